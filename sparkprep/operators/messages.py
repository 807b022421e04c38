"""Messages and conversations: delivery, normalization, rendering, chat templates, cropping, masks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import answer_part, normalized_role, pretoken_count, think_part
from ..session import kept

ROLE_TOKENS = 1
END_TOKENS = 1


def delivered_once(messages: DataFrame) -> DataFrame:
    """(msg_id, conv_id, turn, role, content) of each message, however often it was delivered; partitioned by conv_id.

    Null roles and contents stay; rows that differ in these columns are different messages.
    """
    return messages.select("msg_id", "conv_id", "turn", "role", "content").repartition("conv_id").distinct()


def normalize(messages: DataFrame) -> DataFrame:
    """Messages with a role and a content, roles in one spelling; blank content is kept, order is that of turn and msg_id."""
    out = messages.select("msg_id", "conv_id", "turn", normalized_role(F.col("role")).alias("role"), F.coalesce("content", F.lit("")).alias("content"))
    return out.where("role <> '' and content <> ''")


def render_prompt(normalized: DataFrame) -> DataFrame:
    """(conv_id, prompt): system, user and assistant messages with role and end marks, then an open assistant mark.

    Other roles are dropped; a conversation of only such messages has no row.
    """
    piece = F.concat(F.lit("<|"), F.col("role"), F.lit("|>"), F.col("content"), F.lit("<|end|>"))
    kept = normalized.where(F.col("role").isin("system", "user", "assistant"))
    ordered = F.array_sort(F.collect_list(F.struct("turn", "msg_id", piece.alias("piece"))))
    return kept.groupBy("conv_id").agg(F.concat(F.array_join(F.transform(ordered, lambda s: s["piece"]), ""), F.lit("<|assistant|>")).alias("prompt"))


def segments(normalized: DataFrame) -> DataFrame:
    """(conv_id, turn, msg_id, part, segment, n_tokens, loss, is_answer): runs of tokens of the chat template.

    Role marks carry no loss; of an assistant message reasoning has loss, answer and end mark have loss and are answer.
    Pieces are tokenized apart; reasoning comes only if it is not empty. Tokens are pretokens.
    """
    bot, think = F.col("role") == "assistant", think_part(F.col("content"))
    one, zero = F.lit(1), F.lit(0)

    def piece(part: int, name: str, n: Column, loss: Column, answer: Column) -> Column:
        return F.struct(F.lit(part).alias("part"), F.lit(name).alias("segment"), n.cast("bigint").alias("n_tokens"), loss.alias("loss"), answer.alias("is_answer"))

    flag = F.when(bot, one).otherwise(zero)
    pieces = F.array(
        piece(0, "role", F.lit(ROLE_TOKENS), zero, zero),
        F.when(bot & (think != ""), piece(1, "think", pretoken_count(think), one, zero)),
        piece(2, "content", F.when(bot, pretoken_count(answer_part(F.col("content")))).otherwise(pretoken_count(F.col("content"))), flag, flag),
        piece(3, "end", F.lit(END_TOKENS), flag, flag),
    )
    return normalized.select("conv_id", "turn", "msg_id", F.explode(F.filter(pieces, lambda p: p.isNotNull())).alias("p")).select("conv_id", "turn", "msg_id", "p.*")


def crop(segs: DataFrame, max_len: int) -> DataFrame:
    """Segments with ``kept``, their tokens after cropping to ``max_len`` tokens, and ``status`` of the conversation; ``ids`` stay if there are any.

    Too long conversations lose their earliest reasoning tokens, over all turns, as many as they are too long; answers and
    prompts are never cut. ``overflow``: not enough reasoning to cut (checked first); ``skip``: no token with loss.
    """
    conv = W.partitionBy("conv_id")
    before = conv.orderBy("turn", "msg_id", "part").rowsBetween(W.unboundedPreceding, -1)
    think = F.when((F.col("loss") == 1) & (F.col("is_answer") == 0), F.col("n_tokens")).otherwise(0)
    out = segs.withColumns({"think": think, "total": F.sum("n_tokens").over(conv), "masked": F.sum(F.col("n_tokens") * F.col("loss")).over(conv)})
    out = out.withColumns({"reasoning": F.sum("think").over(conv), "earlier": F.coalesce(F.sum("think").over(before), F.lit(0)), "excess": F.greatest(F.col("total") - max_len, F.lit(0))})
    status = F.when(F.col("excess") > F.col("reasoning"), "overflow").when(F.col("masked") - F.col("excess") <= 0, "skip").otherwise("ok")
    dropped = F.least(F.col("think"), F.greatest(F.col("excess") - F.col("earlier"), F.lit(0)))
    return out.select("conv_id", "turn", "msg_id", "part", "segment", "n_tokens", "loss", "is_answer", (F.col("n_tokens") - dropped).alias("kept"), "excess", status.alias("status"), *[c for c in segs.columns if c == "ids"])


def label_mask(ids: Column, mask: Column, shift: int = 0) -> Column:
    """Token ids where the mask is 1, else -100; ``shift`` 1 moves labels one place forward."""
    labels = F.zip_with(ids, mask, lambda i, m: F.when(m == 1, i.cast("int")).otherwise(-100))
    return labels if not shift else F.concat(F.slice(labels, 2, F.greatest(F.size(labels) - 1, F.lit(0))), F.array(F.lit(-100)))


def collate(rows: DataFrame, key: str, n: str, batch: int, drop_last: bool = False) -> DataFrame:
    """(batch_id, position, key, n, width, padding): consecutive batches of ``batch`` rows in key order, each as wide as its longest.

    Ranks come from counts of sampled key ranges, so no single task sorts all rows, and the input is computed once.
    """
    ranked = global_rank(rows, key)
    out = ranked.withColumns({"batch_id": F.floor(F.col("rank") / batch), "position": F.col("rank") % batch})
    own = W.partitionBy("batch_id")
    out = out.withColumns({"width": F.max(n).over(own), "filled": F.count(F.lit(1)).over(own)})
    if drop_last:
        out = out.where(F.col("filled") == batch)
    return out.select("batch_id", "position", key, n, "width", (F.col("width") - F.col(n)).alias("padding"))


def global_rank(df: DataFrame, *keys: str) -> DataFrame:
    """Rows with ``rank``, their 0-based place in the order of ``keys``, which must be unique; null keys come first.

    The rows are computed once and kept; Spark samples ranges of the keys and sorts each, so skewed keys share no task. A rank
    is the place inside a range plus the counts of the ranges before; only these counts, one a partition, meet in one task.
    """
    ranged = kept(df).repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("__at", F.monotonically_increasing_id())
    part = F.shiftright("__at", 33)
    counts = ranged.groupBy(part.alias("__part")).agg(F.count(F.lit(1)).alias("__n"))
    before = W.orderBy("__part").rowsBetween(W.unboundedPreceding, -1)
    counts = counts.select("__part", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    inside = F.col("__at").bitwiseAND(F.lit((1 << 33) - 1))
    return ranged.join(counts, part == F.col("__part")).withColumn("rank", F.col("__before") + inside).drop("__at", "__part", "__before")
