"""Token records with their ids: chat template, crop, document chunks, labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import encoders
from ..functions.text import answer_part, think_part
from .messages import crop

END_MARK = "<|end|>"


def encoded_segments(normalized: DataFrame, path: str, backend: str = "auto") -> DataFrame:
    """(conv_id, turn, msg_id, part, segment, n_tokens, loss, is_answer, ids): the pieces of the chat template with their ids.

    A message is its role mark, its reasoning (of an assistant, if any), its content and the end mark; pieces are tokenized apart.
    Role marks carry no loss; of an assistant message reasoning has loss, answer and end mark have loss and are answer.
    """
    bot, think = F.col("role") == "assistant", think_part(F.col("content"))
    flag = F.when(bot, 1).otherwise(0)

    def piece(part: int, name: str, text: Column, loss: Column, answer: Column) -> Column:
        return F.struct(F.lit(part).alias("part"), F.lit(name).alias("segment"), text.alias("text"), loss.alias("loss"), answer.alias("is_answer"))

    zero, one = F.lit(0), F.lit(1)
    pieces = F.array(
        piece(0, "role", F.concat(F.lit("<|"), F.col("role"), F.lit("|>")), zero, zero), F.when(bot & (think != ""), piece(1, "think", think, one, zero)),
        piece(2, "content", F.when(bot, answer_part(F.col("content"))).otherwise(F.col("content")), flag, flag), piece(3, "end", F.lit(END_MARK), flag, flag),
    )
    rows = normalized.select("conv_id", "turn", "msg_id", F.explode(F.filter(pieces, lambda p: p.isNotNull())).alias("p")).select("conv_id", "turn", "msg_id", "p.*")
    out = encoders.encoded(rows, {"text": "ids"}, path, backend)
    return out.withColumn("n_tokens", F.size("ids").cast("bigint"))


def chat_records(normalized: DataFrame, max_len: int, path: str, backend: str = "auto") -> DataFrame:
    """(conv_id, ids, mask, is_answer): one record for each conversation of status ok (see ``messages.crop``), at most ``max_len`` tokens.

    Only pieces of such conversations are collected, after cropping, so a row is bounded by ``max_len`` whatever its conversation
    holds. Messages without a conversation make no record.
    """
    segs = crop(encoded_segments(normalized.where("conv_id is not null"), path, backend), max_len).where("status = 'ok' and kept > 0")
    cut = segs.withColumn("ids", F.slice("ids", (F.col("n_tokens") - F.col("kept") + 1).cast("int"), F.col("kept").cast("int")))
    rows = cut.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "msg_id", "part", "ids", "loss", "is_answer"))).alias("s"))

    def flags(field: str) -> Column:
        return F.flatten(F.transform("s", lambda x: F.array_repeat(x[field].cast("tinyint"), F.size(x["ids"]))))

    return rows.select("conv_id", F.flatten(F.transform("s", lambda x: x["ids"])).alias("ids"), flags("loss").alias("mask"), flags("is_answer").alias("is_answer"))


def chunk_records(docs: DataFrame, key: str, text: str, path: str, backend: str = "auto", size: int = 7800, least: int = 64, role: str = "<|assistant|>") -> DataFrame:
    """(key, chunk, ids, mask, is_answer): windows of ``size`` ids without overlap, each between a role mark and the end mark.

    Blank texts and pieces under ``least`` ids have no row. The role mark has no loss, all else has loss and is answer.
    """
    from .mixing import not_blank

    marks = encoders.load(path, backend)([role, END_MARK])
    whole = encoders.encoded(docs.where(not_blank(F.col(text))).select(key, text), {text: "whole"}, path, backend)
    starts = F.sequence(F.lit(0), F.size("whole") - 1, F.lit(size))
    pieces = whole.where(F.size("whole") > 0).select(key, F.posexplode(F.transform(starts, lambda s: F.slice("whole", s + 1, size))).alias("chunk", "piece")).where(F.size("piece") >= least)
    begin, end = (F.array(*[F.lit(i) for i in m]) for m in marks)
    ids = F.concat(begin, F.col("piece"), end)
    loss = F.concat(F.array_repeat(F.lit(0).cast("tinyint"), len(marks[0])), F.array_repeat(F.lit(1).cast("tinyint"), F.size("piece") + len(marks[1])))
    return pieces.select(key, F.col("chunk").cast("bigint").alias("chunk"), ids.alias("ids"), loss.alias("mask"), loss.alias("is_answer"))


def used_ids(records: DataFrame, special: list[int]) -> DataFrame:
    """(id, n, special): every id in the records with its number of places, and the special ids whether used or not."""
    counts = records.select(F.explode("ids").alias("id")).groupBy("id").agg(F.count(F.lit(1)).alias("n"))
    fixed = records.sparkSession.createDataFrame([(i,) for i in special], "id int").withColumn("special", F.lit(True))
    return counts.join(fixed, "id", "full").select("id", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("special", F.lit(False)).alias("special"))


def hex_text(ids: Column) -> Column:
    """Ids as four hex digits each, to compare arrays by one string."""
    return F.array_join(F.transform(ids, lambda i: F.lpad(F.hex(i), 4, "0")), "")
