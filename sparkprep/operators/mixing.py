"""Source mixing, sampling and splits, all in a stable pseudo-random order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import pretoken_count
from ..order import stable_key
from ..session import kept
from .messages import global_rank

CHUNK_TOKENS, LEAST_TOKENS = 7800, 64


#: Fixed value: white space of Unicode, beyond which a text is not blank.
BLANKS = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def not_blank(text: Column) -> Column:
    """Whether anything is left of a text without white space at its ends; false for null."""
    return F.length(F.trim(F.coalesce(text, F.lit("")), F.lit(BLANKS))) > 0


def chunks(docs: DataFrame, size: int = CHUNK_TOKENS, least: int = LEAST_TOKENS) -> DataFrame:
    """(doc_id, chunk, first_token, n_tokens, n_with_marks): windows of ``size`` tokens without overlap.

    Blank texts and pieces under ``least`` tokens have no row. Each piece is wrapped in one role and one end token.
    """
    n = docs.where(not_blank(F.col("text"))).select("doc_id", pretoken_count(F.col("text")).alias("total"))
    starts = n.where("total > 0").select("doc_id", "total", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("total") - 1, F.lit(size).cast("bigint"))).alias("first_token"))
    length = F.least(F.lit(size).cast("bigint"), F.col("total") - F.col("first_token"))
    out = starts.select("doc_id", (F.col("first_token") / size).cast("bigint").alias("chunk"), "first_token", length.alias("n_tokens"))
    return out.where(F.col("n_tokens") >= least).withColumn("n_with_marks", F.col("n_tokens") + 2)


def document_tokens(docs: DataFrame, size: int = CHUNK_TOKENS, least: int = LEAST_TOKENS) -> DataFrame:
    """(doc_id, source, n): tokens of the pieces of each document that are kept; documents without any have no row."""
    total = docs.where(not_blank(F.col("text"))).select("doc_id", "source", pretoken_count(F.col("text")).alias("t"))
    rest = F.col("t") % size
    return total.select("doc_id", "source", (F.col("t") - F.when(rest < least, rest).otherwise(0)).alias("n")).where("n > 0")


def budgeted_mix(tokens: DataFrame, budget: Column, seed: int = 1234, buckets: int = 256) -> DataFrame:
    """(doc_id, source, n, before, place): documents kept under each source's token budget.

    In the stable order of a source, a document is kept while the tokens before it stay under the budget; the last one may
    pass it. ``place`` is the document's share of its budget, by which sources interleave. Sources with budget 0 or less, and
    null sources, are never kept. Prefix sums run in two levels (hash ranges of a source, then inside), so that a source
    with a third of all rows does not fall into one task. Counts of tokens are computed once and kept for both levels.
    """
    keyed = kept(tokens.withColumns({"budget": budget, "k": stable_key(seed, "doc_id")}).where("budget > 0"))
    keyed = keyed.withColumn("b", F.conv(F.substring("k", 1, 2), 16, 10).cast("int") % buckets)
    sums = keyed.groupBy("source", "b").agg(F.sum("n").alias("s"))
    earlier = W.partitionBy("source").orderBy("b").rowsBetween(W.unboundedPreceding, -1)
    sums = sums.select("source", "b", F.coalesce(F.sum("s").over(earlier), F.lit(0)).alias("base"))
    inside = W.partitionBy("source", "b").orderBy("k", "doc_id").rowsBetween(W.unboundedPreceding, -1)
    out = keyed.withColumn("own", F.coalesce(F.sum("n").over(inside), F.lit(0))).join(sums, ["source", "b"])
    out = out.withColumn("before", F.col("base") + F.col("own")).where("before < budget")
    return out.select("doc_id", "source", "n", "before", ((F.col("before") + F.col("n") / 2) / F.col("budget")).alias("place"))


def interleave(docs: DataFrame, subset: str) -> DataFrame:
    """(doc_id, subset, turn): one document of each subset in turn, in doc_id order, until the first subset is used up.

    Null subsets take no part. The order of (subset, doc_id) is ranked globally by sampled ranges, and a document's turn is its rank
    less the rows of the subsets before, so a subset with a third of all rows is spread over many tasks. One scan.
    """
    named = kept(docs.where(F.col(subset).isNotNull()).select("doc_id", subset))
    sizes = named.groupBy(subset).agg(F.count(F.lit(1)).alias("s"))
    earlier = W.orderBy(subset).rowsBetween(W.unboundedPreceding, -1)
    base = sizes.select(subset, F.coalesce(F.sum("s").over(earlier), F.lit(0)).alias("base"), F.min("s").over(W.partitionBy()).alias("least"))
    ranked = global_rank(named, subset, "doc_id").join(base, subset)
    return ranked.withColumn("turn", F.col("rank") - F.col("base") + 1).where("turn <= least").select("doc_id", subset, "turn")


def stratified_sample(docs: DataFrame, stratum: str, target: int, seed: int = 1234) -> DataFrame:
    """(doc_id, stratum): of each stratum floor(target * its share) rows, the first in the stable order.

    Null is a stratum. Totals may stay below the target by the floors. Only hash ranges that can hold the limit are ranked
    together; each range is one task's work.
    """
    keyed = kept(docs.select("doc_id", stratum, stable_key(seed, "doc_id").alias("k"))).withColumn("b", F.substring("k", 1, 2))
    sizes = keyed.groupBy(stratum, "b").agg(F.count(F.lit(1)).alias("s"))
    earlier = W.partitionBy(stratum).orderBy("b").rowsBetween(W.unboundedPreceding, -1)
    whole = W.partitionBy(stratum)
    total = keyed.agg(F.count(F.lit(1))).scalar()
    base = sizes.withColumns({"base": F.coalesce(F.sum("s").over(earlier), F.lit(0)), "size": F.sum("s").over(whole)})
    base = base.select(F.col(stratum).alias("st"), F.col("b").alias("bb"), "base", F.floor(F.lit(target) * F.col("size") / total).alias("take")).where("base < take")
    ranked = keyed.withColumn("own", F.row_number().over(W.partitionBy(stratum, "b").orderBy("k", "doc_id")))
    joined = ranked.join(base, (F.col(stratum).eqNullSafe(F.col("st"))) & (F.col("b") == F.col("bb")))
    return joined.where(F.col("base") + F.col("own") <= F.col("take")).select("doc_id", stratum)


def shuffle_take(docs: DataFrame, n: int, seed: int = 1234) -> DataFrame:
    """The first n documents of the stable order."""
    return docs.select("doc_id", stable_key(seed, "doc_id").alias("k")).orderBy("k", "doc_id").limit(n)


def train_val_split(docs: DataFrame, fraction: float = 0.05, seed: int = 42) -> DataFrame:
    """(doc_id, split): max(1, floor(n * fraction)) rows of the stable order are 'val', the others 'train'.

    With fraction 0, or where the validation part would take all rows, everything is 'train'.
    """
    keyed = kept(docs.select("doc_id", stable_key(seed, "doc_id").alias("k")))
    n = keyed.agg(F.count(F.lit(1))).scalar()
    val = F.when(F.lit(fraction) > 0, F.greatest(F.lit(1), F.floor(n * fraction))).otherwise(0)
    return global_rank(keyed, "k", "doc_id").select("doc_id", F.when((val < n) & (F.col("rank") < val), "val").otherwise("train").alias("split"))


def aligned(docs: DataFrame, *candidates: str) -> DataFrame:
    """(content): the first of the columns ``candidates`` that a source has, and nothing else, so that sources of any schema can be joined.

    A source without any of them is an error.
    """
    name = next((c for c in candidates if c in docs.columns), None)
    if name is None:
        raise ValueError(f"none of {', '.join(candidates)} among {', '.join(docs.columns)}")
    return docs.select(F.col(name).alias("content"))
