"""Greedy next-fit packing of token sequences, by shards, and rows of concatenated ids."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..order import stable_key

#: Sequences of a shard on average; a shard is folded by one task.
SHARD_ITEMS = 4096


def shard_count(n: Column, items: int = SHARD_ITEMS) -> Column:
    """Number of shards for ``n`` sequences."""
    return F.greatest(F.lit(1), F.ceil(n / items)).cast("bigint")


def next_fit(used: np.ndarray, max_len: int) -> np.ndarray:
    """Bin of each sequence in turn: one that does not fit into the open bin opens the next."""
    ends = np.cumsum(used)
    bins, at, number = np.empty(len(used), np.int64), 0, 0
    while at < len(used):
        base = ends[at] - used[at]
        end = max(int(np.searchsorted(ends, base + max_len, "right")), at + 1)
        bins[at:end] = number
        at, number = end, number + 1
    return bins


def pack(lengths: DataFrame, key: str, n: str, max_len: int, seed: int = 1234, shards: Column | int | None = None) -> DataFrame:
    """(shard, bin, place, key, n, n_used): next-fit in the stable order within each hash shard; ``place`` is the order of a shard.

    A sequence that does not fit into the open row opens the next one; longer ones than a row are cut to it; empty ones take
    no room; null lengths count as 0. Next-fit is sequential, so a shard is one task's fold over (key, length) pairs; there
    are as many shards as ``SHARD_ITEMS`` asks for, by a count of the input in the same query.
    """
    if shards is None:
        shards = shard_count(lengths.agg(F.count(F.lit(1))).scalar())
    count = shards if isinstance(shards, Column) else F.lit(shards)
    slim = lengths.select(F.col(key).alias("key"), F.coalesce(F.col(n), F.lit(0)).cast("bigint").alias("n"), stable_key(seed, key).alias("k"))
    slim = slim.withColumn("shard", F.conv(F.substring("k", 1, 8), 16, 10).cast("bigint") % count)
    kind = dict(slim.dtypes)["key"]

    def fold(items: pa.Table) -> pa.Table:
        items = items.sort_by([("k", "ascending"), ("key", "ascending")])
        size = items.column("n").to_numpy()
        used = np.minimum(size, max_len)
        columns = [items.column("shard"), pa.array(next_fit(used, max_len)), pa.array(np.arange(len(size))), items.column("key"), items.column("n"), pa.array(used)]
        return pa.table(columns, ["shard", "bin", "place", "key", "n", "n_used"])

    out = slim.groupBy("shard").applyInArrow(fold, f"shard bigint, bin bigint, place bigint, key {kind}, n bigint, n_used bigint")
    return out.withColumnRenamed("key", key)


def utilization(packed: DataFrame, max_len: int) -> DataFrame:
    """(n_rows, n_tokens, percent): rows, tokens before cutting, and their share of the rows' room; 0 without rows."""
    rows = packed.groupBy("shard", "bin").agg(F.sum("n").alias("t"))
    out = rows.agg(F.count(F.lit(1)).alias("n_rows"), F.coalesce(F.sum("t"), F.lit(0)).alias("n_tokens"))
    return out.withColumn("percent", F.round(F.when(F.col("n_rows") > 0, 100 * F.col("n_tokens") / (F.col("n_rows") * max_len)).otherwise(0.0), 6))


def packed_rows(records: DataFrame, key: str, max_len: int, pad_id: int, seed: int = 1234, shards: Column | int | None = None) -> DataFrame:
    """(shard, bin, n_sequences, input_ids, labels, attention_mask, is_answer): packed records as rows of ``max_len`` tokens.

    ``records`` has arrays ids, mask and is_answer. A row holds its sequences one after the other; the rest is ``pad_id`` with
    label -100, attention 0 and no answer. Records longer than a row are cut to it; empty ones are left out. A row has at most
    ``max_len`` sequences, as each has a token.
    """
    full = records.where(F.size("ids") > 0)
    place = pack(full.select(key, F.size("ids").alias("n")), key, "n", max_len, seed, shards).select(key, "shard", "bin", "place")
    cut = [F.slice(c, 1, max_len).alias(c) for c in ("ids", "mask", "is_answer")]
    joined = place.join(full.select(key, *cut), key)
    rows = joined.groupBy("shard", "bin").agg(F.array_sort(F.collect_list(F.struct("place", "ids", "mask", "is_answer"))).alias("s"))

    def flat(field: str) -> Column:
        return F.flatten(F.transform("s", lambda x: x[field]))

    rows = rows.select("shard", "bin", F.size("s").alias("n_sequences"), flat("ids").alias("i"), flat("mask").alias("m"), flat("is_answer").alias("a"))
    rest = F.lit(max_len) - F.size("i")

    def padded(values: Column, fill: int, kind: str) -> Column:
        return F.concat(values.cast(f"array<{kind}>"), F.array_repeat(F.lit(fill).cast(kind), rest))

    labels = F.zip_with("i", "m", lambda i, m: F.when(m == 1, i.cast("int")).otherwise(-100))
    return rows.select(
        "shard", "bin", "n_sequences", padded(F.col("i"), pad_id, "int").alias("input_ids"), padded(labels, -100, "int").alias("labels"),
        padded(F.transform("i", lambda _: F.lit(1)), 0, "tinyint").alias("attention_mask"), padded(F.col("a"), 0, "tinyint").alias("is_answer"),
    )


def packed_by_split(records: DataFrame, key: str, split: str, max_len: int, pad_id: int) -> DataFrame:
    """``packed_rows`` of the train and of the validation records apart, with the column ``split``; no row holds both."""
    parts = [packed_rows(records.where(F.col(split) == s), key, max_len, pad_id).withColumn("split", F.lit(s)) for s in ("train", "val")]
    return parts[0].unionByName(parts[1])
