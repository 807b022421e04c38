"""Problem 7: filling rows of fixed capacity with documents (conflict-constrained best fit)."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import prefix_bpe
from .common import TOKENIZER_DIR, kept


#: Tokens and items of a shard, which is packed alone; shards follow from the data, not from the session.
SHARD_TOKENS, SHARD_ITEMS = 8_000_000, 200_000


class BestFit:
    """Bins of one shard, ordered by the room left, with bitmaps of what is in them.

    An integer's bits tell which rooms have bins, so the tightest room that holds a size is found by one shift. A bin's bitmap
    has a bit for each source and one for each duplicate cluster of several members; an item never joins a bin that shares a
    bit of ``hard`` with it. The search goes on to larger rooms until it finds a compatible bin, and opens a bin if there is
    none. Among compatible bins of equal room one without the item's ``soft`` bits is preferred.
    """

    def __init__(self, capacity: int):
        self.capacity, self.mask = capacity, 0
        self.by_room: list[dict[int, list[int]]] = [{} for _ in range(capacity + 1)]
        self.n = 0

    def place(self, size: int, hard: int, soft: int) -> int:
        """The tightest compatible bin, which takes the item."""
        floor = size
        while above := self.mask >> floor:
            floor += (above & -above).bit_length() - 1
            level, found = self.by_room[floor], None
            for bits in level:
                if not bits & hard:
                    found = bits
                    if not bits & soft:
                        break
            if found is not None:
                b = level[found].pop()
                if not level[found]:
                    del level[found]
                    if not level:
                        self.mask &= ~(1 << floor)
                return self._put(b, floor - size, found | hard | soft)
            floor += 1
        self.n += 1
        return self._put(self.n - 1, self.capacity - size, hard | soft)

    def _put(self, b: int, room: int, bits: int) -> int:
        self.by_room[room].setdefault(bits, []).append(b)
        self.mask |= 1 << room
        return b


def pack_shard(key: np.ndarray, size: np.ndarray, source: np.ndarray, cluster: np.ndarray, capacity: int, apart: bool = False) -> np.ndarray:
    """Bin number of each item of a shard, for sizes up to ``capacity``; independent of the order of the items.

    Two members of a cluster never share a bin; with ``apart`` neither do two items of a source. Items of size 0 hold
    nothing that could conflict: they are spread over the bins there are.
    """
    order = np.lexsort((key, cluster, -size))
    bins, fit = np.zeros(len(key), np.int64), BestFit(capacity)
    names, at, n = np.unique(cluster[size > 0], return_inverse=True, return_counts=True)
    several = np.cumsum(n > 1) - 1
    cluster_bit = np.full(len(key), -1)
    cluster_bit[size > 0] = np.where(n[at] > 1, several[at], -1)
    sources = np.unique(source, return_inverse=True)[1] + int((n > 1).sum())
    filled = order[size[order] > 0]
    for i in filled:
        own, other = 1 << int(cluster_bit[i]) if cluster_bit[i] >= 0 else 0, 1 << int(sources[i])
        bins[i] = fit.place(int(size[i]), own | other, 0) if apart else fit.place(int(size[i]), own, other)
    empty = order[size[order] == 0]
    bins[empty] = np.arange(len(empty)) % max(fit.n, 1)
    return bins


def _packed(table: pa.Table, capacity: int, apart: bool) -> pa.Table:
    """Pieces of the items of one shard with their rows."""
    key, n, source, cluster = (table.column(c).to_numpy() for c in ("k", "n", "s", "c"))
    key = np.where(np.isnan(key), np.iinfo(np.int64).min, key).astype(np.int64) if key.dtype.kind == "f" else key
    full = np.where(n > capacity, n // capacity, 0)
    rest = n - full * capacity
    packed = (rest > 0) | (n == 0)
    # full rows of oversized items
    owner = np.repeat(np.arange(len(key)), full)
    number = np.arange(len(owner)) - np.repeat(np.cumsum(full) - full, full)
    at = np.flatnonzero(packed)
    bins = pack_shard(key[at], rest[at], source[at], cluster[at], capacity, apart)
    order = np.lexsort((key[at], bins))
    slot = np.empty(len(at), np.int64)
    slot[order] = np.arange(len(at)) - np.searchsorted(bins[order], bins[order])
    top = int(bins.max()) + 1 if len(bins) else 0
    shard = table.column("shard")[0].as_py()
    columns = {
        "k": table.column("k").take(pa.array(np.concatenate([owner, at]))).combine_chunks(), "piece_no": np.concatenate([number, full[at]]),
        "first_token": np.concatenate([number * capacity, full[at] * capacity]), "n_tokens": np.concatenate([np.full(len(owner), capacity), rest[at]]),
        "row_id": (shard << 40) + np.concatenate([top + np.arange(len(owner)), bins]), "slot": np.concatenate([np.zeros(len(owner), np.int64), slot]),
    }
    return pa.table(columns)


def pack_rows(items: DataFrame, key: str, size: str, source: str, cluster: str, capacity: int = 2048, apart: bool = False) -> DataFrame:
    """(key, piece_no, first_token, n_tokens, row_id, slot): every item in exactly one row, or in pieces if it is larger.

    A conflict is a row with two members of one duplicate cluster; there is none. Two items of one source in a row are avoided
    where that costs no room, and ruled out with ``apart``, which costs rows. An item larger than ``capacity`` gives full rows
    and one rest, which is packed like any item. Items of size 0 take no room and are spread over the rows. A null size counts as 0,
    a null source as a source of its own, a null cluster as a cluster of the item alone; a null key is kept.

    Sizes are computed once and kept in the shared folder; their sum gives the number of hash shards, whatever the session
    shuffles into, so the rows are the same with any number of partitions. Each shard packs its sizes alone (best fit,
    descending), which costs at most about one open row a shard of some 4,000. Only sizes are moved, never texts.
    """
    slim = kept(items.select(
        F.col(key).cast("bigint").alias("k"), F.coalesce(F.col(size), F.lit(0)).cast("bigint").alias("n"),
        F.coalesce(F.xxhash64(F.col(source)), F.lit(0)).alias("s"), F.coalesce(F.col(cluster).cast("bigint"), F.xxhash64(F.lit("alone"), F.col(key))).alias("c"),
    ))
    tokens, rows = slim.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
    shards = max(1, -(-tokens // SHARD_TOKENS), -(-rows // SHARD_ITEMS))
    sharded = slim.withColumn("shard", F.pmod(F.xxhash64("k", "n", "s"), F.lit(shards)))
    schema = "k bigint, piece_no bigint, first_token bigint, n_tokens bigint, row_id bigint, slot bigint"
    out = sharded.groupBy("shard").applyInArrow(lambda t: _packed(t, capacity, apart), schema)
    return out.withColumnRenamed("k", key)


_WORD = re.compile(r"[^\W_]+")


def text_cluster(text: str | None) -> int | None:
    """Hash of the words of a text in lower case: texts that differ in marks, case and white space only share it. None without words."""
    words = _WORD.findall(text.lower()) if text else []
    return xxhash.xxh3_64_intdigest(" ".join(words)) - (1 << 63) if words else None


def document_sizes(docs: DataFrame, name: str = "byte_bpe_50k", tokenizer_dir: str = TOKENIZER_DIR) -> DataFrame:
    """(doc_id, source, n_tokens, cluster): tokens of each text and its ``text_cluster``; null and empty texts have 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = prefix_bpe.load(name, tokenizer_dir)
        for x in batches:
            if x.num_rows:
                texts = x.column(2).to_pylist()
                columns = [x.column(0), x.column(1), pa.array(map(text_cluster, texts), pa.int64()), pa.array(map(bpe.count, texts), pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "source", "cluster", "n_tokens"])

    slim = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "source", "text")
    return slim.mapInArrow(run, "doc_id bigint, source string, cluster bigint, n_tokens bigint")
