"""Problem 2: near-duplicate texts by banded SetSketch registers, a likelihood bound, and exact verification.

Plan (no cross join, nothing unbounded in one row, task or on the driver):

1. every text becomes the set of its word sequences; equal sets within a batch are combined at once into one row of a
   *class* (side and set hash, message ids, hashes of the sequences);
2. classes are hash-partitioned once, which brings all copies together; a group of copies is from here on one class. A
   partition is read in the order of its classes, slice by slice;
3. each class sends its band keys, 13 bytes each, to as many buckets as the input's bytes ask for; a task takes its buckets
   one by one. The bands whose key another class has too are told to the class, and only for these it sends a row with two
   bits of each register and its size: 48 bytes;
4. rows with one key are compared by bits and sizes in vectors; keys with very many classes are cut into blocks, which other
   tasks send to each other, so that no task writes or compares all pairs of a key. Unlike texts that share common sequences
   meet in numbers that grow with the square of the input; two bits leave so few of them that what is moved next does not;
5. the pairs left are joined with the sequence hashes of step 2 (the same exchange); their similarity is estimated jointly
   from both sketches by likelihood, and what the estimate leaves is verified exactly;
6. for groups, the components of the classes are contracted in rounds, and messages follow by their class.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import set_sketch
from .common import kept, side

_WORD = re.compile(r"[^\W_]+")
_MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9), np.uint64(0xD6E8FEB86659FD93), np.uint64(0xA0761D6478BD642F))

#: The low bits of a class's number are a hash of its group; classes of different groups are never compared.
_GROUP = 0xFFFF

#: Rows with one band key that are compared at once; more are cut into blocks of this size.
BLOCK = 2048

#: Bits of each register in a band row.
PLANES = 2

#: Keys of a class in one row, the pairs of two rows being expanded together; rows in one batch.
MEMBERS, _AT_ONCE = 256, 1000
_KEYS = pa.list_(pa.int64())


class _Words(dict):
    def __missing__(self, word: str) -> int:
        out = xxhash.xxh3_64_intdigest(word)
        if len(self) > 1_000_000:
            self.clear()
        self[word] = out
        return out


_HASHES = _Words()


def sequences(text: str, k: int, least_words: int) -> np.ndarray | None:
    """Sorted distinct 32-bit hashes of the k-word sequences; None if the text has too few different words."""
    words = _WORD.findall(text.lower())
    if len(words) < max(k, least_words):
        return None
    ids = np.fromiter(map(_HASHES.__getitem__, words), np.uint64, len(words))
    if len(set(words)) < least_words:
        return None
    n = len(ids) - k + 1
    h = np.zeros(n, np.uint64)
    for i in range(k):
        h = (h ^ ids[i : i + n]) * _MIX[i % len(_MIX)]
        h ^= h >> np.uint64(29)
    h = np.sort((h >> np.uint64(32)).astype(np.uint32))
    return h[np.concatenate([[True], h[1:] != h[:-1]])]


def _class_rows(batches: Iterator[pa.RecordBatch], k: int, least_words: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found: dict[int, list] = {}
        for key, who, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist()):
            items = sequences(text, k, least_words)
            if items is not None:
                name = (xxhash.xxh3_64_intdigest(items.tobytes()) >> 16 << 16 | xxhash.xxh3_64_intdigest(who) & _GROUP) - (1 << 63)
                if (own := found.get(name)) is None:
                    found[name] = [[key], items]
                else:
                    own[0].append(key)
        if found:
            ids = [np.array(v[0], np.int64).tobytes() for v in found.values()]
            sets = [v[1].tobytes() for v in found.values()]
            yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.int64()), pa.array(ids, pa.binary()), pa.array(sets, pa.binary())], ["c", "ids", "items"])


def text_classes(df: DataFrame, key: str, group: Column, text: str, k: int = 3, least_words: int = 40) -> DataFrame:
    """(c, ids, items), hash-partitioned by c: classes of equal sequence sets within a group.

    Several rows of one class can remain, one for each input batch that has it. Null texts and texts with fewer than
    ``least_words`` different words have no class. Words are maximal runs of letters and digits in lower case.
    """
    slim = df.select(F.col(key).cast("bigint").alias("k"), group.alias("g"), F.col(text).alias("t")).where("g is not null and t is not null and k is not null")
    rows = slim.mapInArrow(lambda b: _class_rows(b, k, least_words), "c bigint, ids binary, items binary")
    rows = rows.where("c is not null")  # always true; the filter of later joins is then the same, and so is the exchange
    return rows.repartition("c")


def _in_order(classes: DataFrame) -> DataFrame:
    """The classes with all rows of a class in a row."""
    return classes.sortWithinPartitions("c")


def _classes(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, list[bytes], list[bytes]]]:
    """Distinct classes of a sorted partition with all their ids, in slices; ids of one class are merged."""
    names: list[int] = []
    ids: list[list[bytes]] = []
    items: list[bytes] = []
    for batch in batches:
        for c, i, s in zip(*(batch.column(j).to_pylist() for j in range(3))):
            if names and names[-1] == c:
                ids[-1].append(i)
                continue
            if len(names) >= 5000:
                yield np.array(names, np.int64), [b"".join(x) for x in ids], items
                names, ids, items = [], [], []
            names.append(c)
            ids.append([i])
            items.append(s)
    if names:
        yield np.array(names, np.int64), [b"".join(x) for x in ids], items


def _band_hashes(names: np.ndarray, regs: np.ndarray, bands: int, rows: int) -> Iterator[np.ndarray]:
    """For each band a 64-bit hash of group, band and registers: the key in the low half, the bucket in the high one."""
    for band in range(bands):
        h = ((names & _GROUP).astype(np.uint64) * np.uint64(bands) + np.uint64(band + 1)) * _MIX[3]
        for r in range(rows):
            h = (h ^ regs[:, band * rows + r].astype(np.uint64)) * _MIX[r % 3]
            h ^= h >> np.uint64(31)
        yield h


def _by_bucket(row: np.ndarray, hashes: np.ndarray, parts: int) -> pa.RecordBatch:
    """One record of packed rows for each bucket."""
    part = ((hashes >> np.uint64(32)) % np.uint64(parts)).astype(np.int64)
    order = np.argsort(part, kind="stable")
    row, part = row[order], part[order]
    cuts = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]]))
    ends = np.append(cuts[1:], len(part))
    return pa.RecordBatch.from_arrays([pa.array(part[cuts]), pa.array([row[a:b].tobytes() for a, b in zip(cuts, ends)], pa.binary())], ["p", "rows"])


_KEY_ROW = np.dtype([("key", "<u4"), ("c", "<i8"), ("band", "u1")])


def _sketched(items: list[bytes], m: int) -> tuple[np.ndarray, np.ndarray]:
    """(sizes, registers) of packed sets."""
    sizes = np.array([len(x) // 4 for x in items], np.int64)
    return sizes, set_sketch.registers(np.frombuffer(b"".join(items), np.uint32), np.cumsum(sizes) - sizes, m)


def _key_rows(batches: Iterator[pa.RecordBatch], bands: int, rows: int, m: int, parts: int) -> Iterator[pa.RecordBatch]:
    """Packed band keys of all classes, one record for each bucket and slice of classes."""
    for names, _, items in _classes(batches):
        hashes = np.concatenate(list(_band_hashes(names, _sketched(items, m)[1], bands, rows)))
        row = np.empty(len(hashes), _KEY_ROW)
        row["key"], row["c"], row["band"] = hashes & np.uint64(0xFFFFFFFF), np.tile(names, bands), np.repeat(np.arange(bands), len(names))
        yield _by_bucket(row, hashes, parts)


def _shared_bands(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(c, shared): of each bucket the classes that have a key with another class, with their bands as bits."""
    for row in _buckets(batches, _KEY_ROW):
        row = row[np.lexsort((row["c"], row["key"]))]
        new_key = row["key"][1:] != row["key"][:-1]
        fresh = np.concatenate([[True], new_key | (row["c"][1:] != row["c"][:-1])])
        key = np.cumsum(np.concatenate([[0], new_key]))
        row = row[np.bincount(key, fresh)[key] > 1]
        if len(row):
            c, at = np.unique(row["c"], return_inverse=True)
            shared = np.zeros(len(c), np.int64)
            np.bitwise_or.at(shared, at, np.int64(1) << row["band"].astype(np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(c), pa.array(shared)], ["c", "shared"])


def _band_rows(batches: Iterator[pa.RecordBatch], bands: int, rows: int, m: int, parts: int) -> Iterator[pa.RecordBatch]:
    """Packed rows of the bands that a class shares, one record for each bucket and slice of classes (c, items, shared)."""
    for batch in batches:
        for s in range(0, batch.num_rows, 5000):
            names, shared = (batch.column(i).slice(s, 5000).to_numpy(zero_copy_only=False) for i in (0, 2))
            sizes, regs = _sketched(batch.column(1).slice(s, 5000).to_pylist(), m)
            bits = set_sketch.pack_bits(regs, PLANES)
            own = [np.flatnonzero(shared >> band & 1) for band in range(bands)]
            hashes = np.concatenate([h[i] for h, i in zip(_band_hashes(names, regs, bands, rows), own)])
            own = np.concatenate(own)
            row = np.empty(len(own), _row_type(bits.shape[1]))
            row["key"], row["c"], row["n"], row["bits"] = hashes & np.uint64(0xFFFFFFFF), names[own], np.minimum(sizes, 0xFFFFFFFF)[own], bits[own]
            yield _by_bucket(row, hashes, parts)


def _row_type(words: int) -> np.dtype:
    return np.dtype([("key", "<u4"), ("n", "<u4"), ("c", "<i8"), ("bits", "<u8", (words,))])


def _likely(row: np.ndarray, a: np.ndarray, b: np.ndarray, threshold: float, sigmas: float) -> tuple[np.ndarray, np.ndarray]:
    """Classes of the index pairs that the likelihood does not rule out, the lesser first."""
    na, nb = row["n"][a].astype(np.int64), row["n"][b].astype(np.int64)
    near = (np.minimum(na, nb) >= threshold * np.maximum(na, nb)) & ((row["c"][a] ^ row["c"][b]) & _GROUP == 0)
    a, b, na, nb = a[near], b[near], na[near], nb[near]
    same = set_sketch.bit_matches(row["bits"][a], row["bits"][b], PLANES)
    ok = same >= set_sketch.least_matches(64 * row["bits"].shape[1] // PLANES, na, nb, threshold, sigmas, PLANES)
    x, y = row["c"][a[ok]], row["c"][b[ok]]
    return np.minimum(x, y), np.maximum(x, y)


def _buckets(batches: Iterator[pa.RecordBatch], kind: np.dtype) -> Iterator[np.ndarray]:
    """Packed rows of each bucket of a partition that is sorted by bucket."""
    name, held = None, []
    for batch in batches:
        for p, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if p != name and held:
                yield np.frombuffer(b"".join(held), kind)
                held = []
            name = p
            held.append(x)
    if held:
        yield np.frombuffer(b"".join(held), kind)


#: Rows of ``_bucket_pairs``: key and number of a block of ``n`` blocks with its band rows; likely pairs are one block (n = 1).
_BLOCKS = "key bigint, i int, n int, block binary, other binary"


def _bucket_pairs(batches: Iterator[pa.RecordBatch], words: int, threshold: float, sigmas: float) -> Iterator[pa.RecordBatch]:
    """Of each bucket's band rows: packed likely pairs, and blocks of the keys that are to be compared elsewhere."""
    for row in _buckets(batches, _row_type(words)):
        row = row[np.lexsort((row["c"], row["key"]))]
        fresh = np.concatenate([[True], (row["key"][1:] != row["key"][:-1]) | (row["c"][1:] != row["c"][:-1])])
        row = row[fresh]
        starts = np.flatnonzero(np.concatenate([[True], row["key"][1:] != row["key"][:-1]]))
        sizes = np.diff(np.append(starts, len(row)))
        left: list[np.ndarray] = []
        right: list[np.ndarray] = []
        for g in np.unique(sizes[(sizes > 1) & (sizes <= BLOCK)]):
            own = starts[sizes == g]
            i, j = np.triu_indices(g, 1)
            step = max(1, 2_000_000 // len(i))
            for s in range(0, len(own), step):
                base = own[s : s + step, None]
                x, y = _likely(row, (base + i).ravel(), (base + j).ravel(), threshold, sigmas)
                left.append(x)
                right.append(y)
        out: list[tuple[int, int, int, bytes, bytes | None]] = []
        if left:
            pairs = np.unique(np.stack([np.concatenate(left), np.concatenate(right)], 1), axis=0)
            for s in range(0, len(pairs), 100_000):
                part = pairs[s : s + 100_000]
                out.append((int(part[0, 0]), 0, 1, np.ascontiguousarray(part[:, 0]).tobytes(), np.ascontiguousarray(part[:, 1]).tobytes()))
        for start, g in zip(starts[sizes > BLOCK], sizes[sizes > BLOCK]):
            n = -(-int(g) // BLOCK)
            out += [(int(row["key"][start]), i, n, row[start + i * BLOCK : min(start + (i + 1) * BLOCK, start + g)].tobytes(), None) for i in range(n)]
        if out:
            key, i, n, block, other = zip(*out)
            yield pa.RecordBatch.from_arrays([pa.array(key, pa.int64()), pa.array(i, pa.int32()), pa.array(n, pa.int32()), pa.array(block, pa.binary()), pa.array(other, pa.binary())], ["key", "i", "n", "block", "other"])


def _met(packed: DataFrame) -> DataFrame:
    """(met): for each two blocks of a key the both of them, for likely pairs themselves. Each block goes to the tasks of its partners."""
    each = packed.select("key", "i", "block", "other", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("j"))
    low, high = F.least("i", "j").alias("low"), F.greatest("i", "j").alias("high")
    alone = F.coalesce(F.xxhash64("other") * F.col("other").isNotNull().cast("bigint"), F.lit(0)).alias("alone")
    return each.groupBy("key", low, high, alone).agg(F.collect_list(F.struct("block", "other")).alias("met")).select("met")


def _block_pairs(batches: Iterator[pa.RecordBatch], words: int, threshold: float, sigmas: float) -> Iterator[pa.RecordBatch]:
    """Rows (a, b) of packed pairs, and of the blocks that are compared here."""
    for batch in batches:
        for met in batch.column(0).to_pylist():
            for a, b in _compared(met, words, threshold, sigmas):
                if len(a):
                    yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])


def _compared(met: list[dict], words: int, threshold: float, sigmas: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    if met[0]["other"] is not None:
        for x in met:
            yield np.frombuffer(x["block"], np.int64), np.frombuffer(x["other"], np.int64)
        return
    blocks = [np.frombuffer(x["block"], _row_type(words)) for x in met]
    one, two, same = blocks[0], blocks[-1], len(blocks) == 1
    both = np.concatenate([one, two])
    for s in range(0, len(one), 256):
        i = np.arange(s, min(s + 256, len(one)))
        p, r = np.repeat(i, len(two)), np.tile(np.arange(len(two)), len(i))
        p, r = (p[p < r], r[p < r]) if same else (p, r)
        yield _likely(both, p, r + len(one), threshold, sigmas)


def bucket_count(df: DataFrame) -> int:
    """Buckets of about one or two megabytes of band rows, by the bytes of the input that the optimizer knows; no job is run."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return int(min(max(size >> 19, 64), 1 << 27))


def similar_classes(classes: DataFrame, buckets: int, threshold: float = 0.5, bands: int = 28, rows: int = 3, m: int = 128, sigmas: float = 3.0) -> DataFrame:
    """(a, b, jaccard): pairs of different classes, a < b, whose sets are at least as similar as ``threshold``.

    A pair of similarity J shares a band with probability 1 - (1 - J^rows)^bands: 0.976 at 0.5, 0.997 at 0.6, above 0.9999
    at 0.7. Verification compares the sets themselves (as 32-bit hashes of their sequences).
    """
    words = PLANES * m // 64
    keys = _in_order(classes).mapInArrow(lambda x: _key_rows(x, bands, rows, m, buckets), "p bigint, rows binary").repartition("p").sortWithinPartitions("p")
    shared = keys.mapInArrow(_shared_bands, "c bigint, shared bigint").groupBy("c").agg(F.expr("bit_or(shared)").alias("shared"))
    # keeps the partitioning of the classes; the filter holds on to all columns, so that the exchange is the same one
    sets = classes.groupBy("c").agg(F.first("items").alias("items"), F.sum(F.length("ids")).alias("w")).where("w > 0")
    banded = sets.join(shared, "c").select("c", "items", "shared").mapInArrow(lambda x: _band_rows(x, bands, rows, m, buckets), "p bigint, rows binary").repartition("p").sortWithinPartitions("p")
    packed = banded.mapInArrow(lambda x: _bucket_pairs(x, words, threshold, sigmas), _BLOCKS)
    likely = _met(packed).mapInArrow(lambda x: _block_pairs(x, words, threshold, sigmas), "a bigint, b bigint").distinct()
    with_a = likely.join(sets.select(F.col("c").alias("a"), F.col("items").alias("x")), "a")
    both = with_a.join(sets.select(F.col("c").alias("b"), F.col("items").alias("y")), "b").select("a", "b", "x", "y")
    return both.mapInArrow(lambda x: _verified(x, threshold, m), "a bigint, b bigint, jaccard double")


#: Deviations of the joint estimate below the threshold within which a pair is still verified.
MARGIN = 4.0


def _verified(batches: Iterator[pa.RecordBatch], threshold: float, m: int) -> Iterator[pa.RecordBatch]:
    """Pairs whose joint estimate does not lie clearly below the threshold, by their exact similarity."""
    least = threshold - MARGIN * (threshold * (1 - threshold) / m) ** 0.5
    for batch in batches:
        rows = []
        for s in range(0, batch.num_rows, 2000):
            left, right, x, y = (batch.column(i).slice(s, 2000).to_pylist() for i in range(4))
            one, two = ([np.frombuffer(v, np.uint32) for v in z] for z in (x, y))
            sizes = [np.array([len(v) for v in z], np.int64) for z in (one, two)]
            sketches = [set_sketch.registers(np.concatenate(z), np.cumsum(n) - n, m) for z, n in zip((one, two), sizes)]
            near = set_sketch.joint_jaccard(*sketches, *sizes) >= least
            for k in np.flatnonzero(near):
                joined = np.concatenate([one[k], two[k]])
                joined.sort(kind="stable")
                both = int((joined[1:] == joined[:-1]).sum())
                if both >= threshold * (j := len(joined) - both):
                    rows.append((left[k], right[k], both / j))
        if rows:
            a, b, j = zip(*rows)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(j)], ["a", "b", "jaccard"])


def _member_rows(batches: Iterator[pa.RecordBatch], expanded: int | None) -> Iterator[pa.RecordBatch]:
    """(c, ids): the members that are linked to other classes, in blocks."""
    cs, blocks = [], []
    for names, ids, _ in _classes(batches):
        for c, x in zip(names.tolist(), ids):
            own = np.unique(np.frombuffer(x, np.int64))
            own = own if expanded is None or len(own) <= expanded else own[:1]
            for s in range(0, len(own), MEMBERS):
                cs.append(c)
                blocks.append(own[s : s + MEMBERS].tolist())
                if len(cs) == _AT_ONCE:
                    yield pa.RecordBatch.from_arrays([pa.array(cs, pa.int64()), pa.array(blocks, _KEYS)], ["c", "ids"])
                    cs, blocks = [], []
    if cs:
        yield pa.RecordBatch.from_arrays([pa.array(cs, pa.int64()), pa.array(blocks, _KEYS)], ["c", "ids"])


def _copy_rows(batches: Iterator[pa.RecordBatch], expanded: int | None) -> Iterator[pa.RecordBatch]:
    """(x, y): blocks of members of one class, whose keys p of x and q of y with p > q are pairs."""
    left, right = [], []
    for _, ids, _ in _classes(batches):
        for own in (np.unique(np.frombuffer(x, np.int64)) for x in ids):
            if len(own) > 1:
                blocks = [own[a : a + MEMBERS].tolist() for a in range(0, len(own), MEMBERS)]
                for i, x in enumerate(blocks):
                    for y in blocks[: i + 1] if expanded is None or len(own) <= expanded else [own[:1].tolist()]:
                        left.append(x)
                        right.append(y)
                        if len(left) == _AT_ONCE:
                            yield pa.RecordBatch.from_arrays([pa.array(left, _KEYS), pa.array(right, _KEYS)], ["x", "y"])
                            left, right = [], []
    if left:
        yield pa.RecordBatch.from_arrays([pa.array(left, _KEYS), pa.array(right, _KEYS)], ["x", "y"])


def near_duplicate_pairs(df: DataFrame, key: str, group: Column, text: str, k: int = 3, least_words: int = 40, threshold: float = 0.5, expanded: int | None = None) -> DataFrame:
    """(a, b), a < b: keys of the rows whose sets of k-word sequences are at least as similar as ``threshold``.

    All pairs come out, those of equal sets included: n copies make n * (n - 1) / 2 rows. They are expanded from blocks of
    ``MEMBERS`` keys that are spread over all tasks. Only where a caller gives ``expanded``, of a class of more than
    so many rows each row is linked to the class's first, and that one to other classes. A key that comes repeatedly
    with one text counts once. Rows with a null key, text or group, and texts with fewer than ``least_words`` different
    words, have no partners.
    """
    classes = text_classes(df, key, group, text, k, least_words)
    members = _in_order(classes).mapInArrow(lambda b: _member_rows(b, expanded), "c bigint, ids array<bigint>")
    copies = _in_order(classes).mapInArrow(lambda b: _copy_rows(b, expanded), "x array<bigint>, y array<bigint>").withColumn("inside", F.lit(True))
    pairs = similar_classes(classes, bucket_count(df), threshold).select("a", "b")
    one = members.select(F.col("c").alias("a"), F.col("ids").alias("x"))
    two = members.select(F.col("c").alias("b"), F.col("ids").alias("y"))
    blocks = pairs.join(one, "a").join(two, "b").select("x", "y").withColumn("inside", F.lit(False)).unionByName(copies)
    blocks = blocks.repartition(F.xxhash64(F.col("x")[0], F.col("y")[0]))
    out = blocks.select(F.explode("x").alias("p"), "y", "inside").select("p", F.explode("y").alias("q"), "inside").where("not inside or p > q")
    return out.select(F.least("p", "q").alias("a"), F.greatest("p", "q").alias("b"))


def components(edges: DataFrame) -> DataFrame:
    """(v, root) for each end v of the edges (a, b): the least end that can be reached from it.

    Large and small stars in turn (Kiveris et al.): each end hangs its greater neighbours, then its lesser ones and itself,
    below the least of them, until nothing changes. The driver gets two counts a round.
    """
    now = kept(edges.select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("u")).where("v > u").distinct())
    while True:
        both = now.unionByName(now.select(F.col("u").alias("v"), F.col("v").alias("u")))
        least = both.groupBy("v").agg(F.min("u").alias("m")).select(F.col("v").alias("u"), F.least("v", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select("v", F.col("m").alias("u")).distinct()
        least = large.groupBy("v").agg(F.min("u").alias("m"))
        small = large.join(least, "v").select(F.col("u").alias("v"), F.col("m").alias("u")).where("v > u")
        new = kept(small.unionByName(least.select("v", F.col("m").alias("u"))).distinct())
        # rounds are done when every end hangs below one root, and no root below another
        if new.count() == new.select("v").distinct().count() and new.join(new.select(F.col("v").alias("u")), "u", "left_semi").isEmpty():
            return new.select("v", F.col("u").alias("root")).unionByName(new.select(F.col("u").alias("v"), F.col("u").alias("root")).distinct())
        now = new


def _class_members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = [np.frombuffer(x, np.int64) for x in batch.column(1).to_pylist()]
        if ids:
            names = np.repeat(np.array(batch.column(0).to_pylist(), np.int64), [len(x) for x in ids])
            yield pa.RecordBatch.from_arrays([pa.array(names), pa.array(np.concatenate(ids))], ["c", "k"])


def near_duplicate_groups(df: DataFrame, key: str, group: Column, text: str, k: int = 3, least_words: int = 40, threshold: float = 0.5) -> DataFrame:
    """(k, group_id, n_links): for each key with a partner the least key of its group, and the number of its partners.

    A group holds all keys that are linked by pairs of ``near_duplicate_pairs``, directly or through others. Components are
    those of the classes, and keys follow by membership, so that copies cost one row each, whatever the group's size.
    """
    rows = text_classes(df, key, group, text, k, least_words)
    edges = kept(similar_classes(rows, bucket_count(df), threshold).select("a", "b"))
    members = kept(rows.select("c", "ids").mapInArrow(_class_members, "c bigint, k bigint").distinct())
    classes = members.groupBy("c").agg(F.count(F.lit(1)).alias("n"), F.min("k").alias("first"))
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    beside = both.join(classes.select(F.col("c").alias("b"), "n"), "b").groupBy(F.col("a").alias("c")).agg(F.sum("n").alias("beside"))
    roots = components(edges).withColumnRenamed("v", "c")
    linked = classes.join(beside, "c", "left").join(roots, "c", "left").where("n > 1 or root is not null")
    linked = linked.select("c", "first", F.coalesce("root", "c").alias("root"), (F.col("n") - 1 + F.coalesce("beside", F.lit(0))).alias("n_links"))
    named = linked.join(linked.groupBy("root").agg(F.min("first").alias("group_id")), "root")
    return members.join(named, "c").select("k", "group_id", "n_links")


def message_groups(messages: DataFrame) -> DataFrame:
    """(msg_id, group_id, n_links) of the messages with near-duplicates; group_id is the least msg_id of the group."""
    groups = near_duplicate_groups(messages, "msg_id", side(F.col("role")), "content")
    return groups.withColumnRenamed("k", "msg_id")


def message_pairs(messages: DataFrame) -> DataFrame:
    """(msg_id_a, msg_id_b) of near-duplicate messages, both by users or both by assistants."""
    pairs = near_duplicate_pairs(messages, "msg_id", side(F.col("role")), "content")
    return pairs.select(F.col("a").alias("msg_id_a"), F.col("b").alias("msg_id_b"))
