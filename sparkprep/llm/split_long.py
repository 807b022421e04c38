"""Problem 4: splitting of oversized texts at natural boundaries, with overlap."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow

#: Rank and penalty of a cut by the boundary before it.
KINDS = ("start", "paragraph", "line", "sentence", "word", "forced")
PENALTY = np.array([0.0, 0.0, 0.5, 1.0, 3.0, 40.0])

_ENDS = re.compile(r"(?P<p>(?:\r\n|\n|\r)[ \t]*(?:\r\n|\n|\r)[ \t\r\n]*)|(?P<l>[ \t]*(?:\r\n|\n|\r)[ \t]*)|(?P<s>(?<=[.!?…。！？])[ \t]+|(?<=[.!?…][\"'”»)])[ \t]+)|(?P<w>[ \t]+)")
_RANK = {"p": 1, "l": 2, "s": 3, "w": 4}


def boundaries(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Positions after each run of white space, and the rank of the boundary there, in order."""
    found = [(m.end(), _RANK[m.lastgroup]) for m in _ENDS.finditer(text) if 0 < m.end() < len(text)]
    return np.array([x for x, _ in found], np.int64), np.array([x for _, x in found], np.int64)


def _with(pos: np.ndarray, kind: np.ndarray, more: np.ndarray, rank: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions with ``more`` of them put in order; a position that is there keeps its rank."""
    more = more[~np.isin(more, pos)]
    at = np.searchsorted(pos, more)
    return np.insert(pos, at, more), np.insert(kind, at, rank)


def split_text(text: str, limit: int = 2000, overlap: int = 200) -> list[tuple[int, int, int]]:
    """(begin, end, rank of the boundary at the end) of the pieces of a text longer than ``limit``.

    Dynamic programming over boundary positions: the least sum of cut penalties and squared shortfalls against equally
    long pieces, such that no piece is longer than ``limit``. A piece begins ``overlap`` characters before the end of the
    one before if a boundary lies there, else at the first boundary after that place; at exactly ``overlap`` characters
    before if there is none. If that would make it too long it begins later, at the first boundary that allows its end. Word ends are candidates only where better ends are more than a quarter of ``limit`` apart. Where no boundary is
    in reach at all, the cut is forced at the limit. A run of white space belongs to the piece before it; a run longer
    than the limit is cut inside. White space beyond that is never dropped.
    """
    n = len(text)
    if n <= limit:
        return [(0, n, 0)]
    every, ranks = boundaries(text)
    keep = ranks < 4
    if not keep.all():
        better = np.concatenate([[0], every[keep], [n]])
        gap = np.diff(better)[np.clip(np.searchsorted(better, every, "right") - 1, 0, len(better) - 2)]
        keep |= gap > limit // 4
    pos, kind = every[keep], ranks[keep]
    # a run of nearly the limit may also be cut right behind its last character, before the white space
    runs = [m.span() for m in re.finditer(r"[^ \t\r\n]{%d,}" % max(1, limit - overlap - 1), text)]
    pos, kind = _with(pos, kind, np.array([b for _, b in runs if b < n], np.int64), 4)
    # where no end is in reach, ends are added every limit - overlap characters
    fences = np.concatenate([[0], pos, [n]])
    extra = [np.arange(a + limit - overlap, b, limit - overlap) for a, b in zip(fences[:-1], fences[1:]) if b - a > limit]
    for more in extra:
        blank = np.array([text[x - 1] in " \t\r\n" for x in more], bool)
        pos, kind = _with(*_with(pos, kind, more[blank], 4), more[~blank], 5)
    pos, kind = np.concatenate([[0], pos, [n]]), np.concatenate([[0], kind, [0]])
    back = np.maximum(pos - overlap, 0)
    first = np.append(every, n)[np.searchsorted(every, back)]
    begin = np.where(first <= pos, first, back)
    begin[0] = 0
    target = n / max(1, -(-(n - overlap) // (limit - overlap)))
    cost, come, start = np.full(len(pos), np.inf), np.zeros(len(pos), np.int64), begin.copy()
    cost[0], low = 0.0, 0
    for j in range(1, len(pos)):
        low += int(np.searchsorted(pos[low:j], pos[j] - limit))  # earlier cuts cannot reach pos[j]
        part = cost[low:j] + ((target - (pos[j] - pos[low:j])) / limit) ** 2
        part[pos[j] - begin[low:j] > limit] += 5.0  # these need a shorter overlap
        i = low + int(part.argmin())
        cost[j], come[j] = part[i - low] + PENALTY[kind[j]], i
        if pos[j] - begin[i] <= limit:
            start[j] = begin[i]
        else:
            k = int(np.searchsorted(every, pos[j] - limit))
            start[j] = every[k] if k < len(every) and every[k] <= pos[i] else pos[i]
    out, j = [], len(pos) - 1
    while j:
        out.append((int(start[j]), int(pos[j]), int(kind[j])))
        j = int(come[j])
    return out[::-1]


def split_oversized(df: DataFrame, key: str, text: str, limit: int = 2000, overlap: int = 200) -> DataFrame:
    """(key, piece_no, begin, end, cut, piece) for each text longer than ``limit`` characters.

    ``cut`` is the kind of boundary at the piece's end: paragraph, line, sentence, word, forced, or end for the last piece.
    Null, empty and shorter texts have no pieces. The length filter stays in the scan's stage; rows are independent, so
    nothing is shuffled and repeated rows come out repeatedly. Positions are in Unicode characters from 0.
    """

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows: list[tuple] = []
        for k, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            pieces = split_text(t, limit, overlap)
            for n, (a, b, rank) in enumerate(pieces):
                rows.append((k, n, a, b, "end" if n == len(pieces) - 1 else KINDS[rank], t[a:b]))
        columns = list(zip(*rows)) or [[]] * 6
        types = (pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.string())
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], ["k", "piece_no", "begin", "end", "cut", "piece"])

    long = df.where(F.length(text) > limit).select(F.col(key).cast("bigint").alias("k"), F.col(text).alias("t"))
    out = map_arrow(long, run, "k bigint, piece_no int, begin int, end int, cut string, piece string")
    return out.withColumnRenamed("k", key)


def cut_kinds(pieces: DataFrame, key: str) -> DataFrame:
    """(key, cut_kind): 'forced' if a piece had to end where there is no white space, else 'natural'; one row per key."""
    return pieces.groupBy(key).agg(F.when(F.max(F.col("cut") == "forced"), "forced").otherwise("natural").alias("cut_kind"))
