"""Problem 3: text statistics of each document, and a verdict on whether it is prose, a list, a table or junk.

Lines are judged, not whole texts, so that a text that is mostly one kind keeps that kind whatever stands around it: every
line gets statistics of its own, of its neighbours and of its text, boosted trees give it calibrated probabilities of
prose, code, list, table and junk, and the text takes the kind that holds more than half of its non-blank characters.
"""

from __future__ import annotations

import os
import re
import unicodedata

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .boosting import BoostedTrees
from .common import map_arrow

KINDS = ("prose", "code", "list", "table", "junk")
MODEL = os.path.join(os.path.dirname(__file__), "models", "line_kinds.npz")

#: Character classes.
LOWER, UPPER, VOWEL, DIGIT, SPACE, SENTENCE, BRACKET, OPERATOR, BOX, LATIN, EXOTIC, OTHER = range(12)
N_CLASSES = 12

_WORD = re.compile(r"[^\W_]+")
_TOKEN = re.compile(r"\S+")
_MARKER = re.compile(r"\s*(?:[-*+•‣▪◦·→»–—>]\s+|\[[ xX]\]\s|\(?(?:\d{1,3}|[a-zA-Z]|[ivxIVX]{1,5})[.):]\s+|#{1,6}\s|\*\*[^*]+\*\*\s*[-–:])")
_CODE = re.compile(r"[;{}]\s*$|[=!<>]=|\w\(|[\"']\s*:|^\s*(?://|/\*|#\s|\*\s|[\]}])|\w\[|=>|->|::|^\s*```")
_GAP = re.compile(r"(?<=\S)  +(?=\S)")
_RUN = re.compile(r"(\S)\1{4,}")
_IDENT = re.compile(r"[a-z]_[a-z]|[a-z][A-Z]|[a-z]\d|[a-z]\.[a-z]")
_LONG = re.compile(r"(\S{201,})")
_DELIMITERS = "|│\t;,&"


def _char_class(c: str) -> int:
    code = ord(c)
    if c in "\t\n\r\x0b\x0c " or c.isspace():
        return SPACE
    if c.isalpha():
        base = unicodedata.normalize("NFD", c)[0].lower()
        if code in (0xAA, 0xBA):
            return LATIN
        return (VOWEL if base in "aeiouy" else LOWER) if not c.isupper() else UPPER
    if c.isdigit():
        return DIGIT
    if c in ".,!?;:'\"’…¿¡„“”‘«»–—":
        return SENTENCE
    if c in "()[]{}<>":
        return BRACKET
    if code < 128:
        return OPERATOR if c.isprintable() else EXOTIC
    if c in "│┃|":
        return BOX
    if code < 256:
        return LATIN
    return EXOTIC if unicodedata.category(c)[0] in "SC" else OTHER


_CLASSES = np.array([_char_class(chr(i)) for i in range(0x3000)], np.int64)


def classes_of(text: str) -> np.ndarray:
    code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    out = _CLASSES[np.minimum(code, 0x2FFF)]
    high = code >= 0x3000
    if high.any():
        block = code[high]
        out[high] = np.where(((block >= 0xE000) & (block < 0xF900)) | (block >= 0xFFF0), EXOTIC, OTHER)
    return out


def _delimiter(line: str) -> tuple[int, int]:
    best, which = 0, -1
    for k, d in enumerate(_DELIMITERS):
        if (n := line.count(d)) > best:
            best, which = n, k
    return best, which


def _parts(line: str) -> list[str]:
    """A line, nothing if it is blank; a run of over 200 non-blank characters is a line of its own."""
    if len(line) > 200 and max(map(len, line.split()), default=0) > 200:
        return [x for x in _LONG.split(line) if x.strip()]
    return [line] if line.strip() else []


def line_features(texts: list[str], common: frozenset[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[str]]:
    """(features, non-blank characters, index of the text, lines) of all lines that are not blank.

    ``common`` are the frequent words of all languages."""
    lines: list[str] = []
    owner: list[int] = []
    for i, t in enumerate(texts):
        own = [y for x in t.splitlines() for y in _parts(x)]
        lines += own
        owner += [i] * len(own)
    n = len(lines)
    at = np.array(owner, np.int64)
    if not n:
        return np.zeros((0, 1), np.float32), np.zeros(0), at, lines
    size = np.fromiter(map(len, lines), np.int64, n)
    kinds = classes_of("".join(lines))
    counts = np.bincount(np.repeat(np.arange(n), size) * N_CLASSES + kinds, minlength=n * N_CLASSES).reshape(n, N_CLASSES).astype(np.float32)
    solid = np.maximum(size - counts[:, SPACE], 1)
    letters = counts[:, LOWER] + counts[:, UPPER] + counts[:, VOWEL]
    own = np.zeros((n, 17), np.float32)
    seen: dict[str, int] = {}
    gaps: list[frozenset[int]] = []
    delims: list[tuple[int, int]] = []
    for i, line in enumerate(lines):
        words = _WORD.findall(line)
        tokens = _TOKEN.findall(line)
        low = [w.lower() for w in words]
        nw = len(low)
        d = _delimiter(line)
        gap = frozenset(m.end() for m in _GAP.finditer(line)) if "  " in line else frozenset()
        gaps.append(gap)
        delims.append(d)
        runs = sum(m.end() - m.start() for m in _RUN.finditer(line))
        last = line.rstrip()[-1]
        own[i] = (
            nw, sum(map(len, words)) / max(nw, 1), max(map(len, tokens)), sum(map(common.__contains__, low)) / max(nw, 1),
            _MARKER.match(line) is not None, last in ".!?…", last in ",;:", d[0], len(gap), len(set(line)) / min(len(line), 60),
            runs / len(line), len(set(low)) / max(nw, 1), len(line) - len(line.lstrip()), _CODE.search(line) is not None,
            sum(_IDENT.search(w) is not None for w in tokens) / max(len(tokens), 1), line.lstrip()[0].isupper(), len(tokens),
        )
        seen[line] = seen.get(line, 0) + 1
    same = np.zeros((n, 3), np.float32)
    for i in range(1, n):
        if at[i] == at[i - 1]:
            if delims[i][0] and delims[i] == delims[i - 1]:
                same[i, 0] = same[i - 1, 0] = 1
            if gaps[i] and gaps[i] & gaps[i - 1]:
                same[i, 1] = same[i - 1, 1] = 1
            if lines[i] == lines[i - 1]:
                same[i, 2] = same[i - 1, 2] = 1
    share = counts / size[:, None]
    base = np.column_stack([
        np.log1p(solid), letters / solid, counts[:, UPPER] / np.maximum(letters, 1), counts[:, VOWEL] / np.maximum(letters, 1),
        share[:, DIGIT], share[:, SPACE], share[:, SENTENCE], share[:, BRACKET], share[:, OPERATOR], share[:, BOX], share[:, LATIN],
        share[:, EXOTIC], share[:, OTHER], own, same,
    ]).astype(np.float32)
    # means over the neighbourhood and the text
    first = np.searchsorted(at, at, "left")
    end = np.searchsorted(at, at, "right")
    around = np.column_stack([base[:, [0, 1, 4, 6, 8, 11, 13, 15, 16, 17, 18, 26]], same, own[:, 7] > 0])
    total = np.concatenate([np.zeros((1, around.shape[1])), np.cumsum(around, 0, np.float64)])
    lo, hi = np.maximum(first, np.arange(n) - 3), np.minimum(end, np.arange(n) + 4)
    near = (total[hi] - total[lo]) / (hi - lo)[:, None]
    whole = (total[end] - total[first]) / (end - first)[:, None]
    texts_of: dict[int, set[str]] = {}
    for i, line in zip(owner, lines):
        texts_of.setdefault(i, set()).add(line)
    unique = np.array([len(texts_of[i]) for i in owner]) / (end - first)
    features = np.column_stack([base, near, whole[:, [6, 7, 8]], np.log1p(end - first), unique]).astype(np.float32)
    return features, size - counts[:, SPACE], at, lines


_LOADED: dict[str, BoostedTrees] = {}


def load(path: str = MODEL) -> BoostedTrees:
    if path not in _LOADED:
        _LOADED[path] = BoostedTrees.load(path)
    return _LOADED[path]


def verdicts(texts: list[str], common: frozenset[str], model: BoostedTrees, least: int = 40) -> list[str]:
    """Kind of each text: of its non-blank characters more than half, else 'prose'; 'short' under ``least`` of them."""
    features, weight, at, _ = line_features(texts, common)
    n = len(texts)
    mass = np.zeros((n, len(KINDS)))
    if len(at):
        kind = model.probabilities(features).argmax(1)
        np.add.at(mass, (at, kind), weight)
    total = mass.sum(1)
    top = mass.argmax(1)
    return ["short" if total[i] < least else KINDS[top[i]] if mass[i, top[i]] > total[i] / 2 else "prose" for i in range(n)]


def statistics(text: str, common: frozenset[str]) -> tuple[int, float, float, float, float]:
    """(words, mean word length, share of symbols, share of lines that end in punctuation, share of common words)."""
    words = _WORD.findall(text)
    solid = len("".join(text.split()))
    inside = sum(map(len, words))
    lines = [x.rstrip() for x in text.splitlines() if x.strip()]
    ended = sum(x[-1] in ".!?…:;,\"'»”)" for x in lines)
    n = len(words)
    return (
        n, inside / n if n else 0.0, (solid - inside) / solid if solid else 0.0, ended / len(lines) if lines else 0.0,
        sum(w.lower() in common for w in words) / n if n else 0.0,
    )


def text_quality(df: DataFrame, key: str, text: str, common_words: frozenset[str], model: str = MODEL) -> DataFrame:
    """(key, n_words, mean_word_length, symbol_share, ended_line_share, common_share, kind) of each row.

    A word is a maximal run of letters and digits; symbols are the other non-blank characters. Null, empty and blank texts
    have 0 everywhere and kind 'short', as every text of fewer than 40 non-blank characters. Texts are read whole; rows are
    independent, so nothing is shuffled and repeated rows come out repeatedly. ``common_words`` is a set of fixed size.
    """

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        trees = load(model)
        texts = [x or "" for x in batch.column(1).to_pylist()]
        stats = list(zip(*(statistics(t, common_words) for t in texts)))
        kinds: list[str] = []
        for i in range(0, len(texts), 500):
            kinds += verdicts(texts[i : i + 500], common_words, trees)
        columns = [batch.column(0), pa.array(stats[0], pa.int64()), *(pa.array(c, pa.float64()) for c in stats[1:]), pa.array(kinds)]
        return pa.RecordBatch.from_arrays(columns, ["k", "n_words", "mean_word_length", "symbol_share", "ended_line_share", "common_share", "kind"])

    slim = df.select(F.col(key).cast("bigint").alias("k"), F.col(text).alias("t"))
    out = map_arrow(slim, run, "k bigint, n_words bigint, mean_word_length double, symbol_share double, ended_line_share double, common_share double, kind string")
    return out.withColumnRenamed("k", key)


def text_kinds(df: DataFrame, key: str, text: str, common_words: frozenset[str], model: str = MODEL) -> DataFrame:
    """(key, kind) of each row, as ``text_quality`` without its statistics."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        trees = load(model)
        texts = [x or "" for x in batch.column(1).to_pylist()]
        kinds: list[str] = []
        for i in range(0, len(texts), 500):
            kinds += verdicts(texts[i : i + 500], common_words, trees)
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(kinds)], ["k", "kind"])

    slim = df.select(F.col(key).cast("bigint").alias("k"), F.col(text).alias("t"))
    return map_arrow(slim, run, "k bigint, kind string").withColumnRenamed("k", key)
