"""Problem 8: personal data inside free text, found by a BiLSTM-CRF over characters and replaced by typed placeholders.

Every character of a text is decoded, in overlapping windows that are reconciled over the whole text. The model was trained on
windows around *cues*: words outside the background vocabulary, capitalised words in a row, digits that could make a number,
house numbers, and at-signs in any spelling; ``cues`` and ``regions`` lay these for training only.
"""

from __future__ import annotations

import os
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow
from .tagger import CLASSES, KINDS, TOGETHER, Tagger, char_classes

MODEL = os.path.join(os.path.dirname(__file__), "models", "personal_data.npz")

#: Characters of context on either side of a cue, length of a training window and overlap of windows; length of a decoded window.
CONTEXT, WINDOW, OVERLAP, DECODED = 40, 160, 80, 320

_WORD = re.compile(r"([A-ZÀ-Þ]?[a-zß-ÿœ]+|[A-ZÀ-ÞŒ]+(?![a-zß-ÿœ])|[^\W\d_]+)")
_LONG_WORD = re.compile(r"[A-ZÀ-Þ][a-zß-ÿœ]{2,}|[a-zß-ÿœ]{3,}|[A-ZÀ-ÞŒ]{3,}(?![a-zß-ÿœ])|[^\W\d_a-zA-ZÀ-ÿŒœ]{3,}")
#: Cues beside words. Each pattern begins with a set of characters, which the regular expression engine skips to fast.
_AT_SIGN = re.compile(r"@|[(\[] ?at ?[)\]]| dot | punto | punkt | point ")
_NUMBER = re.compile(r"\d[\d ()/.\-]{5,}\d")
_LETTERED = re.compile(r"[A-Z]{1,3} ?\d[\dA-Z .\-]{4,}|[A-Z\d]{6,}")
_HOUSE = re.compile(r"\d{1,4}(?: ?(?:bis|ter|[a-dA-D]))?,? (?:[A-ZÀ-Þ][^\W\d_]|rue|av|bd|boul|imp|quai|pl|chem|all|cours|route|pass|sq)")
_CAPITALS = re.compile(r"[A-ZÀ-ÞŒ][^\W\d_]+(?:[ -][A-ZÀ-ÞŒ][^\W\d_]+)+")
#: Words that open no name, in the four languages.
_FUNCTION_WORDS = frozenset(
    ("the a an this that these those in on at to of for from by with and or if when while after before as is are was it we you no not "
     "der die das den dem des ein eine einen einem einer dieser diese dieses diesen jeder jede jedes kein keine im am zum zur vom beim in an auf aus bei mit nach von vor für laut und oder wenn "
     "le la les un une des du ce cette ces dans sur à au aux par pour avec et ou si selon el los las una del al en por con y o según para este esta").split()
)
_OBFUSCATED = ("@", "at)", "at]", "at )", "at ]", " dot ", " punto ", " punkt ", " point ")
#: Base64 and hex without any sign that could set a value apart.
_BLOB = re.compile(r"[A-Za-z0-9+/]{100,}")


class _WordFlags(dict):
    """1 for words of one letter and of the background vocabulary, 2 for others."""

    def __init__(self, known: frozenset[str]):
        super().__init__()
        self.vocabulary = known

    def __missing__(self, word: str) -> int:
        if len(self) > 200_000:
            self.clear()
        self[word] = out = 1 if len(word) == 1 or word.lower() in self.vocabulary else 2
        return out


class Finder:
    def __init__(self, path: str = MODEL):
        with np.load(path) as f:
            self.known = frozenset(f["words"].tolist())
            self.model = Tagger({k: f[k] for k in f.files if k != "words"})
        self.word_flags = _WordFlags(self.known)
        self.pieces: dict[str, bytes] = {}
        self.pieces_size = 0

    def cues(self, text: str) -> list[tuple[int, int]]:
        """Places of words outside the background vocabulary and of signs and digits that could be part of a mention."""
        known = self.known
        strange = {w for w in set(_LONG_WORD.findall(text)) if w.lower() not in known}
        found = [m.span() for m in _LONG_WORD.finditer(text) if m.group() in strange] if strange else []
        for m in _CAPITALS.finditer(text):  # a name can consist of known words only
            words = m.group().lower().replace("-", " ").split()
            if sum(w not in _FUNCTION_WORDS for w in words) >= 2:
                found.append(m.span())
        if any(x in text for x in _OBFUSCATED):
            found += [m.span() for m in _AT_SIGN.finditer(text)]
        found += [m.span() for m in _NUMBER.finditer(text)]
        for m in _LETTERED.finditer(text):
            a, own = m.start(), m.group()
            if sum(map(str.isdigit, own)) >= 4 and not own.isdigit() and not (a and (text[a - 1].isalnum() or text[a - 1] == "_")):
                found.append(m.span())
        for m in _HOUSE.finditer(text):
            a = m.start()
            if not a or not (text[a - 1].isalnum() or text[a - 1] in "_.,$=/:*+-"):
                found.append(m.span())
        return found

    def flags(self, text: str, begin: int, end: int) -> np.ndarray:
        """0 no word, 1 known, 2 unknown word, for the characters from begin to end; words are those of the whole text."""
        while begin and text[begin].isalpha() and text[begin - 1].isalpha():
            begin -= 1
        stop = min(len(text), end + 60)
        parts = _WORD.split(text[begin:stop])  # stretches without and with a word in turn
        values = np.zeros(len(parts), np.int8)
        values[1::2] = list(map(self.word_flags.__getitem__, parts[1::2]))
        return values.repeat(np.fromiter(map(len, parts), np.int64, len(parts)))[: end - begin]

    def symbols(self, text: str, begin: int, end: int) -> np.ndarray:
        """Input symbols of the model: character class and word flag."""
        return char_classes(text[begin:end]).astype(np.int32) * 3 + self.flags(text, begin, end)[-(end - begin) :]

    def all_symbols(self, texts: list[str]) -> list[np.ndarray]:
        """``symbols`` of whole texts, put together from those of the pieces between blanks; no word goes over a blank."""
        if self.pieces_size > 20_000_000:
            self.pieces.clear()
            self.pieces_size = 0
        split = [t.split(" ") for t in texts]
        new = list(set().union(*split) - self.pieces.keys())
        joined = " ".join([" ", *new])
        own, at = self.symbols(joined, 0, len(joined)).astype(np.int16).tobytes(), 4
        for piece in new:
            end = at + 2 * len(piece)
            self.pieces[piece] = own[at:end]
            at = end + 2
        self.pieces_size += len(own) + 100 * len(new)
        return [np.frombuffer(own[:2].join(map(self.pieces.__getitem__, x)), np.int16) for x in split]

    def regions(self, text: str, cues: list[tuple[int, int]]) -> list[tuple[int, int]]:
        """Merged surroundings of the cues, to whole words; unbroken blobs of letters, digits, '+' and '/' have none."""
        if not cues:
            return []
        if len(text) > 100 and (blobs := [m.span() for m in _BLOB.finditer(text)]):
            ends = [b for _, b in blobs]
            at = np.searchsorted(ends, [a for a, _ in cues], "right")
            cues = [c for c, i in zip(cues, at) if i == len(blobs) or not blobs[i][0] <= c[0] < blobs[i][1]]
        out: list[list[int]] = []
        for a, b in sorted(cues):
            a, b = max(0, a - CONTEXT), min(len(text), b + CONTEXT)
            if out and a <= out[-1][1]:
                out[-1][1] = max(out[-1][1], b)
            else:
                out.append([a, b])
        return [(a, b) for a, b in out]

    def find(self, texts: list[str]) -> list[list[tuple[int, int, str]]]:
        """(begin, end, kind) of the mentions in each text, in order and without overlaps. Every character is decoded."""
        windows: list[tuple[int, int, int]] = []
        symbols: list[np.ndarray] = []
        for i, (text, x) in enumerate(zip(texts, self.all_symbols(texts))):
            a = 0
            while text:
                end = min(len(text), a + DECODED)
                windows.append((i, a, end))
                symbols.append(x[a:end])
                if end == len(text):
                    break
                a = end - OVERLAP
        found: list[list[tuple[int, int, int, float]]] = [[] for _ in texts]
        order = sorted(range(len(windows)), key=lambda k: len(symbols[k]))
        for s in range(0, len(order), 8 * TOGETHER):
            part = order[s : s + 8 * TOGETHER]
            lengths = np.array([len(symbols[k]) for k in part])
            x = np.zeros((len(part), int(lengths[-1])), np.int32)
            for row, k in enumerate(part):
                x[row, : lengths[row]] = symbols[k]
            e = self.model.scores(x, lengths)
            held = np.flatnonzero(self.model.may_hold(e, lengths))
            if not len(held):
                continue
            tags, margin = self.model.viterbi(e[:, :, held].transpose(2, 0, 1), lengths[held])
            for r in np.flatnonzero(tags.any(1)):
                i, a, end = windows[part[held[r]]]
                for begin, stop, kind, score in _spans(tags[r], margin[r], end - a):
                    # a span cut by the window's side is worth less than the same one seen whole
                    cut = (begin == 0 and a > 0) or (stop == end - a and end < len(texts[i]))
                    found[i].append((a + begin, a + stop, kind, score * (0.3 if cut else 1.0)))
        return [_checked(text, reconcile(own), self.known) for text, own in zip(texts, found)]


def _spans(tags: np.ndarray, margin: np.ndarray, n: int) -> list[tuple[int, int, int, float]]:
    out, at = [], 0
    while at < n:
        if tags[at]:
            kind, end = (int(tags[at]) - 1) // 2, at + 1
            while end < n and tags[end] == 2 + 2 * kind:
                end += 1
            out.append((at, end, kind, float(np.maximum(margin[at:end], 0.01).sum())))
            at = end
        else:
            at += 1
    return out


def reconcile(spans: list[tuple[int, int, int, float]]) -> list[tuple[int, int, int]]:
    """The spans without overlaps of the greatest total score, over all windows of a text."""
    if not spans:
        return []
    best: dict[tuple[int, int, int], float] = {}
    for a, b, k, s in spans:
        best[a, b, k] = max(best.get((a, b, k), 0.0), s)
    order = sorted(best, key=lambda x: x[1])
    ends = [b for _, b, _ in order]
    total, take = [0.0], []
    for j, key in enumerate(order):
        before = int(np.searchsorted(ends[:j], key[0], "right"))
        with_it = total[before] + best[key]
        take.append((with_it > total[j], before))
        total.append(max(with_it, total[j]))
    out, j = [], len(order)
    while j:
        used, before = take[j - 1]
        if used:
            out.append(order[j - 1])
        j = before if used else j - 1
    return out[::-1]


_ADDRESS = re.compile(r"[\w][\w.+-]*(?: ?@ ?| ?[(\[] ?at ?[)\]] ?| at )[\w-]+(?:(?:\.| ?[(\[] ?dot ?[)\]] ?| dot )[\w-]+)+", re.I)
_TO = re.compile(r" to (?=\d)")
#: Words that open a sentence before names.
_BEFORE_NAMES = frozenset(("hier", "gestern", "haben", "yesterday", "ayer", "selon", "laut", "según", "erst"))
_INNER_TITLE = re.compile(r"\s(?:Mr|Mrs|Ms|Dr|Mme|Frau|Herr|Don|Doña)\.? (?=[^\W\d_])")
_PARTICLES = frozenset(("von", "van", "de", "del", "la", "du", "le"))
_STREETS = frozenset(("rue", "avenue", "quai", "impasse", "place", "chemin", "boulevard", "calle", "am", "an", "im", "zum"))
_TITLE = re.compile(r"(?:Mr|Mrs|Ms|Dr|Prof|Herr|Frau|Mme|Mlle|Sra|Sr|Don|Doña|Señora|Señor|Mister|Monsieur|Madame|M)\.? (?=\S)")


def _checked(text: str, spans: list[tuple[int, int, int]], known: frozenset[str]) -> list[tuple[int, int, str]]:
    """Exact checks of each mention: borders at word ends, titles at its sides left out, and of a person a closed list of words
    that open sentences and words in lower case (the background vocabulary takes no capitalised word from what the model tags), one address on either side of 'to', and the signs and digits that its kind must have."""
    out = []
    halves = []
    for a, b, k in spans:
        if KINDS[k] == "address" and (m := _TO.search(text, a, b)):
            halves += [(a, m.start(), k), (m.end(), b, k)]
        else:
            halves.append((a, b, k))
    for a, b, k in halves:
        kind = KINDS[k]
        while a < b and (text[a].isspace() or text[a] in ",;:|\"<>{}=" or (text[a] in "([" and kind != "phone")):
            a += 1
        while 0 < a < len(text) and text[a].isalnum() and text[a - 1].isalnum():
            a -= 1
        if kind == "phone":
            while a and text[a - 1] in "+(":
                a -= 1
            while a < b and text[a] in "./-)":
                a += 1
        elif kind == "email":
            while a and (text[a - 1].isalnum() or text[a - 1] in "._+-"):
                a -= 1
        while b < len(text) and text[b].isalnum() and text[b - 1].isalnum():
            b += 1
        while b > a and (text[b - 1].isspace() or text[b - 1] in ",;:|\"<>{}=(["):
            b -= 1
        own = text[a:b]
        digits = sum(c.isdigit() for c in own)
        if kind == "person":
            if m := _TITLE.match(own):
                a += m.end()
                own = text[a:b]
            if m := _INNER_TITLE.search(own):
                halves.append((a + m.end(), b, k))
                b = a + m.start()
                own = text[a:b]
            mixed = any(w[:1].isupper() for w in own.split())
            while m := re.match(r"([^\W\d_]{2,}),? +(?=\S)", own):
                word = m.group(1).lower()
                if word in _PARTICLES or not (word in _BEFORE_NAMES or m.group(1).islower() and (mixed or word in known)):
                    break
                a += m.end()
                own = text[a:b]
            while m := re.search(r"\s+([^\W\d_]{2,})$", own):
                if not (m.group(1).lower() in _BEFORE_NAMES or m.group(1).islower() and (mixed or m.group(1) in known)):
                    break
                b = a + m.start()
                own = text[a:b]
            words = re.findall(r"[^\W\d_]+", own)
            ok = len(words) >= 2 and max(map(len, words)) >= 3 and not digits and "@" not in own and "\n" not in own
        elif kind == "email":
            parts = [m.span() for m in _ADDRESS.finditer(text, a, min(len(text), b + 1))]
            if parts:
                out += [(x, y, kind) for x, y in parts]
                continue
            ok = re.search(r"@|\bat\b|arroba", own, re.I) is not None and len(own) > 6
        elif kind == "phone":
            ok = 7 <= digits <= 20
        elif kind == "id_number":
            ok = 5 <= digits <= 22
        else:
            while m := re.match(r"([a-zà-ÿ]{2,}) +(?=\S)", own):
                if m.group(1) not in known or m.group(1) in _STREETS:
                    break
                a += m.end()
                own = text[a:b]
            ok = digits >= 1 and len(re.findall(r"[^\W\d_]+", own)) >= 1 and len(own) >= 6
        if ok:
            out.append((a, b, kind))
    return sorted(out)


_LOADED: dict[str, Finder] = {}


def load(path: str = MODEL) -> Finder:
    if path not in _LOADED:
        _LOADED[path] = Finder(path)
    return _LOADED[path]


def mentions(df: DataFrame, key: str, text: str, model: str = MODEL) -> DataFrame:
    """(key, kind, start_pos, end_pos): one row for each mention; positions in Unicode characters from 0.

    Null and empty texts have no mentions. Texts are searched whole, rows are independent: nothing is shuffled.
    """

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        finder, keys = load(model), batch.column(0).to_pylist()
        texts, rows = [x or "" for x in batch.column(1).to_pylist()], []
        for s in range(0, len(texts), 500):
            for i, own in enumerate(finder.find(texts[s : s + 500]), s):
                rows += [(keys[i], kind, a, b) for a, b, kind in own]
        columns = list(zip(*rows)) or [[]] * 4
        types = (pa.int64(), pa.string(), pa.int64(), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], ["k", "kind", "start_pos", "end_pos"])

    slim = df.select(F.col(key).cast("bigint").alias("k"), F.col(text).alias("t")).where("t is not null")
    return map_arrow(slim, run, "k bigint, kind string, start_pos bigint, end_pos bigint").withColumnRenamed("k", key)


def redact(df: DataFrame, key: str, text: str, model: str = MODEL) -> DataFrame:
    """(key, redacted, n_mentions): each text with its mentions replaced by [PERSON], [EMAIL], [PHONE], [ID_NUMBER], [ADDRESS].

    Null texts stay null; the rest of the text is unchanged.
    """

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        finder, texts = load(model), batch.column(1).to_pylist()
        clean: list[str | None] = []
        counts: list[int] = []
        for s in range(0, len(texts), 500):
            for t, own in zip(texts[s : s + 500], finder.find([x or "" for x in texts[s : s + 500]])):
                parts, at = [], 0
                for a, b, kind in own:
                    parts += [(t or "")[at:a], f"[{kind.upper()}]"]
                    at = b
                clean.append(None if t is None else "".join([*parts, t[at:]]))
                counts.append(len(own))
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(clean, pa.string()), pa.array(counts, pa.int64())], ["k", "redacted", "n_mentions"])

    slim = df.select(F.col(key).cast("bigint").alias("k"), F.col(text).alias("t"))
    return map_arrow(slim, run, "k bigint, redacted string, n_mentions bigint").withColumnRenamed("k", key)
