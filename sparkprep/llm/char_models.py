"""Two character n-gram models in numpy: naive Bayes over languages, and the likelihood that a text ends where it does."""

from __future__ import annotations

import os
import re

import numpy as np

MODEL = os.path.join(os.path.dirname(__file__), "models", "char_models.npz")

LANGUAGES = ("en", "de", "fr", "es", "code")
#: First code points of scripts that tell a language family by themselves.
SCRIPTS = ((0x0370, "greek"), (0x0400, "cyrillic"), (0x0590, "hebrew"), (0x0600, "arabic"), (0x0900, "indic"), (0x0E00, "thai"), (0x3040, "kana"), (0x4E00, "han"), (0xAC00, "hangul"), (0xD800, ""))
BUCKETS = 1 << 15
#: Suffix lengths of the end model, longest first; suffixes seen in fewer places than LEAST are left out.
SUFFIXES = (16, 11, 8, 6, 4)
LEAST = 16

_P = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)]
_FOLD = np.arange(0x300, dtype=np.uint32)
for _i in range(0x300):
    _c = chr(_i)
    _FOLD[_i] = ord("0") if _c.isdigit() else ord(_c.lower()) if len(_c.lower()) == 1 else _i
    if _c.isspace():
        _FOLD[_i] = 32


def codes(text: str) -> np.ndarray:
    """Code points in lower case, digits as 0 and white space as blanks."""
    raw = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return np.where(raw < 0x300, _FOLD[np.minimum(raw, 0x2FF)], raw)


def trigrams(code: np.ndarray) -> np.ndarray:
    """Bucket of the trigram that ends at each character; text is taken to begin after blanks."""
    c = np.concatenate([[32, 32], code]).astype(np.uint64)
    h = c[:-2] * _P[0] + c[1:-1] * _P[1] + c[2:] * _P[2]
    return ((h ^ (h >> np.uint64(29))) * _P[0] >> np.uint64(49)).astype(np.int64)


def suffix_hashes(code: np.ndarray, length: int) -> np.ndarray:
    """32-bit hash of the ``length`` characters that end at each position (fewer at the beginning)."""
    c = np.concatenate([np.full(length - 1, 32), code]).astype(np.uint64)
    h = np.zeros(len(code), np.uint64)
    for i in range(length):
        h = (h + c[i : i + len(code)]) * _P[1]
        h ^= h >> np.uint64(31)
    return ((h + np.uint64(length)) * _P[2] >> np.uint64(32)).astype(np.uint32)


class CharModels:
    """``table`` has log-probabilities by trigram and language; ``keys`` (sorted), ``ends``, ``seen`` the known suffixes."""

    def __init__(self, table: np.ndarray, keys: np.ndarray, ends: np.ndarray, seen: np.ndarray):
        self.table, self.keys, self.ends, self.seen = table, keys, ends, seen

    def language_scores(self, lines: list[str]) -> np.ndarray:
        """(lines, languages) log-likelihoods of character trigrams."""
        if not lines:
            return np.zeros((0, len(LANGUAGES)), np.float32)
        sizes = np.array([len(x) + 1 for x in lines])
        own = self.table[trigrams(codes("\n".join(lines) + "\n"))]
        return np.add.reduceat(own, np.cumsum(sizes) - sizes, axis=0)

    def end_probability(self, text: str, least: int = LEAST, shortest: int = 0) -> float | None:
        """Chance that a text ends after these characters, by the longest suffix that is known from ``least`` places.

        None if no suffix of at least ``shortest`` characters is known.
        """
        code = codes(text[-2 * SUFFIXES[0] :])
        if not len(code):
            return None
        for length in SUFFIXES:
            if length < shortest:
                break
            h = suffix_hashes(code, length)[-1]
            at = int(np.searchsorted(self.keys, h))
            if at < len(self.keys) and self.keys[at] == h and self.seen[at] >= least:
                return (int(self.ends[at]) + 0.05) / (int(self.seen[at]) + 1.0)
        return None

    def save(self, path: str = MODEL) -> None:
        np.savez_compressed(path, table=self.table.astype(np.float16), keys=self.keys, ends=np.minimum(self.ends, 65535).astype(np.uint16), seen=np.minimum(self.seen, 65535).astype(np.uint16))


_LOADED: dict[str, CharModels] = {}


def load(path: str = MODEL) -> CharModels:
    if path not in _LOADED:
        with np.load(path) as f:
            _LOADED[path] = CharModels(f["table"].astype(np.float32), f["keys"], f["ends"], f["seen"])
    return _LOADED[path]


def fit_languages(lines: list[str], labels: list[int]) -> np.ndarray:
    counts = np.full((BUCKETS, len(LANGUAGES)), 0.05)
    for label in range(len(LANGUAGES)):
        own = [x for x, y in zip(lines, labels) if y == label]
        if own:
            counts[:, label] += np.bincount(trigrams(codes("\n".join(own))), minlength=BUCKETS)
    return np.log(counts / counts.sum(0)).astype(np.float32)


_END = re.compile(r"(?<=\S)(?=[.!?…]+[\"'”»)]*(?:\s|$)|\s*\n|\s*$|;\n)")


def fit_ends(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(keys, ends, seen): suffixes by their places at ends of sentences, lines and texts, and by all their places."""
    code = [codes(t) for t in texts]
    at = [np.array([m.start() - 1 for m in _END.finditer(t)], np.int64) for t in texts]
    found = []
    for length in SUFFIXES:
        hashes = [suffix_hashes(c, length) for c in code]
        keys, seen = np.unique(np.concatenate(hashes), return_counts=True)
        keys, seen = keys[seen >= LEAST], seen[seen >= LEAST]
        last, n = np.unique(np.concatenate([h[i] for h, i in zip(hashes, at)]), return_counts=True)
        where = np.minimum(np.searchsorted(last, keys), len(last) - 1)
        found.append((keys, np.where(last[where] == keys, n[where], 0), seen))
    keys, ends, seen = (np.concatenate(x) for x in zip(*found))
    keys, first = np.unique(keys, return_index=True)
    return keys, ends[first], seen[first]


def script_of(text: str) -> str | None:
    """The script of most letters if it is not Latin."""
    code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    high = code[(code >= 0x370) & (code < 0xD800) & ~((code >= 0x2000) & (code < 0x3040))]
    latin = int((((code | 32) >= 97) & ((code | 32) <= 122)).sum()) + int(((code >= 0xC0) & (code < 0x250)).sum())
    if len(high) <= latin:
        return None
    block = np.searchsorted([a for a, _ in SCRIPTS], high, "right") - 1
    return SCRIPTS[int(np.bincount(block).argmax())][1] or None
