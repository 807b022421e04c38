"""Fits models/personal_data.npz: ``python -m sparkprep.llm.train.personal /path/to/documents.parquet [epochs] [later epochs]``.

1. A first model learns from composed texts (``spans``), set between lines of the corpus that hold common words only, and
   from ``hand_labels.json``: places of mentions in some passages of the corpus, read and labelled by hand.
2. It reads the corpus. Words of which it takes a good part for names leave the background vocabulary; windows that it is sure
   of become labelled windows, the others are left out.
3. The model learns on from both. Mentions of corpus windows are exchanged for composed ones in further copies.

At most ``BOUND`` documents are read; those with ``held_out`` are read by neither model.
"""

from __future__ import annotations

import json
import multiprocessing
import os
import random
import re
import sys
from collections import Counter

import numpy as np

from ..personal_data import _LONG_WORD, _WORD, MODEL, OVERLAP, WINDOW, Finder
from ..tagger import KINDS, Tagger, char_classes, path_log_odds, train
from .spans import LANGS, Writer

BOUND = 20_000
#: Composed texts of the two rounds, and copies of corpus windows with other mentions.
COMPOSED, COMPOSED_AGAIN, COPIES, HAND_COPIES = 24_000, 14_000, 2, 25
#: Shares of the documents that a word must stand in to be background: before and after the first model has named names.
COMMON, KNOWN = 0.006, 0.0012
#: Log-probability of a window's tags from which they count as sure.
SURE = -0.4
#: Share of the documents from which two words that look like a name count as a phrase.
PHRASE = 0.001

Sample = tuple[np.ndarray, np.ndarray]


def held_out(doc_id: int) -> bool:
    return doc_id % 10 == 7


def tags(n: int, spans: list[tuple[int, int, str]]) -> np.ndarray:
    y = np.zeros(n, np.int8)
    for a, b, kind in spans:
        y[a:b] = 2 + 2 * KINDS.index(kind)
        y[a] -= 1
    return y


def cropped(x: np.ndarray, y: np.ndarray, a: int, b: int) -> Sample:
    own = y[a:b].copy()
    if len(own) and own[0] and own[0] % 2 == 0:
        own[0] -= 1
    return x[a:b].astype(np.int32), own


def flags(text: str, known: frozenset[str], spans: list[tuple[int, int, str]], begin: int, end: int, rng: random.Random) -> np.ndarray:
    """Word flags; in the composed part [begin, end) most words of mentions are unknown and most others known, whatever the corpus says."""
    out = np.zeros(len(text), np.int32)
    for m in _WORD.finditer(text):
        a, b = m.span()
        flag = 1 if b - a == 1 or m.group().lower() in known else 2
        if begin <= a < end and b - a > 1:
            inside = any(x <= a < y and k in ("person", "address", "email") for x, y, k in spans)
            flag = (1 if rng.random() < 0.15 else 2) if inside else (2 if rng.random() < 0.12 and flag == 2 else 1)
        out[a:b] = flag
    return out


def composed(n: int, seed: int, lines: list[str], known: frozenset[str]) -> list[Sample]:
    """Windows of composed texts between corpus lines."""
    writer, rng, out = Writer(seed), random.Random(seed + 1), []
    while len(out) < n:
        lang = LANGS[rng.randrange(4)]
        parts, spans, at = [], [], 0
        for i in range(rng.choice((1, 1, 1, 2, 2, 3))):
            text, own = writer.piece(lang)
            if i:
                parts.append(rng.choice((" ", "\n", "\n", ", ", "  ", "\n\n")))
                at += len(parts[-1])
            spans += [(a + at, b + at, k) for a, b, k in own]
            parts.append(text)
            at += len(text)
        middle = "".join(parts)
        before = rng.choice(lines)[-rng.randint(0, 90) :] + rng.choice((" ", "\n", "\n", "\n\n", ". ")) if rng.random() < 0.85 else ""
        after = rng.choice(("\n", "\n", " ", "\n\n", "")) + rng.choice(lines)[: rng.randint(0, 90)] if rng.random() < 0.85 else ""
        if after and after[0].isalnum() and middle[-1:].isalnum():
            after = " " + after
        text = before + middle + after
        spans = [(a + len(before), b + len(before), k) for a, b, k in spans]
        x = char_classes(text).astype(np.int32) * 3 + flags(text, known, spans, len(before), len(before) + len(middle), rng)
        y = tags(len(text), spans)
        low, high = max(0, len(before) - rng.randint(0, 45)), min(len(text), len(before) + len(middle) + rng.randint(0, 45))
        while True:
            end = min(high, low + WINDOW)
            out.append(cropped(x, y, low, end))
            if end == high:
                break
            low = end - OVERLAP
    return out[:n]


def exchanged(text: str, spans: list[tuple[int, int, str]], known: frozenset[str], writer: Writer, rng: random.Random) -> Sample:
    """A window with composed mentions in the place of its own ones."""
    parts, moved, at, n = [], [], 0, 0
    for p, q, k in spans:
        new = writer.make.make(k, LANGS[rng.randrange(4)]) if rng.random() < 0.85 else text[p:q]
        parts += [text[at:p], new]
        n += p - at
        moved.append((n, n + len(new), k))
        n, at = n + len(new), q
    out = "".join([*parts, text[at:]])[: 2 * WINDOW]
    moved = [(p, min(q, len(out)), k) for p, q, k in moved if p < len(out)]
    f = np.zeros(len(out), np.int32)
    for m in _WORD.finditer(out):
        p, q = m.span()
        inside = any(u <= p < v for u, v, _ in moved)
        f[p:q] = 1 if q - p == 1 or m.group().lower() in known or inside and rng.random() < 0.1 else 2
    x, y = char_classes(out).astype(np.int32) * 3 + f, tags(len(out), moved)
    low = rng.randint(0, max(0, len(out) - WINDOW))
    return cropped(x, y, low, low + WINDOW)


def by_hand(texts: dict[int, str], known: frozenset[str], writer: Writer, rng: random.Random) -> list[Sample]:
    """Windows of the passages that were labelled by hand, and copies with other mentions."""
    with open(os.path.join(os.path.dirname(__file__), "hand_labels.json"), encoding="utf-8") as f:
        labels = [x for x in json.load(f) if x["doc_id"] in texts]
    out = []
    for label in labels:
        t, a, b = texts[label["doc_id"]], label["begin"], label["end"]
        spans = [(p - a, q - a, k) for p, q, k in label["spans"]]
        for _ in range(HAND_COPIES if spans else 4):
            out.append(exchanged(t[a:b], spans, known, writer, rng))
    return out


def document_words(texts: list[str]) -> Counter:
    count: Counter = Counter()
    for t in texts:
        count.update({w.lower() for w in _LONG_WORD.findall(t)} | {w.lower() for w in _WORD.findall(t)})
    return count


def batch_of(data: list[Sample]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    size = max(len(w[0]) for w in data)
    x, y = np.zeros((len(data), size), np.int32), np.zeros((len(data), size), np.int64)
    for r, (a, b) in enumerate(data):
        x[r, : len(a)], y[r, : len(b)] = a, b
    return x, y, np.array([len(w[0]) for w in data])


def finder_of(model: Tagger, known: frozenset[str]) -> Finder:
    out = Finder.__new__(Finder)
    out.known, out.model, out.seen = known, model, {}
    return out


_SHARED: dict[str, object] = {}


def _read(part: list[str]) -> list[list[tuple[int, int, str]]]:
    return _SHARED["finder"].find(part)


def _windows(part: list[tuple[str, list]]) -> list[tuple[int, int, int, bool]]:
    """(text, begin, end, sure) of the windows that are laid at decoding."""
    finder: Finder = _SHARED["finder"]
    out, x = [], []
    for i, (t, _) in enumerate(part):
        for first, b in finder.regions(t, finder.cues(t)):
            symbols, a = finder.symbols(t, first, b), first
            while True:
                end = min(b, a + WINDOW)
                out.append((i, a, end))
                x.append(symbols[a - first : end - first])
                if end == b:
                    break
                a = end - OVERLAP
    sure = []
    for s in range(0, len(x), 400):
        own = x[s : s + 400]
        xs, _, n = batch_of([(w, w) for w in own])
        e = finder.model.emissions(xs, (np.arange(xs.shape[1]) < n[:, None]).astype(np.float32))
        ys = np.zeros(xs.shape, np.int64)
        for r, (i, a, end) in enumerate(out[s : s + 400]):
            y = tags(end - a, [(max(p, a) - a, min(q, end) - a, k) for p, q, k in part[i][1] if p < end and q > a])
            ys[r, : len(y)] = y
        sure += (path_log_odds(finder.model, e, n, ys) > SURE).tolist()
    return [(*w, s) for w, s in zip(out, sure)]


def everywhere(fn, items: list, finder: Finder, workers: int = 8) -> list:
    _SHARED["finder"] = finder
    size = 200
    with multiprocessing.get_context("fork").Pool(workers) as pool:
        return [x for part in pool.map(fn, [items[i : i + size] for i in range(0, len(items), size)]) for x in ([part] if fn is _windows else part)]


def main(documents: str, epochs: int = 7, again: int = 10, hidden: int = 24) -> None:
    import duckdb

    rows = duckdb.sql(f"SELECT doc_id, text FROM '{documents}' WHERE text IS NOT NULL ORDER BY doc_id LIMIT {BOUND}").fetchall()
    texts = [t for i, t in rows if not held_out(i)]
    words = document_words(texts)
    common = frozenset(w for w, n in words.items() if n >= COMMON * len(texts))
    lines = [x for t in texts for x in t.splitlines() if 20 < len(x) < 400 and "@" not in x and not re.search(r"\d[\d ./()-]{5,}\d", x) and all(w.lower() in common for w in _LONG_WORD.findall(x))]
    random.Random(4).shuffle(lines)
    lines = lines[:20_000]
    print(f"documents {len(texts)}, common words {len(common)}, lines {len(lines)}", flush=True)
    model, rng, writer = Tagger.fresh(hidden), random.Random(7), Writer(29)
    passages = {i: t for i, t in rows if not held_out(i)}
    train(model, *batch_of(composed(COMPOSED, 11, lines, common) + by_hand(passages, common, writer, rng)), epochs, workers=8)

    found = everywhere(_read, texts, finder_of(model, common))
    named, total, partners, phrases = Counter(), Counter(), {}, Counter()
    for t, spans in zip(texts, found):
        total.update(w.lower() for w in _WORD.findall(t))
        own = {tuple(w.lower() for w in _WORD.findall(t[a:b])) for a, b, k in spans if k == "person"}
        phrases.update(own)
        for a, b, k in spans:
            if k == "person":
                name = [w.lower() for w in _WORD.findall(t[a:b])]
                named.update(name)
                for w in name:
                    partners.setdefault(w, set()).update(name)
    # a word of names comes with many others; one that always has the same partner belongs to a phrase
    names = {w for w, n in named.items() if n > 0.25 * total[w] and len(partners[w]) > max(3, 0.3 * n)}
    known = frozenset(w for w, n in words.items() if n >= KNOWN * len(texts) and w not in names)
    usual = {x for x, n in phrases.items() if n > PHRASE * len(texts)}
    print(f"known words {len(known)}, found {Counter(k for own in found for _, _, k in own)}", flush=True)
    finder = finder_of(model, known)
    read = everywhere(_read, texts, finder)
    pairs = [(t, [(a, b, k) for a, b, k in own if k != "person" or tuple(w.lower() for w in _WORD.findall(t[a:b])) not in usual]) for t, own in zip(texts, read)]
    chosen, seen, left_out = [], set(), 0
    for s, part in zip(range(0, len(pairs), 200), everywhere(_windows, list(zip(texts, read)), finder)):
        for i, a, end, sure in part:
            t, spans = pairs[s + i]
            if not sure and not any(p < end and q > a for p, q, _ in {*read[s + i]} - {*spans}):
                left_out += 1
                continue
            x = finder.symbols(t, a, end)
            if (key := x.tobytes()) in seen:
                continue
            seen.add(key)
            own = [(max(p, a) - a, min(q, end) - a, k) for p, q, k in spans if p < end and q > a]
            chosen.append((x, tags(end - a, own)))
            if own:
                chosen += [exchanged(t[a:end], own, known, writer, rng) for _ in range(COPIES)]
    hits = [w for w in chosen if w[1].any()]
    rest = [w for w in chosen if not w[1].any()]
    rest = rng.sample(rest, min(len(rest), max(len(hits), 1)))
    print(f"corpus windows {len(hits)} with mentions, {len(rest)} without, {left_out} left out", flush=True)
    more = composed(COMPOSED_AGAIN, 13, lines, known)
    train(model, *batch_of(more + hits + rest + by_hand(passages, known, writer, rng)), again, rate=6e-3, workers=8)
    model.save(MODEL, words=np.array(sorted(known)))


if __name__ == "__main__":
    main(sys.argv[1], *map(int, sys.argv[2:]))
