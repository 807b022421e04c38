"""Fits models/line_kinds.npz: ``python -m sparkprep.llm.train.kinds /path/to/messages.parquet /path/to/common_words.parquet``.

Lines are labelled weakly, by rules that look at a line with its neighbours and that keep silent when in doubt; structural
junk is also made from clean text (noise, garbled encoding, blobs, dumps, repetition). At most ``BOUND`` texts are read.
Probabilities are calibrated on HOLDOUT, messages whose kind was checked by hand.
"""

from __future__ import annotations

import base64
import random
import re
import sys
import unicodedata

import numpy as np

from .. import boosting
from ..text_stats import _GAP, _IDENT, _MARKER, _WORD, KINDS, MODEL, line_features, verdicts

#: Most texts that the fit reads.
BOUND = 16_000

PROSE, CODE, LIST, TABLE, JUNK = range(5)

#: msg_id of the 0.1 data by kind, read and decided by hand.
HOLDOUT = {
    "prose": [15604, 37424, 20386, 39534, 46428, 14479, 34763, 11128, 17041, 16554, 25582, 24315, 16356, 32824, 19628, 23359, 252, 16322, 26858, 45769, 30111, 31094, 6012, 2835, 20067],
    "code": [18018, 49988, 4379, 43118, 15949, 21987, 48695, 25336, 13045, 12460, 40333, 42920, 29093, 29707, 46613, 31931, 31524, 10953, 17607, 30223, 49735, 27134, 48118, 48947, 2627, 34717, 5617, 46338],
    "list": [49709, 23509, 4163, 24516, 11674, 10302, 29750, 22138, 4893, 41608, 14779, 10540, 10736, 16902, 34233],
    "table": [22741, 26087, 17492, 36923, 31632, 20432, 40544, 43207, 40177, 22537, 24024, 35522, 15522, 4597, 23965, 32376, 48620, 28194, 29237, 12880, 37834, 22554, 34092, 24486, 15947, 3401, 44458, 20156, 3557, 11058, 47233, 41780, 34444],
    "junk": [11358, 31360, 36473, 32668, 26150, 21468, 28854, 6017, 8311, 28117, 29558, 48783, 31933, 34839, 7120, 30295, 16409, 46764, 23209, 17075, 4686, 23777, 4363, 43757, 35164, 37841, 46080],
}

_BLOB = re.compile(r"[A-Za-z0-9+/=_-]{40,}")
_HEX = re.compile(r"^\s*[0-9a-fA-F]{6,8}\s+(?:[0-9a-fA-F]{2}\s+){6,}")
_CODE = re.compile(r"^\s*(?:def |if |for |return|else|elif |while |assert |continue|import |static |let |const |function|std::|//|#\s|\}|\{|float |int |console\.|class |\"[\w.]+\":|[\w.]+\(.*\)[;:]?$|[\w.\[\]]+ [-+*/]?= )|[;{]$|^```")
_ITEM = re.compile(r"\s*\(?(?:\d{1,3}|[a-zA-Z]|[ivx]{1,5})[.):] ")
_CALLS = re.compile(r"\w\([\w*.,\"' ]*\)\s*[;{}\]]|\w=[\w\[(]|return\b")
_RULE = re.compile(r"^[\s+|│:=-]{4,}$")


def weak(lines: list[str], common: frozenset[str]) -> list[int | None]:
    """A label for each line of a text, or None."""
    out: list[int | None] = [None] * len(lines)
    words = [[w.lower() for w in _WORD.findall(x)] for x in lines]
    share = [sum(w in common for w in ws) / max(1, len(ws)) for ws in words]
    code = [_CODE.search(x) is not None and not _ITEM.match(x) or len(_CALLS.findall(x)) > 3 for x in lines]
    delim = [max(((x.count(d), d) for d in "|│\t;,&"), default=(0, "")) for x in lines]
    mark = [_MARKER.match(x) is not None for x in lines]
    n = len(lines)

    def block(test, least: int) -> list[bool]:
        ok, good = [test(i) for i in range(n)], [False] * n
        i = 0
        while i < n:
            j = i
            while j < n and ok[j]:
                j += 1
            if j - i >= least:
                good[i:j] = [True] * (j - i)
            i = max(j, i + 1)
        return good

    fields = block(lambda i: (delim[i][0] >= (1 if delim[i][1] in "|│\t&;" else 2) and share[i] < 0.2 and not lines[i].rstrip().endswith((";", "{", "}"))) or bool(_RULE.match(lines[i]) and len(lines[i]) > 5), 3)
    aligned = block(lambda i: bool(_GAP.search(lines[i])) or (i > 0 and lines[i - 1][:1] != " " and bool(_GAP.search(lines[i - 1])) and len(words[i]) < 4), 4)
    short = [0 < len(ws) <= 4 and x.strip()[-1:] not in ".!?;{}" and not any(_IDENT.search(w) for w in x.split()) for ws, x in zip(words, lines)]
    menu = block(lambda i: short[i] and share[i] < 0.34 and not mark[i] and lines[i].lstrip()[:1] in "«»" + "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", 4)
    bare = block(lambda i: 2 <= len(words[i]) <= 16 and lines[i].rstrip()[-1:] not in ".!?;{},:" and not code[i] and not mark[i] and share[i] > 0 and delim[i][0] < 2, 4)
    marked = block(lambda i: mark[i] or lines[i].startswith(("  -", "\t-", "   ")), 3)
    fenced, inside = [False] * n, False
    for i, x in enumerate(lines):
        if x.lstrip().startswith("```"):
            inside, fenced[i] = not inside, True
        else:
            fenced[i] = inside
    codes = block(lambda i: code[i], 3)
    for i, x in enumerate(lines):
        solid = re.sub(r"\s", "", x)
        letters = sum(c.isalpha() for c in solid) / max(1, len(solid))
        odd = sum(c in "¢£¤¥¦§¨©ª¬®¯°±²³´µ¶·¸¹º¼½¾ÂÃð€\x83�" or "" <= c <= "" or "←" <= c <= "◿" for c in solid) / max(1, len(solid))
        run = sum(m.end() - m.start() for m in re.finditer(r"(\S{1,12}?)\1{5,}", x)) / max(1, len(x))
        words_set = len(set(words[i])) / max(1, len(words[i]))
        script = sum(ord(c) > 0x36F and unicodedata.category(c)[0] in "LM" for c in solid) / max(1, len(solid))
        if script > 0.6 and len(set(solid)) > 8:
            out[i] = PROSE
        elif _RULE.match(x) and (fields[i] or aligned[i]):
            out[i] = TABLE
        elif _HEX.match(x) or (_BLOB.search(x) and not code[i] and share[i] < 0.05 and len(_BLOB.search(x).group()) > 0.6 * len(solid) and "_" not in x and "." not in x) or run > 0.6 or odd > 0.08 and delim[i][1] not in "│":
            out[i] = JUNK
        elif lines.count(x) > 5 and not _RULE.match(x) and not code[i]:
            out[i] = JUNK
        elif len(words[i]) > 9 and words_set < 0.3 and not code[i]:
            out[i] = JUNK
        elif letters < 0.25 and len(solid) > 30 and not fields[i] and not aligned[i] and not code[i]:
            out[i] = JUNK
        elif re.search(r"(?: [|»•·] ).*(?: [|»•·] ).*(?: [|»•·] )", x) and n < 3 and share[i] < 0.2:
            out[i] = JUNK
        elif menu[i] and not fields[i]:
            out[i] = JUNK
        elif fenced[i] or (codes[i] and not fields[i]):
            out[i] = CODE
        elif fields[i] and not mark[i] or aligned[i] and not code[i]:
            out[i] = TABLE
        elif marked[i]:
            out[i] = LIST
        elif bare[i]:
            out[i] = LIST
        elif len(words[i]) >= 6 and share[i] >= 0.12 and letters > 0.8 and not code[i] and not marked[i]:
            out[i] = PROSE
        elif len(words[i]) >= 8 and letters > 0.9 and x.rstrip()[-1:] in ".?!" and sum(ord(c) > 0x2FF for c in x) > 0.5 * len(x):
            out[i] = PROSE
        elif len(words[i]) >= 5 and letters > 0.97 and share[i] == 0 and len(words[i]) > 15 and not any(c in x for c in ".,") and x.isascii():
            out[i] = JUNK
    return out


def made_junk(clean: list[str], rng: random.Random) -> str:
    """A piece of structural junk of a random kind."""
    kind, n = rng.randrange(11), rng.choice([rng.randint(80, 900), rng.randint(900, 8000)])
    if kind == 9:
        return rng.randbytes(n // 2).hex()
    if kind == 10:
        return "".join(f"%{rng.randrange(256):02X}" for _ in range(n // 3))
    if kind == 0:
        return base64.b64encode(rng.randbytes(n)).decode()
    if kind == 1:
        return "\n".join(f"{16 * i:08x}  " + " ".join(f"{rng.randrange(256):02x}" for _ in range(16)) for i in range(n // 40 + 2))
    if kind == 2:
        text = rng.choice(clean)[:n]
        for _ in range(rng.choice([1, 2])):
            text = text.encode("utf-8").decode("latin-1") if rng.random() < 0.7 else text
        return "".join(rng.choice("¢¤©¶ªðÂÃ€¨�") if c != "\n" and rng.random() < 0.3 else c for c in text)
    if kind == 3:
        return rng.choice([" ", "\n", ""]).join([rng.choice(_WORD.findall(rng.choice(clean)) or ["x"])] * (n // 6))
    if kind == 4:
        return rng.choice([" ", "\n"]).join(rng.choice("aeiotn.-=_!?#*") * rng.randint(10, 60) for _ in range(n // 40 + 2))
    if kind == 5:
        return "".join(rng.choice("!#$%&*+-./:;<=>?[]^_{|}~ ") for _ in range(n))
    if kind == 6:
        return " ".join("".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(3, 11))) for _ in range(n // 8))
    if kind == 7:
        return "".join(chr(rng.choice([rng.randrange(0x2200, 0x2300), rng.randrange(0x2500, 0x2600), 0xFFFD, rng.randrange(0xE000, 0xE100), 32])) for _ in range(n // 2))
    names = ["Home", "Menu", "Next »", "« Back", "Login", "Print", "Top", "Share", "Contact", "About us", "Search", "Privacy policy", "Suchen", "Impressum", "Accueil", "Inicio", "3 comments", "Read more", "Sitemap"]
    picked = [rng.choice(names) + (f" ({rng.randint(1, 99)})" if rng.random() < 0.2 else "") for _ in range(rng.randint(8, 40))]
    return rng.choice(["\n", " | ", " » ", " • ", " · "]).join(picked)


def made_script(rng: random.Random) -> str:
    """Sentences in another script, as far as statistics of characters go."""
    low, high = rng.choice([(0x391, 0x3C9), (0x410, 0x44F), (0x5D0, 0x5EA), (0x627, 0x64A), (0x905, 0x94D), (0xE01, 0xE3A), (0x3041, 0x3093), (0x30A1, 0x30F3), (0x4E00, 0x7000), (0xAC00, 0xB000)])
    close = low >= 0x3041 and low < 0xAC00
    words = ["".join(chr(rng.randint(low, high)) for _ in range(rng.randint(2, 12 if close else 8))) for _ in range(rng.randint(6, 50))]
    words = [str(rng.randint(1, 9999)) if rng.random() < 0.08 else w for w in words]
    return ("" if close else " ").join(w + rng.choice(["", "", "", "、" if close else ",", "。 " if close else "."]) for w in words) + ("。" if close else ".")


def made_code(rng: random.Random) -> str:
    """Minified code or data: long lines with hardly any white space."""

    def name() -> str:
        return rng.choice(["a", "b", "c", "el", "cb", "node", "initApp", "get_size", "fn2", "x", "item.id", "row", "self._n", "mapKey9"])

    def step() -> str:
        return rng.choice([
            f"function {name()}({name()},{name()}){{return {name()}+{name()}({rng.randint(1, 999)})}};", f"var {name()}={name()}[{rng.randint(0, 99)}];",
            f"if({name()}){{{name()}({name()})}}", f"function/*{rng.choice(['', '*', '!'])}*/{name()}({name()}){{return[{name()}*{rng.randint(1, 999)},{name()}.{name()}(0.{rng.randint(1, 999)})]}};",
            f"{name()}=>{{{name()}={rng.randint(1, 99)};return {name()}}},", f'{{"{name()}":{rng.randint(1, 99999)},"{name()}":["{name()}",{rng.random():.3f}]}},',
        ])

    one = rng.random() < 0.5
    first = step()
    return "".join(first if one and rng.random() < 0.6 else step() for _ in range(rng.randint(3, 150)))


def main(messages: str, common_words: str) -> None:
    import duckdb

    common = frozenset(w for (w,) in duckdb.sql(f"SELECT DISTINCT word FROM '{common_words}'").fetchall())
    rows = dict(duckdb.sql(f"SELECT DISTINCT ON (msg_id) msg_id, content FROM '{messages}' WHERE content IS NOT NULL ORDER BY msg_id").fetchall())
    held = {i: KINDS.index(k) for k, ids in HOLDOUT.items() for i in ids}
    rng = random.Random(3)
    plain = [(i, t) for i, t in rows.items() if i not in held]
    special = [t for i, t in plain if (m := re.search(r"\n", t)) or not re.search(r"[.?!]", t)]
    rng.shuffle(special)
    texts = special[: BOUND * 3 // 4] + [t for _, t in rng.sample(plain, BOUND // 4)]
    clean = [t for _, t in plain if re.match(r"[A-ZÀ-Ý][a-zà-ÿ]+ [a-zà-ÿ]+ [a-zà-ÿ]+", t) and len(t) > 300]
    made = [made_junk(clean, rng) for _ in range(1500)]
    coded = [made_code(rng) for _ in range(500)]
    foreign = [made_script(rng) for _ in range(300)]
    mixed = [rng.choice(clean)[:400] + rng.choice(["\n", "\n\n"]) + x for x in made[:400]]
    x, size, at, lines = line_features(texts + made + coded + foreign + mixed, common)
    labels: list[int | None] = []
    by_text: list[list[str]] = [[] for _ in range(len(texts) + len(made) + len(coded) + len(foreign) + len(mixed))]
    for i, line in zip(at, lines):
        by_text[i].append(line)
    for i, own in enumerate(by_text):
        if len(texts) <= i < len(texts) + len(made):
            labels += [JUNK] * len(own)
        elif len(texts) + len(made) <= i < len(texts) + len(made) + len(coded):
            labels += [CODE] * len(own)
        elif len(texts) + len(made) + len(coded) <= i < len(texts) + len(made) + len(coded) + len(foreign):
            labels += [PROSE] * len(own)
        else:
            labels += weak(own, common) if len(own) < 3000 else [None] * len(own)
    y = np.array([-1 if v is None else v for v in labels])
    known = y >= 0
    print("lines", len(y), "labelled", {KINDS[k]: int((y == k).sum()) for k in range(5)})
    # a text weighs as much as the root of its lines, so that long tables do not rule
    per_text = np.bincount(at, minlength=len(by_text))
    w = 1 / np.sqrt(per_text[at])
    w = w / w[known].mean()
    model = boosting.fit(x[known], y[known], len(KINDS), trees=24, depth=4, rate=0.35, weight=w[known])
    print("fit agrees with the weak labels:", float((model.scores(x[known]).argmax(1) == y[known]).mean()))
    ids = [i for i in held if i in rows]
    hx, _, hat, _ = line_features([rows[i] for i in ids], common)
    model.calibrate(hx, np.array([held[ids[i]] for i in hat]))
    found = verdicts([rows[i] for i in ids], common, model)
    wrong = [(i, KINDS[held[i]], k) for i, k in zip(ids, found) if k != KINDS[held[i]]]
    print(f"holdout: {len(ids) - len(wrong)} of {len(ids)} right; wrong: {wrong}")
    model.save(MODEL)


if __name__ == "__main__":
    main(*sys.argv[1:])
