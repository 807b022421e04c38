"""Exact byte-level BPE by dynamic programming over prefixes.

For a valid BPE vocabulary each prefix of a word has exactly one encoding, so it is enough to know that encoding's *last*
token. ``last[i]`` is the token that ends at byte i, is a suffix of the prefix and is compatible with ``last[i - len]``: the
encoding of the whole word then follows the back-pointers. All tokens ending at a byte come from one pass of an
Aho-Corasick automaton over the vocabulary (its failure links are the suffix links of a suffix automaton of the
vocabulary), so time is linear in the word, unlike merging.

Two tokens are compatible if merging their joined bytes keeps the border between them. The tokens that touch the border
while a side is being merged are its spine; a spine token lives from its own rank to the rank of its parent. The border is
lost if and only if a token of the left spine and one of the right spine merge while both live.
"""

from __future__ import annotations

import json
from itertools import chain

import ahocorasick
import numpy as np
import regex

from .common import TOKENIZER_DIR

#: Fixed value: the pattern that splits text before merges (published with the vocabulary).
SPLIT_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def byte_alphabet() -> dict[str, int]:
    """Character that a byte-level vocabulary writes for a byte -> the byte."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + n): b for n, b in enumerate(hidden)}


class PrefixBpe:
    """Encoder of one vocabulary; ``pieces`` remembers encodings of short words, up to ``cache`` of them."""

    def __init__(self, path: str, cache: int = 400_000):
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        alphabet = byte_alphabet()
        raw = {t: bytes(alphabet[c] for c in t) for t in model["vocab"] if all(c in alphabet for c in t)}
        self.ids = {raw[t]: i for t, i in model["vocab"].items() if t in raw}
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        n = max(self.ids.values()) + 1
        parts: list[tuple[int, int] | None] = [None] * n
        born, self.merge = [0] * n, {}
        for rank, (a, b) in enumerate(pairs, 1):
            x, y, z = self.ids[raw[a]], self.ids[raw[b]], self.ids[raw[a] + raw[b]]
            self.merge.setdefault((x, y), rank)
            if parts[z] is None:
                parts[z], born[z] = (x, y), rank
        self.left_spine, self.right_spine = ([self._spine(t, parts, born, k) for t in range(n)] for k in (0, 1))
        self.automaton = ahocorasick.Automaton()
        for word, i in self.ids.items():
            if len(word) == 1 or parts[i] is not None:
                self.automaton.add_word(word.decode("latin-1"), (len(word), i))
        self.automaton.make_automaton()
        self.split = regex.compile(SPLIT_PATTERN).findall
        self.limit, self.known, self.pieces = cache, {}, _Pieces(self)

    @staticmethod
    def _spine(token: int, parts: list, born: list, k: int) -> list[tuple[int, int]]:
        """(token, rank at which it is merged away) of the tokens that touch one edge, outermost first."""
        out, until = [(token, 1 << 60)], 0
        while parts[token] is not None:
            until, token = born[token], parts[token][k]
            out.append((token, until))
        return out

    def compatible(self, a: int, b: int) -> bool:
        key = a << 20 | b
        if (found := self.known.get(key)) is None:
            found, get = True, self.merge.get
            for x, x_until in self.right_spine[a]:
                for y, y_until in self.left_spine[b]:
                    rank = get((x, y))
                    # at equal ranks the leftmost merge comes first
                    if rank is not None and rank < x_until and rank <= y_until:
                        found = False
            if len(self.known) >= 4 * self.limit:
                self.known.clear()
            self.known[key] = found
        return found

    def encode_word(self, word: str) -> list[int]:
        data = word.encode("utf-8", "surrogatepass")
        whole = self.ids.get(data)
        if whole is not None:
            return [whole]
        n, compatible = len(data), self.compatible
        last, size, done = [0] * (n + 1), [0] * (n + 1), 0
        for end, (length, token) in self.automaton.iter(data.decode("latin-1")):
            end += 1
            if end == done:  # the one token that ends here is found
                continue
            begin = end - length
            if not begin or compatible(last[begin], token):
                last[end], size[end], done = token, length, end
        out = []
        while n:
            out.append(last[n])
            n -= size[n]
        return out[::-1]

    def encode(self, text: str | None) -> np.ndarray:
        """Ids of a text; of null and of the empty text none."""
        if not text:
            return np.empty(0, np.int32)
        if len(self.pieces) > self.limit:
            self.pieces.clear()
        return np.fromiter(chain.from_iterable(map(self.pieces.__getitem__, self.split(text))), np.int32)

    def count(self, text: str | None) -> int:
        if not text:
            return 0
        if len(self.pieces) > self.limit:
            self.pieces.clear()
        return sum(map(len, map(self.pieces.__getitem__, self.split(text))))


class _Pieces(dict):
    def __init__(self, owner: PrefixBpe):
        self.owner = owner

    def __missing__(self, word: str) -> list[int]:
        out = self.owner.encode_word(word)
        if len(word) <= 32:
            self[word] = out
        return out


_LOADED: dict[str, PrefixBpe] = {}


def load(name: str = "byte_bpe_50k", tokenizer_dir: str = TOKENIZER_DIR) -> PrefixBpe:
    """The encoder of a vocabulary file, read once per worker."""
    path = f"{tokenizer_dir}/{name}.json"
    if path not in _LOADED:
        _LOADED[path] = PrefixBpe(path)
    return _LOADED[path]
