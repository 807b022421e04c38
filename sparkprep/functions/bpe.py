"""Byte-level BPE with special tokens: encoding by ranked merges of distinct pretokens, decoding, torn characters."""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The pretokenizer of ``functions.text`` in the syntax of the regex module.
PRETOKENS = regex.compile(
    "'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-z\x80-\U0010ffff]+| ?[0-9]+| ?[^ \t\n\r\x0b\x0cA-Za-z0-9\x80-\U0010ffff]+|[ \t\n\r\x0b\x0c]+(?![^ \t\n\r\x0b\x0c])|[ \t\n\r\x0b\x0c]"
)
_SPECIAL = re.compile(r"<\|[^|<>]*\|>")


def byte_alphabet() -> dict[int, str]:
    """Byte -> character: visible Latin-1 bytes stand for themselves, the others for characters from 256 on, in order."""
    own = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(256, 512))
    return {b: chr(b if b in own else next(spare)) for b in range(256)}


_TO_CHAR = byte_alphabet()
_TO_BYTE = {c: b for b, c in _TO_CHAR.items()}


class BpeModel:
    """Vocabulary and ranked merges over the byte alphabet. ``vocab`` maps token strings to ids (of repeats the last holds)."""

    def __init__(self, vocab: dict[str, int], merges: list[tuple[str, str]], bos_id: int = -1):
        self.vocab, self.ranks, self.bos_id = vocab, {p: r for r, p in enumerate(merges)}, bos_id
        self.tokens = {i: t for t, i in vocab.items()}
        special = sorted((t for t in vocab if _SPECIAL.fullmatch(t)), key=lambda t: (-len(t), t))
        self.special = re.compile("(" + "|".join(map(re.escape, special)) + ")") if special else None
        self.known: dict[str, list[int]] = {}

    def merge(self, symbols: list[str]) -> list[str]:
        """Joins the pair of lowest rank, leftmost on ties, until no pair has a rank; by a heap over linked neighbours."""
        n = len(symbols)
        after, before, word = list(range(1, n + 1)), list(range(-1, n - 1)), list(symbols)
        heap = [(r, i, i + 1) for i in range(n - 1) if (r := self.ranks.get((word[i], word[i + 1]))) is not None]
        heapq.heapify(heap)
        alive, pair_of = [True] * n, {}
        for r, i, j in heap:
            pair_of[i] = (word[i], word[j])
        while heap:
            rank, i, j = heapq.heappop(heap)
            if not (alive[i] and j < n and alive[j] and after[i] == j and self.ranks.get((word[i], word[j])) == rank):
                continue
            word[i] += word[j]
            alive[j], after[i] = False, after[j]
            if after[j] < n:
                before[after[j]] = i
            for a, b in ((before[i], i), (i, after[i])):
                if a >= 0 and b < n and (r := self.ranks.get((word[a], word[b]))) is not None:
                    heapq.heappush(heap, (r, a, b))
        return [w for w, live in zip(word, alive) if live]

    def _chunk(self, chunk: str) -> list[int]:
        if (found := self.known.get(chunk)) is not None:
            return found
        out: list[int] = []
        for symbol in self.merge([_TO_CHAR[b] for b in chunk.encode("utf-8", "surrogatepass")]):
            if (i := self.vocab.get(symbol)) is not None:
                out.append(i)
            else:  # its bytes by name; bytes without a token are dropped
                out += [i for c in symbol if (i := self.vocab.get(f"<0x{_TO_BYTE[c]:02X}>")) is not None]
        if len(chunk) <= 64:
            if len(self.known) > 300_000:
                self.known.clear()
            self.known[chunk] = out
        return out

    def encode(self, text: str | None, add_bos: bool = False, special: bool = True) -> list[int]:
        """Ids of a text; of null and of the empty text none (but the first token, if asked for). Special tokens are atomic."""
        out = [self.bos_id] if add_bos and self.bos_id >= 0 else []
        for part in self.special.split(text or "") if special and self.special else [text or ""]:
            if special and part in self.vocab and _SPECIAL.fullmatch(part):
                out.append(self.vocab[part])
            else:
                for chunk in PRETOKENS.findall(part):
                    out += self._chunk(chunk)
        return out

    def token_bytes(self, token: int) -> bytes:
        """Bytes of a token; nothing for unknown ids; characters outside the alphabet stand for themselves."""
        text = self.tokens.get(token, "")
        if m := re.fullmatch(r"<0x([0-9A-F]{2})>", text):
            return bytes([int(m.group(1), 16)])
        if _SPECIAL.fullmatch(text):
            return text.encode()
        return b"".join(bytes([_TO_BYTE[c]]) if c in _TO_BYTE else c.encode() for c in text)

    def decode(self, ids: list[int]) -> str:
        return b"".join(map(self.token_bytes, ids)).decode("utf-8", "replace")


def complete_length(buffer: bytes) -> int:
    """Length without a torn last character; a byte that can begin no character is not waited for."""
    for back in range(1, min(4, len(buffer)) + 1):
        byte = buffer[-back]
        if byte & 0xC0 == 0x80:
            continue
        need = 1 if byte < 0x80 else 2 if byte >> 5 == 6 else 3 if byte >> 4 == 14 else 4 if byte >> 3 == 30 else 0
        return len(buffer) - back if need > back else len(buffer)
    return len(buffer)


class Decoder:
    """Pieces of text from tokens as they come; bytes of a torn character wait for the next token."""

    def __init__(self, model: BpeModel):
        self.model, self.buffer = model, b""

    def push(self, token: int) -> str:
        self.buffer += self.model.token_bytes(token)
        n = complete_length(self.buffer)
        out, self.buffer = self.buffer[:n], self.buffer[n:]
        return out.decode("utf-8", "replace")

    def flush(self) -> str:
        out, self.buffer = self.buffer, b""
        return out.decode("utf-8", "replace")


def load_model(path: str) -> BpeModel:
    """Model of a tokenizer file in JSON with ``model.vocab`` and ``model.merges``."""
    import json

    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ", 1)) for m in spec["model"]["merges"]]
    return BpeModel(dict(spec["model"]["vocab"]), merges)


_LOADED: dict[str, BpeModel] = {}


def encode_documents(df: DataFrame, key: str, text: str, path: str, special: bool = True) -> DataFrame:
    """(key, ids): ids of each text under the model of a file, which every worker reads once; no shuffle.

    Null and empty texts have the empty list; equal pretokens are merged once per worker.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if path not in _LOADED:
            _LOADED[path] = load_model(path)
        model = _LOADED[path]
        for batch in batches:
            ids = [model.encode(t, special=special) for t in batch.column(1).to_pylist()]
            ends = pa.array(np.cumsum([0, *map(len, ids)]).astype(np.int32))
            flat = pa.array(np.fromiter((i for x in ids for i in x), np.int32))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(ends, flat)], ["k", "ids"])

    slim = df.select(F.col(key).cast("bigint").alias("k"), F.col(text).alias("t"))
    return slim.mapInArrow(run, "k bigint, ids array<int>").withColumnRenamed("k", key)


def decode_documents(df: DataFrame, key: str, ids: str, path: str) -> DataFrame:
    """(key, text): the text of each id array; null and empty arrays give the empty text. Unknown ids stand for nothing."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = load_model(path)
        known: dict[int, bytes] = {}
        for batch in batches:
            out = []
            for own in batch.column(1).to_pylist():
                for i in set(own or ()) - known.keys():
                    known[i] = model.token_bytes(i)
                out.append(b"".join(known[i] for i in own or ()).decode("utf-8", "replace"))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string())], ["key", "text"])

    kind = dict(df.dtypes)[key]
    return df.select(F.col(key).alias("key"), F.col(ids).alias("ids")).mapInArrow(run, f"key {kind}, text string").withColumnRenamed("key", key)
