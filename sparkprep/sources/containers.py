"""Model containers as data sources: ``gguf`` (tagged keys and a named tensor table) and ``poscon`` (fixed header, tensors by
position). Both yield one row for each key and tensor, so that validation is relational.
"""

from __future__ import annotations

import glob
import json
import os
import struct
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..operators.metadata import LAYER_TENSORS

SCHEMA = "file string, kind string, ord bigint, name string, value string, shape array<bigint>, qtype int, offset bigint, nbytes bigint"

#: Magic, header layout and flags.
GGUF_MAGIC, POSITIONAL_MAGIC = b"GGUF", b"PCON"
POSITIONAL_HEADER = struct.Struct("<4s10I2fIf2I6Q")
POSITIONAL_FIELDS = (
    "magic", "format_version", "spec_version", "n_vocab", "n_embd", "n_layer", "n_head", "n_kv_head", "head_dim", "n_ff", "ctx_len", "rope_base", "rope_scale", "rope_dim_count",
    "norm_eps", "flags", "alignment", "manifest_offset", "manifest_length", "tokenizer_offset", "tokenizer_length", "tensor_table_offset", "data_section_offset",
)
HAS_GATE, HAS_OUTPUT, HAS_OPTIMIZER = 1, 2, 4
SLOT = struct.Struct("<IQQ")

#: Scalar types of tagged values as (struct code, width); 8 is a string, 9 an array.
_SCALARS = {0: ("B", 1), 1: ("b", 1), 2: ("H", 2), 3: ("h", 2), 4: ("I", 4), 5: ("i", 4), 6: ("f", 4), 7: ("?", 1), 10: ("Q", 8), 11: ("q", 8), 12: ("d", 8)}
#: Storage types as (elements, bytes) of a block.
BLOCKS = {0: (1, 4), 1: (1, 2), 2: (32, 18), 3: (32, 20), 6: (32, 22), 7: (32, 24), 8: (32, 34), 9: (32, 36), 10: (256, 84), 11: (256, 110), 12: (256, 144), 13: (256, 176), 14: (256, 210), 20: (32, 18), 30: (1, 2)}


def block_bytes(elements: int, qtype: int) -> int:
    per, size = BLOCKS.get(qtype, (1, 0))
    return elements // per * size


def sniff(path: str, positional: bytes = POSITIONAL_MAGIC) -> str:
    """'gguf' or 'poscon' by the first four bytes, never by the name; anything else is an error."""
    with open(path, "rb") as f:
        head = f.read(4)
    if head == GGUF_MAGIC:
        return "gguf"
    if head == positional:
        return "poscon"
    raise ValueError(f"unknown container: {path}")


class _Cursor:
    def __init__(self, data: bytes):
        self.data, self.at = data, 0

    def take(self, n: int) -> bytes:
        if self.at + n > len(self.data):
            raise ValueError("container ends early")
        self.at += n
        return self.data[self.at - n : self.at]

    def number(self, code: str) -> int | float:
        return struct.unpack("<" + code, self.take(struct.calcsize("<" + code)))[0]

    def text(self) -> str:
        return self.take(self.number("Q")).decode("utf-8", "replace")

    def value(self, kind: int):
        if kind == 8:
            return self.text()
        if kind == 9:
            inner, n = self.number("I"), self.number("Q")
            if inner == 9:
                raise ValueError("arrays of arrays are not supported")
            return [self.value(inner) for _ in range(n)]
        if kind not in _SCALARS:
            raise ValueError(f"unknown value type {kind}")
        return self.number(_SCALARS[kind][0])


def gguf_rows(path: str) -> Iterator[tuple]:
    with open(path, "rb") as f:
        data = f.read()
    if len(data) < 16 or data[:4] != GGUF_MAGIC:
        raise ValueError(f"not a GGUF file: {path}")
    c = _Cursor(data)
    c.take(4)
    if (version := c.number("I")) not in (2, 3):
        raise ValueError(f"GGUF version {version} is not supported: {path}")
    n_tensors, n_keys = c.number("Q"), c.number("Q")
    yield path, "header", 0, "version", str(version), None, None, None, None
    alignment = 32
    for i in range(n_keys):
        name = c.text()
        value = c.value(c.number("I"))
        if name == "general.alignment" and isinstance(value, int) and value > 0:
            alignment = value
        yield path, "key", i, name, value if isinstance(value, str) else json.dumps(value, ensure_ascii=False), None, None, None, None
    table = []
    for i in range(n_tensors):
        name = c.text()
        shape = [c.number("Q") for _ in range(c.number("I"))]
        qtype, offset = c.number("I"), c.number("Q")
        table.append((i, name, shape, qtype, offset))
    start = -(-c.at // alignment) * alignment
    for i, name, shape, qtype, offset in table:
        elements = 1
        for s in shape:
            elements *= s
        size = block_bytes(elements, qtype)
        if start + offset + size > len(data):
            raise ValueError(f"tensor {name} lies outside of {path}")
        yield path, "tensor", i, name, None, shape, qtype, start + offset, size


def positional_slots(h: dict) -> list[tuple[str, list[int]]]:
    """Names and shapes of the tensors of a positional container, in table order."""
    q, kv, e, ff = h["n_head"] * h["head_dim"], h["n_kv_head"] * h["head_dim"], h["n_embd"], h["n_ff"]
    shapes = dict(zip(LAYER_TENSORS, [[e], [e, q], [e, kv], [e, kv], [q, e], [e], [e, ff], [e, ff], [ff, e]]))
    out = [("token_embd.weight", [e, h["n_vocab"]]), ("output_norm.weight", [e])]
    if h["flags"] & HAS_OUTPUT:
        out.append(("output.weight", [e, h["n_vocab"]]))
    names = [n for n in LAYER_TENSORS if n != "ffn_gate" or h["flags"] & HAS_GATE]
    return out + [(f"blk.{i}.{n}.weight", shapes[n]) for i in range(h["n_layer"]) for n in names]


def positional_rows(path: str, magic: bytes = POSITIONAL_MAGIC) -> Iterator[tuple]:
    with open(path, "rb") as f:
        data = f.read()
    if len(data) < POSITIONAL_HEADER.size or data[:4] != magic:
        raise ValueError(f"not a positional container: {path}")
    h = dict(zip(POSITIONAL_FIELDS, POSITIONAL_HEADER.unpack_from(data)))

    def section(offset: int, length: int) -> bytes:
        if offset > len(data) or length > len(data) - offset:
            raise ValueError(f"section outside of {path}")
        return data[offset : offset + length]

    for i, name in enumerate(POSITIONAL_FIELDS[1:]):
        yield path, "header", i, name, json.dumps(h[name]), None, None, None, None
    yield path, "key", 0, "manifest", section(h["manifest_offset"], h["manifest_length"]).decode(), None, None, None, None
    yield path, "key", 1, "tokenizer", section(h["tokenizer_offset"], h["tokenizer_length"]).decode(), None, None, None, None
    slots = positional_slots(h)
    table = section(h["tensor_table_offset"], len(slots) * SLOT.size)
    for i, (name, shape) in enumerate(slots):
        qtype, offset, size = SLOT.unpack_from(table, i * SLOT.size)
        section(h["data_section_offset"] + offset, size)
        yield path, "tensor", i, name, None, shape, qtype, h["data_section_offset"] + offset, size


def write_positional(path: str, config: dict, manifest: str, tokenizer: str, tensors: list[bytes], qtypes: list[int], magic: bytes = POSITIONAL_MAGIC) -> None:
    """A positional container with the given data, in the order of ``positional_slots``."""
    head, man, tok = POSITIONAL_HEADER.size, manifest.encode(), tokenizer.encode()
    table_at = head + len(man) + len(tok)
    data_at = table_at + SLOT.size * len(tensors)
    h = {"magic": magic, **config, "manifest_offset": head, "manifest_length": len(man), "tokenizer_offset": head + len(man), "tokenizer_length": len(tok), "tensor_table_offset": table_at, "data_section_offset": data_at}
    offset, slots = 0, []
    for raw, qtype in zip(tensors, qtypes):
        slots.append(SLOT.pack(qtype, offset, len(raw)))
        offset += len(raw)
    with open(path, "wb") as f:
        f.write(POSITIONAL_HEADER.pack(*[h[n] for n in POSITIONAL_FIELDS]) + man + tok + b"".join(slots) + b"".join(tensors))


def write_gguf(path: str, keys: list[tuple[str, int, object]], tensors: list[tuple[str, list[int], int, bytes]], alignment: int = 32) -> None:
    """A GGUF file of version 3 from (name, type, value) keys and (name, shape, storage type, bytes) tensors."""

    def text(s: str) -> bytes:
        raw = s.encode()
        return struct.pack("<Q", len(raw)) + raw

    def packed(kind: int, value) -> bytes:
        if kind == 8:
            return text(value)
        if kind == 9:
            inner, items = value
            return struct.pack("<IQ", inner, len(items)) + b"".join(packed(inner, x) for x in items)
        return struct.pack("<" + _SCALARS[kind][0], value)

    head = GGUF_MAGIC + struct.pack("<IQQ", 3, len(tensors), len(keys)) + b"".join(text(n) + struct.pack("<I", k) + packed(k, v) for n, k, v in keys)
    body, offset = b"", 0
    for name, shape, qtype, raw in tensors:
        head += text(name) + struct.pack("<I", len(shape)) + struct.pack(f"<{len(shape)}Q", *shape) + struct.pack("<IQ", qtype, offset)
        padded = raw + b"\0" * (-len(raw) % alignment)
        body, offset = body + padded, offset + len(padded)
    with open(path, "wb") as f:
        f.write(head + b"\0" * (-len(head) % alignment) + body)


@dataclass
class FilePartition(InputPartition):
    path: str


class _Reader(DataSourceReader):
    """One partition a file; with mode=permissive a broken file gives one row of kind 'error' instead of an exception."""

    def __init__(self, options: dict[str, str], parse):
        self.options, self.parse = options, parse

    def partitions(self) -> list[FilePartition]:
        path = self.options["path"]
        found = glob.glob(os.path.join(path, "*")) if os.path.isdir(path) else glob.glob(path)
        return [FilePartition(p) for p in sorted(found) if not os.path.basename(p).startswith(("_", "."))]

    def read(self, partition: FilePartition | None) -> Iterator[tuple]:
        if partition is None:
            return
        try:
            yield from list(self.parse(partition.path))
        except (ValueError, struct.error, UnicodeDecodeError) as e:
            if self.options.get("mode") != "permissive":
                raise
            yield partition.path, "error", 0, type(e).__name__, str(e), None, None, None, None


class GgufSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "gguf"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> _Reader:
        return _Reader(dict(self.options), gguf_rows)


class PositionalSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "poscon"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> _Reader:
        magic = dict(self.options).get("magic", POSITIONAL_MAGIC.decode()).encode("latin-1")
        return _Reader(dict(self.options), lambda path: positional_rows(path, magic))
