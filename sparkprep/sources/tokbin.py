"""Packed token files as a data source: ``spark.read.format("tokbin")`` and ``df.write.format("tokbin")``.

A file is an 8-byte magic, a length-prefixed JSON header, and records to its end: the number of tokens, ids of 2 or 4
bytes, a loss mask and an answer mask of one byte each, all little-endian. Reading stops cleanly at a torn last record.
Large files are read in parts that begin at records (option ``split``, in bytes); batches are written as Arrow arrays.
The magic is an option, so that files of other programs with this layout can be read and written.
"""

from __future__ import annotations

import glob
import json
import os
import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

MAGIC = "TOKBIN01"
SCHEMA = "file string, record bigint, ids array<int>, mask array<tinyint>, is_answer array<tinyint>"


def typecode(ceiling: int) -> str:
    return "H" if ceiling <= 0xFFFF else "I"


def encode_header(header: dict, magic: str = MAGIC) -> bytes:
    body = json.dumps(header, ensure_ascii=False).encode()
    return magic.encode("latin-1") + struct.pack("<I", len(body)) + body


def encode_record(ids: list[int], mask: list[int], answer: list[int], code: str) -> bytes:
    """Bytes of a record; of an empty one none."""
    if not len(ids):
        return b""
    return struct.pack("<I", len(ids)) + np.asarray(ids, "<u2" if code == "H" else "<u4").tobytes() + np.asarray(mask, np.uint8).tobytes() + np.asarray(answer, np.uint8).tobytes()


def read_header(path: str, magic: str = MAGIC) -> tuple[dict, int]:
    """(header, offset of the first record); a file without the magic is an error, an empty one as well."""
    with open(path, "rb") as f:
        head = f.read(12)
        if len(head) < 12 or head[:8] != magic.encode("latin-1"):
            raise ValueError(f"not a packed token file: {path}")
        n = struct.unpack("<I", head[8:])[0]
        body = f.read(n)
    if len(body) < n:
        raise ValueError(f"torn header: {path}")
    return json.loads(body), 12 + n


def is_token_file(path: str, magic: str = MAGIC) -> bool:
    """By its suffix '.bin' without opening it, else by its first bytes; unreadable files are none."""
    if path.endswith(".bin"):
        return True
    try:
        with open(path, "rb") as f:
            return f.read(8) == magic.encode("latin-1")
    except OSError:
        return False


def record_width(header: dict) -> int:
    """Bytes of a token in all three arrays."""
    return (2 if header.get("id_typecode", "I") == "H" else 4) + 2


def cuts(path: str, split: int, magic: str = MAGIC) -> list[tuple[int, int, int]]:
    """(begin, end, number of the first record) of parts of about ``split`` bytes that begin at records; only record lengths are read."""
    header, at = read_header(path, magic)
    width, size = record_width(header), os.path.getsize(path)
    if size - at <= split:
        return [(at, size, 0)]
    out, begin, first, number = [], at, 0, 0
    with open(path, "rb") as f:
        while at + 4 <= size:
            f.seek(at)
            at += 4 + struct.unpack("<I", f.read(4))[0] * width
            number += 1
            if at - begin >= split and at <= size:
                out.append((begin, at, first))
                begin, first = at, number
    return [*out, (begin, size, first)] if begin < size else out


def records(path: str, magic: str = MAGIC, begin: int | None = None, end: int | None = None) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    header, at = read_header(path, magic)
    kind, width = ("<u2", 2) if header.get("id_typecode", "I") == "H" else ("<u4", 4)
    at = at if begin is None else begin
    with open(path, "rb") as f:
        f.seek(at)
        while (end is None or at < end) and len(prefix := f.read(4)) == 4:
            n = struct.unpack("<I", prefix)[0]
            body = f.read(n * (width + 2))
            if len(body) < n * (width + 2):
                return
            at += 4 + len(body)
            yield np.frombuffer(body, kind, n), np.frombuffer(body, np.uint8, n, n * width), np.frombuffer(body, np.uint8, n, n * (width + 1))


def _lists(rows: list[np.ndarray], kind: type, arrow: pa.DataType) -> pa.Array:
    ends = pa.array(np.cumsum([0, *map(len, rows)]).astype(np.int32))
    return pa.ListArray.from_arrays(ends, pa.array(np.concatenate([np.empty(0, kind), *rows]).astype(kind), arrow))


def _rows(column: pa.Array, kind) -> Iterator[np.ndarray]:
    """The lists of an Arrow column as slices of one array; null lists are empty."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    ends = column.offsets.to_numpy()
    flat = column.values.to_numpy(zero_copy_only=False).astype(kind)
    for live, a, b in zip(column.is_valid().to_pylist(), ends[:-1], ends[1:]):
        yield flat[a:b] if live else flat[:0]


@dataclass
class FilePartition(InputPartition):
    path: str
    begin: int
    end: int
    first: int


class TokBinReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.magic, self.split = options.get("magic", MAGIC), int(options.get("split", 128 << 20))
        path = options["path"]
        self.files = sorted(p for p in glob.glob(os.path.join(path, "*")) if not os.path.basename(p).startswith(("_", "."))) if os.path.isdir(path) else sorted(glob.glob(path))

    def partitions(self) -> list[FilePartition]:
        return [FilePartition(p, *cut) for p in self.files for cut in cuts(p, self.split, self.magic)]

    def read(self, partition: FilePartition | None) -> Iterator[pa.RecordBatch]:
        if partition is None:
            return
        rows: list[tuple] = []
        first = partition.first

        def batch() -> pa.RecordBatch:
            ids, mask, answer = zip(*rows)
            n = len(rows)
            return pa.RecordBatch.from_arrays(
                [pa.array([partition.path] * n), pa.array(np.arange(first, first + n)), _lists(ids, np.int32, pa.int32()), _lists(mask, np.int8, pa.int8()), _lists(answer, np.int8, pa.int8())],
                ["file", "record", "ids", "mask", "is_answer"],
            )

        for row in records(partition.path, self.magic, partition.begin, partition.end):
            rows.append(row)
            if len(rows) == 1000:
                yield batch()
                first, rows[:] = first + len(rows), []
        if rows:
            yield batch()


@dataclass
class Written(WriterCommitMessage):
    path: str
    n: int


class TokBinWriter(DataSourceArrowWriter):
    """One file a task, named at commit; ``append`` asks that files already there have the same header."""

    def __init__(self, options: dict[str, str], overwrite: bool):
        self.folder, self.magic, self.overwrite = options["path"], options.get("magic", MAGIC), overwrite
        ceiling = int(options.get("vocab_ceiling", 0xFFFFFFFF))
        self.header = {
            "tokenizer_source": options.get("tokenizer_source", ""), "max_len": int(options.get("max_len", 8192)),
            "think_end_markers": json.loads(options.get("think_end_markers", "[]")), "id_typecode": typecode(ceiling), "vocab_ceiling": ceiling,
        }
        self.old = sorted(glob.glob(os.path.join(self.folder, "*.bin")))
        if not overwrite:
            for path in self.old:
                if read_header(path, self.magic)[0] != self.header:
                    raise ValueError(f"{path} has another header; overwrite the folder or write elsewhere")

    def write(self, iterator: Iterator) -> Written:
        os.makedirs(self.folder, exist_ok=True)
        path, n = os.path.join(self.folder, f".{uuid.uuid4().hex}.tmp"), 0
        with open(path, "wb") as f:
            f.write(encode_header(self.header, self.magic))
            for batch in iterator:
                parts = [_rows(batch.column(batch.schema.get_field_index(c)), kind) for c, kind in (("ids", "<u2" if self.header["id_typecode"] == "H" else "<u4"), ("mask", np.uint8), ("is_answer", np.uint8))]
                for ids, mask, answer in zip(*parts):
                    if len(ids):
                        f.write(struct.pack("<I", len(ids)) + ids.tobytes() + mask.tobytes() + answer.tobytes())
                        n += 1
        return Written(path, n)

    def commit(self, messages: list[Written | None]) -> None:
        if self.overwrite:
            for path in self.old:
                os.remove(path)
        run = uuid.uuid4().hex[:8]
        for i, m in enumerate(x for x in messages if x is not None):
            if m.n:
                os.rename(m.path, os.path.join(self.folder, f"part-{i:05d}-{run}.bin"))
            else:
                os.remove(m.path)

    def abort(self, messages: list[Written | None]) -> None:
        for m in messages:
            if m is not None and os.path.exists(m.path):
                os.remove(m.path)


class TokBinSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "tokbin"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> TokBinReader:
        return TokBinReader(dict(self.options))

    def writer(self, schema, overwrite: bool) -> TokBinWriter:
        return TokBinWriter(dict(self.options), overwrite)
