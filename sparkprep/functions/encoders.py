"""Tokenizers as functions from texts to id arrays, by name of a backend; each is read once per worker."""

from __future__ import annotations

import base64
import json
import os
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed value: the split pattern of byte_bpe_50k.
SPLIT_PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

Encoder = Callable[[list[str]], list[list[int]]]
_LOADED: dict[tuple[str, str], Encoder] = {}

#: ``auto`` takes the first backend whose library and file are there.
BACKENDS = ("tiktoken", "tokenizers", "native", "sentencepiece", "bytes")


def load(path: str, backend: str = "auto") -> Encoder:
    """Encoder of a vocabulary file (path without suffix); ``bytes`` needs none and gives the UTF-8 bytes of a text.

    An unknown backend and a missing file are errors. Special-token strings in a text are ordinary text.
    """
    if (path, backend) in _LOADED:
        return _LOADED[path, backend]
    if backend == "auto":
        suffix = {"tiktoken": ".tiktoken", "tokenizers": ".json", "sentencepiece": ".model"}
        backend = next((b for b in suffix if os.path.exists(path + suffix[b])), "")
        if not backend:
            raise FileNotFoundError(f"no vocabulary file of {path}")
    if backend == "bytes":
        encode: Encoder = lambda texts: [list(t.encode("utf-8", "surrogatepass")) for t in texts]
    elif backend == "tiktoken":
        import tiktoken

        with open(f"{path}.tiktoken", "rb") as f:
            ranks = {base64.b64decode(word): int(rank) for word, rank in (line.split() for line in f if line.strip())}
        model = tiktoken.Encoding(os.path.basename(path), pat_str=SPLIT_PATTERN, mergeable_ranks=ranks, special_tokens={})
        encode = lambda texts: model.encode_ordinary_batch(texts, num_threads=1)
    elif backend == "tokenizers":
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        with open(f"{path}.json", encoding="utf-8") as f:
            spec = json.load(f)
        model = Tokenizer.from_str(json.dumps(spec | {"post_processor": None}))
        model.encode_special_tokens = True
        encode = lambda texts: [x.ids for x in model.encode_batch_fast(texts, add_special_tokens=False)]
    elif backend == "native":
        from .bpe import load_model

        native = load_model(f"{path}.json")
        encode = lambda texts: [native.encode(t, special=False) for t in texts]
    elif backend == "sentencepiece":
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=f"{path}.model")
        encode = lambda texts: model.encode(texts, num_threads=1)
    else:
        raise ValueError(f"unknown backend {backend}, known are {', '.join(BACKENDS)}")
    _LOADED[path, backend] = encode
    return encode


def encoded(df: DataFrame, texts: dict[str, str], path: str, backend: str = "auto") -> DataFrame:
    """``df`` with an array column of ids for each text column of ``texts`` (text column -> new column); the text columns go.

    Null and empty texts have no ids. One call of the tokenizer a batch and column; rows are independent, nothing is shuffled.
    """
    kept = [c for c in df.columns if c not in texts]

    def run(batches):
        encode = load(path, backend)
        for batch in batches:
            if batch.num_rows:
                columns = [batch.column(batch.schema.get_field_index(c)) for c in kept]
                for text in texts:
                    ids = encode([t or "" for t in batch.column(batch.schema.get_field_index(text)).to_pylist()])
                    columns.append(pa.array(ids, pa.list_(pa.int32())))
                yield pa.RecordBatch.from_arrays(columns, [*kept, *texts.values()])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*kept).schema), *(f"`{c}` array<int>" for c in texts.values())])
    return df.select(*kept, *[F.col(t) for t in texts]).mapInArrow(run, schema)
