"""Registration of the engine's parts in a session: SQL functions, a table function, data sources."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .functions import quant
from .functions.bpe import PRETOKENS, load_model
from .sources import containers, tokbin


class ChunkTokens:
    """Table function: pieces of a text's pretokens as (chunk, first_token, n_tokens, text)."""

    def eval(self, text: str | None, size: int = 7800, least: int = 64) -> Iterator[tuple]:
        pieces = PRETOKENS.findall(text or "")
        for k, at in enumerate(range(0, len(pieces), size)):
            part = pieces[at : at + size]
            if len(part) >= least:
                yield k, at, len(part), "".join(part)


def register(spark: SparkSession, tokenizer_path: str | None = None) -> None:
    """SQL functions ``dequantize(data, type)``, with a tokenizer ``bpe_encode(text)`` and ``bpe_decode(ids)``, the table
    function ``chunk_tokens(text, size, least)``, and the sources ``tokbin``, ``gguf`` and ``poscon``."""
    for source in (tokbin.TokBinSource, containers.GgufSource, containers.PositionalSource):
        spark.dataSource.register(source)
    spark.udtf.register("chunk_tokens", F.udtf(ChunkTokens, returnType="chunk int, first_token int, n_tokens int, text string"))

    @F.pandas_udf("array<float>")
    def dequantize(data: pd.Series, kinds: pd.Series) -> pd.Series:
        return pd.Series([None if x is None else quant.dequantize(x, int(k)) for x, k in zip(data, kinds)])

    spark.udf.register("dequantize", dequantize)
    if tokenizer_path:
        models: list = []

        def model():
            if not models:
                models.append(load_model(tokenizer_path))
            return models[0]

        @F.pandas_udf("array<int>")
        def bpe_encode(texts: pd.Series) -> pd.Series:
            return texts.map(lambda t: model().encode(t))

        @F.pandas_udf("string")
        def bpe_decode(ids: pd.Series) -> pd.Series:
            return ids.map(lambda x: None if x is None else model().decode(list(x)))

        spark.udf.register("bpe_encode", bpe_encode)
        spark.udf.register("bpe_decode", bpe_decode)
