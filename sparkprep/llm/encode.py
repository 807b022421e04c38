"""Problem 6: encoding of a whole corpus with a public tokenizer."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import prefix_bpe
from .common import TOKENIZER_DIR, map_arrow


def encode_texts(df: DataFrame, key: str, text: str, name: str = "byte_bpe_50k", tokenizer_dir: str = TOKENIZER_DIR) -> DataFrame:
    """(key, ids): the token ids of each text, without special tokens.

    Null and empty texts get the empty list; strings that look like special tokens are ordinary text; texts of any length
    are encoded whole (time is linear). Rows are independent: no shuffle, repeated rows come out repeatedly. The vocabulary
    is read once per worker.
    """

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        bpe = prefix_bpe.load(name, tokenizer_dir)
        ids = [bpe.encode(x) for x in batch.column(1).to_pylist()]
        ends = np.cumsum([0, *map(len, ids)], dtype=np.int32)
        lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.empty(0, np.int32), *ids])))
        return pa.RecordBatch.from_arrays([batch.column(0), lists], ["k", "ids"])

    slim = df.select(F.col(key).cast("bigint").alias("k"), F.col(text).alias("t"))
    return map_arrow(slim, run, "k bigint, ids array<int>").withColumnRenamed("k", key)
