"""Shared pieces of the training-data operators: tables, roles, batches, tokenizer paths."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ensure_checkpoints

#: Where the vocabulary files of the public tokenizers lie; every operator takes it as a parameter.
TOKENIZER_DIR = "/opt/tokenizers"

USER_ROLES = ("user", "human")
ASSISTANT_ROLES = ("assistant", "gpt", "bot")

#: Markers that end a reasoning region (the longest list any token file names).
THINK_END_MARKERS = ("</think>", "<|end_of_thought|>", "<|begin_of_solution|>")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def side(role: Column) -> Column:
    """'user', 'assistant' or null (system, tool, no role)."""
    return F.when(role.isin(*USER_ROLES), F.lit("user")).when(role.isin(*ASSISTANT_ROLES), F.lit("assistant"))


def map_arrow(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch], schema: str) -> DataFrame:
    """``mapInArrow`` for a function of one batch; empty batches are skipped."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield fn(batch)

    return df.mapInArrow(run, schema)


def kept(df: DataFrame) -> DataFrame:
    """``df`` computed once and read back from the folder that executors share, so that later steps do not repeat it."""
    ensure_checkpoints(df.sparkSession)
    return df.checkpoint()


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Hash-partition by ``keys``, as many partitions as the session shuffles into."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)
