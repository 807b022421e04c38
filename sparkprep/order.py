"""Stable pseudo-random order: md5 of a seed and keys, the same in every engine, executor and run."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def stable_key(seed: int, *keys: str | Column) -> Column:
    """Hex md5 of 'seed:key:...'; null keys count as empty."""
    parts = [F.coalesce((F.col(k) if isinstance(k, str) else k).cast("string"), F.lit("")) for k in keys]
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *parts))
