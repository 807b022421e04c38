"""Registered queries of the core, by subject."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def _all() -> dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]]:
    from . import corpus, engine, models, numeric, records

    return {**corpus.QUERIES, **numeric.QUERIES, **models.QUERIES, **engine.QUERIES, **records.QUERIES}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, (f, _) in _all().items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in _all().items() if sql}
