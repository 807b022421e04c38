"""Configuration of a model from its tensors and metadata, reports on it, and weight arithmetic of conversions."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .metadata import classify, vote


def first_present(values: Column, *keys: str) -> Column:
    """Value of the first key that a map has; null if it has none."""
    return F.coalesce(*[F.try_element_at(values, F.lit(k)) for k in keys])


def infer_config(tensors: DataFrame) -> DataFrame:
    """One row for each ``preset`` (file) of tensors(preset, name, ne0, ne1): sizes by the votes of the layers, and flags.

    n_layer is the highest layer and one; q_dim, kv_dim and n_ff are the rows that most layers' tensors have, the first seen
    on ties; width and vocabulary come from the embedding; ``tied`` says that there is no output matrix.
    """
    known = classify(tensors)
    keyed = known.where(F.col("role").isin("attn_q", "attn_k", "ffn_up")).select(F.concat_ws("/", "preset", "role").alias("g"), "ne1", "layer")
    votes = vote(keyed, "g", "ne1", "layer").select(F.substring_index("g", "/", 1).alias("preset"), F.substring_index("g", "/", -1).alias("role"), "ne1")
    sizes = votes.groupBy("preset").agg(*[F.max(F.when(F.col("role") == r, F.col("ne1"))).alias(n) for r, n in (("attn_q", "q_dim"), ("attn_k", "kv_dim"), ("ffn_up", "n_ff"))])
    flags = known.groupBy("preset").agg(
        (F.max("layer") + 1).alias("n_layer"), F.max(F.when(F.col("role") == "token_embd", F.col("ne0"))).alias("width"), F.max(F.when(F.col("role") == "token_embd", F.col("ne1"))).alias("vocab"),
        (~F.bool_or(F.col("role") == "output")).alias("tied"), F.bool_or(F.endswith("role", F.lit("bias"))).alias("has_bias"), F.bool_or(F.col("role").isin("attn_q_norm", "attn_k_norm")).alias("has_qk_norm"),
        F.bool_or(F.col("role").isin("attn_qkv", "ffn_gate_up")).alias("fused"), F.count_if(F.col("role") == "other").alias("n_unmatched"),
    )
    return flags.join(sizes, "preset", "left")


def with_overrides(config: DataFrame, **given: int | float | None) -> DataFrame:
    """Configuration with given values in place of inferred ones, and the defaults of missing ones."""
    defaults = {"norm_eps": 1e-5, "rope_base": 10000.0, "rope_scale": 1.0}
    for name, value in {**dict.fromkeys(defaults), **given}.items():
        own = F.col(name) if name in config.columns else F.lit(None)
        fallback = F.lit(defaults.get(name))
        config = config.withColumn(name, F.lit(value) if value is not None else F.coalesce(own, fallback))
    return config


def compatibility(config: DataFrame) -> DataFrame:
    """``mechanical`` steps that a conversion takes by itself, and ``blocking`` ones, as lists of names."""

    def listed(**tests: Column) -> Column:
        return F.filter(F.array(*[F.when(t, F.lit(n)) for n, t in tests.items()]), lambda x: x.isNotNull())

    return config.select(
        "preset", listed(split_fused=F.col("fused"), tie_output=~F.col("tied")).alias("mechanical"),
        listed(bias=F.col("has_bias"), qk_norm=F.col("has_qk_norm"), unmatched=F.col("n_unmatched") > 0, groups=F.col("q_dim") % F.col("kv_dim") != 0).alias("blocking"),
    )


def split_rows(matrix: np.ndarray, sizes: list[int]) -> list[np.ndarray]:
    """Consecutive row blocks of a fused matrix; the sizes must add up to its rows."""
    if sum(sizes) != len(matrix):
        raise ValueError(f"{sizes} do not add up to {len(matrix)} rows")
    return np.split(matrix, np.cumsum(sizes)[:-1])


def low_rank_update(weight: np.ndarray, a: np.ndarray, b: np.ndarray, alpha: float) -> np.ndarray:
    """weight + alpha / rank * b @ a"""
    return weight + alpha / a.shape[0] * (b @ a)


def row_parts(rows: DataFrame, row: str, sizes: list[tuple[str, int]]) -> DataFrame:
    """``rows`` with ``part`` and ``part_row``: consecutive runs of a fused matrix's rows by the sizes given, in their order.

    Rows beyond the sizes, and null rows, have no part; a caller compares the counts with the sizes.
    """
    part, at, base = F.lit(None).cast("string"), 0, F.lit(None).cast("bigint")
    r = F.col(row)
    for name, size in reversed(list(sizes)):
        end = sum(n for _, n in sizes[: [s[0] for s in sizes].index(name) + 1])
        at = end - size
        part = F.when((r >= at) & (r < end), name).otherwise(part)
        base = F.when((r >= at) & (r < end), r - at).otherwise(base)
    return rows.withColumns({"part": part, "part_row": base.cast("bigint")})


def negligible(values: Column, eps: float = 1e-6) -> Column:
    """Whether no value's magnitude passes ``eps``; null and empty arrays are negligible."""
    return F.coalesce(F.array_max(F.transform(values, lambda x: F.abs(x))), F.lit(0.0)) <= eps


def storage_choice(ne0: Column, wanted: Column, per_block: Column) -> Column:
    """The storage type of a tensor: the wanted one if rows are whole blocks of it, else F16 (1)."""
    return F.when(ne0 % per_block == 0, wanted).otherwise(1)


def is_subset(part: Column, whole: Column) -> Column:
    """Whether all items of an array are in another; null counts as no items."""
    none = F.array().cast("array<string>")
    return F.size(F.array_except(F.coalesce(part, none), F.coalesce(whole, none))) == 0


def detect_report(classified: DataFrame, key: str) -> DataFrame:
    """(key, role, n, first_layer, last_layer): what a model's tensors are, with 'other' for names that nothing fits."""
    return classified.groupBy(key, "role").agg(F.count(F.lit(1)).alias("n"), F.min("layer").alias("first_layer"), F.max("layer").alias("last_layer"))


def missing_roles(classified: DataFrame, key: str, required: tuple[str, ...]) -> DataFrame:
    """(key, missing): the required roles that a model has no tensor of, in their order; models that lack none have no row."""
    own = classified.groupBy(key).agg(F.collect_set("role").alias("roles"))
    missing = F.array_except(F.array(*[F.lit(r) for r in required]), "roles")
    return own.select(key, missing.alias("missing")).where(F.size("missing") > 0)
