"""Checks of scanned model containers as relations: every violation is a row, a file without rows is sound."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .metadata import LAYER_TENSORS, byte_size

#: Keys that a container must have, below the name of its architecture, and the field each gives.
REQUIRED = (
    ("embedding_length", "width"), ("block_count", "layers"), ("attention.head_count", "heads"), ("attention.head_count_kv", "kv_heads"),
    ("attention.key_length", "head_dim"), ("feed_forward_length", "ff"), ("context_length", "context"),
)
#: Fixed value: positions of the key-value window at most.
WINDOW = 4096


def container_config(rows: DataFrame, arch: str) -> DataFrame:
    """(file, architecture, spec_version, one column for each required key, vocab, kv_window): null where a key is missing."""
    keys = rows.where("kind = 'key'")

    def number(name: str) -> Column:
        return F.max(F.when(F.col("name") == name, F.col("value").try_cast("bigint")))

    def text(name: str) -> Column:
        return F.max(F.when(F.col("name") == name, F.col("value")))

    out = keys.groupBy("file").agg(
        text("general.architecture").alias("architecture"), number(f"{arch}.spec_version").alias("spec_version"), *[number(f"{arch}.{k}").alias(f) for k, f in REQUIRED],
        F.max(F.when(F.col("name") == "tokenizer.tokens", F.size(F.from_json("value", "array<string>")))).cast("bigint").alias("vocab"),
    )
    return out.withColumn("kv_window", F.least("context", F.lit(WINDOW)))


def expected_of(config: DataFrame) -> DataFrame:
    """(file, name, ne0, ne1): the tensors that each file's configuration asks for; vectors have ne1 = 1."""
    q, kv = F.col("heads") * F.col("head_dim"), F.col("kv_heads") * F.col("head_dim")
    e, ff, one = F.col("width"), F.col("ff"), F.lit(1).cast("bigint")
    shapes = dict(zip(LAYER_TENSORS, [(e, one), (e, q), (e, kv), (e, kv), (q, e), (e, one), (e, ff), (e, ff), (ff, e)]))
    per_layer = F.array(*[F.struct(F.lit(n).alias("n"), a.cast("bigint").alias("ne0"), b.cast("bigint").alias("ne1")) for n, (a, b) in shapes.items()])
    full = config.where("layers > 0 and width > 0 and heads > 0 and kv_heads > 0 and head_dim > 0 and ff > 0")
    layers = full.select("file", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("layers") - 1)).alias("l"), per_layer.alias("t"))
    blocks = layers.select("file", "l", F.inline("t")).select("file", F.concat(F.lit("blk."), F.col("l").cast("string"), F.lit("."), F.col("n"), F.lit(".weight")).alias("name"), "ne0", "ne1")
    outer = full.select("file", F.inline(F.array(F.struct(F.lit("token_embd.weight").alias("name"), e.alias("ne0"), F.col("vocab").alias("ne1")), F.struct(F.lit("output_norm.weight").alias("name"), e.alias("ne0"), one.alias("ne1")))))
    return blocks.unionByName(outer)


def container_problems(rows: DataFrame, arch: str = "decoder", spec_version: int = 1) -> DataFrame:
    """(file, problem, name): what is wrong with each scanned file.

    ``unreadable``; ``architecture`` and ``spec_version`` other than asked for; a required ``key`` that is missing or ``zero``;
    ``groups`` (heads no multiple of key-value heads) and ``rope`` (odd head size); tensors ``missing``, ``unknown``, of another
    ``shape``, or of another ``size`` in bytes than their shape and type have. An output matrix is optional. Tensors are compared
    with those of the file's own configuration by one full join on (file, name).
    """
    config = container_config(rows, arch)
    files = rows.where("kind = 'header'").select("file").distinct().join(config, "file", "left")
    checks = [
        F.struct((~F.col("architecture").eqNullSafe(F.lit(arch))).alias("bad"), F.lit("architecture").alias("problem"), F.col("architecture").alias("name")),
        F.struct((~F.col("spec_version").eqNullSafe(F.lit(spec_version))).alias("bad"), F.lit("spec_version").alias("problem"), F.col("spec_version").cast("string").alias("name")),
        *[F.struct(F.col(f).isNull().alias("bad"), F.lit("key").alias("problem"), F.lit(k).alias("name")) for k, f in REQUIRED],
        *[F.struct((F.col(f) == 0).alias("bad"), F.lit("zero").alias("problem"), F.lit(k).alias("name")) for k, f in REQUIRED],
        F.struct((F.try_mod("heads", "kv_heads") != 0).alias("bad"), F.lit("groups").alias("problem"), F.lit(None).cast("string").alias("name")),
        F.struct((F.col("head_dim") % 2 != 0).alias("bad"), F.lit("rope").alias("problem"), F.lit(None).cast("string").alias("name")),
    ]
    wrong = files.select("file", F.inline(F.array(*checks))).where("bad").select("file", "problem", "name")
    size = F.aggregate("shape", F.lit(1).cast("bigint"), lambda a, x: a * x)
    present = rows.where("kind = 'tensor'").select("file", "name", F.get("shape", F.lit(0)).alias("p0"), F.coalesce(F.get("shape", F.lit(1)), F.lit(1)).alias("p1"), (byte_size(size, F.col("qtype")) != F.col("nbytes")).alias("odd"), F.lit(True).alias("there"))
    both = present.join(expected_of(config).withColumn("asked", F.lit(True)), ["file", "name"], "full")
    known = both.join(expected_of(config).select("file").distinct(), "file", "left_semi")
    problem = (
        F.when(F.col("there").isNull(), "missing").when(F.col("asked").isNull() & (F.col("name") != "output.weight"), "unknown")
        .when((F.col("p0") != F.col("ne0")) | (F.col("p1") != F.col("ne1")), "shape").when(F.col("odd"), "size")
    )
    tensors = known.select("file", problem.alias("problem"), "name").where("problem is not null")
    broken = rows.where("kind = 'error'").select("file", F.lit("unreadable").alias("problem"), "name")
    return wrong.unionByName(tensors).unionByName(broken)
