"""Model metadata as tables: expected tensors, byte sizes, offsets, roles, votes, configuration checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Storage types as (id, name, elements per block, bytes per block).
STORAGE = (
    (0, "F32", 1, 4), (1, "F16", 1, 2), (2, "Q4_0", 32, 18), (3, "Q4_1", 32, 20), (6, "Q5_0", 32, 22), (7, "Q5_1", 32, 24), (8, "Q8_0", 32, 34), (9, "Q8_1", 32, 36),
    (10, "Q2_K", 256, 84), (11, "Q3_K", 256, 110), (12, "Q4_K", 256, 144), (13, "Q5_K", 256, 176), (14, "Q6_K", 256, 210), (20, "IQ4_NL", 32, 18), (30, "BF16", 1, 2),
)

#: Shapes of three model sizes (name, vocabulary, width, layers, heads, key-value heads, head size, feed-forward).
PRESETS = (("4b", 200064, 3072, 36, 24, 8, 128, 9216), ("1_5b", 50257, 2048, 30, 16, 4, 128, 5504), ("tiny", 200064, 64, 2, 4, 2, 16, 128))

#: Tensors of a layer in file order.
LAYER_TENSORS = ("attn_norm", "attn_q", "attn_k", "attn_v", "attn_output", "ffn_norm", "ffn_gate", "ffn_up", "ffn_down")

#: A role's tensor name in a layer, in the two naming schemes; '-' where a scheme has none.
LAYER_ROLES = (
    ("attn_norm", "attn_norm.weight", "input_layernorm.weight"), ("attn_q", "attn_q.weight", "self_attn.q_proj.weight"),
    ("attn_k", "attn_k.weight", "self_attn.k_proj.weight"), ("attn_v", "attn_v.weight", "self_attn.v_proj.weight"),
    ("attn_qkv", "attn_qkv.weight", "self_attn.qkv_proj.weight"), ("attn_qkv", "attn.wqkv.weight", "-"), ("attn_output", "attn_output.weight", "self_attn.o_proj.weight"),
    ("attn_q_norm", "attn_q_norm.weight", "self_attn.q_norm.weight"), ("attn_k_norm", "attn_k_norm.weight", "self_attn.k_norm.weight"),
    ("ffn_norm", "ffn_norm.weight", "post_attention_layernorm.weight"), ("ffn_gate", "ffn_gate.weight", "mlp.gate_proj.weight"),
    ("ffn_up", "ffn_up.weight", "mlp.up_proj.weight"), ("ffn_gate_up", "ffn_gate_up.weight", "mlp.gate_up_proj.weight"), ("ffn_down", "ffn_down.weight", "mlp.down_proj.weight"),
    ("attn_q_bias", "attn_q.bias", "self_attn.q_proj.bias"), ("attn_k_bias", "attn_k.bias", "self_attn.k_proj.bias"), ("attn_v_bias", "attn_v.bias", "self_attn.v_proj.bias"),
    ("attn_qkv_bias", "attn_qkv.bias", "self_attn.qkv_proj.bias"), ("attn_output_bias", "attn_output.bias", "self_attn.o_proj.bias"),
    ("ffn_gate_bias", "ffn_gate.bias", "mlp.gate_proj.bias"), ("ffn_up_bias", "ffn_up.bias", "mlp.up_proj.bias"), ("ffn_down_bias", "ffn_down.bias", "mlp.down_proj.bias"),
)
GLOBAL_ROLES = (("token_embd", "token_embd.weight", "model.embed_tokens.weight"), ("output_norm", "output_norm.weight", "model.norm.weight"), ("output", "output.weight", "lm_head.weight"))


def role_table(spark: SparkSession) -> DataFrame:
    """(suffix, role, scope): the known names; at most a hundred rows."""
    rows = [(x, role, "layer") for role, *names in LAYER_ROLES for x in names if x != "-"] + [(x, role, "global") for role, *names in GLOBAL_ROLES for x in names]
    return spark.createDataFrame(rows, "suffix string, role string, scope string")


def storage_types(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(STORAGE, "qtype int, type_name string, per_block bigint, block_bytes bigint")


def presets(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(PRESETS, "preset string, vocab bigint, width bigint, layers bigint, heads bigint, kv_heads bigint, head_dim bigint, ff bigint")


def byte_size(elements: Column, qtype: Column) -> Column:
    """Whole blocks times bytes of a block; 0 for unknown types."""
    out = F.lit(0).cast("bigint")
    for i, _, per, size in STORAGE:
        out = F.when(qtype == i, F.floor(elements / per) * size).otherwise(out)
    return out


def expected_tensors(config: DataFrame, tied: bool = True) -> DataFrame:
    """(preset, ord, name, ne0, ne1): every tensor a configuration must have, in file order; vectors have ne1 = 1.

    ``config`` has one row per model with the columns of ``presets``.
    """
    q, kv = F.col("heads") * F.col("head_dim"), F.col("kv_heads") * F.col("head_dim")
    one = F.lit(1).cast("bigint")
    shapes = dict(zip(LAYER_TENSORS, [("width", one), ("width", q), ("width", kv), ("width", kv), (q, F.col("width")), ("width", one), ("width", F.col("ff")), ("width", F.col("ff")), ("ff", F.col("width"))]))

    def col(x: str | Column) -> Column:
        return F.col(x) if isinstance(x, str) else x

    head = [("token_embd.weight", F.col("width"), F.col("vocab")), ("output_norm.weight", F.col("width"), one)] + ([] if tied else [("output.weight", F.col("width"), F.col("vocab"))])
    globals_ = F.array(*[F.struct(F.lit(i).cast("bigint").alias("ord"), F.lit(n).alias("name"), a.alias("ne0"), b.alias("ne1")) for i, (n, a, b) in enumerate(head)])
    layer = F.col("layer")
    per_layer = F.array(*[F.struct((F.lit(len(head) + i) + layer * len(LAYER_TENSORS)).cast("bigint").alias("ord"), F.concat(F.lit("blk."), layer.cast("string"), F.lit(f".{n}.weight")).alias("name"), col(a).alias("ne0"), b.alias("ne1")) for i, (n, (a, b)) in enumerate(shapes.items())])
    top = config.select("preset", F.inline(globals_))
    return top.unionByName(config.withColumn("layer", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("layers") - 1))).select("preset", F.inline(per_layer)))


def tensor_offsets(tensors: DataFrame, qtype: Column) -> DataFrame:
    """Tensors with ``elements``, ``nbytes`` and ``offset``, the bytes of all tensors before in the same file."""
    elements = F.col("ne0") * F.col("ne1")
    out = tensors.withColumn("elements", elements).withColumn("nbytes", byte_size(elements, qtype))
    return out.withColumn("offset", F.coalesce(F.sum("nbytes").over(W.partitionBy("preset").orderBy("ord").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))


def violations(expected: DataFrame, present: DataFrame) -> DataFrame:
    """(preset, name, problem): missing tensors, unknown ones, and wrong shapes."""
    e = expected.select("preset", "name", F.array("ne0", "ne1").alias("want"))
    p = present.select("preset", "name", F.array("ne0", "ne1").alias("have"))
    both = e.join(p, ["preset", "name"], "full")
    problem = F.when(F.col("have").isNull(), "missing").when(F.col("want").isNull(), "unknown").when(F.col("want") != F.col("have"), "shape")
    return both.select("preset", "name", problem.alias("problem")).where("problem is not null")


def classify(tensors: DataFrame, name: str = "name") -> DataFrame:
    """Tensors with ``role`` and ``layer``; role 'other' and no layer where no known name fits exactly.

    The layer prefix is split off once, so a lookup in the table of names replaces one pattern per role.
    """
    prefix = r"^(?:blk|model\.layers)\.(\d+)\."
    split = tensors.withColumns({
        "layer": F.nullif(F.regexp_extract(name, prefix, 1), F.lit("")).cast("bigint"), "__rest": F.regexp_replace(name, prefix, ""),
        "__scope": F.when(F.col(name).rlike(prefix), "layer").otherwise("global"),
    })
    roles = role_table(tensors.sparkSession).withColumnsRenamed({"suffix": "__rest", "scope": "__scope"})
    out = split.join(F.broadcast(roles), ["__rest", "__scope"], "left")
    return out.withColumn("layer", F.when(F.col("role").isNotNull(), F.col("layer"))).withColumn("role", F.coalesce("role", F.lit("other"))).drop("__rest", "__scope")


def vote(rows: DataFrame, group: str, value: str, order: str) -> DataFrame:
    """(group, value, votes): the most frequent value of each group; on ties the one seen first in ``order``."""
    counts = rows.groupBy(group, value).agg(F.count(F.lit(1)).alias("votes"), F.min(order).alias("__first"))
    best = F.row_number().over(W.partitionBy(group).orderBy(F.desc("votes"), F.asc("__first")))
    return counts.withColumn("__rank", best).where("__rank = 1").drop("__rank", "__first")


def retained(names: DataFrame, name: str, keep: int = 3) -> DataFrame:
    """Names with ``kept``: whether they are among the last ``keep`` numbered ones; names without a number are always kept.

    The limit is a top-k; names are unique.
    """
    numbered = names.where(F.col(name).rlike(r"\d+"))
    last = numbered.orderBy(F.desc(name)).limit(keep).select(F.col(name).alias("__kept"))
    joined = names.join(last, F.col(name) == F.col("__kept"), "left")
    return joined.select(name, (F.col("__kept").isNotNull() | ~F.col(name).rlike(r"\d+")).alias("kept"))


def densified(vocab: DataFrame, upto: Column) -> DataFrame:
    """(id, token, kind) for every id from 0 to ``upto``: gaps become '[UNUSED<id>]' of kind UNUSED."""
    spark = vocab.sparkSession
    ids = spark.range(1).select(F.explode(F.sequence(F.lit(0).cast("bigint"), upto.cast("bigint"))).alias("id"))
    kind = F.when(F.col("token").isNull(), "UNUSED").when(F.col("token").rlike(r"^<\|[^|<>]*\|>$"), "CONTROL").otherwise("NORMAL")
    return ids.join(vocab, "id", "left").select("id", F.coalesce("token", F.concat(F.lit("[UNUSED"), F.col("id").cast("string"), F.lit("]"))).alias("token"), kind.alias("kind"))
