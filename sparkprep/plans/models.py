"""Queries over model metadata, each with the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import conversion, metadata as MD
from .corpus import table


def tensor_manifest(spark: SparkSession, d: str) -> DataFrame:
    return MD.expected_tensors(MD.presets(spark))


def tensor_offsets(spark: SparkSession, d: str) -> DataFrame:
    """Byte sizes and offsets of all tensors, matrices as Q4_0 and vectors as F32."""
    qtype = F.when(F.col("ne1") > 1, 2).otherwise(0)
    return MD.tensor_offsets(MD.expected_tensors(MD.presets(spark)), qtype)


def tensor_nbytes(spark: SparkSession, d: str) -> DataFrame:
    """Bytes of 1000 elements, and of each token file's vocabulary, in every storage type."""
    types = MD.storage_types(spark)
    return types.select("qtype", "type_name", MD.byte_size(F.lit(1000).cast("bigint"), F.col("qtype")).alias("of_1000"), MD.byte_size(F.lit(50257 * 64).cast("bigint"), F.col("qtype")).alias("of_vocab"))


def parameter_counts(spark: SparkSession, d: str) -> DataFrame:
    return MD.expected_tensors(MD.presets(spark)).groupBy("preset").agg(F.sum(F.col("ne0") * F.col("ne1")).alias("n_parameters"), F.count(F.lit(1)).alias("n_tensors"))


def _damaged(expected: DataFrame) -> DataFrame:
    """The expected tensors with some missing, some misshapen and one unknown."""
    kept = expected.where("ord % 11 <> 3").withColumn("ne1", F.when(F.col("ord") % 13 == 5, F.col("ne1") + 1).otherwise(F.col("ne1")))
    return kept.unionByName(kept.where("ord = 0").withColumn("name", F.lit("extra.weight")))


def tensor_validation(spark: SparkSession, d: str) -> DataFrame:
    expected = MD.expected_tensors(MD.presets(spark))
    return MD.violations(expected, _damaged(expected))


def tensor_role_classify(spark: SparkSession, d: str) -> DataFrame:
    names = MD.expected_tensors(MD.presets(spark)).select("preset", "name")
    other = names.select("preset", F.replace(F.replace("name", F.lit("blk."), F.lit("model.layers.")), F.lit("attn_q."), F.lit("self_attn.q_proj.")).alias("name"))
    return MD.classify(names.unionByName(other).distinct())


def shape_votes(spark: SparkSession, d: str) -> DataFrame:
    """Mode of the row counts of each role over the layers of the damaged tensors."""
    t = MD.classify(_damaged(MD.expected_tensors(MD.presets(spark))).where("preset = '4b'")).where("layer is not null")
    return MD.vote(t.select("role", "ne1", "layer"), "role", "ne1", "layer")


def retention_keep3(spark: SparkSession, d: str) -> DataFrame:
    """Of one checkpoint a token file, which are kept."""
    names = table(spark, d, "token_files").select(F.concat(F.lit("ckpt_step"), F.lpad(F.col("file_id").cast("string"), 8, "0"), F.lit(".pt")).alias("name"))
    return MD.retained(names.unionByName(names.sparkSession.createDataFrame([("ckpt_best.pt",)], "name string")), "name")


def vocab_densify(spark: SparkSession, d: str) -> DataFrame:
    """Ids of token files as a vocabulary with gaps."""
    vocab = table(spark, d, "token_files").where("file_id % 3 <> 1").select(F.col("file_id").cast("bigint").alias("id"), F.when(F.col("file_id") % 5 == 0, F.concat(F.lit("<|t"), F.col("file_id").cast("string"), F.lit("|>"))).otherwise(F.concat(F.lit("t"), F.col("file_id").cast("string"))).alias("token"))
    return MD.densified(vocab, table(spark, d, "token_files").agg(F.max("file_id")).scalar())


def config_checks(spark: SparkSession, d: str) -> DataFrame:
    """Divisibility checks and derived sizes of each preset."""
    c = MD.presets(spark)
    return c.select(
        "preset", (F.col("heads") * F.col("head_dim")).alias("q_dim"), (F.col("kv_heads") * F.col("head_dim")).alias("kv_dim"), (F.col("heads") % F.col("kv_heads") == 0).alias("groups_ok"),
        (F.col("head_dim") % 2 == 0).alias("rope_ok"), F.least(F.lit(8192), F.lit(4096)).cast("bigint").alias("kv_window"), (2 + F.col("layers") * 9).alias("n_tensors"),
    )


def inferred_config(spark: SparkSession, d: str) -> DataFrame:
    """Configurations back from the tensors."""
    out = conversion.infer_config(MD.expected_tensors(MD.presets(spark)))
    return out.select("preset", "n_layer", "width", "vocab", "q_dim", "kv_dim", "n_ff", "tied", "has_bias", "fused", "n_unmatched")


def compatibility_report(spark: SparkSession, d: str) -> DataFrame:
    """What hinders the conversion of the damaged tensors."""
    report = conversion.compatibility(conversion.infer_config(_damaged(MD.expected_tensors(MD.presets(spark)))))
    return report.select("preset", F.array_join("mechanical", ",").alias("mechanical"), F.array_join("blocking", ",").alias("blocking"))


def detect_report(spark: SparkSession, d: str) -> DataFrame:
    return conversion.detect_report(MD.classify(_damaged(MD.expected_tensors(MD.presets(spark)))), "preset")


def missing_roles(spark: SparkSession, d: str) -> DataFrame:
    """Required roles that the smallest model's damaged tensors have lost."""
    out = conversion.missing_roles(MD.classify(_damaged(MD.expected_tensors(MD.presets(spark))).where("name not like '%ffn_down%'")), "preset", ("token_embd", "attn_q", "ffn_gate", "ffn_down"))
    return out.select("preset", F.array_join("missing", ",").alias("missing"))


def file_defaults(spark: SparkSession, d: str) -> DataFrame:
    """Fields of each token file's header by the first key present, with overrides."""
    kv = F.create_map(F.lit("tokenizer"), F.nullif(F.trim(F.col("tokenizer_source")), F.lit("")), F.lit("typecode"), F.col("id_typecode"))
    files = table(spark, d, "token_files").select("file_id", F.map_filter(kv, lambda k, v: v.isNotNull()).alias("kv"))
    return files.select("file_id", conversion.first_present(F.col("kv"), "tokenizer", "typecode").alias("first"), F.coalesce(conversion.first_present(F.col("kv"), "typecode"), F.lit("H")).alias("typecode"))


def _values(rows: tuple, names: str) -> str:
    return "(VALUES " + ", ".join("(" + ", ".join(f"'{x}'" if isinstance(x, str) else f"{x}::BIGINT" for x in r) + ")" for r in rows) + f") t({names})"


_P = f"presets AS (SELECT * FROM {_values(MD.PRESETS, 'preset, vocab, width, layers, heads, kv_heads, head_dim, ff')})"
_LAYERS = ", ".join(f"({i}, '{n}')" for i, n in enumerate(MD.LAYER_TENSORS))
_X = f"""{_P}, layer AS (SELECT preset, l.i AS layer, n.i AS k, n.n, width, heads * head_dim AS q, kv_heads * head_dim AS kv, ff
    FROM presets, (SELECT unnest(range(0, 100)) AS i) l, (VALUES {_LAYERS}) n(i, n) WHERE l.i < layers),
  expected AS (SELECT preset, 0::BIGINT AS ord, 'token_embd.weight' AS name, width AS ne0, vocab AS ne1 FROM presets UNION ALL SELECT preset, 1, 'output_norm.weight', width, 1 FROM presets
    UNION ALL SELECT preset, 2 + layer * 9 + k, 'blk.' || layer || '.' || n || '.weight', CASE n WHEN 'attn_output' THEN q WHEN 'ffn_down' THEN ff ELSE width END,
      CASE n WHEN 'attn_norm' THEN 1 WHEN 'ffn_norm' THEN 1 WHEN 'attn_q' THEN q WHEN 'attn_k' THEN kv WHEN 'attn_v' THEN kv WHEN 'ffn_gate' THEN ff WHEN 'ffn_up' THEN ff ELSE width END FROM layer)"""
_D = f"""{_X}, kept AS (SELECT preset, ord, name, ne0, CASE WHEN ord % 13 = 5 THEN ne1 + 1 ELSE ne1 END AS ne1 FROM expected WHERE ord % 11 <> 3),
  damaged AS (SELECT * FROM kept UNION ALL SELECT preset, ord, 'extra.weight', ne0, ne1 FROM kept WHERE ord = 0)"""
_S = f"types AS (SELECT * FROM {_values(MD.STORAGE, 'qtype, type_name, per, size')})"
_R = "roles AS (SELECT * FROM (VALUES " + ", ".join(f"('{x}', '{r}', 'layer')" for r, *ns in MD.LAYER_ROLES for x in ns if x != "-") + ", " + ", ".join(f"('{x}', '{r}', 'global')" for r, *ns in MD.GLOBAL_ROLES for x in ns) + ") t(suffix, role, scope))"


def _classified(source: str) -> str:
    p = r"^(?:blk|model\.layers)\.(\d+)\."
    return f"""{_R}, named AS (SELECT *, regexp_replace(name, '{p}', '') AS rest, CASE WHEN regexp_matches(name, '{p}') THEN 'layer' ELSE 'global' END AS scope, nullif(regexp_extract(name, '{p}', 1), '')::BIGINT AS l FROM {source}),
  classified AS (SELECT n.* EXCLUDE (rest, scope, l), coalesce(r.role, 'other') AS role, CASE WHEN r.role IS NOT NULL THEN l END AS layer FROM named n LEFT JOIN roles r ON r.suffix = n.rest AND r.scope = n.scope)"""


QUERIES = {
    "tensor_manifest": (tensor_manifest, f"WITH {_X} SELECT * FROM expected"),
    "tensor_offsets": (tensor_offsets, f"""WITH {_X}, n AS (SELECT *, ne0 * ne1 AS elements, CASE WHEN ne1 > 1 THEN ne0 * ne1 // 32 * 18 ELSE ne0 * ne1 * 4 END AS nbytes FROM expected)
        SELECT *, coalesce(sum(nbytes) OVER (PARTITION BY preset ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS "offset" FROM n"""),
    "tensor_nbytes": (tensor_nbytes, f"WITH {_S} SELECT qtype::INT AS qtype, type_name, 1000 // per * size AS of_1000, 3216448 // per * size AS of_vocab FROM types"),
    "parameter_counts": (parameter_counts, f"WITH {_X} SELECT preset, sum(ne0 * ne1)::BIGINT AS n_parameters, count(*)::BIGINT AS n_tensors FROM expected GROUP BY preset"),
    "tensor_validation": (tensor_validation, f"""WITH {_D}, j AS (SELECT coalesce(e.preset, p.preset) AS preset, coalesce(e.name, p.name) AS name,
        CASE WHEN p.name IS NULL THEN 'missing' WHEN e.name IS NULL THEN 'unknown' WHEN e.ne0 <> p.ne0 OR e.ne1 <> p.ne1 THEN 'shape' END AS problem
        FROM expected e FULL JOIN damaged p ON p.preset = e.preset AND p.name = e.name) SELECT * FROM j WHERE problem IS NOT NULL"""),
    "tensor_role_classify": (tensor_role_classify, f"""WITH {_X}, names AS (SELECT preset, name FROM expected UNION SELECT preset, replace(replace(name, 'blk.', 'model.layers.'), 'attn_q.', 'self_attn.q_proj.') FROM expected),
        {_classified("names")} SELECT preset, name, role, layer FROM classified"""),
    "shape_votes": (shape_votes, f"""WITH {_D}, big AS (SELECT * FROM damaged WHERE preset = '4b'), {_classified("big")}, c AS (SELECT role, ne1, count(*)::BIGINT AS votes, min(layer) AS f FROM classified WHERE layer IS NOT NULL GROUP BY role, ne1)
        SELECT role, ne1, votes FROM c QUALIFY row_number() OVER (PARTITION BY role ORDER BY votes DESC, f) = 1"""),
    "retention_keep3": (retention_keep3, """WITH n AS (SELECT 'ckpt_step' || lpad(file_id::VARCHAR, 8, '0') || '.pt' AS name FROM token_files UNION ALL SELECT 'ckpt_best.pt')
        SELECT name, NOT regexp_matches(name, '[0-9]') OR row_number() OVER (PARTITION BY regexp_matches(name, '[0-9]') ORDER BY name DESC) <= 3 AS kept FROM n"""),
    "vocab_densify": (vocab_densify, """WITH v AS (SELECT file_id::BIGINT AS id, CASE WHEN file_id % 5 = 0 THEN '<|t' || file_id || '|>' ELSE 't' || file_id END AS token FROM token_files WHERE file_id % 3 <> 1),
        i AS (SELECT unnest(range(0, (SELECT max(file_id) + 1 FROM token_files))) AS id)
        SELECT i.id, coalesce(token, '[UNUSED' || i.id || ']') AS token, CASE WHEN token IS NULL THEN 'UNUSED' WHEN token LIKE '<|%' THEN 'CONTROL' ELSE 'NORMAL' END AS kind FROM i LEFT JOIN v ON v.id = i.id"""),
    "inferred_config": (inferred_config, f"WITH {_P} SELECT preset, layers AS n_layer, width, vocab, heads * head_dim AS q_dim, kv_heads * head_dim AS kv_dim, ff AS n_ff, true AS tied, false AS has_bias, false AS fused, 0::BIGINT AS n_unmatched FROM presets"),
    "compatibility_report": (compatibility_report, f"""WITH {_D}, {_classified("damaged")}, c AS (SELECT preset, role, ne1, count(*) AS n, min(layer) AS f FROM classified WHERE role IN ('attn_q', 'attn_k') GROUP BY ALL),
        v AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY preset, role ORDER BY n DESC, f) = 1), g AS (SELECT preset, max(ne1) FILTER (role = 'attn_q') AS q, max(ne1) FILTER (role = 'attn_k') AS k FROM v GROUP BY preset)
        SELECT preset, '' AS mechanical, CASE WHEN q % k <> 0 THEN 'unmatched,groups' ELSE 'unmatched' END AS blocking FROM g"""),
    "detect_report": (detect_report, f"""WITH {_D}, {_classified("damaged")} SELECT preset, role, count(*)::BIGINT AS n, min(layer) AS first_layer, max(layer) AS last_layer FROM classified GROUP BY preset, role"""),
    "missing_roles": (missing_roles, f"""WITH {_D}, few AS (SELECT * FROM damaged WHERE name NOT LIKE '%ffn_down%'), {_classified("few")}, r AS (SELECT preset, list(DISTINCT role) AS roles FROM classified GROUP BY preset)
        SELECT preset, array_to_string(list_filter(['token_embd', 'attn_q', 'ffn_gate', 'ffn_down'], lambda x: NOT list_contains(roles, x)), ',') AS missing FROM r"""),
    "file_defaults": (file_defaults, "SELECT file_id, coalesce(nullif(trim(tokenizer_source), ''), id_typecode) AS first, coalesce(id_typecode, 'H') AS typecode FROM token_files"),
    "config_checks": (config_checks, f"""WITH {_P} SELECT preset, heads * head_dim AS q_dim, kv_heads * head_dim AS kv_dim, heads % kv_heads = 0 AS groups_ok, head_dim % 2 = 0 AS rope_ok, 4096::BIGINT AS kv_window, 2 + layers * 9 AS n_tensors FROM presets"""),
}
