"""Queries through user-defined parts: tokenizer, token files, containers, block formats, streams."""

from __future__ import annotations

import json
import os

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import bpe, quant, text as T, vectors as V
from ..operators import messages as M, metadata as MD, records as R, validation
from ..session import local_path, run_to_end, work_folder
from ..sources import containers, jsonl, tokbin
from ..streaming import stateful
from .corpus import _NORMAL, RECORD, SQL_RECORDS, _normal, sql_pretokens, table
from .numeric import _E, _vectors

#: Where the vocabulary files of public tokenizers lie.
TOKENIZER_DIR = "/opt/tokenizers"


def bpe_encode(spark: SparkSession, d: str) -> DataFrame:
    ids = bpe.encode_documents(table(spark, d, "documents"), "doc_id", "text", f"{TOKENIZER_DIR}/byte_bpe_50k.json")
    return ids.select("doc_id", F.size("ids").cast("bigint").alias("n_tokens"), F.md5(F.array_join("ids", ",")).alias("ids_md5"))


def tokbin_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    """Token records of conversations (bytes as ids) written as packed token files and read again, record by record."""
    spark.dataSource.register(tokbin.TokBinSource)
    folder = local_path(work_folder(spark, "tokbin"))
    records = R.chat_records(_normal(spark, d), RECORD, "", "bytes")
    records.select("ids", "mask", "is_answer").write.format("tokbin").option("vocab_ceiling", 259).option("tokenizer_source", "bytes").mode("overwrite").save(folder)
    back = spark.read.format("tokbin").option("split", 1 << 20).load(folder)
    return back.select(F.size("ids").cast("bigint").alias("n"), F.md5(R.hex_text(F.col("ids"))).alias("ids_md5"), F.md5(F.array_join("mask", "")).alias("mask_md5"), F.md5(F.array_join("is_answer", "")).alias("answer_md5"))


def _containers(spark: SparkSession) -> str:
    """A folder with one small container of each kind; its tensors follow from the smallest preset."""
    folder = local_path(work_folder(spark, "containers"))
    os.makedirs(f"{folder}/gguf"), os.makedirs(f"{folder}/poscon")
    name, vocab, width, layers, heads, kv, head, ff = ("mini", 512, 64, 2, 4, 2, 16, 128)
    config = {"format_version": 1, "spec_version": 1, "n_vocab": vocab, "n_embd": width, "n_layer": layers, "n_head": heads, "n_kv_head": kv, "head_dim": head, "n_ff": ff, "ctx_len": 256,
              "rope_base": 10000.0, "rope_scale": 1.0, "rope_dim_count": head, "norm_eps": 1e-5, "flags": containers.HAS_GATE, "alignment": 32}
    slots = containers.positional_slots(config)
    data = [np.zeros(int(np.prod(shape)), np.float32).tobytes() for _, shape in slots]
    containers.write_positional(f"{folder}/poscon/model.bin", config, json.dumps({"name": name}), json.dumps({"tokens": [], "merges": []}), data, [0] * len(slots))
    keys = [("general.architecture", 8, "decoder"), ("decoder.block_count", 4, layers), ("tokenizer.tokens", 9, (8, ["a", "b"]))]
    containers.write_gguf(f"{folder}/gguf/model.gguf", keys, [(n, s, 0, raw) for (n, s), raw in zip(slots, data)])
    return folder


def gguf_scan(spark: SparkSession, d: str) -> DataFrame:
    spark.dataSource.register(containers.GgufSource)
    rows = spark.read.format("gguf").load(f"{_containers(spark)}/gguf")
    return rows.select("kind", "ord", "name", F.array_join("shape", "x").alias("shape"), "qtype", "nbytes")


def positional_scan(spark: SparkSession, d: str) -> DataFrame:
    spark.dataSource.register(containers.PositionalSource)
    rows = spark.read.format("poscon").load(f"{_containers(spark)}/poscon")
    return rows.select("kind", "ord", "name", F.array_join("shape", "x").alias("shape"), "qtype", "nbytes")


def container_validation(spark: SparkSession, d: str) -> DataFrame:
    """Tensors of both containers against each other, with byte sizes against shapes; no rows if all is well."""
    a, b = gguf_scan(spark, d).where("kind = 'tensor'"), positional_scan(spark, d).where("kind = 'tensor'")
    sized = a.unionByName(b).withColumn("n", F.aggregate(F.split("shape", "x").cast("array<bigint>"), F.lit(1).cast("bigint"), lambda x, y: x * y))
    wrong = sized.where(MD.byte_size(F.col("n"), F.col("qtype")) != F.col("nbytes")).select("name", F.lit("size").alias("problem"))
    missing = a.select("name").exceptAll(b.select("name")).unionByName(b.select("name").exceptAll(a.select("name"))).withColumn("problem", F.lit("missing"))
    return wrong.unionByName(missing)


def _fixture(path: str, drop: str = "", tensor: str = "", **change: object) -> None:
    """A small sound container, but for a key or tensor that is left out, a key of another value, or ``shape`` of its first matrix."""
    values = {"general.architecture": (8, "decoder"), "decoder.spec_version": (4, 1), "decoder.embedding_length": (4, 8), "decoder.block_count": (4, 1), "decoder.attention.head_count": (4, 4),
              "decoder.attention.head_count_kv": (4, 2), "decoder.attention.key_length": (4, 2), "decoder.feed_forward_length": (4, 16), "decoder.context_length": (4, 64), "tokenizer.tokens": (9, (8, ["a", "b", "c"]))}
    shapes = {"token_embd.weight": [8, 3], "output_norm.weight": [8], "blk.0.attn_norm.weight": [8], "blk.0.attn_q.weight": [8, 8], "blk.0.attn_k.weight": [8, 4], "blk.0.attn_v.weight": [8, 4],
              "blk.0.attn_output.weight": [8, 8], "blk.0.ffn_norm.weight": [8], "blk.0.ffn_gate.weight": [8, 16], "blk.0.ffn_up.weight": [8, 16], "blk.0.ffn_down.weight": [16, 8], "output.weight": [8, 3]}
    keys = [(n, k, change.get(n, v)) for n, (k, v) in values.items() if n != drop]
    tensors = [(n, [s[0], s[1] + 1] if n == change.get("shape") else s) for n, s in shapes.items() if n != tensor] + ([("extra.weight", [4])] if change.get("extra") else [])
    containers.write_gguf(path, keys, [(n, s, 0, bytes(4 * int(np.prod(s)))) for n, s in tensors])


def container_problems(spark: SparkSession, d: str) -> DataFrame:
    """Problems of a folder with two sound files and nine broken ones, scanned and checked as relations."""
    spark.dataSource.register(containers.GgufSource)
    folder = local_path(work_folder(spark, "problems"))
    os.makedirs(folder)
    _fixture(f"{folder}/sound.gguf")
    _fixture(f"{folder}/tied.gguf", tensor="output.weight")
    _fixture(f"{folder}/arch.gguf", **{"general.architecture": "other"})
    _fixture(f"{folder}/spec.gguf", **{"decoder.spec_version": 2})
    _fixture(f"{folder}/nokey.gguf", drop="decoder.context_length")
    _fixture(f"{folder}/groups.gguf", **{"decoder.attention.head_count_kv": 3})
    _fixture(f"{folder}/missing.gguf", tensor="blk.0.ffn_up.weight")
    _fixture(f"{folder}/shape.gguf", shape="blk.0.attn_q.weight")
    _fixture(f"{folder}/extra.gguf", extra=True)
    _fixture(f"{folder}/vocab.gguf", **{"tokenizer.tokens": (8, ["a", "b"])})
    with open(f"{folder}/sound.gguf", "rb") as f, open(f"{folder}/torn.gguf", "wb") as g:
        g.write(f.read(700))
    rows = spark.read.format("gguf").option("mode", "permissive").load(folder)
    out = validation.container_problems(rows)
    return out.select(F.regexp_extract("file", r"([^/]+)\.gguf$", 1).alias("file"), "problem", F.when(F.col("problem") == "unreadable", None).otherwise(F.col("name")).alias("name"))


def _byte(at: F.Column) -> F.Column:
    """The byte at a place of the column ``raw``, from its hex form ``h``."""
    return F.conv(F.substring("h", at * 2 + 1, F.lit(2)), 16, 10).cast("int")


def q8_blocks(spark: SparkSession, d: str) -> DataFrame:
    """Codes of each vector's Q8_0 blocks, read from the bytes."""
    e = _vectors(spark, d).select("vec_id", F.hex(quant.q8_0_block(F.col("v"))).alias("h")).where("h is not null")
    e = e.select("vec_id", "h", F.explode(F.sequence(F.lit(0), (F.length("h") / 68).cast("int") - 1)).alias("block"))
    codes = F.transform(F.sequence(F.lit(0), F.lit(31)), lambda i: _byte(F.col("block") * 34 + 2 + i))
    return e.select("vec_id", F.col("block").cast("bigint").alias("block"), F.array_join(F.transform(codes, lambda c: F.when(c > 127, c - 256).otherwise(c)), ",").alias("codes"))


def q4_blocks(spark: SparkSession, d: str) -> DataFrame:
    """Codes of each vector's Q4_0 blocks, read from the bytes: low nibbles first."""
    e = _vectors(spark, d).select("vec_id", F.hex(quant.q4_0_block(F.col("v"))).alias("h")).where("h is not null")
    e = e.select("vec_id", "h", F.explode(F.sequence(F.lit(0), (F.length("h") / 36).cast("int") - 1)).alias("block"))
    raw = F.transform(F.sequence(F.lit(0), F.lit(15)), lambda i: _byte(F.col("block") * 18 + 2 + i))
    codes = F.concat(F.transform(raw, lambda c: c % 16), F.transform(raw, lambda c: F.shiftright(c, 4)))
    return e.select("vec_id", F.col("block").cast("bigint").alias("block"), F.array_join(codes, ",").alias("codes"))


def q4_fused_dot(spark: SparkSession, d: str) -> DataFrame:
    """Integer product of Q4_0 and Q8_0 blocks against the product of the decoded vectors."""
    e = _vectors(spark, d).select("vec_id", quant.q4_0_block(F.col("v")).alias("w"), quant.q8_0_block(F.reverse("v")).alias("a"))
    e = e.select("vec_id", quant.fused(F.col("w"), F.col("a")).alias("fused"), quant.dequantized(F.col("w"), F.lit(2)).alias("x"), quant.dequantized(F.col("a"), F.lit(8)).alias("y"))
    return e.select("vec_id", (F.abs(F.col("fused") - V.dot(V.doubles(F.col("x")), V.doubles(F.col("y")))) < 1e-3).alias("agrees"))


def jsonl_status(spark: SparkSession, d: str) -> DataFrame:
    """Messages as JSON lines of conversations, parsed again: lines and usable messages by status."""
    lines = M.delivered_once(table(spark, d, "messages")).groupBy("conv_id").agg(F.to_json(F.struct(F.array_sort(F.collect_list(F.struct("turn", "msg_id", "role", "content"))).alias("messages"))).alias("value"))
    # every tenth line comes again with something behind it, and once as white space only
    odd = lines.where("conv_id % 10 = 0").select(F.col("conv_id"), F.explode(F.array(F.concat("value", F.lit(" tail")), F.lit("\t\u00a0 "))).alias("value"))
    parsed = jsonl.parse_lines(lines.unionByName(odd))
    return parsed.groupBy("status").agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.size("messages").cast("bigint")), F.lit(0)).alias("n_messages"))


def payload_prompts(spark: SparkSession, d: str) -> DataFrame:
    """Requests made of user messages: as an object with a prompt, as one with messages, and as plain text."""
    c, kind = F.col("content"), F.col("msg_id") % 3
    as_prompt = F.to_json(F.struct(c.alias("prompt")))
    as_messages = F.to_json(F.struct(F.array(F.struct(F.lit("user").alias("role"), c.alias("content")), F.struct(F.lit("tool").alias("role"), F.lit("x").alias("content"))).alias("messages")))
    plain = F.concat(F.lit("> "), c)
    payload = F.when(kind == 0, as_prompt).when(kind == 1, as_messages).otherwise(plain)
    return _normal(spark, d).where("role = 'user'").select("msg_id", F.md5(jsonl.payload_prompt(payload)).alias("prompt_md5"))


def byte_alphabet(spark: SparkSession, d: str) -> DataFrame:
    """The character that stands for each byte in byte-level vocabularies."""
    return spark.createDataFrame([(b, ord(c)) for b, c in bpe.byte_alphabet().items()], "byte int, code_point int")


def source_manifests(spark: SparkSession, d: str) -> DataFrame:
    """A nested JSON card for each source; missing values stay as null."""
    card = F.to_json(F.struct(F.struct("source_id", "source_name").alias("source"), F.struct(F.col("domain"), F.col("token_target").alias("budget")).alias("mix")), {"ignoreNullFields": "false"})
    return table(spark, d, "sources").select("source_id", card.alias("manifest"))


def _stream(spark: SparkSession, d: str, name: str) -> DataFrame:
    # a pattern, as a stream takes a plain path for a folder and the table may be one file
    return spark.readStream.schema(spark.read.parquet(f"{d}/{name}.parquet").schema).parquet(f"{d}/{name}.parque[t]")


def stream_prefix_reuse(spark: SparkSession, d: str) -> DataFrame:
    """``longest_common_prefix`` over a stream of user messages; repeated deliveries are dropped in the stream."""
    s = _stream(spark, d, "messages").where(F.col("role").isin("user", "human") & (F.coalesce("content", F.lit("")) != ""))
    s = s.dropDuplicates(["msg_id"]).select("conv_id", (F.col("turn") * F.lit(1 << 40).cast("bigint") + F.col("msg_id")).alias("place"), T.pretokenize(F.col("content")).alias("ids"))
    folder = work_folder(spark, "reuse")
    run_to_end(stateful.prefix_reuse(s, "conv_id", "place", "ids"), folder)
    out = spark.read.parquet(folder).withColumn("msg_id", F.col("place") % (1 << 40))
    return out.select("msg_id", "matched", "reused")


def stream_context_windows(spark: SparkSession, d: str) -> DataFrame:
    """Evictions of a 256-token window per conversation over a stream of messages."""
    s = _stream(spark, d, "messages").where("content is not null").dropDuplicates(["msg_id"])
    s = s.select("conv_id", (F.col("turn") * F.lit(1 << 40).cast("bigint") + F.col("msg_id")).alias("place"), T.pretoken_count(F.col("content")).alias("n"))
    folder = work_folder(spark, "windows")
    run_to_end(stateful.context_windows(s, "conv_id", "place", "n", 256), folder)
    return spark.read.parquet(folder).select((F.col("place") % (1 << 40)).alias("msg_id"), "evicted", "length")


def stream_event_windows(spark: SparkSession, d: str) -> DataFrame:
    """Events of a stream by day and type, with a watermark of 40 days for late ones."""
    s = _stream(spark, d, "events").withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", "40 days")
    counts = s.groupBy(F.window("at", "1 day"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"))
    folder = work_folder(spark, "days")
    query = (
        counts.writeStream.foreachBatch(lambda rows, _: rows.write.mode("overwrite").parquet(folder)).option("checkpointLocation", f"{folder}-state")
        .outputMode("complete").trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return spark.read.parquet(folder).select(F.date_format("window.start", "yyyy-MM-dd").alias("day"), "event_type", "n", "total")


_WINDOWS = f"""m AS (SELECT DISTINCT msg_id, conv_id, turn, content FROM messages WHERE content IS NOT NULL), c AS (SELECT msg_id, conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn, msg_id) AS rn, len({sql_pretokens("content")})::BIGINT AS n FROM m),
  f AS (SELECT conv_id, rn, msg_id, 0::BIGINT AS evicted, least(n, 256) AS length FROM c WHERE rn = 1
    UNION ALL SELECT c.conv_id, c.rn, c.msg_id, CASE WHEN f.length + least(c.n, 256 - least(4, f.length)) > 256 THEN least(f.length - least(4, f.length), f.length + least(c.n, 256 - least(4, f.length)) - 256 + 64) ELSE 0 END,
      f.length + least(c.n, 256 - least(4, f.length)) - CASE WHEN f.length + least(c.n, 256 - least(4, f.length)) > 256 THEN least(f.length - least(4, f.length), f.length + least(c.n, 256 - least(4, f.length)) - 256 + 64) ELSE 0 END
    FROM f JOIN c ON c.conv_id = f.conv_id AND c.rn = f.rn + 1)"""

_SLOTS = containers.positional_slots({"n_vocab": 512, "n_embd": 64, "n_layer": 2, "n_head": 4, "n_kv_head": 2, "head_dim": 16, "n_ff": 128, "flags": containers.HAS_GATE})
_SLOT_ROWS = ", ".join(f"('tensor', {i}::BIGINT, '{n}', '{'x'.join(map(str, s))}', 0, {4 * int(np.prod(s))}::BIGINT)" for i, (n, s) in enumerate(_SLOTS))


#: Blocks of 32 single-precision values of each vector.
_BLOCK = """r AS (SELECT vec_id, embedding AS v, unnest(range(0, len(embedding) // 32)) AS block FROM embeddings), b AS (SELECT vec_id, block, v[block * 32 + 1 : block * 32 + 32] AS x FROM r)"""


def _catalogue() -> dict:
    from .corpus import QUERIES as corpus

    return {
        "bpe_encode": (bpe_encode, None),
        "tokbin_roundtrip": (tokbin_roundtrip, f"WITH {SQL_RECORDS} SELECT n, md5(ids) AS ids_md5, md5(mask) AS mask_md5, md5(ans) AS answer_md5 FROM recs"),
        "gguf_scan": (gguf_scan, f"""SELECT * FROM (VALUES ('header', 0::BIGINT, 'version', NULL, NULL::INT, NULL::BIGINT), ('key', 0, 'general.architecture', NULL, NULL, NULL), ('key', 1, 'decoder.block_count', NULL, NULL, NULL),
            ('key', 2, 'tokenizer.tokens', NULL, NULL, NULL), {_SLOT_ROWS}) t(kind, ord, name, shape, qtype, nbytes)"""),
        "positional_scan": (positional_scan, "SELECT * FROM (VALUES " + ", ".join(f"('header', {i}::BIGINT, '{n}', NULL, NULL::INT, NULL::BIGINT)" for i, n in enumerate(containers.POSITIONAL_FIELDS[1:])) + f", ('key', 0, 'manifest', NULL, NULL, NULL), ('key', 1, 'tokenizer', NULL, NULL, NULL), {_SLOT_ROWS}) t(kind, ord, name, shape, qtype, nbytes)"),
        "container_validation": (container_validation, "SELECT '' AS name, '' AS problem WHERE false"),
        "container_problems": (container_problems, """SELECT * FROM (VALUES ('arch', 'architecture', 'other'), ('spec', 'spec_version', '2'), ('nokey', 'key', 'context_length'), ('groups', 'groups', NULL),
            ('groups', 'shape', 'blk.0.attn_k.weight'), ('groups', 'shape', 'blk.0.attn_v.weight'), ('missing', 'missing', 'blk.0.ffn_up.weight'), ('shape', 'shape', 'blk.0.attn_q.weight'), ('extra', 'unknown', 'extra.weight'),
            ('vocab', 'shape', 'token_embd.weight'), ('torn', 'unreadable', NULL)) t(file, problem, name)"""),
        "q8_blocks": (q8_blocks, f"""WITH {_BLOCK}, m AS (SELECT *, (list_max(list_transform(x, lambda y: abs(y))) / 127::FLOAT)::FLOAT AS s FROM b)
            SELECT vec_id, block, array_to_string(list_transform(x, lambda y: CASE WHEN s = 0 THEN 0 ELSE (sign(y) * floor((abs(y) / s)::FLOAT + 0.5::FLOAT))::INT END), ',') AS codes FROM m"""),
        "q4_blocks": (q4_blocks, f"""WITH {_BLOCK}, m AS (SELECT *, (x[list_position(list_transform(x, lambda y: abs(y)), list_max(list_transform(x, lambda y: abs(y))))] / -8::FLOAT)::FLOAT AS s FROM b)
            SELECT vec_id, block, array_to_string(list_transform(x, lambda y: CASE WHEN s = 0 THEN 8 ELSE floor(greatest(0::FLOAT, least(15::FLOAT, ((y / s)::FLOAT + 8.5::FLOAT)::FLOAT)))::INT END), ',') AS codes FROM m"""),
        "q4_fused_dot": (q4_fused_dot, "SELECT vec_id, true AS agrees FROM embeddings"),
        "jsonl_status": (jsonl_status, f"""WITH {_NORMAL}, n AS (SELECT c.conv_id, count(normal.msg_id) AS k FROM (SELECT DISTINCT conv_id FROM messages) c LEFT JOIN normal ON normal.conv_id = c.conv_id GROUP BY c.conv_id)
            SELECT CASE WHEN k > 0 THEN 'ok' ELSE 'empty' END AS status, count(*)::BIGINT AS n, sum(k)::BIGINT AS n_messages FROM n GROUP BY 1
            UNION ALL SELECT 'malformed', count(*), 0 FROM n WHERE conv_id % 10 = 0 HAVING count(*) > 0 UNION ALL SELECT 'blank', count(*), 0 FROM n WHERE conv_id % 10 = 0 HAVING count(*) > 0"""),
        "payload_prompts": (payload_prompts, f"""WITH {_NORMAL} SELECT msg_id, md5(CASE msg_id % 3 WHEN 0 THEN content WHEN 1 THEN '<|user|>' || content || '<|end|><|assistant|>' ELSE '> ' || content END) AS prompt_md5
            FROM normal WHERE role = 'user'"""),
        "byte_alphabet": (byte_alphabet, """WITH b AS (SELECT unnest(range(256))::INT AS byte), k AS (SELECT byte, byte BETWEEN 33 AND 126 OR byte BETWEEN 161 AND 172 OR byte BETWEEN 174 AND 255 AS shown FROM b)
            SELECT byte, (CASE WHEN shown THEN byte ELSE 255 + row_number() OVER (PARTITION BY shown ORDER BY byte) END)::INT AS code_point FROM k"""),
        "source_manifests": (source_manifests, "SELECT source_id, json_object('source', json_object('source_id', source_id, 'source_name', source_name), 'mix', json_object('domain', domain, 'budget', token_target))::VARCHAR AS manifest FROM sources"),
        "stream_prefix_reuse": (stream_prefix_reuse, corpus["longest_common_prefix"][1].replace("WHERE before IS NOT NULL", "").replace("coalesce(list_min", "CASE WHEN before IS NULL THEN 0 ELSE coalesce(list_min").replace("+ 1) - 1 AS matched", "+ 1) - 1 END AS matched")),
        "stream_context_windows": (stream_context_windows, f"WITH RECURSIVE {_WINDOWS} SELECT msg_id, evicted, length FROM f"),
        "stream_event_windows": (stream_event_windows, "SELECT strftime(ts, '%Y-%m-%d') AS day, event_type, count(*)::BIGINT AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2"),
    }


QUERIES = _catalogue()
