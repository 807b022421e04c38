"""Queries over token records with real ids, attention by heads, gathers and split metrics, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import bpe, encoders, text as T, vectors as V
from ..operators import context, conversion, metrics, packing, records as R
from ..sources import jsonl
from .corpus import _BLANK, _NORMAL, RECORD, SQL_RECORDS as _SEGS, _normal, sql_pretokens, table
from .engine import TOKENIZER_DIR
from .numeric import _E, DIM, _vectors, sql_dot

#: Length of a packed row in tokens, and the id that pads.
ROW, PAD = 4096, 256
BPE = f"{TOKENIZER_DIR}/byte_bpe_50k"


def _records(spark: SparkSession, d: str) -> DataFrame:
    return R.chat_records(_normal(spark, d), RECORD, "", "bytes")


def _shown(rows: DataFrame, *key: str) -> DataFrame:
    return rows.select(*key, F.size("ids").cast("bigint").alias("n"), F.md5(R.hex_text(F.col("ids"))).alias("ids_md5"), F.md5(F.array_join("mask", "")).alias("mask_md5"), F.md5(F.array_join("is_answer", "")).alias("answer_md5"))


def chat_records(spark: SparkSession, d: str) -> DataFrame:
    """Conversations as token records after the crop: ids (bytes), loss mask and answer mask, token by token."""
    return _shown(_records(spark, d), "conv_id")


def chat_records_bpe(spark: SparkSession, d: str) -> DataFrame:
    """The same under byte_bpe_50k."""
    return _shown(R.chat_records(_normal(spark, d), RECORD, BPE), "conv_id")


def chunk_records(spark: SparkSession, d: str) -> DataFrame:
    return _shown(R.chunk_records(table(spark, d, "documents"), "doc_id", "text", "", "bytes"), "doc_id", "chunk")


def packed_record_rows(spark: SparkSession, d: str) -> DataFrame:
    """Records packed into rows of 4,096 tokens, padded, with labels and attention."""
    from ..session import kept

    rows = packing.packed_rows(kept(_records(spark, d)), "conv_id", ROW, PAD)
    labels = F.array_join(F.transform("labels", lambda x: F.when(x == -100, "----").otherwise(F.lpad(F.hex(x), 4, "0"))), "")
    return rows.select("shard", "bin", F.col("n_sequences").cast("bigint").alias("n_sequences"), F.md5(R.hex_text(F.col("input_ids"))).alias("ids_md5"), F.md5(labels).alias("labels_md5"),
                       F.aggregate("attention_mask", F.lit(0).cast("bigint"), lambda a, x: a + x).alias("n_tokens"), F.size("is_answer").cast("bigint").alias("width"))


def decode_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    """Documents encoded by the published tokenizer and decoded by the vocabulary here."""
    ids = encoders.encoded(table(spark, d, "documents").select("doc_id", "text"), {"text": "ids"}, BPE)
    return bpe.decode_documents(ids, "doc_id", "ids", f"{BPE}.json").select("doc_id", F.md5("text").alias("text_md5"))


def used_ids(spark: SparkSession, d: str) -> DataFrame:
    ids = encoders.encoded(table(spark, d, "documents").select("doc_id", "text"), {"text": "ids"}, "", "bytes")
    return R.used_ids(ids, [256, 257, 258])


def embedding_bag(spark: SparkSession, d: str) -> DataFrame:
    """For each source the embedding rows of its documents' ids (bytes), gathered and averaged."""
    ids = encoders.encoded(table(spark, d, "documents").select("source", "text"), {"text": "ids"}, "", "bytes")
    counts = ids.select("source", F.explode("ids").alias("id")).groupBy("source", "id").agg(F.count(F.lit(1)).alias("n"))
    rows = _vectors(spark, d).select(F.col("vec_id").alias("id"), "v")
    out = counts.join(rows, "id").groupBy("source").agg(V.sum_of(F.col("v"), F.col("n"), DIM).alias("s"), F.sum("n").alias("n"))
    return out.select("source", "n", F.transform("s", lambda x: F.round(x / F.col("n"), 6) + F.lit(0.0)).alias("mean"))


HEADS, GROUPS = 4, 2


def grouped_attention(spark: SparkSession, d: str) -> DataFrame:
    """Causal attention of four query heads over two key-value heads, sequences of 16 vectors, all dimensions."""
    size = DIM // HEADS
    e = _vectors(spark, d).select(F.floor(F.col("vec_id") / 16).alias("seq"), (F.col("vec_id") % 16).alias("pos"), "v")
    heads = F.array(*[F.struct(F.lit(h).alias("h"), F.lit(h * GROUPS // HEADS).alias("g"), F.slice("v", h * size + 1, size).alias("q")) for h in range(HEADS)])
    groups = F.array(*[F.struct(F.lit(g).alias("g"), F.slice("v", g * size + 1, size).alias("k"), F.slice(F.reverse("v"), g * size + 1, size).alias("value")) for g in range(GROUPS)])
    q = e.select("seq", "pos", F.inline(heads))
    kv = e.select("seq", F.col("pos").alias("kpos"), F.inline(groups))
    pairs = q.join(kv, ["seq", "g"]).where("kpos <= pos").withColumn("s", V.dot(F.col("q"), F.col("k")) / F.lit(size**0.5))
    # scores of 16 dimensions are far from the range where the exponential overflows
    w = F.exp("s")
    out = pairs.groupBy("seq", "pos", "h").agg(V.sum_of(F.col("value"), w, size).alias("o"), F.sum(w).alias("z"))
    return out.select((F.col("seq") * 16 + F.col("pos")).alias("vec_id"), F.col("h").cast("int").alias("head"), F.transform("o", lambda x: F.round(x / F.col("z"), 6) + F.lit(0.0)).alias("out"))


def stored_matvec(spark: SparkSession, d: str) -> DataFrame:
    """A stored matrix (the first 8 vectors as its rows) times each vector; the matrix is one value of the plan."""
    e = _vectors(spark, d)
    matrix = e.where("vec_id < 8").agg(F.array_sort(F.collect_list(F.struct(F.col("vec_id").alias("row"), F.col("v").alias("w"))))).scalar()
    rows = e.select("vec_id", "v", F.explode(matrix).alias("m"))
    return rows.select("vec_id", F.col("m.row").alias("row"), F.round(V.dot(F.col("m.w"), F.col("v")), 6).alias("y"))


def fused_row_split(spark: SparkSession, d: str) -> DataFrame:
    """Vectors as rows of a fused matrix of 128 query, 64 key and 64 value rows."""
    e = _vectors(spark, d).select("vec_id")
    return conversion.row_parts(e, "vec_id", [("q", 128), ("k", 64), ("v", 64)]).select("vec_id", "part", "part_row")


def negligible_biases(spark: SparkSession, d: str) -> DataFrame:
    """Vectors scaled by their label, as biases: whether any is worth keeping."""
    scale = F.when(F.col("label") % 2 == 0, 1e-8).otherwise(1.0)
    return _vectors(spark, d).select("vec_id", conversion.negligible(F.transform("v", lambda x: x * scale)).alias("negligible"))


def storage_choices(spark: SparkSession, d: str) -> DataFrame:
    """Storage of made-up row lengths: block formats where rows are whole blocks."""
    n = F.col("file_id") * 16
    return table(spark, d, "token_files").select("file_id", conversion.storage_choice(n, F.lit(8), F.lit(32)).alias("q8"), conversion.storage_choice(n, F.lit(14), F.lit(256)).alias("q6k"))


def marker_subsets(spark: SparkSession, d: str) -> DataFrame:
    """Whether a token file's markers are all among the default ones, and the other way round."""
    default = F.split(F.lit("<|begin_of_solution|>,</think>,<|end_of_thought|>"), ",")
    return table(spark, d, "token_files").select("file_id", conversion.is_subset(F.col("think_end_markers"), default).alias("known"), conversion.is_subset(default, F.col("think_end_markers")).alias("complete"))


def eval_split(spark: SparkSession, d: str) -> DataFrame:
    """Events as token losses: batches of 30, purchases as answers; the first hundred batches."""
    rows = table(spark, d, "events").select(F.floor(F.col("event_id") / 30).alias("b"), "value", F.when(F.col("event_type") == "purchase", 1).otherwise(0).alias("a"))
    return metrics.split_eval(rows, "b", "value", "a", 100)


def log_split(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "events").select((F.col("event_id") + 1).alias("step"), "value", (F.col("event_id") % 7 + 1).alias("n"), F.when(F.col("event_type") == "purchase", 1).otherwise(0).alias("a"))
    return metrics.split_log_windows(rows, "step", "value", "n", "a")


_MARKS = ("hex('<|assistant|>')", "hex('<|end|>')")
_SIZE = DIM // HEADS

def request_responses(spark: SparkSession, d: str) -> DataFrame:
    """User messages as request lines, every seventh broken: what comes back, with the prompt's pretokens as tokens."""
    good = F.to_json(F.struct(F.col("content").alias("prompt")))
    lines = _normal(spark, d).where("role = 'user'").select("msg_id", F.when(F.col("msg_id") % 7 == 0, F.lit('{"prompt": ')).otherwise(good).alias("value"))
    out = jsonl.respond(lines, T.pretokenize)
    return out.select("msg_id", "status", F.size("responses").cast("bigint").alias("n_lines"), F.element_at("responses", -1).alias("last"))


def pinned_regions(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("event_id", context.pinned_status(F.col("event_id") * 37 % 4200, 4, 4096).alias("status"))


QUERIES = {
    "request_responses": (request_responses, f"""WITH {_NORMAL} SELECT msg_id, CASE WHEN msg_id % 7 = 0 THEN 'error' ELSE 'ok' END AS status, (CASE WHEN msg_id % 7 = 0 THEN 1 ELSE len({sql_pretokens("content")}) + 1 END)::BIGINT AS n_lines,
        CASE WHEN msg_id % 7 = 0 THEN '{{"error":"malformed request"}}' ELSE '{{"done":true}}' END AS last FROM normal WHERE role = 'user'"""),
    "pinned_regions": (pinned_regions, "SELECT event_id, CASE WHEN event_id * 37 % 4200 + 4 >= 4096 THEN 'error' WHEN event_id * 37 % 4200 * 5 > 4096 THEN 'warning' ELSE 'ok' END AS status FROM events"),
    "chat_records": (chat_records, f"WITH {_SEGS} SELECT conv_id, n, md5(ids) AS ids_md5, md5(mask) AS mask_md5, md5(ans) AS answer_md5 FROM recs"),
    "chat_records_bpe": (chat_records_bpe, None),
    "chunk_records": (chunk_records, f"""WITH t AS (SELECT doc_id, hex(text) AS h, strlen(text) AS n FROM documents WHERE {_BLANK}), s AS (SELECT *, unnest(range(0, n, 7800)) AS a FROM t),
        p AS (SELECT doc_id, a // 7800 AS chunk, {_MARKS[0]} || substr(h, 2 * a + 1, 15600) || {_MARKS[1]} AS x, least(7800, n - a) AS k FROM s WHERE least(7800, n - a) >= 64)
        SELECT doc_id, chunk, k + 13 + 7 AS n, md5(regexp_replace(x, '(..)', '00\\1', 'g')) AS ids_md5, md5(repeat('0', 13) || repeat('1', k + 7)) AS mask_md5, md5(repeat('0', 13) || repeat('1', k + 7)) AS answer_md5 FROM p"""),
    "packed_record_rows": (packed_record_rows, f"""WITH RECURSIVE {_SEGS}, k AS (SELECT *, md5('1234:' || conv_id) AS k FROM recs),
        items AS (SELECT *, ('0x' || substr(k, 1, 8))::BIGINT % greatest(1, ceil((SELECT count(*) FROM recs) / 4096.0))::BIGINT AS shard FROM k), ranked AS (SELECT *, row_number() OVER (PARTITION BY shard ORDER BY k, conv_id) AS rn FROM items),
        packed AS (SELECT shard, rn, conv_id, 0::BIGINT AS bin, n AS fill FROM ranked WHERE rn = 1
          UNION ALL SELECT r.shard, r.rn, r.conv_id, p.bin + CASE WHEN p.fill + r.n > {ROW} THEN 1 ELSE 0 END, CASE WHEN p.fill + r.n > {ROW} THEN r.n ELSE p.fill + r.n END FROM packed p JOIN ranked r ON r.shard = p.shard AND r.rn = p.rn + 1),
        rows AS (SELECT p.shard, p.bin, count(*)::BIGINT AS n_sequences, string_agg(r.ids, '' ORDER BY p.rn) AS ids, string_agg(r.labels, '' ORDER BY p.rn) AS labels, sum(r.n)::BIGINT AS t FROM packed p JOIN recs r ON r.conv_id = p.conv_id GROUP BY p.shard, p.bin)
        SELECT shard, bin, n_sequences, md5(ids || repeat('0100', {ROW} - t)) AS ids_md5, md5(labels || repeat('----', {ROW} - t)) AS labels_md5, t AS n_tokens, {ROW}::BIGINT AS width FROM rows"""),
    "decode_roundtrip": (decode_roundtrip, "SELECT doc_id, md5(coalesce(text, '')) AS text_md5 FROM documents"),
    "used_ids": (used_ids, """WITH b AS (SELECT unnest(regexp_extract_all(hex(text), '..')) AS x FROM documents), c AS (SELECT ('0x' || x)::INT AS id, count(*)::BIGINT AS n FROM b GROUP BY 1)
        SELECT id, n, false AS special FROM c UNION ALL SELECT unnest([256, 257, 258])::INT, 0, true"""),
    "embedding_bag": (embedding_bag, f"""WITH {_E}, b AS (SELECT source, unnest(regexp_extract_all(hex(text), '..')) AS x FROM documents), c AS (SELECT source, ('0x' || x)::BIGINT AS id, count(*) AS n FROM b GROUP BY ALL),
        u AS (SELECT c.source, c.n, unnest(e.v) AS x, generate_subscripts(e.v, 1) AS i FROM c JOIN e ON e.vec_id = c.id), m AS (SELECT source, i, sum(n)::BIGINT AS n, round(sum(n * x) / sum(n), 6) AS x FROM u GROUP BY source, i)
        SELECT source, any_value(n) AS n, list(x + 0.0 ORDER BY i) AS mean FROM m GROUP BY source"""),
    "grouped_attention": (grouped_attention, f"""WITH {_E}, s AS (SELECT vec_id // 16 AS seq, vec_id % 16 AS pos, v FROM e), q AS (SELECT seq, pos, v, unnest(range(0, {HEADS})) AS h FROM s),
        p AS (SELECT q.seq, q.pos, q.h, exp(list_sum(list_transform(range(1, {_SIZE + 1}), lambda i: q.v[q.h * {_SIZE} + i] * k.v[(q.h // {HEADS // GROUPS}) * {_SIZE} + i])) / sqrt({_SIZE})) AS w,
          list_reverse(k.v)[(q.h // {HEADS // GROUPS}) * {_SIZE} + 1 : (q.h // {HEADS // GROUPS} + 1) * {_SIZE}] AS x FROM q JOIN s k ON k.seq = q.seq AND k.pos <= q.pos),
        u AS (SELECT seq, pos, h, w, unnest(x) AS x, generate_subscripts(x, 1) AS i FROM p), o AS (SELECT seq, pos, h, i, round(sum(w * x) / sum(w), 6) AS o FROM u GROUP BY ALL)
        SELECT (seq * 16 + pos)::BIGINT AS vec_id, h::INT AS head, list(o + 0.0 ORDER BY i) AS out FROM o GROUP BY seq, pos, h"""),
    "stored_matvec": (stored_matvec, f"WITH {_E} SELECT a.vec_id, b.vec_id AS row, round({sql_dot('b.v', 'a.v')}, 6) AS y FROM e a, e b WHERE b.vec_id < 8"),
    "fused_row_split": (fused_row_split, "SELECT vec_id, CASE WHEN vec_id < 128 THEN 'q' WHEN vec_id < 192 THEN 'k' WHEN vec_id < 256 THEN 'v' END AS part, CASE WHEN vec_id < 128 THEN vec_id WHEN vec_id < 192 THEN vec_id - 128 WHEN vec_id < 256 THEN vec_id - 192 END AS part_row FROM embeddings"),
    "negligible_biases": (negligible_biases, f"WITH {_E} SELECT vec_id, coalesce(list_max(list_transform(v, lambda x: abs(x))), 0) * CASE WHEN label % 2 = 0 THEN 1e-8 ELSE 1 END <= 1e-6 AS negligible FROM e"),
    "storage_choices": (storage_choices, "SELECT file_id, CASE WHEN file_id % 2 = 0 THEN 8 ELSE 1 END AS q8, CASE WHEN file_id % 16 = 0 THEN 14 ELSE 1 END AS q6k FROM token_files"),
    "marker_subsets": (marker_subsets, """SELECT file_id, coalesce(list_has_all(['<|begin_of_solution|>', '</think>', '<|end_of_thought|>'], think_end_markers), true) AS known,
        coalesce(list_has_all(think_end_markers, ['<|begin_of_solution|>', '</think>', '<|end_of_thought|>']), false) AS complete FROM token_files"""),
    "eval_split": (eval_split, """WITH p AS (SELECT event_id // 30 AS b, avg(value) AS m, avg(value) FILTER (event_type <> 'purchase' OR event_type IS NULL) AS t, avg(value) FILTER (event_type = 'purchase') AS a FROM events WHERE event_id // 30 < 100 GROUP BY 1)
        SELECT count(*)::BIGINT AS n_batches, round(coalesce(avg(m), 0), 6) AS loss, round(coalesce(avg(t), 'nan'::DOUBLE), 6) AS think_loss, round(coalesce(avg(a), 'nan'::DOUBLE), 6) AS answer_loss FROM p"""),
    "log_split": (log_split, """WITH r AS (SELECT event_id // 50 AS w, value AS x, event_id % 7 + 1 AS n, coalesce(event_type = 'purchase', false) AS a FROM events)
        SELECT w AS "window", round(avg(x), 6) AS loss, round(coalesce(sum(x * n) FILTER (NOT a), 0) / greatest(coalesce(sum(n) FILTER (NOT a AND x IS NOT NULL), 0), 1), 6) AS think_loss,
          round(coalesce(sum(x * n) FILTER (a), 0) / greatest(coalesce(sum(n) FILTER (a AND x IS NOT NULL), 0), 1), 6) AS answer_loss FROM r GROUP BY 1"""),
}
