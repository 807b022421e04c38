"""Queries over messages, conversations and documents, each with the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import context, messages as M, mixing, packing
from ..order import stable_key


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _normal(spark: SparkSession, d: str) -> DataFrame:
    return M.normalize(M.delivered_once(table(spark, d, "messages")))


# SQL pieces -----------------------------------------------------------------------------------------------------------

_WS = r" \t\n\r\x0B\f"
_END = "chr(1114109)"  # a noncharacter; marks where a run of white space is split


def sql_pretokens(text: str) -> str:
    split = f"regexp_replace({text}, '([{_WS}]+)([{_WS}][^{_WS}])', '\\1' || {_END} || '\\2', 'g')"
    pattern = (
        "'''s|''t|''re|''ve|''m|''ll|''d| ?[A-Za-z\\x{80}-\\x{10FFFC}]+| ?[0-9]+"
        f"| ?[^{_WS}A-Za-z0-9\\x{{80}}-\\x{{10FFFF}}]+|[{_WS}]+\\x{{10FFFD}}|[{_WS}]+'"
    )
    return f"regexp_extract_all({split}, {pattern})"


_ROLE = "CASE coalesce(role, '') WHEN 'human' THEN 'user' WHEN 'gpt' THEN 'assistant' WHEN 'bot' THEN 'assistant' ELSE coalesce(role, '') END"
_NORMAL = f"""normal AS (SELECT msg_id, conv_id, turn, {_ROLE} AS role, content FROM (SELECT DISTINCT msg_id, conv_id, turn, role, content FROM messages)
    WHERE coalesce(role, '') <> '' AND coalesce(content, '') <> '')"""
_CUT = """coalesce((SELECT min(struct_pack(p := instr(content, m), i := i, n := length(m))) FROM
    (VALUES ('</think>', 0), ('<|end_of_thought|>', 1), ('<|begin_of_solution|>', 2)) t(m, i) WHERE instr(content, m) > 0), NULL)"""
_PARTS = f"""parts AS (SELECT *, CASE WHEN s IS NULL THEN 1 ELSE s.p + s.n END AS cut FROM (SELECT *, {_CUT} AS s FROM normal)),
  split AS (SELECT *, substr(content, 1, cut - 1) AS think, substr(content, cut) AS answer FROM parts)"""
_SEGMENTS = f"""{_NORMAL}, {_PARTS}, segs AS (
    SELECT conv_id, turn, msg_id, 0 AS part, 'role' AS segment, 1::BIGINT AS n_tokens, 0 AS loss, 0 AS is_answer FROM split
    UNION ALL SELECT conv_id, turn, msg_id, 1, 'think', len({sql_pretokens("think")}), 1, 0 FROM split WHERE role = 'assistant' AND think <> ''
    UNION ALL SELECT conv_id, turn, msg_id, 2, 'content', len({sql_pretokens("CASE WHEN role = 'assistant' THEN answer ELSE content END")}),
      (role = 'assistant')::INT, (role = 'assistant')::INT FROM split
    UNION ALL SELECT conv_id, turn, msg_id, 3, 'end', 1, (role = 'assistant')::INT, (role = 'assistant')::INT FROM split)"""
_CROP = f"""{_SEGMENTS}, sums AS (SELECT *, CASE WHEN loss = 1 AND is_answer = 0 THEN n_tokens ELSE 0 END AS think,
      sum(n_tokens) OVER (PARTITION BY conv_id) AS total, sum(n_tokens * loss) OVER (PARTITION BY conv_id) AS masked FROM segs),
  sums2 AS (SELECT *, sum(think) OVER (PARTITION BY conv_id) AS reasoning, greatest(total - 512, 0) AS excess,
      coalesce(sum(think) OVER (PARTITION BY conv_id ORDER BY turn, msg_id, part ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS earlier FROM sums),
  cropped AS (SELECT *, n_tokens - least(think, greatest(excess - earlier, 0)) AS kept,
      CASE WHEN excess > reasoning THEN 'overflow' WHEN masked - excess <= 0 THEN 'skip' ELSE 'ok' END AS status FROM sums2)"""
MAX_LEN = 512

#: Length of a record in tokens.
RECORD = 2048
SQL_RECORDS = f"""{_NORMAL}, {_PARTS}, pieces AS (
    SELECT conv_id, turn, msg_id, 0 AS part, hex('<|' || role || '|>') AS h, 0 AS loss, 0 AS ans FROM split
    UNION ALL SELECT conv_id, turn, msg_id, 1, hex(think), 1, 0 FROM split WHERE role = 'assistant' AND think <> ''
    UNION ALL SELECT conv_id, turn, msg_id, 2, hex(CASE WHEN role = 'assistant' THEN answer ELSE content END), (role = 'assistant')::INT, (role = 'assistant')::INT FROM split
    UNION ALL SELECT conv_id, turn, msg_id, 3, hex('<|end|>'), (role = 'assistant')::INT, (role = 'assistant')::INT FROM split),
  segs AS (SELECT *, length(h) // 2 AS n FROM pieces WHERE conv_id IS NOT NULL),
  sums AS (SELECT *, CASE WHEN loss = 1 AND ans = 0 THEN n ELSE 0 END AS th, sum(n) OVER (PARTITION BY conv_id) AS total, sum(n * loss) OVER (PARTITION BY conv_id) AS masked FROM segs),
  more AS (SELECT *, sum(th) OVER (PARTITION BY conv_id) AS reasoning, greatest(total - {RECORD}, 0) AS excess,
    coalesce(sum(th) OVER (PARTITION BY conv_id ORDER BY turn, msg_id, part ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS earlier FROM sums),
  cut AS (SELECT *, (n - least(th, greatest(excess - earlier, 0)))::BIGINT AS kept FROM more WHERE excess <= reasoning AND masked - excess > 0),
  whole AS (SELECT *, regexp_replace(substr(h, 2 * (n - kept) + 1), '(..)', '00\\1', 'g') AS x FROM cut WHERE kept > 0),
  recs AS (SELECT conv_id, sum(kept)::BIGINT AS n, string_agg(x, '' ORDER BY turn, msg_id, part) AS ids, string_agg(repeat(loss::VARCHAR, kept), '' ORDER BY turn, msg_id, part) AS mask,
    string_agg(repeat(ans::VARCHAR, kept), '' ORDER BY turn, msg_id, part) AS ans, string_agg(CASE WHEN loss = 1 THEN x ELSE repeat('----', kept) END, '' ORDER BY turn, msg_id, part) AS labels FROM whole GROUP BY conv_id)"""

_BLANK = r"length(regexp_replace(coalesce(text, ''), '^[\x{09}-\x{0D}\x{1C}-\x{20}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+', '')) > 0"
_DOC_TOKENS = f"""counted AS (SELECT doc_id, source, len({sql_pretokens("text")})::BIGINT AS t FROM documents WHERE {_BLANK}),
  tokens AS (SELECT doc_id, source, t - CASE WHEN t % 7800 < 64 THEN t % 7800 ELSE 0 END AS n FROM counted WHERE t - CASE WHEN t % 7800 < 64 THEN t % 7800 ELSE 0 END > 0)"""
#: Tokens kept of each source in the demonstration of the mix.
BUDGET = 20_000
_MIX = f"""{_DOC_TOKENS}, mix AS (SELECT *, coalesce(sum(n) OVER (PARTITION BY source ORDER BY md5('1234:' || doc_id), doc_id
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before FROM tokens WHERE source IS NOT NULL),
  kept AS (SELECT * FROM mix WHERE before < {BUDGET})"""
#: Budget of a source whose token_target is null, or which the catalogue does not have.
DEFAULT_TARGET = 100_000_000
_TARGET_MIX = f"""{_DOC_TOKENS}, mix AS (SELECT t.*, coalesce(s.token_target, {DEFAULT_TARGET}) AS target, coalesce(sum(n) OVER (PARTITION BY source ORDER BY md5('1234:' || doc_id), doc_id
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before FROM tokens t LEFT JOIN sources s ON s.source_name = t.source WHERE source IS NOT NULL),
  kept AS (SELECT * FROM mix WHERE before < target)"""


# queries --------------------------------------------------------------------------------------------------------------


def normalize_messages(spark: SparkSession, d: str) -> DataFrame:
    return _normal(spark, d)


def think_answer_split(spark: SparkSession, d: str) -> DataFrame:
    c = F.col("content")
    return _normal(spark, d).where("role = 'assistant'").select("msg_id", F.length(T.think_part(c)).cast("bigint").alias("think_chars"), F.md5(T.answer_part(c)).alias("answer_md5"))


def chat_prompt_render(spark: SparkSession, d: str) -> DataFrame:
    return M.render_prompt(_normal(spark, d)).select("conv_id", F.length("prompt").cast("bigint").alias("n_chars"), F.md5("prompt").alias("prompt_md5"))


def pretokenize_counts(spark: SparkSession, d: str) -> DataFrame:
    pieces = T.pretokenize(F.col("text"))
    return table(spark, d, "documents").select("doc_id", T.pretoken_count(F.col("text")).alias("n_tokens"), F.md5(F.array_join(pieces, "\x1f")).alias("pieces_md5"))


def pretokenize_vocab(spark: SparkSession, d: str) -> DataFrame:
    words = table(spark, d, "documents").select(F.explode(T.pretokenize(F.col("text"))).alias("token"))
    return words.groupBy("token").agg(F.count(F.lit(1)).alias("n"))


def chat_template_segments(spark: SparkSession, d: str) -> DataFrame:
    return M.segments(_normal(spark, d))


def chat_template_tokens(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("n_tokens")
    return M.segments(_normal(spark, d)).groupBy("conv_id").agg(F.sum(n).alias("n_tokens"), F.sum(n * F.col("loss")).alias("n_loss"), F.sum(n * F.col("is_answer")).alias("n_answer"))


def crop_preserving_answer(spark: SparkSession, d: str) -> DataFrame:
    return M.crop(M.segments(_normal(spark, d)), MAX_LEN).select("msg_id", "part", "n_tokens", "kept", "status")


def conversation_status(spark: SparkSession, d: str) -> DataFrame:
    per = M.crop(M.segments(_normal(spark, d)), MAX_LEN).groupBy("conv_id").agg(F.first("status").alias("status"), F.sum("kept").alias("kept"), (F.first("excess") > 0).alias("cut"))
    return per.groupBy("status").agg(F.count(F.lit(1)).alias("n"), F.count_if("cut").alias("n_too_long"), F.sum("kept").alias("n_tokens"))


def label_mask_counts(spark: SparkSession, d: str) -> DataFrame:
    """Labels, ignored places and answer labels of every conversation that is kept."""
    kept = M.crop(M.segments(_normal(spark, d)), MAX_LEN).where("status = 'ok'")
    n = F.col("kept")
    return kept.groupBy("conv_id").agg(F.sum(n * F.col("loss")).alias("n_labels"), F.sum(n * (1 - F.col("loss"))).alias("n_ignored"), F.sum(n * F.col("is_answer")).alias("n_answer"))


def collate_lengths(spark: SparkSession, d: str) -> DataFrame:
    lengths = M.segments(_normal(spark, d)).groupBy("conv_id").agg(F.sum("n_tokens").alias("n"))
    return M.collate(lengths, "conv_id", "n", 8)


def instruction_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Each message with the one after it in its conversation, as a two-message conversation."""
    from pyspark.sql import Window as W

    w = W.partitionBy("conv_id").orderBy("turn", "msg_id")
    out = _normal(spark, d).withColumns({"next_role": F.lead("role").over(w), "reply": F.lead("content").over(w)})
    out = out.where("role = 'user' and next_role = 'assistant'")
    pair = F.array(F.struct(F.lit("user").alias("role"), F.col("content").alias("content")), F.struct(F.lit("assistant").alias("role"), F.col("reply").alias("content")))
    return out.select("msg_id", F.md5(F.array_join(F.transform(pair, lambda m: F.concat(m["role"], F.lit(":"), m["content"])), "|")).alias("pair_md5"))


def document_chunks(spark: SparkSession, d: str) -> DataFrame:
    return mixing.chunks(table(spark, d, "documents"))


def mix_order(spark: SparkSession, d: str) -> DataFrame:
    mix = mixing.budgeted_mix(mixing.document_tokens(table(spark, d, "documents")).where("source is not null"), F.lit(BUDGET))
    return mix.select("doc_id", "source", "n", "before", F.round("place", 9).alias("place"))


def mix_token_totals(spark: SparkSession, d: str) -> DataFrame:
    mix = mixing.budgeted_mix(mixing.document_tokens(table(spark, d, "documents")).where("source is not null"), F.lit(BUDGET))
    return mix.groupBy("source").agg(F.count(F.lit(1)).alias("n_docs"), F.sum("n").alias("n_tokens"))


def _target_mix(spark: SparkSession, d: str) -> DataFrame:
    tokens = mixing.document_tokens(table(spark, d, "documents")).where("source is not null")
    targets = table(spark, d, "sources").select(F.col("source_name").alias("source"), "token_target")
    return mixing.budgeted_mix(tokens.join(F.broadcast(targets), "source", "left"), F.coalesce("token_target", F.lit(DEFAULT_TARGET)))


def mix_order_by_target(spark: SparkSession, d: str) -> DataFrame:
    """The mix under each source's own token_target."""
    return _target_mix(spark, d).select("doc_id", "source", "n", "before", F.round("place", 16).alias("place"))


def mix_token_totals_by_target(spark: SparkSession, d: str) -> DataFrame:
    return _target_mix(spark, d).groupBy("source").agg(F.count(F.lit(1)).alias("n_docs"), F.sum("n").alias("n_tokens"))


def subset_interleave(spark: SparkSession, d: str) -> DataFrame:
    return mixing.interleave(table(spark, d, "documents"), "domain")


def stratified_sample(spark: SparkSession, d: str) -> DataFrame:
    return mixing.stratified_sample(table(spark, d, "documents"), "domain", 500)


def shuffle_take(spark: SparkSession, d: str) -> DataFrame:
    return mixing.shuffle_take(table(spark, d, "documents"), 200)


def train_val_split(spark: SparkSession, d: str) -> DataFrame:
    return mixing.train_val_split(table(spark, d, "documents"))


def loader_order(spark: SparkSession, d: str) -> DataFrame:
    """Key by which an epoch's rows are ordered."""
    return table(spark, d, "documents").select("doc_id", stable_key(42, F.lit(3), F.col("doc_id")).alias("key"))


def _packed(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", T.pretoken_count(F.col("text")).alias("n"))
    return packing.pack(docs, "doc_id", "n", 2048)


def pack_bins(spark: SparkSession, d: str) -> DataFrame:
    return _packed(spark, d).select("doc_id", "shard", "bin", "n_used")


def pack_utilization(spark: SparkSession, d: str) -> DataFrame:
    return packing.utilization(_packed(spark, d), 2048)


_PACK = f"""lens AS (SELECT doc_id, coalesce(len({sql_pretokens("text")}), 0)::BIGINT AS n, md5('1234:' || doc_id) AS k FROM documents),
  items AS (SELECT *, least(n, 2048) AS used, (('0x' || substr(k, 1, 8))::BIGINT % greatest(1, ceil((SELECT count(*) FROM documents) / 4096.0))::BIGINT) AS shard FROM lens),
  ranked AS (SELECT *, row_number() OVER (PARTITION BY shard ORDER BY k, doc_id) AS rn FROM items),
  packed AS (SELECT shard, rn, doc_id, n, used, 0::BIGINT AS bin, used AS fill FROM ranked WHERE rn = 1
    UNION ALL SELECT r.shard, r.rn, r.doc_id, r.n, r.used, p.bin + CASE WHEN p.fill + r.used > 2048 THEN 1 ELSE 0 END,
      CASE WHEN p.fill + r.used > 2048 THEN r.used ELSE p.fill + r.used END FROM packed p JOIN ranked r ON r.shard = p.shard AND r.rn = p.rn + 1)"""


def used_vocab(spark: SparkSession, d: str) -> DataFrame:
    """Distinct tokens of documents and of messages, with where they are used."""
    docs = table(spark, d, "documents").select(F.explode(T.pretokenize(F.col("text"))).alias("token")).distinct().withColumn("place", F.lit(1))
    msgs = table(spark, d, "messages").select(F.explode(T.pretokenize(F.col("content"))).alias("token")).distinct().withColumn("place", F.lit(2))
    return docs.unionByName(msgs).groupBy("token").agg(F.sum("place").cast("bigint").alias("places"))


def special_tokens(spark: SparkSession, d: str) -> DataFrame:
    """Strings in documents that look like special tokens, longest first when matched."""
    found = table(spark, d, "documents").select(F.explode(F.regexp_extract_all("text", F.lit(r"<\|[^|<>]*\|>"), F.lit(0))).alias("token"))
    return found.where(T.is_special_token(F.col("token"))).groupBy("token").agg(F.count(F.lit(1)).alias("n"), F.max(F.length("token")).cast("bigint").alias("n_chars"))


def longest_common_prefix(spark: SparkSession, d: str) -> DataFrame:
    """Shared leading pretokens of each user message with the one before it in its conversation, and what can be reused."""
    from pyspark.sql import Window as W

    w = W.partitionBy("conv_id").orderBy("turn", "msg_id")
    ids = T.pretokenize(F.col("content"))
    out = _normal(spark, d).where("role = 'user'").select("msg_id", "conv_id", "turn", ids.alias("ids")).withColumn("before", F.lag("ids").over(w)).where("before is not null")
    matched = context.common_prefix(F.col("before"), F.col("ids"))
    return out.select("msg_id", matched.cast("bigint").alias("matched"), context.reusable(matched, F.size("ids")).cast("bigint").alias("reused"))


def row_status(spark: SparkSession, d: str) -> DataFrame:
    """Rows of documents by whether their text is null, empty, blank or usable, and lines in them."""
    t = F.col("text")
    status = F.when(t.isNull(), "null").when(t == "", "empty").when(~mixing.not_blank(t), "blank").otherwise("ok")
    return table(spark, d, "documents").groupBy(status.alias("status")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.size(F.split(t, "\n"))).alias("n_lines"), F.sum("n_chars").alias("n_chars"))


def source_counts(spark: SparkSession, d: str) -> DataFrame:
    """Rows and characters by source and domain, with subtotals."""
    docs = table(spark, d, "documents")
    return docs.rollup("source", "domain").agg(F.grouping_id().cast("bigint").alias("level"), F.count(F.lit(1)).alias("n"), F.sum("n_chars").alias("n_chars"))


def escape_json(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.md5(T.escape_json(F.col("text"))).alias("escaped_md5"))


def id_typecodes(spark: SparkSession, d: str) -> DataFrame:
    """Width of ids of each token file, chosen by its vocabulary, and whether the header says the same."""
    code = T.id_typecode(F.col("vocab_ceiling"))
    return table(spark, d, "token_files").select("file_id", code.alias("typecode"), F.col("id_typecode").eqNullSafe(code).alias("stated"))


def cache_keys(spark: SparkSession, d: str) -> DataFrame:
    files = table(spark, d, "token_files")
    key = T.cache_key(2, F.coalesce("tokenizer_source", F.lit("")), F.col("max_len"), F.col("think_end_markers"), F.col("vocab_ceiling"), F.col("file_id"))
    return files.select("file_id", key.alias("cache_key"))


def truncated_notes(spark: SparkSession, d: str) -> DataFrame:
    """Message contents as notes of at most 300 bytes."""
    return M.delivered_once(table(spark, d, "messages")).select("msg_id", F.md5(T.truncated_note(F.col("content"))).alias("note_md5"))


def text_hashes(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("sha256"))


_ESC = "text"
for _a, _b in (("'\\'", "'\\\\'"), ("'\"'", "'\\\"'"), ("chr(10)", "'\\n'"), ("chr(13)", "'\\r'"), ("chr(9)", "'\\t'")):
    _ESC = f"replace({_ESC}, {_a}, {_b})"
for _i in range(1, 32):
    if chr(_i) not in "\n\r\t":
        _ESC = f"replace({_ESC}, chr({_i}), '\\u{_i:04x}')"

QUERIES = {
    "normalize_messages": (normalize_messages, f"WITH {_NORMAL} SELECT * FROM normal"),
    "think_answer_split": (think_answer_split, f"WITH {_NORMAL}, {_PARTS} SELECT msg_id, length(think)::BIGINT AS think_chars, md5(answer) AS answer_md5 FROM split WHERE role = 'assistant'"),
    "chat_prompt_render": (chat_prompt_render, f"""WITH {_NORMAL}, r AS (SELECT conv_id, string_agg('<|' || role || '|>' || content || '<|end|>', '' ORDER BY turn, msg_id) || '<|assistant|>' AS prompt
        FROM normal WHERE role IN ('system', 'user', 'assistant') GROUP BY conv_id) SELECT conv_id, length(prompt)::BIGINT AS n_chars, md5(prompt) AS prompt_md5 FROM r"""),
    "pretokenize_counts": (pretokenize_counts, f"""SELECT doc_id, coalesce(len({sql_pretokens("text")}), 0)::BIGINT AS n_tokens,
        md5(replace(array_to_string({sql_pretokens("text")}, chr(31)), {_END}, '')) AS pieces_md5 FROM documents"""),
    "pretokenize_vocab": (pretokenize_vocab, f"SELECT token, count(*)::BIGINT AS n FROM (SELECT replace(unnest({sql_pretokens('text')}), {_END}, '') AS token FROM documents) GROUP BY token"),
    "chat_template_segments": (chat_template_segments, f"WITH {_SEGMENTS} SELECT * FROM segs"),
    "chat_template_tokens": (chat_template_tokens, f"WITH {_SEGMENTS} SELECT conv_id, sum(n_tokens)::BIGINT AS n_tokens, sum(n_tokens * loss)::BIGINT AS n_loss, sum(n_tokens * is_answer)::BIGINT AS n_answer FROM segs GROUP BY conv_id"),
    "crop_preserving_answer": (crop_preserving_answer, f"WITH {_CROP} SELECT msg_id, part, n_tokens, kept::BIGINT AS kept, status FROM cropped"),
    "conversation_status": (conversation_status, f"""WITH {_CROP}, per AS (SELECT conv_id, any_value(status) AS status, sum(kept) AS kept, any_value(excess) > 0 AS cut FROM cropped GROUP BY conv_id)
        SELECT status, count(*)::BIGINT AS n, count_if(cut)::BIGINT AS n_too_long, sum(kept)::BIGINT AS n_tokens FROM per GROUP BY status"""),
    "label_mask_counts": (label_mask_counts, f"""WITH {_CROP} SELECT conv_id, sum(kept * loss)::BIGINT AS n_labels, sum(kept * (1 - loss))::BIGINT AS n_ignored,
        sum(kept * is_answer)::BIGINT AS n_answer FROM cropped WHERE status = 'ok' GROUP BY conv_id"""),
    "collate_lengths": (collate_lengths, f"""WITH {_SEGMENTS}, l AS (SELECT conv_id, sum(n_tokens)::BIGINT AS n FROM segs GROUP BY conv_id), r AS (SELECT *, row_number() OVER (ORDER BY conv_id) - 1 AS rank FROM l),
        b AS (SELECT *, rank // 8 AS batch_id, rank % 8 AS position FROM r), w AS (SELECT *, max(n) OVER (PARTITION BY batch_id) AS width FROM b)
        SELECT batch_id::BIGINT AS batch_id, position::BIGINT AS position, conv_id, n, width, width - n AS padding FROM w"""),
    "instruction_pairs": (instruction_pairs, f"""WITH {_NORMAL}, n AS (SELECT *, lead(role) OVER w AS next_role, lead(content) OVER w AS reply FROM normal WINDOW w AS (PARTITION BY conv_id ORDER BY turn, msg_id))
        SELECT msg_id, md5('user:' || content || '|assistant:' || reply) AS pair_md5 FROM n WHERE role = 'user' AND next_role = 'assistant'"""),
    "document_chunks": (document_chunks, f"""WITH counted AS (SELECT doc_id, len({sql_pretokens("text")})::BIGINT AS total FROM documents WHERE {_BLANK}),
        s AS (SELECT doc_id, total, unnest(range(0, total, 7800)) AS first_token FROM counted)
        SELECT doc_id, first_token // 7800 AS chunk, first_token, least(7800, total - first_token) AS n_tokens, least(7800, total - first_token) + 2 AS n_with_marks FROM s WHERE least(7800, total - first_token) >= 64"""),
    "mix_order": (mix_order, f"WITH {_MIX} SELECT doc_id, source, n, before, round((before + n / 2) / {BUDGET}, 9) AS place FROM kept"),
    "mix_order_by_target": (mix_order_by_target, f"WITH {_TARGET_MIX} SELECT doc_id, source, n, before, round((before + n / 2) / target, 16) AS place FROM kept"),
    "mix_token_totals_by_target": (mix_token_totals_by_target, f"WITH {_TARGET_MIX} SELECT source, count(*)::BIGINT AS n_docs, sum(n)::BIGINT AS n_tokens FROM kept GROUP BY source"),
    "mix_token_totals": (mix_token_totals, f"WITH {_MIX} SELECT source, count(*)::BIGINT AS n_docs, sum(n)::BIGINT AS n_tokens FROM kept GROUP BY source"),
    "subset_interleave": (subset_interleave, """WITH r AS (SELECT doc_id, domain, row_number() OVER (PARTITION BY domain ORDER BY doc_id) AS turn FROM documents WHERE domain IS NOT NULL)
        SELECT doc_id, domain, turn FROM r WHERE turn <= (SELECT min(n) FROM (SELECT count(*) AS n FROM documents WHERE domain IS NOT NULL GROUP BY domain))"""),
    "stratified_sample": (stratified_sample, """WITH r AS (SELECT doc_id, domain, row_number() OVER (PARTITION BY domain ORDER BY md5('1234:' || doc_id), doc_id) AS rn, count(*) OVER (PARTITION BY domain) AS n, count(*) OVER () AS total FROM documents)
        SELECT doc_id, domain FROM r WHERE rn <= 500 * n // total"""),
    "shuffle_take": (shuffle_take, "SELECT doc_id, md5('1234:' || doc_id) AS k FROM documents ORDER BY k, doc_id LIMIT 200"),
    "train_val_split": (train_val_split, """WITH r AS (SELECT doc_id, row_number() OVER (ORDER BY md5('42:' || doc_id), doc_id) - 1 AS rank, count(*) OVER () AS n FROM documents)
        SELECT doc_id, CASE WHEN greatest(1, floor(n * 0.05)) < n AND rank < greatest(1, floor(n * 0.05)) THEN 'val' ELSE 'train' END AS split FROM r"""),
    "loader_order": (loader_order, "SELECT doc_id, md5('42:3:' || doc_id) AS key FROM documents"),
    "pack_bins": (pack_bins, f"WITH RECURSIVE {_PACK} SELECT doc_id, shard, bin, used AS n_used FROM packed"),
    "pack_utilization": (pack_utilization, f"""WITH RECURSIVE {_PACK}, rows AS (SELECT shard, bin, sum(n) AS t FROM packed GROUP BY shard, bin)
        SELECT count(*)::BIGINT AS n_rows, sum(t)::BIGINT AS n_tokens, round(100 * sum(t) / (count(*) * 2048), 6) AS percent FROM rows"""),
    "used_vocab": (used_vocab, f"""WITH t AS (SELECT DISTINCT replace(unnest({sql_pretokens("text")}), {_END}, '') AS token, 1 AS place FROM documents
        UNION ALL SELECT DISTINCT replace(unnest({sql_pretokens("content")}), {_END}, '') AS token, 2 FROM messages) SELECT token, sum(place)::BIGINT AS places FROM t GROUP BY token"""),
    "special_tokens": (special_tokens, r"""WITH t AS (SELECT unnest(regexp_extract_all(text, '<\|[^|<>]*\|>')) AS token FROM documents)
        SELECT token, count(*)::BIGINT AS n, length(token)::BIGINT AS n_chars FROM t GROUP BY token"""),
    "longest_common_prefix": (longest_common_prefix, f"""WITH {_NORMAL}, i AS (SELECT msg_id, conv_id, turn, {sql_pretokens("content")} AS ids FROM normal WHERE role = 'user'),
        b AS (SELECT *, lag(ids) OVER (PARTITION BY conv_id ORDER BY turn, msg_id) AS before FROM i),
        m AS (SELECT msg_id, len(ids) AS n, coalesce(list_min(list_filter(range(1, least(len(ids), len(before)) + 1), lambda j: ids[j] <> before[j])), least(len(ids), len(before)) + 1) - 1 AS matched FROM b WHERE before IS NOT NULL)
        SELECT msg_id, matched::BIGINT AS matched, (CASE WHEN n > 0 AND matched >= n THEN n - 1 ELSE matched END)::BIGINT AS reused FROM m"""),
    "row_status": (row_status, f"""SELECT CASE WHEN text IS NULL THEN 'null' WHEN text = '' THEN 'empty' WHEN NOT {_BLANK} THEN 'blank' ELSE 'ok' END AS status, count(*)::BIGINT AS n,
        sum(len(string_split(text, chr(10))))::BIGINT AS n_lines, sum(n_chars)::BIGINT AS n_chars FROM documents GROUP BY 1"""),
    "source_counts": (source_counts, "SELECT source, domain, grouping(source, domain)::BIGINT AS level, count(*)::BIGINT AS n, sum(n_chars)::BIGINT AS n_chars FROM documents GROUP BY ROLLUP (source, domain)"),
    "escape_json": (escape_json, f"SELECT doc_id, md5({_ESC}) AS escaped_md5 FROM documents"),
    "id_typecodes": (id_typecodes, "SELECT file_id, CASE WHEN vocab_ceiling <= 65535 THEN 'H' ELSE 'I' END AS typecode, id_typecode IS NOT DISTINCT FROM CASE WHEN vocab_ceiling <= 65535 THEN 'H' ELSE 'I' END AS stated FROM token_files"),
    "cache_keys": (cache_keys, "SELECT file_id, substr(sha256(concat_ws('|', '2', coalesce(tokenizer_source, ''), max_len, array_to_string(think_end_markers, ','), vocab_ceiling, file_id)), 1, 16) AS cache_key FROM token_files"),
    "truncated_notes": (truncated_notes, """SELECT msg_id, md5(CASE WHEN strlen(content) > 300
        THEN substr(content, 1, list_max(list_filter(range(75, 301), lambda k: strlen(substr(content, 1, k)) <= 300))) || '...]' || chr(10) ELSE content END) AS note_md5
        FROM (SELECT DISTINCT msg_id, conv_id, turn, role, content FROM messages)"""),
    "text_hashes": (text_hashes, "SELECT doc_id, sha256(text) AS sha256 FROM documents"),
}
