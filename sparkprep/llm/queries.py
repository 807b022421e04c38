"""The queries of the training-data problems, named pN_..., and their SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import answer_defects, encode, fill_rows, near_duplicates, personal_data, split_long, text_stats, token_budget
from .common import table

Query = Callable[[SparkSession, str], DataFrame]


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return answer_defects.answer_defects(table(spark, d, "messages"), _common_words(spark, d))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return near_duplicates.message_pairs(table(spark, d, "messages"))


def p2_groups(spark: SparkSession, d: str) -> DataFrame:
    return near_duplicates.message_groups(table(spark, d, "messages"))


def _common_words(spark: SparkSession, d: str) -> frozenset[str]:
    """The frequent words, a table of fixed size (25 for each language)."""
    return frozenset(w for (w,) in table(spark, d, "common_words").select("word").distinct().collect() if w)


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    kinds = text_stats.text_kinds(table(spark, d, "messages"), "msg_id", "content", _common_words(spark, d))
    return kinds.where(F.col("kind").isin("list", "table", "junk")).dropDuplicates(["msg_id"])


def p3_statistics(spark: SparkSession, d: str) -> DataFrame:
    return text_stats.text_quality(table(spark, d, "messages"), "msg_id", "content", _common_words(spark, d)).dropDuplicates(["msg_id"])


def p3_measures(spark: SparkSession, d: str) -> DataFrame:
    """The statistics of ``p3_statistics`` alone, rounded, as SQL can tell them."""
    shares = [F.round(c, 9).alias(c) for c in ("mean_word_length", "symbol_share", "ended_line_share", "common_share")]
    return p3_statistics(spark, d).select("msg_id", "n_words", *shares)


def p4_rebuilt(spark: SparkSession, d: str) -> DataFrame:
    """For each message that is split: its text put together again from the pieces, and whether sizes and overlaps keep the limits."""
    from pyspark.sql import Window as W

    pieces = p4_pieces(spark, d).withColumn("before", F.lag("end").over(W.partitionBy("msg_id").orderBy("piece_no")))
    again = F.coalesce(F.col("before") - F.col("begin"), F.lit(0))
    new = F.substr("piece", again + 1)
    kept = (F.length("piece") <= 2000) & (F.length("piece") == F.col("end") - F.col("begin")) & again.between(0, 200)
    rows = pieces.select("msg_id", F.struct("piece_no", new.alias("t")).alias("s"), kept.alias("kept"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list("s")), lambda x: x["t"]), "")
    return rows.groupBy("msg_id").agg(F.md5(text).alias("text_md5"), F.min("kept").alias("within"))


def p4_pieces(spark: SparkSession, d: str) -> DataFrame:
    return split_long.split_oversized(table(spark, d, "messages"), "msg_id", "content").dropDuplicates(["msg_id", "piece_no"])


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return split_long.cut_kinds(split_long.split_oversized(table(spark, d, "messages"), "msg_id", "content"), "msg_id")


def _message_tokens(spark: SparkSession, d: str) -> DataFrame:
    return token_budget.message_tokens(*(table(spark, d, t) for t in ("messages", "conversations", "token_files", "sources")))


def p5_token_budget(spark: SparkSession, d: str) -> DataFrame:
    return token_budget.budget_cube(_message_tokens(spark, d))


def p5_message_tokens(spark: SparkSession, d: str) -> DataFrame:
    return _message_tokens(spark, d)


def p6_ids(spark: SparkSession, d: str) -> DataFrame:
    return encode.encode_texts(table(spark, d, "documents"), "doc_id", "text")


def p7_rows(spark: SparkSession, d: str) -> DataFrame:
    sizes = fill_rows.document_sizes(table(spark, d, "documents"))
    return fill_rows.pack_rows(sizes, "doc_id", "n_tokens", "source", "cluster")


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return personal_data.mentions(table(spark, d, "documents"), "doc_id", "text").select("doc_id", "kind", "start_pos")


def p8_redacted(spark: SparkSession, d: str) -> DataFrame:
    return personal_data.redact(table(spark, d, "documents"), "doc_id", "text")


def queries() -> dict[str, Query]:
    return {f.__name__: f for f in (p1_found, p2_found, p2_groups, p3_found, p3_statistics, p3_measures, p4_found, p4_pieces, p4_rebuilt, p5_token_budget, p5_message_tokens, p6_ids, p7_rows, p8_found, p8_redacted)}


#: White space of Unicode as a class of SQL patterns.
_BLANKS = r"\x{09}-\x{0D}\x{1C}-\x{20}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"


def oracle_sql() -> dict[str, str]:
    return {
        "p4_found": """
            SELECT DISTINCT msg_id,
                   CASE WHEN list_max(list_transform(regexp_split_to_array(content, '[ \\t\\r\\n]+'), lambda x: length(x))) > 2000
                        THEN 'forced' ELSE 'natural' END AS cut_kind
            FROM messages WHERE length(content) > 2000""",
        "p4_rebuilt": "SELECT DISTINCT msg_id, md5(content) AS text_md5, true AS within FROM messages WHERE length(content) > 2000",
        "p3_measures": rf"""
            WITH m AS (SELECT DISTINCT ON (msg_id) msg_id, coalesce(content, '') AS t FROM messages),
            w AS (SELECT msg_id, regexp_extract_all(t, '[\p{{L}}\p{{N}}]+') AS words, length(regexp_replace(t, '[^\p{{L}}\p{{N}}]', '', 'g')) AS inside, length(regexp_replace(t, '[{_BLANKS}]', '', 'g')) AS solid,
                list_filter(list_transform(string_split_regex(t, '\r\n|[\n\r\x0B\x0C\x1C-\x1E\x{{85}}\x{{2028}}\x{{2029}}]'), lambda x: regexp_replace(x, '[{_BLANKS}]+$', '')), lambda x: x <> '') AS lines FROM m),
            c AS (SELECT list(DISTINCT word) AS common FROM common_words)
            SELECT msg_id, len(words)::BIGINT AS n_words, round(CASE WHEN len(words) > 0 THEN inside / len(words) ELSE 0 END, 9) AS mean_word_length, round(CASE WHEN solid > 0 THEN (solid - inside) / solid ELSE 0 END, 9) AS symbol_share,
                round(CASE WHEN len(lines) > 0 THEN len(list_filter(lines, lambda x: contains('.!?…:;,"''»”)', x[-1:]))) / len(lines) ELSE 0 END, 9) AS ended_line_share,
                round(CASE WHEN len(words) > 0 THEN len(list_filter(words, lambda x: list_contains(common, lower(x)))) / len(words) ELSE 0 END, 9) AS common_share FROM w, c""",
    }
