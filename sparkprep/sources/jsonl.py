"""Conversations as JSON lines."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import normalized_role
from ..operators.mixing import BLANKS

_MESSAGE = "array<struct<role:string,content:string,from:string,value:string>>"


def parse_lines(lines: DataFrame, line: str = "value") -> DataFrame:
    """Lines with ``status`` and normalized ``messages`` (role, content).

    A line holds an object with ``messages`` or ``conversations``, or the list itself. Status: ``blank``, ``malformed`` (no
    one JSON document and nothing else), ``empty`` (no usable message) or ``ok``. Keys are role and content, or from and value.
    """
    text = F.trim(F.col(line), F.lit(BLANKS))

    def listed(path: str | None) -> Column:
        raw = text if path is None else F.get_json_object(text, path)
        return F.from_json(raw, _MESSAGE)

    found = F.coalesce(listed("$.messages"), listed("$.conversations"), F.when(F.startswith(text, F.lit("[")), listed(None)))
    clean = F.transform(found, lambda m: F.struct(normalized_role(m["role"], m["from"]).alias("role"), F.coalesce(F.nullif(m["content"], F.lit("")), m["value"], F.lit("")).alias("content")))
    kept = F.filter(clean, lambda m: (m["role"] != "") & (m["content"] != ""))
    blank = F.coalesce(text, F.lit("")) == ""
    # one document and nothing behind it: inside an array, whatever follows a document breaks the whole
    valid = F.try_parse_json(F.concat(F.lit("["), text, F.lit("]"))).isNotNull() & (F.try_variant_get(F.try_parse_json(F.concat(F.lit("["), text, F.lit("]"))), "$[1]", "string").isNull())
    out = lines.withColumn("messages", F.when(valid, kept))
    status = F.when(blank, "blank").when(~valid, "malformed").when(F.coalesce(F.size("messages"), F.lit(0)) <= 0, "empty").otherwise("ok")
    return out.withColumn("status", status)


def read_conversations(spark: SparkSession, path: str) -> DataFrame:
    return parse_lines(spark.read.text(path))


def payload_prompt(payload: Column) -> Column:
    """Prompt of a request: of an object the rendered messages, else its ``prompt``, else the payload itself; of other text the text."""
    messages = F.from_json(F.get_json_object(payload, "$.messages"), _MESSAGE)
    shown = F.filter(messages, lambda m: m["role"].isin("system", "user", "assistant"))
    rendered = F.concat(F.array_join(F.transform(shown, lambda m: F.concat(F.lit("<|"), m["role"], F.lit("|>"), F.coalesce(m["content"], F.lit("")), F.lit("<|end|>"))), ""), F.lit("<|assistant|>"))
    prompt = F.coalesce(F.get_json_object(payload, "$.prompt"), payload)
    return F.when(F.startswith(payload, F.lit("{")), F.when(F.size(messages) > 0, rendered).otherwise(prompt)).otherwise(payload)


def respond(lines: DataFrame, tokens: Callable[[Column], Column], line: str = "value") -> DataFrame:
    """Lines with ``status`` and ``responses``: of a request one JSON line a token and ``{"done":true}``, of a broken one an error line.

    Blank lines have no response. ``tokens`` gives the array of tokens for a prompt. Rows are independent, so the same plan
    serves a file and a stream of lines.
    """
    text = F.trim(F.col(line), F.lit(BLANKS))
    valid = F.try_parse_json(F.concat(F.lit("["), text, F.lit("]"))).isNotNull()
    shown = F.transform(tokens(payload_prompt(text)), lambda t: F.to_json(F.struct(t.alias("token"))))
    status = F.when(F.coalesce(text, F.lit("")) == "", "blank").when(F.startswith(text, F.lit("{")) & ~valid, "error").otherwise("ok")
    out = lines.withColumn("status", status)
    done, error = F.lit('{"done":true}'), F.lit('{"error":"malformed request"}')
    return out.withColumn("responses", F.when(F.col("status") == "ok", F.concat(shown, F.array(done))).when(F.col("status") == "error", F.array(error)))
