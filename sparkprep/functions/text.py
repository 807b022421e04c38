"""String functions of the tokenizer front end, as built-in column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: the six white-space characters of the pretokenizer.
WS = r" \t\n\r\x0B\f"

#: Contractions, then an optional blank with letters, digits or punctuation, then white space.
PRETOKENS = (
    r"'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-z\x{80}-\x{10FFFF}]+| ?[0-9]+"
    rf"| ?[^{WS}A-Za-z0-9\x{{80}}-\x{{10FFFF}}]+|[{WS}]+(?![^{WS}])|[{WS}]"
)

#: Markers that end reasoning, in the order that breaks ties.
THINK_END_MARKERS = ("<|begin_of_solution|>", "</think>", "<|end_of_thought|>")


def pretokenize(text: Column) -> Column:
    """Pretokens of a text in order; they join to the text. Null stays null, the empty text has none."""
    return F.regexp_extract_all(text, F.lit(PRETOKENS), F.lit(0))


def pretoken_count(text: Column) -> Column:
    """Number of pretokens; 0 for null."""
    return F.coalesce(F.size(pretokenize(text)), F.lit(0)).cast("bigint")


def normalized_role(role: Column, alternative: Column | None = None) -> Column:
    """First non-empty role, with human as user and gpt and bot as assistant; other roles stay; empty if there is none."""
    first = F.coalesce(F.nullif(role, F.lit("")), alternative if alternative is not None else F.lit(None).cast("string"), F.lit(""))
    return F.when(first == "human", "user").when(first.isin("gpt", "bot"), "assistant").otherwise(first)


def answer_start(content: Column, markers: tuple[str, ...] = THINK_END_MARKERS) -> Column:
    """1-based position of the answer: behind the earliest marker, the first in the list on ties; 1 without one."""
    spots = F.array(*[F.struct(F.instr(content, m).alias("p"), F.lit(i).alias("i"), F.lit(len(m)).alias("n")) for i, m in enumerate(markers)])
    first = F.array_min(F.filter(spots, lambda s: s["p"] > 0))
    return F.coalesce(first["p"] + first["n"], F.lit(1))


def think_part(content: Column, markers: tuple[str, ...] = THINK_END_MARKERS) -> Column:
    return F.substring(content, F.lit(1), answer_start(content, markers) - 1)


def answer_part(content: Column, markers: tuple[str, ...] = THINK_END_MARKERS) -> Column:
    return F.substring(content, answer_start(content, markers), F.lit(2147483647))


def is_special_token(token: Column) -> Column:
    """'<|name|>' without bars or angle brackets inside the name."""
    return F.coalesce(token.rlike(r"^<\|[^|<>]*\|>$"), F.lit(False))


def escape_json(text: Column) -> Column:
    """Text inside JSON quotes: short forms for quote, backslash, line feed, return and tab, \\u00xx for other controls."""
    out = text
    for a, b in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        out = F.replace(out, F.lit(a), F.lit(b))
    for i in range(32):
        if chr(i) not in "\n\r\t":
            out = F.replace(out, F.lit(chr(i)), F.lit(f"\\u{i:04x}"))
    return out


def truncated_note(text: Column, limit: int = 300) -> Column:
    """Notes of more than ``limit`` bytes are cut there and end in '...]' and a line feed; a torn last character is dropped."""
    raw = F.encode(text, "utf-8")
    inner = [F.hex(F.substring(raw, limit + 1 - k, 1)).between("80", "BF") for k in range(3)]  # bytes that go on with a character, backwards from the cut
    torn = F.when(~inner[0], 0).when(~inner[1], 1).when(~inner[2], 2).otherwise(3)
    cut = F.decode(F.substring(raw, F.lit(1), limit - torn), "utf-8")
    return F.when(F.octet_length(text) > limit, F.concat(cut, F.lit("...]\n"))).otherwise(text)


def id_typecode(ceiling: Column) -> Column:
    """'H' for vocabularies whose ids fit 16 bits (ceiling up to 65535), else 'I'."""
    return F.when(ceiling <= 65535, "H").otherwise("I")


def cache_key(version: int, tokenizer: Column, max_len: Column, markers: Column, size: Column, mtime: Column) -> Column:
    """First 16 hex digits of a SHA-256 over what a tokenization depends on."""
    return F.substring(F.sha2(F.concat_ws("|", F.lit(str(version)), tokenizer, max_len.cast("string"), F.array_join(markers, ","), size.cast("string"), mtime.cast("bigint").cast("string")), 256), 1, 16)
