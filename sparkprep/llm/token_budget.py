"""Problem 5: tokens per source, language and domain under the tokenizer that each conversation's file names."""

from __future__ import annotations

import base64
import json
import os

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import TOKENIZER_DIR, map_arrow
from .prefix_bpe import SPLIT_PATTERN

#: Vocabulary ceiling -> tokenizer, in the order of the names.
TOKENIZERS = {50257: "byte_bpe_50k", 50256: "byte_bpe_multi_50k", 32000: "piece_bpe_32k", 49408: "word_bpe_49k"}

#: Spellings of the languages beyond their two-letter codes.
LANGUAGES = {"english": "en", "german": "de", "french": "fr", "spanish": "es", "deutsch": "de", "français": "fr", "español": "es"}

_LOADED: dict[str, object] = {}


def tokenizer_name(source: Column, ceiling: Column) -> Column:
    """Tokenizer of a token file: its spelling reduced to the file's stem, lower case and underscores.

    Null, empty and unknown spellings follow the vocabulary ceiling; null if that is unknown as well.
    """
    stem = F.regexp_replace(F.regexp_replace(F.lower(F.trim(source)), r"^.*/", ""), r"\.(json|tiktoken|model)$", "")
    stem = F.replace(stem, F.lit("-"), F.lit("_"))
    by_ceiling = F.create_map(*[F.lit(x) for pair in TOKENIZERS.items() for x in pair])[ceiling]
    return F.when(stem.isin(*TOKENIZERS.values()), stem).otherwise(by_ceiling)


def language(lang: Column) -> Column:
    """Two-letter code of a spelled language ('EN', 'en-US', 'english'); null for null and undetermined."""
    low = F.lower(F.trim(lang))
    named = F.create_map(*[F.lit(x) for pair in LANGUAGES.items() for x in pair])[low]
    code = F.regexp_extract(low, r"^([a-z]{2})([-_].*)?$", 1)
    return F.coalesce(named, F.when(code != "", code))


def load(name: str, tokenizer_dir: str = TOKENIZER_DIR):
    """A function from texts to exact token counts; its tokenizer is read once per worker."""
    if (key := f"{tokenizer_dir}/{name}") in _LOADED:
        return _LOADED[key]
    if os.path.exists(path := f"{key}.tiktoken"):
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(word): int(rank) for word, rank in (line.split() for line in f if line.strip())}
        model = tiktoken.Encoding(name, pat_str=SPLIT_PATTERN, mergeable_ranks=ranks, special_tokens={})
        count = lambda texts: [len(x) for x in model.encode_ordinary_batch(texts, num_threads=1)]
    elif os.path.exists(path := f"{key}.model"):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        count = lambda texts: [len(x) for x in model.encode(texts, num_threads=1)]
    else:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        with open(f"{key}.json", encoding="utf-8") as f:
            spec = json.load(f)
        model = Tokenizer.from_str(json.dumps(spec | {"post_processor": None}))
        model.encode_special_tokens = True
        count = lambda texts: [len(x) for x in model.encode_batch_fast(texts, add_special_tokens=False)]
    _LOADED[key] = count
    return count


def count_tokens(df: DataFrame, text: str, tokenizer: str, out: str = "n_tokens", tokenizer_dir: str = TOKENIZER_DIR) -> DataFrame:
    """Replaces the column ``text`` by its number of tokens under the tokenizer of each row's column ``tokenizer``.

    Null and empty texts have 0 tokens; a row without a tokenizer has a null count. Whole texts are encoded, in one
    vectorized call for each tokenizer and batch.
    """
    kept = [c for c in df.columns if c != text]

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts, names = batch.column(batch.schema.get_field_index("__text")), batch.column(batch.schema.get_field_index("__tok"))
        counts, known = np.zeros(batch.num_rows, np.int64), np.asarray(pc.is_valid(names))
        for name in pc.unique(names).to_pylist():
            if name is not None:
                at = np.flatnonzero(np.asarray(pc.fill_null(pc.equal(names, name), False)))
                counts[at] = load(name, tokenizer_dir)(pc.fill_null(texts.take(pa.array(at)), "").to_pylist())
        columns = [batch.column(batch.schema.get_field_index(c)) for c in kept]
        return pa.RecordBatch.from_arrays([*columns, pa.array(counts, mask=~known)], [*kept, out])

    slim = df.select(*kept, F.col(text).alias("__text"), F.col(tokenizer).alias("__tok"))
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*kept).schema), f"`{out}` bigint"])
    return map_arrow(slim, run, schema)


def message_tokens(messages: DataFrame, conversations: DataFrame, token_files: DataFrame, sources: DataFrame, tokenizer_dir: str = TOKENIZER_DIR) -> DataFrame:
    """(msg_id, source_name, lang, domain, tokenizer, n_tokens): one row for each message, however often delivered.

    Tokenizer, source, language and domain are those of the message's conversation; languages and domains in one spelling.
    Of a conversation's deliveries the latest counts. Messages without a conversation keep null for all of them; those without a
    conv_id are spread by msg_id. Only the conversation side is built into hash tables; the texts are moved once and not
    sorted. Token files and sources are catalogues of fixed size, which the session's broadcast threshold checks.
    """
    files = token_files.select("file_id", tokenizer_name(F.col("tokenizer_source"), F.col("vocab_ceiling")).alias("tokenizer"))
    names = sources.select("source_id", "source_name")
    times = [c for c in ("ingested_at", "created_at") if c in conversations.columns]
    own = F.struct("file_id", "source_id", language(F.col("lang")).alias("lang"), F.lower(F.trim("domain")).alias("domain"))
    talks = (
        conversations.where("conv_id is not null").groupBy("conv_id").agg(F.max_by(own, F.struct(*times, "file_id", "source_id", "lang", "domain")).alias("c"))
        .select("conv_id", "c.*").join(files, "file_id", "left").join(names, "source_id", "left")
        .select("conv_id", F.lit(0).alias("salt"), "source_name", "lang", "domain", "tokenizer")
    )
    salt = F.when(F.col("conv_id").isNull(), F.pmod(F.xxhash64("msg_id"), F.lit(4096)).cast("int")).otherwise(0)
    texts = messages.select("msg_id", "conv_id", salt.alias("salt"), "content")
    joined = texts.join(talks.hint("shuffle_hash"), ["conv_id", "salt"], "left").drop("conv_id", "salt")
    counted = count_tokens(joined, "content", "tokenizer", tokenizer_dir=tokenizer_dir)
    return counted.dropDuplicates(["msg_id"])


def budget_cube(counts: DataFrame) -> DataFrame:
    """Messages and tokens of every slice of the cube source x language x domain.

    ``slice`` names the columns by which a row is grouped ('all' for the grand total), so a null value of a grouped column
    differs from a subtotal. Messages without a tokenizer count as messages, not as tokens.
    """
    dims = ["source_name", "lang", "domain"]
    leaves = counts.groupBy(*dims).agg(F.count(F.lit(1)).alias("n"), F.sum("n_tokens").alias("t"))
    grouped = F.concat_ws(",", *[F.when(F.grouping(c) == 0, F.lit(c)) for c in dims])
    cube = leaves.cube(*dims).agg(
        F.when(grouped == "", "all").otherwise(grouped).alias("slice"),
        F.sum("n").alias("n_messages"), F.coalesce(F.sum("t"), F.lit(0)).alias("n_tokens"),
    )
    return cube.select("slice", *dims, "n_messages", "n_tokens")
