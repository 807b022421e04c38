"""Small cases of each operator: nulls, empties, long texts, ties, repeats, empty tables, and brute force where SQL has no word."""

import random
import re

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sparkprep.llm import answer_defects, char_models, encode, fill_rows, near_duplicates, personal_data, prefix_bpe, queries, set_sketch, split_long, tagger, text_stats, token_budget

from ..compare import duck, rows

COMMON = frozenset("the of a and in on to is die der und le la de que el en".split())


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_same_rows_as_sql(spark, data, name):
    got, want = queries.queries()[name](spark, data).toPandas(), duck(data).sql(queries.oracle_sql()[name]).df()
    assert rows(got) == rows(want)


@pytest.mark.parametrize("name", sorted(queries.queries()))
def test_queries_run(spark, data, name):
    df = queries.queries()[name](spark, data)
    assert len(set(df.columns)) == len(df.columns) and df.count() > 0


# 1 pairs ---------------------------------------------------------------------------------------------------------------

MSG = "msg_id bigint, conv_id bigint, turn int, role string, content string, who string, question string"


def test_pairs_and_defects(spark):
    q = "How do I find out whether the loader keeps the running average of the second file?"
    long = "The loader keeps the average in every run. The packer copies the leftover tokens, and the reader "
    table = [
        (1, 1, 0, "user", q), (2, 1, 1, "tool", "ok"), (3, 1, 2, "assistant", None), (4, 1, 3, "bot", "​ \n"), (5, 1, 4, "gpt", "I'm sorry, but I can't help with this. Please ask someone qualified."),
        (6, 1, 5, "assistant", q.upper()), (7, 1, 6, "assistant", long + "pads the trail"), (8, 1, 7, "assistant", "Yes."), (8, 1, 7, "assistant", "Yes."),
        (9, 1, 8, "assistant", "<think>" + long + "</think>\n"), (10, 2, 0, "assistant", None), (11, 2, 1, "user", None), (12, 2, 2, "assistant", "Set it to 5 and restart."),
        (13, 1, 9, "assistant", "Der Packer verwirft die leere Zeile. Die Prüfung des Kopfes zählt die übrigen Tokens, und der Leser puffert die längste Anfrage."), (14, None, None, None, None),
        (15, 1, 10, "assistant", "Run it:\n```\nfor x in range(3):\n    print(x"), (16, 1, 11, "assistant", q + "\n\nNo, the reader drops it before the second pass."),
    ]
    df = spark.createDataFrame([(*r, "x", "y") for r in table], MSG)
    found = {r.msg_id: r.defect for r in answer_defects.answer_defects(df, COMMON).collect()}
    assert found == {3: "empty", 4: "empty", 5: "refusal", 6: "echo", 7: "truncated", 9: "empty", 13: "wrong_language", 15: "truncated"}
    assert answer_defects.answer_defects(df.limit(0), COMMON).count() == 0


@pytest.mark.parametrize("text", ["That is a question I leave to professionals.", "Sorry, this is not something I do.", "As an AI language model, that request goes beyond my limits.", "Dazu möchte ich mich nicht äußern.", "Je ne peux pas t'aider sur ce point."])
def test_refusals_in_other_words(text):
    assert answer_defects.is_refusal(text)


@pytest.mark.parametrize("text", ["Sorry, the loader can't open the file because the path is wrong.", "You cannot pass a null here.", "The reader keeps the file. I can't help you with the rest.", "", "Yes."])
def test_answers_that_are_no_refusals(text):
    assert not answer_defects.is_refusal(text)


def test_truncation_is_the_models():
    model = char_models.load()
    cut = "The loader keeps the average in every run. The packer copies the leftover tokens of the"
    assert answer_defects.truncation(cut, model) == "sentence"
    assert answer_defects.truncation(cut, char_models.CharModels(model.table, *[x[:1] for x in (model.keys, model.ends, model.seen)])) is None


def test_refusals_of_any_length():
    text = "I'm sorry, but I can't help with this. Please ask someone qualified."
    assert answer_defects.is_refusal(text) and answer_defects.is_refusal(" ".join([text] * 9))
    assert not answer_defects.is_refusal(" ".join([text] * 9) + " The loader keeps the running average of the second file in every run.")


def test_informal_answers_of_two_sentences_are_complete():
    models = char_models.load()
    for text in ("Sure. Use the second one", "Sí. Usa el segundo", "Yes. Set it to five and restart"):
        assert answer_defects.truncation(text, models) is None
    long = "The loader keeps the average in every run, and the packer copies the leftover tokens of it. The reader pads the"
    assert answer_defects.truncation(long, models) == "sentence"


def test_long_conversations_are_cut_into_blocks(spark, monkeypatch):
    monkeypatch.setattr(answer_defects, "TURNS", 4)
    df = spark.createDataFrame([(i, 1, i, "user" if i in (0, 9) else "assistant", f"c{i}", "", "") for i in range(12)], MSG)
    got = {r.msg_id: r.question for r in answer_defects.answer_pairs(df).collect()}
    assert got == {i: "c0" if i < 9 else "c9" for i in range(1, 12) if i != 9}


# 2 near-duplicates -----------------------------------------------------------------------------------------------------


def _edited(words, rng, n):
    out = list(words)
    for _ in range(n):
        at = rng.randrange(len(out))
        out[at : at + 1] = rng.choice([[], ["new" + str(rng.randrange(99))], [out[at], "more"]])
    return out


def test_pairs_match_brute_force(spark):
    rng, texts = random.Random(4), []
    for _ in range(25):
        base = [f"w{rng.randrange(400)}" for _ in range(rng.randint(60, 160))]
        texts += [" ".join(_edited(base, rng, n)) for n in (0, 0, 2, 6, 12, 25)]
    table = [(i, "user" if i % 5 else "assistant", t) for i, t in enumerate(texts)] + [(900, "user", None), (901, "user", ""), (902, None, texts[0]), (903, "user", "too short")]
    df = spark.createDataFrame(table + table[:40], "k bigint, g string, t string").withColumn("c", F.lit("clash"))
    got = {(r.a, r.b) for r in near_duplicates.near_duplicate_pairs(df, "k", F.col("g"), "t").collect()}

    def grams(t):
        w = re.findall(r"[^\W_]+", (t or "").lower())
        return set(zip(w, w[1:], w[2:])) if len(set(w)) >= 40 else set()

    sets = {k: grams(t) for k, g, t in table if g}
    side = {k: g for k, g, _ in table}
    want = {(a, b): j for a in sets for b in sets if a < b and side[a] == side[b] and sets[a] and sets[b] and (j := len(sets[a] & sets[b]) / len(sets[a] | sets[b])) >= 0.5}
    assert got <= set(want)
    assert len(got) >= 0.97 * len(want) and all(p in got for p, j in want.items() if j >= 0.75)
    assert near_duplicates.near_duplicate_pairs(df.limit(0), "k", F.col("g"), "t").count() == 0


def _similar_sets(rng, count, common, own):
    """Classes of random sets that share ``common`` of their hashes."""
    shared = rng.integers(0, 1 << 32, common, np.uint32)
    return [np.unique(np.concatenate([shared, rng.integers(0, 1 << 32, own, np.uint32)])) for _ in range(count)]


def test_few_unlike_texts_with_common_sequences_are_moved():
    sets = _similar_sets(np.random.default_rng(3), 300, 20, 80) + _similar_sets(np.random.default_rng(4), 60, 80, 20)  # similarity 0.11, 0.67
    sizes, regs = near_duplicates._sketched([x.tobytes() for x in sets], 128)
    bits = set_sketch.pack_bits(regs, near_duplicates.PLANES)
    row = np.zeros(len(sets), near_duplicates._row_type(bits.shape[1]))
    row["c"], row["n"], row["bits"] = np.arange(len(sets)) << 16, sizes, bits
    a, b = near_duplicates._likely(row, *np.triu_indices(300, 1), 0.5, 3.0)
    assert len(a) < 0.001 * 300 * 299 / 2  # with one bit of each register some 4 %
    i, j = np.triu_indices(60, 1)
    assert len(near_duplicates._likely(row, 300 + i, 300 + j, 0.5, 3.0)[0]) == len(i)


def test_only_shared_bands_are_moved():
    rng = np.random.default_rng(6)
    sets = _similar_sets(rng, 40, 0, 100) + _similar_sets(rng, 2, 90, 10)
    names = [(i << 16) + 5 for i in range(len(sets))]
    batch = pa.RecordBatch.from_arrays([pa.array(names), pa.array([b""] * len(sets), pa.binary()), pa.array([x.tobytes() for x in sets], pa.binary())], ["c", "ids", "items"])
    keys = pa.Table.from_batches(list(near_duplicates._key_rows(iter([batch]), 28, 3, 128, 7))).sort_by("p")
    shared = pa.Table.from_batches(list(near_duplicates._shared_bands(iter(keys.to_batches())))).to_pylist()
    bands = {c: 0 for c in names[-2:]}
    for r in shared:
        bands[r["c"]] |= r["shared"]
    _, regs = near_duplicates._sketched([x.tobytes() for x in sets[-2:]], 128)
    same = sum(1 << b for b in range(28) if (regs[0, 3 * b : 3 * b + 3] == regs[1, 3 * b : 3 * b + 3]).all())
    assert set(bands.values()) == {same} and same and len(bands) == 2


def test_large_groups_and_buckets_lose_no_link(spark, monkeypatch):
    words = [f"w{i}" for i in range(80)]
    df = spark.createDataFrame([(i, "user", " ".join(words)) for i in range(30)] + [(100 + i, "user", " ".join([*words, f"x{i}"])) for i in range(20)], "k bigint, g string, t string")
    monkeypatch.setattr(near_duplicates, "BLOCK", 4)
    full = {(r.a, r.b) for r in near_duplicates.near_duplicate_pairs(df, "k", F.col("g"), "t").collect()}
    assert len(full) == 50 * 49 // 2
    star = {(r.a, r.b) for r in near_duplicates.near_duplicate_pairs(df, "k", F.col("g"), "t", expanded=10).collect()}
    assert {(0, i) for i in range(1, 30)} <= star and {(0, 100 + i) for i in range(20)} <= star and len(star) == 29 + 20 + 190


def test_every_pair_of_a_class_over_256_members(spark):
    words = [f"w{i}" for i in range(80)]
    many = [(3 * i, "user", ("; " if i % 2 else " ").join(words)) for i in range(600)]  # equal sequences, two raw texts
    df = spark.createDataFrame([*many, (1, "user", " ".join([*words, "x"])), (2, "assistant", " ".join(words))], "k bigint, g string, t string")
    pairs = [(r.a, r.b) for r in near_duplicates.near_duplicate_pairs(df, "k", F.col("g"), "t").collect()]
    keys = sorted([1, *(k for k, _, _ in many)])
    assert sorted(pairs) == [(a, b) for i, a in enumerate(keys) for b in keys[i + 1 :]]
    messages = df.select(F.col("k").alias("msg_id"), F.col("g").alias("role"), F.col("t").alias("content"))
    assert near_duplicates.message_pairs(messages).count() == len(pairs)


def _joined(pairs):
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in pairs:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    return {x: find(x) for x in root}


def test_components_match_union_find(spark):
    rng = random.Random(8)
    chain = [(i, i + 1) for i in range(100, 160)] + [(170, i) for i in range(171, 190)]
    edges = [(rng.randrange(90), rng.randrange(90)) for _ in range(50)] + [(b, a) for a, b in chain]
    edges = [(a, b) for a, b in edges if a != b]
    got = near_duplicates.components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()
    assert {(r.v, r.root) for r in got} == set(_joined(edges).items()) and len(got) == len({r.v for r in got})
    assert near_duplicates.components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def test_groups_are_those_of_the_pairs(spark):
    rng, table = random.Random(5), []
    for g in range(6):
        words = [f"g{g}w{i}" for i in range(60)]
        for step in range(8):  # each text is near the one before, the last one not near the first
            table += [(rng.randrange(1 << 40), "user", " ".join(words)) for _ in range(1 + g % 3)]
            words = [*words[9:], *(f"g{g}s{step}n{i}" for i in range(9))]
    table += [(1, "assistant", table[0][2]), (2, "user", " ".join(f"lone{i}" for i in range(60))), (3, "user", None)]
    df = spark.createDataFrame(table + table[:5], "k bigint, g string, t string")
    pairs = {(r.a, r.b) for r in near_duplicates.near_duplicate_pairs(df, "k", F.col("g"), "t").collect()}
    want, links = _joined(pairs), [x for p in pairs for x in p]
    got = near_duplicates.near_duplicate_groups(df, "k", F.col("g"), "t").collect()
    assert {(r.k, r.group_id, r.n_links) for r in got} == {(x, g, links.count(x)) for x, g in want.items()} and len(got) == len(want)
    assert near_duplicates.near_duplicate_groups(df.limit(0), "k", F.col("g"), "t").count() == 0


def test_sketches_merge_and_estimate():
    rng = np.random.default_rng(1)
    a, b = (rng.choice(1 << 32, 900, replace=False).astype(np.uint32) for _ in range(2))
    x, y = np.concatenate([a[:600], a[600:]]), np.concatenate([a[:600], b[:300]])
    k = set_sketch.registers(np.concatenate([x, y]), np.array([0, 900]), 1024)
    both = set_sketch.registers(np.unique(np.concatenate([x, y])), np.array([0]), 1024)
    assert (set_sketch.merge(k[0], k[1]) == both[0]).all()
    j = set_sketch.joint_jaccard(k[:1], k[1:], np.array([900]), np.array([900]))[0]
    assert abs(j - 0.5) < 0.06
    bits = set_sketch.pack_bits(k)
    assert abs(set_sketch.bit_matches(bits[:1], bits[1:])[0] / 1024 - 0.75) < 0.06


# 3 statistics ----------------------------------------------------------------------------------------------------------

PROSE = "The reader keeps the file in the second pass, and the packer copies a row of the table. It is the end of the run."
LIST = "\n".join(f"- the {w} of the run" for w in ("reader", "packer", "loader", "table", "file", "header"))
TABLE = "\n".join(["| name | size | step |", "| --- | --- | --- |", *(f"| row{i} | {i * 37} | {i / 7:.3f} |" for i in range(8))])
JUNK = "q9Zk+/A7bX" * 60


@pytest.mark.parametrize("text, kind", [(PROSE, "prose"), (LIST, "list"), (TABLE, "table"), (JUNK, "junk"), (PROSE[:30] + "\n" + TABLE, "table"), ("", "short"), ("x" * 39, "short"), ("hahaha " * 50, "junk")])
def test_kinds(text, kind):
    assert text_stats.verdicts([text], COMMON, text_stats.load()) == [kind]


def test_statistics(spark):
    assert text_stats.statistics("", COMMON) == (0, 0, 0, 0, 0)
    n, mean, symbols, ended, common = text_stats.statistics("The cat.\nab c", COMMON)
    assert (n, mean, ended, common) == (4, 9 / 4, 0.5, 0.25) and abs(symbols - 0.1) < 1e-9
    df = spark.createDataFrame([(1, None), (2, ""), (3, " \n"), (4, PROSE), (4, PROSE)], "k bigint, t string").withColumn("kind", F.lit("clash"))
    got = [(r.k, r.kind) for r in text_stats.text_quality(df, "k", "t", COMMON).collect()]
    assert got == [(1, "short"), (2, "short"), (3, "short"), (4, "prose"), (4, "prose")]
    assert text_stats.text_quality(df.limit(0), "k", "t", COMMON).count() == 0


# 4 splitting -----------------------------------------------------------------------------------------------------------

pieces = st.lists(st.tuples(st.integers(0, 60), st.sampled_from([" ", "\n", "\n\n", ". ", "", "\r\n", "  ", "? "])), min_size=1, max_size=60)


@settings(max_examples=300, deadline=None)
@given(pieces)
def test_split_properties(parts):
    text = "".join("a" * n + s for n, s in parts)
    out = split_long.split_text(text, 50, 10)
    assert out[0][0] == 0 and out[-1][1] == len(text) and all(b - a <= 50 for a, b, _ in out)
    for (a, b, kind), (c, d, _) in zip(out, out[1:]):
        assert a < c <= b < d and b - c <= 10 and (kind == 5 or text[b - 1].isspace() or text[b].isspace())
    assert any(k == 5 for _, _, k in out) == any(len(m) > 50 for m in re.findall(r"[^ \t\r\n]+", text) if len(text) > 50)


def test_split_rows(spark):
    df = spark.createDataFrame([(1, None), (2, ""), (3, "a" * 2000), (4, "a" * 2001), (5, "😀 " * 1500)], "k bigint, t string")
    out = split_long.split_oversized(df, "k", "t").orderBy("k", "piece_no").collect()
    assert {r.k for r in out} == {4, 5} and all(len(r.piece) == r.end - r.begin <= 2000 for r in out)
    assert {r.k: r.cut_kind for r in split_long.cut_kinds(split_long.split_oversized(df, "k", "t"), "k").collect()} == {4: "forced", 5: "natural"}


# 5 and 6 tokens --------------------------------------------------------------------------------------------------------


def test_prefix_encoding_is_the_tokenizers():
    import base64

    import tiktoken

    with open("/opt/tokenizers/byte_bpe_50k.tiktoken", "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    reference = tiktoken.Encoding("own", pat_str=prefix_bpe.SPLIT_PATTERN, mergeable_ranks=ranks, special_tokens={})
    bpe, rng = prefix_bpe.load(), random.Random(7)
    parts = ["a", "the", "ing", " ", "  ", "\n", "é", "語", "😀", "12", "'s", "aaaa", "==", "<|endoftext|>", "\x00", " "]
    for _ in range(400):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 60)))
        assert bpe.encode(text).tolist() == reference.encode_ordinary(text)
        assert bpe.count(text) == len(reference.encode_ordinary(text))
    for text in ("a" * 50_000, "ab" * 20_000, " " * 9_000, "the" * 9_000):
        assert bpe.encode(text).tolist() == reference.encode_ordinary(text)


def test_ids_of_null_and_empty(spark):
    df = spark.createDataFrame([(1, None), (2, ""), (3, "<|endoftext|>"), (3, "<|endoftext|>")], "doc_id bigint, text string").withColumn("ids", F.lit("clash"))
    got = [(r.doc_id, r.ids) for r in encode.encode_texts(df, "doc_id", "text").collect()]
    assert got[:2] == [(1, []), (2, [])] and got[2] == got[3] and 50256 not in got[2][1] and len(got[2][1]) > 1
    assert encode.encode_texts(df.limit(0), "doc_id", "text").count() == 0


def test_budget(spark):
    messages = spark.createDataFrame([(1, 1, "hello world"), (1, 1, "hello world"), (2, 1, None), (3, 2, "Hello"), (4, 9, "lost"), (5, 3, "x")], "msg_id bigint, conv_id bigint, content string")
    talks = spark.createDataFrame([(1, 1, 1, "EN", " Code"), (1, 1, 1, "EN", " Code"), (2, 2, 1, "english", None), (3, 3, 2, "und", "math")], "conv_id bigint, file_id int, source_id int, lang string, domain string")
    files = spark.createDataFrame([(1, " Byte-BPE-50k ", 50257), (2, None, 49408), (3, "other", 7)], "file_id int, tokenizer_source string, vocab_ceiling int")
    sources = spark.createDataFrame([(1, "s1"), (2, "s2")], "source_id int, source_name string")
    counts = token_budget.message_tokens(messages, talks, files, sources)
    got = {r.msg_id: (r.tokenizer, r.lang, r.domain, r.n_tokens) for r in counts.collect()}
    assert got == {1: ("byte_bpe_50k", "en", "code", 2), 2: ("byte_bpe_50k", "en", "code", 0), 3: ("word_bpe_49k", "en", None, 1), 4: (None, None, None, None), 5: (None, None, "math", None)}
    cube = {(r.slice, r.source_name, r.lang, r.domain): (r.n_messages, r.n_tokens) for r in token_budget.budget_cube(counts).collect()}
    assert cube["all", None, None, None] == (5, 3) and cube["source_name", "s1", None, None] == (3, 3) and cube["lang", None, "en", None] == (3, 3)


# 7 filling -------------------------------------------------------------------------------------------------------------


@settings(max_examples=150, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 100), st.integers(0, 3), st.integers(0, 5)), min_size=1, max_size=120))
def test_shards_fit(items):
    size = np.array([i[0] for i in items], np.int64)
    source, cluster = (np.array([i[k] for i in items], np.int64) for k in (1, 2))
    bins = fill_rows.pack_shard(np.arange(len(items)), size, source, cluster, 100)
    load = np.bincount(bins, size)
    assert load.max() <= 100 and len(bins) == len(items)
    held = [(b, c) for b, c, n in zip(bins.tolist(), cluster.tolist(), size.tolist()) if n]
    assert len(held) == len(set(held))  # no row has two members of a cluster
    most = max(np.bincount(cluster[size > 0]), default=0)
    assert len(load) <= 2 * -(-int(size.sum()) // 100) + 1 + most
    strict = fill_rows.pack_shard(np.arange(len(items)), size, source, cluster, 100, apart=True)
    held = [(b, s) for b, s, n in zip(strict.tolist(), source.tolist(), size.tolist()) if n]
    assert len(held) == len(set(held))


def test_copies_are_kept_apart():
    size = np.array([40] * 4 + [30] * 8 + [20] * 6)
    cluster = np.array([1] * 4 + list(range(10, 18)) + list(range(20, 26)))
    bins = fill_rows.pack_shard(np.arange(18), size, np.zeros(18, np.int64), cluster, 100)
    assert len(set(bins[:4])) == 4 and bins.max() + 1 == -(-size.sum() // 100)
    six = fill_rows.pack_shard(np.arange(6), np.full(6, 1000), np.zeros(6, np.int64), np.ones(6, np.int64), 2048)
    assert len(set(six)) == 6


def test_clusters_of_texts():
    same = {fill_rows.text_cluster(t) for t in ("The run, is OK.", "the RUN is ok", "  the run\nis - ok!")}
    assert len(same) == 1 and fill_rows.text_cluster("the run is not ok") not in same
    assert fill_rows.text_cluster(None) is fill_rows.text_cluster("") is fill_rows.text_cluster(" ... ") is None


def test_rows_do_not_depend_on_partitions(spark, monkeypatch):
    monkeypatch.setattr(fill_rows, "SHARD_TOKENS", 4000)
    df = spark.createDataFrame([(i, i * 37 % 700 + 1, f"s{i % 3}", i // 2) for i in range(200)], "k bigint, n bigint, s string, c bigint")
    got = [{(r.k, r.piece_no): (r.row_id, r.slot) for r in fill_rows.pack_rows(df.repartition(n), "k", "n", "s", "c").collect()} for n in (1, 3, 11)]
    assert got[0] == got[1] == got[2] and len({row >> 40 for row, _ in got[0].values()}) > 5


def test_rows_of_oversized_and_empty(spark):
    df = spark.createDataFrame([(1, 5000, "a", 1), (2, 0, None, 2), (3, None, "b", None), (4, 2048, "a", 4), (5, 100, "a", 5), (None, 7, "a", 5)], "k bigint, n bigint, s string, c bigint")
    out = fill_rows.pack_rows(df, "k", "n", "s", "c").collect()
    per = {}
    for r in out:
        per.setdefault(r.k, []).append((r.first_token, r.n_tokens))
    assert sorted(per[1]) == [(0, 2048), (2048, 2048), (4096, 904)] and per[4] == [(0, 2048)] and per[2] == per[3] == [(0, 0)]
    load = {}
    for r in out:
        load[r.row_id] = load.get(r.row_id, 0) + r.n_tokens
    assert max(load.values()) <= 2048
    assert fill_rows.pack_rows(df.limit(0), "k", "n", "s", "c").count() == 0


# 8 personal data -------------------------------------------------------------------------------------------------------


def test_mentions(spark):
    text = "Please contact Taryn Bexgrove at taryn.bexgrove@quillmail.example.\nCall +1 305 555 0148 if the run stalls.\nThe manifest check keeps the end token."
    df = spark.createDataFrame([(1, text), (2, None), (3, ""), (4, "step 60281 | loss 5.2358 | lr 5.73e-01"), (5, "x" * 50_000)], "k bigint, t string").withColumn("kind", F.lit("clash"))
    got = {(r.k, r.kind, r.start_pos) for r in personal_data.mentions(df, "k", "t").collect()}
    assert got == {(1, "person", 15), (1, "email", 33), (1, "phone", 72)}
    clean = {r.k: (r.redacted, r.n_mentions) for r in personal_data.redact(df, "k", "t").collect()}
    assert clean[1][0].startswith("Please contact [PERSON] at [EMAIL].\nCall [PHONE] if") and clean[2] == (None, 0) and clean[4][1] == 0 and clean[5] == ("x" * 50_000, 0)
    assert personal_data.mentions(df.limit(0), "k", "t").count() == 0


def test_names_of_known_words_are_kept():
    finder, known = personal_data.load(), frozenset(("costa", "long", "petit", "please", "yesterday"))
    assert "wexsend" not in finder.known
    for text, name in (
        ("The merge table, says Gareth Wexsend, keeps every sample.", "Gareth Wexsend"), ("We owe the crop routine to Edmund Wexsend and to nobody else.", "Edmund Wexsend"),
    ):
        assert finder.find([text]) == [[(text.index(name), text.index(name) + len(name), "person")]]
    for text, name in (("Marta Costa", "Marta Costa"), ("LONG PETIT", "LONG PETIT"), ("Yesterday Marta Costa", "Marta Costa"), ("please marta ozur", "marta ozur"), ("Marta Costa left", "Marta Costa")):
        assert personal_data._checked(text, [(0, len(text), 0)], known) == [(text.index(name), text.index(name) + len(name), "person")]
    text = "der Long Petit und die Maske. Der Long, Die Petit"
    finder = personal_data.Finder.__new__(personal_data.Finder)
    finder.known = frozenset(text.lower().replace(".", "").replace(",", "").split())
    assert finder.cues(text) == [(4, 14)]


def test_unspaced_fields_are_searched():
    log = '{"run":{"id":"cbf0","step":"60281"},"loss":"5.2358","rows":["a","b"],"contact":{"phone":"+1-305-555-0148","mail":"x@quillmail.example"},"ok":true}'
    query = "https://host.example/load?table=merge&step=60281&mode=full&keep=tokens&source=web&cache=no&phone=+1-305-555-0148&ok=true&more=" + "a" * 90
    finder = personal_data.load()
    for text in (log, query):
        assert (text.index("+1-"), "phone") in [(a, kind) for a, _, kind in finder.find([text])[0]], text
    chinese = "数据" * 60
    assert finder.regions(chinese, finder.cues(chinese)) == [(0, 120)]
    blob = "aGVsbG8gd29ybGQ5555" * 20
    assert finder.regions(blob, finder.cues(blob)) == []


def test_every_character_is_decoded(monkeypatch):
    finder, seen = personal_data.load(), []
    scores = finder.model.scores
    monkeypatch.setattr(finder.model, "scores", lambda x, n: (seen.extend(r[:k] for r, k in zip(x, n)), scores(x, n))[1])
    # no cue in the prose, none in the blob
    texts = ["the run is long and the file is small. " * 40, "", "a", "aGVsbG8gd29ybGQ5555" * 40, "the row of the table " * 20 + "Write to runs+jo@quillmail.example today. " + "the row of the table " * 20]
    assert not finder.regions(texts[0], finder.cues(texts[0])) and not finder.regions(texts[3], finder.cues(texts[3]))
    assert [[m[2] for m in own] for own in finder.find(texts)] == [[], [], [], [], ["email"]]
    step = personal_data.DECODED - personal_data.OVERLAP
    whole = [finder.symbols(t, 0, len(t)) for t in texts]
    want = [x[a : a + personal_data.DECODED].tobytes() for x in whole for a in range(0, len(x), step) if a == 0 or a + personal_data.OVERLAP < len(x)]
    assert sorted(want) == sorted(x.tobytes() for x in seen)


def test_a_mention_of_blanks_at_the_end_is_none():
    assert personal_data._checked("call me ", [(7, 8, 2)], frozenset()) == []


def test_scores_and_best_paths_of_the_tagger():
    model, rng = personal_data.load().model, np.random.default_rng(2)
    lengths = np.sort(rng.integers(1, 60, 40))
    x = rng.integers(0, tagger.N_CLASSES * tagger.N_FLAGS, (40, int(lengths[-1]))).astype(np.int32)
    mask = (np.arange(x.shape[1]) < lengths[:, None]).astype(np.float32)
    e = model.emissions(x, mask)
    got = model.scores(x, lengths).transpose(2, 0, 1)
    assert np.abs((got - e) * mask[:, :, None]).max() < 1e-3
    tags, _ = model.viterbi(e, lengths)
    best = tagger.path_log_odds(model, e, lengths, tags)
    for _ in range(30):  # no path that differs in a stretch is better
        other, row, a = tags.copy(), rng.integers(40), rng.integers(60)
        other[row, a : a + rng.integers(1, 9)] = rng.integers(0, tagger.N_TAGS)
        other = np.where(mask > 0, other, 0)
        assert (tagger.path_log_odds(model, e, lengths, other) <= best + 1e-3).all()
    held = model.may_hold(e.transpose(1, 2, 0), lengths)
    assert not tags[~held].any()
    assert not model.may_hold(e.transpose(1, 2, 0) + np.eye(tagger.N_TAGS)[0][:, None] * 99, lengths).any()


def test_scores_of_many_windows_of_mixed_lengths():
    model, rng = personal_data.load().model, np.random.default_rng(3)
    n = 2 * tagger.TOGETHER + 5
    for lengths in (np.sort(rng.integers(1, 30, n)), np.full(n, 20)):
        x = rng.integers(0, tagger.N_CLASSES * tagger.N_FLAGS, (n, int(lengths[-1]))).astype(np.int32)
        mask = (np.arange(x.shape[1]) < lengths[:, None]).astype(np.float32)
        got = model.scores(x, lengths).transpose(2, 0, 1)
        assert np.abs((got - model.emissions(x, mask)) * mask[:, :, None]).max() < 1e-3
        held = model.may_hold(got.transpose(1, 2, 0), lengths)
        assert not model.viterbi(got, lengths)[0][~held].any()


def test_best_paths_are_sought_only_where_a_mention_may_begin(monkeypatch):
    finder, seen = personal_data.load(), []
    viterbi = finder.model.viterbi
    monkeypatch.setattr(finder.model, "viterbi", lambda e, n: (seen.append(len(n)), viterbi(e, n))[1])
    prose = "the row of the table " * 60
    assert finder.find([prose]) == [[]] and not seen
    assert [m[2] for m in finder.find([prose + "Write to runs+jo@quillmail.example today."])[0]] == ["email"] and seen


def test_symbols_of_texts_from_their_pieces():
    finder = personal_data.Finder()
    texts = ["", " ", "  a", "Frau Müller-Lüdenscheidt  wohnt\nhier\tund dort. ", "camelCaseWORDSomething x9y ŒUVRE", "数据 \U0001f600\u00a0x\ud800", "aGVsbG8gd29ybGQ5555" * 40]
    for size in (0, 10**9):  # kept from before, and dropped
        finder.pieces_size = size
        for text, got in zip(texts, finder.all_symbols(texts), strict=True):
            want = finder.symbols(text, 0, len(text)) if text else np.zeros(0, np.int32)
            assert got.tolist() == want.tolist(), text
    assert finder.pieces_size < 10**6


def test_reconciling_windows():
    spans = [(0, 5, 0, 2.0), (3, 9, 1, 5.0), (9, 12, 0, 1.0), (0, 5, 0, 2.5)]
    assert personal_data.reconcile(spans) == [(3, 9, 1), (9, 12, 0)]
    assert personal_data.reconcile([]) == []


def test_gradient_of_the_tagger():
    rng = np.random.default_rng(2)
    model = tagger.Tagger.fresh(4, 3)
    model.p = {k: v.astype(np.float64) for k, v in model.p.items()}
    x = rng.integers(0, 300, (3, 6))
    y = np.array([[0, 1, 2, 0, 3, 0], [1, 2, 2, 0, 0, 0], [0, 0, 5, 6, 0, 0]])
    lengths, ban = np.array([6, 4, 5]), tagger.allowed().astype(np.float64)
    _, grad = tagger._gradient(model, x, y, lengths, ban)
    for name, place in (("Wh0", (1, 5)), ("Wh1", (2, 3)), ("Wx0", (0, 9)), ("W", (3, 2)), ("T", (0, 1)), ("E", (int(x[0, 1]), 1)), ("b1", (6,)), ("c", (2,))):
        old = model.p[name][place]
        values = []
        for step in (1e-3, -1e-3):
            model.p[name][place] = old + step
            values.append(tagger._gradient(model, x, y, lengths, ban)[0])
        model.p[name][place] = old
        assert abs((values[0] - values[1]) / 2e-3 - grad[name][place]) < 2e-3, name
