"""Edge cases of the core operators: nulls, empties, ties, repeats, empty tables, other columns."""

import pytest
from pyspark.sql import functions as F

from sparkprep import plans
from sparkprep.functions import vectors as V
from sparkprep.operators import context, messages as M, metadata as MD, metrics, mixing, packing

MSG = "msg_id bigint, conv_id bigint, turn int, role string, content string, kept string"


def messages(spark, rows):
    return spark.createDataFrame(rows, MSG)


def test_messages_edge(spark):
    rows = [(1, 1, 0, "human", "q", "x"), (1, 1, 0, "human", "q", "y"), (2, 1, 1, None, "a", ""), (3, 1, 2, "gpt", None, ""), (4, 1, 3, "bot", " ", ""), (5, 1, 4, "tool", "t", ""), (6, None, None, "user", "z", None)]
    out = M.normalize(M.delivered_once(messages(spark, rows)))
    assert sorted((r.msg_id, r.role, r.content) for r in out.collect()) == [(1, "user", "q"), (4, "assistant", " "), (5, "tool", "t"), (6, "user", "z")]
    prompts = {r.conv_id: r.prompt for r in M.render_prompt(out).collect()}
    assert prompts[1] == "<|user|>q<|end|><|assistant|> <|end|><|assistant|>"
    empty = M.delivered_once(messages(spark, []))
    assert M.crop(M.segments(M.normalize(empty)), 10).count() == 0


@pytest.mark.parametrize("limit, status, kept", [(100, "ok", None), (13, "ok", 13), (12, "ok", 12), (5, "overflow", None)])
def test_crop_drops_the_earliest_reasoning(spark, limit, status, kept):
    rows = [(1, 1, 0, "user", "a b", ""), (2, 1, 1, "assistant", "t u v</think>x y", "")]
    out = M.crop(M.segments(M.normalize(messages(spark, rows))), limit).collect()
    assert {r.status for r in out} == {status}
    total = sum(r.n_tokens for r in out)
    if kept is not None and kept < total:
        assert sum(r.kept for r in out) == kept
    assert all(r.kept == r.n_tokens for r in out if r.segment != "think")


def test_skip_without_answer(spark):
    out = M.crop(M.segments(M.normalize(messages(spark, [(1, 1, 0, "user", "a", "")]))), 10)
    assert {r.status for r in out.collect()} == {"skip"}


def test_label_mask_and_shift(spark):
    df = spark.createDataFrame([([5, 6, 7], [0, 1, 1]), ([], []), (None, None)], "ids array<int>, mask array<int>")
    got = df.select(M.label_mask(F.col("ids"), F.col("mask")), M.label_mask(F.col("ids"), F.col("mask"), 1)).collect()
    assert tuple(got[0]) == ([-100, 6, 7], [6, 7, -100]) and got[1][0] == [] and got[2][0] is None


def test_global_rank_orders_all_rows(spark):
    df = spark.createDataFrame([(i * 37 % 1001 - 500,) for i in range(1001)] + [(None,)], "k bigint")
    got = [r.k for r in M.global_rank(df, "k").orderBy("rank").collect()]
    assert got == [None, *range(-500, 501)]
    assert M.global_rank(df.limit(0), "k").count() == 0


@pytest.mark.parametrize("n, pieces", [(0, 0), (63, 0), (64, 1), (7800, 1), (7863, 1), (7864, 2), (15600, 2)])
def test_chunk_sizes(spark, n, pieces):
    docs = spark.createDataFrame([(1, "s", " a" * n)], "doc_id bigint, source string, text string")
    assert mixing.chunks(docs).count() == pieces


def test_mix_budget(spark):
    tokens = spark.createDataFrame([(i, "s" if i % 2 else None, 10) for i in range(100)], "doc_id bigint, source string, n bigint")
    known = tokens.where("source is not null")
    out = mixing.budgeted_mix(known, F.lit(95)).collect()
    assert sum(r.n for r in out) == 100 and max(r.before for r in out) == 90
    assert mixing.budgeted_mix(known, F.lit(0)).count() == 0 and mixing.budgeted_mix(known, F.lit(10**6)).count() == 50


def test_samples_and_splits(spark):
    docs = spark.createDataFrame([(i, "a" if i < 85 else "b" if i < 95 else None) for i in range(100)], "doc_id bigint, domain string")
    sample = mixing.stratified_sample(docs, "domain", 20).groupBy("domain").count().collect()
    assert {r.domain: r["count"] for r in sample} == {"a": 17, "b": 2, None: 1}
    for fraction, val in ((0.0, 0), (0.05, 5), (0.001, 1), (1.0, 0)):
        out = mixing.train_val_split(docs, fraction)
        assert out.where("split = 'val'").count() == val and out.count() == 100
    assert mixing.train_val_split(docs.limit(0)).count() == 0
    turns = mixing.interleave(docs, "domain").groupBy("domain").count().collect()
    assert {r["count"] for r in turns} == {10}


def test_packing_keeps_all_and_fits(spark):
    items = spark.createDataFrame([(i, (i * 31) % 130) for i in range(500)] + [(999, None)], "k bigint, n bigint")
    out = packing.pack(items, "k", "n", 100, shards=4).collect()
    assert sorted(r.k for r in out) == sorted([*range(500), 999])
    bins = {}
    for r in out:
        bins[r.shard, r.bin] = bins.get((r.shard, r.bin), 0) + r.n_used
    assert max(bins.values()) <= 100
    assert packing.utilization(packing.pack(items.limit(0), "k", "n", 100), 100).first().percent == 0


def test_vectors(spark):
    df = spark.createDataFrame([([3.0, 4.0], [1.0, 2.0]), ([0.0, 0.0], [0.0, 0.0])], "a array<double>, b array<double>")
    got = df.select(V.dot(F.col("a"), F.col("b")), V.rms_norm(F.col("a"), F.col("b"))[1], V.argmax(F.col("a")), V.softmax(F.col("a"))[0]).collect()
    assert got[0][0] == 11 and abs(got[0][1] - 4 / 12.50001**0.5 * 2) < 1e-9 and got[0][2] == 1 and got[1][2] == 0 and got[1][3] == 0.5
    with pytest.raises(ValueError):
        V.rope(F.col("a"), F.lit(1), dim=3)
    one = spark.createDataFrame([([float(i) for i in range(8)],)], "v array<double>")
    r = one.select(V.rope(V.rope(F.col("v"), F.lit(5), dim=8), F.lit(7), dim=8).alias("x"), V.rope(F.col("v"), F.lit(12), dim=8).alias("y")).first()
    assert max(abs(a - b) for a, b in zip(r.x, r.y)) < 1e-9
    assert V.pair_permutation(6, 4) == [0, 2, 1, 3, 4, 5]


def test_nucleus(spark):
    import math

    df = spark.createDataFrame([([math.log(x) for x in (0.5, 0.3, 0.2)],)], "v array<double>")
    for p, ids in ((0.4, [0]), (0.5000001, [0, 1]), (0.9, [0, 1, 2]), (2.0, [0, 1, 2])):
        assert df.select(V.nucleus(F.col("v"), p)).first()[0] == ids
    drawn = [df.select(V.draw(F.array(F.lit(7), F.lit(8)), F.array(F.lit(0.5), F.lit(0.5)), F.lit(u))).first()[0] for u in (0.0, 0.49, 0.51, 1.0)]
    assert drawn == [7, 7, 8, 8]


def test_early_stopping(spark):
    rows = [("a", i, v) for i, v in enumerate([1.0, 0.995, 0.99, 0.989, 0.5])] + [("b", i, v) for i, v in enumerate([1.0, 0.8, float("nan"), 0.6, 0.4])]
    df = spark.createDataFrame(rows, "run string, step bigint, metric double")
    out = {r.run: (r.n_seen, r.best, r.stop_at) for r in metrics.early_stopping(df, "run", 3, 0.02).collect()}
    assert out == {"a": (4, 1.0, 3), "b": (4, 0.4, None)}
    off = {r.run: r.stop_at for r in metrics.early_stopping(df, "run", 0, 0.02).collect()}
    assert off == {"a": None, "b": None}


def test_context(spark):
    df = spark.createDataFrame([([1, 2, 3], [1, 2, 4]), ([1], [1]), ([], [1]), (None, [1])], "a array<int>, b array<int>")
    assert [r[0] for r in df.select(context.common_prefix(F.col("a"), F.col("b"))).collect()] == [2, 1, 0, 0]
    cases = spark.createDataFrame([(90, 5), (96, 5), (100, 97), (4, 97), (3, 100), (100, 10)], "n int, more int")
    assert [r[0] for r in cases.select(context.eviction(F.col("n"), F.col("more"), 100)).collect()] == [0, 26, None, None, None, 35]


def test_metadata(spark):
    expected = MD.expected_tensors(MD.presets(spark).where("preset = 'tiny'"), tied=False)
    assert expected.count() == 3 + 2 * 9
    assert MD.violations(expected, expected).count() == 0
    assert MD.violations(expected, expected.limit(0)).where("problem = 'missing'").count() == 21
    votes = spark.createDataFrame([("a", 1, 5), ("a", 2, 6), ("a", 2, 7), ("b", 9, 2), ("b", 8, 1)], "role string, v int, layer int")
    assert {(r.role, r.v) for r in MD.vote(votes, "role", "v", "layer").collect()} == {("a", 2), ("b", 8)}
    names = spark.createDataFrame([("lm_head.weight",), ("xlm_head.weight",), ("blk.3.attn_q.weight",), ("blk.3.attn_q.weightx",)], "name string")
    got = {r.name: (r.role, r.layer) for r in MD.classify(names).collect()}
    assert got == {"lm_head.weight": ("output", None), "xlm_head.weight": ("other", None), "blk.3.attn_q.weight": ("attn_q", 3), "blk.3.attn_q.weightx": ("other", None)}


def test_conversion():
    import numpy as np

    from sparkprep.operators import conversion

    m = np.arange(12.0).reshape(6, 2)
    assert [len(x) for x in conversion.split_rows(m, [3, 2, 1])] == [3, 2, 1]
    with pytest.raises(ValueError):
        conversion.split_rows(m, [3, 2])
    assert (conversion.low_rank_update(np.zeros((2, 2)), np.ones((1, 2)), np.ones((2, 1)), 3.0) == 3).all()


def test_overrides_and_registration(spark):
    from sparkprep import api
    from sparkprep.operators import conversion

    df = spark.createDataFrame([("a", 5, None)], "preset string, n_ff bigint, rope_base double")
    row = conversion.with_overrides(df, n_ff=7).first()
    assert (row.n_ff, row.rope_base, row.norm_eps) == (7, 10000.0, 1e-5)
    api.register(spark, "/opt/tokenizers/byte_bpe_50k.json")
    assert spark.sql("SELECT bpe_decode(bpe_encode('héllo <x>')) AS t").first().t == "héllo <x>"
    assert spark.sql("SELECT * FROM chunk_tokens('a b c d e', 2, 1)").count() == 3
    assert spark.sql("SELECT dequantize(X'0000803F', 0) AS v").first().v == [1.0]


def test_mix_by_targets_of_the_sources(spark, tmp_path):
    docs = [(i, "word " * 100, f"s{i % 4}") for i in range(80)] + [(80, "word " * 100, None), (81, None, "s0")]
    spark.createDataFrame(docs, "doc_id bigint, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    targets = [("s0", 1000), ("s1", 500), ("s2", None)]
    spark.createDataFrame(targets, "source_name string, token_target bigint").write.parquet(f"{tmp_path}/sources.parquet")
    n = mixing.document_tokens(spark.read.parquet(f"{tmp_path}/documents.parquet")).first().n
    kept = {r.source: (r.n_docs, r.n_tokens) for r in plans.queries()["mix_token_totals_by_target"](spark, str(tmp_path)).collect()}
    assert kept == {s: (k, k * n) for s, k in (("s0", -(-1000 // n)), ("s1", -(-500 // n)), ("s2", 20), ("s3", 20))}
    order = plans.queries()["mix_order_by_target"](spark, str(tmp_path)).collect()
    budget = {"s0": 1000, "s1": 500, "s2": 100_000_000, "s3": 100_000_000}
    assert all(r.before < budget[r.source] and abs(r.place - (r.before + r.n / 2) / budget[r.source]) < 1e-11 for r in order) and len(order) == sum(k for k, _ in kept.values())
