"""Token records with ids, packed rows, token files in parts, encoders, split metrics, and how often plans scan."""

import math
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkprep import plans
from sparkprep.functions import encoders
from sparkprep.operators import conversion, messages as M, metrics, mixing, packing, records as R
from sparkprep.sources import jsonl, tokbin

BPE = "/opt/tokenizers/byte_bpe_50k"
MSG = "msg_id bigint, conv_id bigint, turn int, role string, content string"


def conversations(spark):
    rows = [
        (1, 1, 0, "user", "Hi é"), (2, 1, 1, "gpt", "abcdefghij</think>ok"), (3, 2, 0, "user", "x" * 90), (4, 2, 1, "assistant", "y"), (5, 3, 0, "user", "only me"), (6, None, 0, "user", "lost"),
        (7, 4, 0, "system", None), (8, 4, 1, "assistant", "fine"),
    ]
    return M.normalize(spark.createDataFrame([(*r, "clash") for r in rows], MSG + ", ids string"))


def test_records_keep_answers_and_crop_reasoning(spark):
    got = {r.conv_id: r for r in R.chat_records(conversations(spark), 70, "", "bytes").collect()}
    assert set(got) == {1, 4}  # 2 overflows, 3 has nothing to learn, null has no conversation
    text = bytes(got[1].ids).decode("utf-8", "replace")
    assert text.startswith("<|user|>Hi é<|end|><|assistant|>") and text.endswith("</think>ok<|end|>"[8:]) and len(got[1].ids) <= 70
    one = got[1]
    assert len(one.ids) == len(one.mask) == len(one.is_answer) and all(m >= a for m, a in zip(one.mask, one.is_answer))
    assert bytes(i for i, a in zip(one.ids, one.is_answer) if a) == b"ok<|end|>"
    assert R.chat_records(conversations(spark).limit(0), 70, "", "bytes").count() == 0


def test_backends_agree_with_each_other():
    texts = ["the quick  brown\n\nfox", "", "é語😀 <|endoftext|> 12345", "don't"]
    want = encoders.load(BPE, "tiktoken")(texts)
    assert encoders.load(BPE, "tokenizers")(texts) == want == encoders.load(BPE, "auto")(texts)
    assert encoders.load("", "bytes")(["é"]) == [[0xC3, 0xA9]]
    with pytest.raises(ValueError):
        encoders.load(BPE, "other")
    with pytest.raises(FileNotFoundError):
        encoders.load("/nowhere/none")


def test_packed_rows_hold_every_record_once(spark):
    rows = [(i, list(range(n)), [j % 2 for j in range(n)], [0] * n) for i, n in enumerate((30, 30, 50, 0, 120, 7, 1, 99))]
    df = spark.createDataFrame(rows, "k bigint, ids array<int>, mask array<tinyint>, is_answer array<tinyint>")
    out = packing.packed_rows(df, "k", 100, 999, shards=2).collect()
    assert sum(r.n_sequences for r in out) == 7 and sum(sum(r.attention_mask) for r in out) == 30 + 30 + 50 + 100 + 7 + 1 + 99
    for r in out:
        assert len(r.input_ids) == len(r.labels) == len(r.attention_mask) == len(r.is_answer) == 100
        for i, label, live in zip(r.input_ids, r.labels, r.attention_mask):
            assert (live or (i, label) == (999, -100)) and label in (-100, i)
    assert packing.packed_rows(df.limit(0), "k", 100, 999).count() == 0


def test_next_fit():
    assert packing.next_fit(np.array([60, 30, 20, 100, 0, 1]), 100).tolist() == [0, 0, 1, 2, 2, 3]
    assert packing.next_fit(np.array([], np.int64), 100).tolist() == []


def test_chunks_wrap_ids(spark):
    df = spark.createDataFrame([(1, "a" * 130), (2, "a" * 30), (3, " 　"), (4, None)], "k bigint, t string")
    got = {(r.k, r.chunk): r for r in R.chunk_records(df, "k", "t", "", "bytes", size=100, least=20).collect()}
    assert {k: len(r.ids) for k, r in got.items()} == {(1, 0): 120, (1, 1): 50, (2, 0): 50}
    assert all(r.mask[0] == 0 and r.mask[-1] == 1 for r in got.values())


def test_blank_is_unicode(spark):
    texts = [" 　", "\t\x1c", "", None, " x ", "​"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    assert [r.b for r in df.select(mixing.not_blank(F.col("t")).alias("b"), "i").orderBy("i").collect()] == [bool((t or "").strip()) for t in texts]


def test_lines_with_something_behind_them(spark):
    good = '{"messages": [{"role": "user", "content": "a"}]}'
    lines = [good, good + " tail", "\t", good + "\t", "[1, 2", good + good, "null"]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(lines)], "i int, value string")
    assert [r.status for r in jsonl.parse_lines(df).orderBy("i").collect()] == ["ok", "malformed", "blank", "ok", "malformed", "malformed", "empty"]


def test_token_files_in_parts(spark, tmp_path):
    spark.dataSource.register(tokbin.TokBinSource)
    rows = [(list(range(i % 40)), [1] * (i % 40), [0] * (i % 40)) for i in range(300)]
    folder = str(tmp_path / "parts")
    spark.createDataFrame(rows, "ids array<int>, mask array<tinyint>, is_answer array<tinyint>").coalesce(1).write.format("tokbin").option("vocab_ceiling", 70000).mode("overwrite").save(folder)
    want = sorted(r[0] for r in rows if r[0])
    for split in (1, 500, 1 << 30):
        back = spark.read.format("tokbin").option("split", split).load(folder)
        got = back.collect()
        assert sorted(r.ids for r in got) == want and sorted(r.record for r in got) == list(range(len(want)))
    assert spark.read.format("tokbin").option("split", 500).load(folder).rdd.getNumPartitions() > 5


def test_split_metrics(spark):
    df = spark.createDataFrame([(0, 1.0, 0), (0, 3.0, 1), (1, 5.0, 1), (2, 100.0, 0)], "b int, x double, a int")
    r = metrics.split_eval(df, "b", "x", "a", 2).first()
    assert (r.n_batches, r.loss, r.think_loss, r.answer_loss) == (2, 3.5, 1.0, 4.0)
    none = metrics.split_eval(df.limit(0), "b", "x", "a").first()
    assert none.n_batches == 0 and none.loss == 0.0 and math.isnan(none.think_loss) and math.isnan(none.answer_loss)


def test_fused_rows_and_biases(spark):
    rows = spark.range(10).withColumnRenamed("id", "r")
    got = [(x.part, x.part_row) for x in conversion.row_parts(rows, "r", [("q", 4), ("k", 2)]).orderBy("r").collect()]
    assert got == [("q", 0), ("q", 1), ("q", 2), ("q", 3), ("k", 0), ("k", 1)] + [(None, None)] * 4
    df = spark.createDataFrame([([1e-7, -1e-7],), ([0.0, 1e-3],), ([],), (None,)], "v array<double>")
    assert [r.b for r in df.select(conversion.negligible(F.col("v")).alias("b")).collect()] == [True, False, True, True]


@pytest.mark.parametrize("name, scans", [("mix_order", 1), ("train_val_split", 1), ("stratified_sample", 1), ("subset_interleave", 2), ("collate_lengths", 1), ("pack_bins", 2)])
def test_sources_are_scanned_once(spark, data, name, scans):
    """What is left of the tables in the plan: kept frames replace them, packing counts its rows by a scan of no columns."""
    plan = plans.queries()[name](spark, data)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan parquet") <= scans and plan.count("CartesianProduct") == 0
