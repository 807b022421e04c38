"""Tokenizer, block formats, sources and streams."""

import json
import struct

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sparkprep.functions import bpe, quant
from sparkprep.sources import containers, jsonl, tokbin
from sparkprep.streaming import stateful

_A = bpe.byte_alphabet()
VOCAB = {c: b for b, c in _A.items()} | {"th": 256, "the": 257, "Ġthe": 258, "in": 259, "ing": 260, "<|user|>": 261, "<|end|>": 262, "<|end|>x": 263}
MODEL = bpe.BpeModel(VOCAB, [("t", "h"), ("th", "e"), ("Ġ", "the"), ("i", "n"), ("in", "g")], bos_id=300)


def test_alphabet_is_a_bijection():
    assert len(set(_A.values())) == 256 and _A[32] == "Ġ" and _A[0] == "Ā" and _A[65] == "A"


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=80))
def test_encoding_round_trips(text):
    assert MODEL.decode(MODEL.encode(text)) == text


def naive(symbols):
    while True:
        ranked = [(MODEL.ranks[p], i) for i, p in enumerate(zip(symbols, symbols[1:])) if p in MODEL.ranks]
        if not ranked:
            return symbols
        _, i = min(ranked)
        symbols = symbols[:i] + [symbols[i] + symbols[i + 1]] + symbols[i + 2 :]


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="theing ", max_size=60))
def test_merging_is_lowest_rank_leftmost(text):
    symbols = [_A[b] for b in text.encode()]
    assert MODEL.merge(symbols) == naive(symbols)


def test_special_tokens_and_fallback():
    assert MODEL.encode("<|user|>the<|end|>", add_bos=True) == [300, 261, 257, 262]
    assert MODEL.encode("<|user|>", special=False) != [261]
    assert MODEL.encode(None) == [] and MODEL.encode("") == []
    small = bpe.BpeModel({"a": 0, "<0x62>": 1}, [])
    assert small.encode("abc") == [0, 1] and small.decode([0, 1, 99]) == "ab"


def test_torn_characters():
    raw = "é語😀".encode()
    decoder, out = bpe.Decoder(MODEL), []
    for b in raw:
        out.append(decoder.push(VOCAB[_A[b]]))
    assert "".join(out) == "é語😀" and decoder.flush() == ""
    assert [bpe.complete_length(raw[:i]) for i in range(1, 10)] == [0, 2, 2, 2, 5, 5, 5, 5, 9]
    assert bpe.complete_length(b"\xff") == 1


def half(x):
    return np.float16(x).tobytes()


def test_block_formats_by_hand():
    low, high = np.arange(16, dtype=np.uint8), np.arange(15, -1, -1, dtype=np.uint8)
    nibbles = (low | high << 4).tobytes()
    q = np.concatenate([low, high]).astype(np.float32)
    assert (quant.dequantize(half(2) + nibbles, 2) == 2 * (q - 8)).all()
    assert (quant.dequantize(half(2) + half(3) + nibbles, 3) == 2 * q + 3).all()
    ones = struct.pack("<I", 0xFFFF0000)
    fifth = np.concatenate([np.zeros(16), np.full(16, 16)])
    assert (quant.dequantize(half(1) + ones + nibbles, 6) == q + fifth - 16).all()
    assert (quant.dequantize(half(1) + half(1) + ones + nibbles, 7) == q + fifth + 1).all()
    assert (quant.dequantize(half(0.5) + np.arange(-16, 16, dtype=np.int8).tobytes(), 8) == np.arange(-16, 16) / 2).all()
    assert (quant.dequantize(np.array([1.5, -2], np.float32).tobytes(), 0) == [1.5, -2]).all()
    assert (quant.dequantize(b"\x80\x3f\x00\xc0", 30) == [1, -2]).all()
    with pytest.raises(ValueError):
        quant.dequantize(b"", 99)


def test_super_blocks_against_plain_loops():
    rng = np.random.default_rng(3)
    for kind, size in ((12, 144), (13, 176), (14, 210)):
        raw = bytearray(rng.integers(0, 256, size, np.uint8).tobytes())
        if kind == 14:
            raw[208:210] = half(0.25)
        else:
            raw[:4] = half(0.25) + half(0.5)
        got = quant.dequantize(bytes(raw), kind)
        want = np.zeros(256, np.float32)
        for e in range(256):  # element by element from the definition of the format
            if kind == 14:
                n, r = divmod(e, 128)
                part, place = divmod(r, 32)
                byte = raw[64 * n + 32 * (part % 2) + place]
                code = (byte >> 4 if part > 1 else byte & 15) | ((raw[128 + 32 * n + place] >> 2 * part) & 3) << 4
                scale = np.int8(np.uint8(raw[192 + 8 * n + 2 * part + place // 16]))
                want[e] = 0.25 * float(scale) * (code - 32)
            else:
                sub, place = divmod(e, 32)
                base = 16 if kind == 12 else 48
                byte = raw[base + 32 * (sub // 2) + place]
                code = byte >> 4 if sub % 2 else byte & 15
                if kind == 13:
                    code += 16 * ((raw[16 + place] >> sub) & 1)
                s = raw[4:16]
                if sub < 4:
                    scale, low = s[sub] & 63, s[sub + 4] & 63
                else:
                    scale, low = s[sub + 4] & 15 | (s[sub - 4] >> 6) << 4, s[sub + 4] >> 4 | (s[sub] >> 6) << 4
                want[e] = 0.25 * scale * code - 0.5 * low
        assert np.allclose(got, want)


def test_quantizers():
    v = np.linspace(-3, 3, 64).astype(np.float32)
    assert np.abs(quant.dequantize(quant.quantize_q8_0(v), 8) - v).max() < 3 / 127
    assert np.abs(quant.dequantize(quant.quantize_q4_0(v), 2) - v).max() < 0.5
    assert (quant.dequantize(quant.quantize_q8_0(np.zeros(32)), 8) == 0).all()
    w, a = quant.quantize_q4_0(v), quant.quantize_q8_0(v[::-1])
    assert abs(quant.fused_dot(w, a) - float(quant.dequantize(w, 2) @ quant.dequantize(a, 8))) < 1e-3


@pytest.mark.parametrize("ceiling, width", [(300, 2), (70000, 4)])
def test_token_files_round_trip_and_tear(spark, tmp_path, ceiling, width):
    spark.dataSource.register(tokbin.TokBinSource)
    rows = [([1, 2, 299], [0, 1, 1], [0, 0, 1]), ([7], [1], [1]), ([], [], [])]
    df = spark.createDataFrame(rows, "ids array<int>, mask array<tinyint>, is_answer array<tinyint>").coalesce(1)
    folder = str(tmp_path / "t")
    df.write.format("tokbin").option("vocab_ceiling", ceiling).mode("overwrite").save(folder)
    back = spark.read.format("tokbin").load(folder).orderBy("record").collect()
    assert [(r.ids, r.mask, r.is_answer) for r in back] == rows[:2]
    df.write.format("tokbin").option("vocab_ceiling", ceiling).mode("append").save(folder)
    assert spark.read.format("tokbin").load(folder).count() == 4
    with pytest.raises(Exception):
        df.write.format("tokbin").option("vocab_ceiling", ceiling + 1).mode("append").save(folder)
    df.write.format("tokbin").option("vocab_ceiling", ceiling).mode("overwrite").save(folder)
    assert spark.read.format("tokbin").load(folder).count() == 2
    path = next((tmp_path / "t").glob("*.bin"))
    raw, start = path.read_bytes(), tokbin.read_header(str(path))[1]
    first = 4 + 3 * (width + 2)
    for cut in range(start, len(raw)):
        path.write_bytes(raw[:cut])
        assert len(list(tokbin.records(str(path)))) == (cut >= start + first)
    path.write_bytes(b"")
    with pytest.raises(ValueError):
        list(tokbin.records(str(path)))
    assert tokbin.is_token_file("x.bin") and not tokbin.is_token_file(str(tmp_path / "none"))


CONFIG = {"format_version": 1, "spec_version": 1, "n_vocab": 8, "n_embd": 4, "n_layer": 2, "n_head": 2, "n_kv_head": 1, "head_dim": 2, "n_ff": 6, "ctx_len": 16,
          "rope_base": 10000.0, "rope_scale": 1.0, "rope_dim_count": 2, "norm_eps": 1e-5, "flags": 3, "alignment": 32}


def test_containers(spark, tmp_path):
    slots = containers.positional_slots(CONFIG)
    assert len(slots) == 3 + 2 * 9 and len(containers.positional_slots(CONFIG | {"flags": 0})) == 2 + 2 * 8
    data = [np.full(int(np.prod(s)), i, np.float32).tobytes() for i, (_, s) in enumerate(slots)]
    path = str(tmp_path / "m.pc")
    containers.write_positional(path, CONFIG, "{}", '{"tokens": []}', data, [0] * len(slots))
    spark.dataSource.register(containers.PositionalSource)
    spark.dataSource.register(containers.GgufSource)
    rows = spark.read.format("poscon").load(path).where("kind = 'tensor'").orderBy("ord").collect()
    raw = open(path, "rb").read()
    assert [r.name for r in rows] == [n for n, _ in slots] and all(raw[r.offset : r.offset + r.nbytes] == d for r, d in zip(rows, data))
    assert containers.sniff(path) == "poscon" and containers.POSITIONAL_HEADER.size == 116
    open(path, "wb").write(raw[:-8])
    assert spark.read.format("poscon").option("mode", "permissive").load(path).first().kind == "error"
    with pytest.raises(Exception):
        spark.read.format("poscon").load(path).collect()
    for alignment in (32, 64):
        g = str(tmp_path / f"g{alignment}.gguf")
        keys = [("general.alignment", 4, alignment), ("s", 8, "é"), ("f", 6, 0.5), ("a", 9, (5, [1, -2])), ("b", 7, True), ("big", 10, 2**60)]
        containers.write_gguf(g, keys, [("x", [32], 8, b"\1" * 34), ("y", [2, 3], 0, b"\2" * 24)], alignment)
        rows = {r.name: r for r in spark.read.format("gguf").load(g).collect()}
        assert rows["s"].value == "é" and json.loads(rows["a"].value) == [1, -2] and rows["big"].value == str(2**60)
        raw = open(g, "rb").read()
        for name, byte in (("x", 1), ("y", 2)):
            assert set(raw[rows[name].offset : rows[name].offset + rows[name].nbytes]) == {byte} and rows[name].offset % alignment == 0
    bad = tmp_path / "bad"
    bad.write_bytes(b"GGUF" + struct.pack("<IQQ", 9, 0, 0))
    with pytest.raises(ValueError):
        list(containers.gguf_rows(str(bad)))
    bad.write_bytes(b"none")
    with pytest.raises(ValueError):
        containers.sniff(str(bad))


def test_json_lines(spark):
    lines = ['{"messages":[{"role":"user","content":"a"},{"from":"gpt","value":"b"}]}', '{"conversations":[{"from":"human","value":"x"}]}', '[{"role":"user","content":"y"}]', "", "  ", "{broken", '{"messages":[]}', '{"messages":[{"role":"","content":"a"}]}', None]
    got = jsonl.parse_lines(spark.createDataFrame([(x,) for x in lines], "value string")).collect()
    assert [r.status for r in got] == ["ok", "ok", "ok", "blank", "blank", "malformed", "empty", "empty", "blank"]
    assert [(m.role, m.content) for m in got[0].messages] == [("user", "a"), ("assistant", "b")]
    p = spark.createDataFrame([('{"messages":[{"role":"user","content":"a"}]}',), ('{"prompt":"p"}',), ("plain",), ("{}",)], "p string")
    assert [r[0] for r in p.select(jsonl.payload_prompt(F.col("p"))).collect()] == ["<|user|>a<|end|><|assistant|>", "p", "plain", "{}"]


def run(spark, tmp_path, frames, schema, op, timers=False):
    """Each frame is a batch of its own. A stream with timers runs on without data, so it is stopped when its output is there."""
    folder = tmp_path / "in"
    for i, rows in enumerate(frames):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(folder))
    out = str(tmp_path / "out")
    stream = spark.readStream.schema(spark.createDataFrame([], schema).schema).option("maxFilesPerTrigger", 1).parquet(str(folder))
    writer = op(stream).writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "cp"))
    q = (writer if timers else writer.trigger(availableNow=True)).start(out)
    q.awaitTermination(15 if timers else 60)
    q.stop()
    return spark.read.parquet(out)


def test_stream_prefixes(spark, tmp_path):
    frames = [[("a", 1, [1, 2, 3])], [("a", 2, [1, 2, 3]), ("a", 3, [1, 9])], [("a", 4, None), ("b", 1, [1])]]
    out = run(spark, tmp_path, frames, "k string, t bigint, ids array<int>", lambda s: stateful.prefix_reuse(s, "k", "t", "ids"))
    assert sorted(tuple(r) for r in out.collect()) == [("a", 1, 0, 0), ("a", 2, 3, 2), ("a", 3, 1, 1), ("a", 4, 0, 0), ("b", 1, 0, 0)]


def test_stream_windows_and_bytes(spark, tmp_path):
    frames = [[("a", 1, 90)], [("a", 2, 20)], [("a", 3, None), ("a", 4, 1000)]]
    out = run(spark, tmp_path / "w", frames, "k string, t bigint, n bigint", lambda s: stateful.context_windows(s, "k", "t", "n", 100))
    assert sorted(tuple(r) for r in out.collect()) == [("a", 1, 0, 90), ("a", 2, 35, 75), ("a", 3, 0, 75), ("a", 4, 71, 100)]
    raw = "é語".encode()
    out = run(spark, tmp_path / "b", [[("a", i, bytes([b]))] for i, b in enumerate(raw)], "k string, t bigint, raw binary", lambda s: stateful.decoded(s, "k", "t", "raw"))
    assert "".join(r.text for r in out.orderBy("t").collect()) == "é語"


def test_stream_buffer(spark, tmp_path):
    out = run(spark, tmp_path, [[("a", "x", 2)], [("a", "y", 2)], [("a", "z", 1)]], "k string, t string, n bigint", lambda s: stateful.buffered(s, "k", "t", "n", most=4, seconds=3600), timers=True)
    assert [tuple(r) for r in out.collect()] == [("a", "xy", 4, "count")]


def test_evict_matches_the_column_form(spark):
    from sparkprep.operators.context import eviction

    cases = [(n, m) for n in range(0, 100, 7) for m in range(0, 96, 5)]
    got = spark.createDataFrame(cases, "n int, m int").select("n", "m", eviction(F.col("n"), F.col("m"), 100).alias("e")).collect()
    for r in got:
        if r.e is None:
            with pytest.raises(ValueError):
                stateful.evict(r.n, r.m, 100, 4)
        else:
            assert r.e == stateful.evict(r.n, r.m, 100, 4)
