import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from sparkprep import plans
from sparkprep.functions import text as T
from sparkprep.functions.bpe import PRETOKENS


def strings(n, seed=1):
    rng = random.Random(seed)
    parts = ["a", "B", "é", "語", "😀", "7", "42", " ", "  ", "\n", "\t", "\r\n", "\x0b", "\x0c", "'s", "'re", "'", "!?", "--", "_", " "]
    return ["".join(rng.choice(parts) for _ in range(rng.randint(0, 40))) for _ in range(n)]


def test_pretokens_join_to_the_text_and_match_the_python_form(spark):
    texts = [*strings(400), None, ""]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select("t", T.pretokenize(F.col("t")).alias("p"), T.pretoken_count(F.col("t")).alias("n")).collect()
    for t, p, n in got:
        if t is None:
            assert p is None and n == 0
        else:
            assert "".join(p) == t and p == PRETOKENS.findall(t) and n == len(p)


@pytest.mark.parametrize(
    "content, think, answer",
    [
        ("a</think>b", "a</think>", "b"), ("plain", "", "plain"), ("</think>", "</think>", ""), ("", "", ""),
        ("x<|end_of_thought|>y</think>z", "x<|end_of_thought|>", "y</think>z"), ("é</think>ü", "é</think>", "ü"),
    ],
)
def test_think_split(spark, content, think, answer):
    row = spark.createDataFrame([(content,)], "c string").select(T.think_part(F.col("c")), T.answer_part(F.col("c"))).first()
    assert tuple(row) == (think, answer)


def test_roles(spark):
    df = spark.createDataFrame([("human",), ("gpt",), ("bot",), ("tool",), ("",), (None,), ("GPT",)], "r string")
    assert [r[0] for r in df.select(T.normalized_role(F.col("r"))).collect()] == ["user", "assistant", "assistant", "tool", "", "", "GPT"]


def test_escape_and_notes(spark):
    row = spark.createDataFrame([('a"\\\n\r\t\x08\x0cé',)], "c string").select(T.escape_json(F.col("c"))).first()
    assert row[0] == 'a\\"\\\\\\n\\r\\t\\u0008\\u000cé'
    df = spark.createDataFrame([("x" * 300,), ("x" * 301,), ("é" * 200,), (None,), ("",)], "c string")
    got = [r[0] for r in df.select(T.truncated_note(F.col("c"))).collect()]
    assert got == ["x" * 300, "x" * 300 + "...]\n", "é" * 150 + "...]\n", None, ""]


def test_special_tokens_and_widths(spark):
    df = spark.createDataFrame([("<|a|>", 65535), ("<|a", 65536), ("<||>", 1), ("<|a|b|>", 2), (None, None)], "t string, n int")
    got = df.select(T.is_special_token(F.col("t")), T.id_typecode(F.col("n"))).collect()
    assert [tuple(r) for r in got] == [(True, "H"), (False, "I"), (True, "H"), (False, "H"), (False, "I")]


def test_python_pattern_is_the_spark_pattern():
    assert re.sub(r"\s", "", T.PRETOKENS)[:20] == "'s|'t|'re|'ve|'m|'ll"


def _note(text):
    raw = text.encode()
    return text if len(raw) <= 300 else raw[:300].decode(errors="ignore") + "...]\n"


def test_notes_of_all_contents_match_brute_force(spark, tmp_path):
    fixture = [None, "", "a" * 300, "a" * 301, "\ufffd" * 101, "a" * 298 + "\ufffd" + "b"]
    fixture += ["a" * n + c * 90 for n in range(213, 218) for c in ("é", "語", "😀")] + ["a" * n + c + "\ufffd語" for n in range(291, 301) for c in ("é", "語", "😀", "\ufffd")]
    df = spark.createDataFrame([(i, 1, i, "user", t) for i, t in enumerate(fixture)] + [(7, 1, 7, "user", fixture[7])], "msg_id bigint, conv_id bigint, turn int, role string, content string")
    df.write.parquet(f"{tmp_path}/messages.parquet")
    got = [(r.msg_id, r.note_md5) for r in plans.queries()["truncated_notes"](spark, str(tmp_path)).collect()]
    assert sorted(got) == [(i, None if t is None else hashlib.md5(_note(t).encode()).hexdigest()) for i, t in enumerate(fixture)]


def test_notes_of_all_messages_come_out(spark, data):
    table = spark.read.parquet(f"{data}/messages.parquet").select("msg_id", "conv_id", "turn", "role", "content").distinct().collect()
    got = [(r.msg_id, r.note_md5) for r in plans.queries()["truncated_notes"](spark, data).collect()]
    want = [(r.msg_id, None if r.content is None else hashlib.md5(_note(r.content).encode()).hexdigest()) for r in table]
    assert sorted(got, key=str) == sorted(want, key=str)
