"""Formatting: marks, merging, masks, and reading back."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridwise.llm import chat


def test_round_trip(spark):
    rows = [
        (1, 0, "user", "hi <b>&lt;"), (1, 1, "user", "again|><|and|>"), (1, 2, "assistant", "ok <|end|>"), (1, 3, "assistant", "x\n"), (1, 4, "us<er", "é<|"),
        (2, 0, None, None), (3, 5, "assistant", ""), (None, 0, "user", "n"), (4, 1, "user", "b"), (4, 1, "user", "a"), (4, None, "user", "first"), (4, 1, "user", "a"),
        (-7, 1, "assistant", "</s>[INST] ok [/INST]"), (-7, 0, "user", "</s>[INST] ok [/INST]"),
    ]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "'x' AS turns")
    out = chat.format_chats(df).withColumn("back", chat.read_turns(F.col("formatted"))).withColumn("masked", chat.under_mask(F.col("formatted"), F.col("loss_spans")))
    got = {r.conv_id: r for r in out.collect()}
    assert len(got) == 6
    for k in got:
        own = sorted(((t if t is not None else -1, r or "", x or "") for c, t, r, x in rows if c == k))
        assert [tuple(t) for t in got[k].back] == [(r, x) for _, r, x in own]
        said = [x for _, r, x in own if r == "assistant"]
        assert got[k].masked == "".join(said) and len(got[k].loss_spans) == len(said)
    assert got[1].formatted == "<|user|>hi &lt;b>&amp;lt;<|and|>again|>&lt;|and|><|end|><|assistant|>ok &lt;|end|><|and|>x\n<|end|><|us&lt;er|>é&lt;|<|end|>"
    assert chat.format_chats(df.limit(0)).count() == 0


def test_roles_with_marks(spark):
    roles = ["a|>b", ">", "|>", "&gt;", "<|end|>", "a&lt;|>", "user"]
    rows = [(1, i, r, "hi|>") for i, r in enumerate(roles)] + [(2, 0, "assistant|>", "x"), (2, 1, "assistant", "said")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    out = chat.format_chats(df).withColumn("back", chat.read_turns(F.col("formatted"))).withColumn("masked", chat.under_mask(F.col("formatted"), F.col("loss_spans")))
    got = {r.conv_id: r for r in out.collect()}
    assert [tuple(t) for t in got[1].back] == [(r, "hi|>") for r in roles]
    assert [tuple(t) for t in got[2].back] == [("assistant|>", "x"), ("assistant", "said")] and got[2].masked == "said"


def test_no_python(spark):
    df = spark.createDataFrame([(1, 0, "user", "a")], "conv_id long, turn long, role string, text string")
    plan = chat.format_chats(df)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
