"""Diverse picks of long sessions in rounds against picks from the whole list."""

import random

import pytest
from pyspark.sql import functions as F

from colloquy.operators import summary
from tests.test_text_operators import plain_pick, segments

SCHEMA = "session_id string, ord int, kind string, text string, words array<string>, score double"


def prose(seed, sessions=4, n=60):
    """Sentences of few words, so most are like some other, with equal scores and empty word lists."""
    rnd = random.Random(seed)
    rows = []
    for s in range(sessions):
        for k in range(n):
            words = rnd.sample("abcdefg", rnd.choice([0, 1, 2, 3, 3])) if s else ["a", "b"]
            rows.append((f"s{s}", k, "prose" if rnd.random() < 0.9 else "action", f"{s}-{k}", words, float(rnd.randint(0, 5))))
    return rows


@pytest.mark.parametrize("block", [2, 8, 512])
def test_rounds(spark, monkeypatch, block):
    monkeypatch.setattr(summary, "BLOCK", block)
    rows = prose(block)
    got = summary.picked(spark.createDataFrame(rows, SCHEMA).repartition(4), "lecture").collect()
    found = {}
    for r in got:
        found.setdefault((r.session_id, r.section), []).append((r.ord, r.text))
    want = {}
    for s in {r[0] for r in rows}:
        ranked = sorted(({"ord": o, "words": w, "score": x, "text": t} for i, o, kind, t, w, x in rows if i == s and kind == "prose"), key=lambda r: (-r["score"], r["ord"]))
        top = plain_pick(ranked, 3)
        rest = plain_pick([r for r in ranked if r not in top], 8)
        for section, own in (("overview", top), ("key_points", rest)):
            if own:
                want[s, section] = sorted((r["ord"], r["text"]) for r in own)
    assert {k: sorted(v) for k, v in found.items()} == want


def test_summary_in_rounds(spark, monkeypatch):
    """The long form has the same lines whatever the block."""
    rnd = random.Random(4)
    words = "apples rivers stones bears birds singing quietly under seven".split()
    texts = [" ".join(rnd.choices(words, k=5)).capitalize() + rnd.choice([".", ".", "?"]) + " We will review bears." for _ in range(120)]
    rows = segments(spark, texts, lambda i: i % 3)
    want = sorted(map(str, summary.summary(rows, "interview").collect()))
    monkeypatch.setattr(summary, "BLOCK", 5)
    assert sorted(map(str, summary.summary(rows, "interview").collect())) == want


def test_one_long_session(spark):
    """Half a million sentences of one session; the best hundred thousand are all alike."""
    word = lambda k: F.concat(F.lit("w"), (F.col("id") * k % 9973).cast("string"))
    same = F.col("id") < 100_000
    rows = spark.range(0, 500_000, 1, 8).select(
        F.lit("s").alias("session_id"), F.col("id").cast("int").alias("ord"), F.lit("prose").alias("kind"), F.col("id").cast("string").alias("text"),
        F.when(same, F.array(F.lit("x"), F.lit("y"))).otherwise(F.array(word(1), word(7), word(31))).alias("words"), (-F.col("id")).cast("double").alias("score"),
    )
    got = sorted((r.section, r.ord) for r in summary.picked(rows, "meeting").collect())
    # Of those alike only the first is picked, and the second as a key point.
    assert got == [("key_points", 1), *(("key_points", 100_002 + k) for k in range(5)), ("overview", 0), ("overview", 100_000), ("overview", 100_001)]
