"""Hard negatives against brute force: ties, copies, large values and odd rows."""

import math
import random

import duckdb
import pytest
from pyspark.sql import functions as F

from colloquy.llm import hard_negatives as H

SCHEMA = "vec_id long, embedding array<double>, label int"


def plain(rows, every=100):
    by = {}
    for i, v, x in rows:
        if i is not None and v is not None and x is not None and all(c is not None and math.isfinite(c) for c in v):
            by.setdefault(i, []).append((x, v))
    own = {i: min(found) for i, found in by.items()}
    scaled = {i: [math.floor(c) * 256 if abs(c) > 2**53 else math.floor(256 * c) for c in v] for i, (_, v) in own.items()}
    out = set()
    for a in own:
        if a % every:
            continue
        score = {i: sum(p * q for p, q in zip(scaled[a], v, strict=True)) for i, v in scaled.items() if i != a and len(v) == len(scaled[a])}
        score = {i: s for i, s in score.items() if abs(s) <= H.LONG}
        order = sorted(score, key=lambda i: (-score[i], i))
        for p in [i for i in order if own[i][0] == own[a][0]][:5]:
            found = [i for i in order if own[i][0] != own[a][0] and 30 * score[p] <= 100 * score[i] <= 90 * score[p]][:10]
            out |= {(a, p, k, n, score[p], score[n]) for k, n in enumerate(found, 1)}
    return out


def check(spark, rows, parts=4):
    df = spark.createDataFrame(rows, SCHEMA).repartition(parts).withColumn("id", F.lit("clash")).withColumn("window", F.lit(1))
    got = [tuple(r) for r in H.mined(df, F.col("id") % 100 == 0).collect()]
    assert len(got) == len(set(got)) and set(got) == plain(rows)
    return got


def some(n, seed, values, dim=4):
    rnd = random.Random(seed)
    return [(i, [rnd.choice(values) for _ in range(dim)], rnd.randint(0, 2)) for i in range(-100, n)]


def test_ties_and_blocks(spark, monkeypatch):
    """Few different scores, blocks of two anchors, rows scored seven at a time."""
    monkeypatch.setattr(H, "ANCHOR_BLOCK", 2)
    monkeypatch.setattr(H, "ROW_BLOCK", 7)
    assert check(spark, some(420, 1, [0.0, 0.5, 1.0]))


def test_real_values(spark):
    rnd = random.Random(2)
    rows = [(i, [rnd.gauss(0, 1) for _ in range(8)], i % 3) for i in range(600)]
    assert len(check(spark, rows)) > 200


def test_hot_copies(spark):
    """A third of the rows are one vector: the smallest ids win, in every window."""
    rows = some(700, 3, [0.1, 0.4, 0.9]) + [(1000 + i, [0.4, 0.4, 0.4, 0.4], 1) for i in range(350)]
    assert check(spark, rows, 16)


def test_odd_rows(spark):
    rows = some(150, 4, [0.25, 1.0])
    rows += [(200, None, 1), (300, [0.1, None, 0.1, 0.1], 1), (400, [0.1, math.nan, 0.1, 0.1], 1), (500, [math.inf] * 4, 1), (600, [1.0] * 4, None), (None, [1.0] * 4, 1)]
    rows += [(700, [1.0, 1.0], 0), (701, [1.0, 1.0], 0), (702, [0.5, 0.5], 1), (800, [], 0), (801, [], 0), (802, [], 1)]
    rows += [rows[5], rows[5], (7, [9.0] * 4, 0), (7, [1.0] * 4, 0)]
    assert check(spark, rows)


@pytest.mark.parametrize("size", [1e6, 1e9, 1e300])
def test_large_values(spark, size):
    """Past the exact range of doubles, and past long scores, which take no part."""
    rnd = random.Random(6)
    rows = [(i, [rnd.random() * (size if i % 3 else 1.0) for _ in range(3)], i % 2) for i in range(0, 220)]
    check(spark, rows)


def test_empty(spark):
    assert H.mined(spark.createDataFrame([], SCHEMA), F.col("id") % 100 == 0).count() == 0
    assert check(spark, [(0, [1.0], 1)]) == []


def test_query_and_sql(spark):
    from colloquy.llm.queries import ORACLES, QUERIES

    con = duckdb.connect()
    con.execute("CREATE VIEW embeddings AS SELECT * FROM '/root/testdata/sf0.1/embeddings.parquet'")
    names = "anchor_id, positive_id, rank, negative_id, positive_score, negative_score"
    want = {tuple(r) for r in con.execute(f"SELECT {names} FROM ({ORACLES['op12_hard_negatives']})").fetchall()}
    got = {tuple(r) for r in QUERIES["op12_hard_negatives"](spark, "/root/testdata/sf0.1").collect()}
    assert got == want and len(got) > 500
