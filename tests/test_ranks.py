"""Medians in rounds against sorted lists."""

import random

import numpy as np
from pyspark.sql import functions as F

from colloquy.functions import ranks, vectors

PLACES = {"low": ranks.LOWER, "up": ranks.UPPER, "first": lambda n: n * 0, "last": lambda n: n - 1, "ninth": lambda n: F.floor(n * 0.9)}


def plain(values, name):
    v, n = sorted(values), len(values)
    return v[{"low": (n - 1) // 2, "up": n // 2, "first": 0, "last": n - 1, "ninth": int(n * 0.9)}[name]]


def test_by_rank(spark):
    """Large keys with copies, wide ranges and few different values; small ones, null keys and null values."""
    rnd = random.Random(1)
    keys = {
        "even": [rnd.random() for _ in range(5000)], "wide": [rnd.choice([-1, 1]) * 10.0 ** rnd.uniform(-300, 300) for _ in range(4001)],
        "hot": [7.0] * 6000 + [rnd.gauss(7, 1) for _ in range(500)], "two": [1.0] * 2500 + [2.0] * 2500, "one": [3.0] * 3000,
        None: [float(k) for k in range(2000)], "small": [5.0, 1.0, 3.0], "inf": [float("inf")] * 1500 + [float("-inf")] * 1400 + [0.0],
    }
    rows = [(k, v) for k, own in keys.items() for v in own] + [("small", None), ("nothing", None)]
    rnd.shuffle(rows)
    df = spark.createDataFrame(rows, "key string, x double").repartition(6)
    got = {r.key: r for r in ranks.by_rank(df, ["key"], "x", PLACES, listed=100).collect()}
    assert set(got) == set(keys)
    for k, values in keys.items():
        assert {n: got[k][n] for n in PLACES} == {n: plain(values, n) for n in PLACES}, k
    middle = {r.key: r.median for r in ranks.medians(df, ["key"], "x", listed=100).collect()}
    assert all(middle[k] == np.median(v) or k == "inf" for k, v in keys.items())


def test_one_key_has_all_rows(spark, monkeypatch):
    """No task of the rounds sees more than its part of the key, and lists hold a thousand values at most."""
    monkeypatch.setattr(ranks, "LISTED", 1000)
    df = spark.range(0, 300_000, 1, 8).select(F.lit("k").alias("key"), (F.xxhash64("id") % 100_003).cast("double").alias("x"))
    want = np.sort([r.x for r in df.collect()])
    assert ranks.medians(df, ["key"], "x").first().median == (want[149_999] + want[150_000]) / 2
    folded = vectors.octave_folded_median(df.withColumn("x", F.abs("x") + 1), ["key"], "x").first()
    x = np.abs(want) + 1
    raw = np.median(x)
    assert folded.raw_median == raw and folded.folded_median == np.median(np.where(x > raw * 1.6, x / 2, np.where(x < raw / 1.6, x * 2, x)))


def test_empty(spark):
    assert ranks.medians(spark.createDataFrame([], "key string, x double"), ["key"], "x").count() == 0
