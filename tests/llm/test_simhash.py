"""SimHash: fingerprints, forest search and components against plain versions."""

import numpy as np
import xxhash
from pyspark.sql import functions as F

from colloquy.llm import simhash

TEXTS = [
    (1, "The quick brown fox jumps over the lazy dog and runs away"),
    (2, "the QUICK brown fox jumps over the lazy dog and runs away"),
    (3, None),
    (4, ""),
    (5, "one two"),
    (5, "one two"),
    (6, "a b\tc\nd\x0be f"),
    (7, "Été été ÉTÉ x"),
    (None, "the quick brown fox jumps over the lazy dog and runs away"),
    (9, "word " * 40000),
]


def slow_fingerprint(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in low.translate({9: 32, 10: 32, 11: 32, 12: 32, 13: 32}).split(" ") if w]
    grams = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    out = 0
    for bit in range(64):
        if 2 * sum(xxhash.xxh64(g.encode(), seed=42).intdigest() >> bit & 1 for g in grams) > len(grams):
            out |= 1 << bit
    return out


def slow_components(codes):
    label = list(range(len(codes)))
    for i, a in enumerate(codes):
        for j in range(i):
            if bin(a ^ codes[j]).count("1") <= 3 and label[i] != label[j]:
                x, y = sorted((label[i], label[j]))
                label = [x if q == y else q for q in label]
    return label


def test_rows(spark):
    docs = spark.createDataFrame(TEXTS, "doc_id long, text string").withColumn("fp", F.lit("x")).withColumn("component", F.lit(1))
    got = simhash.near_duplicates(docs).collect()
    assert len(got) == len(TEXTS)
    by = {r["doc_id"]: r for r in got}
    for i, t in TEXTS:
        assert by[i]["fp"] % 2**64 == slow_fingerprint(t)
    assert by[2]["component_id"] == 1 and by[None]["component_id"] == 1
    assert by[4]["component_id"] == 3
    kept = simhash.firsts(docs, simhash.near_duplicates(docs))
    assert kept.columns == docs.columns
    ids = [r["doc_id"] for r in kept.collect()]
    assert ids.count(5) == 1 and len(ids) == len({r["component_id"] for r in got})


def test_empty(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert simhash.near_duplicates(docs).count() == 0


def test_components_match_all_pairs(spark):
    rng = np.random.default_rng(3)
    base = rng.integers(0, 2**64, 60, np.uint64)
    codes = list(base)
    for x in base[:25]:
        y = x
        for _ in range(12):
            for bit in rng.integers(0, 64, rng.integers(1, 4)):
                y = y ^ np.uint64(1 << int(bit))
            codes.append(y)
    codes = sorted({int(c) for c in codes})
    want = slow_components(codes)
    rows = spark.createDataFrame([(int(np.uint64(c).astype(np.int64)),) for c in codes], "fp long").repartition(7)
    for limit in (simhash.SHARD_ROWS, 3):
        found = {r["node"] % 2**64: r["component"] % 2**64 for r in simhash.fingerprint_components(rows, limit).collect()}
        groups = {}
        for c, l in zip(codes, want):
            groups.setdefault(l, set()).add(c)
        got = {}
        for c in codes:
            got.setdefault(found.get(c, c), set()).add(c)
        assert sorted(map(sorted, got.values())) == sorted(map(sorted, groups.values()))


def test_clashes(spark):
    """Columns named as those on the way, and maps, come back unchanged."""
    docs = spark.createDataFrame(
        [(1, "same text of a few words", 99, 1, 2, {"a": 1}), (1, "same text of a few words", 98, 3, 4, {"a": 2}), (2, "same text of a few words", 97, 5, 6, None)],
        "doc_id long, text string, _id long, _key long, _nth long, _no_id map<string, int>",
    )
    kept = simhash.firsts(docs, simhash.near_duplicates(docs)).collect()
    assert len(kept) == 1 and kept[0] in docs.collect() and kept[0].doc_id == 1


def test_query(spark):
    from colloquy.llm.queries import QUERIES

    name = "/root/testdata/sf0.001"
    docs = sorted((r.doc_id, r.text) for r in spark.read.parquet(f"{name}/documents.parquet").collect())
    codes = [slow_fingerprint(t) for _, t in docs]
    label = slow_components(codes)
    want = {i: (f"{c:016x}", docs[label.index(l)][0]) for (i, _), c, l in zip(docs, codes, label)}
    got = QUERIES["op10_simhash"](spark, name).collect()
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in got} == want and len(got) == len(docs)


def test_hot_rows_stay_in_their_tasks(spark):
    """A third of all rows are one row: each task passes one of them on."""
    rows = [(7, "the same text in every copy of this row", "x")] * 3000 + [(10 + i, f"text number {i} {'word ' * (i % 50)}", "y") for i in range(6000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(8)
    kept = simhash.firsts(docs, simhash.near_duplicates(docs))
    plan = kept._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") >= 2
    got = kept.collect()
    assert sum(r.doc_id == 7 for r in got) == 1
