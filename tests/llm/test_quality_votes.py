"""Quality votes: against a plain version, held-out accuracy, and edge cases."""

import re
import zlib
from collections import Counter

import numpy as np

from pyspark.sql import functions as F

from colloquy.llm import quality_votes as Q
from colloquy.llm.queries import QUERIES, quality_model


def test_held_out(spark):
    name = "/root/testdata/sf0.01"
    got = QUERIES["op6_quality_votes"](spark, name)
    labels = spark.read.parquet(f"{name}/labels.parquet")
    rows = got.where("held_out").join(labels, "doc_id").collect()
    assert len(rows) > 60 and sum(r.predicted == r.quality for r in rows) / len(rows) >= 0.95
    assert got.count() == spark.read.parquet(f"{name}/documents.parquet").count()
    assert got.where("score not between 0 and 1 or predicted <> cast(score >= 0.7 as int)").count() == 0


def test_edges(spark):
    rows = [(1, None), (2, ""), (3, "x"), (3, "x"), (None, "y " * 300000), (5, "\U0001f600")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("score", F.lit("clash"))
    labels = spark.createDataFrame([(1, 1), (3, 0), (3, 0), (99, 1), (None, 1), (5, None)], "doc_id long, label int")
    model = Q.fit(docs, labels)
    got = Q.scored(docs, model).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got)
    none = Q.fit(docs, labels.limit(0))
    assert {r.score for r in Q.scored(docs, none).collect()} == {0.5}
    assert Q.scored(docs.limit(0), model).count() == 0


def test_limit(spark):
    docs = spark.range(3000).selectExpr("id as doc_id", "concat('text ', id) as text")
    assert len(Q.fit(docs, docs.selectExpr("doc_id", "doc_id % 2 as label"), limit=100).labels) == 100


def test_labels_count_once(spark):
    """Repeated labels of one id don't fill the sample, and contradictions give their mean."""
    docs = spark.range(50).selectExpr("id as doc_id", "concat('text number ', id) as text")
    rows = [(i, 1) for i in range(50)] + [(7, 1)] * 20 + [(8, 0)]
    model = Q.fit(docs, spark.createDataFrame(rows, "doc_id long, label int"), limit=20)
    assert len(model.labels) == 20 and len({v.tobytes() for v in model.vectors}) > 15
    assert set(Q.fit(docs, spark.createDataFrame(rows, "doc_id long, label int")).labels) == {1.0, 0.5}


def test_words_count():
    """Words enter the latent vectors: two texts of one layout and different words differ."""
    good, bad = "the calm river runs past old stone houses today", "buy cash pills fast rich win prize money now"
    rows = np.array([Q.features(f"{t} {i}") for i in range(30) for t in (good, bad)])
    model = Q.Model(rows, np.array([1, 0] * 30))
    assert model.score(np.array([Q.features(good), Q.features(bad)])).round().tolist() == [1, 0]


def plain_features(text):
    text = text or ""
    out = np.zeros(Q.WIDTH)
    words = text.lower().split()
    for w, n in Counter(zlib.crc32(w.strip(Q.SIGNS).encode()) % Q.WORDS for w in words).items():
        out[w] = np.log1p(n)
    kinds = []
    for b in f" \n{text}\n ".encode():
        c = chr(b)
        kinds.append(1 if b > 127 else 1 if re.match("[a-z]", c) else 2 if re.match("[A-Z]", c) else 3 if c in "0123456789" else 4 if c in " \t" else 5 if c in "\n\r" else 6 + b % 25)
    for (x, y, z), n in Counter(zip(kinds, kinds[1:], kinds[2:])).items():
        at = Q.WORDS + (((x * 32 + y) * 32 + z) * 2654435761 >> 7) % Q.TRIGRAMS
        out[at] = np.log1p(np.expm1(out[at]) + n)
    for part, weight in ((slice(0, Q.WORDS), Q.WORD_WEIGHT), (slice(Q.WORDS, Q.WORDS + Q.TRIGRAMS), 1)):
        out[part] *= weight / max(np.sqrt((out[part] ** 2).sum()), 1e-9)
    pairs = list(zip(words, words[1:]))
    repeated = 1 - len(set(pairs)) / len(pairs) if pairs else 0
    twice = sum(a == b for a, b in pairs) / max(len(pairs), 1)
    for k in range(16):
        out[Q.WORDS + Q.TRIGRAMS + k] = Q.STEP_WEIGHT * (repeated > k / 16)
        out[Q.WORDS + Q.TRIGRAMS + 16 + k] = Q.STEP_WEIGHT * (twice > k / 16)
        out[Q.WORDS + Q.TRIGRAMS + 32 + k] = Q.STEP_WEIGHT * (len(words) > 2**k)
    return out


def test_brute_force(spark):
    """The registered query against features, weights, neighbours and votes in plain loops."""
    name = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{name}/documents.parquet").collect()}
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{name}/labels.parquet").collect() if zlib.crc32(str(r.doc_id).encode()) % 4 != 2}
    ids = sorted(i for i in labels if i in texts)
    x = np.array([plain_features(texts[i]) for i in ids])
    weight = np.log((1 + len(ids)) / (1 + (x > 0).sum(0))) + 1
    weight[-Q.STEPS :] = 1
    x *= weight
    x /= np.linalg.norm(x, axis=1)[:, None]
    model = quality_model(spark, name)
    # The directions hold as much of the labelled texts as the best ones do.
    best = np.linalg.svd(x, compute_uv=False)[: Q.LATENT]
    assert ((x @ model.directions) ** 2).sum() > 0.999 * (best**2).sum()
    latent = x @ model.directions
    got = {r.doc_id: r.score for r in QUERIES["op6_quality_votes"](spark, name).collect()}
    assert set(got) == set(texts)
    for doc, text in texts.items():
        own = plain_features(text) * weight
        z = own @ model.directions
        like = sorted(((z @ v / np.linalg.norm(z) / np.linalg.norm(v), labels[i]) for i, v in zip(ids, latent)), reverse=True)
        voters = [(max(s, 1e-6), y) for s, y in like if s >= like[min(Q.VOTERS, len(like)) - 1][0] - Q.TIE]
        want = sum(s**Q.POWER * y for s, y in voters) / sum(s**Q.POWER for s, _ in voters)
        assert abs(got[doc] - want) < 0.02, doc


def test_labels_of_absent_ids_take_no_place(spark):
    """100,000 labelled ids of which 100 have a document: all of those are learned, whatever the limit of the sample."""
    docs = spark.range(100).select((F.col("id") * 1000).alias("doc_id"), F.concat(F.lit("some text number "), F.col("id")).alias("text"))
    labels = spark.range(100_000).select(F.col("id").alias("doc_id"), (F.col("id") % 2).alias("label"))
    assert Q.fit(docs, labels, limit=100).labels.size == 100
    assert Q.fit(docs, labels, limit=30).labels.size == 30
    both = Q.fit(docs.unionByName(docs), labels.unionByName(labels), limit=60_000)
    assert both.labels.size == 100
