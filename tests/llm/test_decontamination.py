"""Decontamination: alignment and search against plain versions."""

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from colloquy.llm import decontamination as D


def plain_score(a, b):
    h = np.zeros((len(a) + 1, len(b) + 1))
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            h[i, j] = max(0, h[i - 1, j - 1] + (D.MATCH if a[i - 1] == b[j - 1] else D.MISMATCH), h[i - 1, j] + D.GAP, h[i, j - 1] + D.GAP)
    return h.max()


WORDS = st.lists(st.integers(0, 4), min_size=1, max_size=14)


@settings(max_examples=400, deadline=None)
@given(WORDS, WORDS)
def test_alignment(a, b):
    score, first, last = D.align(np.array(a), np.array(b))
    assert score == plain_score(a, b)
    if score:
        assert plain_score(a, b[first : last + 1]) == score


ITEM = "the quick brown fox jumps over a lazy dog while seven wizards quietly brew strong tea at midnight"
OTHER = "many small birds sing from tall green trees when early light comes over our cold river"
FILL = " ".join(f"fill{i}" for i in range(400))


def test_search(spark):
    edited = ITEM.upper().replace("BROWN", "red").replace("QUIETLY ", "").replace("TEA", "tea, hot,")
    docs = [
        (1, f"{FILL} {ITEM}. {FILL}"), (2, f"{FILL}\n{edited} {FILL}"), (3, FILL), (4, None), (5, ""), (6, " ".join(ITEM.split()[:4]) + FILL),
        (7, f"{OTHER} {FILL * 20} ***{ITEM}***"), (7, f"{OTHER} {FILL * 20} ***{ITEM}***"), (None, ITEM),
        (9, " ".join(ITEM.split()[::-1])), (10, "a Tiny, one; tiny two"), (11, "one tiny"), (12, "unique!"),
    ]
    items = [(1, ITEM), (2, OTHER), (3, None), (4, "tiny one"), (5, ""), (6, "Unique"), (7, "...")]
    d = spark.createDataFrame(docs, "doc_id long, text string").withColumn("item_id", F.lit("clash")).withColumn("text_key", F.lit("clash")).repartition(3)
    b = spark.createDataFrame(items, "item_id long, text string").withColumn("doc_id", F.lit(1))
    for size in (D.BLOCK_WORDS, 1):
        got = sorted(((str(r.doc_id), r.item_id) for r in D.contaminated(d, b, block_words=size).collect()))
        assert got == [("1", 1), ("10", 4), ("12", 6), ("2", 1), ("7", 1), ("7", 1), ("7", 2), ("7", 2), ("None", 1)]
    assert D.contaminated(d, b.limit(0)).count() == 0
    assert D.contaminated(d.limit(0), b).count() == 0


def test_common_passage(spark):
    """An item in every document has no rare n-gram and is still found."""
    docs = spark.createDataFrame([(i, f"d{i} {ITEM} {FILL}") for i in range(60)], "doc_id long, text string")
    assert D.contaminated(docs, spark.createDataFrame([(1, ITEM)], "item_id long, text string")).count() == 60


def test_common_edited_passage(spark):
    """Copies with changed words, or of a part of the item, are found however many documents hold them."""
    changed = ITEM.replace("fox", "cat").replace("seven", "nine").replace("strong", "weak")
    part = " ".join(ITEM.split()[:11])
    items = spark.createDataFrame([(1, ITEM)], "item_id long, text string")
    for copy in (changed, part):
        docs = spark.createDataFrame([(i, f"d{i} {copy} {FILL}") for i in range(60)], "doc_id long, text string")
        assert D.contaminated(docs, items).count() == 60


def test_all_pairs(spark):
    """Every pair whose whole alignment reaches the threshold is found on the small tables."""
    name = "/root/testdata/sf0.001"
    docs, items = (spark.read.parquet(f"{name}/{t}.parquet") for t in ("documents", "benchmark"))
    got = {(r.doc_id, r.item_id) for r in D.contaminated(docs, items).collect()}
    rows = [(r.item_id, r.text) for r in items.collect()]
    all_ = D.Items(rows)
    read, want = all_.reader(), set()
    for r in docs.collect():
        words = read(r.text)
        for k, item in enumerate(all_.ids):
            own = all_.words(k)
            if D.MATCH * np.isin(own, words).sum() >= D.THRESHOLD * D.MATCH * own.size and D.align(own, words)[0] >= D.THRESHOLD * D.MATCH * own.size:
                want.add((r.doc_id, item))
    assert want and got == want


def test_short_items_give_one_row_a_text(spark):
    docs = spark.createDataFrame([(1, "yes " * 5000 + "no"), (2, "The end. the END"), (3, "no")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "yes"), (2, "the end"), (3, ITEM)], "item_id long, text string")
    got = {(r.doc_id, r.item_id): (r.first_word, r.last_word, r.places) for r in D.contaminated(docs, items).collect()}
    assert got == {(1, 1): (0, 0, 5000), (2, 2): (0, 1, 2)}
    assert D.contaminated(docs, items, least_item_words=5).count() == 0
    assert D.contaminated(docs.limit(0).unionByName(spark.createDataFrame([(4, ITEM)], docs.schema)), items, least_item_words=5).count() == 1


def test_common_openings():
    """Thousands of items begin alike: a text full of that opening opens windows only where an item's rare words stand."""
    import random
    import time

    rnd, opening = random.Random(0), "which of the following is true about"
    rare, other = [f"v{i}" for i in range(30_000)], [f"z{i}" for i in range(500)]
    rows = [(k, f"{opening} {' '.join(rnd.choices(rare, k=8))}") for k in range(4000)]
    words = sum((opening.split() + rnd.choices(other, k=60) for _ in range(150)), []) + rows[7][1].replace("true", "false").split()
    items = D.Items(rows)
    read = items.reader()
    text = read(" ".join(words))
    began = time.monotonic()
    found = [(item, D.align(items.words(item), window)[0]) for item, _, window in items.candidates(text, *items.hits(text))]
    assert time.monotonic() - began < 3
    assert [item for item, score in found if score >= items.need[item]] == [7]


def test_windows_lose_nothing():
    """Against every window of every item with hits, on random texts of few words with common openings."""
    import random

    for seed in range(60):
        rnd = random.Random(seed)
        vocabulary = [f"w{i}" for i in range(rnd.choice([4, 8, 30]))]
        head = " ".join(rnd.choices(vocabulary, k=5))
        items = D.Items([(k, head + " " + " ".join(rnd.choices(vocabulary, k=rnd.randint(0, 15)))) for k in range(12)])
        words = items.reader()(" ".join(rnd.choices(vocabulary + ["zz"] * 6, k=120)))
        at, number = items.hits(words)
        if not at.size:
            continue
        got = {(item, first, tuple(w.tolist())) for item, first, w in items.candidates(words, at, number)}
        want = set()
        for item in range(len(items.ids)):
            own = items.words(item)
            m, slack = own.size, own.size // 2 + 2
            starts = sorted(int(p) - q for p in range(words.size - 2) for q in range(m - 2) if (words[p : p + 3] == own[q : q + 3]).all())
            spans = []
            for s in starts:
                lo, hi = max(s - slack, 0), min(s + m + slack, words.size)
                if spans and lo <= spans[-1][1]:
                    spans[-1][1] = max(spans[-1][1], hi)
                else:
                    spans.append([lo, hi])
            for lo, hi in spans:
                window = words[lo:hi]
                if D.MATCH * np.isin(own, window).sum() >= items.need[item]:
                    want.add((item, lo, tuple(window.tolist())))
        assert got == want
