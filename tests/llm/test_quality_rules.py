"""Quality rules against a plain version."""

import re
from collections import Counter

from pyspark.sql import functions as F

from colloquy.llm import quality_rules as Q

LONG = " ".join(f"word{i}" for i in range(60))
ROWS = [
    (1, LONG, "a"),
    (2, None, "a"),
    (3, "", "b"),
    (4, "spam spam spam spam " * 30, "b"),
    (5, LONG + "\n" + " ".join(LONG.split()[10:25]) + "\n \n" + LONG, "b"),
    (6, "line one here\nline one here\n\n  \nline one here " + LONG, None),
    (6, "line one here\nline one here\n\n  \nline one here " + LONG, None),
    (None, "## **bold** | <tag> $5 \té\x0bx\x0cy\rz " + LONG, "b"),
    (8, "tail " + "a b c d e f g h " * 2 + LONG, "b"),
    (9, "x y " * 60000, "huge"),
]


def plain(text):
    text = text or ""
    words = [w for w in re.split("[ \t-\r]+", text) if w]
    grams = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    often = Counter(grams)
    covered = {j for i, g in enumerate(grams) if often[g] > 1 for j in range(i, i + 8)}
    lines = [x for x in text.split("\n") if re.search("[^ \t-\r]", x)]
    return len(words), sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered)


def test_counts(spark):
    docs = spark.createDataFrame(ROWS, "doc_id long, text string, source string").withColumn("n_words", F.lit("clash"))
    got = Q.judged(docs).collect()
    key = lambda r: (str(r[0]), r[1:])
    assert sorted(((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in got), key=key) == sorted(
        ((i, *plain(t)) for i, t, _ in ROWS), key=key
    )
    kept = {r.doc_id: r.kept for r in got}
    assert kept[1] and not kept[2] and not kept[4] and not kept[9]


def test_hosts(spark):
    bad = " ".join(f"word{i}###" for i in range(60))
    rows = [(i, bad if i % 10 else LONG, "bad") for i in range(100)] + [(100 + i, LONG if i else bad, "good") for i in range(50)]
    got = {r.doc_id: r for r in Q.judged(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert got[0].kept and got[0].host_rejected and not got[1].kept
    assert got[100].kept and not got[100].host_rejected


def test_verdicts_bite(spark):
    """On the small tables some hosts are rejected, and then some documents that no base rule rejects."""
    from colloquy.llm.queries import QUERIES

    got = QUERIES["op2_quality_rules"](spark, "/root/testdata/sf0.01")
    assert got.where("host_rejected").count() and got.where("not kept and not base_failed").count()


def test_clashes(spark):
    docs = spark.createDataFrame([(1, LONG, "a", 7, 8, 9)], "doc_id long, text string, source string, _t long, _host long, _hit long")
    row = Q.judged(docs, keep=("doc_id", "_t", "_host", "_hit")).first()
    assert (row._t, row._host, row._hit, row.n_words) == (7, 8, 9, 60)


def test_empty(spark):
    assert Q.judged(spark.createDataFrame([], "doc_id long, text string, source string")).count() == 0
