"""Source divergences against a plain version, on rows with every odd case."""

import random
from collections import Counter, defaultdict

import duckdb
import pytest
from pyspark.sql import functions as F

from colloquy.llm import source_divergence as S

SCHEMA = "doc_id long, text string, lang string, source string"


def plain(rows):
    import re

    words = [re.findall("[^\x00-\x40\x5b-\x60\x7b-\x7f]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")) for _, t, *_ in rows]
    docs, groups = defaultdict(Counter), {}
    for (_, _, lang, source), w in zip(rows, words, strict=True):
        docs[lang or ""].update(set(w))
        groups.setdefault((lang or "", source or ""), Counter()).update(w)
    out = set()
    for lang in {g[0] for g in groups}:
        kept = sorted(t for t, n in docs[lang].items() if n >= 3)
        own = {s: c for (x, s), c in groups.items() if x == lang}
        share = lambda c: {t: 1 + 10**9 * (c[t] + 1) // (sum(c[k] for k in kept) + len(kept)) for t in kept}
        p = {s: share(c) for s, c in own.items()}
        whole = share(sum(own.values(), Counter()))
        for s in own:
            pairs = [(-sum((p[s][t] - p[o][t]) ** 2 // p[o][t] for t in kept), o.encode()) for o in own if o != s]
            terms = [(-((p[s][t] - whole[t]) ** 2 // whole[t]), t.encode()) for t in kept if own[s][t] and p[s][t] > whole[t]]
            for part, found in (("pair", sorted(pairs)), ("term", sorted(terms)[:200])):
                out |= {(lang, s, part, item.decode(), -v, k) for k, (v, item) in enumerate(found, 1)}
    return out


def odd_rows():
    rnd = random.Random(5)
    letters = ["a", "A", "b", "é", "É", "ß", "漢", "퟿", "", "😀"]
    word = lambda: "".join(rnd.choices(letters, k=rnd.randint(1, 4)))
    rows = [(i, " ".join(word() for _ in range(rnd.randint(0, 40))), rnd.choice(["en", "de", None]), rnd.choice(["s1", "s2", "s3", None])) for i in range(150)]
    rows += [(1, "same same-text 12 same", "en", "s1")] * 5 + [(None, None, "en", "s9"), (2, "", None, None), (3, "1 2 3", "xx", "s1"), (4, "once", "xx", "s2")]
    return rows + [(5, "long" * 30_000 + " \x00tail_of[it]", "en", "s2")] * 3


@pytest.mark.parametrize("small", [False, True])
def test_plain(spark, monkeypatch, small):
    """Also with tries written out early, blocks of two sources and few sums held."""
    if small:
        for name, value in (("BUFFER", 50), ("MAX_LEAVES", 100), ("SOURCE_BLOCK", 2), ("MAX_CELLS", 3)):
            monkeypatch.setattr(S, name, value)
    rows = odd_rows()
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3).withColumn("term", F.lit("clash")).withColumn("groups", F.lit(1))
    got = [tuple(r) for r in S.audited(docs).select("lang", "source", "part", "item", "value", "rank").collect()]
    assert len(got) == len(set(got)) and set(got) == plain(rows)


def test_more_terms_than_listed(spark):
    rows = [(i, f"w{'x' * (i // 3)} shared", "en", f"s{i % 2}") for i in range(900)] + [(i, " ".join(f"t{'y' * k}" for k in range(250)), "en", "s0") for i in range(3)]
    got = {tuple(r) for r in S.audited(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == plain(rows) and max(r[5] for r in got if r[2] == "term") == 200


def test_trie_order_and_numbers():
    rnd = random.Random(1)
    words = {bytes(rnd.choices(b"ab\xc3\xa9\xff", k=rnd.randint(1, 6))) for _ in range(500)}
    trie = S.Trie()
    number = {w: trie.leaf(w) for w in words}
    assert [trie.leaf(w) for w in words] == list(number.values()) and sorted(number.values()) == list(range(len(words)))
    assert list(trie.leaves()) == sorted(number.items())


def test_shares_do_not_overflow():
    import numpy as np

    counts, of = np.array([0, 7, 10**13, 8 * 10**15]), np.array([9 * 10**15] * 4)
    assert S._shares(counts, of).tolist() == [1 + 10**9 * (int(c) + 1) // int(n) for c, n in zip(counts, of, strict=True)]


def test_empty(spark):
    assert S.audited(spark.createDataFrame([], SCHEMA)).count() == 0


def test_query_and_sql(spark):
    from colloquy.llm.queries import ORACLES, QUERIES

    con = duckdb.connect()
    con.execute("CREATE VIEW documents AS SELECT * FROM '/root/testdata/sf0.001/documents.parquet'")
    want = {tuple(r) for r in con.execute(f"SELECT lang, source, part, item, value, rank FROM ({ORACLES['op11_source_divergence']})").fetchall()}
    got = {tuple(r) for r in QUERIES["op11_source_divergence"](spark, "/root/testdata/sf0.001").collect()}
    assert got == want and len(got) > 5000
