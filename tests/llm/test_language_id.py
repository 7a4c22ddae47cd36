"""Language: the parse against a plain one without cuts, and held-out accuracy."""

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from colloquy.llm import language_id as L
from colloquy.llm.queries import QUERIES

SAMPLES = {"a": "abra cadabra abba", "b": "bebe cede babe dada", "c": "zzz yyy", "d": "".join(map(chr, range(0x4E00, 0x4E90)))}
MODEL = L.Model(SAMPLES)


def letters_of(text):
    """Lower-case letters, runs of other characters as one space, none at the start."""
    out = []
    for c in text.lower():
        if c.isalpha():
            out.append(c)
        elif out and out[-1] != " ":
            out.append(" ")
    return "".join(out)


def plain(text, sample):
    """Phrases of the longest matches, from the first character to the last."""
    text, sample, i, n = letters_of(text), letters_of(sample), 0, 0
    while i < len(text):
        j = i + 1
        while j <= len(text) and text[i:j] in sample:
            j += 1
        i = max(j - 1, i + 1)
        n += 1
    return n


TEXTS = st.text("abcdey z.É一丐あ", max_size=40) | st.sampled_from(["abra ", "ab", "cadabra abba", "é!"]).map(lambda x: x * 150)


@settings(max_examples=60, deadline=None)
@given(st.lists(TEXTS, max_size=5), st.sampled_from([7, 256]), st.sampled_from([11, 1 << 20]))
def test_parse(texts, segment, part):
    before = L.SEGMENT, L.PART
    L.SEGMENT, L.PART = segment, part
    try:
        found, length, letters = MODEL.phrases(texts)
    finally:
        L.SEGMENT, L.PART = before
    for t, row, n, has in zip(texts, found, length, letters):
        assert list(row) == [plain(t, SAMPLES[k]) for k in MODEL.languages]
        assert n == len(letters_of(t)) and has == any(c.isalpha() for c in t)


@pytest.mark.parametrize("n", [300, 3_000_000])
def test_long(n):
    """No phrase is cut, however long the text."""
    rng = np.random.default_rng(n)
    text = "".join(np.array(["abra", "cad", "abba", " ", "be", "z", "一"])[rng.integers(0, 7, n)])[:n]
    found, _, _ = MODEL.phrases([text, "abra"])
    assert list(found[0]) == [plain(text, SAMPLES[k]) for k in MODEL.languages]


def test_many_letters():
    """Letters of all scripts are told apart, also with more of them than in any one alphabet."""
    kana, common = "".join(map(chr, range(0x3041, 0x3091))), "".join(map(chr, range(0x4E00, 0x5200)))
    model = L.Model({"ja": kana + common[:80], "zh": common, "en": "some latin letters"})
    assert model.predict([kana[60:], common[500:540], "letters", "Ж"])[0][:3] == ["ja", "zh", "en"]


def test_every_language(spark):
    """However many languages there are, each is learned, and from anywhere in its texts."""
    rows = [(i, "x " * 300 + chr(0x4E00 + i % 150) * 900, f"l{i % 150:03d}") for i in range(300)]
    model = L.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"), passages=4)
    assert len(model.languages) == 150
    assert model.predict([chr(0x4E00 + 149) * 9])[0] == ["l149"]


def test_held_out(spark):
    name = "/root/testdata/sf0.01"
    got = QUERIES["op3_language_id"](spark, name).cache()
    docs = spark.read.parquet(f"{name}/documents.parquet")
    rows = got.where("held_out").join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert len(rows) > 200 and sum(r.lang_pred == r.lang for r in rows) / len(rows) >= 0.97
    assert got.count() == docs.count() and got.where("score not between 0 and 1").count() == 0


def test_edges(spark):
    rows = [(1, None, "a"), (2, "", "a"), (3, "123 !!", None), (4, "abra " * 300000, "b"), (4, "abra " * 300000, "b"), (None, "zzz", "c"), (7, "\U0001d400b", "d")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("score", F.lit("clash")).withColumn("_in0", F.lit("mine"))
    got = L.predicted(docs, MODEL, keep=("doc_id", "score", "_in0", "lang")).collect()
    assert len(got) == len(rows) and {r._in0 for r in got} == {"mine"}
    by = {r.doc_id: r for r in got}
    assert [by[i].lang_pred for i in (1, 2, 3, 4, None)] == ["und", "und", "und", "a", "c"]
    assert by[1].score == 0 and by[4].score > 0.3
    assert L.fit(docs).languages == ["a", "b", "d"]
    assert {r.lang_pred for r in L.predicted(docs, L.fit(docs.limit(0))).collect()} == {"und"}
    assert L.predicted(docs.limit(0), MODEL).count() == 0


def test_repeated_rows_take_no_other_place(spark):
    """A language of a few ids that are repeated by the thousand is learned like the others."""
    french = ["ceci est du francais et il fait beau", "nous avons des chevaux dans la cour", "les enfants jouent avec le chien"]
    english = "this is some english text about weather and horses number"
    rows = [(k % 3, french[k % 3], "fr") for k in range(30_000)] + [(100 + k, f"{english} {k}", "en") for k in range(50)]
    model = L.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert model.languages == ["en", "fr"]
    assert model.predict(["ceci est du francais", "this is english text"])[0] == ["fr", "en"]


def test_sample_is_never_empty(spark, monkeypatch):
    """Of a language of many ids the one of the least hash is always learned."""
    monkeypatch.setattr(L, "SAMPLE_DOCS", 0)
    rows = [(k, f"some words {k}", "en") for k in range(300)]
    assert L.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string")).languages == ["en"]


def test_long_text_fits_fast(spark):
    import time

    word = "beau temps dans la cour des chevaux "
    docs = spark.createDataFrame([(1, word * 110_000, "fr"), (2, "english words here", "en")], "doc_id long, text string, lang string")
    docs.count()
    began = time.monotonic()
    assert L.fit(docs).languages == ["en", "fr"] and time.monotonic() - began < 20
