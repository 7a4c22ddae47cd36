"""Detectors, edits and summaries on hand-made cases."""

import re
import time

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from colloquy import schemas
from colloquy.functions import text as X
from colloquy.operators import detect, edits, summary


def segments(spark, texts, speaker=lambda i: 0):
    rows = [("s", str(i), i, speaker(i), t, float(i), i + 1.0, None) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, schemas.SEGMENTS)


def found(spark, *texts):
    rows = detect.suggestions(segments(spark, texts)).orderBy("seg_ord", "det_ord", "lex_ord", "start").collect()
    assert all(texts[r.seg_ord][r.start : r.end] == r.excerpt for r in rows)
    return [(r.seg_ord, r.kind, r.start, r.end, r.replacement) for r in rows]


def test_golden(spark):
    long = " ".join(["word"] * 41)
    got = found(spark, "So um, we go", "the the plan", "a  b ,c", f"{long}.", " ".join(["word"] * 40), "", "   ", None)
    assert (0, "filler", 2, 6, "") in got
    assert (1, "stutter", 0, 7, "the") in got
    assert [x for x in got if x[0] == 2] == [(2, "spacing", 1, 3, " "), (2, "spacing", 4, 5, "")]
    assert (3, "run-on", 0, 80, None) in got
    assert not [x for x in got if x[0] == 4 and x[1] == "run-on"]
    assert not [x for x in got if x[0] > 4]


def test_spans_are_kept(spark):
    """Every kind, with letters outside ASCII, at the ends, and near misses."""
    got = found(
        spark,
        "Um UH, er! summer erm",
        "naïve ve ve Ve. ve",
        "It's banana, Banana and (BANANA) bananas",
        "Basically, I guess literally? I think maybe",
        "In order to circle back; going forward TOUCH BASE",
        "sort of kind of you know um um",
    )
    assert [x[2:] for x in got if x[0] == 0] == [(0, 2, ""), (2, 6, ""), (6, 9, ""), (17, 21, "")]
    # 'ï' is no ASCII letter, so a word begins behind it.
    assert [x[2:4] for x in got if x[0] == 1 and x[1] == "stutter"] == [(3, 8), (9, 14)]
    assert [x[2:4] for x in got if x[0] == 2 and x[1] == "repeated-word"] == [(5, 11)]
    assert [x[2] for x in got if x[0] == 3 and x[1] == "hedge"] == [30, 11, 0, 19]
    assert [x[4] for x in got if x[0] == 4 and x[1] == "weak-phrase"] == ["to", "follow up", "check in", "from now on"]
    assert len([x for x in got if x[0] == 5 and x[1] == "filler"]) == 5


def test_phrases_that_share_words(spark):
    got = found(spark, "I just wanted to be honest about it")
    assert [(k, a, b) for _, k, a, b, _ in got] == [("hedge", 2, 16), ("hedge", 14, 26)]


def plain_items(text):
    """The detectors as plain patterns, one scan for each phrase."""
    ws = X.WS
    for k, phrase in enumerate(detect.FILLERS):
        for m in re.finditer(rf"(?ai)(?<![^{ws}]){re.escape(phrase)}(?![^{ws},.!?])", text):
            yield "filler", k, m.start() - (text[m.start() - 1 : m.start()] == " "), m.end() + (text[m.end() : m.end() + 1] == ",")
    for m in re.finditer(rf"(?ai)\b(\w+)([,.]?[{ws}]+)\1\b", text):
        yield "stutter", 0, m.start(), m.end()
    for k, phrase in enumerate(detect.HEDGES):
        for m in re.finditer(rf"(?ai)(?<![^{ws}]){re.escape(phrase)}(?![^{ws},.!?])", text):
            yield "hedge", k, m.start(), m.end()
    for k, (phrase, _, _) in enumerate(detect.WEAK_PHRASES):
        for m in re.finditer(rf"(?ai)\b{re.escape(phrase)}\b", text):
            yield "weak-phrase", k, m.start(), m.end()
    for m in re.finditer(rf" {{2,}}|[{ws}]+(?=[,.!?])", text):
        yield "spacing", 0, m.start(), m.end()


PIECES = ["um", "Uh,", "the", "the", "The.", "you know", "i mean", "just wanted to", "be honest", "to be honest", "in order to", "touch base", ",", ".", "!", " ", "  ", "\n", "\t ", "é", "x_y", "so", "\u00a0", "kind of"]


@settings(max_examples=500, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(PIECES), st.sampled_from(["", " ", " ", ", ", "  ", " ,"])), max_size=15))
def test_against_plain_patterns(parts):
    text = "".join(a + b for a, b in parts)
    kinds = ("filler", "stutter", "hedge", "weak-phrase", "spacing")
    assert [(kind, i[0], i[1], i[2]) for kind, i in detect.found_in(text, kinds)] == list(plain_items(text))
    slow, fast = text, edits.fixed_wholly(text)
    while (new := edits.fixed_once(slow)) is not None:
        slow = new
    assert fast == slow


def test_time_is_linear():
    def seconds(n):
        text = "um the the plan  , is in order to " * n + "\n" * n
        began = time.perf_counter()
        assert sum(1 for _ in detect.found_in(text)) >= 4 * n
        return time.perf_counter() - began

    seconds(100)
    assert seconds(16000) < 8 * max(seconds(4000), 0.02)


def test_repeated_words_against_counter(spark):
    text = " ".join(f"word{'abcde'[i % 5]}x {'other' * (i % 3)}" for i in range(50))
    tokens = re.findall(r"\b[a-z']{5,}\b", text, re.ASCII)
    want = sorted(text.index(w) for w in set(tokens) if tokens.count(w) >= 3)
    assert sorted(x[2] for x in found(spark, text) if x[1] == "repeated-word") == want


def test_fixes(spark):
    rows = segments(spark, ["So um, we go", "the the plan is  set", "nothing here", "I guess so", None])
    assert [r.text for r in edits.apply_first(rows).orderBy("seg_ord").collect()] == ["So we go", "the plan is set", "nothing here", "I guess so", None]
    all_ = detect.suggestions(rows)
    first = edits.first_fixes(all_)
    by_join = edits.fixed(rows, first)
    assert [r.text for r in by_join.orderBy("seg_ord").collect()] == ["So we go", "the plan is set", "nothing here", "I guess so", None]
    left = edits.remaining(all_, first).collect()
    assert {r.seg_id for r in left} == {"3"}
    assert edits.dismissed(all_, "s", "3", "hedge", 0).count() == all_.count() - 1
    done = [r.text for r in edits.apply_all(segments(spark, ["um um um the the the the cat"]), 8).collect()]
    assert done == ["the cat"]
    assert detect.flagged(rows, all_).count() == 3


def test_interim_is_skipped(spark):
    rows = segments(spark, ["um the the"]).withColumn("interim", F.lit(True))
    assert detect.suggestions(rows).count() == 0
    assert summary.sentences(rows).count() == 0


def test_sentences_are_cut_once(spark):
    """Scoring reads written sentences; it read and cut the texts twice before."""
    for rows in (summary.classified(segments(spark, ["We all agree on it. Send it to us."])), summary.top_sentences(segments(spark, ["We all agree on it."]))):
        assert "(?<=[.!?])" not in rows._jdf.queryExecution().toString()
        assert rows.count() == len(rows.select("ord").distinct().collect()) > 0


def test_kinds(spark):
    texts = ["Have we decided on the date?", "We decided we will ship it.", "Send it over now please.", "We all walk far today.", "The greenlight is here now."]
    got = summary.classified(segments(spark, ["We all agree.", *texts])).orderBy("ord").collect()
    assert [(r.text, r.kind) for r in got] == list(zip(texts, ["question", "decision", "action", "prose", "decision"]))


def plain_pick(rows, k):
    out = []
    for r in rows:
        words = set(r["words"])
        if len(out) < k and not any((u := len(words | set(p["words"]))) and len(words & set(p["words"])) / u > 0.6 for p in out):
            out.append(r)
    return out


def test_summary_against_plain(spark):
    texts = ["Apples grow near rivers. Apples grow near rivers today! Bears eat many red apples. Rivers carry 25 cold stones. "
             "Birds sing near rivers daily. Cold stones hold warm bears. Nobody saw seven bears there. Why do bears sing?",
             "They will review bears. We agreed to feed birds."]
    rows = summary.classified(segments(spark, texts, lambda i: i))
    ranked = sorted((r.asDict() for r in rows.collect() if r.kind == "prose"), key=lambda r: (-r["score"], r["ord"]))
    top = plain_pick(ranked, 3)
    rest = plain_pick([r for r in ranked if r not in top], 6)
    got = summary.picked(rows, "meeting").collect()
    for section, want in (("overview", top), ("key_points", rest)):
        assert sorted(r.ord for r in got if r.section == section) == sorted(w["ord"] for w in want)
    assert len(top) == 3
    pairs = summary.qa_pairs(rows).collect()
    assert [(r.question, r.answer, r.asker_id, r.answerer_id) for r in pairs] == [("Why do bears sing?", "They will review bears.", 0, 1)]
    names = spark.createDataFrame([("s", 1, "Ann", "#", 0.0)], schemas.SPEAKERS)
    text = summary.summary_text(summary.summary(segments(spark, texts, lambda i: i), "interview"), names).first().summary
    assert text.startswith("OVERVIEW\n  ") and "\n\nACTION ITEMS\n  [ ] They will review bears. (Ann)\n" in text
    assert text.endswith("\n\nQ & A\n  Q: Why do bears sing?\n  A: They will review bears.") and "OPEN QUESTIONS" not in text
    meeting = summary.summary_text(summary.summary(segments(spark, texts, lambda i: i)), names.limit(0)).first().summary
    assert "(Unassigned)" in meeting and meeting.endswith("\n\nOPEN QUESTIONS\n  - Why do bears sing?")


@pytest.mark.parametrize(
    ("expression", "want"),
    [
        (lambda: X.srt_time(F.lit(3725.5)), "01:02:05,500"), (lambda: X.srt_time(F.lit(-2.0)), "00:00:00,000"), (lambda: X.srt_time(F.lit(1.9996)), "00:00:02,000"),
        (lambda: X.clock(F.lit(3725.9)), "62:05"), (lambda: X.trim(F.lit(" \n a b ﻿\n")), "a b"), (lambda: X.capitalized(F.lit("élan VITAL")), "Élan VITAL"),
        (lambda: X.default_name(F.lit(0)), "Speaker 1"), (lambda: X.color(F.lit(9)), "#e2557b"), (lambda: X.audio_extension(F.lit("audio/mp4")), "m4a"),
        (lambda: X.draft_id(F.lit(1000000000000)), "draft-cre66i9s"), (lambda: X.backoff_ms(F.lit(9)), 3000.0), (lambda: X.cooldown_ms(F.lit(2)), 10000.0),
    ],
)
def test_functions(spark, expression, want):
    assert spark.range(1).select(expression().alias("x")).first().x == want


def test_all_fixes_to_the_end(spark):
    """Without a number of passes no fix is left, and the text is that of as many single passes as it takes."""
    texts = [
        "um " + " and the the cat , uh, sat  in order to, er, rest" * 9, "going um forward we we touch base .", "plain words", "", "  ", None, "um",
        " ".join(["so so"] * 20) + " due to the fact that (you know) it\t\t  , is  ",
    ]
    rows = segments(spark, texts)
    done = edits.apply_all(rows)
    assert detect.fixable(detect.suggestions(done)).count() == 0
    want = {r.seg_ord: r.text for r in rows.collect()}
    for _ in range(100):
        frame = segments(spark, [want[k] for k in sorted(want)])
        new = {r.seg_ord: r.text for r in edits.apply_first(frame).collect()}
        if new == want:
            break
        want = new
    assert {r.seg_ord: r.text for r in done.collect()} == want
    interim = segments(spark, ["um the the"]).withColumn("interim", F.lit(True))
    assert edits.apply_all(interim).first().text == "um the the"


def test_batches_are_small(spark):
    """A worker of fixes or suggestions holds few rows at once, however many its partition has; a smaller setting stays."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    try:
        for make in (edits.apply_all, edits.apply_first, detect.suggestions):
            for user, want in (("10000", detect.BATCH_ROWS), ("0", detect.BATCH_ROWS), ("100", 100)):
                spark.conf.set(key, user)
                make(segments(spark, ["um the the"]))
                assert int(spark.conf.get(key)) == want
    finally:
        spark.conf.set(key, before)
