"""Extractive summaries: overview, key points, action items, decisions, questions, and answers.

A session's sentences are scored by how often their words occur in the session's
sentences. One hash partitioning by session serves all steps.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from colloquy.functions import text as X
from colloquy.sources import scratch

#: Words that carry no content. Fixed value.
STOP_WORDS = (
    "the a an and or but if so to of in on at for with is are was were be been being it its this that these those "
    "i you he she we they him his her our your their my me us do does did have has had will would can could should "
    "shall may might must not no yes okay ok um uh like just really very also then than there here what when where "
    "which who how why all any some as from by about into over after before up down out off again going get got "
    "think know want say said see one two thing things stuff bit lot"
).split()
#: Phrases by which sentences are told apart. Fixed values.
ACTIONS = (
    r"will|we'll|i'll|going to|need(?:s)? to|has to|have to|let's|let us|make sure|follow(?:ing)? up|schedule|send|review|prepare|"
    r"set up|reach out|assign(?:ed)?|due|deadline|action item|take care of|get back to|"
    r"by (?:monday|tuesday|wednesday|thursday|friday|saturday|sunday|tomorrow|next week|end of|eod|eow)"
)
IMPERATIVES = (
    "send|schedule|review|prepare|set|create|update|draft|share|check|confirm|book|invite|email|call|follow|finish|complete|assign|"
    "collect|organize|write"
)
DECISIONS = (
    r"decided|decision|agreed?(?:s|d)? (?:to|on|that)|approved|confirmed|finali[sz]ed|going with|settled on|signed off|"
    r"green.?light|consensus"
)
MIN_TOKENS, DIGIT_BONUS, SAME = 4, 1.25, 0.6
OVERVIEW, ITEMS, DECISIONS_KEPT, PAIRS = 3, 12, 8, 10
KEY_POINTS = {"meeting": 6, "lecture": 8, "interview": 5}
QUESTIONS = {"meeting": 5, "lecture": 5, "interview": 12}


def kind(t: Column) -> Column:
    """question, decision, action or prose, the first that fits."""
    return (
        F.when(t.rlike(rf"\?[{X.WS}]*\z"), "question")
        .when(t.rlike(f"(?i){X.EDGE}(?:{DECISIONS}){X.EDGE}"), "decision")
        .when(t.rlike(f"(?i){X.EDGE}(?:{ACTIONS}){X.EDGE}") | t.rlike(f"(?i)^(?:{IMPERATIVES}){X.EDGE}"), "action")
        .otherwise("prose")
    )


def _pieces(segments: DataFrame) -> DataFrame:
    """``session_id, seg_ord, piece, speaker_id, text, words``: sentences of four tokens and more."""
    final = segments.where(~F.coalesce(F.col("interim"), F.lit(False)))
    pieces = final.select("session_id", "seg_ord", "speaker_id", F.posexplode(X.sentences(F.col("text"))).alias("piece", "raw"))
    rows = pieces.select("session_id", "seg_ord", "piece", "speaker_id", X.trim(F.col("raw")).alias("text"))
    rows = rows.where(F.size(F.split("text", rf"[{X.WS}]+")) >= MIN_TOKENS)
    tokens = X.words(F.regexp_replace(F.lower("text"), rf"[^a-z0-9{X.WS}']", ""))
    content = F.array_except(F.filter(tokens, lambda w: F.length(w) > 2), F.array(*map(F.lit, STOP_WORDS)))
    return rows.withColumn("words", content)


def _numbered(pieces: DataFrame) -> DataFrame:
    number = F.row_number().over(Window.partitionBy("session_id").orderBy("seg_ord", "piece")) - 1
    return pieces.select("session_id", number.alias("ord"), "speaker_id", "text", "words")


def sentences(segments: DataFrame) -> DataFrame:
    """``session_id, ord, speaker_id, text, words``: sentences of four tokens and more, numbered within the session."""
    return _numbered(_pieces(segments))


def _scored_once(segments: DataFrame) -> DataFrame:
    """Scored sentences; they are written first, as scoring reads them twice and cutting them costs more than that."""
    return scored(_numbered(scratch.written(_pieces(segments), "sentences")))


def scored(rows: DataFrame) -> DataFrame:
    """Sentences with ``score``: their words' sentence counts, damped by length, more with a digit."""
    words = rows.select("session_id", "ord", F.explode("words").alias("word"))
    often = F.count("*").over(Window.partitionBy("session_id", "word"))
    sums = words.withColumn("n", often).groupBy("session_id", "ord").agg(F.sum("n").alias("total"))
    score = F.coalesce(F.col("total") / F.sqrt(F.size("words") + F.lit(3.0)), F.lit(0.0))
    bonus = F.when(F.col("text").rlike("[0-9]"), F.lit(DIGIT_BONUS)).otherwise(F.lit(1.0))
    return rows.join(sums, ["session_id", "ord"], "left").select(*rows.columns, (score * bonus).alias("score"))


def classified(segments: DataFrame) -> DataFrame:
    """Scored sentences with their ``kind``."""
    return _scored_once(segments).withColumn("kind", kind(F.col("text")))


def top_sentences(segments: DataFrame, k: int = OVERVIEW) -> DataFrame:
    """The ``k`` best-scored sentences of each session, ties by order."""
    rank = F.row_number().over(Window.partitionBy("session_id").orderBy(F.desc("score"), "ord"))
    return _scored_once(segments).withColumn("rank", rank).where(F.col("rank") <= k).select("session_id", "rank", "ord", "speaker_id", "text", "score")


#: Sentences of prose that are looked at as one list, and the mark of a session that may need more.
BLOCK, MORE = 512, "more prose"

PICK = "array<struct<rank: double, ord: int, text: string, words: array<string>>>"


def _like(a: Column, b: Column) -> Column:
    common = F.size(F.array_intersect(a["words"], b["words"]))
    union = F.size(a["words"]) + F.size(b["words"]) - common
    return (union > 0) & (common / union > SAME)


def _pick(ranked: Column, k: int, start: Column | None = None) -> Column:
    """From sentences best first, those unlike all picked before, up to ``k``; ``start`` are picked already."""

    def step(picked: Column, x: Column) -> Column:
        skip = (F.size(picked) >= k) | F.exists(picked, lambda p: _like(p, x))
        return F.when(skip, picked).otherwise(F.concat(picked, F.array(x)))

    return F.aggregate(ranked, F.array().cast(PICK) if start is None else start, step)


def _sections(prose: Column, template: str, line) -> Column:
    """``line(section, sentence)`` of overview and key points, from the best prose of one session.

    A session that has more prose than that, and fewer picks than there may be, has a line :data:`MORE` instead.
    """
    overview = lambda p, o: F.filter(p, lambda x: ~F.exists(o, lambda y: y["ord"] == x["ord"]))
    most = KEY_POINTS[template]

    def both(p: Column, o: Column, k: Column) -> Column:
        lines = lambda name, x: F.transform(x, lambda y: line(name, y))
        few = (F.size(p) >= BLOCK) & ((F.size(o) < OVERVIEW) | (F.size(k) < most))
        return F.when(few, lines(MORE, F.slice(p, 1, 1))).otherwise(F.concat(lines("overview", o), lines("key_points", k)))

    return _let(F.array_sort(prose).cast(PICK), lambda p: _let(_pick(p, OVERVIEW), lambda o: _let(_pick(overview(p, o), most), lambda k: both(p, o, k))))


def _let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _prose() -> Column:
    """The best sentences of prose as entries of which the best come first; rows have ``_best``, their rank in session and kind."""
    return F.collect_list(F.when((F.col("kind") == "prose") & (F.col("_best") <= BLOCK), F.struct((-F.col("score")).alias("rank"), "ord", "text", "words")))


def _ranked(rows: DataFrame) -> DataFrame:
    return rows.withColumn("_best", F.row_number().over(Window.partitionBy("session_id", "kind").orderBy(F.desc("score"), "ord")))


def picked(rows: DataFrame, template: str) -> DataFrame:
    """``session_id, section, ord, text`` of overview and key points, from classified sentences.

    The best :data:`BLOCK` sentences of a session's prose are one array, best first. Sessions of more prose that
    need further sentences get them in rounds, see :func:`_in_rounds`.
    """
    line = lambda name, s: F.struct(F.lit(name).alias("section"), s["ord"].alias("ord"), s["text"].alias("text"))
    found = _ranked(rows.where("kind = 'prose'")).where(F.col("_best") <= BLOCK).groupBy("session_id").agg(_sections(_prose(), template, line).alias("both"))
    found = found.select("session_id", F.explode("both").alias("s")).select("session_id", "s.*")
    return _completed(found, rows, template)


def _completed(found: DataFrame, rows: DataFrame, template: str) -> DataFrame:
    """``found`` with the picks of the sessions that have a line :data:`MORE` in place of it."""
    found = scratch.written(found, "summary")
    more = found.where(F.col("section") == MORE).select("session_id")
    if more.isEmpty():
        return found
    prose = rows.where("kind = 'prose'").join(more, "session_id", "left_semi").select("session_id", (-F.col("score")).alias("rank"), "ord", "text", "words")
    prose = scratch.written(prose, "prose")
    overview = _in_rounds(prose, OVERVIEW)
    points = _in_rounds(prose.join(overview, ["session_id", "ord"], "left_anti"), KEY_POINTS[template])
    both = overview.select("session_id", F.lit("overview").alias("section"), "ord", "text").unionByName(points.select("session_id", F.lit("key_points").alias("section"), "ord", "text"))
    for field in found.schema:
        if field.name not in both.columns:
            both = both.withColumn(field.name, F.lit(None).cast(field.dataType))
    return found.where(F.col("section") != MORE).unionByName(both.select(found.columns))


def _in_rounds(prose: DataFrame, k: int) -> DataFrame:
    """``session_id, ord, text``: the sentences of ``prose`` that :func:`_pick` picks, for sessions of any length.

    A round takes the best :data:`BLOCK` sentences of a session that come after the last ones and are like none
    that is picked already; every task keeps no more of a session. The first of them is picked
    for certain, so there are as many rounds as picks at most, and usually one or two.
    """
    best = Window.partitionBy("session_id").orderBy("rank", "ord")
    entry = F.struct("rank", "ord", "text", "words")
    state, done = None, []
    while True:
        if state is None:
            left = prose.withColumn("p", F.array().cast(PICK))
        else:
            left = prose.join(state.where("open").drop("open"), "session_id")
            left = left.where((F.struct("rank", "ord") > F.col("last")) & ~F.exists("p", lambda x: _like(x, entry))).drop("last")
        top = left.withColumn("_n", F.row_number().over(best)).where(F.col("_n") <= BLOCK)
        step = top.groupBy("session_id").agg(F.array_sort(F.collect_list(entry)).alias("x"), F.first("p").alias("p"))
        step = step.withColumn("now", _pick(F.col("x"), k, F.col("p")))
        last = F.element_at("x", -1)
        made = step.select(
            "session_id", F.col("now").alias("p"), F.struct(last["rank"].alias("rank"), last["ord"].alias("ord")).alias("last"),
            ((F.size("x") >= BLOCK) & (F.size("now") < k)).alias("open"),
        )
        # A session whose pool ran out in this round keeps what it had.
        made = made if state is None else made.unionByName(state.where("open").join(made, "session_id", "left_anti").withColumn("open", F.lit(False)))
        state = scratch.written(made, "picks")
        done.append(state.where("not open"))
        if state.where("open").isEmpty():
            break
    rows = done[0]
    for more in done[1:]:
        rows = rows.unionByName(more)
    return rows.select("session_id", F.explode("p").alias("s")).select("session_id", "s.ord", "s.text")


def first_items(rows: DataFrame, which: str, limit: int) -> DataFrame:
    """The first ``limit`` sentences of a kind in each session."""
    nth = F.row_number().over(Window.partitionBy("session_id").orderBy("ord"))
    return rows.where(F.col("kind") == which).withColumn("nth", nth).where(F.col("nth") <= limit).drop("nth")


def top_questions(rows: DataFrame, limit: int) -> DataFrame:
    nth = F.row_number().over(Window.partitionBy("session_id").orderBy(F.desc("score"), "ord"))
    return rows.where(F.col("kind") == "question").withColumn("nth", nth).where(F.col("nth") <= limit).drop("nth")


def _answer() -> Column:
    """Of a question, the first of the next three sentences that someone else says and that asks nothing."""
    by = Window.partitionBy("session_id").orderBy("ord")
    asks = F.col("kind") == "question"
    candidates = []
    for k in (1, 2, 3):
        ok = ~F.lead(asks, k).over(by) & (F.lead("speaker_id", k).over(by) != F.col("speaker_id"))
        candidates.append(F.when(ok, F.struct(F.lead("text", k).over(by).alias("text"), F.lead("speaker_id", k).over(by).alias("speaker_id"))))
    return F.when(asks, F.coalesce(*candidates))


def qa_pairs(rows: DataFrame, limit: int = PAIRS) -> DataFrame:
    """Questions with the first of the next three sentences that someone else says and that asks nothing."""
    by = Window.partitionBy("session_id").orderBy("ord")
    pairs = rows.withColumn("_answer", _answer()).where(F.col("_answer").isNotNull())
    pairs = pairs.withColumn("_nth", F.row_number().over(by)).where(F.col("_nth") <= limit)
    return pairs.select(
        "session_id", "ord", F.col("text").alias("question"), F.col("_answer.text").alias("answer"),
        F.col("speaker_id").alias("asker_id"), F.col("_answer.speaker_id").alias("answerer_id"),
    )


_LINE = "array<struct<section: string, ord: int, text: string, owner_id: int, answer: string, answerer_id: int>>"


def summary(segments: DataFrame, template: str = "meeting") -> DataFrame:
    """Long form: ``session_id, section, ord, text, owner_id, answer, answerer_id``.

    Sections are overview, key_points, action_items, decisions, questions and, for
    interviews, qa_pairs. Sentences are made and classified once; windows over the
    session number them, and one aggregation takes all sections.
    """
    by = Window.partitionBy("session_id", "kind")
    rows = classified(segments).withColumns({"_nth": F.row_number().over(by.orderBy("ord")), "_best": F.row_number().over(by.orderBy(F.desc("score"), "ord"))})
    kind = F.col("kind")
    none = {"owner_id": F.lit(None).cast("int"), "answer": F.lit(None).cast("string"), "answerer_id": F.lit(None).cast("int")}

    def lines(which: Column, section: str, **more: Column) -> Column:
        values = none | more
        return F.collect_list(F.when(which, F.struct(F.lit(section).alias("section"), "ord", "text", *(v.alias(k) for k, v in values.items())))).cast(_LINE)

    listed = [
        lines((kind == "action") & (F.col("_nth") <= ITEMS), "action_items", owner_id=F.col("speaker_id")),
        lines((kind == "decision") & (F.col("_nth") <= DECISIONS_KEPT), "decisions"),
        lines((kind == "question") & (F.col("_best") <= QUESTIONS[template]), "questions"),
    ]
    if template == "interview":
        rows = rows.withColumn("_answer", _answer())
        answered = F.count_if(F.col("_answer").isNotNull()).over(Window.partitionBy("session_id").orderBy("ord"))
        rows = rows.withColumn("_pair", answered)
        pair = F.col("_answer").isNotNull() & (F.col("_pair") <= PAIRS)
        listed.append(lines(pair, "qa_pairs", owner_id=F.col("speaker_id"), answer=F.col("_answer.text"), answerer_id=F.col("_answer.speaker_id")))
    line = lambda name, s: F.struct(F.lit(name).alias("section"), s["ord"].alias("ord"), s["text"].alias("text"), *(v.alias(k) for k, v in none.items()))
    prose = _sections(_prose(), template, line).cast(_LINE)
    whole = rows.groupBy("session_id").agg(F.concat(prose, *listed).alias("lines"))
    return _completed(whole.select("session_id", F.explode("lines").alias("x")).select("session_id", "x.*"), rows, template)


#: Sections in the order of the text, their headings and line starts. Fixed values.
HEADINGS = (
    ("overview", "OVERVIEW", "  "), ("key_points", "KEY POINTS", "  - "), ("action_items", "ACTION ITEMS", "  [ ] "),
    ("decisions", "DECISIONS", "  - "), ("qa_pairs", "Q & A", "  Q: "), ("questions", "OPEN QUESTIONS", "  - "),
)


def summary_text(found: DataFrame, speakers: DataFrame) -> DataFrame:
    """``session_id, summary``: the summary as text; a session without any has no row.

    Pairs take the place of open questions. Owners without a name are 'Unassigned'.
    """
    names = speakers.select("session_id", F.col("id").alias("owner_id"), "name")
    rows = found.join(names, ["session_id", "owner_id"], "left")
    section = F.col("section")
    place, start, heading = F.lit(0), F.lit(""), F.lit("")
    for k, (name, head, begin) in enumerate(HEADINGS):
        place, start, heading = (F.when(section == name, F.lit(v)).otherwise(o) for v, o in ((k, place), (begin, start), (head, heading)))
    owner = F.when(section == "action_items", F.concat(F.lit(" ("), F.coalesce("name", F.lit("Unassigned")), F.lit(")"))).otherwise("")
    answer = F.when(section == "qa_pairs", F.concat(F.lit("\n  A: "), F.col("answer"))).otherwise("")
    line = F.concat(start, F.col("text"), owner, answer)
    parts = rows.groupBy("session_id", place.alias("place"), heading.alias("heading")).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", line.alias("line")))), lambda x: x["line"]), "\n").alias("lines")
    )
    body = F.concat(F.when(F.col("place") > 0, F.lit("\n")).otherwise(""), F.col("heading"), F.lit("\n"), F.col("lines"))
    whole = parts.groupBy("session_id").agg(F.array_sort(F.collect_list(F.struct("place", body.alias("body")))).alias("parts"))
    answered = F.exists("parts", lambda p: p["place"] == 4)
    shown = F.filter("parts", lambda p: ~(answered & (p["place"] == 5)))
    return whole.select("session_id", F.array_join(F.transform(shown, lambda p: p["body"]), "\n").alias("summary"))


def sessions_with_summary(found: DataFrame) -> DataFrame:
    """Sessions with a summary; pairs alone do not make one."""
    return found.where(F.col("section") != "qa_pairs").select("session_id").distinct()
