"""All registered queries (``QUERIES``) and their DuckDB oracles (``ORACLES``)."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from colloquy.functions import ranks, signal, vectors
from colloquy.functions import text as X
from colloquy.operators import cluster, detect, edits, intervals, ordered, store, summary
from colloquy.plans import fixtures as D
from colloquy.sources import exports, readers, scratch, waves
from colloquy.streaming import failover, live

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(oracle: str | None = None):
    """Register a function as the query of its name."""

    def add(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return add


#: DuckDB: sentences of ``seg``, numbered, with words, and their scores and kinds.
_STOP = ", ".join(f"'{w}'" for w in summary.STOP_WORDS)
_SENTENCES = rf"""pieces AS (
  SELECT session_id, seg_ord, speaker_id, unnest(p) AS raw, unnest(range(len(p))) AS piece
  FROM (SELECT *, string_split(regexp_replace(text, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)) AS p FROM seg)
), kept AS (
  SELECT session_id, seg_ord, piece, speaker_id, regexp_replace(raw, '^\s+|\s+$', '', 'g') AS text FROM pieces
), sent AS (
  SELECT session_id, row_number() OVER (PARTITION BY session_id ORDER BY seg_ord, piece) - 1 AS ord, speaker_id, text,
         list_distinct(list_filter(regexp_split_to_array(regexp_replace(lower(text), '[^a-z0-9\s'']', '', 'g'), '\s+'),
           lambda w: length(w) > 2 AND NOT list_contains([{_STOP}], w))) AS words
  FROM kept WHERE len(regexp_split_to_array(text, '\s+')) >= 4
), freq AS (
  SELECT session_id, word, count(*) AS n FROM (SELECT session_id, unnest(words) AS word FROM sent) GROUP BY ALL
), total AS (
  SELECT session_id, ord, sum(n) AS total FROM (SELECT session_id, ord, unnest(words) AS word FROM sent) JOIN freq USING (session_id, word) GROUP BY ALL
), scored AS (
  SELECT sent.*, coalesce(total / sqrt(len(words) + 3), 0) * CASE WHEN regexp_matches(text, '[0-9]') THEN 1.25 ELSE 1 END AS score,
         CASE WHEN regexp_matches(text, '\?\s*$') THEN 'question'
              WHEN regexp_matches(text, '(?i)\b({summary.DECISIONS})\b') THEN 'decision'
              WHEN regexp_matches(text, '(?i)\b({summary.ACTIONS.replace("'", "''")})\b') OR regexp_matches(text, '(?i)^({summary.IMPERATIVES})\b') THEN 'action'
              ELSE 'prose' END AS kind
  FROM sent LEFT JOIN total USING (session_id, ord)
)"""


@query(
    f"""WITH {D.SEGMENTS}, {_SENTENCES}, ranked AS (
  SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY score DESC, ord) AS rank FROM scored
) SELECT session_id, rank, ord, speaker_id, text, round(score, 6) AS score FROM ranked WHERE rank <= 3"""
)
def sentence_overview(spark, sf_dir):
    return summary.top_sentences(D.conversation_segments(spark, sf_dir)).withColumn("score", F.round("score", 6))


@query(f"WITH {D.SEGMENTS}, {_SENTENCES} SELECT session_id, word, n FROM freq")
def word_frequencies(spark, sf_dir):
    rows = summary.sentences(D.conversation_segments(spark, sf_dir))
    return rows.select("session_id", F.explode("words").alias("word")).groupBy("session_id", "word").agg(F.count("*").alias("n"))


_N_WORDS = r"len(list_filter(regexp_split_to_array(text, '\s+'), lambda w: w <> ''))"


@query(
    f"""WITH {D.SEGMENTS} SELECT session_id, sum({_N_WORDS})::BIGINT AS n_words, round(max(end_s), 6) AS length_s,
  count(*) AS n_segments, count(DISTINCT speaker_id) AS n_speakers FROM seg GROUP BY session_id"""
)
def transcript_stats(spark, sf_dir):
    return store.stats(D.conversation_segments(spark, sf_dir)).withColumn("length_s", F.round("length_s", 6))


@query(
    f"""WITH {D.SEGMENTS}, n AS (SELECT session_id, speaker_id, sum({_N_WORDS})::BIGINT AS n_words FROM seg GROUP BY ALL)
SELECT session_id, CASE speaker_id WHEN 0 THEN 'Speaker 1' WHEN 1 THEN 'Speaker 2' ELSE 'Unknown speaker' END AS speaker_name, n_words,
  round(n_words / sum(n_words) OVER (PARTITION BY session_id), 6) AS share FROM n"""
)
def speaker_talk_share(spark, sf_dir):
    rows = D.conversation_segments(spark, sf_dir).groupBy("session_id", "speaker_id").agg(F.sum(F.size(X.words(F.col("text")))).alias("n_words"))
    share = F.round(F.col("n_words") / F.sum("n_words").over(Window.partitionBy("session_id")), 6)
    return store.named(rows.withColumn("share", share), D.speakers(spark, sf_dir)).select("session_id", "speaker_name", "n_words", "share")


#: DuckDB has no look-around. Fillers of one word are tokens between white space that
#: begin with the filler and a sign; those of two words don't occur in the documents.
_FILLER_ROWS = rf"""tok AS (
  SELECT doc_id, text, unnest(t) AS token, unnest(range(len(t))) AS i
  FROM (SELECT doc_id, text, regexp_split_to_array(text, '\s') AS t FROM documents)
), placed AS (
  SELECT *, sum(length(token) + 1) OVER (PARTITION BY doc_id ORDER BY i) - length(token) - 1 AS p0 FROM tok
), fill AS (
  SELECT doc_id, text, p0, regexp_extract(token, '^(?i)({"|".join(f for f in detect.FILLERS if " " not in f)})([,.!?]|$)', 1) AS word FROM placed
), fillers AS (
  SELECT doc_id, (p0 - CASE WHEN p0 > 0 AND substr(text, p0::BIGINT, 1) = ' ' THEN 1 ELSE 0 END)::INTEGER AS start,
    (p0 + length(word) + CASE WHEN substr(text, (p0 + length(word) + 1)::BIGINT, 1) = ',' THEN 1 ELSE 0 END)::INTEGER AS "end", word
  FROM fill WHERE word <> ''
)"""


@query(
    f"""WITH {_FILLER_ROWS} SELECT doc_id::VARCHAR AS session_id, start, "end", 'Filler word — remove "' || word || '"' AS message FROM fillers"""
)
def filler_spans(spark, sf_dir):
    found = detect.suggestions(D.document_segments(spark, sf_dir), ("filler",))
    return found.select("session_id", "start", "end", "message")


_STUTTERS = r"""w AS (
  SELECT doc_id, unnest(t) AS word, unnest(s[2:]) AS sep, unnest(range(len(t))) AS i FROM (
    SELECT doc_id, regexp_extract_all(text, '[A-Za-z0-9_]+') AS t, regexp_split_to_array(text, '[A-Za-z0-9_]+') AS s FROM documents)
), linked AS (
  SELECT *, lower(word) = lower(lag(word) OVER o) AND regexp_full_match(lag(sep) OVER o, '[,.]?\s+') AS same FROM w WINDOW o AS (PARTITION BY doc_id ORDER BY i)
), runs AS (
  SELECT *, sum(CASE WHEN same THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM linked
), stutters AS (
  SELECT doc_id, sum(n // 2)::BIGINT AS n FROM (SELECT doc_id, run, count(*) AS n FROM runs GROUP BY ALL) GROUP BY doc_id HAVING sum(n // 2) > 0
)"""


@query(f"WITH {_STUTTERS} SELECT doc_id::VARCHAR AS session_id, n FROM stutters")
def stutter_counts(spark, sf_dir):
    found = detect.suggestions(D.document_segments(spark, sf_dir), ("stutter",))
    return found.groupBy("session_id").agg(F.count("*").alias("n"))


#: The stutters of a run of equal words are its first and second, third and fourth, and so on.
_STUTTER_SPANS = r"""w AS (
  SELECT doc_id, text, unnest(t) AS word, unnest(s[2:]) AS sep, unnest(range(len(t))) AS i, s[1] AS head FROM (
    SELECT doc_id, text, regexp_extract_all(text, '[A-Za-z0-9_]+') AS t, regexp_split_to_array(text, '[A-Za-z0-9_]+') AS s FROM documents)
), placed AS (
  SELECT *, length(head) + sum(length(word) + length(sep)) OVER o - length(word) - length(sep) AS pos, lead(word) OVER p AS next,
    lower(word) = lower(lag(word) OVER p) AND regexp_full_match(lag(sep) OVER p, '[,.]?\s+') AS same
  FROM w WINDOW o AS (PARTITION BY doc_id ORDER BY i), p AS (PARTITION BY doc_id ORDER BY i)
), runs AS (
  SELECT *, sum(CASE WHEN same THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM placed
), numbered AS (
  SELECT *, row_number() OVER (PARTITION BY doc_id, run ORDER BY i) AS k, count(*) OVER (PARTITION BY doc_id, run) AS n FROM runs
)"""


@query(
    f"""WITH {_STUTTER_SPANS} SELECT doc_id::VARCHAR AS session_id, pos::INTEGER AS start, (pos + length(word) + length(sep) + length(next))::INTEGER AS "end", word AS replacement
FROM numbered WHERE k % 2 = 1 AND k < n"""
)
def stutter_spans(spark, sf_dir):
    found = detect.suggestions(D.document_segments(spark, sf_dir), ("stutter",))
    return found.select("session_id", "start", "end", "replacement")


#: Spaces and the signs behind them, piece by piece: two spaces and more, or any white space before a sign.
_SPACING_SPANS = r"""m AS (
  SELECT session_id, seg_id, unnest(p) AS piece, unnest(range(len(p))) AS i, (SELECT regexp_split_to_array(text, ' {2,}|\s+[,.!?]')) AS gaps
  FROM (SELECT *, regexp_extract_all(text, ' {2,}|\s+[,.!?]') AS p FROM seg)
), pieces_at AS (
  SELECT *, (list_sum(list_transform(gaps[:i + 1], lambda g: length(g))) + coalesce(sum(length(piece)) OVER (PARTITION BY session_id, seg_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::INTEGER AS start FROM m
), spacing AS (
  SELECT session_id, seg_id, start, (start + length(regexp_replace(piece, '[,.!?]$', '')))::INTEGER AS "end", CASE WHEN contains(piece, '  ') THEN ' ' ELSE '' END AS replacement FROM pieces_at
)"""


@query(f"WITH {D.SPOKEN}, {_SPACING_SPANS} SELECT * FROM spacing")
def spacing_spans(spark, sf_dir):
    found = detect.suggestions(D.spoken_segments(spark, sf_dir), ("spacing",))
    return found.select("session_id", "seg_id", "start", "end", "replacement")


_REPEATED = r"""rep AS (
  SELECT session_id, seg_ord, word, count(*) AS n, min(text) AS text
  FROM (SELECT session_id, seg_ord, text, unnest(regexp_extract_all(lower(text), '\b[a-z'']{5,}\b')) AS word FROM seg) GROUP BY 1, 2, 3 HAVING count(*) >= 3
)"""


@query(
    f"""WITH {D.SEGMENTS}, {_REPEATED} SELECT session_id, seg_ord, (instr(lower(text), word) - 1)::INTEGER AS start, length(word)::INTEGER AS length,
  '"' || word || '" appears ' || n || '× in this passage — consider varying the wording' AS message FROM rep"""
)
def repeated_words(spark, sf_dir):
    found = detect.suggestions(D.conversation_segments(spark, sf_dir), ("repeated-word",))
    return found.select("session_id", "seg_ord", "start", (F.col("end") - F.col("start")).alias("length"), "message")


#: Every place of every phrase, one phrase at a time, between blanks or signs.
_HEDGES = ", ".join(f"('{h}')" for h in detect.HEDGES)


@query(
    rf"""WITH {D.SPOKEN}, p(phrase) AS (VALUES {_HEDGES}), places AS (
  SELECT session_id, seg_id, text, phrase, unnest(range(1, length(text) + 1)) AS i FROM seg JOIN p ON contains(lower(text), phrase)
) SELECT session_id, seg_id, (i - 1)::INTEGER AS start, substr(text, i, length(phrase)) AS excerpt FROM places
WHERE lower(substr(text, i, length(phrase))) = phrase AND (i = 1 OR regexp_full_match(substr(text, i - 1, 1), '\s'))
  AND (i + length(phrase) > length(text) OR regexp_full_match(substr(text, i + length(phrase), 1), '[\s,.!?]'))"""
)
def hedge_spans(spark, sf_dir):
    return detect.suggestions(D.spoken_segments(spark, sf_dir), ("hedge",)).select("session_id", "seg_id", "start", "excerpt")


_WEAK = ", ".join(f"('{a}', '{b}')" for a, b, _ in detect.WEAK_PHRASES)


@query(
    rf"""WITH {D.SPOKEN}, p(phrase, replacement) AS (VALUES {_WEAK}), places AS (
  SELECT session_id, seg_id, text, phrase, replacement, unnest(range(1, length(text) + 1)) AS i FROM seg JOIN p ON contains(lower(text), phrase)
) SELECT session_id, seg_id, (i - 1)::INTEGER AS start, replacement FROM places
WHERE lower(substr(text, i, length(phrase))) = phrase AND (i = 1 OR NOT regexp_full_match(substr(text, i - 1, 1), '\w'))
  AND (i + length(phrase) > length(text) OR NOT regexp_full_match(substr(text, i + length(phrase), 1), '\w'))"""
)
def weak_phrases(spark, sf_dir):
    return detect.suggestions(D.spoken_segments(spark, sf_dir), ("weak-phrase",)).select("session_id", "seg_id", "start", "replacement")


_RUN_ONS = r"""pc AS (
  SELECT doc_id, text, unnest(p) AS s, unnest(range(len(p))) AS i
  FROM (SELECT doc_id, text, string_split(regexp_replace(text, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)) AS p FROM documents)
), off AS (
  SELECT *, (sum(length(s)) OVER (PARTITION BY doc_id ORDER BY i) - length(s))::BIGINT AS off,
    len(list_filter(regexp_split_to_array(s, '\s+'), lambda w: w <> '')) AS n FROM pc
), run_ons AS (
  SELECT doc_id, (off + instr(substr(text, off + 1), s) - 1)::INTEGER AS start, least(length(s), 80)::INTEGER AS length, n FROM off WHERE n > 40
)"""


@query(
    f"""WITH {_RUN_ONS} SELECT doc_id::VARCHAR AS session_id, start, length,
  'Long sentence (' || n || ' words) — consider splitting it up' AS message FROM run_ons"""
)
def run_ons(spark, sf_dir):
    found = detect.suggestions(D.document_segments(spark, sf_dir), ("run-on",))
    return found.select("session_id", "start", (F.col("end") - F.col("start")).alias("length"), "message")


@query(
    rf"""WITH {D.SPOKEN}, n AS (
  SELECT session_id, seg_id, len(regexp_extract_all(text, ' {{2,}}')) AS doubles, len(regexp_extract_all(text, '[^ ] [,.!?]')) AS singles FROM seg
) SELECT session_id, seg_id, doubles AS n_double, singles AS n_before_sign FROM n WHERE doubles + singles > 0"""
)
def spacing_counts(spark, sf_dir):
    found = detect.suggestions(D.spoken_segments(spark, sf_dir), ("spacing",))
    return found.groupBy("session_id", "seg_id").agg(
        F.count_if(F.col("replacement") == " ").alias("n_double"), F.count_if(F.col("replacement") == "").alias("n_before_sign")
    )


@query(
    rf"""WITH {_FILLER_ROWS}, {_STUTTERS}, seg AS (SELECT doc_id::VARCHAR AS session_id, 0 AS seg_ord, text FROM documents), {_REPEATED}, {_RUN_ONS}
SELECT 'filler' AS kind, count(*) AS n FROM fillers UNION ALL SELECT 'stutter', sum(n)::BIGINT FROM stutters
UNION ALL SELECT 'repeated-word', count(*) FROM rep UNION ALL SELECT 'run-on', count(*) FROM run_ons"""
)
def suggestion_counts(spark, sf_dir):
    return detect.counts_by_kind(detect.suggestions(D.document_segments(spark, sf_dir)))


@query(f"WITH {D.SEGMENTS}, {_REPEATED} SELECT session_id, seg_ord, length(seg.text) AS n_chars FROM seg WHERE (session_id, seg_ord) IN (SELECT (session_id, seg_ord) FROM rep)")
def flagged_segments(spark, sf_dir):
    segments = D.conversation_segments(spark, sf_dir)
    return detect.flagged(segments, detect.suggestions(segments, ("repeated-word",))).select("session_id", "seg_ord", F.length("text").cast("bigint").alias("n_chars"))


_PHRASES = ", ".join(f"('{p}', {k}, 0, '')" for k, p in enumerate(detect.FILLERS)) + ", " + ", ".join(f"('{p}', {k}, 4, '{r}')" for k, (p, r, _) in enumerate(detect.WEAK_PHRASES))

#: Every fix with its place, by the detectors' order; phrases by position, between blanks or signs or between word edges.
_FIXES = rf"""p(phrase, lex, det, replacement) AS (VALUES {_PHRASES}), places AS (
  SELECT session_id, seg_id, text, p.*, unnest(range(1, length(text) + 1)) AS i FROM seg JOIN p ON contains(lower(text), phrase)
), around AS (
  SELECT *, CASE WHEN i > 1 THEN substr(text, i - 1, 1) ELSE '' END AS before, substr(text, i + length(phrase), 1) AS behind FROM places WHERE lower(substr(text, i, length(phrase))) = phrase
), {_STUTTER_SPANS.replace("FROM documents", "FROM (SELECT seg_id AS doc_id, text FROM seg)")}, {_SPACING_SPANS}, fixes AS (
  SELECT seg_id, det, lex, i - 1 - CASE WHEN before = ' ' THEN 1 ELSE 0 END AS start, i - 1 + length(phrase) + CASE WHEN behind = ',' THEN 1 ELSE 0 END AS "end", replacement
  FROM around WHERE det = 0 AND regexp_full_match(before, '\s?') AND regexp_full_match(behind, '[\s,.!?]?')
  UNION ALL SELECT seg_id, det, lex, i - 1, i - 1 + length(phrase), replacement FROM around WHERE det = 4 AND NOT regexp_full_match(before, '\w') AND NOT regexp_full_match(behind, '\w')
  UNION ALL SELECT doc_id, 1, 0, pos, pos + length(word) + length(sep) + length(next), word FROM numbered WHERE k % 2 = 1 AND k < n
  UNION ALL SELECT seg_id, 6, 0, start, "end", replacement FROM spacing
), firsts AS (
  SELECT * FROM fixes QUALIFY row_number() OVER (PARTITION BY seg_id ORDER BY det, lex, start, "end") = 1
)"""


@query(
    rf"""WITH {D.SPOKEN}, {_FIXES} SELECT session_id, seg.seg_id, CASE WHEN start IS NULL THEN text
  ELSE regexp_replace(regexp_replace(substr(text, 1, start::BIGINT) || replacement || substr(text, "end"::BIGINT + 1), ' {{2,}}', ' ', 'g'), '^\s+|\s+$', '', 'g') END AS text
FROM seg LEFT JOIN firsts ON firsts.seg_id = seg.seg_id"""
)
def apply_first_fix(spark, sf_dir):
    return edits.apply_first(D.spoken_segments(spark, sf_dir)).select("session_id", "seg_id", "text")


@query()
def apply_all_fixes(spark, sf_dir):
    return edits.apply_all(D.document_segments(spark, sf_dir)).select("session_id", "seg_id", "text")


@query(f"WITH {D.SPOKEN}, {_SENTENCES} SELECT session_id, ord, kind, round(score, 6) AS score FROM scored")
def classify_sentences(spark, sf_dir):
    return summary.classified(D.spoken_segments(spark, sf_dir)).select("session_id", "ord", "kind", F.round("score", 6).alias("score"))


def _first(kind: str, n: int) -> str:
    return f"""WITH {D.SPOKEN}, {_SENTENCES} SELECT session_id, ord, speaker_id, text FROM scored WHERE kind = '{kind}'
QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY ord) <= {n}"""


@query(_first("action", 12))
def action_items(spark, sf_dir):
    return summary.first_items(summary.classified(D.spoken_segments(spark, sf_dir)), "action", summary.ITEMS).select("session_id", "ord", "speaker_id", "text")


@query(_first("decision", 8))
def decisions(spark, sf_dir):
    rows = summary.classified(D.spoken_segments(spark, sf_dir))
    return summary.first_items(rows, "decision", summary.DECISIONS_KEPT).select("session_id", "ord", "speaker_id", "text")


@query(
    f"""WITH {D.SPOKEN}, {_SENTENCES} SELECT session_id, ord, text FROM scored WHERE kind = 'question'
QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY score DESC, ord) <= 5"""
)
def open_questions(spark, sf_dir):
    return summary.top_questions(summary.classified(D.spoken_segments(spark, sf_dir)), 5).select("session_id", "ord", "text")


@query(
    f"""WITH {D.SPOKEN}, {_SENTENCES}, pairs AS (
  SELECT q.session_id, q.ord, q.text AS question, q.speaker_id AS asker_id, min(a.ord) AS a_ord FROM scored q JOIN scored a
    ON q.session_id = a.session_id AND a.ord > q.ord AND a.ord <= q.ord + 3 AND a.speaker_id <> q.speaker_id AND a.kind <> 'question'
  WHERE q.kind = 'question' GROUP BY ALL
) SELECT p.session_id, p.ord, question, a.text AS answer, asker_id, a.speaker_id AS answerer_id
FROM pairs p JOIN scored a ON p.session_id = a.session_id AND a.ord = p.a_ord QUALIFY row_number() OVER (PARTITION BY p.session_id ORDER BY p.ord) <= 10"""
)
def qa_pairs(spark, sf_dir):
    return summary.qa_pairs(summary.classified(D.spoken_segments(spark, sf_dir)))


def _picks(source: str, name: str, k: int) -> str:
    """Sentences of ``source`` picked best first unless they are like one picked before, up to ``k``; name_rank and name are CTEs."""
    return f"""{name}_rank AS (
  SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY score DESC, ord) AS rk FROM {source}
), {name}_step AS (
  SELECT session_id, 1::BIGINT AS rk, [words] AS held, [ord] AS ords FROM {name}_rank WHERE rk = 1
  UNION ALL
  SELECT s.session_id, s.rk + 1, CASE WHEN skip THEN held ELSE list_append(held, words) END, CASE WHEN skip THEN ords ELSE list_append(ords, ord) END
  FROM (SELECT s.*, r.words, r.ord, len(held) >= {k} OR len(list_filter(held, lambda h: len(list_distinct(list_concat(h, r.words))) > 0
      AND len(list_intersect(h, r.words)) / len(list_distinct(list_concat(h, r.words))) > 0.6)) > 0 AS skip
    FROM {name}_step s JOIN {name}_rank r ON r.session_id = s.session_id AND r.rk = s.rk + 1) s
), {name} AS (
  SELECT r.* FROM {name}_rank r JOIN (SELECT session_id, arg_max(ords, rk) AS ords FROM {name}_step GROUP BY session_id) USING (session_id) WHERE list_contains(ords, ord)
)"""


def _sections_sql(template: str) -> str:
    """Prose, overview and key points as CTEs."""
    return f"""prose AS (SELECT * FROM scored WHERE kind = 'prose'), {_picks("prose", "overview", summary.OVERVIEW)},
rest AS (SELECT * FROM prose WHERE (session_id, ord) NOT IN (SELECT (session_id, ord) FROM overview)), {_picks("rest", "key_points", summary.KEY_POINTS[template])}"""


@query(
    f"""WITH RECURSIVE {D.SEGMENTS}, {_SENTENCES}, {_sections_sql("meeting")}
SELECT session_id, 'overview' AS section, ord, text FROM overview UNION ALL SELECT session_id, 'key_points', ord, text FROM key_points"""
)
def distinct_key_points(spark, sf_dir):
    return summary.picked(summary.classified(D.conversation_segments(spark, sf_dir)), "meeting")


def _summary_sql(template: str, name: str) -> str:
    """CTE ``summaries``: each session's summary as text and whether it has more than pairs; ``name`` is an owner's name in SQL."""
    pairs = f"""pair AS (
  SELECT q.session_id, q.ord, q.text, min(a.ord) AS a_ord FROM scored q JOIN scored a ON q.session_id = a.session_id AND a.ord > q.ord AND a.ord <= q.ord + 3
    AND a.speaker_id <> q.speaker_id AND a.kind <> 'question' WHERE q.kind = 'question' GROUP BY q.session_id, q.ord, q.text QUALIFY row_number() OVER (PARTITION BY q.session_id ORDER BY q.ord) <= 10
)"""
    asked = "SELECT p.session_id, 4, 'Q & A', p.ord, '  Q: ' || p.text || chr(10) || '  A: ' || a.text FROM pair p JOIN scored a ON p.session_id = a.session_id AND a.ord = p.a_ord UNION ALL" if template == "interview" else ""
    unasked = "WHERE session_id NOT IN (SELECT session_id FROM pair)" if template == "interview" else ""
    return f"""{_sections_sql(template)}, {pairs}, lines(session_id, place, heading, ord, line) AS (
  SELECT session_id, 0, 'OVERVIEW', ord, '  ' || text FROM overview UNION ALL SELECT session_id, 1, 'KEY POINTS', ord, '  - ' || text FROM key_points UNION ALL
  SELECT session_id, 2, 'ACTION ITEMS', ord, '  [ ] ' || text || ' (' || {name} || ')' FROM (SELECT * FROM scored WHERE kind = 'action' QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY ord) <= 12) UNION ALL
  SELECT session_id, 3, 'DECISIONS', ord, '  - ' || text FROM (SELECT * FROM scored WHERE kind = 'decision' QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY ord) <= 8) UNION ALL
  {asked}
  SELECT session_id, 5, 'OPEN QUESTIONS', ord, '  - ' || text FROM (SELECT * FROM scored WHERE kind = 'question'
    QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY score DESC, ord) <= {summary.QUESTIONS[template]}) {unasked}
), bodies AS (
  SELECT session_id, place, CASE WHEN place > 0 THEN chr(10) ELSE '' END || heading || chr(10) || string_agg(line, chr(10) ORDER BY ord) AS body FROM lines GROUP BY session_id, place, heading
), summaries AS (SELECT session_id, string_agg(body, chr(10) ORDER BY place) AS summary FROM bodies GROUP BY session_id)"""


@query(
    f"""WITH RECURSIVE {D.SPOKEN}, {_SENTENCES}, {_summary_sql("interview", "CASE speaker_id WHEN 1 THEN 'Ada' ELSE 'Unassigned' END")}
SELECT session_id, summary FROM summaries"""
)
def summary_texts(spark, sf_dir):
    segments = D.spoken_segments(spark, sf_dir)
    names = segments.select("session_id", F.lit(1).alias("id"), F.lit("Ada").alias("name")).distinct()
    return summary.summary_text(summary.summary(segments, "interview"), names)


_NAME = "CASE speaker_id WHEN 0 THEN 'Speaker 1' WHEN 1 THEN 'Speaker 2' ELSE 'Unknown speaker' END"


def _srt(x: str) -> str:
    ms = f"floor(greatest({x}, 0) * 1000 + 0.5)::BIGINT"
    return f"printf('%02d:%02d:%02d,%03d', {ms} // 3600000, {ms} // 60000 % 60, {ms} // 1000 % 60, {ms} % 1000)"


@query(
    f"""WITH {D.SEGMENTS} SELECT session_id, seg_ord, row_number() OVER (PARTITION BY session_id ORDER BY seg_ord) || chr(10) ||
  {_srt("start_s")} || ' --> ' || {_srt("greatest(end_s, start_s + 0.5)")} || chr(10) || {_NAME} || ': ' || text AS cue FROM seg"""
)
def srt_cues(spark, sf_dir):
    return exports.cues(D.conversation_segments(spark, sf_dir), D.speakers(spark, sf_dir))


_OWNER = "CASE speaker_id WHEN 0 THEN 'Speaker 1' WHEN 1 THEN 'Speaker 2' ELSE 'Unassigned' END"


@query(
    f"""WITH RECURSIVE {D.SEGMENTS}, {_SENTENCES}, {_summary_sql("meeting", _OWNER)}, body AS (
  SELECT session_id, string_agg('[' || printf('%d:%02d', floor(start_s)::BIGINT // 60, floor(start_s)::BIGINT % 60) || '] ' || {_NAME} || ': ' || text,
    chr(10) || chr(10) ORDER BY seg_ord) AS body FROM seg GROUP BY session_id
) SELECT session_id, coalesce(summary || chr(10) || chr(10) || repeat('=', 40) || chr(10) || 'TRANSCRIPT' || chr(10) || chr(10), '') || body AS txt
FROM body LEFT JOIN summaries USING (session_id)"""
)
def txt_bodies(spark, sf_dir):
    """The plain-text export: the transcript below the meeting's summary."""
    return exports.txt(D.conversation_segments(spark, sf_dir), D.speakers(spark, sf_dir))


_ADA = "CASE speaker_id WHEN 1 THEN 'Ada' ELSE 'Unknown speaker' END"


@query(
    f"""WITH RECURSIVE {D.SPOKEN}, {_SENTENCES}, {_sections_sql("meeting")}, lines(session_id, place, ord, line) AS (
  SELECT session_id, 2, ord, text FROM overview UNION ALL SELECT session_id, 4, ord, '• ' || text FROM key_points UNION ALL
  SELECT session_id, 6, ord, '• ' || text || ' — ' || {_ADA} FROM (SELECT * FROM scored WHERE kind = 'action' QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY ord) <= 12) UNION ALL
  SELECT session_id, 8, ord, '• ' || text FROM (SELECT * FROM scored WHERE kind = 'decision' QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY ord) <= 8)
), titled AS (
  SELECT * FROM lines UNION ALL SELECT DISTINCT session_id, place - 1, 0, ['', 'Key points', 'Action items', 'Decisions'][place // 2] FROM lines WHERE place > 2
  UNION ALL SELECT DISTINCT session_id, 0, 0, 'Summary' FROM (SELECT session_id FROM lines UNION SELECT session_id FROM scored WHERE kind = 'question')
  UNION ALL SELECT DISTINCT session_id, 100, 0, 'Meeting transcript' FROM seg
  UNION ALL SELECT session_id, 101, seg_ord, {_ADA} || ' [' || printf('%d:%02d', floor(start_s)::BIGINT // 60, floor(start_s)::BIGINT % 60) || ']  ' || text FROM seg
) SELECT session_id, string_agg(line, chr(10) ORDER BY place, ord) AS document FROM titled GROUP BY session_id"""
)
def docx_files(spark, sf_dir):
    """The Word files' paragraphs, read back from the files."""
    segments = D.spoken_segments(spark, sf_dir)
    names = segments.select("session_id", F.lit(1).alias("id"), F.lit("Ada").alias("name")).distinct()
    return exports.docx_texts(exports.docx(segments, names))


_RUNS = """runs AS (
  SELECT *, sum(CASE WHEN gap > {gap} THEN 1 ELSE 0 END) OVER (PARTITION BY session_id ORDER BY time_s)::BIGINT AS run
  FROM (SELECT *, time_s - lag(time_s) OVER (PARTITION BY session_id ORDER BY time_s) AS gap FROM frames)
)"""


@query(
    f"""WITH {D.FRAMES}, {_RUNS.format(gap=0.75)} SELECT session_id, run, min(time_s) AS start_s, max(time_s) AS end_s, count(*) AS n_frames,
  round(median(pitch_hz) FILTER (pitch_hz > 0), 6) AS median_pitch_hz FROM runs GROUP BY session_id, run"""
)
def voiced_spans(spark, sf_dir):
    return intervals.voiced_spans(D.frames(spark, sf_dir)).withColumn("median_pitch_hz", F.round("median_pitch_hz", 6))


@query(
    f"""WITH {D.FRAMES}, {_RUNS.format(gap=0.6)}, spans AS (
  SELECT session_id, run, min(time_s) AS s, max(time_s) + 0.25 AS e FROM runs GROUP BY session_id, run
), hops AS (
  SELECT *, greatest(1.2, sum(e - s) OVER (PARTITION BY session_id) / 400) AS hop FROM spans
), win AS (
  SELECT session_id, run, k, s + k * hop AS start_s, least(s + k * hop + 2.4, e) AS end_s
  FROM (SELECT *, unnest(range(0, greatest(ceil((e - s - 2.4) / hop), 0)::BIGINT + 1)) AS k FROM hops)
) SELECT session_id, row_number() OVER (PARTITION BY session_id ORDER BY run, k) - 1 AS win_ord, round(start_s, 6) AS start_s, round(end_s, 6) AS end_s
FROM win WHERE end_s - start_s >= 1.0 OR (run = 0 AND k = 0) QUALIFY win_ord < 400"""
)
def hop_windows(spark, sf_dir):
    return intervals.hop_windows(D.frames(spark, sf_dir)).withColumns({"start_s": F.round("start_s", 6), "end_s": F.round("end_s", 6)})


@query(
    f"""WITH {D.EVENTS}, {D.WORDS}, {D.REGIONS}, near AS (
  SELECT w.session_id, word_ord, arg_min(r.speaker_id, (greatest(r.start_s - w.start_s, w.start_s - r.end_s, 0.0), reg_ord)) AS speaker_id
  FROM words w JOIN regions r ON w.session_id = r.session_id AND greatest(r.start_s - w.start_s, w.start_s - r.end_s, 0.0) <= 1.0 GROUP BY ALL
) SELECT w.session_id, word_ord, coalesce(speaker_id, -1) AS speaker_id FROM words w LEFT JOIN near USING (session_id, word_ord)"""
)
def nearest_region(spark, sf_dir):
    done = intervals.nearest_region(D.words(spark, sf_dir), D.regions(spark, sf_dir), F.col("start_s"), "word_ord")
    return done.select("session_id", "word_ord", "speaker_id")


_VOTE = f"""{D.EVENTS}, {D.WORDS}, {D.WINDOWS}, pairs AS (
  SELECT w.session_id, word_ord, label, sum(least(w.end_s + 0.15, x.end_s) - greatest(w.start_s - 0.15, x.start_s)) AS vote, min(win_ord) AS first
  FROM words w JOIN windows x ON w.session_id = x.session_id AND label >= 0
    AND least(w.end_s + 0.15, x.end_s) > greatest(w.start_s - 0.15, x.start_s) GROUP BY ALL
), best AS (
  SELECT session_id, word_ord, label FROM pairs QUALIFY row_number() OVER (PARTITION BY session_id, word_ord ORDER BY round(vote, 9) DESC, first) = 1
), labelled AS (
  SELECT w.*, coalesce(last_value(label IGNORE NULLS) OVER (PARTITION BY w.session_id ORDER BY w.word_ord), -1) AS label
  FROM words w LEFT JOIN best USING (session_id, word_ord)
)"""


@query(f"WITH {_VOTE} SELECT session_id, word_ord, label FROM labelled")
def overlap_vote(spark, sf_dir):
    done = intervals.overlap_vote(D.words(spark, sf_dir), D.windows(spark, sf_dir))
    return done.select("session_id", "word_ord", "label")


_COLLECT = """segs AS (
  SELECT *, sum(new) OVER (PARTITION BY session_id ORDER BY {key}) - 1 AS seg_ord FROM flagged
) SELECT session_id, seg_ord::BIGINT AS seg_ord, arg_min({spk}, {key}) AS speaker_id, string_agg(text, ' ' ORDER BY {key}) AS text,
  arg_min(start_s, {key}) AS start_s, arg_max(end_s, {key}) AS end_s FROM segs GROUP BY session_id, seg_ord"""


@query(
    f"""WITH {_VOTE}, jumps AS (
  SELECT *, CASE WHEN label = lag(label) OVER o AND start_s - lag(end_s) OVER o <= 1.5 THEN 0 ELSE 1 END AS new FROM labelled
  WINDOW o AS (PARTITION BY session_id ORDER BY word_ord)
), isl AS (
  SELECT * EXCLUDE (new), sum(new) OVER (PARTITION BY session_id ORDER BY word_ord) AS run FROM jumps
), flagged AS (
  SELECT *, CASE WHEN (row_number() OVER (PARTITION BY session_id, run ORDER BY word_ord) - 1) % 120 = 0 THEN 1 ELSE 0 END AS new FROM isl
), {_COLLECT.format(key="word_ord", spk="label")}"""
)
def word_segments(spark, sf_dir):
    voted = intervals.overlap_vote(D.words(spark, sf_dir), D.windows(spark, sf_dir)).withColumnRenamed("label", "speaker_id")
    return intervals.word_segments(voted).drop("seg_id", "interim")


@query(
    f"""WITH {D.EVENTS}, {D.WORDS}, {D.REGIONS}, pairs AS (
  SELECT w.session_id, word_ord, speaker_id, sum(least(w.end_s, r.end_s) - greatest(w.start_s, r.start_s)) AS vote, min(reg_ord) AS first
  FROM words w JOIN regions r ON w.session_id = r.session_id AND least(w.end_s, r.end_s) > greatest(w.start_s, r.start_s) GROUP BY ALL
), best AS (
  SELECT session_id, word_ord, speaker_id FROM pairs QUALIFY row_number() OVER (PARTITION BY session_id, word_ord ORDER BY round(vote, 9) DESC, first) = 1
), spk AS (
  SELECT w.*, coalesce(last_value(speaker_id IGNORE NULLS) OVER (PARTITION BY w.session_id ORDER BY w.word_ord), -1) AS label
  FROM words w LEFT JOIN best USING (session_id, word_ord)
), flagged AS (
  SELECT *, CASE WHEN label = lag(label) OVER o AND start_s - lag(end_s) OVER o < 2 THEN 0 ELSE 1 END AS new FROM spk
  WINDOW o AS (PARTITION BY session_id ORDER BY word_ord)
), {_COLLECT.format(key="word_ord", spk="label")}"""
)
def chunk_segments(spark, sf_dir):
    chunks = D.words(spark, sf_dir).withColumnRenamed("word_ord", "chunk_ord")
    return intervals.chunk_segments(chunks, D.regions(spark, sf_dir)).drop("seg_id", "interim")


@query(
    f"""WITH {D.EVENTS} SELECT session_id, e, coalesce(last_value(CASE WHEN e % 4 = 0 THEN (e % 5)::INTEGER END IGNORE NULLS)
  OVER (PARTITION BY session_id ORDER BY e), -1) AS speaker_id FROM ev"""
)
def forward_fill(spark, sf_dir):
    rows = D._events(spark, sf_dir).select("session_id", "e", F.when(F.col("e") % 4 == 0, (F.col("e") % 5).cast("int")).alias("speaker_id"))
    return intervals.forward_fill(rows, "speaker_id", "e")


def _fold_oracle(agree: str) -> str:
    return f"""WITH RECURSIVE {D.EVENTS}, l AS (
  SELECT session_id, e, (e * 7 // 3 % 3)::INTEGER AS label, row_number() OVER o AS k, lead((e * 7 // 3 % 3)::INTEGER) OVER o AS nxt
  FROM ev WINDOW o AS (PARTITION BY session_id ORDER BY e)
), r AS (
  SELECT session_id, k, e, label FROM l WHERE k = 1
  UNION ALL
  SELECT l.session_id, l.k, l.e, CASE WHEN l.nxt IS NOT NULL AND l.label <> r.label AND l.label <> l.nxt {agree} THEN r.label ELSE l.label END
  FROM r JOIN l ON l.session_id = r.session_id AND l.k = r.k + 1
) SELECT session_id, e, label FROM r"""


def _labels(spark, sf_dir):
    return D._events(spark, sf_dir).select("session_id", "e", (F.floor(F.col("e") * 7 / 3) % 3).cast("int").alias("label"))


@query(_fold_oracle(""))
def absorbed_flips(spark, sf_dir):
    return ordered.by_session(_labels(spark, sf_dir), "e", "label", ordered.absorbed)


@query(_fold_oracle("AND r.label = l.nxt"))
def smoothed_labels(spark, sf_dir):
    return ordered.by_session(_labels(spark, sf_dir), "e", "label", ordered.smoothed)


@query(
    """SELECT a.label::VARCHAR AS session_id, a.vec_id AS a, b.vec_id AS b, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS cosine
FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id < b.vec_id"""
)
def pairwise_cosine(spark, sf_dir):
    return vectors.pairwise_cosine(D.vectors(spark, sf_dir), digits=6)


@query(
    """WITH flat AS (SELECT label, unnest(embedding)::DOUBLE AS x, unnest(range(len(embedding))) AS d FROM embeddings),
m AS (SELECT label, d, avg(x) AS x FROM flat GROUP BY ALL), c AS (SELECT label AS cluster, list(x ORDER BY d) AS centroid FROM m GROUP BY label)
SELECT vec_id AS win_ord, cluster::INTEGER AS cluster, round(cosine, 6) AS cosine FROM (
  SELECT vec_id, cluster, list_cosine_similarity(embedding::DOUBLE[], centroid) AS cosine FROM embeddings, c)
QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY cosine DESC, cluster) = 1"""
)
def nearest_centroid(spark, sf_dir):
    rows = D.vectors(spark, sf_dir).withColumn("cluster", F.col("session_id").cast("int"))
    centroids = vectors.mean_vectors(rows, ["cluster"])
    done = vectors.nearest_centroid(rows.drop("cluster"), centroids)
    return done.select("win_ord", "cluster", F.round("cosine", 6).alias("cosine"))


@query(
    """WITH v AS (SELECT user_id, value AS x, median(value) OVER (PARTITION BY user_id) AS raw FROM events)
SELECT user_id, round(any_value(raw), 6) AS raw_median,
  round(median(CASE WHEN x > raw * 1.6 THEN x / 2 WHEN x < raw / 1.6 THEN x * 2 ELSE x END), 6) AS folded_median,
  round(list_sort(list(x))[len(list(x)) // 2 + 1], 6) AS upper_median FROM v GROUP BY user_id"""
)
def robust_pitch(spark, sf_dir):
    rows = D.table(spark, sf_dir, "events").select("user_id", "value")
    upper = ranks.by_rank(rows, ["user_id"], "value", {"upper_median": ranks.UPPER})
    done = vectors.octave_folded_median(rows, ["user_id"], "value").join(upper, "user_id")
    return done.select("user_id", *(F.round(c, 6).alias(c) for c in ("raw_median", "folded_median", "upper_median")))


@query(
    f"""WITH {D.FRAMES}, {D.WINDOWS}, hit AS (
  SELECT f.session_id, time_s, arg_min(label, win_ord) AS label, any_value(pitch_hz) AS p FROM frames f JOIN windows w
    ON f.session_id = w.session_id AND label >= 0 AND pitch_hz > 0 AND time_s BETWEEN start_s AND end_s GROUP BY ALL
), up AS (SELECT session_id, label, list_sort(list(p)) AS p FROM hit GROUP BY ALL)
SELECT l.session_id, l.label, round(coalesce(p[len(p) // 2 + 1], 0), 6) AS pitch_hz
FROM (SELECT DISTINCT session_id, label FROM windows WHERE label >= 0) l LEFT JOIN up USING (session_id, label)"""
)
def label_pitch(spark, sf_dir):
    return intervals.label_pitch(D.frames(spark, sf_dir), D.windows(spark, sf_dir)).withColumn("pitch_hz", F.round("pitch_hz", 6))


@query(
    f"""WITH {D.FRAMES}, {D.UTTERANCES}, u AS (
  SELECT session_id, utt_ord, end_s AS until, coalesce(lag(end_s) OVER (PARTITION BY session_id ORDER BY utt_ord), '-inf'::DOUBLE) AS since FROM utt
) SELECT u.session_id, utt_ord, count(*) AS n_frames FROM u JOIN frames f ON f.session_id = u.session_id AND time_s > since AND time_s <= until GROUP BY ALL"""
)
def utterance_frames(spark, sf_dir):
    return intervals.utterance_frames(D.utterances(spark, sf_dir), D.frames(spark, sf_dir)).groupBy("session_id", "utt_ord").agg(F.count("*").alias("n_frames"))


@query(
    f"""WITH {D.EVENTS}, c AS (
  SELECT session_id, e, CASE WHEN e % 9 = 0 THEN '  ' ELSE event_type END AS text, CASE WHEN e % 4 > 0 THEN tm END AS s, CASE WHEN e % 6 > 0 THEN tm + 0.5 END AS x FROM ev
) SELECT session_id, e AS word_ord, text, coalesce(s, 0.0) AS start_s, coalesce(x, least(coalesce(s, 0.0) + 30, 50.0)) AS end_s FROM c WHERE trim(text) <> ''"""
)
def timed_words(spark, sf_dir):
    e, at = F.col("e"), F.col("at")
    ts = F.struct(F.when(e % 4 > 0, at).alias("start"), F.when(e % 6 > 0, at + 0.5).alias("end"))
    rows = D._events(spark, sf_dir).select("session_id", e.alias("chunk_ord"), F.when(e % 9 == 0, "  ").otherwise(F.col("event_type")).alias("text"), ts.alias("ts"))
    return intervals.timed_words(rows, rows.select("session_id", F.lit(50.0).alias("duration_s")).distinct())


@query("SELECT user_id::VARCHAR AS session_id, CASE WHEN avg(length(props)) > 20 THEN 'chunk' ELSE 'word' END AS granularity FROM events GROUP BY user_id")
def granularity(spark, sf_dir):
    return intervals.granularity(D._events(spark, sf_dir).select("session_id", F.col("props").alias("text")))


@query(
    f"""WITH {D.EVENTS}, {D.UTTERANCES} SELECT session_id, utt_ord, end_s, coalesce(lag(end_s) OVER (PARTITION BY session_id ORDER BY utt_ord), 0.0) AS start_s FROM utt"""
)
def previous_ends(spark, sf_dir):
    return intervals.previous_ends(D.utterances(spark, sf_dir))


@query()
def voiced_regions(spark, sf_dir):
    return cluster.voiced_regions(D.frames(spark, sf_dir))


@query()
def adaptive_clusters(spark, sf_dir):
    rows = D.vectors(spark, sf_dir).withColumn("session_id", (F.col("win_ord") % 5).cast("string"))
    return cluster.cluster_vectors(rows)


@query()
def fixed_clusters(spark, sf_dir):
    rows = D.vectors(spark, sf_dir).withColumn("session_id", (F.col("win_ord") % 5).cast("string"))
    return cluster.cluster_vectors(rows, adaptive=False)


@query(
    f"""WITH {D.SEGMENTS} SELECT session_id, seg_id, CASE WHEN speaker_id IN (1, 2) THEN 0 ELSE speaker_id END AS speaker_id FROM seg"""
)
def speaker_remap(spark, sf_dir):
    """Speaker 2 was merged into 1 and 1 into 0: chains are followed."""
    segments = D.conversation_segments(spark, sf_dir)
    merges = segments.select("session_id", F.explode(F.array(F.struct(F.lit(2).alias("from_id"), F.lit(1).alias("to_id")), F.struct(F.lit(1).alias("from_id"), F.lit(0).alias("to_id")))).alias("m")).distinct()
    return store.remapped(segments, D.speakers(spark, sf_dir), merges.select("session_id", "m.*"))[0].select("session_id", "seg_id", "speaker_id")


@query(
    f"""WITH {D.SEGMENTS}, top AS (SELECT session_id, max(seg_ord) + 1 AS n FROM seg GROUP BY session_id)
SELECT session_id, seg_id, seg_ord, CASE WHEN seg_ord = 0 THEN 'changed' ELSE text END AS text FROM seg
UNION ALL SELECT session_id, session_id || '-new', n, 'added' FROM top"""
)
def segment_upsert(spark, sf_dir):
    segments = D.conversation_segments(spark, sf_dir)
    changed = segments.where("seg_ord = 0").withColumn("text", F.lit("changed"))
    added = segments.dropDuplicates(["session_id"]).withColumns({"seg_id": F.concat("session_id", F.lit("-new")), "seg_ord": F.lit(99).cast("bigint"), "text": F.lit("added")})
    return store.upsert(segments, changed.unionByName(added)).select("session_id", "seg_id", "seg_ord", "text")


@query(
    f"""WITH {D.SEGMENTS}, heard AS (SELECT DISTINCT session_id, speaker_id AS id FROM seg)
SELECT session_id, id, 'Speaker ' || (id + 1) AS name, list_extract(['#4f8ef7', '#4f8ef7', '#3bb273'], id + 1) AS color, 100.0 + id AS median_pitch_hz FROM heard"""
)
def ensured_speakers(spark, sf_dir):
    heard = D.conversation_segments(spark, sf_dir).select("session_id", F.col("speaker_id").alias("id")).distinct()
    return store.ensured_speakers(D.speakers(spark, sf_dir), heard.withColumn("median_pitch_hz", 100.0 + F.col("id")))


@query("SELECT o_orderkey AS id, o_orderdate AS saved_at FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 20")
def newest_drafts(spark, sf_dir):
    rows = D.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderdate").alias("saved_at"))
    return store.newest(rows)


@query(
    """SELECT vec_id, round(sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE)) / len(embedding)), 6) AS rms,
  round(list_max(list_transform(embedding, lambda x: abs(x)))::DOUBLE, 6) AS peak FROM embeddings"""
)
def signal_levels(spark, sf_dir):
    rows = D.table(spark, sf_dir, "embeddings")
    return rows.select("vec_id", F.round(signal.rms(F.col("embedding")), 6).alias("rms"), F.round(signal.peak(F.col("embedding")), 6).alias("peak"))


def _tones(values: pa.Array) -> pa.Array:
    """Half a second of a tone for each value."""
    hz = 80 + np.fmod(np.fmod(values.to_numpy(zero_copy_only=False), 300.0) + 300.0, 300.0)
    pcm = (0.4 * np.sin(np.arange(8000) * hz[:, None] * 6.283185307179586 / 16000)).astype(np.float32)
    offsets = pa.array(np.arange(len(hz) + 1, dtype=np.int32) * 8000, mask=np.r_[values.is_null().to_numpy(zero_copy_only=False), False])
    return pa.ListArray.from_arrays(offsets, pa.array(pcm.ravel()))


@query()
def audio_frames(spark, sf_dir):
    """Frames of every event's tone, whose pitch comes from its value; events are dealt out before they become samples."""
    tones = D.table(spark, sf_dir, "events").select(F.col("event_id").cast("string").alias("session_id"), "value")
    tones = tones.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "session_id")
    audio = tones.select("session_id", F.lit(signal.RATE).alias("sample_rate"), F.col("value").alias("pcm"))
    return signal.frames(audio, sampled=_tones).withColumns({c: F.round(c, 3) for c in ("pitch_hz", "centroid_hz", "energy")})


def _quarters(values: pa.Array) -> np.ndarray:
    """A quarter of a second at 8 kHz for each value, that loud."""
    pcm = np.repeat(values.fill_null(0).to_numpy(zero_copy_only=False), 2000)
    pcm[1::2] *= -1
    return pcm


@query(
    """WITH r AS (SELECT event_id // 500 AS rec, row_number() OVER (PARTITION BY event_id // 500 ORDER BY event_id) - 1 AS k, (1 + floor(abs(value))::BIGINT % 100) / 128 AS a FROM events),
g AS (SELECT *, max(a) OVER (PARTITION BY rec) AS top FROM r), h AS (SELECT *, a * CASE WHEN top < 0.5 THEN least(0.9 / top, 24) ELSE 1 END AS energy FROM g)
SELECT rec::VARCHAR AS session_id, k * 0.25 AS time_s, round(energy, 4) AS energy FROM h WHERE energy >= 0.008"""
)
def wave_file_frames(spark, sf_dir):
    """Frames of wave files: every 500 events are a recording, of a quarter of a second each, as loud as the event's value."""
    rows = D.table(spark, sf_dir, "events").select(
        F.floor(F.col("event_id") / 500).alias("session_id"), "event_id", ((1 + F.floor(F.abs("value")) % 100) / F.lit(128.0)).alias("a")
    )
    loud = rows.groupBy("session_id").agg(F.array_sort(F.collect_list(F.struct("event_id", "a"))).alias("x"))
    loud = loud.select("session_id", F.transform("x", lambda e: e["a"]).alias("pcm"))
    frames = lambda path: waves.file_frames(spark, path, unit_s=20).select("session_id", "time_s", F.round("energy", 4).alias("energy"))
    return waves.analyzed(loud, rows.count() * 2000, frames, rate=8000, width=1, sampled=_quarters)


def _live_inputs(spark, sf_dir):
    e = F.col("e")
    kind = F.when(e % 6 == 5, "final").when(e % 2 == 0, "frame").otherwise("interim")
    rows = D._events(spark, sf_dir)
    texts = F.element_at(F.array(*map(F.lit, D.TEMPLATES)), (e % 16 + 1).cast("int"))
    return rows.select(
        "session_id", e.alias("seq"), kind.alias("kind"), F.col("at").alias("time_s"), F.when(kind != "frame", F.lower(texts)).alias("text"),
        (F.col("value") + 60).alias("pitch_hz"), (F.col("value") * 3 + 500).alias("centroid_hz"),
    )


@query()
def live_captions(spark, sf_dir):
    """The changes are a table of their own: segments and aliases both come from it, and no session is replayed for each."""
    return live.segments(scratch.written(live.changes(_live_inputs(spark, sf_dir)), "changes"))


_MIMES = ("audio/mp4", "audio/x-m4a", "audio/mpeg", "audio/mp3", "audio/wav", "audio/ogg", "audio/webm", "video/mp4")
_ERRORS = ("not-allowed", "service-not-allowed", "network", "no-speech", "aborted", "audio-capture", "bad-grammar")
_LISTS = [", ".join(f"'{x}'" for x in xs) for xs in (_MIMES, _ERRORS)]


@query(
    f"""WITH m AS (SELECT event_id, list_extract([{_LISTS[0]}], (event_id % 8 + 1)::INTEGER) || ';codecs=' || event_type AS mime, list_extract([{_LISTS[1]}], (event_id % 7 + 1)::INTEGER) AS error FROM events)
SELECT event_id, mime, CASE WHEN mime LIKE '%mp4%' OR mime LIKE '%m4a%' THEN 'm4a' WHEN mime LIKE '%mpeg%' OR mime LIKE '%mp3%' THEN 'mp3' WHEN mime LIKE '%wav%' THEN 'wav'
    WHEN mime LIKE '%ogg%' THEN 'ogg' ELSE 'webm' END AS ext,
  CASE WHEN error IN ('not-allowed', 'service-not-allowed') THEN 'cooldown' WHEN error = 'network' THEN 'fallback' WHEN error IN ('no-speech', 'aborted') THEN 'ignore' ELSE 'error' END AS route FROM m"""
)
def routing(spark, sf_dir):
    """File extensions by media type and routes of recognizer errors, of every event."""
    pick = lambda values: F.element_at(F.array(*map(F.lit, values)), (F.col("event_id") % len(values) + 1).cast("int"))
    rows = D.table(spark, sf_dir, "events").select("event_id", F.concat(pick(_MIMES), F.lit(";codecs="), F.col("event_type")).alias("mime"), pick(_ERRORS).alias("error"))
    return rows.select("event_id", "mime", X.audio_extension(F.col("mime")).alias("ext"), readers.error_route(F.col("error")).alias("route"))


@query(
    """WITH b AS (SELECT user_id::VARCHAR AS session_id, value, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS ord FROM events)
SELECT session_id, ord // 8 AS batch, count(*)::INTEGER AS n_samples, round(sum(value), 4) AS total FROM b GROUP BY session_id, ord // 8"""
)
def audio_batches(spark, sf_dir):
    """Every event is a buffer of one sample; eight buffers are a batch."""
    order = F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")) - 1
    rows = D.table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("session_id"), order.cast("long").alias("buf_ord"), F.array("value").alias("pcm"))
    total = F.round(F.aggregate("pcm", F.lit(0.0), lambda s, x: s + x), 4)
    return readers.pcm_batches(rows, 8, 1).select("session_id", "batch", F.size("pcm").alias("n_samples"), total.alias("total"))


@query(
    f"""WITH {D.SEGMENTS} SELECT session_id, seg_id, seg_ord, CASE WHEN hash_no % 3 = 0 THEN 'refined ' || length(text) ELSE text END AS text
FROM (SELECT *, session_id::BIGINT AS hash_no FROM seg) WHERE hash_no % 5 <> 1 OR hash_no % 3 = 0"""
)
def overwritten_sessions(spark, sf_dir):
    """A session table: live segments, then a batch pass over every third session that replaces it while each fifth goes."""
    segments = D.conversation_segments(spark, sf_dir)
    path, number = scratch.new_path(spark, "sessions"), F.col("session_id").cast("long")
    store.written_sessions(segments, path)
    refined = segments.where(number % 3 == 0).withColumn("text", F.concat(F.lit("refined "), F.length("text").cast("string")))
    store.written_sessions(refined, path, gone=segments.where((number % 5 == 1) & (number % 3 != 0)).select("session_id").distinct())
    return store.read_sessions(spark, path).select("session_id", "seg_id", "seg_ord", "text")


@query(
    """SELECT conv_id::VARCHAR AS session_id, 'slot-' || (turn % 4) AS seg_id, arg_max(coalesce(text, ''), turn) AS text, max(turn)::DOUBLE AS end_s
FROM conversations GROUP BY conv_id, turn % 4 HAVING max(turn) % 9 <> 8"""
)
def leveled_changes(spark, sf_dir):
    """Change rows in levels: each turn writes one of four segments again, and every ninth turn deletes it; seven micro-batches, merged by threes."""
    turn = F.col("turn")
    rows = D.table(spark, sf_dir, "conversations").select(
        F.col("conv_id").cast("string").alias("session_id"), turn.alias("seq"), F.when(turn % 9 == 8, "delete").otherwise("upsert").alias("op"),
        F.concat(F.lit("slot-"), turn % 4).alias("seg_id"), F.lit(0).alias("speaker_id"), F.coalesce("text", F.lit("")).alias("text"),
        F.lit(0.0).alias("start_s"), turn.cast("double").alias("end_s"), F.lit(False).alias("interim"),
        F.lit(None).cast("int").alias("from_id"), F.lit(None).cast("int").alias("to_id"), F.lit(None).cast("double").alias("pitch_hz"),
    )
    path = scratch.new_path(spark, "changes")
    sink = live.upsert_sink(path, every=3)
    for k in range(7):
        sink(rows.where(turn % 7 == k), k)
    return live.segments(live.change_table(spark, path).drop("batch")).select("session_id", "seg_id", "text", "end_s")


@query()
def engine_switches(spark, sf_dir):
    """Events as inputs of two speech engines: results, levels, errors, ends and the fallback's texts."""
    e = F.col("event_id")
    kind = F.when(e % 40 == 0, "start").when(e % 11 == 3, "final").when(e % 13 == 5, "fallback").when(e % 17 == 7, "error").when(e % 19 == 9, "ended").otherwise("level")
    code = F.element_at(F.array(*map(F.lit, _ERRORS)), (e % 7 + 1).cast("int"))
    rows = D._events(spark, sf_dir).select(
        "session_id", e.alias("seq"), F.timestamp_millis((F.col("at") * 1000).cast("long")).alias("ts"), kind.alias("kind"),
        F.when(kind == "error", code).when(kind.isin("final", "fallback"), F.col("event_type")).alias("text"), (F.col("value") % 10 / 20).alias("level"), (e % 3).cast("int").alias("epoch"),
    )
    return failover.switched(rows)
