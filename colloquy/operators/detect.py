"""Text detectors: seven kinds of suggestions with exact spans.

Each detector reads a text once, in time in proportion to its length, and gives
items ``(lex_ord, start, end, replacement, message)`` in their order. All of them look at
a text in one Arrow pass over the segments; nothing is shuffled.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from colloquy.functions import text as X
from colloquy.schemas import KINDS, SUGGESTIONS

#: Lexicons; their order is the order of suggestions. Fixed values.
FILLERS = (
    "um", "uh", "umm", "uhh", "er", "erm", "hmm", "mhm",
    "you know", "i mean", "like i said", "sort of", "kind of", "kinda", "sorta",
)
HEDGES = (
    "i think maybe", "i guess", "i suppose", "probably maybe",
    "just wanted to", "i just think", "to be honest", "basically",
    "literally", "actually",
)
WEAK_PHRASES = (
    ("in order to", "to", '"in order to" can usually be just "to"'),
    ("at this point in time", "now", 'Wordy — "now" says the same thing'),
    ("due to the fact that", "because", 'Wordy — "because" is cleaner'),
    ("circle back", "follow up", 'Jargon — consider "follow up"'),
    ("touch base", "check in", 'Jargon — consider "check in"'),
    ("going forward", "from now on", 'Jargon — consider "from now on" or cutting it'),
)
RUN_ON_WORDS, RUN_ON_SPAN, REPEATED_LETTERS, REPEATED_TIMES = 40, 80, 5, 3

#: Rows of one Arrow batch at most; a worker holds one batch of texts and its results.
BATCH_ROWS = 512

Item = tuple[int, int, int, str | None, str]

#: White space as in :data:`text.WS`, what may stand behind a spoken phrase, and letters of words.
SPACES = frozenset(c for c in map(chr, range(0x10000)) if re.fullmatch(f"[{X.WS}]", c))
BEHIND, LETTERS = SPACES | set(",.!?"), frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789_")
_RUN, _WORD, _TOKEN = re.compile(f"[{X.WS}]+"), re.compile("[A-Za-z0-9_]+"), re.compile(f"[^{X.WS}]+")
_SEPARATOR = re.compile(f"[,.]?[{X.WS}]+")
_ODD_SPACE = re.compile(f"  |[{X.WS}][,.!?]")
_LONG_WORD = re.compile(rf"\b[a-z']{{{REPEATED_LETTERS},}}\b", re.ASCII)
_SENTENCE_END = re.compile(f"(?<=[.!?])[{X.WS}]+")
_LOWER = {c: c + 32 for c in range(65, 91)}


def lowered(text: str) -> str:
    """ASCII letters in lower case, so that offsets stay."""
    return text.lower() if text.isascii() else text.translate(_LOWER)


def phrase_starts(low: str, phrase: str, begin: int = 0, end: int | None = None, spoken: bool = True) -> Iterator[int]:
    """Where a phrase stands in a text in lower case: between blanks or signs, or else (not ``spoken``) between word edges."""
    at = low.find(phrase, begin, end)
    while at >= 0:
        before, behind = low[at - 1 : at], low[at + len(phrase) : at + len(phrase) + 1]
        if (not before or before in SPACES) and (not behind or behind in BEHIND) if spoken else before not in LETTERS and behind not in LETTERS:
            yield at
        at = low.find(phrase, at + 1, end)


def filler(text: str, low: str, k: int, at: int) -> Item:
    """The span of a filler takes a space before and a comma behind."""
    end = at + len(FILLERS[k])
    return k, at - (text[at - 1 : at] == " "), end + (text[end : end + 1] == ","), "", f'Filler word — remove "{text[at:end]}"'


def fillers(text: str, low: str) -> Iterator[Item]:
    for k, phrase in enumerate(FILLERS):
        for at in phrase_starts(low, phrase):
            yield filler(text, low, k, at)


def stutters(text: str, low: str, begin: int = 0, end: int | None = None) -> Iterator[Item]:
    """A word said twice in a row, a comma or full stop between them or not."""
    last = None
    for m in _WORD.finditer(low, begin, len(low) if end is None else end):
        if last and last[0] == m[0] and _SEPARATOR.fullmatch(text, last.end(), m.start()):
            word = text[last.start() : last.end()]
            yield 0, last.start(), m.end(), word, f'Repeated word — keep one "{word}"'
            last = None  # the second can't be the first of another
        else:
            last = m


def repeated_words(text: str, low: str) -> Iterator[Item]:
    """Words of five and more letters or apostrophes said three times and more, at their first hit as text, in order of their first."""
    low = text.lower()
    often = [(w, n) for w, n in Counter(_LONG_WORD.findall(low)).items() if n >= REPEATED_TIMES]
    for k, (word, n) in enumerate(often):
        at = low.find(word)
        yield k, at, at + len(word), None, f'"{word}" appears {n}× in this passage — consider varying the wording'


def hedges(text: str, low: str) -> Iterator[Item]:
    """Every phrase by itself, as phrases may share words."""
    for k, phrase in enumerate(HEDGES):
        for at in phrase_starts(low, phrase):
            yield k, at, at + len(phrase), None, f'Hedging phrase — "{text[at:at + len(phrase)]}" may weaken the point'


def weak_phrases(text: str, low: str) -> Iterator[Item]:
    for k, (phrase, new, message) in enumerate(WEAK_PHRASES):
        for at in phrase_starts(low, phrase, spoken=False):
            yield k, at, at + len(phrase), new, message


def run_ons(text: str, low: str) -> Iterator[Item]:
    """Sentences of more than forty words, from where they stand, eighty characters at most."""
    at = 0
    for sentence in _SENTENCE_END.split(text):
        if len(sentence) > 2 * RUN_ON_WORDS:
            n = len(_TOKEN.findall(sentence))
            if n > RUN_ON_WORDS:
                begin = text.find(sentence, at)
                yield 0, begin, begin + min(len(sentence), RUN_ON_SPAN), None, f"Long sentence ({n} words) — consider splitting it up"
        at += len(sentence)


def spacing(text: str, low: str, begin: int = 0, end: int | None = None) -> Iterator[Item]:
    """Two spaces and more, and white space before a sign."""
    end = len(text) if end is None else end
    if not _ODD_SPACE.search(text, begin, min(end + 1, len(text))):
        return
    for run in _RUN.finditer(text, begin, end):
        at, stop = run.span()
        sign = text[stop : stop + 1] in (",", ".", "!", "?")
        while at < stop:
            to = stop if sign else at + 1
            if text.startswith("  ", at):
                to = at
                while to < stop and text[to] == " ":
                    to += 1
            if sign or to - at > 1:
                double = "  " in text[at:to]
                yield (0, at, to, " ", "Extra whitespace") if double else (0, at, to, "", "Space before punctuation")
            at = to


DETECTORS: dict[str, Callable[[str, str], Iterator[Item]]] = dict(
    zip(KINDS, (fillers, stutters, repeated_words, hedges, weak_phrases, run_ons, spacing))
)
#: Kinds whose suggestions have a replacement, always; the others' never have one.
FIXABLE = ("filler", "stutter", "weak-phrase", "spacing")


def found_in(text: str, kinds: tuple[str, ...] = KINDS) -> Iterator[tuple[str, Item]]:
    """All suggestions for one text with their kinds."""
    low = lowered(text)
    for kind in kinds:
        for item in DETECTORS[kind](text, low):
            yield kind, item


def small_batches(spark: SparkSession) -> None:
    """Keep Arrow batches to :data:`BATCH_ROWS` rows, so that a worker's memory doesn't grow with its partition.

    Spark reads the setting when a query runs, so the session keeps it; a smaller one of the user's own stays.
    """
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))


def suggestions(segments: DataFrame, kinds: tuple[str, ...] = KINDS) -> DataFrame:
    """One row per suggestion of final segments that are not blank; see ``schemas.SUGGESTIONS``.

    All detectors look at a segment in one pass, so nothing is shuffled or read
    twice. Their order is (seg_ord, det_ord, lex_ord, start).
    """
    small_batches(segments.sparkSession)
    final = segments.where(~F.coalesce(F.col("interim"), F.lit(False)) & ~X.is_blank(F.col("text")))
    names = [field.split()[0] for field in SUGGESTIONS.split(", ")]
    types = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}
    kinds_ = [types[field.split()[1]] for field in SUGGESTIONS.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for session, segment, order, text in zip(*(c.to_pylist() for c in batch.columns)):
                for kind, (lex, start, end, new, message) in found_in(text, kinds):
                    out.append((session, segment, order, kind, KINDS.index(kind), lex, start, end, text[start:end], new, message))
                if len(out) >= 10_000:
                    yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*out), kinds_)], names=names)
                    out = []
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*out), kinds_)], names=names)

    return final.select("session_id", "seg_id", F.col("seg_ord").cast("bigint").alias("seg_ord"), "text").mapInArrow(run, SUGGESTIONS)


def counts_by_kind(found: DataFrame) -> DataFrame:
    return found.groupBy("kind").agg(F.count("*").alias("n"))


def flagged(segments: DataFrame, found: DataFrame) -> DataFrame:
    """Segments that have a suggestion."""
    return segments.join(found.select("session_id", "seg_id").distinct(), ["session_id", "seg_id"], "left_semi")


def fixable(found: DataFrame) -> DataFrame:
    return found.where(F.col("replacement").isNotNull())
