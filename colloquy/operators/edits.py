"""Applying and dismissing suggestions."""

from __future__ import annotations

import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colloquy.functions import text as X
from colloquy.operators import detect

ORDER = ("det_ord", "lex_ord", "start", "end")


def fixed(segments: DataFrame, chosen: DataFrame) -> DataFrame:
    """``segments`` with one chosen suggestion each applied; runs of spaces collapse, ends are trimmed.

    Advisory suggestions, those without a replacement, change nothing.
    """
    new = chosen.where(F.col("replacement").isNotNull()).select("session_id", "seg_id", "start", "end", "replacement")
    text = X.trim(X.one_space(X.spliced(F.col("text"), F.col("start"), F.col("end"), F.col("replacement"))))
    joined = segments.join(new, ["session_id", "seg_id"], "left")
    return joined.withColumn("text", F.when(F.col("replacement").isNull(), F.col("text")).otherwise(text)).select(segments.columns)


def remaining(found: DataFrame, applied: DataFrame) -> DataFrame:
    """Suggestions left once some were applied: those of other segments, as offsets have moved."""
    return found.join(applied.select("session_id", "seg_id").distinct(), ["session_id", "seg_id"], "left_anti")


def dismissed(found: DataFrame, session_id: str, seg_id: str, kind: str, start: int) -> DataFrame:
    hit = (F.col("session_id") == session_id) & (F.col("seg_id") == seg_id) & (F.col("kind") == kind) & (F.col("start") == start)
    return found.where(~hit)


def first_fixes(found: DataFrame) -> DataFrame:
    """The first suggestion with a replacement of each segment."""
    first = F.min_by(F.struct("start", "end", "replacement", "kind"), F.struct(*ORDER)).alias("m")
    return detect.fixable(found).groupBy("session_id", "seg_id").agg(first).select("session_id", "seg_id", "m.*")


_SPACES, _DOUBLE = "".join(sorted(detect.SPACES)), re.compile(" {2,}")
#: How many tokens around a change a new suggestion can reach over; the longest phrase has five words.
REACH = 8


def _first_phrase(phrases: tuple[str, ...], spoken: bool, item: Callable) -> list[Callable]:
    """For each phrase, a function from a text and a part of it to the phrase's first item there."""

    def finder(k: int, phrase: str) -> Callable:
        def find(text: str, low: str, begin: int, end: int):
            at = next(detect.phrase_starts(low, phrase, begin, end, spoken), None)
            return None if at is None else item(text, low, k, at)

        return find

    return [finder(k, phrase) for k, phrase in enumerate(phrases)]


def _weak(text: str, low: str, k: int, at: int):
    phrase, new, message = detect.WEAK_PHRASES[k]
    return k, at, at + len(phrase), new, message


#: What finds the first fix, in the order of suggestions.
FINDERS: list[Callable] = [
    *_first_phrase(detect.FILLERS, True, detect.filler),
    lambda text, low, begin, end: next(detect.stutters(text, low, begin, end), None),
    *_first_phrase(tuple(p for p, _, _ in detect.WEAK_PHRASES), False, _weak),
    lambda text, low, begin, end: next(detect.spacing(text, low, begin, end), None),
]


def fixed_once(text: str) -> str | None:
    """A text with its first fix applied; None if it has none."""
    low = detect.lowered(text)
    for find in FINDERS:
        if item := find(text, low, 0, len(text)):
            _, start, end, new, _ = item
            return _DOUBLE.sub(" ", text[:start] + new + text[end:]).strip(_SPACES)
    return None


def fixed_wholly(text: str) -> str:
    """A text after as many single fixes as it takes until none is left.

    The first fix takes out all runs of spaces. From then on only the surroundings of
    a fix can have become different, so each finder remembers the part of the text that it has
    not seen since, and a fix costs a look at its surroundings and a copy of the text.
    """
    once = fixed_once(text)
    if once is None:
        return text
    text, low = once, detect.lowered(once)
    unseen: list[tuple[int, int] | None] = [(0, len(text))] * len(FINDERS)
    while True:
        for k, find in enumerate(FINDERS):
            if unseen[k] and (item := find(text, low, *unseen[k])):
                break
            unseen[k] = None
        else:
            return text
        _, start, end, new, _ = item
        unseen[k] = (start, unseen[k][1])  # nothing before its first
        # The change with the spaces around it, which become one.
        left, right = start, end
        while left and text[left - 1] == " ":
            left -= 1
        while right < len(text) and text[right] == " ":
            right += 1
        middle = _DOUBLE.sub(" ", text[left:start] + new + text[end:right])
        if not left:
            middle = middle.lstrip(_SPACES)
            if not middle:
                right += len(text) - right - len(text[right:].lstrip(_SPACES))
        if right == len(text):
            middle = middle.rstrip(_SPACES)
            if not middle:
                left = len(text[:left].rstrip(_SPACES))
        text, low = text[:left] + middle + text[right:], low[:left] + detect.lowered(middle) + low[right:]
        moved, stop = left + len(middle) - right, left + len(middle)
        begin, finish = left, stop
        for _ in range(REACH):
            while begin and text[begin - 1] in detect.SPACES:
                begin -= 1
            while begin and text[begin - 1] not in detect.SPACES:
                begin -= 1
            while finish < len(text) and text[finish] in detect.SPACES:
                finish += 1
            while finish < len(text) and text[finish] not in detect.SPACES:
                finish += 1
        for k, part in enumerate(unseen):
            lo, hi = part or (begin, finish - moved)
            lo, hi = lo if lo <= left else max(lo + moved, left), hi + moved if hi >= right else min(hi, stop)
            unseen[k] = min(lo, begin), max(hi, finish)


def _mapped(segments: DataFrame, change: Callable[[str], str | None]) -> DataFrame:
    """Segments that are looked at, with their text changed where ``change`` gives one."""

    @F.pandas_udf("string")
    def changed(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else change(t))

    detect.small_batches(segments.sparkSession)
    looked_at = ~F.coalesce(F.col("interim"), F.lit(False)) & ~X.is_blank(F.col("text"))
    new = F.coalesce(changed(F.when(looked_at, F.col("text"))), F.col("text"))
    return segments.withColumn("text", new)


def apply_first(segments: DataFrame) -> DataFrame:
    """One pass of fixing: each segment's first fix, found and applied in its row without a join."""
    return _mapped(segments, fixed_once)


def apply_all(segments: DataFrame, passes: int | None = None) -> DataFrame:
    """Passes of :func:`apply_first`, each over the text that the last one left, until no fix is left; or a fixed number."""
    if passes is None:
        return _mapped(segments, fixed_wholly)

    def several(text: str) -> str:
        for _ in range(passes):
            new = fixed_once(text)
            if new is None:
                break
            text = new
        return text

    return _mapped(segments, several)
