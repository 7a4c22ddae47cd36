"""String expressions with the semantics of the transcripts' source: its white space, word edges and offsets.

Offsets count code points.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as the analyzer of the transcripts knows it, for character classes. Fixed value.
WS = r"\t-\r \u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"
#: A word edge where words are ASCII letters, digits and the underscore.
EDGE = r"(?:(?<=[A-Za-z0-9_])(?![A-Za-z0-9_])|(?<![A-Za-z0-9_])(?=[A-Za-z0-9_]))"


def trim(text: Column) -> Column:
    return F.regexp_replace(text, rf"^[{WS}]+|[{WS}]+\z", "")


def is_blank(text: Column) -> Column:
    """Null and all-blank texts."""
    return text.isNull() | ~text.rlike(rf"[^{WS}]")


def words(text: Column) -> Column:
    return F.array_remove(F.split(text, rf"[{WS}]+"), "")


def sentences(text: Column) -> Column:
    """Pieces that end in a full stop, exclamation or question mark before white space."""
    return F.split(text, rf"(?<=[.!?])[{WS}]+")


def one_space(text: Column) -> Column:
    return F.regexp_replace(text, " {2,}", " ")


def joined(*parts: Column) -> Column:
    return one_space(F.concat_ws(" ", *parts))


def capitalized(text: Column) -> Column:
    """Only the first character in upper case."""
    return F.concat(F.upper(F.substring(text, 1, 1)), F.substr(text, F.lit(2)))


def spliced(text: Column, start: Column, end: Column, replacement: Column) -> Column:
    """``text`` with the characters from ``start`` to ``end`` replaced."""
    return F.concat(F.substr(text, F.lit(1), start), replacement, F.substr(text, end + 1))


def clock(seconds: Column) -> Column:
    """m:ss; the minutes have no upper end."""
    whole = F.floor(seconds)
    return F.format_string("%d:%02d", F.floor(whole / 60), whole % 60)


def srt_time(seconds: Column) -> Column:
    """HH:MM:SS,mmm; below 0 counts as 0. Milliseconds are rounded first, so that they carry."""
    ms = F.floor(F.greatest(seconds, F.lit(0.0)) * 1000 + 0.5).cast("long")
    return F.format_string("%02d:%02d:%02d,%03d", F.expr("0L") + F.floor(ms / 3600000), F.floor(ms / 60000) % 60, F.floor(ms / 1000) % 60, ms % 1000)


def default_name(speaker_id: Column) -> Column:
    return F.concat(F.lit("Speaker "), (speaker_id + 1).cast("string"))


#: What kinds of suggestions are called. Fixed values.
LABELS = {
    "filler": "Filler", "stutter": "Stutter", "repeated-word": "Repetition", "hedge": "Hedging", "weak-phrase": "Wordy", "run-on": "Run-on", "spacing": "Spacing",
}


def kind_label(kind: Column) -> Column:
    """What a kind of suggestion is called; null for a kind that there isn't."""
    return F.element_at(F.create_map(*(F.lit(x) for pair in LABELS.items() for x in pair)), kind)


def counted(n: Column, one: str) -> Column:
    """'1 speaker', '2 speakers'."""
    return F.concat(n.cast("string"), F.when(n == 1, F.lit(f" {one}")).otherwise(F.lit(f" {one}s")))


def pitch_label(hz: Column) -> Column:
    """'~120 Hz', null without a pitch."""
    return F.when(hz > 0, F.concat(F.lit("~"), F.floor(hz + 0.5).cast("string"), F.lit(" Hz")))


#: Colours of speakers by id. Fixed values.
PALETTE = ("#4f8ef7", "#e2557b", "#3bb273", "#e8a13c", "#9b6bd3", "#38b6b6", "#c96f4a", "#7a86e8")


def color(speaker_id: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, PALETTE)), (F.pmod(speaker_id, F.lit(len(PALETTE))) + 1).cast("int"))


def audio_extension(mime: Column) -> Column:
    """File extension by media type, webm where none fits."""
    known = (("m4a", ("mp4", "m4a")), ("mp3", ("mpeg", "mp3")), ("wav", ("wav",)), ("ogg", ("ogg",)))
    out = F.lit("webm")
    for extension, parts in reversed(known):
        for part in parts:
            out = F.when(mime.contains(part), extension).otherwise(out)
    return out


def draft_id(saved_ms: Column) -> Column:
    """Epoch milliseconds in base 36."""
    return F.concat(F.lit("draft-"), F.lower(F.conv(saved_ms.cast("string"), 10, 36)))


def backoff_ms(attempt: Column) -> Column:
    """Delay before a restart of the recognizer: doubling from 50 ms to 3 s."""
    return F.least(50 * F.pow(F.lit(2.0), attempt), F.lit(3000.0))


def cooldown_ms(attempt: Column) -> Column:
    """Pause after a refused start: doubling from 5 s to 30 s; attempts from 1 on."""
    return F.least(5000 * F.pow(F.lit(2.0), attempt - 1), F.lit(30000.0))
