"""Interval and nearest-match joins, sessions, hopping windows, forward fill and runs.

Range joins carry the session as an equi-key. So that a long session doesn't meet
itself in one task, times are cut into buckets: an interval goes to each bucket
that it touches and a point to its own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from colloquy.functions import ranks
from colloquy.functions import text as X

BUCKET_S = 60.0
#: Gaps and tolerances in seconds. Fixed values.
REGION_GAP, SPAN_GAP, SPAN_TAIL = 0.75, 0.6, 0.25
WINDOW, MIN_WINDOW, MIN_HOP, MAX_WINDOWS = 2.4, 1.0, 1.2, 400
NEAREST, PAD, PAUSE, MAX_WORDS, CHUNK_GAP = 1.0, 0.15, 1.5, 120, 2.0


def _bucket(x: Column, size: float) -> Column:
    return F.floor(x / size)


def point_in_interval(points: DataFrame, at: Column, intervals: DataFrame, start: Column, end: Column, bucket_s: float = BUCKET_S) -> DataFrame:
    """Pairs of a point and an interval of its session that holds it, ends included.

    ``at`` is over ``points``; ``start`` and ``end`` are over ``intervals``. The
    intervals' columns other than ``session_id`` must have names of their own.
    """
    left = points.withColumn("_at", at).withColumn("_bucket", _bucket(F.col("_at"), bucket_s))
    right = intervals.withColumns({"_from": start, "_to": end}).where(F.col("_from") <= F.col("_to"))
    right = right.withColumn("_bucket", F.explode(F.sequence(_bucket(F.col("_from"), bucket_s), _bucket(F.col("_to"), bucket_s))))
    pairs = left.join(right, ["session_id", "_bucket"]).where("_at between _from and _to")
    return pairs.drop("_bucket", "_at", "_from", "_to")


def overlaps(left: DataFrame, a: Column, b: Column, right: DataFrame, c: Column, d: Column, bucket_s: float = BUCKET_S) -> DataFrame:
    """Pairs of intervals of a session that share time, with ``overlap_s``.

    Both sides go to the buckets they touch; a pair counts in the bucket in which
    its common part begins, so it comes once.
    """
    one = left.withColumns({"_a": a, "_b": b}).where(F.col("_a") <= F.col("_b"))
    two = right.withColumns({"_c": c, "_d": d}).where(F.col("_c") <= F.col("_d"))
    one = one.withColumn("_bucket", F.explode(F.sequence(_bucket(F.col("_a"), bucket_s), _bucket(F.col("_b"), bucket_s))))
    two = two.withColumn("_bucket", F.explode(F.sequence(_bucket(F.col("_c"), bucket_s), _bucket(F.col("_d"), bucket_s))))
    overlap = F.least("_b", "_d") - F.greatest("_a", "_c")
    pairs = one.join(two, ["session_id", "_bucket"]).where((overlap > 0) & (F.col("_bucket") == _bucket(F.greatest("_a", "_c"), bucket_s)))
    return pairs.withColumn("overlap_s", overlap).drop("_bucket", "_a", "_b", "_c", "_d")


def nearest_region(points: DataFrame, regions: DataFrame, at: Column, key: str, tolerance: float = NEAREST) -> DataFrame:
    """``points`` with ``speaker_id`` of the region that holds them, or else of the nearest within ``tolerance``; -1 if none.

    Regions that hold a point are at distance 0; of equals, the first in order wins.
    ``key`` numbers the points within their session.
    """
    own = regions.select("session_id", "reg_ord", F.col("start_s").alias("_s"), F.col("end_s").alias("_e"), F.col("speaker_id").alias("_spk"))
    near = point_in_interval(points.select("session_id", key, at.alias("_t")), F.col("_t"), own, F.col("_s") - tolerance, F.col("_e") + tolerance)
    distance = F.greatest(F.col("_s") - F.col("_t"), F.col("_t") - F.col("_e"), F.lit(0.0))
    best = near.where(distance <= tolerance).groupBy("session_id", key).agg(F.min_by("_spk", F.struct(distance, "reg_ord")).alias("speaker_id"))
    return points.join(best, ["session_id", key], "left").withColumn("speaker_id", F.coalesce("speaker_id", F.lit(-1)))


def overlap_vote(words: DataFrame, windows: DataFrame, key: str = "word_ord", pad: float = PAD) -> DataFrame:
    """Words with ``label``: that with most shared time over windows with a label, or of the word before; -1 at the start.

    Of labels with as much time, the one of the earliest window wins.
    """
    labelled = windows.where(F.col("label") >= 0).select("session_id", "win_ord", F.col("start_s").alias("_ws"), F.col("end_s").alias("_we"), "label")
    pairs = overlaps(
        words.select("session_id", key, "start_s", "end_s"), F.col("start_s") - pad, F.col("end_s") + pad, labelled, F.col("_ws"), F.col("_we")
    )
    return forward_fill(words.join(_voted(pairs, key, "label", "win_ord"), ["session_id", key], "left"), "label", key)


def _voted(pairs: DataFrame, key: str, label: str, order: str) -> DataFrame:
    # Rounded, as sums of doubles depend on the order of their parts, which no shuffle keeps.
    votes = pairs.groupBy("session_id", key, label).agg(F.round(F.sum("overlap_s"), 9).alias("_vote"), F.min(order).alias("_first"))
    return votes.groupBy("session_id", key).agg(F.min_by(label, F.struct(-F.col("_vote"), "_first")).alias(label))


def forward_fill(rows: DataFrame, column: str, key: str, default: int = -1) -> DataFrame:
    """Nulls of ``column`` give way to the last value before in the session, or else ``default``."""
    by = Window.partitionBy("session_id").orderBy(key)
    return rows.withColumn(column, F.coalesce(F.last(column, ignorenulls=True).over(by), F.lit(default)))


def chunk_segments(chunks: DataFrame, regions: DataFrame) -> DataFrame:
    """Chunks by the speaker with most shared time; neighbours of one speaker less than two seconds apart merge.

    A chunk that shares no time with a region takes the speaker before it. ``chunks`` has
    ``session_id, chunk_ord, text, start_s, end_s``; blank ones are left out.
    """
    rows = chunks.where(~X.is_blank(F.col("text"))).withColumn("text", X.trim(F.col("text")))
    own = regions.select("session_id", "reg_ord", F.col("start_s").alias("_rs"), F.col("end_s").alias("_re"), "speaker_id")
    pairs = overlaps(rows.select("session_id", "chunk_ord", "start_s", "end_s"), F.col("start_s"), F.col("end_s"), own, F.col("_rs"), F.col("_re"))
    rows = rows.join(_voted(pairs, "chunk_ord", "speaker_id", "reg_ord"), ["session_id", "chunk_ord"], "left")
    rows = forward_fill(rows, "speaker_id", "chunk_ord")
    by = Window.partitionBy("session_id").orderBy("chunk_ord")
    apart = (F.col("speaker_id") != F.lag("speaker_id").over(by)) | (F.col("start_s") - F.lag("end_s").over(by) >= CHUNK_GAP)
    return _collected(rows.withColumn("_new", F.coalesce(apart, F.lit(True)).cast("int")), "chunk_ord")


def _collected(rows: DataFrame, key: str) -> DataFrame:
    """Segments from rows whose ``_new`` is 1 where one begins."""
    by = Window.partitionBy("session_id").orderBy(key)
    runs = rows.withColumn("seg_ord", F.sum("_new").over(by) - 1)
    texts = F.array_sort(F.collect_list(F.struct(F.col(key), F.col("text"))))
    out = runs.groupBy("session_id", "seg_ord").agg(
        F.min_by("speaker_id", key).alias("speaker_id"),
        F.array_join(F.transform(texts, lambda x: x["text"]), " ").alias("text"),
        F.min_by("start_s", key).alias("start_s"),
        F.max_by("end_s", key).alias("end_s"),
    )
    return out.select(
        "session_id", F.concat(F.lit("file-"), F.col("seg_ord").cast("string")).alias("seg_id"), "seg_ord", "speaker_id",
        X.trim(X.one_space(F.col("text"))).alias("text"), "start_s", "end_s", F.lit(False).alias("interim"),
    )


def word_segments(words: DataFrame, pause: float = PAUSE, most: int = MAX_WORDS) -> DataFrame:
    """Segments of words with ``speaker_id``: a new one at another speaker, a long pause, or after ``most`` words."""
    by = Window.partitionBy("session_id").orderBy("word_ord")
    apart = (F.col("speaker_id") != F.lag("speaker_id").over(by)) | (F.col("start_s") - F.lag("end_s").over(by) > pause)
    runs = words.withColumn("_new", F.coalesce(apart, F.lit(True)).cast("int")).withColumn("_run", F.sum("_new").over(by))
    nth = F.row_number().over(Window.partitionBy("session_id", "_run").orderBy("word_ord")) - 1
    return _collected(runs.withColumn("_new", (nth % most == 0).cast("int")), "word_ord")


def gap_runs(frames: DataFrame, gap: float, at: str = "time_s") -> DataFrame:
    """Frames with ``run``, counted from 0 in their session: a new one after more than ``gap`` seconds."""
    by = Window.partitionBy("session_id").orderBy(at)
    new = F.coalesce(F.col(at) - F.lag(at).over(by) > gap, F.lit(False)).cast("int")
    return frames.withColumn("run", F.sum(new).over(by))


def voiced_spans(frames: DataFrame, gap: float = REGION_GAP) -> DataFrame:
    """Bounds, number of frames and median pitch of the runs of frames."""
    return gap_runs(frames, gap).groupBy("session_id", "run").agg(
        F.min("time_s").alias("start_s"), F.max("time_s").alias("end_s"), F.count("*").alias("n_frames"),
        F.median(F.when(F.col("pitch_hz") > 0, F.col("pitch_hz"))).alias("median_pitch_hz"),
    )


def hop_windows(frames: DataFrame, most: int = MAX_WINDOWS) -> DataFrame:
    """Windows over the speech of each session, numbered in order, ``most`` at most.

    The hop grows so that about ``most`` cover the session. Windows start at their
    span's start, are cut at its end and last a second at least. A short first span
    still gives one.
    """
    spans = gap_runs(frames, SPAN_GAP).groupBy("session_id", "run").agg(
        F.min("time_s").alias("_start"), (F.max("time_s") + SPAN_TAIL).alias("_end")
    )
    whole = Window.partitionBy("session_id")
    hop = F.greatest(F.lit(MIN_HOP), F.sum(F.col("_end") - F.col("_start")).over(whole) / most)
    spans = spans.withColumn("_hop", hop)
    # The last window is the first that reaches the end.
    count = F.greatest(F.ceil((F.col("_end") - F.col("_start") - WINDOW) / F.col("_hop")), F.lit(0)).cast("int")
    k = F.explode(F.sequence(F.lit(0), count)).alias("_k")
    rows = spans.select("session_id", "run", "_start", "_end", "_hop", k)
    begin = F.col("_start") + F.col("_k") * F.col("_hop")
    rows = rows.withColumns({"start_s": begin, "end_s": F.least(begin + WINDOW, F.col("_end"))})
    short_first = (F.col("_k") == 0) & (F.col("run") == 0)
    rows = rows.where((F.col("end_s") - F.col("start_s") >= MIN_WINDOW) | short_first)
    number = F.row_number().over(Window.partitionBy("session_id").orderBy("run", "_k")) - 1
    rows = rows.select("session_id", number.alias("win_ord"), "start_s", "end_s")
    return rows.where(F.col("win_ord") < most)


def first_window_label(frames: DataFrame, windows: DataFrame) -> DataFrame:
    """Voiced frames with the label of the first labelled window that holds them."""
    voiced = frames.where(F.col("pitch_hz") > 0)
    own = windows.where(F.col("label") >= 0).select("session_id", "win_ord", F.col("start_s").alias("_s"), F.col("end_s").alias("_e"), "label")
    pairs = point_in_interval(voiced, F.col("time_s"), own, F.col("_s"), F.col("_e"))
    return pairs.groupBy("session_id", "time_s").agg(F.min_by("label", "win_ord").alias("label"), F.first("pitch_hz").alias("pitch_hz"))


def label_pitch(frames: DataFrame, windows: DataFrame) -> DataFrame:
    """Each label's representative pitch: the upper median of its frames, 0 without any."""
    upper = ranks.by_rank(first_window_label(frames, windows), ["session_id", "label"], "pitch_hz", {"_p": ranks.UPPER})
    labels = windows.where(F.col("label") >= 0).select("session_id", "label").distinct()
    return labels.join(upper, ["session_id", "label"], "left").select("session_id", "label", F.coalesce("_p", F.lit(0.0)).alias("pitch_hz"))


def utterance_frames(utterances: DataFrame, frames: DataFrame) -> DataFrame:
    """Frames of each utterance: those after the one before ended and up to its own end."""
    by = Window.partitionBy("session_id").orderBy("utt_ord")
    since = utterances.select(
        "session_id", "utt_ord", F.coalesce(F.lag("end_s").over(by), F.lit(float("-inf"))).alias("_since"), F.col("end_s").alias("_until")
    )
    left = F.greatest("_since", F.lit(0.0))
    pairs = point_in_interval(frames, F.col("time_s"), since, left, F.col("_until"))
    return pairs.where("time_s > _since").drop("_since", "_until")


def timed_words(chunks: DataFrame, durations: DataFrame) -> DataFrame:
    """Recognized chunks as ``session_id, word_ord, text, start_s, end_s``; blank ones are left out.

    A missing start is 0; a missing end is 30 s later, or the audio's end.
    """
    start = F.coalesce(F.col("ts.start"), F.lit(0.0))
    rows = chunks.join(durations.select("session_id", "duration_s"), "session_id", "left")
    return rows.where(~X.is_blank(F.col("text"))).select(
        "session_id", F.col("chunk_ord").alias("word_ord"), "text", start.alias("start_s"),
        F.coalesce(F.col("ts.end"), F.least(start + 30, F.col("duration_s"))).alias("end_s"),
    )


def granularity(chunks: DataFrame) -> DataFrame:
    """'chunk' for sessions whose recognized texts have more than twenty characters on average, else 'word'."""
    return chunks.groupBy("session_id").agg(F.when(F.avg(F.length("text")) > 20, "chunk").otherwise("word").alias("granularity"))


def previous_ends(utterances: DataFrame) -> DataFrame:
    """Utterances start where the one before ended, the first at 0."""
    by = Window.partitionBy("session_id").orderBy("utt_ord")
    return utterances.withColumn("start_s", F.coalesce(F.lag("end_s").over(by), F.lit(0.0)))
