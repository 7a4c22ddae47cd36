"""From audio to a speaker-attributed transcript, all sessions in one plan.

Sessions with word times and at least two voice vectors are labelled by clusters of
voices; the others by pitch and timbre of their voiced regions.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from colloquy.functions import signal
from colloquy.operators import cluster, intervals, ordered
from colloquy.sources import readers, scratch, waves


def routes(windows: DataFrame, vectors: DataFrame, chunks: DataFrame) -> DataFrame:
    """``session_id, granularity, accurate``: whether a session has two windows, two vectors and word times."""
    n_windows = windows.groupBy("session_id").agg(F.count("*").alias("n_windows"))
    n_vectors = vectors.groupBy("session_id").agg(F.count("vector").alias("n_vectors"))
    rows = intervals.granularity(chunks).join(n_windows, "session_id", "left").join(n_vectors, "session_id", "left")
    enough = (F.coalesce("n_windows", F.lit(0)) >= 2) & (F.coalesce("n_vectors", F.lit(0)) >= 2)
    return rows.select("session_id", "granularity", (enough & (F.col("granularity") == "word")).alias("accurate"))


def _absorbed(words: DataFrame) -> DataFrame:
    return ordered.by_session(words, "word_ord", "speaker_id", ordered.absorbed)


def by_voices(words: DataFrame, windows: DataFrame, vectors: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Segments of words, and windows with their smoothed ``label``."""
    labels = ordered.by_session(cluster.cluster_vectors(vectors), "win_ord", "label", ordered.smoothed)
    labelled = windows.join(labels, ["session_id", "win_ord"], "left").withColumn("label", F.coalesce("label", F.lit(-1)))
    voted = intervals.overlap_vote(words, labelled).withColumnRenamed("label", "speaker_id")
    return intervals.word_segments(_absorbed(voted)), labelled


def by_regions(words: DataFrame, regions: DataFrame) -> DataFrame:
    """Segments of words by the nearest region of their middle; words far from any take the speaker before."""
    middle = (F.col("start_s") + F.col("end_s")) / 2
    near = intervals.nearest_region(words, regions, middle, "word_ord")
    known = near.withColumn("speaker_id", F.when(F.col("speaker_id") >= 0, F.col("speaker_id")))
    return intervals.word_segments(_absorbed(intervals.forward_fill(known, "speaker_id", "word_ord")))


def region_speakers(regions: DataFrame) -> DataFrame:
    """``session_id, id, median_pitch_hz``: a speaker's last region gives the pitch."""
    heard = regions.where((F.col("speaker_id") >= 0) & (F.col("median_pitch_hz") > 0))
    return heard.groupBy("session_id", F.col("speaker_id").alias("id")).agg(F.max_by("median_pitch_hz", "reg_ord").alias("median_pitch_hz"))


def transcribed(
    audio: DataFrame, recognizer: readers.Recognizer = readers.stub_recognizer, embedder: readers.Embedder = readers.stub_embedder
) -> tuple[DataFrame, DataFrame]:
    """``schemas.SEGMENTS`` and heard speakers of ``session_id, sample_rate, pcm, duration_s``."""
    frames = signal.frames(audio)
    return _attributed(readers.recognized(audio, recognizer), frames, audio, lambda windows: readers.embedded(windows, audio, embedder))


def transcribed_files(
    spark: SparkSession, path: str, recognizer: readers.Recognizer = readers.stub_recognizer, embedder: readers.Embedder = readers.stub_embedder, unit_s: int = waves.UNIT_S
) -> tuple[DataFrame, DataFrame]:
    """:func:`transcribed` of wave files of any length: each is read in units that several tasks share.

    Recognition, frames and vectors read the files once each, with the overlap that they need, and their
    results are written to the shared folder, as several steps use them and no model should be asked twice.
    """
    pieces = waves.units(spark, path, unit_s, overlap_s=readers.LONG_CHUNK_S)
    chunks = scratch.written(readers.recognized_units(pieces, recognizer), "chunks")
    frames = scratch.written(waves.file_frames(spark, path, unit_s), "frames")
    lengths = scratch.written(waves.lengths(spark, path, unit_s), "lengths")
    embed = lambda windows: scratch.written(readers.embedded_units(windows, pieces, embedder, unit_s=unit_s), "vectors")
    return _attributed(chunks, frames, lengths, embed)


def _attributed(chunks: DataFrame, frames: DataFrame, lengths: DataFrame, embed: Callable[[DataFrame], DataFrame]) -> tuple[DataFrame, DataFrame]:
    words = intervals.timed_words(chunks, lengths)
    windows = intervals.hop_windows(frames)
    vectors = embed(windows)
    route = routes(windows, vectors, chunks)
    accurate = route.where("accurate").select("session_id")
    fallback = route.where("not accurate")
    only = lambda rows, sessions: rows.join(sessions.select("session_id"), "session_id", "left_semi")

    voiced, labelled = by_voices(only(words, accurate), only(windows, accurate), only(vectors, accurate))
    regions = cluster.voiced_regions(only(frames, fallback))
    spoken = by_regions(only(words, fallback.where("granularity = 'word'")), regions)
    chunked = only(words, fallback.where("granularity = 'chunk'")).withColumnRenamed("word_ord", "chunk_ord")
    segments = voiced.unionByName(spoken).unionByName(intervals.chunk_segments(chunked, regions))
    pitch = intervals.label_pitch(frames, labelled).select("session_id", F.col("label").alias("id"), F.col("pitch_hz").alias("median_pitch_hz"))
    return segments, pitch.unionByName(region_speakers(regions))


def refinable(recordings: DataFrame, refined: DataFrame, least_bytes: int = 20_000) -> DataFrame:
    """Live recordings of more than ``least_bytes`` bytes that no refining pass has seen: ``session_id, content_id, n_bytes``."""
    return recordings.where(F.col("n_bytes") > least_bytes).dropDuplicates(["content_id"]).join(refined.select("content_id"), "content_id", "left_anti")
