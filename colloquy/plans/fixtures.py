"""The engine's tables from the test tables, in Spark and, in the same words, in DuckDB SQL.

Conversations are transcripts; events are voice frames, words, regions, windows and
short spoken texts; embeddings are voice vectors.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Texts that events stand for, by event_id; {0} is the event's type.
TEMPLATES = (
    "I guess we can {0} the plan later.",
    "In order to {0} we meet again soon.",
    "Have we decided on the {0} date?",
    "We decided we will ship the {0} part.",
    "Send the {0} report by friday please.",
    "The river  runs past the {0} house , they say.",
    "Due to the fact that {0} works we literally won.",
    "I just wanted to be honest about the {0} road today.",
    "Who will take care of the {0} desk?",
    "They touch base about {0} every single morning.",
    "The team agreed to the {0} budget of 300 euros.",
    "Um the the {0} garden looks green and quiet.",
    "Nobody knows where the {0} letter went yesterday.",
    "What does the {0} number 42 mean here? ",
    "So uh, {0} was fine. Review the {0} draft soon.",
    "Old {0} trees grow slowly near calm water.",
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def conversation_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("turn").cast("double")
    return table(spark, sf_dir, "conversations").select(
        F.col("conv_id").cast("string").alias("session_id"),
        F.concat(F.col("conv_id").cast("string"), F.lit("-"), F.col("turn").cast("string")).alias("seg_id"),
        F.col("turn").alias("seg_ord"),
        F.when(F.col("role") == "user", 0).when(F.col("role") == "assistant", 1).otherwise(2).alias("speaker_id"),
        "text", (t * 61.5).alias("start_s"), (t * 61.5 + F.length("text") / 16).alias("end_s"), F.lit(False).alias("interim"),
    )


SEGMENTS = """seg AS (
  SELECT conv_id::VARCHAR AS session_id, conv_id || '-' || turn AS seg_id, turn AS seg_ord,
         CASE role WHEN 'user' THEN 0 WHEN 'assistant' THEN 1 ELSE 2 END AS speaker_id, text,
         turn::DOUBLE * 61.5 AS start_s, turn::DOUBLE * 61.5 + length(text) / 16 AS end_s
  FROM conversations
)"""


def document_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(
        F.col("doc_id").cast("string").alias("session_id"), F.col("doc_id").cast("string").alias("seg_id"), F.lit(0).cast("bigint").alias("seg_ord"),
        F.lit(0).alias("speaker_id"), "text", F.lit(0.0).alias("start_s"), F.lit(1.0).alias("end_s"), F.lit(False).alias("interim"),
    )


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with ``at``: their time, so scaled that a user's are about a second apart."""
    micros = F.expr("timestampdiff(MICROSECOND, timestamp_ntz'2024-01-01 00:00:00', ts)")
    return table(spark, sf_dir, "events").withColumns(
        {"session_id": F.col("user_id").cast("string"), "at": F.round(micros / 4.0e10, 3), "e": F.col("event_id")}
    )


EVENTS = """ev AS (
  SELECT *, user_id::VARCHAR AS session_id, event_id AS e,
         round((epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01 00:00:00')) / 4.0e10, 3) AS tm
  FROM events
)"""


def spoken_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = F.element_at(F.array(*map(F.lit, TEMPLATES)), (F.col("e") % len(TEMPLATES) + 1).cast("int"))
    return _events(spark, sf_dir).select(
        "session_id", F.col("e").cast("string").alias("seg_id"), F.col("e").alias("seg_ord"), (F.col("e") % 3).cast("int").alias("speaker_id"),
        F.replace(texts, F.lit("{0}"), F.col("event_type")).alias("text"), F.col("at").alias("start_s"), (F.col("at") + 0.5).alias("end_s"),
        F.lit(False).alias("interim"),
    )


_LIST = ", ".join("'" + t.replace("'", "''") + "'" for t in TEMPLATES)
SPOKEN = f"""{EVENTS}, seg AS (
  SELECT session_id, e::VARCHAR AS seg_id, e AS seg_ord, (e % 3)::INTEGER AS speaker_id,
         replace(list_extract([{_LIST}], (e % {len(TEMPLATES)} + 1)::INTEGER), '{{0}}', event_type) AS text,
         tm AS start_s, tm + 0.5 AS end_s
  FROM ev
)"""


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One frame a time: pitch from the value, unvoiced for every seventh event."""
    rows = _events(spark, sf_dir).groupBy("session_id", F.col("at").alias("time_s")).agg(F.min_by("value", "e").alias("v"), F.min("e").alias("e"))
    return rows.select(
        "session_id", "time_s", F.when(F.col("e") % 7 == 0, 0.0).otherwise(F.col("v") + 60).alias("pitch_hz"),
        (F.col("v") * 3 + 500).alias("centroid_hz"), F.lit(0.1).alias("energy"), "e",
    )


FRAMES = f"""{EVENTS}, frames AS (
  SELECT session_id, tm AS time_s, CASE WHEN min(e) % 7 = 0 THEN 0.0 ELSE arg_min(value, e) + 60 END AS pitch_hz, min(e) AS e
  FROM ev GROUP BY session_id, tm
)"""


def words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event is a word."""
    return _events(spark, sf_dir).select(
        "session_id", F.col("e").alias("word_ord"), F.col("event_type").alias("text"), F.col("at").alias("start_s"), (F.col("at") + 0.375).alias("end_s")
    )


WORDS = "words AS (SELECT session_id, e AS word_ord, event_type AS text, tm AS start_s, tm + 0.375 AS end_s FROM ev)"


def regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event is a region, some seconds after its word, so words have regions of other events, or none."""
    return _events(spark, sf_dir).select(
        "session_id", F.col("e").alias("reg_ord"), (F.col("at") + 3).alias("start_s"), (F.col("at") + 3.5).alias("end_s"),
        (F.col("e") % 5 - 1).cast("int").alias("speaker_id"), F.col("value").alias("median_pitch_hz"),
    )


REGIONS = "regions AS (SELECT session_id, e AS reg_ord, tm + 3 AS start_s, tm + 3.5 AS end_s, (e % 5 - 1)::INTEGER AS speaker_id FROM ev)"


def windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event is a window, whose end is the middle of its word; some have no label."""
    return _events(spark, sf_dir).select(
        "session_id", F.col("e").alias("win_ord"), (F.col("at") - 2.25).alias("start_s"), (F.col("at") + 0.25).alias("end_s"), (F.col("e") % 4 - 1).cast("int").alias("label")
    )


WINDOWS = "windows AS (SELECT session_id, e AS win_ord, tm - 2.25 AS start_s, tm + 0.25 AS end_s, (e % 4 - 1)::INTEGER AS label FROM ev)"


def utterances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event ends an utterance; in the order of times, as a session's utterances end one after the other."""
    order = F.row_number().over(Window.partitionBy("session_id").orderBy("at", "e"))
    return _events(spark, sf_dir).select("session_id", order.cast("bigint").alias("utt_ord"), F.col("at").alias("end_s"))


UTTERANCES = "utt AS (SELECT session_id, row_number() OVER (PARTITION BY session_id ORDER BY tm, e) AS utt_ord, tm AS end_s FROM ev)"


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("label").cast("string").alias("session_id"), F.col("vec_id").alias("win_ord"), F.col("embedding").alias("vector"))


def speakers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users and assistants of conversations have names; system turns have none."""
    ids = conversation_segments(spark, sf_dir).select("session_id", F.col("speaker_id").alias("id")).where("id < 2").distinct()
    return ids.select("session_id", "id", F.concat(F.lit("Speaker "), (F.col("id") + 1).cast("string")).alias("name"), F.lit("#4f8ef7").alias("color"), F.lit(0.0).alias("median_pitch_hz"))
