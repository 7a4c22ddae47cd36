"""State of live recognition as columns: stalls, failover and late results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Seconds and levels of the watchdog. Fixed values.
STALL_S, VOICE_LEVEL, VOICE_S = 8.0, 0.06, 5.0


def should_kick(now_s: Column, last_result_s: Column, last_voice_s: Column) -> Column:
    """Whether recognition is mute although somebody spoke in the last seconds."""
    return (now_s - last_result_s > STALL_S) & (now_s - last_voice_s <= VOICE_S)


def last_voice(levels: DataFrame) -> DataFrame:
    """``session_id, last_voice_s``: when the meter was last above the voice level."""
    return levels.where(F.col("level") > VOICE_LEVEL).groupBy("session_id").agg(F.max("time_s").alias("last_voice_s"))


def preferred(native: DataFrame, fallback: DataFrame) -> DataFrame:
    """One text for each utterance: the recognizer's, or else the fallback engine's."""
    both = native.join(fallback.withColumnRenamed("text", "_other"), ["session_id", "utt_ord"], "full")
    return both.select(
        "session_id", "utt_ord", F.coalesce("text", "_other").alias("text"), F.when(F.col("text").isNotNull(), "native").otherwise("fallback").alias("engine")
    )


def current_only(results: DataFrame, engines: DataFrame) -> DataFrame:
    """Results of the engine in use at their time; those that come after a switch back are dropped.

    ``engines`` has ``session_id, engine, from_s, until_s``.
    """
    joined = results.join(engines.select("session_id", "engine", "from_s", "until_s"), ["session_id", "engine"])
    return joined.where("time_s >= from_s and (until_s is null or time_s < until_s)").drop("from_s", "until_s")
