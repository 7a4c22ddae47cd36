"""Changes to a session's tables, each a new DataFrame: nothing is updated in place.

``written_sessions`` makes such a change durable for the sessions concerned.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from colloquy.functions import text as X
from colloquy.sources.sessions import SessionTable

DRAFTS_KEPT = 20


def upsert(segments: DataFrame, new: DataFrame) -> DataFrame:
    """Rows of ``new`` take the place, and the order, of those with their id; the others come last.

    Of several new rows with one id, the last ``seg_ord`` counts.
    """
    key = ["session_id", "seg_id"]
    last = Window.partitionBy(*key).orderBy(F.desc("seg_ord"))
    new = new.withColumn("_n", F.row_number().over(last)).where("_n = 1").drop("_n")
    place = segments.select(*key, F.col("seg_ord").alias("_place"))
    end = segments.groupBy("session_id").agg((F.max("seg_ord") + 1).alias("_end"))
    by = Window.partitionBy("session_id", F.col("_place").isNull()).orderBy("seg_ord")
    placed = new.join(place, key, "left").join(end, "session_id", "left").withColumn(
        "seg_ord", F.coalesce("_place", F.coalesce("_end", F.lit(0)) + F.row_number().over(by) - 1)
    )
    kept = segments.join(new.select(*key), key, "left_anti")
    return kept.unionByName(placed.select(segments.columns))


def replaced(segments: DataFrame, new: DataFrame) -> DataFrame:
    """The sessions in ``new`` have its segments only."""
    return cleared(segments, new.select("session_id").distinct()).unionByName(new.select(segments.columns))


def cleared(table: DataFrame, sessions: DataFrame) -> DataFrame:
    return table.join(sessions, "session_id", "left_anti")


def ensured_speakers(speakers: DataFrame, heard: DataFrame) -> DataFrame:
    """Speakers of ``heard(session_id, id, median_pitch_hz)`` exist, and have its pitch; names stay."""
    both = speakers.join(heard.withColumnRenamed("median_pitch_hz", "_new"), ["session_id", "id"], "full")
    return both.select(
        "session_id", "id", F.coalesce("name", X.default_name(F.col("id"))).alias("name"),
        F.coalesce("color", X.color(F.col("id"))).alias("color"), F.coalesce("_new", "median_pitch_hz").alias("median_pitch_hz"),
    )


def _here(session_id: str) -> Column:
    return F.col("session_id") == session_id


def renamed_speaker(speakers: DataFrame, session_id: str, speaker_id: int, name: str) -> DataFrame:
    return speakers.withColumn("name", F.when(_here(session_id) & (F.col("id") == speaker_id), name).otherwise(F.col("name")))


def remapped(segments: DataFrame, speakers: DataFrame, merges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Segments and speakers after merges ``(session_id, from_id, to_id)``; chains are followed first."""
    alias = resolved_aliases(merges).where("from_id <> to_id")
    tagged = segments.join(alias.withColumnRenamed("from_id", "speaker_id"), ["session_id", "speaker_id"], "left")
    tagged = tagged.withColumn("speaker_id", F.coalesce("to_id", "speaker_id")).select(segments.columns)
    gone = alias.select("session_id", F.col("from_id").alias("id"))
    return tagged, speakers.join(gone, ["session_id", "id"], "left_anti")


def resolved_aliases(merges: DataFrame) -> DataFrame:
    """Each merged speaker with the one that remains: ``session_id, from_id, to_id``.

    Of several merges of one speaker the last by ``seq`` counts or, without such a column, the one
    into the least id. Merges in a circle make all of it its least id. The chain is
    followed inside the session's map of merges.
    """
    last = F.max_by("to_id", F.struct("seq", -F.col("to_id"))) if "seq" in merges.columns else F.min("to_id")
    single = merges.groupBy("session_id", "from_id").agg(last.alias("to_id"))
    maps = single.groupBy("session_id").agg(F.map_from_entries(F.collect_list(F.struct("from_id", "to_id"))).alias("_m"))
    rows = maps.select("session_id", "_m", F.explode(F.map_keys("_m")).alias("from_id"))
    steps = F.sequence(F.lit(1), F.size("_m"))
    follow = lambda x: F.coalesce(F.try_element_at("_m", x), x)
    end = F.aggregate(steps, F.col("from_id"), lambda x, _: follow(x))
    # As many steps again go round a circle, or stay at the end of a chain.
    least = F.aggregate(steps, F.struct(end.alias("at"), end.alias("least")), lambda s, _: F.struct(follow(s["at"]).alias("at"), F.least(s["least"], follow(s["at"])).alias("least")))
    return rows.select("session_id", "from_id", least["least"].alias("to_id"))


def assigned(segments: DataFrame, speakers: DataFrame, session_id: str, seg_id: str, speaker_id: int | None) -> tuple[DataFrame, DataFrame]:
    """One segment goes to a speaker; None makes a new one, a number above all others."""
    hit = _here(session_id) & (F.col("seg_id") == seg_id)
    if speaker_id is not None:
        return segments.withColumn("speaker_id", F.when(hit, speaker_id).otherwise(F.col("speaker_id"))), speakers
    new = speakers.where(_here(session_id)).agg(F.coalesce(F.max("id") + 1, F.lit(0)).alias("id")).withColumns(
        {"session_id": F.lit(session_id), "median_pitch_hz": F.lit(0.0)}
    )
    tagged = segments.join(F.broadcast(new.select(F.col("id").alias("_new")))).withColumn(
        "speaker_id", F.when(hit, F.col("_new")).otherwise(F.col("speaker_id"))
    )
    return tagged.select(segments.columns), ensured_speakers(speakers, new.select("session_id", "id", "median_pitch_hz"))


def other_speakers(speakers: DataFrame, speaker_id: int) -> DataFrame:
    return speakers.where(F.col("id") != speaker_id)


def next_speaker(speakers: DataFrame) -> DataFrame:
    return speakers.groupBy("session_id").agg((F.max("id") + 1).alias("next_id"))


def stats(segments: DataFrame) -> DataFrame:
    """Words and length of each session's final segments."""
    final = segments.where(~F.coalesce(F.col("interim"), F.lit(False)))
    return final.groupBy("session_id").agg(
        F.sum(F.size(X.words(F.col("text")))).alias("n_words"), F.coalesce(F.max("end_s"), F.lit(0.0)).alias("length_s"),
        F.count("*").alias("n_segments"), F.count_distinct("speaker_id").alias("n_speakers"),
    )


def named(rows: DataFrame, speakers: DataFrame, default: str = "Unknown speaker", speaker: str = "speaker_id") -> DataFrame:
    """``rows`` with ``speaker_name``."""
    names = speakers.select("session_id", F.col("id").alias(speaker), F.col("name").alias("speaker_name"))
    return rows.join(names, ["session_id", speaker], "left").withColumn("speaker_name", F.coalesce("speaker_name", F.lit(default)))


def saved_draft(drafts: DataFrame, segments: DataFrame, speakers: DataFrame, now_ms: int, keep: int = DRAFTS_KEPT) -> DataFrame:
    """``drafts`` and a snapshot of each session that has final segments, the newest ``keep`` of all."""
    final = segments.where(~F.coalesce(F.col("interim"), F.lit(False)))
    fields = ("seg_id", "seg_ord", "speaker_id", "text", "start_s", "end_s")
    texts = final.groupBy("session_id").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("seg_ord", F.struct(*fields).alias("row")))), lambda x: x["row"]).alias("segments")
    )
    people = speakers.groupBy("session_id").agg(F.array_sort(F.collect_list(F.struct("id", "name", "color", "median_pitch_hz"))).alias("speakers"))
    ms = F.lit(now_ms).cast("long")
    new = texts.join(people, "session_id", "left").select(
        F.concat(X.draft_id(ms), F.lit("-"), F.col("session_id")).alias("id"), draft_name(ms).alias("name"), ms.alias("saved_at"), "segments", "speakers"
    )
    return newest(drafts.unionByName(new.select(drafts.columns)), keep)


def draft_name(saved_ms: Column) -> Column:
    return F.concat(F.lit("Draft — "), F.date_format(F.timestamp_millis(saved_ms), "MMM d, h:mm a"))


def newest(rows: DataFrame, keep: int = DRAFTS_KEPT, at: str = "saved_at", tie: str = "id") -> DataFrame:
    return rows.orderBy(F.desc(at), tie).limit(keep)


def loaded_draft(drafts: DataFrame, draft_id: str) -> tuple[DataFrame, DataFrame]:
    """A draft's segments and speakers as tables; empty if there is none of that id."""
    own = drafts.where(F.col("id") == draft_id)
    segments = own.select(F.col("id").alias("session_id"), F.explode("segments").alias("s")).select("session_id", "s.*", F.lit(False).alias("interim"))
    return segments, own.select(F.col("id").alias("session_id"), F.explode("speakers").alias("p")).select("session_id", "p.*")


def deleted_draft(drafts: DataFrame, draft_id: str) -> DataFrame:
    return drafts.where(F.col("id") != draft_id)


def renamed_draft(drafts: DataFrame, draft_id: str, name: str) -> DataFrame:
    return drafts.withColumn("name", F.when(F.col("id") == draft_id, name).otherwise(F.col("name")))


def with_state(state: DataFrame, changes: DataFrame) -> DataFrame:
    """Single values of sessions ``(session_id, name, value, seq)``, such as mode, error, status and progress.

    The newest value of a name counts; a null one changes nothing, so progress without a status leaves the status.
    """
    both = state.unionByName(changes.where(F.col("value").isNotNull()))
    return both.groupBy("session_id", "name").agg(F.max_by("value", "seq").alias("value"), F.max("seq").alias("seq"))


def written_sessions(table: DataFrame, path: str, gone: DataFrame | None = None) -> int:
    """Overwrite the sessions in ``table``, and delete those in ``gone``, in the session table at ``path``; other sessions stay.

    All of it happens or nothing, see :class:`colloquy.sources.sessions.SessionTable`. Returns the version's number.
    """
    return SessionTable(table.sparkSession, path).overwrite(table, gone)


def read_sessions(spark: SparkSession, path: str, sessions: list[str] | None = None) -> DataFrame:
    """The session table at ``path``, or some of its sessions, whose buckets alone are read."""
    return SessionTable(spark, path).read(sessions)
