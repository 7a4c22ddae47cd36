"""Live sessions: captions that never shrink, utterances with speakers, and retractions, as a keyed stream.

Inputs of a session, in order of ``seq``: a start mark, voice frames, recognizer results
and an end mark. One processor holds a session's state, puts what a batch brings in
order, and emits change rows, which a sink applies to the table of segments. The state goes at the
session's end, or when nothing has come for a while. A later batch pass replaces the session.

Where a live device would drop audio while its model is busy, a stream here reads less at a time
(``maxFilesPerTrigger``, see ``readers.recognizer_events``): it falls behind, but loses nothing.
"""

from __future__ import annotations

import json
import time
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQueryListener

from colloquy.operators.cluster import Voices
from colloquy.sources.sessions import bucket

#: Words at the live edge that may still change; frames held between utterances. Fixed values.
OPEN_WORDS, FRAMES_HELD = 1, 600
#: Milliseconds without an input after which a session with open words is kicked (a fixed value), and after which it ends.
KICK_MS, IDLE_MS = 8_000, 600_000
INTERIM_ID = "live-interim"
#: Folders of raw recordings, and parts of one level that are merged into one of the next.
RECORD_BUCKETS, MERGED = 16, 8

#: kind: start, frame, interim, final or end. Frames have pitch and timbre, results have text.
INPUT = "session_id string, seq bigint, kind string, time_s double, text string, pitch_hz double, centroid_hz double"
#: op: upsert, delete, retag (from_id, to_id), speaker (speaker_id, pitch_hz) or kick (the recognizer should be started again).
OUTPUT = (
    "session_id string, seq bigint, op string, seg_id string, speaker_id int, text string, "
    "start_s double, end_s double, interim boolean, from_id int, to_id int, pitch_hz double"
)


class Caption:
    """Shown words: all but the last are locked, and what was shown is never taken back."""

    def __init__(self, locked: list[str] | None = None, shown: list[str] | None = None):
        self.locked, self.shown = locked or [], shown or []

    def update(self, text: str) -> str:
        words = text.split()
        self.locked += words[len(self.locked) : max(len(self.locked), len(words) - OPEN_WORDS)]
        candidate = self.locked + words[len(self.locked) :]
        if len(candidate) >= len(self.shown):
            self.shown = candidate
        return " ".join(self.shown)

    def finalize(self, text: str) -> str:
        """Shown words stay; a final text adds the words beyond them."""
        base = max(self.shown, self.locked, key=len)
        whole = base + text.split()[len(base) :]
        self.locked, self.shown = [], []
        return " ".join(whole)


class Session:
    """State of one live session and its transitions; small enough for one JSON value."""

    def __init__(self, state: str | None = None):
        d = json.loads(state) if state else {}
        self.caption = Caption(d.get("locked"), d.get("shown"))
        self.voices = Voices(d.get("voices"))
        self.frames: list[list[float]] = d.get("frames", [])
        self.start, self.last, self.count = d.get("start", 0.0), d.get("last", -1), d.get("count", 0)
        #: Place and time of the last input, and when it came.
        self.seq, self.time_s, self.touched = d.get("seq", 0), d.get("time_s", 0.0), d.get("touched", 0)
        self.ended = False

    def state(self) -> str:
        return json.dumps(
            {
                "locked": self.caption.locked, "shown": self.caption.shown, "voices": self.voices.state(),
                "frames": self.frames, "start": self.start, "last": self.last, "count": self.count,
                "seq": self.seq, "time_s": self.time_s, "touched": self.touched,
            }
        )

    def feed(self, kind: str, time_s: float, text: str | None, pitch: float, timbre: float) -> Iterator[dict]:
        """Changes that one input makes."""
        text = (text or "").strip()
        self.ended = kind == "end"
        if kind == "start":  # all state is new; segments that there were stay
            count = self.count
            self.__init__()
            self.count = count
        elif kind == "frame":
            self.frames = (self.frames + [[pitch, timbre]])[-FRAMES_HELD:]
        elif kind == "interim" and text:
            shown = self.caption.update(text)
            yield {"op": "upsert", "seg_id": INTERIM_ID, "speaker_id": self.last, "text": shown, "start_s": self.start, "end_s": time_s, "interim": True}
        elif kind == "final" and text:
            yield from self._utterance(self.caption.finalize(text), time_s)
        elif kind == "end":
            text = " ".join(self.caption.shown)
            self.caption = Caption()
            yield from self._utterance(text, time_s)
            yield {"op": "delete", "seg_id": INTERIM_ID}

    def _utterance(self, text: str, time_s: float) -> Iterator[dict]:
        if not text:
            return
        heard = np.array(self.frames, float).reshape(-1, 2)
        self.frames, self.voices.merged = [], []
        match = self.voices.classify(heard[:, 0], heard[:, 1])
        for gone, stays in self.voices.merged:
            yield {"op": "retag", "from_id": gone, "to_id": stays}
            if self.last == gone:
                self.last = stays
        if match:
            self.last = match[0]
            yield {"op": "speaker", "speaker_id": match[0], "pitch_hz": match[1]}
        yield {
            "op": "upsert", "seg_id": f"live-{self.count}", "speaker_id": self.last, "text": text[:1].upper() + text[1:],
            "start_s": self.start, "end_s": time_s, "interim": False,
        }
        self.count, self.start = self.count + 1, time_s
        yield {"op": "delete", "seg_id": INTERIM_ID}


_COLUMNS = [field.split()[0] for field in OUTPUT.split(", ")]


def _changes(session: Session, key: str, rows: pd.DataFrame) -> pd.DataFrame:
    out = []
    for r in rows.sort_values("seq", kind="stable").itertuples(index=False):
        number = lambda x: 0.0 if x is None or x != x else float(x)
        text = r.text if isinstance(r.text, str) else None
        for change in session.feed(r.kind, number(r.time_s), text, number(r.pitch_hz), number(r.centroid_hz)):
            out.append({"session_id": key, "seq": r.seq} | change)
        session.seq, session.time_s = int(r.seq), number(r.time_s)
    return _frame(out)


def _frame(rows: list[dict]) -> pd.DataFrame:
    frame = pd.DataFrame(rows, columns=_COLUMNS).astype(object)
    return frame.where(frame.notna(), None)


class Processor(StatefulProcessor):
    """The session's state as one value, and two timers that every input sets anew.

    When the first one is due and words are open, the recognizer should be started again; when the
    second one is, the open words become an utterance and the session ends. At its end
    nothing of a session stays in the store. Without timers, only end marks end sessions.
    """

    def __init__(self, timers: bool = True, kick_ms: int = KICK_MS, idle_ms: int = IDLE_MS):
        self.timers, self.kick_ms, self.idle_ms = timers, kick_ms, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.value = handle.getValueState("session", "state string")

    def _stop(self) -> None:
        for due in list(self.handle.listTimers()) if self.timers else ():
            self.handle.deleteTimer(due)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        session = Session(self.value.get()[0] if self.value.exists() else None)
        out = _changes(session, key[0], pd.concat(list(rows), ignore_index=True))
        self._stop()
        if session.ended:
            self.value.clear()
        else:
            if self.timers:
                session.touched = timerValues.getCurrentProcessingTimeInMs()
                self.handle.registerTimer(session.touched + self.kick_ms)
                self.handle.registerTimer(session.touched + self.idle_ms)
            self.value.update((session.state(),))
        yield out

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if not self.value.exists():
            return
        session = Session(self.value.get()[0])
        if expiredTimerInfo.getExpiryTimeInMs() < session.touched + self.idle_ms:
            rows = [{"op": "kick"}] if session.caption.shown else []
        else:
            rows = list(session.feed("end", session.time_s, None, 0.0, 0.0))
            self.value.clear()
        yield _frame([{"session_id": key[0], "seq": session.seq + 1} | r for r in rows])

    def close(self) -> None:
        pass


def changes_stream(inputs: DataFrame, timers: bool = True, kick_ms: int = KICK_MS, idle_ms: int = IDLE_MS) -> DataFrame:
    """Change rows of a stream of inputs. The session needs the RocksDB state store provider.

    With timers a query runs batches as long as it lives, so it takes a trigger by processing
    time; a run over what is there (``availableNow``) takes none.
    """
    mode = "ProcessingTime" if timers else "None"
    return inputs.groupBy("session_id").transformWithStateInPandas(Processor(timers, kick_ms, idle_ms), OUTPUT, "Update", mode)


def changes(inputs: DataFrame) -> DataFrame:
    """Change rows of a table of inputs, the same as of a stream of them.

    Inputs are dealt by session once and pass in order; of a session its state is held, and one batch of inputs.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for start, key, rows in by_session(batches):
            session = Session() if start else session
            yield _changes(session, key, rows)

    return inputs.repartition("session_id").sortWithinPartitions("session_id", "seq").mapInPandas(run, OUTPUT)


def by_session(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[bool, str | None, pd.DataFrame]]:
    """Runs of one session's rows in batches that are sorted by session: whether it begins there, its id, the rows."""
    last = object()
    for b in batches:
        ids = b["session_id"].tolist()
        cuts = [0, *(i for i in range(1, len(ids)) if ids[i] != ids[i - 1]), len(ids)]
        for lo, hi in zip(cuts, cuts[1:]):
            if hi > lo:
                yield ids[lo] != last, ids[lo], b.iloc[lo:hi]
                last = ids[lo]


def segments(changed: DataFrame) -> DataFrame:
    """``schemas.SEGMENTS`` that change rows lead to: the last change of each segment, speakers after all merges."""
    from colloquy.operators.store import resolved_aliases

    marks = changed.where(F.col("op").isin("upsert", "delete"))
    # Within one input, a segment's upsert comes before the interim row's delete.
    last = marks.groupBy("session_id", "seg_id").agg(
        F.max_by(F.struct("op", "speaker_id", "text", "start_s", "end_s", "interim"), F.struct("seq", (F.col("op") == "delete"))).alias("x"),
        F.min("seq").alias("_first"),
    )
    rows = last.where("x.op = 'upsert'").select("session_id", "seg_id", "_first", "x.*")
    alias = resolved_aliases(changed.where(F.col("op") == "retag").select("session_id", "from_id", "to_id"))
    rows = rows.join(alias.withColumnRenamed("from_id", "speaker_id"), ["session_id", "speaker_id"], "left")
    order = F.row_number().over(Window.partitionBy("session_id").orderBy("_first", "seg_id")) - 1
    return rows.select(
        "session_id", "seg_id", order.cast("bigint").alias("seg_ord"), F.coalesce("to_id", "speaker_id").alias("speaker_id"),
        "text", "start_s", "end_s", "interim",
    )


def inputs(events: DataFrame, frames: DataFrame) -> DataFrame:
    """Recognizer events and voice frames, streams or tables, as inputs; no window and no aggregation.

    ``events`` has the columns of ``schemas.EVENTS`` and ``time_s``, seconds in the session; ``frames`` those of
    ``schemas.FRAMES``. Each final result is an input; the interim ones of an event are one,
    as they are shown together. ``seq`` is made of microseconds, the event and the result's place,
    frames first, so it orders a session's inputs by itself.
    """
    from colloquy.functions import text as X

    micros = F.round(F.col("time_s") * 1_000_000).cast("long")
    new = F.filter(F.transform("results", lambda r, i: F.struct(i.alias("pos"), F.coalesce(r["is_final"], F.lit(False)).alias("final"), X.trim(r["transcript"]).alias("text"))),
                   lambda r: (r["pos"] >= F.col("result_index")) & (F.length(r["text"]) > 0))
    final = F.filter("_new", lambda r: r["final"])
    open_ = F.filter("_new", lambda r: ~r["final"])
    shown = F.when(F.size(open_) > 0, F.array(F.struct(F.lit(4095).alias("pos"), F.lit(False).alias("final"), F.array_join(F.transform(open_, lambda r: r["text"]), " ").alias("text"))))
    rows = events.withColumn("_new", new).withColumn("r", F.explode(F.concat(final, F.coalesce(shown, F.array().cast("array<struct<pos: int, final: boolean, text: string>>")))))
    place = micros * (1 << 23) + F.col("seq").bitwiseAND(2047) * 4096 + F.least(F.col("r.pos") + 1, F.lit(4095))
    none = F.lit(None)
    spoken = rows.select(
        "session_id", place.alias("seq"), F.when(F.col("r.final"), "final").otherwise("interim").alias("kind"), "time_s", F.col("r.text").alias("text"),
        none.cast("double").alias("pitch_hz"), none.cast("double").alias("centroid_hz"),
    )
    heard = frames.select("session_id", (micros * (1 << 23)).alias("seq"), F.lit("frame").alias("kind"), "time_s", none.cast("string").alias("text"), "pitch_hz", "centroid_hz")
    return spoken.unionByName(heard)


def compacted(changed: DataFrame) -> DataFrame:
    """The change rows that still say something: of each segment the first and the last, all retags, each speaker's last pitch."""
    marks = changed.where(F.col("op").isin("upsert", "delete"))
    by = Window.partitionBy("session_id", "seg_id")
    order = lambda way: F.row_number().over(by.orderBy(way("seq"), way(F.col("op") == "delete")))
    ends = marks.withColumns({"_a": order(F.asc), "_b": order(lambda c: F.desc(c))}).where("_a = 1 or _b = 1").drop("_a", "_b")
    pitch = Window.partitionBy("session_id", "speaker_id").orderBy(F.desc("seq"))
    speakers = changed.where("op = 'speaker'").withColumn("_n", F.row_number().over(pitch)).where("_n = 1").drop("_n")
    return ends.unionByName(changed.where("op = 'retag'").distinct()).unionByName(speakers)


def upsert_sink(path: str, every: int = MERGED):
    """A ``foreachBatch`` function that writes change rows by batch; a batch that runs again overwrites its own.

    Parts are kept in levels. Whenever ``every`` parts of one level are there, they are compacted into one part of the next,
    so a row is written again once a level: the logarithm of the number of batches times in all, and no
    batch waits for all history. 0 merges nothing. A part's name is its batch number, or a negative number made of its level and
    the last batch in it. The parts behind a new one go afterwards, so a failure in between leaves rows twice,
    which changes nothing.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")
        if not every:
            return
        spark = batch.sparkSession
        folder = spark._jvm.org.apache.hadoop.fs.Path(path)
        fs = folder.getFileSystem(spark._jsc.hadoopConfiguration())
        names = (status.getPath().getName() for status in fs.listStatus(folder))
        levels: dict[int, list[int]] = {}
        for number in sorted((int(n[6:]) for n in names if n.startswith("batch=")), key=_part_end):
            levels.setdefault(_part_level(number), []).append(number)
        level = 0
        while len(parts := levels.get(level, [])) >= every:
            level += 1
            merged = -(_part_end(parts[-1]) * LEVELS + level)
            rows = spark.read.schema(OUTPUT).parquet(*(f"{path}/batch={n}" for n in parts))
            compacted(rows).write.mode("overwrite").parquet(f"{path}/batch={merged}")
            for n in parts:
                fs.delete(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/batch={n}"), True)
            levels.setdefault(level, []).append(merged)

    return write


#: More levels than parts of any number can have.
LEVELS = 64


def _part_level(number: int) -> int:
    return 0 if number >= 0 else -number % LEVELS


def _part_end(number: int) -> int:
    """The last batch in a part."""
    return number if number >= 0 else -number // LEVELS


def change_table(spark: SparkSession, path: str) -> DataFrame:
    """What :func:`upsert_sink` has written, with ``batch``."""
    return spark.read.schema(f"{OUTPUT}, batch bigint").parquet(path)


def recorded(buffers: DataFrame, path: str, checkpoint: str, flush: str = "10 seconds", buckets: int = RECORD_BUCKETS):
    """Start writing a stream of raw audio buffers ``(session_id, buf_ord, pcm)`` as it comes, in files by a hash of the session.

    A flush writes ``buckets`` folders' files at most, however many sessions speak. What was flushed stays, however
    the query stops; :func:`recording` reads it back for :func:`readers.pcm_batches` and the batch pass.
    """
    rows = buffers.withColumn("bucket", bucket(F.col("session_id"), buckets)).repartition(buckets, "bucket")
    writer = rows.writeStream.format("parquet").outputMode("append").partitionBy("bucket")
    return writer.option("path", path).option("checkpointLocation", checkpoint).trigger(processingTime=flush).start()


def recording(spark: SparkSession, path: str, session_id: str | None = None, buckets: int = RECORD_BUCKETS) -> DataFrame:
    """What :func:`recorded` has written, or one session of it, of which only the session's folder is read."""
    rows = spark.read.parquet(path)
    if session_id is not None:
        own = spark.range(1).select(bucket(F.lit(session_id), buckets)).first()[0]
        rows = rows.where((F.col("bucket") == own) & (F.col("session_id") == session_id))
    return rows.drop("bucket")


def analysis_sink(path: str):
    """A ``foreachBatch`` function that analyses the segments which a batch of change rows has made or changed.

    A trigger's interval is the delay in which further changes of a segment count as one: only its
    last text of the batch is looked at. A part holds the suggestions of its batch; those of the
    newest batch that has a segment are the segment's.
    """
    from colloquy.operators import detect

    def write(batch: DataFrame, batch_id: int) -> None:
        last = F.max_by(F.struct("op", "text", "interim"), "seq").alias("x")
        new = batch.where(F.col("op") == "upsert").groupBy("session_id", "seg_id").agg(last, F.max("seq").alias("seg_ord"))
        rows = new.select("session_id", "seg_id", "seg_ord", "x.text", "x.interim")
        detect.suggestions(rows).write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return write


class Progress(StreamingQueryListener):
    """What streams report: for each query its status, batches, rows, and seconds since its start."""

    def __init__(self):
        self.queries: dict[str, dict] = {}

    def onQueryStarted(self, event) -> None:
        self.queries[str(event.id)] = {"status": "started", "batches": 0, "rows": 0, "began": time.monotonic(), "elapsed_s": 0.0}

    def _seen(self, query_id, **values) -> None:
        own = self.queries.get(str(query_id))
        if own is not None:
            own.update(values, elapsed_s=time.monotonic() - own["began"])

    def onQueryProgress(self, event) -> None:
        own = self.queries.get(str(event.progress.id))
        if own is not None:
            self._seen(event.progress.id, status="running", batches=own["batches"] + 1, rows=own["rows"] + event.progress.numInputRows)

    def onQueryIdle(self, event) -> None:
        self._seen(event.id, status="idle")

    def onQueryTerminated(self, event) -> None:
        self._seen(event.id, status="failed" if event.exception else "stopped")
