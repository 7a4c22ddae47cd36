"""Live audio and voice frames brought together with what they belong to, with bounded state."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.query import StreamingQuery

from colloquy.streaming.live import FRAMES_HELD, IDLE_MS

#: Seconds before an utterance's end in which its frames lie: what the frames that are held last for, at four a second.
HELD_S = FRAMES_HELD // 4


def utterance_frames_stream(utterances: DataFrame, frames: DataFrame, delay: str = "10 seconds", held_s: int = HELD_S) -> DataFrame:
    """Frames with the ``utt_ord`` of the utterance that they belong to: those after it started and up to its end.

    ``utterances`` has ``session_id, utt_ord, start_ts, end_ts``, ``frames`` has ``session_id, ts`` and more; both are streams. The join
    is by session and interval. Watermarks of ``delay`` on both sides let Spark forget an utterance when no frame
    of it can come any more, and a frame ``held_s`` seconds after it, as a live session holds no older ones either.
    What comes later than its side's watermark is left out; :func:`dropped_late` counts it.
    """
    ends = utterances.select(F.col("session_id").alias("_session"), "utt_ord", "start_ts", "end_ts").withWatermark("end_ts", delay)
    own = (
        (F.col("session_id") == F.col("_session")) & (F.col("ts") > F.col("start_ts")) & (F.col("ts") <= F.col("end_ts"))
        & (F.col("ts") >= F.col("end_ts") - F.expr(f"INTERVAL {held_s} SECONDS"))
    )
    return frames.withWatermark("ts", delay).join(ends, own).select(*frames.columns, "utt_ord")


def dropped_late(query: StreamingQuery) -> int:
    """Rows that a query's stateful operators have left out as too late, as far back as Spark keeps its progress."""
    return sum(op["numRowsDroppedByWatermark"] for p in query.recentProgress for op in p["stateOperators"])


BUFFERS = "session_id string, buf_ord bigint, pcm array<float>, last boolean"
BATCHES = "session_id string, batch bigint, pcm array<float>"


class Batches(StatefulProcessor):
    """Buffers of a session gathered into batches of ``per``, by their places.

    A batch goes out when all of its buffers have come, in whatever order and micro-batches. What is held
    are the buffers of batches that aren't whole. When the session's last buffer has come,
    and those before it, the rest goes out as a shorter batch; after ``idle_ms`` without a buffer, with holes.
    """

    def __init__(self, per: int, timers: bool, idle_ms: int):
        self.per, self.timers, self.idle_ms = per, timers, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getListState("held", "buf_ord bigint, pcm binary")
        #: The place of the last buffer, -1 while it isn't known, and of the first that didn't go out.
        self.end = handle.getValueState("end", "last bigint, next bigint")

    def _out(self, key, buffers: dict[int, bytes], rest: bool) -> tuple[dict[int, bytes], pd.DataFrame]:
        by: dict[int, list[int]] = {}
        for place in sorted(buffers):
            by.setdefault(place // self.per, []).append(place)
        whole = [n for n, own in by.items() if rest or len(own) == self.per]
        pcm = [np.frombuffer(b"".join(buffers[k] for k in by[n]), np.float32).tolist() for n in whole]
        left = {k: v for n, own in by.items() if n not in set(whole) for k, v in ((k, buffers[k]) for k in own)}
        out = pd.DataFrame({"session_id": [key[0]] * len(whole), "batch": whole, "pcm": pcm}, columns=["session_id", "batch", "pcm"]).astype(object)
        return left, out

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        buffers = {r[0]: r[1] for r in self.held.get()} if self.held.exists() else {}
        last, done = self.end.get() if self.end.exists() else (-1, 0)
        for frame in rows:
            for place, pcm, final in zip(frame["buf_ord"], frame["pcm"], frame["last"]):
                buffers[int(place)] = np.asarray([] if pcm is None else pcm, np.float32).tobytes()
                last = int(place) if final else last
        # Buffers count from 0, so all have come once as many are held or gone as the last one's place says.
        before = len(buffers)
        left, out = self._out(key, buffers, last >= 0 and done + before == last + 1)
        done += before - len(left)
        self._keep(left, last, done, timerValues)
        yield out

    def _keep(self, left: dict[int, bytes], last: int, done: int, timerValues) -> None:
        for due in list(self.handle.listTimers()) if self.timers else ():
            self.handle.deleteTimer(due)
        self.held.clear()
        if last >= 0 and done == last + 1:
            self.end.clear()
            return
        self.end.update((last, done))
        if left:
            self.held.put(list(left.items()))
        if self.timers:
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.idle_ms)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        buffers = {r[0]: r[1] for r in self.held.get()} if self.held.exists() else {}
        self.held.clear()
        self.end.clear()
        yield self._out(key, buffers, True)[1]

    def close(self) -> None:
        pass


def pcm_batches_stream(buffers: DataFrame, samples: int, buffer: int = 4096, timers: bool = True, idle_ms: int = IDLE_MS) -> DataFrame:
    """``readers.pcm_batches`` of a stream of :data:`BUFFERS`, whose places count from 0; ``last`` marks a session's end.

    Needs the RocksDB state store provider. With timers a query takes a trigger by processing time.
    """
    mode = "ProcessingTime" if timers else "None"
    rows = buffers.select("session_id", "buf_ord", "pcm", F.coalesce("last", F.lit(False)).alias("last"))
    return rows.groupBy("session_id").transformWithStateInPandas(Batches(-(-samples // buffer), timers, idle_ms), BATCHES, "Update", mode)
