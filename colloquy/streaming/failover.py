"""Two speech engines on one stream: a watchdog by voice, failover, restarts, and late results.

The primary recognizer's results, its errors and ends, levels of the microphone and the fallback engine's
texts are inputs of one processor by session. Its timers are in event time and every deadline is
also looked at before each input, so the outcome doesn't depend on how inputs fall into
batches, and a replay gives the same rows.

- *Watchdog*: when somebody spoke in the last 5 s and the recognizer said nothing for more than 8 s, the next
  tick of 4 s kicks it. Silence kicks nothing and registers no timer. A kick opens the switch: when 12 s have
  passed without a result, and there is still voice, the fallback engine takes over.
- *Failover*: errors of access or network take over at once. A result of the primary engine ends the fallback;
  each such recovery begins a new epoch. Fallback texts of an epoch before, or without a switch, are dropped.
  Those that come while the switch is open wait in a queue, which the takeover releases and a recovery drops.
- *Restarts*: a recognizer that ended starts again after 50 ms, twice as long each time up to 3 s, and not before
  the cooldown of a refused access, 5 s and twice as long each time up to 30 s; a result resets both.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from colloquy.streaming.live import by_session

#: Milliseconds and levels. Fixed values.
STALL_MS, TICK_MS, VOICE_MS, FALLBACK_MS, VOICE_LEVEL = 8_000, 4_000, 5_000, 12_000, 0.06
BACKOFF_MS, BACKOFF_MOST_MS, COOLDOWN_MS, COOLDOWN_MOST_MS = 50, 3_000, 5_000, 30_000
#: Texts that wait while a switch is open: 12 s of chunks of 6 s are two; more than this means that nothing drains them.
QUEUED = 64

#: kind: start, level (level), interim, final (text), error (text: its code), ended, fallback (text, epoch) or stop.
INPUT = "session_id string, seq bigint, ts timestamp, kind string, text string, level double, epoch int"
#: op: kick, restart, engine (engine, epoch: which one speaks from here on), text (engine, text), error (text), promote or late (text).
OUTPUT = "session_id string, time_ms bigint, op string, engine string, epoch int, text string"


class Watch:
    """State of one session's engines and its transitions."""

    def __init__(self, state: str | None = None, timers: dict[str, int] | None = None, queue: list[str] | None = None):
        d = json.loads(state) if state else {}
        self.running, self.active, self.open = d.get("running", False), d.get("active", False), d.get("open", False)
        self.epoch, self.attempts, self.failures = d.get("epoch", 0), d.get("attempts", 0), d.get("failures", 0)
        self.began, self.now, self.heard = d.get("began", 0), d.get("now", 0), d.get("heard", 0)
        #: When the recognizer last did something or was kicked, last gave a result, and may start again.
        self.activity, self.caption, self.cooldown = d.get("activity", 0), d.get("caption", 0), d.get("cooldown", 0)
        self.timers, self.queue = timers or {}, queue or []

    def state(self) -> str:
        return json.dumps({k: v for k, v in vars(self).items() if k not in ("timers", "queue")})

    def _tick(self, at: int) -> int:
        """The first tick after ``at``."""
        return self.began + ((at - self.began) // TICK_MS + 1) * TICK_MS

    def _row(self, op: str, at: int, text: str | None = None, engine: str | None = None) -> dict:
        return {"time_ms": at, "op": op, "engine": engine, "epoch": self.epoch, "text": text}

    def advance(self, until: int) -> Iterator[dict]:
        """What the deadlines up to ``until`` bring about, in their order."""
        while self.timers:
            name, at = min(self.timers.items(), key=lambda x: (x[1], x[0]))
            if at > until:
                return
            del self.timers[name]
            self.now = max(self.now, at)
            voiced = at - self.heard < VOICE_MS
            if name == "stall" and voiced and at - self.activity > STALL_MS:
                self.activity, self.open = at, self.open or not self.active
                yield self._row("kick", at)
                if not self.active:
                    self.timers["takeover"] = max(self.caption + FALLBACK_MS, at) + 1
                self._watch()
            elif name == "takeover" and not self.active:
                if voiced:
                    yield from self._fallback(at)
                else:  # nobody speaks any more: the next kick opens the switch again
                    self.open, self.queue = False, []
            elif name == "restart":
                yield self._row("restart", at)

    def _watch(self) -> None:
        """Look again at the tick after the recognizer has been mute for long enough, if there is voice by then."""
        if self.running:
            self.timers["stall"] = self._tick(max(self.activity + STALL_MS, self.heard))

    def _fallback(self, at: int) -> Iterator[dict]:
        self.timers.pop("takeover", None)
        if self.active:
            return
        self.active, self.open = True, False
        yield self._row("engine", at, engine="fallback")
        for text in self.queue:
            yield self._row("text", at, text, "fallback")
        self.queue = []

    def _recovered(self, at: int) -> Iterator[dict]:
        self.activity = self.caption = at
        self.attempts = self.failures = self.cooldown = 0
        self.open, self.queue = False, []
        self.timers.pop("takeover", None)
        self.timers.pop("stall", None)
        if at - self.heard < VOICE_MS:
            self._watch()
        if self.active:
            self.active, self.epoch = False, self.epoch + 1
            yield self._row("engine", at, engine="primary")

    def feed(self, kind: str, at: int, text: str | None, level: float, epoch: int | None) -> Iterator[dict]:
        """What one input brings about. An input from before the newest one counts at the newest one's time."""
        at = max(at, self.now)
        yield from self.advance(at)
        self.now, text = at, (text or "").strip()
        if kind == "start":
            self.__init__()
            self.running, self.began, self.now = True, at, at
            self.activity = self.caption = at
            self.heard = at - VOICE_MS
            yield self._row("engine", at, engine="primary")
        elif not self.running:
            if kind in ("fallback", "final") and text:
                yield self._row("late", at, text, "fallback" if kind == "fallback" else "primary")
        elif kind == "level" and level > VOICE_LEVEL:
            self.heard = at
            if "stall" not in self.timers:
                self._watch()
        elif kind in ("interim", "final"):
            yield from self._recovered(at)
            if text and kind == "final":
                yield self._row("text", at, text, "primary")
        elif kind == "error":
            if text in ("not-allowed", "service-not-allowed"):
                self.failures += 1
                self.cooldown = at + min(COOLDOWN_MS * 2 ** (self.failures - 1), COOLDOWN_MOST_MS)
                yield from self._fallback(at)
            elif text == "network":
                yield from self._fallback(at)
            elif text not in ("no-speech", "aborted"):
                yield self._row("error", at, text)
        elif kind == "ended":
            yield self._row("promote", at)
            self.timers["restart"] = max(at + min(BACKOFF_MS * 2 ** min(self.attempts, 16), BACKOFF_MOST_MS), self.cooldown)
            self.attempts += 1
        elif kind == "fallback" and text:
            if epoch is not None and epoch < self.epoch or not (self.active or self.open):
                yield self._row("late", at, text, "fallback")
            elif self.active:
                yield self._row("text", at, text, "fallback")
            else:
                self.queue = (self.queue + [text])[-QUEUED:]
        elif kind == "stop":
            self.running, self.active, self.open, self.timers, self.queue = False, False, False, {}, []


_COLUMNS = [field.split()[0] for field in OUTPUT.split(", ")]


def _fed(watch: Watch, key: str, rows: pd.DataFrame) -> pd.DataFrame:
    out = []
    for r in rows.sort_values(["time_ms", "seq"], kind="stable").itertuples(index=False):
        missing = lambda x: x is None or x != x
        level, epoch = 0.0 if missing(r.level) else float(r.level), None if missing(r.epoch) else int(r.epoch)
        out += watch.feed(r.kind, int(r.time_ms), r.text if isinstance(r.text, str) else None, level, epoch)
    return _frame(key, out)


def _frame(key: str, out: list[dict]) -> pd.DataFrame:
    frame = pd.DataFrame([{"session_id": key} | r for r in out], columns=_COLUMNS).astype(object)
    return frame.where(frame.notna(), None)


class Processor(StatefulProcessor):
    """:class:`Watch` in a state store: its scalars as one value, its deadlines by name as a map, what waits as a list."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.value = handle.getValueState("watch", "state string")
        self.due = handle.getMapState("due", "name string", "at bigint")
        self.waiting = handle.getListState("waiting", "text string")

    def _load(self) -> Watch:
        return Watch(
            self.value.get()[0] if self.value.exists() else None,
            {k[0]: v[0] for k, v in self.due.iterator()} if self.due.exists() else {},
            [x[0] for x in self.waiting.get()] if self.waiting.exists() else [],
        )

    def _save(self, watch: Watch) -> None:
        """Deadlines are one timer each; the map tells which of them a timer was for."""
        timers = set(self.handle.listTimers())
        for at in timers - set(watch.timers.values()):
            self.handle.deleteTimer(at)
        for at in set(watch.timers.values()) - timers:
            self.handle.registerTimer(at)
        self.due.clear()
        self.waiting.clear()
        if not watch.running:
            self.value.clear()
            return
        self.value.update((watch.state(),))
        for name, at in watch.timers.items():
            self.due.updateValue((name,), (at,))
        if watch.queue:
            self.waiting.put([(x,) for x in watch.queue])

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        watch = self._load()
        out = _fed(watch, key[0], pd.concat(list(rows), ignore_index=True))
        self._save(watch)
        yield out

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        watch = self._load()
        out = list(watch.advance(expiredTimerInfo.getExpiryTimeInMs()))
        self._save(watch)
        yield _frame(key[0], out)

    def close(self) -> None:
        pass


def switched_stream(inputs: DataFrame, delay: str = "1 second") -> DataFrame:
    """:data:`OUTPUT` rows of a stream of :data:`INPUT`; what comes later than ``delay`` after newer inputs is dropped.

    Needs the RocksDB state store provider. After a stop nothing of a session stays in the store.
    """
    timed = inputs.withColumn("time_ms", F.unix_millis("ts"))  # as timers count, in whatever time zone the session is
    return timed.withWatermark("ts", delay).groupBy("session_id").transformWithStateInPandas(Processor(), OUTPUT, "Update", "EventTime")


def switched(inputs: DataFrame) -> DataFrame:
    """The same of a table of inputs: deadlines up to each session's last input. Of a session its state is held, and one batch."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for start, key, rows in by_session(batches):
            watch = Watch() if start else watch
            yield _fed(watch, key, rows)

    timed = inputs.withColumn("time_ms", F.unix_millis("ts"))
    return timed.repartition("session_id").sortWithinPartitions("session_id", "ts", "seq").mapInPandas(run, OUTPUT)


def utterances(changes: DataFrame) -> DataFrame:
    """Texts of either engine as final inputs of ``streaming.live``: ``live.INPUT`` rows."""
    none = F.lit(None).cast("double")
    return changes.where(F.col("op") == "text").select(
        "session_id", (F.col("time_ms") * 1000).alias("seq"), F.lit("final").alias("kind"), (F.col("time_ms") / 1000).alias("time_s"), "text",
        none.alias("pitch_hz"), none.alias("centroid_hz"),
    )
