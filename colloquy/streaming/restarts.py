"""Restart of a failed query from its checkpoint, after a growing pause."""

from __future__ import annotations

import threading
import time
from collections.abc import Callable

from pyspark.sql import SparkSession
from pyspark.sql.streaming import StreamingQueryListener
from pyspark.sql.streaming.query import StreamingQuery

from colloquy.streaming.failover import BACKOFF_MOST_MS, BACKOFF_MS, COOLDOWN_MOST_MS, COOLDOWN_MS


def pause_ms(attempts: int, refusals: int) -> int:
    """Pause before a restart: by the restarts since the last progress, and by how often access was refused in a row."""
    backoff = min(BACKOFF_MS * 2 ** min(attempts, 16), BACKOFF_MOST_MS)
    return max(backoff, min(COOLDOWN_MS * 2 ** min(refusals - 1, 16), COOLDOWN_MOST_MS) if refusals else 0)


def refused(error: str) -> bool:
    """Whether a failure is one of access, which takes the longer cooldown."""
    return any(word in error for word in ("AccessControlException", "AccessDenied", "PermissionError", "Permission denied"))


class Supervisor(StreamingQueryListener):
    """Keeps a query running: ``start`` starts it, always with the same checkpoint and sink.

    As the checkpoint tells where the failed run was, the next one takes its batch up again; with a sink that
    overwrites a batch that runs again no row is lost or doubled. Progress with rows resets the pauses. A query
    that ends by itself or by :meth:`stop` stays ended, and so does one that has failed ``most`` times in a row.
    """

    def __init__(self, spark: SparkSession, start: Callable[[], StreamingQuery], most: int | None = None, cooldown_if: Callable[[str], bool] = refused):
        self.spark, self._start, self.most, self._refused = spark, start, most, cooldown_if
        self.query: StreamingQuery | None = None
        #: Failures since the last progress, refusals among them in a row, all restarts, and the last failure.
        self.attempts = self.refusals = self.restarts = 0
        self.error: str | None = None
        self.ended = threading.Event()
        self._lock, self._stopped, self._timer = threading.Lock(), False, None

    def run(self) -> Supervisor:
        self.spark.streams.addListener(self)
        self._begin()
        return self

    def _begin(self) -> None:
        with self._lock:
            if self._stopped:
                return
            try:
                self.query = self._start()
            except Exception as error:  # a source that isn't there yet is a failure like others
                self._failed(str(error))

    def _failed(self, error: str) -> None:
        self.error = error
        if self._stopped or (self.most is not None and self.attempts >= self.most):
            self._finish()
            return
        self.refusals = self.refusals + 1 if self._refused(error) else 0
        pause = pause_ms(self.attempts, self.refusals)
        self.attempts += 1
        self.restarts += 1
        # In a thread of its own, as a listener must not start queries itself.
        self._timer = threading.Timer(pause / 1000, self._begin)
        self._timer.daemon = True
        self._timer.start()

    def _finish(self) -> None:
        self.ended.set()

    def _own(self, run_id) -> bool:
        return self.query is not None and str(run_id) == str(self.query.runId)

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        if self._own(event.progress.runId) and event.progress.numInputRows:
            self.attempts = self.refusals = 0

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        with self._lock:
            mine = self._own(event.runId)
        if mine and event.exception:
            self._failed(event.exception)
        elif mine:
            self._finish()

    def stop(self) -> None:
        """End the query and restart it no more."""
        with self._lock:
            self._stopped = True
        if self._timer is not None:
            self._timer.cancel()
        if self.query is not None:
            self.query.stop()
        self._finish()
        self.spark.streams.removeListener(self)

    def wait(self, seconds: float) -> bool:
        """Whether the query has ended for good within that time."""
        until = time.monotonic() + seconds
        return self.ended.wait(max(0.0, until - time.monotonic()))
