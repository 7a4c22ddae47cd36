"""Failover, watchdog and restarts: transitions by hand, and a stream in many batches against the table."""

import datetime as dt
import random

from pyspark.sql import functions as F

from colloquy.streaming import failover as E

BEGAN = dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc)


def ts(s):
    return BEGAN + dt.timedelta(seconds=s)


def run(*inputs):
    """Rows of ``(second, kind, text or level or (text, epoch))`` as ``(second, op, engine, epoch, text)``."""
    watch, out = E.Watch(), []
    for s, kind, *rest in inputs:
        x = rest[0] if rest else None
        text, epoch = x if isinstance(x, tuple) else (x, None)
        out += watch.feed(kind, round(s * 1000), text if isinstance(text, str) else None, text if isinstance(text, float) else 0.0, epoch)
    return [(r["time_ms"] / 1000, r["op"], r["engine"], r["text"]) for r in out][1:], watch


def levels(*seconds, level=0.1):
    return [(s, "level", level) for s in seconds]


def test_silence_kicks_nothing():
    out, watch = run((0, "start"), *levels(*range(1, 60), level=0.06), (60, "level", 0.0))
    assert out == [] and watch.timers == {}


def test_voice_kicks_then_takes_over():
    out, _ = run((0, "start"), (2, "final", "hello"), *levels(*range(3, 18)))
    assert out == [(2, "text", "primary", "hello"), (12, "kick", None, None), (14.001, "engine", "fallback", None)]
    out, _ = run((0, "start"), (2, "final", "hello"), *levels(3, 4), (40, "level", 0.0))
    assert out == [(2, "text", "primary", "hello")]  # the voice was long ago when the recognizer had been mute for 8 s


def test_voice_stops_before_the_takeover():
    out, watch = run((0, "start"), (2, "final", "a"), *levels(4, 8, 8.9), (12.5, "fallback", "noise"), (30, "level", 0.0))
    assert out[1:] == [(12, "kick", None, None)] and not watch.active and not watch.open and not watch.queue


def test_queue_is_released_or_dropped():
    head = [(0, "start"), (1, "final", "one"), *levels(*range(2, 14))]
    out, _ = run(*head, (12.2, "fallback", "two"), (12.9, "fallback", "three"), (14, "level", 0.1), (15, "fallback", "four"))
    assert out[1:] == [(12, "kick", None, None), (13.001, "engine", "fallback", None), (13.001, "text", "fallback", "two"), (13.001, "text", "fallback", "three"), (15, "text", "fallback", "four")]
    out, _ = run(*head[:-1], (12.2, "fallback", "two"), (12.5, "final", "back"), (16, "fallback", "late"))
    assert out[1:] == [(12, "kick", None, None), (12.5, "text", "primary", "back"), (16, "late", "fallback", "late")]


def test_late_primary_result_and_old_epoch():
    """A late result of the primary engine ends the fallback; texts asked for before that are dropped."""
    out, watch = run((0, "start"), (1, "error", "network"), (3, "fallback", ("a", 0)), (4, "interim", "x"), (5, "fallback", ("b", 0)), (6, "error", "network"), (7, "fallback", ("c", 0)), (8, "fallback", ("d", 1)))
    assert out == [
        (1, "engine", "fallback", None), (3, "text", "fallback", "a"), (4, "engine", "primary", None), (5, "late", "fallback", "b"),
        (6, "engine", "fallback", None), (7, "late", "fallback", "c"), (8, "text", "fallback", "d"),
    ]
    assert watch.epoch == 1


def test_restarts_back_off_and_cool_down():
    ends = [(s, "ended") for s in (1, 2, 3, 4, 10, 20, 30, 40)]
    out, _ = run((0, "start"), *ends, (60, "level", 0.0))
    assert [round(s, 3) for s, op, *_ in out if op == "restart"] == [1.05, 2.1, 3.2, 4.4, 10.8, 21.6, 33, 43]
    out, _ = run((0, "start"), (1, "error", "not-allowed"), (1.1, "ended"), (7, "error", "not-allowed"), (7.1, "ended"), (20, "interim", ""), (21, "ended"), (22, "error", "aborted"), (23, "error", "odd"), (24, "stop"), (25, "final", "gone"))
    assert [(s, op) for s, op, *_ in out if op in ("restart", "error", "late")] == [(6, "restart"), (17, "restart"), (21.05, "restart"), (23, "error"), (25, "late")]


def rows():
    rnd, out = random.Random(3), []
    for n, name in enumerate(("mute", "fine", "still", "many")):
        at = [(0, "start", None, None, None)]
        if name == "mute":  # the primary goes mute, the fallback speaks, a late primary result, a text of the old epoch
            at += [(1, "final", "hello", None, None)] + [(s / 2, "level", None, 0.2, None) for s in range(4, 80)]
            at += [(12.4, "fallback", "queued", None, 0), (20.2, "fallback", "on device", None, 0), (25.1, "final", "late primary", None, None), (26.1, "fallback", "too late", None, 0)]
        elif name == "fine":
            at += [(s, "final", f"t{s}", None, None) for s in range(2, 40, 5)] + [(s, "level", None, 0.2, None) for s in range(40)]
        elif name == "still":
            at += [(s, "level", None, 0.01, None) for s in range(40)]
        else:
            kinds = ["level", "level", "level", "final", "interim", "fallback", "error", "ended"]
            for _ in range(150):
                kind = rnd.choice(kinds)
                text = {"error": rnd.choice(["network", "not-allowed", "no-speech", "x"])}.get(kind, rnd.choice(["", "some words"]))
                at.append((round(rnd.random() * 80, 2), kind, text, rnd.choice([0.0, 0.2]), rnd.choice([None, 0, 1])))
        out += [(name, k, ts(s), kind, text, level, epoch) for k, (s, kind, text, level, epoch) in enumerate(at)]
    return out


def test_stream_is_batch(spark, tmp_path):
    """Eight batches by time; timers of mute sessions expire while other sessions speak; a stop ends all state."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    data = rows() + [("clock", k, ts(k), "level", None, 0.0, None) for k in range(0, 120, 3)]
    table = spark.createDataFrame(data, E.INPUT)
    for k in range(8):
        part = table.where((F.col("ts") >= F.lit(ts(15 * k))) & (F.col("ts") < F.lit(ts(15 * k + 15))))
        part.coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")

    def go():
        stream = spark.readStream.schema(E.INPUT).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
        query = (
            E.switched_stream(stream).writeStream.outputMode("update").foreachBatch(lambda b, i: b.write.mode("overwrite").parquet(f"{tmp_path}/out/batch={i}"))
            .option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
        )
        assert query.awaitTermination(150) and query.exception() is None

    go()
    read = lambda: sorted(str(tuple(r)) for r in spark.read.schema(E.OUTPUT).parquet(f"{tmp_path}/out").select("session_id", "time_ms", "op", "engine", "epoch", "text").collect())
    # In the table every session is looked at up to 100 s, as the stream's clock brings it about.
    ends = [(s, 10**6, ts(100), "level", None, 0.0, None) for s in ("mute", "fine", "still", "many")]
    want = sorted(str(tuple(r)) for r in E.switched(table.unionByName(spark.createDataFrame(ends, E.INPUT))).collect())
    assert read() == want
    ops = [w for w in want if "'mute'" in w]
    assert sum("'kick'" in w for w in ops) and sum("'late'" in w for w in ops) == 1 and sum("'queued'" in w for w in ops) == 1
    assert not any("'kick'" in w for w in want if "'still'" in w or "'fine'" in w)
    stops = [(s, 10**7, ts(130), "stop", None, None, None) for s in ("mute", "fine", "still", "many")]
    spark.createDataFrame(stops, E.INPUT).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    go()
    for state in ("watch", "due", "waiting"):
        options = {"stateVarName": state} | ({"flattenCollectionTypes": "true"} if state != "watch" else {})
        assert spark.read.format("statestore").options(**options).load(f"{tmp_path}/c").count() == 0


def test_time_zone(spark):
    """Times are those of the inputs, not of the session's zone."""
    table = spark.createDataFrame(rows(), E.INPUT)
    want = sorted(map(str, E.switched(table).collect()))
    spark.conf.set("spark.sql.session.timeZone", "America/Lima")
    try:
        assert sorted(map(str, E.switched(table).collect())) == want
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_utterances(spark):
    from colloquy.streaming import live

    texts = E.utterances(E.switched(spark.createDataFrame(rows(), E.INPUT)).where("session_id = 'mute'"))
    got = live.segments(live.changes(texts)).orderBy("seg_ord").collect()
    assert [r.text for r in got] == ["Hello", "Queued", "On device", "Late primary"]
