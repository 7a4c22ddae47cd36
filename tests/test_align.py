"""Streams of frames and buffers against the same tables."""

import datetime as dt
import random
import time

import pytest
from pyspark.sql import functions as F

from colloquy.operators import intervals
from colloquy.sources import readers
from colloquy.streaming import align

BEGAN = dt.datetime(2024, 1, 1)


@pytest.fixture
def rocks(spark):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def stream(spark, frames, path):
    """A stream of one file a batch."""
    for frame in frames:
        frame.coalesce(1).write.mode("append").parquet(path)
        time.sleep(0.02)  # files are taken by their time
    return spark.readStream.schema(frames[0].schema).option("maxFilesPerTrigger", 1).parquet(path)


def test_interval_join(spark, rocks, tmp_path):
    """Equals the batch join of the frames that weren't late; late ones are counted; no state is left but the newest."""
    ts = (F.lit(BEGAN) + F.make_dt_interval(secs=F.col("time_s"))).cast("timestamp")
    frames = spark.range(1600).select((F.col("id") % 2).cast("string").alias("session_id"), (F.floor(F.col("id") / 2) * 0.25).alias("time_s"), F.col("id").cast("double").alias("pitch_hz"))
    ends = [(s, k, round(7.3 * (k + 1) + s, 2)) for s in (0, 1) for k in range(26)]
    utt = spark.createDataFrame([(str(s), k, end) for s, k, end in ends], "session_id string, utt_ord bigint, end_s double")
    starts = intervals.previous_ends(utt)
    late = frames.where("session_id = '0' and time_s between 20 and 22").withColumn("pitch_hz", F.lit(-1.0))
    cut = lambda df, c: [df.where((F.col(c) >= 25 * k) & (F.col(c) < 25 * k + 25)) for k in range(8)]
    parts = cut(frames, "time_s")
    parts[6] = parts[6].unionByName(late)
    f = stream(spark, [p.withColumn("ts", ts) for p in parts], f"{tmp_path}/f")
    end = lambda c: (F.lit(BEGAN) + F.make_dt_interval(secs=F.col(c))).cast("timestamp")
    u = stream(spark, [p.withColumns({"start_ts": end("start_s"), "end_ts": end("end_s")}) for p in cut(starts, "end_s")], f"{tmp_path}/u")
    query = (
        align.utterance_frames_stream(u, f, "5 seconds", 60).writeStream.outputMode("append").format("parquet").option("path", f"{tmp_path}/out")
        .option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
    )
    assert query.awaitTermination(150) and query.exception() is None
    columns = ["session_id", "utt_ord", "time_s", "pitch_hz"]
    got = sorted(map(tuple, spark.read.parquet(f"{tmp_path}/out").select(columns).collect()))
    # The stream's first utterance begins after 0 s, the batch's with the first frame.
    want = sorted(map(tuple, intervals.utterance_frames(utt, frames.where("time_s > 0")).select(columns).collect()))
    assert got == want and len(got) > 1500
    assert align.dropped_late(query) == late.count() == 9
    assert query.lastProgress["stateOperators"][0]["numRowsTotal"] < 700


def buffers(n=23, sessions="abc"):
    return [(s, k, [float(k)] * 3, k == n - 1) for s in sessions for k in range(n)]


def test_pcm_batches(spark, rocks, tmp_path):
    """Any order, within and across micro-batches, gives the batches of the whole table."""
    rows = buffers()
    random.Random(2).shuffle(rows)
    parts = [spark.createDataFrame(rows[k::5], align.BUFFERS) for k in range(5)]
    source = stream(spark, parts, f"{tmp_path}/in")
    query = (
        align.pcm_batches_stream(source, 15, 3, timers=False).writeStream.outputMode("update").foreachBatch(lambda b, i: b.write.mode("overwrite").parquet(f"{tmp_path}/out/{i}"))
        .option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
    )
    assert query.awaitTermination(120) and query.exception() is None
    got = sorted(map(str, spark.read.schema(align.BATCHES).option("recursiveFileLookup", True).parquet(f"{tmp_path}/out").collect()))
    whole = spark.createDataFrame(buffers(), align.BUFFERS)
    assert got == sorted(map(str, readers.pcm_batches(whole, 15, 3).collect())) and len(got) == 15
    for state in ("held", "end"):
        options = {"stateVarName": state} | ({"flattenCollectionTypes": "true"} if state == "held" else {})
        assert spark.read.format("statestore").options(**options).load(f"{tmp_path}/c").count() == 0


def test_idle_session_gives_its_rest(spark, rocks, tmp_path):
    rows = spark.createDataFrame([r for r in buffers(7, "a") if r[1] not in (2, 6)], align.BUFFERS)
    source = stream(spark, [rows], f"{tmp_path}/in")
    query = (
        align.pcm_batches_stream(source, 15, 3, idle_ms=10).writeStream.outputMode("update").format("memory").queryName("rest")
        .option("checkpointLocation", f"{tmp_path}/c").trigger(processingTime="200 milliseconds").start()
    )
    until = time.time() + 60
    while time.time() < until and spark.table("rest").count() < 2:
        time.sleep(0.5)
    query.stop()
    assert sorted((r.batch, list(r.pcm)) for r in spark.table("rest").collect()) == [(0, [0.0] * 3 + [1.0] * 3 + [3.0] * 3 + [4.0] * 3), (1, [5.0] * 3)]
