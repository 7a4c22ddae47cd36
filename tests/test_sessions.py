"""Store, exports, sources and live sessions."""

import io
import time
import wave
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from colloquy import schemas
from colloquy.functions import text as X
from colloquy.operators import store
from colloquy.sources import exports, readers
from colloquy.streaming import live


@pytest.fixture
def tables(spark):
    rows = [("a", "x", 0, 0, "We decided we ship the apples today.", 0.0, 1.2, False), ("a", "y", 1, 1, "fine with me", 61.0, 61.1, None), ("a", "z", 2, 1, "open words", 62.0, 63.0, True)]
    people = [("a", 0, "Ann", "#1", 100.0), ("a", 1, "Bob", "#2", 200.0)]
    return spark.createDataFrame(rows, schemas.SEGMENTS), spark.createDataFrame(people, schemas.SPEAKERS)


def test_store(spark, tables):
    segments, speakers = tables
    new = spark.createDataFrame([("a", "y", 9, 0, "new", 0.0, 0.0, False), ("a", "q", 9, 0, "more", 0.0, 0.0, False), ("b", "p", 3, 0, "b", 0.0, 0.0, False)], schemas.SEGMENTS)
    got = store.upsert(segments, new).orderBy("session_id", "seg_ord").collect()
    assert [(r.session_id, r.seg_id, r.seg_ord, r.text[:4]) for r in got] == [("a", "x", 0, "We d"), ("a", "y", 1, "new"), ("a", "z", 2, "open"), ("a", "q", 3, "more"), ("b", "p", 0, "b")]
    assert store.replaced(segments, new.where("session_id = 'a'")).count() == 2
    merges = spark.createDataFrame([("a", 1, 5), ("a", 5, 0)], "session_id string, from_id int, to_id int")
    tagged, left = store.remapped(segments, speakers, merges)
    assert {r.speaker_id for r in tagged.collect()} == {0} and [r.id for r in left.collect()] == [0]
    tagged, people = store.assigned(segments, speakers, "a", "y", None)
    assert [r.speaker_id for r in tagged.orderBy("seg_ord").collect()] == [0, 2, 1]
    assert {(r.id, r.name) for r in people.collect()} == {(0, "Ann"), (1, "Bob"), (2, "Speaker 3")}
    tagged, _ = store.assigned(segments, speakers, "a", "y", 0)
    assert [r.speaker_id for r in tagged.orderBy("seg_ord").collect()] == [0, 0, 1]
    assert [r.name for r in store.renamed_speaker(speakers, "a", 1, "Cy").orderBy("id").collect()] == ["Ann", "Cy"]
    stats = store.stats(segments).first()
    assert (stats.n_words, stats.length_s, stats.n_segments) == (10, 61.1, 2)
    assert store.next_speaker(speakers).first().next_id == 2 and store.other_speakers(speakers, 0).count() == 1


def test_drafts(spark, tables, tmp_path):
    segments, speakers = tables
    drafts = spark.createDataFrame([], schemas.DRAFTS)
    for k in range(22):
        drafts = spark.createDataFrame(store.saved_draft(drafts, segments, speakers, 1_700_000_000_000 + k).collect(), schemas.DRAFTS)
    rows = drafts.collect()
    assert len(rows) == 20 and rows[0].saved_at == 1_700_000_000_021 and len(rows[0].segments) == 2
    assert rows[0].name == "Draft — Nov 14, 10:13 PM"
    path = f"{tmp_path}/drafts"
    assert exports.write_drafts(drafts, path)
    read = readers.drafts(spark, path)
    assert read.count() == 20 and readers.drafts(spark, f"{tmp_path}/none").count() == 0
    got, people = store.loaded_draft(read, rows[0].id)
    assert [r.text for r in got.orderBy("seg_ord").collect()] == ["We decided we ship the apples today.", "fine with me"] and people.count() == 2
    assert store.loaded_draft(read, "no")[0].count() == 0
    assert store.deleted_draft(read, rows[0].id).count() == 19
    assert store.renamed_draft(read, rows[0].id, "N").where("name = 'N'").count() == 1


def test_exports(spark, tables, tmp_path):
    segments, speakers = tables
    speakers = speakers.where("id = 0")
    text = exports.txt(segments, speakers).first().txt
    assert text == "\n\nDECISIONS\n  - We decided we ship the apples today.\n\n".removeprefix("\n") + "=" * 40 + (
        "\nTRANSCRIPT\n\n[0:00] Ann: We decided we ship the apples today.\n\n[1:01] Unknown speaker: fine with me"
    )
    assert exports.srt(segments, speakers).first().srt == (
        "1\n00:00:00,000 --> 00:00:01,200\nAnn: We decided we ship the apples today.\n\n2\n00:01:01,000 --> 00:01:01,500\nUnknown speaker: fine with me"
    )
    content = exports.docx(segments, speakers).first().content
    with zipfile.ZipFile(io.BytesIO(bytes(content))) as file:
        document = file.read("word/document.xml").decode()
    order = [document.index(x) for x in ("Summary", "Decisions", "Meeting transcript", "Ann ", "[1:01]")]
    assert order == sorted(order)
    exports.write_text(exports.srt(segments, speakers), "srt", f"{tmp_path}/srt")
    assert spark.read.text(f"{tmp_path}/srt", wholetext=True).count() == 1
    no_summary = exports.txt(segments.where("seg_ord = 1"), speakers).first().txt
    assert no_summary == "[1:01] Unknown speaker: fine with me"


def test_audio(spark, tmp_path):
    x = (8000 * np.sin(2 * np.pi * 150 * np.arange(32000) / 32000)).astype("<i2")
    with wave.open(f"{tmp_path}/a.wav", "wb") as file:
        file.setparams((2, 2, 32000, 0, "NONE", ""))
        file.writeframes(np.repeat(x, 2).tobytes())
    (tmp_path / "bad.wav").write_bytes(b"nothing")
    rows = {r.session_id: r for r in readers.audio(spark, str(tmp_path)).collect()}
    assert len(rows["a.wav"].pcm) == 16000 and abs(max(rows["a.wav"].pcm) - 0.9) < 0.01 and rows["bad.wav"].pcm is None
    audio = readers.audio(spark, f"{tmp_path}/a.wav")
    chunks = readers.recognized(audio)
    assert chunks.count() == 2
    windows = spark.createDataFrame([("a.wav", 0, 0.0, 0.9), ("a.wav", 1, 0.5, 0.9)], schemas.WINDOWS)
    got = readers.embedded(windows, audio).orderBy("win_ord").collect()
    assert len(got[0].vector) == 16 and got[1].vector is None
    two = audio.select("session_id", "pcm")
    both = readers.mixed(two.unionByName(two)).first().pcm
    assert np.allclose(both, 2 * np.array(rows["a.wav"].pcm), atol=1e-5)
    buffers = spark.createDataFrame([("s", k, [float(k)] * 2) for k in range(5)], "session_id string, buf_ord bigint, pcm array<double>")
    assert [len(r.pcm) for r in readers.pcm_batches(buffers, 4, 2).orderBy("batch").collect()] == [4, 4, 2]


def test_settings(spark):
    assert readers.setting(spark, "language", readers.LANGUAGES) == "en-US"
    spark.conf.set("colloquy.language", "xx")
    assert readers.setting(spark, "language", readers.LANGUAGES) == "en-US"
    spark.conf.set("colloquy.language", "fr-FR")
    assert readers.setting(spark, "language", readers.LANGUAGES) == "fr-FR"
    assert readers.duty_cycle("balanced", 0.25, False) == (2, 0, 3000) and readers.duty_cycle("balanced", 0.2, True)[0] == 4


def test_caption():
    c = live.Caption()
    assert [c.update(x) for x in ("we", "we should", "we shout at", "we should")] == ["we", "we should", "we shout at", "we shout at"]
    assert c.finalize("we should act now please") == "we shout at now please"
    c.update("send the report today")
    assert c.finalize("send report") == "send the report today" and c.finalize("as is") == "as is"


INPUTS = [
    ("a", 1, "frame", 0.1, None, 100.0, 500.0), ("a", 2, "frame", 0.2, None, 101.0, 510.0), ("a", 3, "frame", 0.3, None, 99.0, 490.0),
    ("a", 4, "interim", 0.5, "hello the", None, None), ("a", 5, "interim", 0.7, "hello", None, None), ("a", 6, "final", 0.9, "hello there", None, None),
    ("b", 1, "final", 0.4, " ", None, None), ("b", 2, "interim", 0.5, "left over", None, None), ("b", 3, "end", 0.8, None, None, None),
    ("a", 7, "frame", 1.1, None, 230.0, 500.0), ("a", 8, "frame", 1.2, None, 231.0, 510.0), ("a", 9, "frame", 1.3, None, 229.0, 490.0),
    ("a", 10, "final", 2.0, "other voice", None, None), ("a", 11, "interim", 2.5, "so", None, None),
]


def test_batch(spark):
    got = live.segments(live.changes(spark.createDataFrame(INPUTS, live.INPUT))).orderBy("session_id", "seg_ord").collect()
    assert [(r.session_id, r.seg_id, r.speaker_id, r.text, r.start_s, r.end_s, r.interim) for r in got] == [
        ("a", "live-interim", 1, "so", 2.0, 2.5, True), ("a", "live-0", 0, "Hello the", 0.0, 0.9, False),
        ("a", "live-1", 1, "Other voice", 0.9, 2.0, False), ("b", "live-0", -1, "Left over", 0.0, 0.8, False),
    ]


def test_sessions_over_many_batches(spark):
    """Sessions that pass in batches of two rows give the changes of whole ones."""
    rows = spark.createDataFrame(INPUTS, live.INPUT)
    want = sorted(map(str, live.changes(rows).collect()))
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 2)
    try:
        assert sorted(map(str, live.changes(rows.repartition(5)).collect())) == want
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)


def test_stream_is_batch(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    rows = spark.createDataFrame(INPUTS, live.INPUT)
    source = f"{tmp_path}/in"
    for lo, hi in ((0, 4), (5, 8), (9, 99)):  # three files, three batches
        rows.where(F.col("seq").between(lo, hi)).coalesce(1).write.mode("append").parquet(source)
    stream = spark.readStream.schema(live.INPUT).option("maxFilesPerTrigger", 1).parquet(source)
    query = (
        live.changes_stream(stream, timers=False).writeStream.outputMode("update").foreachBatch(live.upsert_sink(f"{tmp_path}/out"))
        .option("checkpointLocation", f"{tmp_path}/checkpoint").trigger(availableNow=True).start()
    )
    query.awaitTermination(120)
    got = live.segments(live.change_table(spark, f"{tmp_path}/out").drop("batch")).orderBy("session_id", "seg_id").collect()
    want = live.segments(live.changes(rows)).orderBy("session_id", "seg_id").collect()
    assert got == want and len(got) == 4


def test_events(spark, tmp_path):
    (tmp_path / "e.json").write_text(
        '{"session_id":"a","seq":1,"ts":"2024-01-01T00:00:01","result_index":1,"results":[{"is_final":true,"transcript":"old"},{"is_final":false,"transcript":" new "},{"transcript":" "}]}\n'
    )
    got = readers.results(readers.recognizer_events(spark, str(tmp_path), streaming=False)).collect()
    assert [(r.pos, r.is_final, r.text) for r in got] == [(1, False, "new")]
    rows = readers.recognizer_events(spark, str(tmp_path), streaming=False).withColumn("time_s", F.lit(1.0))
    frames = spark.createDataFrame([("a", 0.5, 100.0, 500.0, 0.1)], schemas.FRAMES)
    assert [(r.kind, r.text) for r in live.inputs(rows, frames).orderBy("seq").collect()] == [("frame", None), ("interim", "new")]


EVENTS = [
    ("a", 1, 0, 0.5, [(False, "hello the")]), ("a", 2, 0, 0.9, [(True, "hello there"), (True, "friend"), (False, "and"), (False, "so")]),
    ("a", 3, 2, 1.4, [(True, "old"), (True, "older"), (True, "and so on")]), ("b", 1, 0, 0.2, [(False, "left over")]), ("b", 2, 0, 0.3, [(None, "left over words")]),
]


def test_events_to_segments(spark, tmp_path):
    """A stream of recognizer events and frames, in files, gives the segments of the whole tables; open sessions end when idle."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    events = spark.createDataFrame(EVENTS, "session_id string, seq bigint, result_index int, time_s double, results array<struct<is_final: boolean, transcript: string>>")
    frames = spark.createDataFrame([("a", 0.1 * k, 100.0 + k, 500.0, 0.1) for k in range(8)] + [("a", 1 + 0.1 * k, 240.0 + k, 900.0, 0.1) for k in range(4)], schemas.FRAMES)
    for k in range(3):
        events.where(F.col("seq") == k + 1).coalesce(1).write.mode("append").json(f"{tmp_path}/events")
    frames.coalesce(1).write.parquet(f"{tmp_path}/frames")
    stream = live.inputs(
        spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).json(f"{tmp_path}/events"), spark.readStream.schema(frames.schema).parquet(f"{tmp_path}/frames")
    )
    progress = live.Progress()
    spark.streams.addListener(progress)
    sink = live.upsert_sink(f"{tmp_path}/out", every=2)
    analysis = live.analysis_sink(f"{tmp_path}/suggestions")

    def both(batch, batch_id):
        sink(batch, batch_id)
        analysis(batch, batch_id)

    def run():
        query = (
            live.changes_stream(stream, kick_ms=1, idle_ms=1500).writeStream.outputMode("update").foreachBatch(both)
            .option("checkpointLocation", f"{tmp_path}/checkpoint").trigger(once=True).start()
        )
        assert query.awaitTermination(60)

    run()
    # Timers are looked at when a batch runs: the next one, of another session, comes later.
    time.sleep(2)
    spark.createDataFrame([("c", 9, 0, 9.0, [(True, "um wake up")])], events.schema).coalesce(1).write.mode("append").json(f"{tmp_path}/events")
    run()
    spark.streams.removeListener(progress)
    changes = live.change_table(spark, f"{tmp_path}/out")
    ended = spark.createDataFrame([("a", 2**60, "end", 1.4, None, None, None), ("b", 2**60, "end", 0.3, None, None, None)], live.INPUT)
    want = live.segments(live.changes(live.inputs(events, frames).unionByName(ended)))
    got = live.segments(changes.drop("batch"))
    key = ["session_id", "seg_id"]
    columns = ["session_id", "seg_id", "speaker_id", "text", "start_s", "end_s", "interim"]
    assert got.where("session_id <> 'c'").select(columns).orderBy(key).collect() == want.select(columns).orderBy(key).collect()
    assert [r.text for r in got.where("session_id = 'b'").collect()] == ["Left over words"]
    assert changes.where("op = 'kick'").count() or changes.select("batch").distinct().count() < 5
    left = spark.read.format("statestore").option("stateVarName", "session").load(f"{tmp_path}/checkpoint").collect()
    assert len(left) <= 1
    found = spark.read.parquet(f"{tmp_path}/suggestions").where("session_id = 'c'").collect()
    assert {r.kind for r in found} == {"filler"}
    assert sum(q["batches"] for q in progress.queries.values()) >= 0


def test_state_goes_at_the_end(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    rows = spark.createDataFrame([*INPUTS, ("a", 12, "end", 3.0, None, None, None)], live.INPUT)
    rows.coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(live.INPUT).parquet(f"{tmp_path}/in")
    query = (
        live.changes_stream(stream, timers=False).writeStream.outputMode("update").foreachBatch(live.upsert_sink(f"{tmp_path}/out"))
        .option("checkpointLocation", f"{tmp_path}/checkpoint").trigger(availableNow=True).start()
    )
    query.awaitTermination(120)
    assert live.segments(live.change_table(spark, f"{tmp_path}/out").drop("batch")).count() == 4
    assert spark.read.format("statestore").option("stateVarName", "session").load(f"{tmp_path}/checkpoint").count() == 0


def test_start_makes_all_new():
    session = live.Session()
    list(session.feed("interim", 0.5, "some words", 0, 0)), list(session.feed("frame", 0.6, None, 100, 500))
    list(session.feed("start", 0.7, None, 0, 0))
    assert not session.caption.shown and not session.frames and session.last == -1


def test_compacted(spark):
    changed = live.changes(spark.createDataFrame(INPUTS, live.INPUT))
    assert sorted(live.segments(live.compacted(changed)).collect()) == sorted(live.segments(changed).collect())
    assert live.compacted(changed).count() < changed.count()


def test_merges(spark):
    """A speaker that merges twice, and merges in a circle, have one end."""
    rows = [("a", 1, 5), ("a", 1, 3), ("a", 3, 0), ("b", 1, 2), ("b", 2, 3), ("b", 3, 1), ("b", 7, 3), ("c", 4, 4)]
    merges = spark.createDataFrame(rows, "session_id string, from_id int, to_id int")
    got = {(r.session_id, r.from_id): r.to_id for r in store.resolved_aliases(merges).collect()}
    assert got == {("a", 1): 0, ("a", 3): 0, ("b", 1): 1, ("b", 2): 1, ("b", 3): 1, ("b", 7): 1, ("c", 4): 4}
    later = spark.createDataFrame([("a", 1, 0, 1), ("a", 1, 5, 2)], "session_id string, from_id int, to_id int, seq int")
    assert store.resolved_aliases(later).first().to_id == 5


def test_long_and_quick_recognition(spark):
    """Long audio is heard in pieces, and every half second of it once; a model that hangs gives no vector."""
    rate = 100
    audio = spark.createDataFrame([("s", rate, [0.5] * (rate * 70))], "session_id string, sample_rate int, pcm array<float>")
    got = readers.recognized(audio).orderBy("chunk_ord").collect()
    assert [r.ts.start for r in got] == [k / 2 for k in range(140)]
    assert [(r.text, r.ts.start) for r in readers.recognized(audio.select("session_id", "sample_rate", F.slice("pcm", 1, 100).alias("pcm")), quick=True).collect()] == [("w50 w50", None)]
    windows = spark.createDataFrame([("s", 0, 0.0, 1.0), ("s", 1, 1.0, 3.0)], schemas.WINDOWS)

    def slow(pcm, rate):
        time.sleep(3 if len(pcm) > 150 else 0)
        return [1.0]

    assert [r.vector for r in readers.embedded(windows, audio, slow, limit_s=1).orderBy("win_ord").collect()] == [[1.0], None]


def test_labels_and_state(spark):
    row = spark.range(1).select(
        X.kind_label(F.lit("hedge")).alias("a"), X.counted(F.lit(1), "speaker").alias("b"), X.counted(F.lit(2), "word").alias("c"), X.pitch_label(F.lit(119.6)).alias("d")
    ).first()
    assert tuple(row) == ("Hedging", "1 speaker", "2 words", "~120 Hz") and set(X.LABELS) == set(schemas.KINDS)
    state = spark.createDataFrame([("a", "status", "reading", 1), ("a", "progress", "0.1", 1)], "session_id string, name string, value string, seq int")
    new = spark.createDataFrame([("a", "status", None, 2), ("a", "progress", "0.2", 2)], state.schema)
    assert {(r.name, r.value) for r in store.with_state(state, new).collect()} == {("status", "reading"), ("progress", "0.2")}
    readers.set_setting(spark, "template", "lecture", readers.TEMPLATES)
    assert readers.setting(spark, "template", readers.TEMPLATES) == "lecture"
    with pytest.raises(ValueError):
        readers.set_setting(spark, "template", "sermon", readers.TEMPLATES)


def test_recorded(spark, tmp_path):
    rows = spark.createDataFrame([("s", k, [float(k)] * 2) for k in range(5)], "session_id string, buf_ord bigint, pcm array<float>")
    rows.write.parquet(f"{tmp_path}/in")
    query = live.recorded(spark.readStream.schema(rows.schema).parquet(f"{tmp_path}/in"), f"{tmp_path}/raw", f"{tmp_path}/checkpoint", "0 seconds")
    query.processAllAvailable()
    query.stop()
    assert spark.read.parquet(f"{tmp_path}/raw").count() == 5
