"""Session tables, change rows in levels, and restarts."""

import os

import pytest
from pyspark.sql import functions as F

from colloquy.operators import store
from colloquy.sources import exports, readers, sessions
from colloquy.streaming import live, restarts

SCHEMA = "session_id string, n int, text string"


def rows(spark, *data):
    return spark.createDataFrame([(s, n, f"{s}{n}") for s, n in data], SCHEMA)


def content(table, only=None):
    return sorted((r.session_id, r.n) for r in table.read(only).collect())


def test_overwrite_and_delete(spark, tmp_path):
    table = sessions.SessionTable(spark, str(tmp_path), buckets=4)
    with pytest.raises(FileNotFoundError):
        table.read()
    first = [(f"s{k}", n) for k in range(20) for n in range(2)]
    assert table.overwrite(rows(spark, *first)) == 1 and content(table) == sorted(first)
    assert store.written_sessions(rows(spark, ("s3", 9), ("new", 1)), str(tmp_path), gone=rows(spark, ("s4", 0))) == 2
    want = sorted([x for x in first if x[0] not in ("s3", "s4")] + [("s3", 9), ("new", 1)])
    assert content(table) == want and content(table, ["s3", "s5", "none"]) == [("s3", 9), ("s5", 0), ("s5", 1)]
    assert sorted((r.session_id, r.n) for r in table.read(number=1).collect()) == sorted(first)
    assert table.overwrite(rows(spark)) == 2
    table.overwrite(rows(spark), gone=table.read().select("session_id"))
    assert content(table) == []
    table.vacuum(keep=1)
    assert table.manifests() == [3] and content(table) == [] and not os.listdir(tmp_path / "data")


def test_killed_overwrites_leave_the_old_sessions(spark, tmp_path, monkeypatch):
    """A failure while data is written, and one just before the manifest's rename."""
    table = sessions.SessionTable(spark, str(tmp_path), buckets=2)
    old = [(f"s{k}", 0) for k in range(30)]
    table.overwrite(rows(spark, *old))
    bad = rows(spark, *((f"s{k}", 1) for k in range(30))).withColumn("text", F.when(F.col("session_id") == "s7", F.raise_error(F.lit("killed"))).otherwise(F.col("text")))
    with pytest.raises(Exception, match="killed"):
        table.overwrite(bad)
    assert content(table) == sorted(old)

    def die(*_):
        raise KeyboardInterrupt

    with monkeypatch.context() as m:
        m.setattr(sessions.SessionTable, "_commit", die)
        with pytest.raises(KeyboardInterrupt):
            table.overwrite(rows(spark, *((f"s{k}", 1) for k in range(30))))
    assert content(table) == sorted(old) and len(os.listdir(tmp_path / "data")) >= 2
    table.vacuum()
    assert content(table) == sorted(old) and len(os.listdir(tmp_path / "data")) == 1
    table.overwrite(rows(spark, *((f"s{k}", 2) for k in range(30))))
    assert content(table) == [(s, 2) for s, _ in sorted(old)]


def test_two_writers(spark, tmp_path, monkeypatch):
    """Of different buckets both succeed; of the same bucket the second is refused."""
    table = sessions.SessionTable(spark, str(tmp_path), buckets=64)
    table.overwrite(rows(spark, ("a", 0), ("b", 0)))
    other = sessions.SessionTable(spark, str(tmp_path))
    commit = sessions.SessionTable._commit

    def with_another(name):
        def later(self, base, changed):
            monkeypatch.setattr(sessions.SessionTable, "_commit", commit)
            other.overwrite(rows(spark, (name, 5)))
            return commit(self, base, changed)

        monkeypatch.setattr(sessions.SessionTable, "_commit", later)

    with_another("b")
    assert table.overwrite(rows(spark, ("a", 1))) == 3 and content(table) == [("a", 1), ("b", 5)]
    with_another("a")
    with pytest.raises(sessions.Conflict):
        table.overwrite(rows(spark, ("a", 2)))
    assert content(table) == [("a", 5), ("b", 5)]
    assert not table._published(table.manifest()["number"], "{}")


def test_many_sessions_few_files(spark, tmp_path):
    many = spark.range(100_000).select(F.concat(F.lit("s"), F.col("id")).alias("session_id"), F.lit(1).alias("n"), F.lit("text").alias("text"))
    table = sessions.SessionTable(spark, str(tmp_path))
    table.overwrite(many)
    files = [f for _, _, names in os.walk(tmp_path) for f in names if f.endswith(".parquet")]
    assert len(files) <= 1000 and table.read().count() == 100_000
    plan = table.read(["s77"])
    assert len(plan.inputFiles()) < 20 and plan.count() == 1


def test_kept_settings(spark, tmp_path):
    """Settings outlive the session that made them; each owner has its own."""
    path, get = str(tmp_path / "settings"), lambda owner, name, domain: readers.saved_setting(spark.newSession(), path, owner, name, domain)
    assert get("ann", "language", readers.LANGUAGES) == "en-US"
    for owner, name, value, domain in (("ann", "language", "fr-FR", readers.LANGUAGES), ("bob", "language", "ja-JP", readers.LANGUAGES), ("ann", "template", "lecture", readers.TEMPLATES), ("ann", "language", "de-DE", readers.LANGUAGES)):
        readers.save_setting(spark, path, owner, name, value, domain)
    assert [get("ann", "language", readers.LANGUAGES), get("ann", "template", readers.TEMPLATES), get("bob", "language", readers.LANGUAGES)] == ["de-DE", "lecture", "ja-JP"]
    assert get("bob", "template", readers.TEMPLATES) == "meeting" and get("ann", "language", ("xx",)) == "xx"
    with pytest.raises(ValueError):
        readers.save_setting(spark, path, "ann", "template", "sermon", readers.TEMPLATES)


def test_texts(spark, tmp_path):
    text = spark.createDataFrame([("a", "one"), ("b", "two")], "session_id string, srt string")
    exports.write_texts(text, "srt", str(tmp_path))
    exports.write_texts(text.where("session_id = 'a'").withColumn("srt", F.lit("new")), "srt", str(tmp_path))
    assert {(r.session_id, r.value) for r in store.read_sessions(spark, str(tmp_path)).collect()} == {("a", "new"), ("b", "two")}


def test_recordings(spark, tmp_path):
    data = spark.createDataFrame([(f"s{k % 40}", k, [float(k)]) for k in range(200)], "session_id string, buf_ord bigint, pcm array<float>")
    data.write.parquet(f"{tmp_path}/in")
    query = live.recorded(spark.readStream.schema(data.schema).parquet(f"{tmp_path}/in"), f"{tmp_path}/raw", f"{tmp_path}/c", "0 seconds")
    query.processAllAvailable()
    query.stop()
    files = [f for d, _, names in os.walk(f"{tmp_path}/raw") for f in names if f.endswith(".parquet")]
    assert len(files) <= live.RECORD_BUCKETS and live.recording(spark, f"{tmp_path}/raw").count() == 200
    assert sorted(r.buf_ord for r in live.recording(spark, f"{tmp_path}/raw", "s3").collect()) == [3, 43, 83, 123, 163]


def test_levels(spark, tmp_path, monkeypatch):
    """50 batches: a row is read again once a level, the segments are those of all rows, and a batch that runs again changes nothing."""
    inputs = [("a", k, "frame", k / 10, None, 100.0 + k % 7, 500.0) if k % 3 == 0 else ("a", k, "final" if k % 12 == 11 else "interim", k / 10, f"text {k} more words", None, None) for k in range(150)]
    changed = live.changes(spark.createDataFrame(inputs, live.INPUT)).collect()
    merged = []
    plain = live.compacted

    def counted(part):
        merged.append(part.count())
        return plain(part)

    monkeypatch.setattr(live, "compacted", counted)
    sink = live.upsert_sink(str(tmp_path / "t"), every=4)
    local = lambda k: spark.createDataFrame([r for r in changed if r.seq // 3 == k], live.OUTPUT)
    for k in range(50):
        sink(local(k), k)
    sink(local(49), 49)
    sink(local(32), 32)
    want = live.segments(spark.createDataFrame(changed, live.OUTPUT))
    got = live.segments(live.change_table(spark, str(tmp_path / "t")).drop("batch"))
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect())) and len(changed) > 100
    assert len(merged) in (12 + 3, 12 + 3 + 1) and sum(merged) <= 4 * len(changed)
    assert len([n for n in os.listdir(tmp_path / "t") if n.startswith("batch=")]) < 13


def test_restarts(spark, tmp_path):
    """A sink that fails twice: the query goes on from its checkpoint, and every row is there once."""
    source = f"{tmp_path}/in"
    for k in range(4):
        spark.range(10 * k, 10 * k + 10).coalesce(1).write.mode("append").parquet(source)
    failed = []

    def sink(batch, batch_id):
        if batch_id in (1, 2) and batch_id not in failed:
            failed.append(batch_id)
            raise PermissionError("once") if batch_id == 3 else RuntimeError("once")
        batch.write.mode("overwrite").parquet(f"{tmp_path}/out/batch={batch_id}")

    def start():
        stream = spark.readStream.schema("id long").option("maxFilesPerTrigger", 1).parquet(source)
        return stream.writeStream.foreachBatch(sink).option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()

    keeper = restarts.Supervisor(spark, start).run()
    try:
        assert keeper.wait(90) and keeper.restarts == 2 and failed == [1, 2]
        assert sorted(r.id for r in spark.read.parquet(f"{tmp_path}/out").collect()) == list(range(40))
    finally:
        keeper.stop()


def test_gives_up(spark, tmp_path):
    keeper = restarts.Supervisor(spark, lambda: 1 / 0, most=2).run()
    try:
        assert keeper.wait(30) and keeper.restarts == 2 and "division" in keeper.error
    finally:
        keeper.stop()
    assert [restarts.pause_ms(n, 0) for n in (0, 1, 5, 9)] == [50, 100, 1600, 3000] and [restarts.pause_ms(0, n) for n in (1, 2, 3, 9)] == [5000, 10000, 20000, 30000]
    assert restarts.refused("java.nio.file.AccessControlException: no") and not restarts.refused("network")
