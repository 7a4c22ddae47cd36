"""Wave files in units against the same files read whole."""

import struct
import wave

import numpy as np
import pytest
from pyspark.sql import functions as F

from colloquy.functions import signal
from colloquy.operators import transcribe
from colloquy.sources import readers, waves


def write_wave(path, rate, channels, width, seconds, loud=1.0):
    rnd = np.random.default_rng(rate + width)
    n = int(rate * seconds)
    t = np.arange(n) / rate
    x = np.sin(2 * np.pi * (110 + 60 * np.floor(t / 7)) * t)[:, None] * np.linspace(0.3, 0.4, channels) * loud + 0.01 * loud * rnd.standard_normal((n, channels))
    x[(t % 11) < 2] = 0
    top = 1 << (8 * width - 1)
    ints = np.clip(np.round(x * (top - 1)), -top, top - 1).astype(np.int64)
    raw = (ints + 128).astype("u1").tobytes() if width == 1 else ints.astype("<i8").view("u1").reshape(n, channels, 8)[:, :, :width].tobytes()
    with wave.open(str(path), "wb") as file:
        file.setparams((channels, width, rate, 0, "NONE", ""))
        file.writeframes(raw)


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    path = tmp_path_factory.mktemp("waves")
    for name, *layout in (("a", 16000, 1, 2, 65.3), ("b", 22050, 2, 2, 41.7, 0.2), ("c", 8000, 1, 1, 43.0), ("d", 44100, 1, 3, 20.01), ("e", 48000, 2, 4, 20.5), ("s", 16000, 1, 2, 0.05)):
        write_wave(path / f"{name}.wav", *layout)
    (path / "bad.wav").write_bytes(b"RIFF")
    (path / "text.wav").write_bytes(b"no audio at all " * 9)
    return str(path)


def key(rows):
    return sorted((r.session_id, round(r.time_s, 6), r.pitch_hz, r.centroid_hz, r.energy) for r in rows.collect())


def test_same_frames(spark, folder):
    """Units of 20 s in ranges of 300 kB, some files over several tasks, give the frames of whole files."""
    units = waves.units(spark, folder, unit_s=20, range_bytes=600_000)
    assert units.rdd.getNumPartitions() > 0
    n_units = {r.session_id: r.n for r in units.groupBy("session_id").agg(F.count("*").alias("n")).collect()}
    assert n_units == {"a.wav": 4, "b.wav": 3, "c.wav": 3, "d.wav": 2, "e.wav": 2, "s.wav": 1, "bad.wav": 1, "text.wav": 1}
    want = key(signal.frames(readers.audio(spark, folder)))
    assert key(waves.frames(units)) == want and len({w[0] for w in want}) == 5
    assert key(waves.frames(waves.units(spark, folder))) == want


def test_tasks_share_a_file(spark, folder):
    rows = waves.units(spark, f"{folder}/a.wav", unit_s=5, range_bytes=400_000, level=False).select("unit", F.spark_partition_id().alias("task"), F.size("pcm").alias("n")).collect()
    assert sorted(r.unit for r in rows) == list(range(14)) and len({r.task for r in rows}) > 4
    assert max(r.n for r in rows) <= 5 * signal.RATE + signal.FRAME


def test_samples_are_the_file(spark, folder):
    whole = {r.session_id: r for r in readers.audio(spark, folder).collect()}
    rows = waves.units(spark, folder, unit_s=7, range_bytes=700_000, overlap_s=0).orderBy("session_id", "unit").collect()
    for name in ("a.wav", "b.wav", "c.wav", "d.wav", "e.wav", "s.wav"):
        own = [r for r in rows if r.session_id == name]
        assert np.array_equal(np.concatenate([r.pcm for r in own]), np.array(whole[name].pcm)) and own[0].duration_s == whole[name].duration_s
    assert [r.pcm for r in rows if r.session_id in ("bad.wav", "text.wav")] == [None, None]


def test_streamed_and_large_headers(spark, tmp_path):
    """A length that isn't known, an RF64 file with its own chunk, and chunks before the samples."""
    raw = (np.sin(np.arange(40_000) / 9) * 20000).astype("<i2").tobytes()
    fmt = struct.pack("<4sIHHIIHH", b"fmt ", 16, 1, 1, 16000, 32000, 2, 16)
    (tmp_path / "open.wav").write_bytes(struct.pack("<4sI4s", b"RIFF", 0xFFFFFFFF, b"WAVE") + fmt + struct.pack("<4sI", b"LIST", 5) + b"abcde\0" + struct.pack("<4sI", b"data", 0xFFFFFFFF) + raw)
    large = struct.pack("<4sI4s", b"RF64", 0xFFFFFFFF, b"WAVE") + struct.pack("<4sIQQQI", b"ds64", 28, 0, len(raw), 40_000, 0)
    (tmp_path / "rf.wav").write_bytes(large + fmt + struct.pack("<4sI", b"data", 0xFFFFFFFF) + raw + b"LIST\4\0\0\0more")
    rows = waves.units(spark, str(tmp_path), level=False).collect()
    assert [r.n_samples for r in rows] == [40_000, 40_000] and rows[0].pcm == rows[1].pcm


def test_recognition_and_vectors(spark, folder):
    audio = readers.audio(spark, folder)
    units = waves.units(spark, folder, unit_s=20, range_bytes=500_000, overlap_s=30)
    order = ["session_id", "chunk_ord"]
    want = readers.recognized(audio).orderBy(order).collect()
    assert readers.recognized_units(units).orderBy(order).collect() == want and len(want) > 300
    from colloquy.operators import intervals

    windows = intervals.hop_windows(signal.frames(audio))
    by = ["session_id", "win_ord"]
    assert readers.embedded_units(windows, units, unit_s=20).orderBy(by).collect() == readers.embedded(windows, audio).orderBy(by).collect()


def test_transcribed_files(spark, folder):
    """The stages between are tables in both cases, so that the two long plans differ in how audio is read only."""
    from colloquy.sources import scratch

    audio = scratch.written(readers.audio(spark, f"{folder}/[abs].wav"), "audio")
    chunks, frames = scratch.written(readers.recognized(audio), "chunks"), scratch.written(signal.frames(audio), "frames")
    one = transcribe._attributed(chunks, frames, audio.select("session_id", "duration_s"), lambda w: scratch.written(readers.embedded(w, audio), "vectors"))
    two = transcribe.transcribed_files(spark, f"{folder}/[abs].wav", unit_s=20)
    rows = lambda df: sorted(map(str, df.collect()))
    assert rows(two[0]) == rows(one[0]) and rows(two[1]) == rows(one[1]) and len(rows(one[0])) > 2


def test_missing(spark, tmp_path):
    with pytest.raises(Exception, match="nothing-here"):
        waves.units(spark, str(tmp_path / "nothing-here")).collect()
    assert waves.units(spark, str(tmp_path)).count() == 0


def test_samples_stay_in_their_task(spark, folder):
    """Leveled units are dealt before their samples are read, and short files share a task."""
    plan = waves.units(spark, folder, unit_s=20)._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and all("pcm" not in line for line in plan.splitlines() if "Repartition" in line or "Window" in line)
    assert waves.units(spark, folder, level=False).rdd.getNumPartitions() == 1
    assert key(waves.file_frames(spark, folder, unit_s=7, range_bytes=600_000)) == key(waves.frames(waves.units(spark, folder)))


def test_files_in_turns(spark, monkeypatch):
    """Recordings of 2 MB each way are 10 turns: the same frames as at once, and no turn's files are there when the next ones are written."""
    import glob
    import os

    from colloquy.plans import catalogue
    from colloquy.sources import scratch

    rows = lambda df: sorted(map(tuple, df.collect()))
    want = rows(catalogue.QUERIES["wave_file_frames"](spark, "/root/testdata/sf0.01"))
    paths, counts, new, write = [], [], scratch.new_path, waves.write

    def new_path(session, name):
        paths.append(new(session, name).removeprefix("file:"))
        return f"file:{paths[-1]}"

    def written(*a, **b):
        assert not any(os.path.exists(p) for p in paths if "/waves-" in p)
        write(*a, **b)
        counts.append(len(glob.glob(f"{paths[-1]}/session_id=*")))

    monkeypatch.setattr(scratch, "new_path", new_path)
    monkeypatch.setattr(waves, "write", written)
    monkeypatch.setattr(waves, "TURN_BYTES", 2_000_000)
    got = catalogue.QUERIES["wave_file_frames"](spark, "/root/testdata/sf0.01")
    assert len(counts) == 10 and sum(counts) == 20 and max(counts) < 8
    assert got.dtypes == [("session_id", "string"), ("time_s", "double"), ("energy", "double")] and rows(got) == want and len(want) > 9000
