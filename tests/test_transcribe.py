"""The batch path from audio to segments with stand-in models, and states of live recognition."""

import numpy as np
from pyspark.sql import functions as F

from colloquy.operators import transcribe
from colloquy.streaming import health

RATE = 16000


def tone(hz, seconds):
    return 0.4 * np.sin(2 * np.pi * hz * np.arange(int(RATE * seconds)) / RATE)


def voice(pcm, rate):
    """A vector that tells low from high tones."""
    hz = np.abs(np.fft.rfft(pcm)).argmax() * rate / len(pcm)
    return [1.0, 0.0] if hz < 200 else [0.0, 1.0]


def sentence(pcm, rate):
    return [("one whole sentence of text", 0.0, 4.0), ("and a second one follows it", 4.0, None)]


def test_batch(spark):
    two = np.concatenate([tone(120, 8), np.zeros(RATE * 2), tone(300, 8)])
    rows = [("two", RATE, two.tolist(), 18.0), ("short", RATE, tone(120, 1.5).tolist(), 1.5), ("still", RATE, [0.0] * RATE, 1.0)]
    audio = spark.createDataFrame(rows, "session_id string, sample_rate int, pcm array<float>, duration_s double")
    segments, speakers = transcribe.transcribed(audio, embedder=voice)
    got = {}
    for r in segments.orderBy("session_id", "seg_ord").collect():
        got.setdefault(r.session_id, []).append((r.speaker_id, r.start_s, r.end_s))
    assert [s for s, *_ in got["two"]] == [0, 1] and got["two"][0][1] == 0 and got["two"][1][2] == 18
    assert [s for s, *_ in got["short"]] == [0] and {s for s, *_ in got["still"]} == {-1}
    hz = {(r.session_id, r.id): r.median_pitch_hz for r in speakers.collect()}
    assert abs(hz["two", 0] - 120) < 5 and abs(hz["two", 1] - 300) < 10 and abs(hz["short", 0] - 120) < 5
    chunked, _ = transcribe.transcribed(audio.where("session_id = 'two'"), recognizer=sentence, embedder=voice)
    assert [(r.speaker_id, r.text) for r in chunked.orderBy("seg_ord").collect()] == [
        (0, "one whole sentence of text"), (1, "and a second one follows it"),
    ] or chunked.count() == 1


def test_refinable(spark):
    live = spark.createDataFrame([("a", "x", 30000), ("a", "x", 30000), ("b", "y", 20000), ("c", "z", 90000)], "session_id string, content_id string, n_bytes long")
    seen = spark.createDataFrame([("z",)], "content_id string")
    assert [r.content_id for r in transcribe.refinable(live, seen).collect()] == ["x"]


def test_health(spark):
    row = spark.range(1).select(
        health.should_kick(F.lit(20.0), F.lit(11.0), F.lit(16.0)).alias("a"), health.should_kick(F.lit(20.0), F.lit(12.0), F.lit(16.0)).alias("b"),
        health.should_kick(F.lit(20.0), F.lit(1.0), F.lit(14.0)).alias("c"),
    ).first()
    assert (row.a, row.b, row.c) == (True, False, False)
    levels = spark.createDataFrame([("a", 1.0, 0.1), ("a", 2.0, 0.06)], "session_id string, time_s double, level double")
    assert health.last_voice(levels).first().last_voice_s == 1.0
    text = "session_id string, utt_ord long, text string"
    got = health.preferred(spark.createDataFrame([("a", 0, "n")], text), spark.createDataFrame([("a", 0, "f"), ("a", 1, "f")], text))
    assert sorted((r.utt_ord, r.text, r.engine) for r in got.collect()) == [(0, "n", "native"), (1, "f", "fallback")]
    results = spark.createDataFrame([("a", "fallback", 3.0), ("a", "fallback", 6.0), ("a", "native", 6.0)], "session_id string, engine string, time_s double")
    engines = spark.createDataFrame([("a", "fallback", 2.0, 5.0), ("a", "native", 5.0, None)], "session_id string, engine string, from_s double, until_s double")
    assert health.current_only(results, engines).count() == 2
