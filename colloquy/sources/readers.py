"""Sources: audio files, recognizer events, recognized chunks, drafts and settings."""

from __future__ import annotations

import io
import wave
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor

import numpy as np
import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from colloquy import schemas
from colloquy.functions import signal
from colloquy.sources.sessions import SessionTable
from colloquy.sources.waves import UNIT_S, samples

#: Spoken languages that can be asked for, the first by default. Fixed value.
LANGUAGES = ("en-US", "en-GB", "es-ES", "fr-FR", "de-DE", "it-IT", "pt-BR", "zh-CN", "ja-JP", "ko-KR", "hi-IN")
TEMPLATES = ("meeting", "lecture", "interview")
#: Frames a second, meter and analysis intervals in milliseconds by power profile. Fixed values.
PROFILES = {"balanced": (4, 120, 1200), "saver": (2, 0, 3000), "hidden": (1, 0, 3000)}
SAVER_BELOW = 0.25
MIN_VOICE_S, CHUNK_S = 0.8, 6.0
#: Seconds of the pieces in which long audio is heard, of what they share, and of a model's call at most. Fixed values.
LONG_CHUNK_S, STRIDE_S, LIMIT_S = 30.0, 5.0, 300.0


def decode_wav(content: bytes) -> tuple[int, np.ndarray]:
    """Rate and mono samples, -1 to 1, of a PCM wave file."""
    with wave.open(io.BytesIO(content)) as file:
        return file.getframerate(), samples(file.readframes(file.getnframes()), file.getsampwidth(), file.getnchannels())


def audio(spark: SparkSession, path: str) -> DataFrame:
    """``session_id, sample_rate, pcm, duration_s`` of wave files: 16 kHz mono, quiet ones leveled.

    The file name is the session. Files that aren't PCM wave files have a null pcm. A file is one row: for recordings
    of any length there are :func:`colloquy.sources.waves.units`.
    """
    files = spark.read.format("binaryFile").load(path).select(F.element_at(F.split("path", "/"), -1).alias("session_id"), "content")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for name, content in zip(b["session_id"], b["content"]):
                try:
                    rate, x = decode_wav(bytes(content))
                    out.append((name, signal.RATE, leveled(resampled(x, rate)), x.size / rate))
                except (wave.Error, EOFError, ValueError):
                    out.append((name, signal.RATE, None, None))
            yield pd.DataFrame(out, columns=["session_id", "sample_rate", "pcm", "duration_s"])

    return files.mapInPandas(run, "session_id string, sample_rate int, pcm array<float>, duration_s double")


def resampled(x: np.ndarray, rate: int, to: int = signal.RATE) -> np.ndarray:
    """Nearest-sample decimation, as ``signal.decimated`` does it."""
    return x if rate == to else x[np.floor(np.arange(int(x.size * float(to) // rate)) * (rate / float(to))).astype(np.int64)]


def leveled(x: np.ndarray) -> np.ndarray:
    """As ``signal.leveled`` does it."""
    top = float(np.abs(x).max()) if x.size else 0.0
    return (x.astype(float) * min(0.9 / top, 24.0)).astype(np.float32) if 0 < top < 0.5 else x


def mixed(sources: DataFrame) -> DataFrame:
    """One signal from several of a session: samples of one place are added; ``session_id, pcm`` rows.

    A session's few signals meet as arrays; no sample becomes a row.
    """
    listed = sources.where(F.col("pcm").isNotNull()).groupBy("session_id").agg(F.array_sort(F.collect_list(F.col("pcm").cast("array<double>"))).alias("_all"))
    add = lambda a, b: F.zip_with(a, b, lambda x, y: F.coalesce(x, F.lit(0.0)) + F.coalesce(y, F.lit(0.0)))
    total = F.aggregate("_all", F.array().cast("array<double>"), add)
    return listed.select("session_id", total.cast("array<float>").alias("pcm"))


def pcm_batches(buffers: DataFrame, samples: int, buffer: int = 4096) -> DataFrame:
    """Buffers ``(session_id, buf_ord, pcm)`` gathered into batches of ``samples`` samples and more."""
    per = -(-samples // buffer)
    grouped = buffers.groupBy("session_id", F.floor(F.col("buf_ord") / per).alias("batch")).agg(F.array_sort(F.collect_list(F.struct("buf_ord", "pcm"))).alias("_b"))
    return grouped.select("session_id", "batch", F.flatten(F.transform("_b", lambda e: e["pcm"])).alias("pcm"))


def recognizer_events(spark: SparkSession, path: str, streaming: bool = True, max_files: int | None = None) -> DataFrame:
    """Recognizer events from JSON lines, as a stream or a table; see ``schemas.EVENTS``.

    ``max_files`` bounds what one batch of a stream takes in.
    """
    reader = (spark.readStream if streaming else spark.read).schema(schemas.EVENTS)
    if streaming and max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.json(path)


def results(events: DataFrame) -> DataFrame:
    """One row per new result that isn't blank: ``is_final`` and trimmed ``text``."""
    from colloquy.functions import text as X

    rows = events.select("session_id", "seq", "ts", "result_index", F.posexplode("results").alias("pos", "r"))
    rows = rows.where((F.col("pos") >= F.col("result_index")) & ~X.is_blank(F.col("r.transcript")))
    return rows.select("session_id", "seq", "ts", "pos", F.coalesce("r.is_final", F.lit(False)).alias("is_final"), X.trim(F.col("r.transcript")).alias("text"))


def error_route(error) -> object:
    """What an error of the recognizer leads to."""
    return (
        F.when(error.isin("not-allowed", "service-not-allowed"), "cooldown")
        .when(error == "network", "fallback")
        .when(error.isin("no-speech", "aborted"), "ignore")
        .otherwise("error")
    )


Recognizer = Callable[[np.ndarray, int], list[tuple[str, float, float | None]]]
Embedder = Callable[[np.ndarray, int], list[float]]


def stub_recognizer(pcm: np.ndarray, rate: int) -> list[tuple[str, float, float | None]]:
    """Stands in for a speech model: a word for every half second, named by its loudness."""
    step = rate // 2
    return [(f"w{int(100 * np.sqrt(np.mean(pcm[k : k + step] ** 2)))}", k / rate, (k + step) / rate) for k in range(0, max(len(pcm) - step + 1, 0), step)]


def stub_embedder(pcm: np.ndarray, rate: int) -> list[float]:
    """Stands in for a voice model: energies of 16 bands of the spectrum."""
    power = np.abs(np.fft.rfft(pcm[: 1 << 14])) ** 2
    return [float(np.log1p(p.sum())) for p in np.array_split(power, 16)]


def recognized(
    audio_rows: DataFrame, model: Recognizer | None = None, load: Callable[[], Recognizer] = lambda: stub_recognizer, quick: bool = False,
    chunk_s: float = LONG_CHUNK_S, stride_s: float = STRIDE_S,
) -> DataFrame:
    """``schemas.CHUNKS`` of audio by a model that each task gets once from ``load``, or by ``model``.

    Audio longer than ``chunk_s`` is heard in pieces of that length that share ``stride_s`` with
    the ones before and behind; a word counts in the piece in whose own part it begins. ``quick`` hears a short piece as a
    whole and gives one text without times for each session.
    """

    def pieces(pcm: np.ndarray, rate: int) -> Iterator[tuple[float, np.ndarray, float, float]]:
        """Start in seconds, samples, and the piece's own part within it."""
        size, step = int(chunk_s * rate), int((chunk_s - 2 * stride_s) * rate)
        if quick or pcm.size <= size:
            yield 0.0, pcm, 0.0, float("inf")
            return
        for at in range(0, pcm.size, step):
            last = at + size >= pcm.size
            yield at / rate, pcm[at : at + size], stride_s if at else 0.0, float("inf") if last else chunk_s - stride_s
            if last:
                return

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hear = model or load()
        for b in batches:
            out = []
            for name, rate, pcm in zip(b["session_id"], b["sample_rate"], b["pcm"]):
                found = []
                for at, part, low, high in pieces(np.asarray(pcm, np.float32), int(rate)) if pcm is not None else ():
                    found += [(text, at + s, None if e is None else at + e) for text, s, e in hear(part, int(rate)) if low <= s < high]
                if quick:
                    found = [(" ".join(text for text, _, _ in found), None, None)] if found else []
                out += [(name, k, text, {"start": s, "end": e}) for k, (text, s, e) in enumerate(found)]
            yield pd.DataFrame(out, columns=["session_id", "chunk_ord", "text", "ts"])

    return audio_rows.select("session_id", "sample_rate", "pcm").mapInPandas(run, schemas.CHUNKS)


def embedded(windows: DataFrame, audio_rows: DataFrame, model: Embedder = stub_embedder, limit_s: float = LIMIT_S) -> DataFrame:
    """``session_id, win_ord, vector``: voice vectors of windows; null under 0.8 s and where the model fails or takes more than ``limit_s``."""
    first = F.greatest(F.floor(F.col("start_s") * F.col("sample_rate")).cast("int"), F.lit(0))
    stop = F.least(F.ceil(F.col("end_s") * F.col("sample_rate")).cast("int"), F.size("pcm"))
    rows = windows.join(audio_rows.select("session_id", "sample_rate", "pcm"), "session_id")
    cut = F.when(stop - first >= F.col("sample_rate") * MIN_VOICE_S, F.slice("pcm", first + 1, stop - first))
    return _vectors(rows.select("session_id", "win_ord", "sample_rate", cut.alias("pcm")), model, limit_s)


def embedded_units(windows: DataFrame, units: DataFrame, model: Embedder = stub_embedder, limit_s: float = LIMIT_S, unit_s: int = UNIT_S) -> DataFrame:
    """:func:`embedded` for audio in units of ``unit_s`` seconds that overlap by the longest window.

    The windows that begin in a unit meet it as one row, so a unit's samples are moved once.
    """
    first = F.greatest(F.floor(F.col("start_s") * signal.RATE), F.lit(0)).cast("long")
    spans = windows.select("session_id", "win_ord", first.alias("at"), F.ceil(F.col("end_s") * signal.RATE).cast("long").alias("stop"))
    grouped = spans.groupBy("session_id", F.floor(F.col("at") / (unit_s * signal.RATE)).alias("unit")).agg(F.collect_list(F.struct("win_ord", "at", "stop")).alias("w"))
    rows = grouped.join(units.select("session_id", "unit", "first", "n_samples", "pcm"), ["session_id", "unit"])
    size = lambda w: F.least(w["stop"], F.col("n_samples")) - w["at"]
    cut = lambda w: F.when(size(w) >= signal.RATE * MIN_VOICE_S, F.slice("pcm", (w["at"] - F.col("first") + 1).cast("int"), size(w).cast("int")))
    found = rows.select("session_id", F.explode(F.transform("w", lambda w: F.struct(w["win_ord"].alias("win_ord"), cut(w).alias("pcm")))).alias("x"))
    return _vectors(found.select("session_id", "x.win_ord", F.lit(signal.RATE).alias("sample_rate"), "x.pcm"), model, limit_s)


def _vectors(rows: DataFrame, model: Embedder, limit_s: float) -> DataFrame:
    """Vectors of ``session_id, win_ord, sample_rate, pcm``.

    A call that takes too long can't be ended from outside: its thread is left to itself, and the worker waits for it at its end.
    """

    def vector(pool, pcm, rate):
        if pcm is None:
            return None
        try:
            return pool[0].submit(model, np.asarray(pcm, np.float32), int(rate)).result(limit_s)
        except TimeoutError:  # the next calls get a thread of their own
            pool[0].shutdown(wait=False)
            pool[0] = ThreadPoolExecutor(1)
            return None
        except Exception:  # a model's failure is a missing vector
            return None

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pool = [ThreadPoolExecutor(1)]
        for b in batches:
            yield b[["session_id", "win_ord"]].assign(vector=[vector(pool, p, r) for p, r in zip(b["pcm"], b["sample_rate"])])
        pool[0].shutdown(wait=False)

    return rows.mapInPandas(run, "session_id string, win_ord bigint, vector array<double>")


def recognized_units(
    units: DataFrame, model: Recognizer | None = None, load: Callable[[], Recognizer] = lambda: stub_recognizer, chunk_s: float = LONG_CHUNK_S, stride_s: float = STRIDE_S
) -> DataFrame:
    """:func:`recognized` for audio in units, which must overlap by ``chunk_s``: the same pieces, each heard in the unit where it begins."""
    size, step = int(chunk_s * signal.RATE), int((chunk_s - 2 * stride_s) * signal.RATE)

    def heard(hear: Recognizer, first: int, n_own: int, n: int, pcm: np.ndarray) -> Iterator[tuple]:
        starts = range(-(-first // step) * step, first + n_own, step)
        for at in starts:
            if at and at - step + size >= n:  # the piece before was the last
                return
            low, high = (stride_s if at else 0.0), (float("inf") if at + size >= n else chunk_s - stride_s)
            for text, s, e in hear(pcm[at - first : at - first + size], signal.RATE):
                if low <= s < high:
                    yield text, at / signal.RATE + s, None if e is None else at / signal.RATE + e

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hear = model or load()
        for b in batches:
            out = []
            for r in b.itertuples(index=False):
                found = heard(hear, int(r.first), int(r.n_own), int(r.n_samples), np.asarray(r.pcm, np.float32))
                out += [(r.session_id, r.unit, k, text, {"start": s, "end": e}) for k, (text, s, e) in enumerate(found)]
            yield pd.DataFrame(out, columns=["session_id", "unit", "k", "text", "ts"])

    known = units.where(F.col("pcm").isNotNull()).select("session_id", "unit", "first", "n_own", "n_samples", "pcm")
    found = known.mapInPandas(run, "session_id string, unit bigint, k bigint, text string, ts struct<start: double, end: double>")
    order = F.row_number().over(Window.partitionBy("session_id").orderBy("unit", "k")) - 1
    return found.select("session_id", order.cast("bigint").alias("chunk_ord"), "text", "ts")


def drafts(spark: SparkSession, path: str) -> DataFrame:
    """Saved drafts; none where the path is missing, and rows that can't be read are left out."""
    try:
        rows = spark.read.schema(schemas.DRAFTS + ", _corrupt string").option("columnNameOfCorruptRecord", "_corrupt").json(path)
    except AnalysisException:
        return spark.createDataFrame([], schemas.DRAFTS)
    return rows.where(F.col("id").isNotNull()).drop("_corrupt")


def setting(spark: SparkSession, name: str, domain: tuple[str, ...]) -> str:
    """A session setting below ``colloquy.``; what is outside its domain counts as the first value."""
    value = spark.conf.get(f"colloquy.{name}", domain[0])
    return value if value in domain else domain[0]


def set_setting(spark: SparkSession, name: str, value: str, domain: tuple[str, ...]) -> None:
    """Keep a setting in the session; values outside its domain are refused."""
    if value not in domain:
        raise ValueError(f"{name} is one of {', '.join(domain)}")
    spark.conf.set(f"colloquy.{name}", value)


def saved_setting(spark: SparkSession, path: str, owner: str, name: str, domain: tuple[str, ...]) -> str:
    """An owner's setting as kept at ``path``; without one, or with one outside its domain, the first value."""
    try:
        rows = SessionTable(spark, path).read([owner])
    except FileNotFoundError:
        return domain[0]
    found = rows.where(F.col("name") == name).select("value").first()
    return found[0] if found and found[0] in domain else domain[0]


def save_setting(spark: SparkSession, path: str, owner: str, name: str, value: str, domain: tuple[str, ...]) -> None:
    """Keep an owner's setting at ``path``, where later applications find it; values outside its domain are refused.

    Owners are the sessions of a session table, so a change is there as a whole or not at all.
    """
    if value not in domain:
        raise ValueError(f"{name} is one of {', '.join(domain)}")
    table = SessionTable(spark, path, buckets=16)
    new = spark.createDataFrame([(owner, name, value)], "session_id string, name string, value string")
    try:
        new = table.read([owner]).where(F.col("name") != name).unionByName(new)
    except FileNotFoundError:
        pass
    table.overwrite(new)


def duty_cycle(profile: str, battery: float | None = None, charging: bool | None = None) -> tuple[int, int, int]:
    """Frames a second, meter and analysis intervals; a low battery in use saves power."""
    low = battery is not None and battery <= SAVER_BELOW and charging is False
    return PROFILES["saver" if low and profile == "balanced" else profile]
