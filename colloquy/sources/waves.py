"""Wave files of any length as units of a minute: a data source that reads byte ranges.

A file is cut into ranges of bytes, which are the tasks. A task looks at the file's header and
reads the units that begin in its range, one at a time, each with so much of what follows it
as frames, pieces or windows that begin in the unit may need. No task or row ever
holds a whole file, and several tasks read one.

Files are opened through ``pyarrow.fs``: plain paths, ``file:``, ``hdfs:``, ``s3:`` and ``gs:`` addresses. For a store
that only Spark itself can read there is :func:`colloquy.sources.readers.audio`, which takes each file whole.
"""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterator
from fnmatch import fnmatch
from urllib.parse import unquote

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from colloquy.functions import signal
from colloquy.sources import scratch

#: Seconds of a unit, bytes of a task's range, and seconds that a unit has of the next ones: those of a frame.
UNIT_S, RANGE_BYTES, OVERLAP_S = 60, 64 << 20, signal.FRAME / signal.RATE
#: What opening a file counts for, in bytes, where short files are dealt to tasks.
OPEN_BYTES = 1 << 18
#: Tasks that read samples, at most; beyond it each reads more.
MAX_TASKS = 20_000
#: Bytes of files that are on disk at once, about, where they are made to be analyzed only.
TURN_BYTES = 2 << 30
#: first and n_own: place and number of the unit's own samples at 16 kHz; pcm has the overlap behind them.
UNITS = (
    "session_id string, path string, unit bigint, first bigint, n_own int, n_samples bigint, duration_s double, "
    "source_rate int, peak float, pcm array<float>"
)


def samples(raw: bytes, width: int, channels: int) -> np.ndarray:
    """Mono samples, -1 to 1, of interleaved PCM."""
    if width == 1:
        x = (np.frombuffer(raw, np.uint8).astype(np.float32) - 128) / 128
    elif width == 3:
        parts = np.frombuffer(raw, np.uint8).reshape(-1, 3).astype(np.int32)
        x = ((parts[:, 0] << 8 | parts[:, 1] << 16 | parts[:, 2] << 24) >> 8).astype(np.float32) / (1 << 23)
    else:
        x = np.frombuffer(raw, f"<i{width}").astype(np.float32) / (1 << (8 * width - 1))
    return x.reshape(-1, channels).mean(1).astype(np.float32)


class Header:
    """Layout of a PCM wave file; a ValueError for anything else. Sizes of 4 GB and more are in an RF64 file's own chunk."""

    def __init__(self, file, size: int):
        kind, _, form = struct.unpack("<4sI4s", _exactly(file, 12))
        if kind not in (b"RIFF", b"RF64") or form != b"WAVE":
            raise ValueError("not a wave file")
        self.rate, long_size = 0, None
        while True:
            name, length = struct.unpack("<4sI", _exactly(file, 8))
            if name == b"data":
                break
            body = _exactly(file, min(length, 64))
            if name == b"fmt ":
                tag, self.channels, self.rate, _, block, bits = struct.unpack("<HHIIHH", body[:16])
                if tag == 0xFFFE and len(body) >= 26:
                    (tag,) = struct.unpack("<H", body[24:26])
                self.width = (bits + 7) // 8
                if tag != 1 or not self.rate or not self.channels or not 1 <= self.width <= 4 or block != self.width * self.channels:
                    raise ValueError("not PCM")
            elif name == b"ds64":
                (long_size,) = struct.unpack("<Q", body[8:16])
            file.seek(file.tell() - len(body) + length + length % 2)
        if not self.rate:
            raise ValueError("samples before their format")
        self.start, self.block = file.tell(), self.width * self.channels
        if kind == b"RF64" and length == 0xFFFFFFFF and long_size is not None:
            length = long_size
        elif length in (0, 0xFFFFFFFF):  # written as a stream: all that follows
            length = size - self.start
        self.n = min(length, size - self.start) // self.block
        self.every = self.rate / float(signal.RATE)
        #: Samples at 16 kHz.
        self.n_out = self.n if self.rate == signal.RATE else int(self.n * float(signal.RATE) // self.rate)

    def read(self, file, first: int, count: int) -> np.ndarray:
        """Samples at 16 kHz, the nearest of the file's own, from ``first`` on."""
        count = min(count, self.n_out - first)
        if count <= 0:
            return np.empty(0, np.float32)
        place = lambda k: k if self.rate == signal.RATE else np.floor(k * self.every).astype(np.int64)
        low, high = int(place(np.int64(first))), min(int(place(np.int64(first + count - 1))), self.n - 1)
        file.seek(self.start + low * self.block)
        raw = samples(_exactly(file, (high - low + 1) * self.block), self.width, self.channels)
        times = signal.RATE // self.rate
        if times in (2, 4) and times * self.rate == signal.RATE:
            return np.repeat(raw, times)[first % times : first % times + count]
        return raw if self.rate == signal.RATE else raw[np.minimum(place(np.arange(first, first + count)), high) - low]


def _exactly(file, n: int) -> bytes:
    data = file.read(n)
    if len(data) < n:
        raise ValueError("the file ends early")
    return data


def _opened(path: str) -> tuple[fs.FileSystem, str]:
    if path.startswith("file:"):
        path = "/" + path.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def _files(path: str) -> list[tuple[str, int]]:
    """Files and sizes below a folder, of a file, or that a name with ``*``, ``?`` or ``[`` matches."""
    system, at = _opened(path)
    scheme = path.split("://")[0] + "://" if "://" in path and not path.startswith("file:") else ""
    folder, name = (at.rpartition("/")[0], at) if any(c in at for c in "*?[") else (at, None)
    info = system.get_file_info(folder)
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    found = [info] if info.type == fs.FileType.File else system.get_file_info(fs.FileSelector(folder, recursive=True))
    return sorted((scheme + x.path, x.size) for x in found if x.type == fs.FileType.File and (fnmatch(x.path, name) if name else not x.base_name.startswith(("_", "."))))


class Range:
    def __init__(self, path: str, size: int, begin: int, end: int):
        self.path, self.size, self.begin, self.end = path, size, begin, end


class Ranges(InputPartition):
    """Ranges of one task: one of a long file, or several short files whole."""

    def __init__(self, parts: list[Range]):
        self.parts = parts


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.path = options["path"]
        self.unit_s, self.range_bytes = int(options.get("unitseconds", UNIT_S)), int(options.get("rangebytes", RANGE_BYTES))
        self.overlap = round(float(options.get("overlapseconds", OVERLAP_S)) * signal.RATE)
        self.peaks_only = options.get("peaksonly", "false") == "true"

    def partitions(self) -> list[Ranges]:
        """By size alone; no file is opened here. Short files share a task up to the bytes of a range."""
        tasks, held = [], self.range_bytes
        for path, size in _files(self.path):
            if size + OPEN_BYTES > self.range_bytes:
                tasks += [Ranges([Range(path, size, at, at + self.range_bytes)]) for at in range(0, max(size, 1), self.range_bytes)]
                held = self.range_bytes
                continue
            if held + size + OPEN_BYTES > self.range_bytes:
                tasks.append(Ranges([]))
                held = 0
            tasks[-1].parts.append(Range(path, size, 0, self.range_bytes))
            held += size + OPEN_BYTES
        return tasks

    def read(self, task: Ranges | None) -> Iterator[pa.RecordBatch]:
        for part in task.parts if task else ():  # or else no file at all
            yield from self._read(part)

    def _read(self, part: Range) -> Iterator[pa.RecordBatch]:
        system, path = _opened(part.path)
        *_, folder, name = f"/{part.path}".split("/")
        if folder.startswith("session_id="):
            name = unquote(folder.removeprefix("session_id="))
        with system.open_input_file(path) as file:
            try:
                head = Header(file, part.size)
            except ValueError:
                if part.begin == 0:
                    yield _batch(name, part.path, 0, 0, 0, None, None, None, None, None)
                return
            per = self.unit_s * signal.RATE
            # A unit belongs to the range in which its first byte, in the file, stands.
            begins = lambda unit: head.start + int(np.floor(unit * per * head.every)) * head.block
            units = -(-head.n_out // per) or 1
            unit = 0 if part.begin == 0 else _first(units, lambda u: begins(u) >= part.begin)
            while unit < units and (begins(unit) < part.end or (unit == 0 and part.begin == 0)):
                first = unit * per
                pcm = head.read(file, first, per + self.overlap)
                own = pcm[:per]
                if unit or part.begin == 0:
                    top = float(np.abs(own).max()) if own.size else 0.0
                    yield _batch(name, part.path, unit, first, own.size, head.n_out, head.n / head.rate, head.rate, top, None if self.peaks_only else pcm)
                unit += 1


def _first(n: int, holds) -> int:
    """The least number below ``n`` for which a condition that stays true holds, or ``n``."""
    low, high = 0, n
    while low < high:
        middle = (low + high) // 2
        low, high = (low, middle) if holds(middle) else (middle + 1, high)
    return low


_ARROW = pa.schema(
    [
        ("session_id", pa.string()), ("path", pa.string()), ("unit", pa.int64()), ("first", pa.int64()), ("n_own", pa.int32()), ("n_samples", pa.int64()),
        ("duration_s", pa.float64()), ("source_rate", pa.int32()), ("peak", pa.float32()), ("pcm", pa.list_(pa.float32())),
    ]
)


def _batch(*row) -> pa.RecordBatch:
    *plain, pcm = row
    last = pa.array([None], _ARROW.field("pcm").type) if pcm is None else pa.ListArray.from_arrays(pa.array([0, pcm.size], pa.int32()), pa.array(pcm))
    return pa.RecordBatch.from_arrays([*(pa.array([x], f.type) for x, f in zip(plain, _ARROW)), last.cast(_ARROW.field("pcm").type)], schema=_ARROW)


class WaveUnits(DataSource):
    """``spark.read.format("wave_units")`` with the options ``path``, ``unitSeconds``, ``overlapSeconds``, ``rangeBytes``, ``peaksOnly``."""

    @classmethod
    def name(cls) -> str:
        return "wave_units"

    def schema(self) -> str:
        return UNITS

    def reader(self, schema) -> _Reader:
        return _Reader({k.lower(): v for k, v in self.options.items()})


def _read(spark: SparkSession, path: str, peaks_only: bool, **options) -> DataFrame:
    spark.dataSource.register(WaveUnits)
    reader = spark.read.format("wave_units").option("path", path).option("peaksOnly", str(peaks_only).lower())
    for name, value in options.items():
        reader = reader.option(name, str(value))
    return reader.load()


def units(spark: SparkSession, path: str, unit_s: int = UNIT_S, overlap_s: float = OVERLAP_S, range_bytes: int = RANGE_BYTES, level: bool = True) -> DataFrame:
    """:data:`UNITS` of the wave files at ``path``: 16 kHz mono, quiet files leveled as a whole.

    The session is the folder's, where that is named ``session_id=``, or else the file's name. A file that isn't a PCM wave file is one row without samples. With ``level`` the files are read
    twice, first for their peaks. What is dealt by file are the units without their samples; those are read
    when the gain is known, so no sample is shuffled.
    """
    if not level:
        return _read(spark, path, False, unitSeconds=unit_s, rangeBytes=range_bytes, overlapSeconds=overlap_s)
    return _dealt(spark, path, unit_s, range_bytes).mapInArrow(_filled(unit_s, overlap_s), UNITS)


def _dealt(spark: SparkSession, path: str, unit_s: int, range_bytes: int) -> DataFrame:
    """Units without their samples, with the ``top`` of their file."""
    tops = _read(spark, path, True, unitSeconds=unit_s, rangeBytes=range_bytes, overlapSeconds=0).drop("pcm")
    tops = tops.withColumn("top", F.max("peak").over(Window.partitionBy("path")))
    # A number of its own, as the rows are small and would otherwise be put together in few tasks.
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), min(-(-sum(size for _, size in _files(path)) // range_bytes), MAX_TASKS))
    return tops.repartition(tasks, "path", "unit").sortWithinPartitions("path", "unit")


def _filled(unit_s: int, overlap_s: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A pass over :func:`_dealt` that reads the samples and levels them, a unit a batch."""
    longest = unit_s * signal.RATE + round(overlap_s * signal.RATE)

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name = file = head = None
        try:
            for b in batches:
                for row in b.to_pylist():
                    top, pcm = row.pop("top"), None
                    if row["n_samples"] is not None:
                        if row["path"] != name:
                            if file is not None:
                                file.close()
                            name = row["path"]
                            system, at = _opened(name)
                            file = system.open_input_file(at)
                            head = Header(file, file.size())
                        pcm = head.read(file, row["first"], longest)
                        if top is not None and 0 < top < 0.5:
                            pcm = (pcm.astype(float) * min(0.9 / top, 24.0)).astype(np.float32)
                    yield _batch(*row.values(), pcm)
        finally:
            if file is not None:
                file.close()

    return fill


def write(rows: DataFrame, path: str, rate: int = signal.RATE, width: int = 2, sampled: Callable[[pa.Array], np.ndarray] | None = None) -> None:
    """Write ``session_id, pcm`` rows as mono wave files, each below a folder ``session_id=``, by Spark's committer.

    A row is a file; its samples are numbers of ``width`` bytes, louder ones than 1 are cut. ``sampled`` makes
    them, a row at a time, where ``pcm`` holds what they are made from.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(b.num_rows):
                values = b.column(1)[k].values if b.column(1)[k].is_valid else pa.array([], pa.float32())
                x = (sampled(values) if sampled else values.to_numpy(zero_copy_only=False)).astype(np.float64)
                top = 1 << (8 * width - 1)
                whole = np.clip(np.round(x * top), -top, top - 1)
                raw = (whole + 128).astype(np.uint8).tobytes() if width == 1 else whole.astype("<i8").view(np.uint8).reshape(-1, 8)[:, :width].tobytes()
                head = struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + len(raw), b"WAVE", b"fmt ", 16, 1, 1, rate, rate * width, width, 8 * width, b"data", len(raw))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(k, 1), pa.array([head + raw], pa.binary())], names=["session_id", "value"])

    pcm = F.col("pcm") if sampled else F.col("pcm").cast("array<float>")
    made = rows.select(F.col("session_id").cast("string"), pcm).mapInArrow(run, "session_id string, value binary")
    files = made.select("session_id", F.col("value").cast("string").alias("value"))
    files.write.partitionBy("session_id").option("maxRecordsPerFile", 1).text(path)


def analyzed(rows: DataFrame, n_bytes: int, analyze: Callable[[str], DataFrame], **layout) -> DataFrame:
    """What ``analyze`` makes of the folder of wave files that :func:`write` makes of ``rows``, of about ``n_bytes`` together.

    More than :data:`TURN_BYTES` are written and analyzed in turns, each with some of the sessions: only its results stay, and its files go
    before those of the next one are written.
    """
    spark, turns = rows.sparkSession, -(-n_bytes // TURN_BYTES)
    deal = lambda df: df.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "session_id")
    if turns <= 1:
        path = scratch.new_path(spark, "waves")
        write(deal(rows), path, **layout)
        return analyze(path)
    kept, out = scratch.new_path(spark, "recordings"), scratch.new_path(spark, "analyzed")
    rows.withColumn("_turn", F.pmod(F.xxhash64("session_id"), F.lit(turns)).cast("int")).write.partitionBy("_turn").parquet(kept)
    for turn in range(turns):
        path = scratch.new_path(spark, "waves")
        write(deal(spark.read.parquet(kept).where(F.col("_turn") == turn).select(*rows.columns)), path, **layout)
        found = analyze(path)
        found.write.mode("append").parquet(out)
        scratch.dropped(spark, path)
    return spark.read.schema(found.schema).parquet(out)


def lengths(spark: SparkSession, path: str, unit_s: int = UNIT_S) -> DataFrame:
    """``session_id, duration_s`` of the wave files at ``path``."""
    rows = _read(spark, path, True, unitSeconds=unit_s, overlapSeconds=0)
    return rows.where("unit = 0 and duration_s is not null").select("session_id", "duration_s")


def spans(rows: DataFrame, first, count) -> DataFrame:
    """Rows of :func:`units` with ``span``: the samples from place ``first`` of the file on, of which the unit must have the first one."""
    at = first - F.col("first")
    return rows.withColumn("span", F.when((at >= 0) & (at < F.col("n_own")), F.slice("pcm", (at + 1).cast("int"), count)))


def frames(rows: DataFrame, gate: float = signal.GATE, fps: float = 1 / signal.STEP_S) -> DataFrame:
    """``schemas.FRAMES`` of :func:`units`: the same frames as ``signal.frames`` gives of the whole signal, in one Arrow pass."""
    return rows.select("session_id", "first", "n_own", "n_samples", "pcm").mapInArrow(_framing(gate, fps), signal.FRAME_ROWS)


def file_frames(spark: SparkSession, path: str, unit_s: int = UNIT_S, gate: float = signal.GATE, fps: float = 1 / signal.STEP_S, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """:func:`frames` of the :func:`units` at ``path``, read and analyzed in the same pass."""
    fill, cut = _filled(unit_s, OVERLAP_S), _framing(gate, fps)
    names = ["session_id", "first", "n_own", "n_samples", "pcm"]
    return _dealt(spark, path, unit_s, range_bytes).mapInArrow(lambda batches: cut(b.select(names) for b in fill(batches)), signal.FRAME_ROWS)


def _framing(gate: float, fps: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            plain = [c.to_pylist() for c in b.columns[:4]]
            for k, (session, first, n_own, n) in enumerate(zip(*plain)):
                pcm = signal.samples_of(b.column(4), k)
                if pcm is None or n is None or n <= signal.FRAME:
                    continue
                seconds = n / signal.RATE
                low = int(np.ceil(first * fps / signal.RATE))
                high = min(int(np.floor((first + n_own - 1) * fps / signal.RATE)), int(np.floor((seconds - signal.FRAME / signal.RATE) * fps)))
                time = np.arange(max(low - 1, 0), high + 2) / fps
                # Places are made as for the whole signal; a frame belongs to the unit that has its first sample.
                at = np.floor(time * signal.RATE).astype(np.int64) - first
                own = (at >= 0) & (at < n_own) & (at + signal.FRAME <= pcm.size) & (time + signal.FRAME / signal.RATE < seconds)
                if own.any():
                    windows = np.lib.stride_tricks.sliding_window_view(pcm, signal.FRAME)
                    yield from signal.framed([session], [time[own]], [signal.RATE], [windows[at[own]]], gate)

    return run
