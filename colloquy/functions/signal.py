"""Audio frames to pitch, spectral centre and energy."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Search range, gates and bands of the analysis. Fixed values.
MIN_HZ, MAX_HZ, GATE, FAR_GATE, VOICING = 60, 400, 0.008, 0.002, 0.45
BANDS, BAND_LOW, BAND_HIGH, FRAME, STEP_S = 32, 100.0, 4000.0, 2048, 0.25
SILENT_RMS, RATE = 0.004, 16000
#: Frames that are analyzed together. Always so many, so that a frame's numbers don't depend on which others stand beside it.
BLOCK = 32


def rms(pcm: Column, every: int = 1) -> Column:
    """Root mean square of every n-th sample."""
    taken = pcm if every == 1 else F.filter(pcm, lambda x, i: i % every == 0)
    total = F.aggregate(taken, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    return F.when(F.size(taken) > 0, F.sqrt(total / F.size(taken))).otherwise(0.0)


def is_silent(pcm: Column) -> Column:
    return rms(pcm, 4) < SILENT_RMS


def peak(pcm: Column) -> Column:
    return F.coalesce(F.array_max(F.transform(pcm, lambda x: F.abs(x))).cast("double"), F.lit(0.0))


def leveled(pcm: Column) -> Column:
    """Quiet audio, with a peak under 0.5, brought to a peak of 0.9 by a gain of 24 at most."""
    top = peak(pcm)
    # As an array the gain is made once; inside the function of the samples it would be made for each of them.
    gains = F.array_repeat(F.least(F.lit(0.9) / top, F.lit(24.0)), F.size(pcm))
    return F.when((top > 0) & (top < 0.5), F.zip_with(pcm, gains, lambda x, gain: (x * gain).cast("float"))).otherwise(pcm)


def decimated(pcm: Column, rate: Column, to: int = RATE) -> Column:
    """Nearest-sample decimation."""
    n = F.floor(F.size(pcm) * F.lit(float(to)) / rate).cast("int")
    every = rate / F.lit(float(to))
    cut = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.get(pcm, F.floor(i * every).cast("int")))
    return F.when(pcm.isNull() | (rate == to), pcm).when(n > 0, cut).otherwise(F.array().cast("array<float>"))


def level(energy: Column, gate: float = FAR_GATE) -> Column:
    """Meter level: five times the energy, 1 at most, 0 below the gate."""
    return F.when(energy < gate, 0.0).otherwise(F.least(F.lit(1.0), energy * 5))


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def adapted_gains(energies: pd.Series) -> pd.Series:
    """Gain after each frame's energy: steps of 15 % at most toward 0.18, between 1 and 10; silence changes nothing."""

    def fold(values: np.ndarray | None) -> list[float] | None:
        gain, out = 1.0, []
        for e in () if values is None else values:
            if e is not None and e > 0.001:
                gain = min(10.0, max(1.0, gain * min(max(0.18 / e, 0.85), 1.15)))
            out.append(gain)
        return None if values is None else out

    return energies.map(fold)


@lru_cache(8)
def _bands(rate: float, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Centres of the bands and, as columns, cosines and sines of their turns over a frame; the same for all frames of a rate and size."""
    hz = BAND_LOW * (BAND_HIGH / BAND_LOW) ** (np.arange(BANDS) / (BANDS - 1))
    turns = 2 * np.pi * np.outer(np.arange(size), hz / rate)
    return hz, np.hstack([np.cos(turns), np.sin(turns)])


@lru_cache(8)
def _padded(least: int) -> int:
    """The next size that transforms quickly: a product of twos, threes and fives."""
    return min(2**a * 3**b * 5**c for a in range(33) for b in range(4) for c in range(4) if 2**a * 3**b * 5**c >= least)


def _block(x: np.ndarray, rate: float) -> tuple[np.ndarray, np.ndarray]:
    """Pitch and spectral centre of each row of :data:`BLOCK` frames, none of which is silent but those added at the end."""
    n = x.shape[1]
    power = np.einsum("ij,ij->i", x, x)
    power[power == 0] = 1
    low, high = int(rate // MAX_HZ), min(int(rate // MIN_HZ), n - 1)
    pitch = np.zeros(len(x))
    if high >= low:
        # All lags at once: autocorrelation by the power spectrum of frames so padded that the lags looked at don't wrap.
        size = _padded(n + high + 2)
        spectrum = np.fft.rfft(x, size)
        corr = np.fft.irfft(spectrum.real**2 + spectrum.imag**2, size)[:, : min(high + 2, n)] / power[:, None]
        seen = corr[:, low : high + 1]
        lag = low + seen.argmax(1)
        row = np.arange(len(x))
        place = lag.astype(float)
        inside = np.flatnonzero((low < lag) & (lag < high))
        left, mid, right = (corr[row[inside], lag[inside] + k] for k in (-1, 0, 1))
        bend = left - 2 * mid + right
        bent = np.abs(bend) >= 1e-9
        place[inside[bent]] += np.clip((left - right)[bent] / (2 * bend[bent]), -1, 1)
        voiced = (seen.max(1) >= VOICING) & (lag > 0)
        pitch[voiced] = rate / place[voiced]
    hz, turns = _bands(rate, n)
    parts = (x @ turns) ** 2
    bands = parts[:, :BANDS] + parts[:, BANDS:]
    total = bands.sum(1)
    centre = np.divide((bands * hz).sum(1), total, out=np.zeros(len(x)), where=total > 0)
    return pitch, centre


def analyze_all(frames: np.ndarray, rate: float, gate: float = GATE) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Places of the rows that are frames over the energy gate, and their pitch (0: unvoiced), spectral centre and energy."""
    n, size = frames.shape
    if not size:
        return np.empty(0, int), np.empty(0), np.empty(0), np.empty(0)
    at, found = [], []
    for first in range(0, n, BLOCK):
        x = frames[first : first + BLOCK].astype(float)
        energy = np.sqrt(np.einsum("ij,ij->i", x, x) / size)
        loud = np.flatnonzero((energy >= gate) & (energy > 0))
        if not loud.size:
            continue
        block = np.zeros((BLOCK, size))
        block[: loud.size] = x[loud]
        pitch, centre = _block(block, rate)
        at.append(first + loud)
        found.append((pitch[: loud.size], centre[: loud.size], energy[loud]))
    if not at:
        return np.empty(0, int), np.empty(0), np.empty(0), np.empty(0)
    return np.concatenate(at), *map(np.concatenate, zip(*found))


def analyze(frame: np.ndarray, rate: float, gate: float = GATE) -> tuple[float, float, float] | None:
    """Pitch (0: unvoiced), spectral centre and energy of one frame; None below the energy gate."""
    at, *found = analyze_all(np.asarray(frame, float)[None, :], rate, gate)
    return tuple(float(x[0]) for x in found) if at.size else None


def samples_of(pcm: pa.Array, k: int) -> np.ndarray | None:
    """The samples of an Arrow list's row, without a copy; a missing one is NaN, and frames with it are dropped."""
    return pcm[k].values.to_numpy(zero_copy_only=False) if pcm[k].is_valid else None


def framed(session: list, times: list[np.ndarray], rates: list, frames: list[np.ndarray], gate: float) -> Iterator[pa.RecordBatch]:
    """``schemas.FRAMES`` of sessions' frames, analyzed in blocks over several sessions; those under the gate are dropped."""
    by: dict = {}
    for k, rate in enumerate(rates):
        if len(times[k]):
            by.setdefault(rate, []).append(k)
    for rate, own in by.items():
        at, pitch, centre, energy = analyze_all(np.concatenate([frames[k] for k in own]), rate, gate)
        names = pa.array([session[k] for k in own], pa.string()).take(pa.array(np.repeat(np.arange(len(own)), [len(times[k]) for k in own])[at]))
        columns = [names, *map(pa.array, (np.concatenate([times[k] for k in own])[at], pitch, centre, energy))]
        yield pa.RecordBatch.from_arrays(columns, names=["session_id", "time_s", "pitch_hz", "centroid_hz", "energy"])


FRAME_ROWS = "session_id string, time_s double, pitch_hz double, centroid_hz double, energy double"
#: Samples whose frames are cut before they are analyzed; a task holds their frames.
CUT_SAMPLES = 1 << 20


def frames(audio: DataFrame, gate: float = GATE, fps: float = 1 / STEP_S, sampled: Callable[[pa.Array], pa.Array] | None = None) -> DataFrame:
    """``schemas.FRAMES`` of ``session_id, sample_rate, pcm``: 2048 samples every quarter of a second, or ``fps`` times a second.

    Live sampling has the rate of the power profile, see ``readers.duty_cycle``. Frames are cut and analyzed
    in one Arrow pass over the rows, no sample is copied for a frame outside it. ``sampled``
    makes the lists of samples of some rows, where ``pcm`` holds what they are made from.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            step = max(1, CUT_SAMPLES // 8192) if sampled else b.num_rows or 1
            for first in range(0, b.num_rows, step):
                part = b.slice(first, step)
                pcm = sampled(part.column(2)) if sampled else part.column(2)
                yield from _cut(part.column(0).to_pylist(), part.column(1).to_pylist(), pcm)

    def _cut(sessions: list, given: list, pcm: pa.Array) -> Iterator[pa.RecordBatch]:
        names, times, rates, cuts, held = [], [], [], [], 0
        for k, (session, rate) in enumerate(zip(sessions, given)):
            x = samples_of(pcm, k)
            if x is None or x.size <= FRAME or not rate:
                continue
            seconds = x.size / rate
            time = np.arange(int(np.floor((seconds - FRAME / rate) * fps)) + 1) / fps
            time = time[time + FRAME / rate < seconds]
            place = np.floor(time * rate).astype(np.int64)
            whole = place + FRAME <= x.size
            time, place = time[whole], place[whole]
            windows = np.lib.stride_tricks.sliding_window_view(x, FRAME)
            for i in range(0, len(time), CUT_SAMPLES // FRAME):
                part = slice(i, i + CUT_SAMPLES // FRAME)
                names, times, rates, cuts = [*names, session], [*times, time[part]], [*rates, rate], [*cuts, windows[place[part]]]
                held += len(time[part]) * FRAME
                if held >= CUT_SAMPLES:
                    yield from framed(names, times, rates, cuts, gate)
                    names, times, rates, cuts, held = [], [], [], [], 0
        yield from framed(names, times, rates, cuts, gate)

    return audio.select(F.col("session_id").cast("string"), "sample_rate", "pcm").mapInArrow(run, FRAME_ROWS)
