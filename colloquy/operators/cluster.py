"""Speakers from voices: online clusters of pitch and timbre, and clusters of voice vectors.

Both depend on order and on what came before, so each session is one stream of frames, or one grouped
numpy function for its vectors; sessions are spread over the cluster.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

#: Radii and bounds of the online clusters. Fixed values.
MAX_SPEAKERS, MATCH, NEW, MERGE, TIMBRE, MIN_FRAMES, SAMPLES, MEMORY = 8, 0.35, 0.55, 0.25, 0.2, 3, 50, 12
#: Adaptive threshold of vectors: modes nearer than this are one voice; bounds; small clusters. Fixed values.
ONE_VOICE, LEAST, MOST, SMALL, FIXED, ROUNDS = 0.08, 0.45, 0.8, 3, 0.6, 20
#: Vectors whose similarities are all kept for the threshold, and similarities that are held at once beyond that.
KEPT_ROWS, BLOCK_CELLS = 4096, 1 << 22
#: Cells for similarities, and what a bound must be off by to settle a threshold.
CELLS, SURE = 1 << 14, 1e-9
#: Rows of similarities that are held for merges, and what stands for a row that is gone.
KEPT_LIKE, GONE = 128, -9.0
#: How far a held row of up to a hundred dimensions may be off when it is made, what a merge adds, and when it is made again.
FIRST_OFF, STEP_OFF, FAR_OFF = 1e-5, 1e-6, 1e-4
#: Pitch jumps that split a run. Fixed values.
JUMP, AGREE, SMOOTH = 0.45, 0.2, 0.3


def folded_median(values: np.ndarray) -> float:
    raw = np.median(values)
    return float(np.median(np.where(values > raw * 1.6, values / 2, np.where(values < raw / 1.6, values * 2, values))))


class Voices:
    """Online clusters of one session; its state is small and goes to and from JSON."""

    def __init__(self, state: str | None = None):
        data = json.loads(state) if state else {}
        self.clusters: list[dict] = data.get("clusters", [])
        self.next_id: int = data.get("next_id", 0)
        self.alias: dict[int, int] = {int(k): v for k, v in data.get("alias", {}).items()}
        self.merged: list[tuple[int, int]] = []

    def state(self) -> str:
        return json.dumps({"clusters": self.clusters, "next_id": self.next_id, "alias": self.alias})

    def resolve(self, speaker: int) -> int:
        while speaker in self.alias:
            speaker = self.alias[speaker]
        return speaker

    def _nearest(self, p: float, c: float) -> tuple[float, dict | None]:
        gaps = [math.hypot(p - k["p"], (c - k["c"]) * TIMBRE) for k in self.clusters]
        if not gaps:
            return math.inf, None
        best = int(np.argmin(gaps))
        return gaps[best], self.clusters[best]

    def classify(self, pitch: np.ndarray, timbre: np.ndarray) -> tuple[int, float] | None:
        """Speaker and its median pitch for one utterance's frames; None with too few voiced ones."""
        voiced = (pitch > 0) & (timbre > 0)
        if voiced.sum() < MIN_FRAMES:
            return None
        hz = folded_median(pitch[voiced])
        p, c = math.log(hz), math.log(float(np.median(timbre[voiced])))
        gap, own = self._nearest(p, c)
        if own is not None and gap <= MATCH:
            rate = 1 / min(own["w"] + 1, MEMORY)
            own["p"] += (p - own["p"]) * rate
            own["c"] += (c - own["c"]) * rate
            own["w"] += 1
            own["hz"] = (own["hz"] + [hz])[-SAMPLES:]
        elif own is None or (gap > NEW and len(self.clusters) < MAX_SPEAKERS):
            own = {"id": self.next_id, "p": p, "c": c, "w": 1, "hz": [hz]}
            self.next_id += 1
            self.clusters.append(own)
        self._merge()
        speaker = self.resolve(own["id"])
        own = next((k for k in self.clusters if k["id"] == speaker), own)
        return speaker, float(np.median(own["hz"]))

    def _merge(self) -> None:
        """Join the first two clusters that are near, again and again; the heavier one's id stays."""
        while pair := next(
            (
                (a, b)
                for i, a in enumerate(self.clusters)
                for b in self.clusters[i + 1 :]
                if math.hypot(a["p"] - b["p"], (a["c"] - b["c"]) * TIMBRE) < MERGE
            ),
            None,
        ):
            keep, gone = sorted(pair, key=lambda k: -k["w"])
            total = keep["w"] + gone["w"]
            for x in ("p", "c"):
                keep[x] = (keep[x] * keep["w"] + gone[x] * gone["w"]) / total
            keep["w"], keep["hz"] = total, (keep["hz"] + gone["hz"])[-SAMPLES:]
            self.clusters = [k for k in self.clusters if k is not gone]
            self.alias[gone["id"]] = keep["id"]
            self.merged.append((gone["id"], keep["id"]))


def jump_runs(pitch: np.ndarray) -> np.ndarray:
    """Run numbers of a silence-free group of frames: a new run where a jump in pitch is confirmed.

    A jump counts once a second voiced frame agrees with it; a single odd frame and
    unvoiced frames stay with what is being gathered.
    """
    run, number, held, smooth, odd = np.zeros(pitch.size, int), 0, [], None, None
    for i, hz in enumerate(pitch):
        if hz <= 0:
            if held:
                held.append(i)
            else:
                run[i] = number
            continue
        x = math.log(hz)
        if smooth is None:
            smooth = x
        elif abs(x - smooth) <= JUMP:
            run[held], held, odd = number, [], None
            smooth += (x - smooth) * SMOOTH
        elif odd is not None and abs(x - odd) < AGREE:
            number += 1
            run[held], held = number, []
            smooth, odd = (odd + x) / 2, None
        else:
            run[held] = number
            held, odd = [i], x
            continue
        run[i] = number
    run[held] = number
    return run


class Regions:
    """Regions of one session as its frames pass in order: of the frames, those of the open region are held."""

    def __init__(self, gap: float):
        self.gap, self.voices, self.done = gap, Voices(), []
        self.time, self.speaker = None, -1
        self._open()

    def _open(self) -> None:
        #: Frames of the run, those that wait for a jump to be confirmed, the run's smooth pitch, and the jump's.
        self.run, self.held, self.smooth, self.odd = [], [], None, None

    def feed(self, time: float, pitch: float, timbre: float) -> None:
        if self.time is not None and time - self.time > self.gap:
            self.close()
        self.time, frame = time, (time, pitch, timbre)
        if pitch <= 0:
            (self.held or self.run).append(frame)
            return
        x = math.log(pitch)
        if self.smooth is None:
            self.smooth = x
        elif abs(x - self.smooth) <= JUMP:
            self.run, self.held, self.odd = self.run + self.held, [], None
            self.smooth += (x - self.smooth) * SMOOTH
        elif self.odd is not None and abs(x - self.odd) < AGREE:
            self._region(self.run)
            self.run, self.held, self.smooth, self.odd = self.held, [], (self.odd + x) / 2, None
        else:
            self.run += self.held
            self.held, self.odd = [frame], x
            return
        self.run.append(frame)

    def _region(self, frames: list[tuple]) -> None:
        if not frames:
            return
        time, pitch, timbre = np.array(frames).T
        match = self.voices.classify(pitch, timbre)
        self.speaker = match[0] if match else self.speaker
        self.done.append((time[0], time[-1], self.speaker, match[1] if match else 0.0))

    def close(self) -> None:
        """The open region ends, as after silence."""
        self._region(self.run + self.held)
        self._open()

    def rows(self) -> list[tuple]:
        """All regions, with the speakers that remain after all merges."""
        self.close()
        return [(a, b, self.voices.resolve(s) if s >= 0 else s, hz) for a, b, s, hz in self.done]


def voiced_regions(frames: DataFrame) -> DataFrame:
    """``schemas.REGIONS`` of every session: runs without silence, split at pitch jumps, each with its speaker.

    A region with too little voice takes the speaker before it, -1 at the start.
    Speakers are those that remain after all merges. Frames are dealt by session once and pass in order as a
    stream; of a session its regions and the open one's frames are held.
    """
    from colloquy.operators.intervals import REGION_GAP
    from colloquy.schemas import REGIONS

    names = [field.split()[0] for field in REGIONS.split(", ")]

    def table(session: str, regions: Regions) -> pd.DataFrame:
        rows = regions.rows()
        out = pd.DataFrame(rows, columns=names[2:])
        out.insert(0, "reg_ord", range(len(rows)))
        out.insert(0, "session_id", session)
        return out

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        session, regions = None, None
        for b in batches:
            for own, *frame in zip(b["session_id"], b["time_s"].tolist(), b["pitch_hz"].tolist(), b["centroid_hz"].tolist()):
                if regions is None or own != session:
                    if regions is not None:
                        yield table(session, regions)
                    session, regions = own, Regions(REGION_GAP)
                regions.feed(*frame)
        if regions is not None:
            yield table(session, regions)

    source = frames.select("session_id", "time_s", "pitch_hz", "centroid_hz")
    return source.repartition("session_id").sortWithinPartitions("session_id", "time_s").mapInPandas(run, REGIONS)


def _unit(x: np.ndarray) -> np.ndarray:
    norm = np.linalg.norm(x, axis=-1, keepdims=True)
    return x / np.where(norm == 0, 1, norm)


def _last_max(values: np.ndarray) -> int:
    return values.size - 1 - int(values[::-1].argmax())


class _Likeness:
    """Similarities of some rows to all, about, and how far they may be off.

    Rows are asked for again soon, as those that merge next are much alike. So a row is made together with others that may follow, in one product, and a
    merged row from the two it comes from. Gone rows are at :data:`GONE`.
    """

    def __init__(self, c: np.ndarray):
        self.c = c.astype(np.float32)
        self.rows, self.off = np.empty((min(KEPT_LIKE, len(c)), len(c)), np.float32), np.full(min(KEPT_LIKE, len(c)), np.inf)
        self.slot, self.owner, self.used = {}, [None] * len(self.off), np.zeros(len(self.off), int)
        self.time, self.lost = 0, np.zeros(len(c), np.float32)
        self.wide = max(1.0, c.shape[1] / 100)

    def _free(self, keep: tuple = ()) -> int:
        self.used[[self.slot[k] for k in keep if k in self.slot]] = self.time
        at = int(self.used.argmin())
        if self.owner[at] is not None:
            del self.slot[self.owner[at]]
        return at

    def of(self, k: int, like: np.ndarray, near: np.ndarray, keep: int | None = None) -> tuple[np.ndarray, float]:
        """The row of ``k``; ``keep`` is one that must stay."""
        self.time += 1
        at = self.slot.get(k)
        if at is None or self.off[at] > FAR_OFF * self.wide:
            beside = self.rows[self.slot[keep]] if keep in self.slot else None
            self._make(k, beside, like, near, keep)
            at = self.slot[k]
        self.used[at] = self.time
        return self.rows[at], float(self.off[at])

    def _make(self, k: int, beside: np.ndarray | None, like: np.ndarray, near: np.ndarray, keep: int | None) -> None:
        n, most = len(self.c), len(self.off) // 4
        wanted = [k]
        if n > most > 1:
            best = np.argpartition(like, n - most)[n - most :]
            best = best[np.argsort(-like[best])][: most // 3]
            wanted += [int(j) for pair in zip(best, near[best]) for j in pair]
            if beside is not None:
                wanted += [int(j) for j in np.argpartition(beside, n - most)[n - most :]]
        wanted = [j for j in dict.fromkeys(wanted) if j == k or (j not in self.slot and not self.lost[j])][: max(1, most)]
        made = self.c[wanted] @ self.c.T
        made += self.lost
        for j, row in zip(wanted, made):
            at = self.slot[j] if j in self.slot else self._free((keep,) if keep is not None else ())
            self.rows[at], self.off[at], self.owner[at], self.slot[j] = row, FIRST_OFF * self.wide, j, at
            self.used[at] = self.time

    def merge(self, a: int, b: int, center: np.ndarray, shares: tuple[float, float], like: np.ndarray, near: np.ndarray) -> tuple[np.ndarray, float]:
        """The row of ``a`` once it has ``center``, the ``shares`` of what both were; ``b`` is gone."""
        self.of(a, like, near)
        other, far = self.of(b, like, near, a)
        mine, off = self.rows[self.slot[a]], self.off[self.slot[a]]
        mine *= np.float32(shares[0])
        mine += np.float32(shares[1]) * other
        self.c[a], self.lost[b] = center, GONE
        self.off[self.slot[a]] = off = off * shares[0] + far * shares[1] + STEP_OFF * sum(shares)
        at = self.slot.pop(b)
        self.owner[at], self.used[at] = None, -1
        held = list(self.slot)
        slots = [self.slot[j] for j in held]
        self.rows[slots, a] = self.c[held] @ self.c[a]
        self.rows[:, b] = GONE
        return mine, float(off)


def _join_nearest(groups: list[list[int]], centers: list[np.ndarray], least: float, until: int) -> None:
    """Merge the most alike pair, in place, while it is at least ``least`` alike and more than ``until`` remain.

    Of pairs as much alike, the last in order goes first. No matrix of similarities is kept: each row knows
    its nearest later row. A merge renews the merged row and whatever has become nearer to it; a row whose
    nearest one is gone or has moved off keeps its old similarity as a bound, and looks again only
    when that bound is the best of all. Rows that may be nearest or nearer come from :class:`_Likeness`; their exact products decide.
    """
    if len(groups) <= until:
        return
    c, sizes = np.array(centers), np.array([len(g) for g in groups])
    rows, left = list(groups), len(groups)
    near, like = _nearest_later(c)
    alive, about = np.ones(left, bool), _Likeness(c)
    #: How often a row has moved or gone, and what that was of its nearest row when it looked.
    moves, seen = np.zeros(left, int), np.zeros(left, int)

    def nearest(a: int, row: np.ndarray, off: float) -> None:
        """The nearest later row of ``a``, the last of several."""
        near[a], like[a], later = 0, -np.inf, row[a + 1 :]
        best = later.max(initial=GONE)
        if best > GONE / 2:
            at = a + 1 + np.flatnonzero(later >= best - 2 * off)
            at = at[alive[at]]
            sims = c[at] @ c[a]
            k = _last_max(sims)
            near[a], like[a] = at[k], sims[k]
        seen[a] = moves[near[a]]

    while left > until:
        a = _last_max(like)
        if not like[a] >= least:
            break
        b = int(near[a])
        if seen[a] != moves[b]:
            nearest(a, *about.of(a, like, near))
            continue
        total = c[a] * sizes[a] + c[b] * sizes[b]
        length = np.linalg.norm(total) or 1.0
        c[a] = total / length
        row, off = about.merge(a, b, c[a], (sizes[a] / length, sizes[b] / length), like, near)
        sizes[a] += sizes[b]
        rows[a] = rows[a] + rows[b]
        alive[b], like[b], left = False, -np.inf, left - 1
        moves[[a, b]] += 1
        nearest(a, row, off)
        at = np.flatnonzero(row[:a] >= like[:a] - off)
        at = at[alive[at]]
        sims = c[at] @ c[a]
        fresh = seen[at] == moves[near[at]]
        nearer = (sims > like[at]) | ((sims == like[at]) & (near[at] < a) & fresh)
        at, sims = at[nearer], sims[nearer]
        near[at], like[at], seen[at] = a, sims, moves[a]
        if left < alive.size // 2:
            place = np.cumsum(alive) - 1
            keep = np.flatnonzero(alive)
            fresh = seen == moves[near]
            near, c, sizes, like, rows = place[near][keep], c[keep], sizes[keep], like[keep], [rows[k] for k in keep]
            moves, seen, alive, about = np.zeros(left, int), np.where(fresh[keep], 0, -1), np.ones(left, bool), _Likeness(c)
    keep = np.flatnonzero(alive)
    groups[:], centers[:] = [rows[k] for k in keep], list(c[keep])


def _nearest_later(c: np.ndarray, block: int = 512) -> tuple[np.ndarray, np.ndarray]:
    """For each row the later one that is most alike, the last of several, and how much."""
    n, back = len(c), c[::-1].copy()
    block = min(block, max(16, BLOCK_CELLS // n))
    near, like = np.zeros(n, int), np.full(n, -np.inf)
    for k in range(0, n, block):
        sims = c[k : k + block] @ back[: n - k].T
        b = len(sims)
        sims[:, n - k - b :][np.tril_indices(b)[0], b - 1 - np.tril_indices(b)[1]] = -np.inf
        best = sims.argmax(1)
        near[k : k + block], like[k : k + block] = n - 1 - best, sims[np.arange(b), best]
    return near, like


def _similarities(x: np.ndarray, block: int = 512) -> np.ndarray:
    """Similarities of all pairs of rows, each once, in one flat array."""
    n, at = len(x), 0
    out = np.empty(n * (n - 1) // 2)
    for k in range(0, n, block):
        sims = x[k : k + block] @ x[k:].T
        for i in range(len(sims)):
            own = sims[i, i + 1 :]
            out[at : at + own.size] = own
            at += own.size
    return out


def _numbered(groups: list[list[int]], n: int) -> np.ndarray:
    """Cluster numbers by first appearance."""
    out = np.full(n, -1)
    for k, group in enumerate(sorted(groups, key=min)):
        out[group] = k
    return out


def _present(vectors: list) -> tuple[list[int], np.ndarray]:
    at = [i for i, v in enumerate(vectors) if v is not None and len(v)]
    return at, _unit(np.array([np.asarray(vectors[i], float) for i in at])) if at else np.empty((0, 0))


def threshold(sims: np.ndarray) -> float | None:
    """From the two modes of similarities; None if they are one."""
    lo, hi = sims.min(), sims.max()
    for _ in range(ROUNDS):
        low = sims < (lo + hi) / 2
        if low.all() or not low.any():
            break
        lo, hi = sims[low].mean(), sims[~low].mean()
    return None if hi - lo < ONE_VOICE else float(min(MOST, max(LEAST, (lo + hi) / 2)))


class _Cells:
    """Counts and sums of values by :data:`CELLS` cells of equal width; a cell that is looked into has cells of its own, or its values."""

    def __init__(self, low: float, width: float):
        self.low, self.width, self.inner = low, width, {}
        self.count, self.total = np.zeros(CELLS, np.int64), np.zeros(CELLS)

    def place(self, values: np.ndarray) -> np.ndarray:
        return np.clip((values - self.low) * (CELLS / self.width), 0, CELLS - 1).astype(np.intp)

    def add(self, values: np.ndarray) -> None:
        at = self.place(values)
        self.count += np.bincount(at, minlength=CELLS)
        self.total += np.bincount(at, values, CELLS)

    def close(self) -> None:
        self.counts, self.totals = (np.concatenate([[0], np.cumsum(x)]) for x in (self.count, self.total))
        self.n = int(self.counts[-1])

    def below(self, middle: float, needed: set) -> tuple[float, float]:
        """How many values are under ``middle``, and their sum. An estimate, if cells are ``needed``: those are then looked into."""
        at, edge = int(self.place(middle)), self.width / CELLS / 20
        n, total = self.counts[at], self.totals[at]
        own = self.inner.get(at)
        if isinstance(own, _Cells):
            inside = own.below(middle, needed)
        elif own is not None:
            k = int(np.searchsorted(own[0], middle))
            inside = k, own[1][k]
        elif self.count[at] and self.width / CELLS > 1e-15:
            needed.update((self, j) for j in map(int, self.place(np.array([middle - edge, middle, middle + edge]))) if self.count[j] and j not in self.inner)
            share = min(1.0, max(0.0, (middle - self.low) * CELLS / self.width - at))
            inside = share * self.count[at], share * self.total[at]
        else:  # as good as one value
            inside = (self.count[at], self.total[at]) if self.count[at] and self.total[at] / self.count[at] < middle else (0, 0.0)
        return n + inside[0], total + inside[1]

    def look(self, values: np.ndarray, new: dict) -> None:
        """``values`` to the ``new`` cells or lists within."""
        at = self.place(values)
        for j, own in self.inner.items():
            if (self, j) in new:
                (own.add if isinstance(own, _Cells) else own.append)(values[at == j])
            elif isinstance(own, _Cells):
                own.look(values[at == j], new)


def _rounds(lo: float, hi: float, count: int, below) -> tuple[float, float]:
    """The two modes from the least and largest value, by counts and sums of the values below their middle."""
    for _ in range(ROUNDS):
        n_below, under, total = below((lo + hi) / 2)
        if n_below <= 0 or n_below >= count:
            break
        before = lo, hi
        lo, hi = under / n_below, (total - under) / (count - n_below)
        if before == (lo, hi):
            break
    return lo, hi


def _bounded(cells: _Cells, lo: float, hi: float) -> tuple[bool, float | None]:
    """Whether the counts of whole cells alone settle the threshold, and what it is then.

    Both modes' means only rise with the middle, so those for the cell's lower edge and for its upper one bound them, round by round.
    """
    low, high = (lo, hi), (lo, hi)
    for _ in range(ROUNDS):
        found = []
        for modes, upper in ((low, 0), (high, 1)):
            at = int(cells.place(sum(modes) / 2)) + upper
            n, under = int(cells.counts[at]), cells.totals[at]
            if not 0 < n < cells.n:
                return False, None
            found.append((under / n, (cells.totals[-1] - under) / (cells.n - n)))
        low, high = found
    middle, gap = (sum(low) / 2, sum(high) / 2), (low[1] - high[0], high[1] - low[0])
    if gap[1] < ONE_VOICE - SURE:
        return True, None
    if gap[0] > ONE_VOICE + SURE and middle[1] < LEAST - SURE:
        return True, LEAST
    if gap[0] > ONE_VOICE + SURE and middle[0] > MOST + SURE:
        return True, MOST
    return False, None


def _threshold_of(x: np.ndarray) -> float | None:
    """:func:`threshold` of the similarities of all pairs of rows.

    Those of many rows are counted and summed in cells, a block at a time. That mostly settles a threshold beyond its bounds; for
    one between them they are made again for the cells in which a round's middle lies, until it is exact.
    """
    n = len(x)
    if n <= KEPT_ROWS:
        return threshold(_similarities(x))
    if not np.isfinite(x).all():
        return LEAST
    block = min(512, max(16, BLOCK_CELLS // n))

    def parts() -> Iterator[np.ndarray]:
        for k in range(0, n, block):
            sims = x[k : k + block] @ x[k:].T
            b = len(sims)
            yield sims[:, :b][np.triu_indices(b, 1)]
            step = max(1, 8 * CELLS // n)
            for i in range(0, b if sims.shape[1] > b else 0, step):
                yield sims[i : i + step, b:].ravel()

    lo, hi, cells = np.inf, -np.inf, _Cells(-1.0, 2.0)
    for part in parts():
        if part.size:
            lo, hi = min(lo, part.min()), max(hi, part.max())
            cells.add(part)
    cells.close()
    settled, found = _bounded(cells, lo, hi)
    if settled:
        return found
    while True:
        needed: set = set()
        modes = _rounds(lo, hi, cells.n, lambda m: (*cells.below(m, needed), cells.totals[-1]))
        if not needed:
            break
        listed = sum(int(own.count[j]) for own, j in needed) <= BLOCK_CELLS
        for own, j in needed:
            own.inner[j] = [] if listed else _Cells(own.low + j * own.width / CELLS, own.width / CELLS)
        wanted = np.zeros(CELLS, bool)
        wanted[list(cells.inner)] = True
        for part in parts():
            cells.look(part[wanted[cells.place(part)]], needed)
        for own, j in needed:
            if listed:
                values = np.sort(np.concatenate(own.inner[j]))
                own.inner[j] = values, np.concatenate([[0.0], np.cumsum(values)])
            else:
                own.inner[j].close()
    lo, hi = modes
    return None if hi - lo < ONE_VOICE else float(min(MOST, max(LEAST, (lo + hi) / 2)))


def _alike(x: np.ndarray) -> tuple[list[list[int]], list[np.ndarray]]:
    """Groups of equal rows by first appearance, and their rows: these merge before all others, and their center stays. Rows of zeros are like no row."""
    known = np.column_stack([x, np.where(x.any(axis=1), -1, np.arange(len(x)))])
    _, first, own = np.unique(known, axis=0, return_index=True, return_inverse=True)
    order = np.argsort(first)
    place = np.empty(len(first), int)
    place[order] = np.arange(len(first))
    groups: list[list[int]] = [[] for _ in first]
    for i, k in enumerate(place[own.ravel()].tolist()):
        groups[k].append(i)
    return groups, list(x[first[order]])


def adaptive_labels(vectors: list, most: int = MAX_SPEAKERS) -> np.ndarray:
    """Clusters of vectors by a threshold that their own similarities give; -1 without a vector."""
    out = np.full(len(vectors), -1)
    at, x = _present(vectors)
    if len(at) < 2:
        out[at] = 0
        return out
    limit = _threshold_of(x)
    if limit is None:
        out[at] = 0
        return out
    groups, centers = _alike(x)
    _join_nearest(groups, centers, limit, 1)
    c, alive = np.array(centers), np.ones(len(groups), bool)
    for k in range(len(groups) - 1, -1, -1):  # the smallest join what is nearest, from the last on
        if alive.sum() > 1 and len(groups[k]) < SMALL:
            alive[k] = False
            to = int(np.where(alive, c @ c[k], -np.inf).argmax())
            groups[to] = groups[to] + groups[k]
    groups, centers = [groups[k] for k in np.flatnonzero(alive)], list(c[alive])
    _join_nearest(groups, centers, -1.0, most)
    groups.sort(key=min)
    means = _unit(np.array([x[g].mean(0) for g in groups]))
    out[at] = (x @ means.T).argmax(1)
    return out


def fixed_labels(vectors: list, limit: float = FIXED, most: int = MAX_SPEAKERS) -> np.ndarray:
    """Clusters of vectors by a fixed threshold; -1 without a vector."""
    out = np.full(len(vectors), -1)
    at, x = _present(vectors)
    groups, centers = _alike(x) if limit < 1 - SURE and at else ([[i] for i in range(len(x))], list(x))
    if groups:
        _join_nearest(groups, centers, limit, 1)
        _join_nearest(groups, centers, -1.0, most)
        out[at] = _numbered(groups, len(x))
    return out


def cluster_vectors(vectors: DataFrame, adaptive: bool = True, most: int = MAX_SPEAKERS, limit: int | None = None) -> DataFrame:
    """``session_id, win_ord, label`` of every session's vectors.

    Windows are made 400 to a session at most. A longer session takes time by the square of its vectors, as each merge
    looks at all that remain, but memory in proportion to them. One of more than ``limit`` vectors, if that is given, is refused.
    """

    def one(frame: pd.DataFrame) -> pd.DataFrame:
        if limit is not None and len(frame) > limit:
            raise ValueError(f"more than {limit} vectors in session {frame['session_id'].iat[0]}")
        frame = frame.sort_values("win_ord", kind="stable")
        labels = (adaptive_labels if adaptive else fixed_labels)(frame["vector"].tolist(), most=most)
        return pd.DataFrame({"session_id": frame["session_id"], "win_ord": frame["win_ord"], "label": labels})

    return vectors.select("session_id", "win_ord", "vector").groupBy("session_id").applyInPandas(one, "session_id string, win_ord bigint, label int")
