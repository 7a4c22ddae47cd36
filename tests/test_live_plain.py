"""Live captions and regions' speakers on the given tables against a version of the rules in plain steps."""

import math
from statistics import median

import numpy as np

from colloquy.operators import cluster
from colloquy.plans import catalogue
from colloquy.plans import fixtures as D

DIR = "/root/testdata/sf0.001"


class Speakers:
    """Online clusters as lists: [id, log pitch, log timbre, weight, pitches]; the list of merges tells whose id went where."""

    def __init__(self):
        self.known, self.made, self.merges = [], 0, []

    def final(self, speaker):
        for gone, to in self.merges:
            speaker = to if speaker == gone else speaker
        return speaker

    @staticmethod
    def away(a, b):
        return math.sqrt((a[1] - b[1]) ** 2 + (0.2 * (a[2] - b[2])) ** 2)

    def hear(self, frames):
        frames = [(p, c) for p, c in frames if p > 0 and c > 0]
        if len(frames) < 3:
            return None
        raw = median(p for p, _ in frames)
        hz = median(p / 2 if p > 1.6 * raw else p * 2 if p < raw / 1.6 else p for p, _ in frames)
        me = [None, math.log(hz), math.log(median(c for _, c in frames)), 1, [hz]]
        near = min(self.known, key=lambda k: self.away(me, k), default=None)
        gap = math.inf if near is None else self.away(me, near)
        if gap <= 0.35:
            rate = 1 / min(near[3] + 1, 12)
            near[1] += rate * (me[1] - near[1])
            near[2] += rate * (me[2] - near[2])
            near[3] += 1
            near[4] = (near[4] + [hz])[-50:]
        elif near is None or (gap > 0.55 and len(self.known) < 8):
            near, me[0], self.made = me, self.made, self.made + 1
            self.known.append(me)
        own = near[0]
        merged = True
        while merged:
            merged = False
            for i in range(len(self.known)):
                for j in range(i + 1, len(self.known)):
                    a, b = self.known[i], self.known[j]
                    if not merged and self.away(a, b) < 0.25:
                        keep, gone = (a, b) if a[3] >= b[3] else (b, a)
                        for x in (1, 2):
                            keep[x] = (keep[x] * keep[3] + gone[x] * gone[3]) / (keep[3] + gone[3])
                        keep[3], keep[4] = keep[3] + gone[3], (keep[4] + gone[4])[-50:]
                        self.known.remove(gone)
                        self.merges.append((gone[0], keep[0]))
                        merged = True
        own = self.final(own)
        return own, median(next(k[4] for k in self.known if k[0] == own))


def captions(inputs):
    """Rows of one session after all of its inputs."""
    speakers, segments, open_, locked, shown, frames, last, since, count = Speakers(), [], None, [], [], [], -1, 0.0, 0
    for r in sorted(inputs, key=lambda r: r.seq):
        text = (r.text or "").strip()
        if r.kind == "frame":
            frames = [*frames, (r.pitch_hz, r.centroid_hz)][-600:]
        elif r.kind == "interim" and text:
            words = text.split()
            if len(words) - 1 > len(locked):
                locked = locked + words[len(locked) : len(words) - 1]
            candidate = locked + words[len(locked) :]
            shown = candidate if len(candidate) >= len(shown) else shown
            open_ = ["live-interim", last, " ".join(shown), since, r.time_s, True]
        elif r.kind == "final" and text:
            base = shown if len(shown) >= len(locked) else locked
            words = base + text.split()[len(base) :]
            match = speakers.hear(frames)
            last = speakers.final(last) if match is None else match[0]
            whole = " ".join(words)
            segments.append([f"live-{count}", last, whole[0].upper() + whole[1:], since, r.time_s, False])
            count, since, frames, locked, shown, open_ = count + 1, r.time_s, [], [], [], None
    return [(*s[:1], speakers.final(s[1]), *s[2:]) for s in segments + ([open_] if open_ else [])]


def test_live_captions(spark):
    by = {}
    for r in catalogue._live_inputs(spark, DIR).collect():
        by.setdefault(r.session_id, []).append(r)
    want = sorted(str((s, *row)) for s, own in by.items() for row in captions(own))
    got = sorted(str((r.session_id, r.seg_id, r.speaker_id, r.text, r.start_s, r.end_s, r.interim)) for r in catalogue.QUERIES["live_captions"](spark, DIR).collect())
    assert got == want and len(got) > 100


def test_region_speakers(spark):
    by = {}
    for r in D.frames(spark, DIR).collect():
        by.setdefault(r.session_id, []).append((r.time_s, r.pitch_hz, r.centroid_hz))
    want = {}
    for s, rows in by.items():
        rows.sort()
        groups = [[rows[0]]]
        for a, b in zip(rows, rows[1:]):
            groups.append([b]) if b[0] - a[0] > 0.75 else groups[-1].append(b)
        speakers, last, out = Speakers(), -1, []
        for group in groups:
            runs = cluster.jump_runs(np.array([p for _, p, _ in group]))
            for n in sorted(set(runs.tolist())):
                part = [f for f, run in zip(group, runs) if run == n]
                match = speakers.hear([f[1:] for f in part])
                last = last if match is None else match[0]
                out.append((part[0][0], part[-1][0], last, 0.0 if match is None else round(match[1], 9)))
        want[s] = [(k, a, b, speakers.final(x), hz) for k, (a, b, x, hz) in enumerate(out)]
    got = {}
    for r in catalogue.QUERIES["voiced_regions"](spark, DIR).collect():
        got.setdefault(r.session_id, []).append((r.reg_ord, r.start_s, r.end_s, r.speaker_id, round(r.median_pitch_hz, 9)))
    assert {k: sorted(v) for k, v in got.items()} == want


def test_changes_are_made_once(spark):
    """Segments and aliases both read the written changes; neither replays the sessions."""
    plan = catalogue.QUERIES["live_captions"](spark, DIR)._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInPandas" not in plan
