"""Clusters of vectors against a plain version that looks at every pair again after every merge, regions against whole arrays."""

import time

import numpy as np
import pytest

from colloquy.operators import cluster


def plain(vectors, adaptive, most=8):
    out = [-1] * len(vectors)
    at = [i for i, v in enumerate(vectors) if v is not None and len(v)]
    unit = lambda v: v / (np.linalg.norm(v) or 1)
    x = [unit(np.array(vectors[i], float)) for i in at]
    groups, centers = [[i] for i in range(len(x))], list(x)
    limit = 0.6
    if adaptive:
        if len(at) < 2:
            return [0 if i in at else -1 for i in range(len(vectors))]
        limit = cluster.threshold(np.array([x[i] @ x[j] for i in range(len(x)) for j in range(i + 1, len(x))]))
        if limit is None:
            return [0 if i in at else -1 for i in range(len(vectors))]

    def join(least, until):
        while len(groups) > until:
            s, a, b = max((float(centers[a] @ centers[b]), a, b) for a in range(len(groups)) for b in range(a + 1, len(groups)))
            if s < least:
                return
            na, nb = len(groups[a]), len(groups[b])
            centers[a] = unit((centers[a] * na + centers[b] * nb) / (na + nb))
            groups[a] = groups[a] + groups[b]
            del groups[b], centers[b]

    join(limit, 1)
    if adaptive:
        for k in range(len(groups) - 1, -1, -1):
            if len(groups) > 1 and len(groups[k]) < 3:
                to = max((float(centers[j] @ centers[k]), -j) for j in range(len(groups)) if j != k)[1]
                groups[-to] = groups[-to] + groups[k]
                del groups[k], centers[k]
    join(-1.0, most)
    groups.sort(key=min)
    for n, group in enumerate(groups):
        for i in group:
            out[at[i]] = n
    if adaptive:
        means = [unit(np.mean([x[i] for i in g], axis=0)) for g in groups]
        for i, v in enumerate(x):
            out[at[i]] = int(np.argmax([v @ m for m in means]))
    return out


@pytest.mark.parametrize("adaptive", [True, False])
@pytest.mark.parametrize("kind", ["noise", "voices", "few"])
def test_plain(adaptive, kind):
    for seed in range(12):
        rnd = np.random.default_rng(seed)
        n, d = int(rnd.integers(1, 40)), int(rnd.integers(2, 10))
        x = rnd.standard_normal((n, d))
        if kind != "noise":
            x = rnd.standard_normal((3, d))[rnd.integers(0, 3, n)] * 2 + 0.6 * x
        if kind == "few":
            x = x[: max(1, n // 8)]
        vectors = [None if rnd.random() < 0.05 else row.tolist() for row in x] + [[]]
        labels = (cluster.adaptive_labels if adaptive else cluster.fixed_labels)(vectors)
        assert labels.tolist() == plain(vectors, adaptive), (kind, seed)


def test_many_vectors():
    """4,000 vectors take seconds: the matrix of similarities is not copied for each merge."""
    rnd = np.random.default_rng(1)
    x = rnd.standard_normal((4000, 64)).tolist()
    began = time.monotonic()
    labels = cluster.fixed_labels(x)
    assert time.monotonic() - began < 20 and len(set(labels.tolist())) <= 8


def test_long_sessions(spark, monkeypatch):
    """More vectors than whose similarities are kept: the same threshold and labels, a block at a time; no session is refused."""
    rnd = np.random.default_rng(3)
    x = rnd.standard_normal((5, 12))[rnd.integers(0, 5, 5000)] + 0.4 * rnd.standard_normal((5000, 12))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    assert abs(cluster._threshold_of(x) - cluster.threshold(cluster._similarities(x))) < 1e-12
    want = cluster.adaptive_labels(list(x[:700])).tolist(), cluster.fixed_labels(list(x[:700])).tolist()
    monkeypatch.setattr(cluster, "KEPT_ROWS", 50)
    monkeypatch.setattr(cluster, "BLOCK_CELLS", 20_000)
    assert (cluster.adaptive_labels(list(x[:700])).tolist(), cluster.fixed_labels(list(x[:700])).tolist()) == want
    rows = spark.createDataFrame([("s", k, v.tolist()) for k, v in enumerate(x)], "session_id string, win_ord bigint, vector array<double>")
    for adaptive in (True, False):
        got = cluster.cluster_vectors(rows, adaptive).collect()
        assert sorted(r.win_ord for r in got) == list(range(5000)) and 1 < len({r.label for r in got}) <= 8


@pytest.mark.parametrize("kept", [2, 5, 16])
def test_held_rows(monkeypatch, kept):
    """Few held rows of similarities, made again when they are off, and sessions of near copies: the same clusters as by all pairs."""
    monkeypatch.setattr(cluster, "KEPT_LIKE", kept)
    for seed in range(6):
        monkeypatch.setattr(cluster, "FAR_OFF", (1e-4, 1.5e-5)[seed % 2])
        rnd = np.random.default_rng(seed)
        n, d = int(rnd.integers(30, 60)), int(rnd.integers(3, 12))
        x = rnd.standard_normal((9, d))[rnd.integers(0, 9, n)] + (0.02, 0.3)[seed % 3 == 0] * rnd.standard_normal((n, d))
        vectors = [row.tolist() for row in x]
        assert cluster.adaptive_labels(vectors).tolist() == plain(vectors, True) and cluster.fixed_labels(vectors).tolist() == plain(vectors, False)


def test_equal_vectors():
    """Copies of a vector are one group from the start: the same clusters as by all pairs, and many copies take no merges."""
    for seed in range(8):
        rnd = np.random.default_rng(seed)
        x = rnd.standard_normal((12, 5))[rnd.integers(0, 12, 45)]
        x[:9] += 0.2 * rnd.standard_normal((9, 5))
        vectors = [row.tolist() for row in x] + [None, [0.0] * 5, [0.0] * 5]
        assert cluster.adaptive_labels(vectors).tolist() == plain(vectors, True) and cluster.fixed_labels(vectors).tolist() == plain(vectors, False)
    x = np.random.default_rng(1).standard_normal((300, 64))[np.arange(30_000) % 300]
    began = time.process_time()
    labels = cluster.fixed_labels(list(x))
    assert time.process_time() - began < 5 and labels[:300].tolist() * 100 == labels.tolist() and len(set(labels.tolist())) == 8


def test_threshold_by_cells(monkeypatch):
    """Similarities in cells give the threshold of all of them, settled by bounds or looked into; they are not made again for each round."""
    rnd = np.random.default_rng(5)
    x = rnd.standard_normal((12_000, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    began = time.process_time()
    assert cluster._threshold_of(x) == cluster.LEAST and time.process_time() - began < 10
    bounded, between = cluster._bounded, 0
    monkeypatch.setattr(cluster, "KEPT_ROWS", 10)
    for k in range(60):
        monkeypatch.setattr(cluster, "CELLS", int(rnd.choice([16, 256, 1 << 14])))
        monkeypatch.setattr(cluster, "BLOCK_CELLS", int(rnd.choice([3, 2000, 1 << 22])))
        monkeypatch.setattr(cluster, "_bounded", bounded if k % 2 else lambda *_: (False, None))
        n, voices, d = int(rnd.integers(20, 500)), int(rnd.integers(1, 5)), int(rnd.integers(2, 30))
        y = cluster._unit(rnd.standard_normal((voices, d))[rnd.integers(0, voices, n)] + float(rnd.choice([0, 0.05, 0.4, 1])) * rnd.standard_normal((n, d)))
        got, want = cluster._threshold_of(y), cluster.threshold(cluster._similarities(y))
        assert got == want if want is None or got is None else abs(got - want) < 1e-11
        between += want is not None and cluster.LEAST < want < cluster.MOST
    assert between > 5
    y[3, 0] = np.nan
    assert cluster._threshold_of(y) == cluster.threshold(cluster._similarities(y)) == cluster.LEAST


def test_given_vectors(spark):
    """The registered queries on the smallest tables."""
    from colloquy.plans import catalogue
    from colloquy.plans import fixtures as D

    for name, adaptive in (("adaptive_clusters", True), ("fixed_clusters", False)):
        got = {(r.session_id, r.win_ord): r.label for r in catalogue.QUERIES[name](spark, "/root/testdata/sf0.001").collect()}
        by = {}
        for r in sorted(D.vectors(spark, "/root/testdata/sf0.001").collect(), key=lambda r: r.win_ord):
            by.setdefault(str(r.win_ord % 5), []).append((r.win_ord, r.vector))
        assert got == {(s, i): label for s, own in by.items() for (i, _), label in zip(own, plain([v for _, v in own], adaptive), strict=True)}


def plain_regions(rows):
    """Regions of one session from its whole arrays of time, pitch and timbre."""
    time_, pitch, timbre = np.array(sorted(rows)).T
    voices, out, last = cluster.Voices(), [], -1
    for group in np.split(np.arange(time_.size), np.flatnonzero(np.diff(time_) > 0.75) + 1):
        runs = cluster.jump_runs(pitch[group])
        for part in np.split(group, np.flatnonzero(np.diff(runs)) + 1):
            match = voices.classify(pitch[part], timbre[part])
            last = match[0] if match else last
            out.append((time_[part[0]], time_[part[-1]], last, match[1] if match else 0.0))
    return [(k, a, b, voices.resolve(s) if s >= 0 else s, hz) for k, (a, b, s, hz) in enumerate(out)]


def test_streamed_regions(spark):
    """Random sessions, silences, jumps and unvoiced frames, and the frames of the given tables."""
    from colloquy import schemas
    from colloquy.operators import cluster as C
    from colloquy.plans import fixtures as D

    rnd, rows = np.random.default_rng(2), []
    for s in range(30):
        at, hz = 0.0, 120.0
        for _ in range(int(rnd.integers(1, 200))):
            at = round(at + float(rnd.choice([0.25, 0.25, 0.25, 0.75, 0.8])), 2)
            hz = float(rnd.choice([hz, hz, hz * 1.05, 90.0, 210.0, 400.0]))
            rows.append((f"s{s}", at, float(rnd.choice([hz, hz, hz, 0.0])), float(rnd.uniform(300, 900)), 0.1))
    given = D.frames(spark, "/root/testdata/sf0.001").select("session_id", "time_s", "pitch_hz", "centroid_hz", "energy")
    for table in (spark.createDataFrame(rows, schemas.FRAMES).repartition(5), given):
        by = {}
        for r in table.collect():
            by.setdefault(r.session_id, []).append((r.time_s, r.pitch_hz, r.centroid_hz))
        got = {}
        for r in C.voiced_regions(table).collect():
            got.setdefault(r.session_id, []).append((r.reg_ord, r.start_s, r.end_s, r.speaker_id, r.median_pitch_hz))
        assert {k: sorted(v) for k, v in got.items()} == {k: plain_regions(v) for k, v in by.items()}
