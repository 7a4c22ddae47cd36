"""Hard-negative mining: for an anchor and a positive, the best rows of other labels inside a window of scores.

Anchors are taken in blocks of bounded size, each against all rows. What a window keeps is found by a
distributed radix selection: tasks count scores in the window's buckets, the counts' sums tell
the bucket of the last score that is kept, and that bucket is split again until it holds one score;
then only rows that qualify are gathered. A task leaves out buckets below its own best rows, as the
last score of all rows can't lie below the last of some.

Scores are exact integer inner products: by floating point where no sum can leave its exact range
of 2^53, by Python integers elsewhere. A score beyond a 64-bit integer doesn't take part.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from colloquy.llm.shared import forget, shared_path, shuffle_cleanup, written

#: Anchors of one pass, which bounds what the driver and a task know of them.
ANCHOR_BLOCK = 1024
#: Rows scored at once in a task.
ROW_BLOCK = 4096
#: Bits of a score decided by one round.
DIGIT = 8
POSITIVES, NEGATIVES = 5, 10
#: A negative scores between these parts of a hundred of the positive's score.
LOW, HIGH = 30, 90
#: Components are floor(SCALE * x).
SCALE = 256
LONG = (1 << 63) - 1

COUNTS = "window int, bucket int, n long"
FOUND = "window int, id long, score long"
RESULT = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"


def usable(vectors: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """Rows that take part as ``(id, label, vector)``, one for each id.

    A row without an id, a label or a vector, or with a null or non-finite component, takes no part. Of
    rows with one id, that with the least label and then the least vector counts.
    """
    x = F.col(f"`{vector}`").cast("array<double>")
    rows = vectors.select(F.col(f"`{vec_id}`").cast("long").alias("id"), F.col(f"`{label}`").alias("label"), x.alias("vector")).where(
        F.col("id").isNotNull() & F.col("label").isNotNull() & F.forall("vector", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(math.inf)))
    )
    twice = rows.groupBy("id").count().where("count > 1").select("id")
    if twice.isEmpty():
        return rows
    twice = written(twice, "repeated-ids")
    one = rows.join(twice, "id", "left_semi").groupBy("id").agg(F.min(F.struct("label", "vector")).alias("x")).select("id", "x.label", "x.vector")
    return written(rows.join(twice, "id", "left_anti").unionByName(one), "vectors")


def whole(values: np.ndarray, exact: bool) -> np.ndarray:
    """floor(SCALE * x), as doubles or as Python integers."""
    if exact:
        return np.floor(values * SCALE)
    flat = [math.floor(x) * SCALE if abs(x) >= 1 << 53 else math.floor(x * SCALE) for x in values.ravel().tolist()]
    out = np.empty(len(flat), object)
    out[:] = flat
    return out.reshape(values.shape)


def _vectors(lists: pa.ListArray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Positions and matrix of the vectors of each length."""
    flat = lists.flatten().to_numpy(zero_copy_only=False)
    sizes = np.diff(lists.offsets.to_numpy())
    starts = np.cumsum(sizes) - sizes
    for size in np.unique(sizes):
        at = np.flatnonzero(sizes == size)
        yield at, flat[starts[at][:, None] + np.arange(size)]


class Anchors:
    """One block of anchors: ids, labels and vectors by length."""

    def __init__(self, rows: list, largest: float):
        self.ids = np.array([r.id for r in rows], np.int64)
        self.labels = [r.label for r in rows]
        by: dict[int, list[int]] = {}
        for k, r in enumerate(rows):
            by.setdefault(len(r.vector), []).append(k)
        length = max(by)
        top = max(abs(x) for r in rows for x in (*r.vector, 0.0))
        #: No score's magnitude is larger.
        self.bound = min(LONG, max(1, length) * (math.floor(top) + 1) * (math.floor(largest) + 1) * SCALE * SCALE)
        self.exact = self.bound < 1 << 53
        self.by = {n: (np.array(own), whole(np.array([rows[k].vector for k in own], float).reshape(len(own), n), self.exact)) for n, own in by.items()}

    def scores(self, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        """For blocks of rows and each anchor of their length: its number, the rows' scores, ids and whether their label is the anchor's."""
        numbers: dict = {}
        for label in self.labels:
            numbers.setdefault(label, len(numbers))
        own = np.array([numbers[x] for x in self.labels])
        for b in _blocks(batches):
            ids = b.column("id").to_numpy()
            labels = np.array([numbers.get(x, -1) for x in b.column("label").to_pylist()])
            for at, matrix in _vectors(b.column("vector")):
                if matrix.shape[1] not in self.by:
                    continue
                anchors, known = self.by[matrix.shape[1]]
                found = known @ whole(matrix, self.exact).T
                for k, row in zip(anchors.tolist(), found, strict=True):
                    if self.exact:
                        yield k, row.astype(np.int64), ids[at], labels[at] == own[k]
                    else:
                        fits = np.array([-LONG <= x <= LONG for x in row], bool)
                        yield k, row[fits].astype(np.int64), ids[at][fits], labels[at][fits] == own[k]


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held, n = [], 0
    for b in batches:
        for at in range(0, b.num_rows, ROW_BLOCK):
            held.append(b.slice(at, ROW_BLOCK))
            n += held[-1].num_rows
            if n >= ROW_BLOCK:
                yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                held, n = [], 0
    if n:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


class Windows:
    """Windows of scores: whose anchor, the same or other labels, bounds, and how many rows each keeps.

    A round narrows ``low`` and ``high`` to the bucket of the last row that is kept; ``need`` is how many
    rows of that bucket are kept.
    """

    def __init__(self, anchor: list[int], same: bool, low: list[int], high: list[int], keep: int):
        self.anchor, self.same, self.keep = np.array(anchor, np.int64), same, keep
        self.low, self.high = np.array(low, np.int64), np.array(high, np.int64)
        self.top = self.high.copy()
        self.need = np.where(self.low <= self.high, keep, 0)
        self.shift = self._shift()
        self.of: dict[int, list[int]] = {}
        for w, k in enumerate(anchor):
            self.of.setdefault(k, []).append(w)

    def _shift(self) -> np.ndarray:
        return np.array([max(0, (int(h) - int(x)).bit_length() - DIGIT) if h >= x else 0 for x, h in zip(self.low, self.high, strict=True)], np.uint64)

    def offsets(self, w: int, scores: np.ndarray) -> np.ndarray:
        """Distances from the window's low bound; they wrap to unsigned ones, so that no range overflows."""
        with np.errstate(over="ignore"):
            return (scores - self.low[w]).view(np.uint64)

    def narrow(self, found: list) -> bool:
        """Take the located buckets ``(window, bucket, rows above it)``; whether another round is needed.

        A window that isn't among them has fewer rows than it keeps: all of them stay.
        """
        more = False
        located = {r.window: r for r in found}
        for w in np.flatnonzero(self.need > 0).tolist():
            if w not in located:
                self.need[w] = 0  # what is left lies between low and top
                continue
            r, shift = located[w], int(self.shift[w])
            low = int(self.low[w]) + (r.bucket << shift)
            self.high[w] = min(int(self.high[w]), low + (1 << shift) - 1)
            self.low[w] = low
            self.need[w] -= r.above
            more |= shift > 0
        self.shift = self._shift()
        return more


def _selected(rows: DataFrame, anchors, windows: Windows) -> DataFrame:
    """``(window, id, score, rank)``: the best rows of each window, by score and then by the least id.

    ``anchors`` is a broadcast block. Rows for the driver: one for each window and round.
    """
    spark = rows.sparkSession
    below = Window.partitionBy("window").orderBy(F.desc("bucket"))
    while True:
        sent = spark.sparkContext.broadcast(windows)
        counts = rows.mapInArrow(lambda batches, s=sent: _histogram(anchors.value, s.value, batches), COUNTS)
        sums = counts.groupBy("window", "bucket").agg(F.sum("n").alias("n"))
        need = spark.createDataFrame([(w, int(n)) for w, n in enumerate(windows.need.tolist())], "window int, need long")
        upto = sums.withColumn("upto", F.sum("n").over(below)).join(F.broadcast(need), "window")
        first = upto.where((F.col("upto") >= F.col("need")) & (F.col("upto") - F.col("n") < F.col("need")))
        if not windows.narrow(first.select("window", "bucket", (F.col("upto") - F.col("n")).alias("above")).collect()):
            break
    sent = spark.sparkContext.broadcast(windows)
    found = rows.mapInArrow(lambda batches, s=sent: _gathered(anchors.value, s.value, batches), FOUND)
    best = Window.partitionBy("window").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= windows.keep)


def _histogram(anchors: Anchors, windows: Windows, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of this task's rows by window and bucket, down to the bucket of the last row that the task itself would keep."""
    forget()
    counts: dict[int, np.ndarray] = {}
    for k, scores, ids, same in anchors.scores(batches):
        may = same & (ids != anchors.ids[k]) if windows.same else ~same
        scores = scores[may]
        for w in windows.of.get(k, ()):
            if windows.need[w] > 0:
                away = windows.offsets(w, scores)
                buckets = away[away <= np.uint64(int(windows.high[w]) - int(windows.low[w]))] >> windows.shift[w]
                if buckets.size:
                    n = np.bincount(buckets.astype(np.int64), minlength=1 << DIGIT)
                    counts[w] = counts[w] + n if w in counts else n
    out = []
    for w, n in counts.items():
        at = np.flatnonzero(n)[::-1]
        last = int(np.searchsorted(np.cumsum(n[at]), windows.need[w])) + 1
        out += [(w, int(b), int(n[b])) for b in at[:last]]
    yield _batch(out, ("window", "bucket", "n"), (pa.int32(), pa.int32(), pa.int64()))


def _gathered(anchors: Anchors, windows: Windows, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """This task's rows above the last score of each window, and as many with that score as the window needs, the least ids."""
    forget()
    ties: dict[int, list[int]] = {}
    out = []
    for k, scores, ids, same in anchors.scores(batches):
        may = same & (ids != anchors.ids[k]) if windows.same else ~same
        scores, ids = scores[may], ids[may]
        for w in windows.of.get(k, ()):
            need, low = int(windows.need[w]), windows.low[w]
            inside = (scores > low if need else scores >= low) & (scores <= windows.top[w])
            out += zip([w] * int(inside.sum()), ids[inside].tolist(), scores[inside].tolist(), strict=True)
            if need and (tied := ids[scores == low]).size:
                ties[w] = sorted([*ties.get(w, ()), *np.sort(tied)[:need].tolist()])[:need]
    out += [(w, i, int(windows.low[w])) for w, own in ties.items() for i in own]
    yield _batch(out, ("window", "id", "score"), (pa.int32(), pa.int64(), pa.int64()))


def _batch(rows: list[tuple], names: tuple, kinds: tuple) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else [()] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=list(names))


def _mined(rows: DataFrame, block: list, largest: float) -> DataFrame:
    """The result of one block of anchors."""
    spark = rows.sparkSession
    own = Anchors(block, largest)
    anchors = spark.sparkContext.broadcast(own)
    every = range(len(block))
    positives = _selected(rows, anchors, Windows(list(every), True, [-own.bound] * len(block), [own.bound] * len(block), POSITIVES))
    found = sorted((r.window, r.rank, r.id, r.score) for r in positives.collect())
    if not found:
        return spark.createDataFrame([], RESULT)
    low, high = [-(-LOW * s // 100) for *_, s in found], [HIGH * s // 100 for *_, s in found]
    negatives = _selected(rows, anchors, Windows([w for w, *_ in found], False, low, high, NEGATIVES))
    names = spark.createDataFrame([(k, int(own.ids[w]), i, s) for k, (w, _, i, s) in enumerate(found)], "window int, anchor_id long, positive_id long, positive_score long")
    done = negatives.join(F.broadcast(names), "window")
    return done.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


def mined(vectors: DataFrame, anchors: Column, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """Hard negatives of the rows for which ``anchors``, a condition on the columns ``id`` and ``label``, holds.

    ``(anchor_id, positive_id, rank, negative_id, positive_score, negative_score)``: the positives of an anchor
    are its best :data:`POSITIVES` other rows of the same label; for each of them the best :data:`NEGATIVES` rows of other
    labels with :data:`LOW` * positive_score <= 100 * negative_score <= :data:`HIGH` * positive_score, fewer where there are fewer.
    Ties go to the smaller id. Vectors of another length than the anchor's don't meet it; empty vectors score 0.

    Every :data:`ANCHOR_BLOCK` anchors are one pass of a few scans over all rows; the driver and each task hold
    one block and its windows at a time, never all anchors. Equal scores by the million leave a task as
    no more rows than the window keeps. An empty table gives no rows.
    """
    rows = usable(vectors, vec_id, vector, label)
    spark = rows.sparkSession
    largest = rows.agg(F.max(F.array_max(F.transform("vector", F.abs)))).first()[0] or 0.0
    path = shared_path(spark, "negatives")
    queue = written(rows.where(anchors).orderBy("id"), "anchors").orderBy("id").toLocalIterator()
    spark.createDataFrame([], RESULT).write.parquet(path)
    while block := list(islice(queue, ANCHOR_BLOCK)):
        with shuffle_cleanup(spark):
            _mined(rows, block, largest).write.mode("append").parquet(path)
    return spark.read.schema(RESULT).parquet(path)


ORACLE = """
WITH e AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
    FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same, CAST(list_dot_product(a.v, b.v) AS BIGINT) AS score
    FROM e a JOIN e b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
p AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) AS r FROM s WHERE same) x WHERE r <= 5),
n AS (SELECT p.anchor_id, p.id AS positive_id, CAST(row_number() OVER (PARTITION BY p.anchor_id, p.id ORDER BY s.score DESC, s.id) AS INTEGER) AS rank,
    s.id AS negative_id, p.score AS positive_score, s.score AS negative_score
    FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same AND 100 * s.score BETWEEN 30 * p.score AND 90 * p.score)
SELECT * FROM n WHERE rank <= 10
"""
