"""Quality scores by the votes of labelled nearest neighbours.

A text's terms are its words (in lower case without the signs around them, hashed to
columns) and the trigrams of its characters' classes (letters in lower and upper case,
digits, blanks, line ends, signs), counted over the whole text, and steps of its length and of
how much it repeats itself. Weighted by rarity and projected to their strongest
latent directions, a bounded sample of labelled texts is broadcast; each text is
compared with all of it by blocks of exact cosine products, and its nearest neighbours
vote with their similarity.
"""

from __future__ import annotations

import math
import zlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from colloquy.llm.shared import Units, arrow_map, forget, written

#: Columns of words, of class trigrams and of steps; latent directions; labelled texts at most; voters (and those
#: as near as the last of them); the power of similarity by which they weigh; the score from which quality is predicted.
WORDS, TRIGRAMS, STEPS, LATENT = 2048, 2000, 48, 64
WIDTH = WORDS + TRIGRAMS + STEPS
MAX_LABELLED, VOTERS, POWER, THRESHOLD = 4000, 25, 8, 0.7
#: Part of the words and of the steps in a text's features (1: the trigrams'), and bytes counted at once.
WORD_WEIGHT, STEP_WEIGHT, CHUNK = 0.5, 0.35, 1 << 20
#: Similarities that differ by less are equal.
TIE = 1e-5
SIGNS = ".,;:!?\"'()[]{}<>*#$%&|-_/\\…“”«»¿¡"


def _classes() -> np.ndarray:
    out = np.ones(256, np.uint8)  # bytes of other letters count as letters
    for b in range(128):
        c = chr(b)
        out[b] = 1 if c.islower() else 2 if c.isupper() else 3 if c.isdigit() else 4 if c in " \t" else 5 if c in "\n\r" else 6 + b % 25
    return out


_CLASSES = _classes()


_columns = Units(lambda word: zlib.crc32(word.strip(SIGNS).encode()) % WORDS)


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=-1, keepdims=True), 1e-9)


def features(text: str | None) -> np.ndarray:
    """The feature vector of one whole text; null counts as empty."""
    text = text or ""
    raw = np.frombuffer(f" \n{text}\n ".encode(), np.uint8)
    counts = np.zeros(TRIGRAMS)
    for at in range(0, raw.size - 2, CHUNK):
        c = _CLASSES[raw[at : at + CHUNK + 2]].astype(np.int64)
        code = (c[:-2] * 32 + c[1:-1]) * 32 + c[2:]
        counts += np.bincount((code * 2654435761 >> 7) % TRIGRAMS, minlength=TRIGRAMS)
    words = text.lower().split()
    terms = np.bincount(np.fromiter(map(_columns.__getitem__, words), np.int64, len(words)), minlength=WORDS)
    pairs = max(len(words) - 1, 1)
    repeated = 1 - len(set(zip(words, words[1:]))) / pairs if len(words) > 1 else 0.0
    twice = sum(map(str.__eq__, words, words[1:])) / pairs
    step = np.arange(16) / 16
    steps = np.r_[repeated > step, twice > step, len(words) > 2.0 ** np.arange(16)]
    return np.concatenate([WORD_WEIGHT * _unit(np.log1p(terms)), _unit(np.log1p(counts)), STEP_WEIGHT * steps]).astype(np.float32)


class Model:
    """Weights, latent directions and the labelled vectors; its size is bounded by the parameters."""

    def __init__(self, rows: np.ndarray, labels: np.ndarray, seed: int = 0):
        """``rows`` is used up: it is weighted in place, as it is the largest thing here."""
        self.labels = labels.astype(np.float64)
        self.weight = (np.log((1 + len(rows)) / (1 + np.count_nonzero(rows, axis=0))) + 1).astype(np.float32)
        self.weight[WIDTH - STEPS :] = 1
        x = rows
        x *= self.weight
        x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)
        basis = np.random.default_rng(seed).standard_normal((WIDTH, LATENT + 16)).astype(np.float32)
        for _ in range(6):
            basis, _r = np.linalg.qr(x.T @ (x @ basis))
        _u, _s, right = np.linalg.svd(x @ basis, full_matrices=False)
        self.directions = np.ascontiguousarray((basis @ right.T)[:, :LATENT])
        self.vectors = _unit(x @ self.directions)

    def score(self, rows: np.ndarray) -> np.ndarray:
        if not self.labels.size:
            return np.full(len(rows), 0.5)
        z = _unit(_unit(rows * self.weight) @ self.directions)
        near = z @ self.vectors.T
        k = near.shape[1] - min(VOTERS, near.shape[1])
        last = np.partition(near, k, axis=1)[:, k : k + 1]
        votes = np.where(near >= last - TIE, near.clip(1e-6, 1), 0).astype(np.float64) ** POWER
        return ((votes @ self.labels) / votes.sum(1)).clip(0, 1)


def fit(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "label", limit: int = MAX_LABELLED) -> Model:
    """A model of at most ``limit`` labelled ids that have a document, those of the least hashes.

    An id counts once however often it is labelled; labels that contradict each other
    give their mean. Rows with a null id or label, and ids without a document, teach
    nothing and take no other id's place. Of several documents of an id the one with the least text stands for all.
    """
    known = labels.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{label}`").cast("double").alias("label")).dropna()
    known = written(known.groupBy("doc_id").agg(F.avg("label").alias("label")), "labels")
    source = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    hashed, most = F.xxhash64("doc_id"), 4 * limit
    # A few times the ids wanted are looked for among the documents' ids; where too many of them have no document, all are.
    total = known.count()
    some = known.where(hashed < int(-(1 << 63) + (1 << 64) * min(1.0, 1.5 * most / max(total, 1)))) if total > 2 * most else known
    first = some.orderBy(hashed, "doc_id").limit(most) if total > most else known
    there = written(source.select("doc_id").join(F.broadcast(first), "doc_id").groupBy("doc_id").agg(F.first("label").alias("label")), "labelled")
    if total > most and there.count() < limit:
        there = known.join(source.select("doc_id"), "doc_id", "left_semi")
    chosen = written(there.orderBy(hashed, "doc_id").limit(limit), "chosen")
    # At most ``limit`` rows are broadcast.
    own = source.join(F.broadcast(chosen.select("doc_id")), "doc_id", "left_semi").groupBy("doc_id").agg(F.min("text").alias("text"))
    sample = own.join(F.broadcast(chosen), "doc_id")
    vector = T.StructType([T.StructField("vector", T.BinaryType())])
    rows = arrow_map(sample, ["text"], vector, lambda: lambda texts: [[zlib.compress(features(t).tobytes(), 1) for t in texts]], ("doc_id", "label")).collect()
    rows.sort(key=lambda r: r["doc_id"])
    matrix = np.zeros((len(rows), WIDTH), np.float32)
    for k, r in enumerate(rows):
        matrix[k] = np.frombuffer(zlib.decompress(r["vector"]), np.float32)
    return Model(matrix, np.array([r["label"] for r in rows]))


def scored(docs: DataFrame, model: Model, text: str = "text", keep: tuple[str, ...] = ("doc_id",), name: str = "score") -> DataFrame:
    """``keep`` columns and the score, 0 to 1; whole texts of any length are read.

    Null and empty texts get a score as well, and 0.5 is everyone's where nothing was
    labelled. All neighbours as near as the last voter vote. Rows that are repeated
    give repeated results, an empty table none; a kept column of the score's name gives way.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        forget()
        model = shared.value

        def batch(texts):
            parts = [texts[i : i + 256] for i in range(0, len(texts), 256)]
            return [[float(s) for part in parts for s in model.score(np.array([features(t) for t in part]))]]

        return batch

    return arrow_map(docs, [text], T.StructType([T.StructField(name, T.DoubleType())]), make, keep)


def remainder(doc_id: str, by: int):
    """crc32 of an id's text modulo ``by``; null for a null id."""
    return F.crc32(F.col(f"`{doc_id}`").cast("string")) % math.floor(by)
