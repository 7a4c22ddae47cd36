"""Benchmark items in documents: shared n-grams as seeds, local alignment as the score.

Documents and items are sequences of words in lower case without the signs around
them. Three words in a row that an item and a document share are a hit. In one pass over
the texts, the words around an item's hits are looked at where enough of the item's
words stand for a match; there a Smith-Waterman alignment finds the best local match,
so that a copy with words changed, left out or put in still scores high. Every hit
counts, however many documents have its n-gram: a passage copied widely is a match too.
A match needs a part of its item's words, so one of the item's rarest words (as many as the others leave no
match without) is always among them. Windows without one are not opened: openings that
thousands of items share cost next to nothing, and no match is lost.
Items of one or two words have no n-gram; they match where all of their words stand in a row, and give
one row for a text, with the number of places.

Items are taken in blocks of bounded size, and each block's n-grams are broadcast. One
block, so one scan of the texts, holds all public benchmarks in use today several times.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colloquy.llm.shared import Units, forget, small_batches

#: Words of an n-gram; words of a block's items, which take about 30 bytes each; signs taken from words' ends.
GRAM, BLOCK_WORDS = 3, 4_000_000
SIGNS = ".,;:!?\"'()[]{}<>*#$%&|-_/\\…“”«»¿¡"
#: Scores of a word that agrees, differs, is missing or is added.
MATCH, MISMATCH, GAP = 2.0, -1.0, -1.0
#: A match scores this part of the item's own score at least, and this many words.
THRESHOLD, LEAST_WORDS = 0.5, 5


class Items:
    """A block of items as word numbers, and their n-grams; everything in flat arrays."""

    def __init__(self, rows: list[tuple[int, str]]):
        self.vocabulary: dict[str, int] = {}
        self.ids: list[int] = []
        sizes, flat = [], array("i")
        for item, text in rows:
            words = [w for w in (x.strip(SIGNS).lower() for x in text.split()) if w]
            if words:
                self.ids.append(item)
                sizes.append(len(words))
                flat.extend(self.vocabulary.setdefault(w, len(self.vocabulary)) for w in words)
        self.base = len(self.vocabulary) + 1
        if self.base**GRAM >= 1 << 63:
            raise ValueError("too many different words in a block")
        self.flat, self.size = np.array(flat, np.int32), np.array(sizes, np.int64)
        self.offset = np.cumsum(self.size) - self.size
        owner = np.repeat(np.arange(self.size.size, dtype=np.int32), self.size)
        place = (np.arange(self.flat.size) - self.offset[owner]).astype(np.int32)
        code = self.codes(self.flat)
        inside = np.flatnonzero(place[: code.size] <= self.size[owner[: code.size]] - GRAM)  # not over an item's end
        self.grams, number = np.unique(code[inside], return_inverse=True)
        order = np.argsort(number, kind="stable")
        self.owner = owner[inside][order]
        self.first = np.searchsorted(number[order], np.arange(self.grams.size + 1))
        #: The n-grams of each item and their places in it.
        self.own_gram, self.own_place = number.astype(np.int32), place[inside]
        self.own_first = np.searchsorted(owner[inside], np.arange(self.size.size + 1))
        self.need = np.maximum(THRESHOLD * MATCH * self.size, np.minimum(MATCH * self.size, MATCH * LEAST_WORDS))
        self._rarest(owner)
        #: Items too short for an n-gram, by their words.
        self.short: dict[tuple, list[int]] = {}
        for item in np.flatnonzero(self.size < GRAM):
            self.short.setdefault(tuple(self.words(item).tolist()), []).append(int(item))

    def _rarest(self, owner: np.ndarray) -> None:
        """Of an item's ``m`` words, ``a`` of which a match has at least, the ``m - a + 1`` that the fewest items have."""
        pairs = np.unique(owner.astype(np.int64) * self.base + self.flat)
        items_with = np.bincount(pairs % self.base, minlength=self.base)
        order = np.lexsort((self.flat, items_with[self.flat], owner))
        rank = np.arange(order.size) - self.offset[owner[order]]
        keep = order[rank <= self.size[owner[order]] - np.ceil(self.need[owner[order]] / MATCH)]
        self.rare, self.rare_first = self.flat[keep], np.searchsorted(owner[keep], np.arange(self.size.size + 1))

    def words(self, item: int) -> np.ndarray:
        return self.flat[self.offset[item] : self.offset[item] + self.size[item]]

    def whole(self, words: np.ndarray) -> Iterator[tuple[int, int, int]]:
        """Items under :data:`GRAM` words that stand in a text, the first place, and the number of places."""
        for own, items in self.short.items():
            same = words[: max(words.size - len(own) + 1, 0)] == own[0]
            for k, word in enumerate(own[1:], 1):
                same = same & (words[k : k + same.size] == word)
            at = np.flatnonzero(same)
            if at.size:
                for item in items:
                    yield item, int(at[0]), int(at.size)

    def codes(self, words: np.ndarray) -> np.ndarray:
        """The numbers of n-grams of known words (-1: a word is unknown)."""
        if words.size < GRAM:
            return np.empty(0, np.int64)
        words = words.astype(np.int64)
        parts = [words[k : words.size - GRAM + 1 + k] for k in range(GRAM)]
        code = np.zeros(parts[0].size, np.int64)
        for part in parts:
            code = code * self.base + part
        return np.where(np.logical_and.reduce([p >= 0 for p in parts]), code, -1)

    def reader(self):
        """A function from a text to its words' numbers (-1: in no item)."""
        memo = Units(lambda raw: self.vocabulary.get(raw.strip(SIGNS).lower(), -2 if not raw.strip(SIGNS) else -1))

        def read(text: str | None) -> np.ndarray:
            words = (text or "").split()
            got = np.fromiter(map(memo.__getitem__, words), np.int64, len(words))
            return got[got != -2] if (got == -2).any() else got

        return read

    def hits(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions in a document and the n-grams' numbers there."""
        codes = self.codes(words)
        at = np.flatnonzero(codes >= 0)
        if not at.size or not self.grams.size:
            return at[:0], at[:0]
        number = np.minimum(np.searchsorted(self.grams, codes[at]), self.grams.size - 1)
        same = self.grams[number] == codes[at]
        return at[same], number[same]

    def candidates(self, words: np.ndarray, at: np.ndarray, number: np.ndarray) -> Iterator[tuple[int, int, np.ndarray]]:
        """From a document's hits: item's number, first place and words around.

        An alignment scores at most :data:`MATCH` for each of the item's words that the
        window has, so windows with too few are left out without loss, as are those without any of the item's rarest words.
        What is held at once are the hits of one item.
        """
        grams = np.unique(number)
        items = np.unique(self.owner[_runs(self.first[grams], self.first[grams + 1] - self.first[grams])])
        present = np.zeros(self.base, bool)
        present[words[words >= 0]] = True
        inside = np.add.reduceat(present[self.flat[_runs(self.offset[items], self.size[items])]], np.cumsum(self.size[items]) - self.size[items], dtype=np.int64)
        rare = self.rare_first[items + 1] - self.rare_first[items]
        some = np.add.reduceat(present[self.rare[_runs(self.rare_first[items], rare)]], np.cumsum(rare) - rare, dtype=np.int64)
        items = items[(MATCH * inside >= self.need[items]) & (some > 0)]
        if not items.size:
            return
        slot = np.full(self.base + 1, -1, np.int64)  # the last one is for words of no item
        by_gram, by_word = np.argsort(number, kind="stable"), np.argsort(words, kind="stable")
        at, number, sorted_ = at[by_gram], number[by_gram], words[by_word]
        for item in items.tolist():
            m = int(self.size[item])
            slack = m // 2 + 2
            own = slice(self.own_first[item], self.own_first[item + 1])
            begin = np.searchsorted(number, self.own_gram[own])
            count = np.searchsorted(number, self.own_gram[own], "right") - begin
            start = np.sort(at[_runs(begin, count)] - np.repeat(self.own_place[own], count))
            lo, hi = np.maximum(start - slack, 0), np.minimum(start + m + slack, words.size)
            first = np.flatnonzero(np.r_[True, lo[1:] > np.maximum.accumulate(hi)[:-1]])
            low, high = lo[first], np.maximum.reduceat(hi, first)
            seldom = np.unique(self.rare[self.rare_first[item] : self.rare_first[item + 1]])
            begin = np.searchsorted(sorted_, seldom)
            stands = np.sort(by_word[_runs(begin, np.searchsorted(sorted_, seldom, "right") - begin)])
            seen = np.searchsorted(stands, low) < np.searchsorted(stands, high)
            low, high = low[seen], high[seen]
            if not low.size:
                continue
            # How many of the item's words each window has, for all windows at once.
            own_words, times = np.unique(self.words(item), return_counts=True)
            slot[own_words] = np.arange(own_words.size)
            of = slot[words[_runs(low, high - low)]]
            slot[own_words] = -1
            there = np.zeros((low.size, own_words.size), bool)
            there[np.repeat(np.arange(low.size), high - low)[of >= 0], of[of >= 0]] = True
            for x in np.flatnonzero(MATCH * (there @ times) >= self.need[item]).tolist():
                yield item, int(low[x]), words[low[x] : high[x]]


def _runs(first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """The numbers of all runs of ``count`` from ``first`` on."""
    return np.repeat(first - np.cumsum(count) + count, count) + np.arange(count.sum())


def align(item: np.ndarray, window: np.ndarray) -> tuple[float, int, int]:
    """Smith-Waterman with linear gaps: best score and the first and last place in the window."""
    places = np.arange(window.size)
    before, start_before = np.zeros(window.size + 1), np.arange(window.size + 1)
    best = (0.0, 0, 0)
    for word in item:
        diagonal = before[:-1] + np.where(window == word, MATCH, MISMATCH)
        up = before[1:] + GAP
        take = diagonal >= up
        score = np.where(take, diagonal, up)
        start = np.where(take, start_before[:-1], start_before[1:])
        fresh = score <= 0
        score = np.where(fresh, 0.0, score)
        start = np.where(fresh, places + 1, start)
        # A run of added words: the best of what stands before, less a gap for each place.
        lifted = np.maximum.accumulate(score - GAP * places)
        source = np.maximum.accumulate(np.where(lifted == score - GAP * places, places, 0))
        score, start = lifted + GAP * places, start[source]
        top = int(score.argmax())
        if score[top] > best[0]:
            best = (float(score[top]), int(start[top]), top)
        before, start_before = np.r_[0.0, score], np.r_[0, start]
    return best


OUTPUT = "doc_id long, item_id long, score double, first_word long, last_word long, places long"


def contaminated(
    docs: DataFrame,
    benchmark: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    block_words: int = BLOCK_WORDS,
    text_key: bool = False,
    least_item_words: int = 1,
) -> DataFrame:
    """``(doc_id, item_id, score, first_word, last_word, places)`` of every match of a document and an item.

    An item that stands in a document at several places gives several rows, each with ``places`` 1; one of fewer
    than :data:`GRAM` words gives one row for a text, that of its first place, with their number. Items of fewer than
    ``least_item_words`` words aren't looked for: a single common word would match nearly every text.

    ``score`` is the alignment's part of the item's score with itself, at least
    :data:`THRESHOLD`; at least five words must agree, or all of an item with fewer.
    Whole texts of any length are read. Null and empty texts, and items without a word,
    match nothing. Rows that are repeated give repeated results, an empty table on either
    side none; other columns don't matter, whatever their names. With ``text_key``
    there is a last column of that name, xxhash64 of the document's text, which tells
    texts with the same id, or none, apart. Items of more than ``block_words`` words
    together are looked for in several scans.
    """
    spark = docs.sparkSession
    small_batches(spark)
    source = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    output = OUTPUT
    if text_key:
        source, output = source.withColumn("text_key", F.xxhash64("text")), f"{OUTPUT}, text_key long"
    item, words = F.col(f"`{item_id}`"), F.col(f"`{item_text}`")
    rows = benchmark.where(words.isNotNull()).select(item.cast("long").alias("item"), words.alias("words")).distinct()
    found, block, size = None, [], 0
    listed = rows.orderBy("item", "words").toLocalIterator()
    while True:
        row = next(listed, None)
        if row is not None:
            if len([x for x in row[1].split() if x.strip(SIGNS)]) >= least_item_words:
                block.append((row[0], row[1]))
                size += len(row[1].split())
        if block and (row is None or size >= block_words):
            one = _block(source, Items(block), output)
            found, block, size = one if found is None else found.unionByName(one), [], 0
        if row is None:
            return found if found is not None else spark.createDataFrame([], output)


def _block(source: DataFrame, items: Items, output: str) -> DataFrame:
    plain = source.sparkSession.sparkContext.broadcast(items)
    names = [x.split()[0] for x in output.split(", ")]
    kinds = [pa.float64() if x == "score" else pa.int64() for x in names]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        items = plain.value
        read = items.reader()
        for batch in batches:
            out = []
            for doc_id, text, *key in zip(*(c.to_pylist() for c in batch.columns)):
                words = read(text)
                at, number = items.hits(words)
                if at.size:
                    for item, first, window in items.candidates(words, at, number):
                        got, begin, end = align(items.words(item), window)
                        if got >= items.need[item]:
                            out.append((doc_id, items.ids[item], got / (MATCH * items.size[item]), first + begin, first + end, 1, *key))
                for item, first, places in items.whole(words):
                    out.append((doc_id, items.ids[item], 1.0, first, first + int(items.size[item]) - 1, places, *key))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*out), kinds)], names=names)

    return source.mapInArrow(scan, output)
