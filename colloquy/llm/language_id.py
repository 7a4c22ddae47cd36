"""Language by cross-parsing entropy.

A bounded sample of labelled text of each language becomes a suffix automaton. A
text is parsed from its start into the longest phrases that occur in the sample; the
language whose automaton needs the fewest phrases, normalised by the sample's and the
text's length, wins.

The parse runs over whole texts. It is done for many segments at once, one character
of all segments at a time: each segment is first parsed as if a phrase began at its
start, then again from the state in which the segment before really ends, until both
parses are in the same state, from where they stay the same. So the phrases are those of
one parse from the text's first character to its last, wherever segments were cut.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from colloquy.llm.shared import arrow_map

#: Labelled passages of each language and their characters; documents they come from at most;
#: characters of all languages' samples together, which become shorter when there are many
#: languages; languages at most, beyond which fitting is refused.
SAMPLE_PASSAGES, PASSAGE_CHARS, SAMPLE_DOCS, SAMPLE_TOTAL, MAX_LANGUAGES = 60, 400, 200, 4_000_000, 10_000
#: Characters of a segment, and characters parsed at once.
SEGMENT, PART = 256, 1 << 20
#: Symbols: blank, a letter that is in no sample, then the letters of the samples.
BLANK, UNKNOWN = 0, 1
UNDETERMINED = "und"
#: The table of steps holds a state in its lower bits and the phrases that end in its upper two.
_STATE = np.uint32((1 << 30) - 1)


class Alphabet:
    """Every letter of the samples as a number, the most frequent first; runs of other characters are one blank."""

    def __init__(self, sample: str):
        letters: dict[str, int] = {}
        for c in sample.lower():
            if c.isalpha():
                letters[c] = letters.get(c, 0) + 1
        known = sorted(letters, key=lambda c: (-letters[c], c))
        self.size = UNKNOWN + 1 + len(known)
        self.table = np.array([UNKNOWN if chr(i).isalpha() else BLANK for i in range(0x110000)], np.uint16 if self.size < 1 << 16 else np.uint32)
        for k, c in enumerate(known):
            self.table[ord(c)] = UNKNOWN + 1 + k

    def symbols(self, low: list[str], blank_before: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Symbols of all lower-case texts in a row, and how many each has.

        A blank at a text's start is left out where ``blank_before`` is true.
        """
        codes = self.table[np.frombuffer("".join(low).encode("utf-32-le", "surrogatepass"), "<u4")]
        size = np.array([len(t) for t in low], np.int64)
        owner = np.repeat(np.arange(len(low)), size)
        blank = codes == BLANK
        before = np.r_[True, blank[:-1]] if codes.size else blank
        first = (np.cumsum(size) - size)[size > 0]
        before[first] = True if blank_before is None else blank_before[size > 0]
        stay = ~(blank & before)
        return codes[stay], np.bincount(owner[stay], minlength=len(low))


def automaton(symbols: list[int]) -> list[dict[int, int]]:
    """Transitions of the suffix automaton of a sequence; state 0 is the root."""
    after, link, length = [{}], [-1], [0]
    last = 0
    for c in symbols:
        new = len(after)
        after.append({})
        link.append(0)
        length.append(length[last] + 1)
        p = last
        while p >= 0 and c not in after[p]:
            after[p][c] = new
            p = link[p]
        if p >= 0:
            q = after[p][c]
            if length[p] + 1 == length[q]:
                link[new] = q
            else:
                copy = len(after)
                after.append(dict(after[q]))
                link.append(link[q])
                length.append(length[p] + 1)
                while p >= 0 and after[p].get(c) == q:
                    after[p][c] = copy
                    p = link[p]
                link[q] = link[new] = copy
        last = new
    return after


class Steps:
    """An automaton's transitions in two flat arrays, whatever the size of the alphabet.

    A state is a place: its step by symbol c stands at place + c, if that cell's owner
    is the state. Rows of many states interlock, so there are hardly more cells than
    transitions.
    """

    def __init__(self, after: list[dict[int, int]], size: int, seed: int = 0):
        degree = np.array([len(own) for own in after], np.int64)
        symbols = np.fromiter((c for own in after for c in own), np.int64, int(degree.sum()))
        begin = np.cumsum(degree) - degree
        room = 2 * symbols.size + 2 * len(after) + size + 64
        taken, used, place = np.zeros(room, bool), np.zeros(room + size, bool), np.zeros(len(after), np.int64)
        # States look for a place at random, those with many transitions first; who finds
        # all its cells free, or asks first for them in a round, stays.
        random = np.random.default_rng(seed)
        for least in (64, 8, 2, 0):
            left = np.flatnonzero((degree >= least) & (degree < {64: symbols.size + 1, 8: 64, 2: 8, 0: 2}[least]))
            while left.size:
                at = random.integers(0, room, left.size)
                who = np.repeat(np.arange(left.size), degree[left])
                row = np.repeat(begin[left] - np.cumsum(degree[left]) + degree[left], degree[left]) + np.arange(who.size)
                cell = at[who] + symbols[row]
                ask, spot = np.full(room + size, left.size), np.full(room, left.size)
                np.minimum.at(ask, cell, who)
                np.minimum.at(spot, at, np.arange(left.size))
                lost = taken[at] | (spot[at] != np.arange(left.size))
                lost |= np.bincount(who, used[cell] | (ask[cell] != who), left.size) > 0
                won = ~lost
                place[left[won]] = at[won]
                taken[at[won]] = True
                used[cell[won[who]]] = True
                left = left[lost]
        self.owner = np.full(int(place.max()) + size + 1, -1, np.int32)
        self.to = np.zeros(self.owner.size, np.uint32)
        for state, own in enumerate(after):
            for c, to in own.items():
                self.owner[place[state] + c] = place[state]
                self.to[place[state] + c] = place[to]
        self.root = np.uint32(place[0])
        #: After a phrase ends before symbol c: the next state, and one phrase more if c is in no sample phrase.
        self.fresh = np.full(size, self.root | np.uint32(1 << 30), np.uint32)
        for c, to in after[0].items():
            self.fresh[c] = place[to]

    def step(self, state: np.ndarray, symbol: np.ndarray) -> np.ndarray:
        """The next states, with the number of phrases that end on the way in the upper two bits."""
        cell = state + symbol
        out = self.to[cell]
        miss = np.flatnonzero(self.owner[cell] != state)
        if miss.size:
            out[miss] = self.fresh[symbol[miss]] + ((state[miss] != self.root).astype(np.uint32) << np.uint32(30))
        return out


class Model:
    """Languages, alphabet and the steps of each language; bounded by the sample's size."""

    def __init__(self, samples: dict[str, str]):
        self.languages = sorted(samples)
        self.alphabet = Alphabet("".join(samples[k] for k in self.languages))
        self.steps, weight = [], []
        for k in self.languages:
            symbols, _ = self.alphabet.symbols([samples[k].lower()])
            self.steps.append(Steps(automaton(symbols.tolist()), self.alphabet.size))
            weight.append(np.log2(len(symbols) + 2))
        #: A phrase costs its place in the sample: the logarithm of the sample's length.
        self.weight = np.array(weight)

    def parse(self, symbols: np.ndarray, sizes: np.ndarray, state: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Phrases that end in each text and language, and the states at the texts' ends, from ``state`` on."""
        ends = np.cumsum(sizes)
        counts = -(-sizes // SEGMENT)
        owner = np.repeat(np.arange(sizes.size), counts)
        nth = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
        start = (ends - sizes)[owner] + nth * SEGMENT
        length = np.minimum(SEGMENT, ends[owner] - start)
        order = np.argsort(-length, kind="stable")  # longest first: the short ones drop out
        rank = np.empty_like(order)
        rank[order] = np.arange(order.size)
        active = np.searchsorted(-length[order], -np.arange(SEGMENT), "left")
        grid = np.zeros((SEGMENT, order.size), np.int32)
        for i in range(SEGMENT):
            n = active[i]
            grid[i, :n] = symbols[start[order[:n]] + i]
        found, after = np.zeros((sizes.size, len(self.steps)), np.int64), state.copy()
        last, final = nth == counts[owner] - 1, length - 1
        for k, own in enumerate(self.steps):
            done = np.zeros((SEGMENT, order.size), np.uint32)
            at = np.full(order.size, own.root, np.uint32)
            for i in range(SEGMENT):
                n = active[i]
                if not n:
                    break
                done[i, :n] = got = own.step(at[:n], grid[i, :n])
                at[:n] = got & _STATE
            # What each segment was taken to begin with; its real beginning is its predecessor's end.
            begun = np.full(order.size, own.root, np.uint32)
            while order.size:
                end = (done[final, rank] & _STATE)
                real = np.where(nth == 0, state[owner, k], np.r_[np.uint32(0), end[:-1]])
                lane = np.flatnonzero(real != begun)
                if not lane.size:
                    break
                begun[lane] = real[lane]
                at, lane = real[lane], rank[lane]
                for i in range(SEGMENT):
                    inside = lane < active[i]
                    lane, at = lane[inside], at[inside]
                    if not lane.size:
                        break
                    got = own.step(at, grid[i, lane])
                    before = done[i, lane]
                    done[i, lane] = got
                    at = got & _STATE
                    differ = at != (before & _STATE)
                    lane, at = lane[differ], at[differ]
            ended = (done >> np.uint32(30)).sum(0, dtype=np.int64)[rank]
            found[:, k] = np.bincount(owner, ended, sizes.size)
            after[owner[last], k] = (done[final, rank] & _STATE)[last]
        return found, after

    def phrases(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each text and language, the number of phrases; for each text, its symbols and whether it has a letter.

        A text longer than :data:`PART` goes part by part, from the state in which the part before ended.
        """
        n = len(texts)
        root = np.array([s.root for s in self.steps], np.uint32)
        total, state = np.zeros((n, len(self.steps)), np.int64), np.tile(root, (n, 1))
        letters, length, blank = np.zeros(n, bool), np.zeros(n, np.int64), np.ones(n, bool)
        held: list[tuple[int, str]] = []

        def flush() -> None:
            if not held:
                return
            rows = np.array([i for i, _ in held])
            symbols, sizes = self.alphabet.symbols([t for _, t in held], blank[rows])
            found, state[rows] = self.parse(symbols, sizes, state[rows])
            total[rows] += found
            length[rows] += sizes
            letters[rows] |= np.bincount(np.repeat(np.arange(rows.size), sizes), symbols != BLANK, rows.size) > 0
            some = sizes > 0
            blank[rows[some]] = symbols[np.cumsum(sizes)[some] - 1] == BLANK
            held.clear()

        size = 0
        for i, text in enumerate(texts):
            low = (text or "").lower()
            for at in range(0, len(low), PART):
                part = low[at : at + PART]
                if size + len(part) > PART:
                    flush()
                    size = 0
                held.append((i, part))
                size += len(part)
        flush()
        return total + (state != root), length, letters

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        """The language and score of each text."""
        n = len(texts)
        if not self.languages:
            return [UNDETERMINED] * n, [0.0] * n
        total, length, letters = self.phrases(texts)
        cost = total * self.weight / np.maximum(length, 1)[:, None]
        best = cost.argmin(1)
        ranked = np.sort(cost, axis=1)
        second = ranked[:, 1] if len(self.languages) > 1 else np.full(n, np.inf)
        score = np.where(letters, 1 - ranked[:, 0] / np.maximum(second, 1e-9), 0.0).clip(0, 1)
        return [self.languages[b] if x else UNDETERMINED for b, x in zip(best, letters)], [float(s) for s in score]


def fit(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", passages: int = SAMPLE_PASSAGES, chars: int = PASSAGE_CHARS
) -> Model:
    """A model from labelled passages: whole texts are cut into passages of ``chars`` characters, and ``passages`` are taken of each language.

    They come from about :data:`SAMPLE_DOCS` different ids of each language, those of the least hashes and always the very least,
    one passage of every document before a second of any, by hash, so from anywhere in a text. Every language is
    learned; with so many that the samples would pass :data:`SAMPLE_TOTAL` characters, each
    gets fewer passages, and more than :data:`MAX_LANGUAGES` are refused. Rows with a
    null id, text or language teach nothing; an id's repeated rows teach once and take no other id's
    place; without rows every prediction is undetermined.
    """
    source = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text"), F.col(f"`{lang}`").alias("lang")).dropna()
    hashed = F.xxhash64("doc_id")
    counts = source.groupBy("lang").agg(F.approx_count_distinct("doc_id").alias("ids"), F.min(hashed).alias("least")).limit(MAX_LANGUAGES + 1).collect()
    if len(counts) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    if not counts:
        return Model({})
    passages = max(1, min(passages, SAMPLE_TOTAL // (chars * len(counts))))
    table = source.sparkSession.createDataFrame([(r["lang"], min(1.0, SAMPLE_DOCS / max(r["ids"], 1)), r["least"]) for r in counts], "lang string, part double, least long")
    place = (hashed / F.lit(float(1 << 64))) + 0.5
    # The table has MAX_LANGUAGES rows at most.
    some = source.join(F.broadcast(table), "lang").where((place < F.col("part")) | (hashed == F.col("least")))
    # A row of an id and language stands for all of them, so repeated rows don't swell the sample.
    own = some.groupBy("lang", "doc_id").agg(F.min("text").alias("text"))
    count = F.greatest(F.ceil(F.length("text") / chars), F.lit(1)).cast("int")
    # Places are drawn before any is cut, as finding one is a walk through the text.
    places = F.array_sort(F.transform(F.sequence(F.lit(0), count - 1), lambda at: F.struct(F.xxhash64("doc_id", at).alias("h"), at.alias("at"))))
    cut = own.select("lang", "doc_id", "text", F.posexplode(F.slice(places, 1, passages)).alias("turn", "x"))
    cut = cut.select("lang", "doc_id", "turn", "x.h", F.substring("text", F.col("x.at") * chars + 1, F.lit(chars)).alias("passage"))
    nth = F.row_number().over(Window.partitionBy("lang").orderBy("turn", "h", "doc_id"))
    rows = cut.withColumn("nth", nth).where(F.col("nth") <= passages)
    samples: dict[str, list] = {}
    for r in rows.select("lang", "nth", "passage").collect():
        samples.setdefault(r["lang"], []).append((r["nth"], r["passage"]))
    return Model({k: "\n".join(p for _, p in sorted(v)) for k, v in samples.items()})


def predicted(docs: DataFrame, model: Model, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns, ``lang_pred`` and ``score``: by which part the winner's cost lies under the next one's.

    Whole texts of any length are parsed. Null texts, empty ones and those without a
    letter are ``und`` with score 0, as are all without a learned language. Of
    languages that cost as much, the first by name wins. Rows that are repeated give
    repeated results, an empty table none. A kept column named ``lang_pred`` or
    ``score`` gives way; others may have any name.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    outputs = T.StructType([T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    return arrow_map(docs, [text], outputs, lambda: shared.value.predict, keep)
