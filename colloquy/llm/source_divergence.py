"""Source divergence audit: how far a source's words are from those of the other sources of its language.

Partitions count terms in byte tries whose leaves have a counter for each source. Tries meet by
ranges of terms: written out in the order of UTF-8 bytes they are streams of leaves in which equal
terms stand side by side, so a merge holds one leaf. A last traversal of the kept terms streams
the sums of all pairs of sources and each source's candidates for its most telling terms.

All arithmetic is on integers and exact. Null texts, languages and sources count as empty strings;
every row is a document of its own, repeated ones too; a text without a term still makes its
group; an empty table gives no rows. Terms of any length are kept whole.
"""

from __future__ import annotations

import heapq
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from colloquy.llm.shared import dropped, forget, small_batches, written

#: A term is kept if so many documents of its language have it.
LEAST_DOCS = 3
#: Terms listed for each source of a language.
TOP_TERMS = 200
#: Probabilities are in units of one to this.
UNIT = 1_000_000_000
#: Counters that a task holds before they go into its tries, and leaves that its tries hold before they are written out.
BUFFER, MAX_LEAVES = 1_000_000, 600_000
#: Sources whose sums are made at once; languages with more are dealt to tasks in such blocks.
SOURCE_BLOCK = 256
#: Cells of sums that a task holds before it writes them out.
MAX_CELLS = 4_000_000

#: Letters to lower case, what stands between terms to spaces; all bytes of other characters stay.
_TERMS = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
LEAVES = "lang string, term string, docs long, sources array<string>, counts array<long>"


def terms(text: bytes) -> list[bytes]:
    """Runs of ASCII letters, lower-cased, and other characters beyond ASCII."""
    return text.translate(_TERMS).split()


class Trie:
    """A radix trie over bytes: edges carry labels of any length, terms end at numbered leaves."""

    __slots__ = ("root", "size")

    def __init__(self):
        self.root, self.size = [None, None], 0  # edges by first byte, number

    def leaf(self, term: bytes) -> int:
        """The number of the term's leaf, made if it is new."""
        node, at, n = self.root, 0, len(term)
        while at < n:
            edges = node[0]
            if edges is None:
                edges = node[0] = {}
            edge = edges.get(term[at])
            if edge is None:
                child = [None, None]
                edges[term[at]] = (term[at:], child)
                node, at = child, n
            elif term.startswith(edge[0], at):
                node, at = edge[1], at + len(edge[0])
            else:  # the term leaves the label inside: a new node there takes over the rest of the edge
                label, child = edge
                same = 1
                while same < len(label) and at + same < n and label[same] == term[at + same]:
                    same += 1
                middle = [{label[same]: (label[same:], child)}, None]
                edges[term[at]] = (label[:same], middle)
                node, at = middle, at + same
        if node[1] is None:
            node[1], self.size = self.size, self.size + 1
        return node[1]

    def leaves(self) -> Iterator[tuple[bytes, int]]:
        """Terms with their leaves' numbers, in the order of their bytes."""
        stack = [(b"", self.root)]
        while stack:
            prefix, (edges, number) = stack.pop()
            if number is not None:
                yield prefix, number
            if edges:
                stack += [(prefix + edges[b][0], edges[b][1]) for b in sorted(edges, reverse=True)]


class _Counts:
    """One task's tries, by language, with their leaves' counters of documents and of each source."""

    def __init__(self):
        self.words: dict[tuple[str, str], Counter] = {}
        self.docs: dict[str, Counter] = {}
        self.tries: dict[str, Trie] = {}
        self.found: dict[str, list] = {}  # leaf numbers, source numbers, counts; source None: documents
        self.sources: dict[str, dict[str, int]] = {}
        self.buffered = 0

    def add(self, lang: str, source: str, text: bytes) -> None:
        words = terms(text)
        if not words:
            return
        if (lang, source) not in self.words:
            self.words[lang, source] = Counter()
            self.docs.setdefault(lang, Counter())
        counter, docs = self.words[lang, source], self.docs[lang]
        before = len(counter) + len(docs)
        counter.update(words)
        docs.update(set(words))
        self.buffered += len(counter) + len(docs) - before

    def pour(self) -> None:
        """Put the buffered counts at the leaves of the tries."""
        numbers = {}
        for lang, docs in self.docs.items():
            leaf = self.tries.setdefault(lang, Trie()).leaf
            own = numbers[lang] = {term: leaf(term) for term in docs}
            self._found(lang, -1, own, docs)
        for (lang, source), counter in self.words.items():
            known = self.sources.setdefault(lang, {})
            self._found(lang, known.setdefault(source, len(known)), numbers[lang], counter)
        self.words, self.docs, self.buffered = {}, {}, 0

    def _found(self, lang: str, source: int, numbers: dict, counter: Counter) -> None:
        n = len(counter)
        at = np.fromiter(map(numbers.__getitem__, counter), np.int64, n)
        counts = np.fromiter(counter.values(), np.int64, n)
        self.found.setdefault(lang, []).append((at, np.full(n, source), counts))

    def size(self) -> int:
        return sum(t.size for t in self.tries.values())

    def batches(self) -> Iterator[pa.RecordBatch]:
        """The tries' leaves by language, in the order of their terms; afterwards there are none."""
        for lang in sorted(self.tries):
            trie, names = self.tries.pop(lang), pa.array(list(self.sources[lang]), pa.string())
            terms_, numbers = zip(*trie.leaves(), strict=True)
            rank = np.empty(trie.size, np.int64)
            rank[np.array(numbers)] = np.arange(trie.size)
            at, source, counts = map(np.concatenate, zip(*self.found.pop(lang), strict=True))
            at, source, counts = _summed(rank[at], source, counts)
            docs, rest = counts[source < 0], source >= 0
            offsets = np.searchsorted(at[rest], np.arange(trie.size + 1)).astype(np.int32)
            table = pa.RecordBatch.from_arrays(
                [
                    pa.array([lang] * trie.size, pa.string()),
                    pa.array(terms_, pa.binary()).cast(pa.string()),
                    pa.array(docs),
                    pa.ListArray.from_arrays(offsets, names.take(pa.array(source[rest]))),
                    pa.ListArray.from_arrays(offsets, pa.array(counts[rest])),
                ],
                names=["lang", "term", "docs", "sources", "counts"],
            )
            for k in range(0, trie.size, 20_000):
                yield table.slice(k, 20_000)
        self.sources = {}


def _summed(at: np.ndarray, source: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Counts of equal leaf and source added up, by leaf and then by source."""
    order = np.lexsort((source, at))
    at, source, counts = at[order], source[order], counts[order]
    new = np.r_[True, (at[1:] != at[:-1]) | (source[1:] != source[:-1])] if at.size else np.empty(0, bool)
    starts = np.flatnonzero(new)
    return at[starts], source[starts], np.add.reduceat(counts, starts) if starts.size else counts


def counted(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """Leaves of the partitions' tries: ``(lang, term, docs, sources, counts)``, a row for each language, term and trie.

    A task's tries hold at most about :data:`MAX_LEAVES` leaves; then they are written out and new ones begin.
    """
    small_batches(docs.sparkSession)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        held = _Counts()
        for b in batches:
            texts = b.column(0).cast(pa.binary())
            for row in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), texts.to_pylist(), strict=True):
                held.add(*row)
                if held.buffered > BUFFER:
                    held.pour()
                    if held.size() > MAX_LEAVES:
                        yield from held.batches()
        held.pour()
        yield from held.batches()

    return _columns(docs, text, lang, source).mapInArrow(count, LEAVES)


def _columns(docs: DataFrame, text: str, lang: str, source: str) -> DataFrame:
    return docs.select(*(F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).alias(n) for c, n in ((text, "text"), (lang, "lang"), (source, "source"))))


def _merge(batch: pa.RecordBatch) -> pa.RecordBatch:
    """Rows of equal language and term, which stand side by side, as one."""
    n = batch.num_rows
    lang, term = batch.column("lang"), batch.column("term")
    new = np.ones(n, bool)
    if n > 1:
        differs = pc.or_(pc.not_equal(lang.slice(1), lang.slice(0, n - 1)), pc.not_equal(term.slice(1), term.slice(0, n - 1)))
        new[1:] = differs.to_numpy(zero_copy_only=False)
    starts = np.flatnonzero(new)
    if starts.size == n:
        return batch
    sizes = pc.list_value_length(batch.column("sources")).to_numpy(zero_copy_only=False)
    names = batch.column("sources").flatten().dictionary_encode()
    at, source, counts = _summed(
        np.repeat(np.cumsum(new) - 1, sizes), names.indices.to_numpy(zero_copy_only=False).astype(np.int64), batch.column("counts").flatten().to_numpy(zero_copy_only=False)
    )
    offsets = np.searchsorted(at, np.arange(starts.size + 1)).astype(np.int32)
    where = pa.array(starts)
    arrays = (
        lang.take(where),
        term.take(where),
        pa.array(np.add.reduceat(batch.column("docs").to_numpy(zero_copy_only=False), starts)),
        pa.ListArray.from_arrays(offsets, names.dictionary.take(pa.array(source))),
        pa.ListArray.from_arrays(offsets, pa.array(counts)),
    )
    return pa.RecordBatch.from_arrays([a.cast(f.type) for a, f in zip(arrays, batch.schema, strict=True)], schema=batch.schema)


def merged(leaves: DataFrame) -> DataFrame:
    """The tries of :func:`counted` merged by ranges of terms: one row for each language and term.

    ``leaves`` should be a written table, as Spark looks at it twice to find the ranges.
    A term has one row for each trie at most, so no range is longer than the tries are many.
    """

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        carried = None
        for b in batches:
            if not b.num_rows:
                continue
            if carried is not None:
                b = pa.Table.from_batches([carried, b]).combine_chunks().to_batches()[0]
            done = _merge(b)
            carried = done.slice(done.num_rows - 1)
            yield done.slice(0, done.num_rows - 1)
        if carried is not None:
            yield carried

    return leaves.repartitionByRange("lang", "term").sortWithinPartitions("lang", "term").mapInArrow(merge, LEAVES)


def _shares(counts: np.ndarray, of: np.ndarray) -> np.ndarray:
    """1 + floor(UNIT * (count + 1) / of) by three long divisions, so that nothing overflows below 9e15 terms."""
    whole, rest = np.divmod(counts + 1, of)
    for _ in range(3):
        more, rest = np.divmod(rest * 1000, of)
        whole = whole * 1000 + more
    return whole + 1


class _Sums:
    """One task's sums of pairs and candidates of terms, by language and block of sources."""

    def __init__(self):
        self.pairs: dict = {}
        self.best: dict = {}
        self.names: dict[str, list] = {}

    def add(self, lang: str, block: int, names: list, shares: np.ndarray, whole: np.ndarray, counts: np.ndarray, terms_: pa.Array) -> None:
        self.names[lang] = names
        first = block * SOURCE_BLOCK
        mine = range(first, min(first + SOURCE_BLOCK, len(names)))
        if (lang, block) not in self.pairs:
            self.pairs[lang, block] = np.zeros((len(mine), len(names)), np.int64)
        sums = self.pairs[lang, block]
        for i in mine:
            p = shares[:, i]
            gap = p[:, None] - shares
            sums[i - first] += (gap * gap // shares).sum(0)
            value = (p - whole) ** 2 // whole
            least, found = self.best.setdefault((lang, i), (-1, []))
            at = np.flatnonzero((counts[:, i] > 0) & (p > whole) & (value >= least))
            found += zip((-value[at]).tolist(), terms_.take(pa.array(at)).to_pylist(), strict=True)
            if len(found) > 4 * TOP_TERMS:
                found = heapq.nsmallest(TOP_TERMS, found)
                least = -found[-1][0]
            self.best[lang, i] = least, found

    def cells(self) -> int:
        return sum(x.size for x in self.pairs.values())

    def rows(self) -> Iterator[pa.RecordBatch]:
        """``(lang, source, part, item, value)``; afterwards there are none."""
        out = []
        for (lang, block), sums in self.pairs.items():
            names = self.names[lang]
            for i, row in enumerate(sums.tolist(), block * SOURCE_BLOCK):
                out += [(lang, names[i], b"pair", names[j].encode(), x) for j, x in enumerate(row) if j != i]
                if len(out) > 50_000:
                    yield _rows(out)
                    out = []
        for (lang, i), (_, found) in self.best.items():
            out += [(lang, self.names[lang][i], b"term", t, -x) for x, t in heapq.nsmallest(TOP_TERMS, found)]
            if len(out) > 50_000:
                yield _rows(out)
                out = []
        self.pairs, self.best = {}, {}
        yield _rows(out)


def _rows(out: list[tuple]) -> pa.RecordBatch:
    columns = zip(*out, strict=True) if out else [()] * 5
    kinds = (pa.string(), pa.string(), pa.binary(), pa.binary(), pa.int64())
    arrays = [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]
    return pa.RecordBatch.from_arrays([a.cast(pa.string()) if a.type == pa.binary() else a for a in arrays], names=["lang", "source", "part", "item", "value"])


def _scored(kept: DataFrame, by: DataFrame) -> DataFrame:
    """Parts of all pairs' sums and candidates of the terms, from a traversal of the kept terms."""
    blocks = F.explode(F.sequence(F.lit(0), F.floor((F.size("groups") - 1) / SOURCE_BLOCK).cast("int")))
    rows = kept.join(by, "lang").select("lang", blocks.alias("block"), "term", "sources", "counts", F.col("groups.source").alias("names"), F.col("groups.n").alias("sizes"), "v", "n")

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        sums = _Sums()
        for b in batches:
            seen: dict = {}
            keys = np.array([seen.setdefault(k, len(seen)) for k in zip(b.column("lang").to_pylist(), b.column("block").to_pylist(), strict=True)])
            for key in range(len(seen)):
                part = b.take(pa.array(np.flatnonzero(keys == key)))
                lang, block, v = (part.column(c)[0].as_py() for c in ("lang", "block", "v"))
                names, sizes = part.column("names")[0].as_py(), np.array(part.column("sizes")[0].as_py(), np.int64)
                number = {name: k for k, name in enumerate(names)}
                own = part.column("sources").flatten().dictionary_encode()
                column = np.array([number[x] for x in own.dictionary.to_pylist()], np.int64)[own.indices.to_numpy(zero_copy_only=False)]
                row = np.repeat(np.arange(part.num_rows), pc.list_value_length(part.column("sources")).to_numpy(zero_copy_only=False))
                counts = np.zeros((part.num_rows, len(names)), np.int64)
                counts[row, column] = part.column("counts").flatten().to_numpy(zero_copy_only=False)
                whole = _shares(counts.sum(1), np.int64(part.column("n")[0].as_py() + v))
                sums.add(lang, block, names, _shares(counts, sizes + v), whole, counts, part.column("term").cast(pa.binary()))
                if sums.cells() > MAX_CELLS:
                    yield from sums.rows()
        yield from sums.rows()

    return rows.mapInArrow(score, "lang string, source string, part string, item string, value long")


def audited(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """``(lang, source, part, item, value, rank)``: divergences of each source of a language.

    Part ``pair`` has the sum over all kept terms of ``floor((p-q)^2/q)`` against each other source of
    the language, part ``term`` the :data:`TOP_TERMS` terms with the largest value against the
    language as a whole. ``p`` and ``q`` are 1 + floor(10^9 (count + 1) / (N + V)). Ranks count from 1 by
    value, the largest first, then by the item's bytes.

    The table of kept terms is written, and each of its rows meets its language's groups by a join on the
    language, which Spark broadcasts where it is small and splits where it is skewed. The rows grow with the
    square of a language's sources, as the result does.
    """
    leaves = written(counted(docs, text, lang, source), "leaves")
    kept = written(merged(leaves).where(F.col("docs") >= LEAST_DOCS).select("lang", "term", "sources", "counts"), "terms")
    dropped(leaves)
    totals = kept.select("lang", F.explode(F.arrays_zip("sources", "counts")).alias("x")).groupBy("lang", F.col("x.sources").alias("source")).agg(F.sum("x.counts").alias("n"))
    groups = _columns(docs, text, lang, source).select("lang", "source").distinct().join(totals, ["lang", "source"], "left")
    by = groups.groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("source", F.coalesce("n", F.lit(0)).alias("n")))).alias("groups"), F.coalesce(F.sum("n"), F.lit(0)).alias("n"))
    by = written(by.join(kept.groupBy("lang").agg(F.count("*").alias("v")), "lang", "left").na.fill(0, ["v"]), "groups")
    found = written(_scored(kept, by), "divergences")
    dropped(kept)
    sums = found.where("part = 'pair'").groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value"))
    bare = by.where("v = 0").select("lang", F.explode("groups.source").alias("source"), "groups").select("lang", "source", F.lit("pair").alias("part"), F.explode("groups.source").alias("item"), F.lit(0).cast("long").alias("value")).where("source <> item")
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    pairs = sums.unionByName(bare).withColumn("rank", F.row_number().over(order))
    top = found.where("part = 'term'").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= TOP_TERMS)
    return pairs.unionByName(top)


ORACLE = r"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
w AS (SELECT r, lang, source, unnest(regexp_extract_all(t, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
kept AS (SELECT lang, term FROM w GROUP BY lang, term HAVING count(DISTINCT r) >= 3),
c AS (SELECT lang, source, term, count(*) AS n FROM w JOIN kept USING (lang, term) GROUP BY lang, source, term),
v AS (SELECT lang, count(*) AS v FROM kept GROUP BY lang),
g AS (SELECT g.lang, g.source, coalesce(sum(n), 0) AS s FROM (SELECT DISTINCT lang, source FROM d) g LEFT JOIN c ON c.lang = g.lang AND c.source = g.source GROUP BY g.lang, g.source),
p AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, CAST(1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 1)::HUGEINT) // (g.s + v.v)::HUGEINT AS HUGEINT) AS p
    FROM g JOIN v ON v.lang = g.lang JOIN kept k ON k.lang = g.lang LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
q AS (SELECT l.lang, l.term, CAST(1 + (1000000000::HUGEINT * (l.n + 1)::HUGEINT) // (t.s + v.v)::HUGEINT AS HUGEINT) AS q
    FROM (SELECT lang, term, sum(n) AS n FROM c GROUP BY lang, term) l JOIN (SELECT lang, sum(s) AS s FROM g GROUP BY lang) t ON t.lang = l.lang JOIN v ON v.lang = l.lang),
pair AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // b.p) AS value
    FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY a.lang, a.source, b.source
  UNION ALL SELECT a.lang, a.source, 'pair', b.source, 0 FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source WHERE a.lang NOT IN (SELECT lang FROM v)),
term AS (SELECT p.lang, p.source, 'term' AS part, p.term AS item, ((p.p - q.q) * (p.p - q.q)) // q.q AS value
    FROM p JOIN q ON p.lang = q.lang AND p.term = q.term WHERE p.n > 0 AND p.p > q.q),
both_ AS (SELECT * FROM pair UNION ALL SELECT * FROM term),
ranked AS (SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank FROM both_)
SELECT * FROM ranked WHERE part = 'pair' OR rank <= 200
"""
