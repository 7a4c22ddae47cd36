"""SimHash near-duplicates: 64-bit fingerprints linked through BK-trees.

Every fingerprint goes to four shards, one for each of its 16-bit blocks: two
fingerprints that differ in at most three bits agree on one block, so they meet
in a shard and no link is lost. Each shard is a BK-tree: a child hangs below its
parent by the Hamming distance of the two, and a search follows only the edges
whose distance is within the radius of the distance to the node. All trees of a
block of shards are built and searched together, level by level, in numpy.

The trees reach their queries by the shuffle on the shard key. Broadcasting them
would need all fingerprints on the driver.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import islice

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from colloquy.llm.components import components
from colloquy.llm.shared import arrow_map, forget, unused, written

SEED = 42
SHINGLE_WORDS = 3
RADIUS = 3
#: Shards with more fingerprints are dealt again by the blocks of their other 48 bits.
SHARD_ROWS = 20_000
#: Fingerprints whose trees are searched together, and pairs of query and node held at once.
FOREST_ROWS, FRONTIER = 200_000, 2_000_000
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_CHUNK = 1 << 16


def fingerprint(text: str | None, width: int = SHINGLE_WORDS) -> int:
    """The SimHash of one text as an unsigned integer; 0 for null and texts without words."""
    words = (text or "").encode().translate(_LOWER).split()
    if not words:
        return 0
    if len(words) < width:
        return xxhash.xxh64_intdigest(b" ".join(words), SEED)
    shingles, ones, total = zip(*(words[i:] for i in range(width))), np.zeros(64, np.int64), 0
    while part := [xxhash.xxh64_intdigest(b" ".join(s), SEED) for s in islice(shingles, _CHUNK)]:
        codes = np.array(part, np.uint64)
        ones += np.unpackbits(codes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
        total += len(part)
    return int(np.packbits(2 * ones > total, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns and ``fp``, the fingerprint's 64 bits as a signed long; a kept column of that name gives way."""

    def make():
        forget()
        return lambda texts: [np.array([fingerprint(t) for t in texts], np.uint64).view(np.int64)]

    return arrow_map(docs, [text], T.StructType([T.StructField("fp", T.LongType())]), make, keep)


def _labels(n: int) -> np.ndarray:
    return np.arange(n)


def _unite(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Give linked rows the least label of both, in place, until nothing changes."""
    while a.size:
        x, y = label[a], label[b]
        differ = x != y
        if not differ.any():
            return
        a, b, x, y = a[differ], b[differ], x[differ], y[differ]
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while not np.array_equal(up := label[label], label):
            label[:] = up


def _forest(shard: np.ndarray, fp: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """BK-trees of rows sorted by shard: each row's root, and (edge keys, children) in key order.

    A child's edge key is 65 * parent + distance.
    """
    first = np.r_[True, shard[1:] != shard[:-1]]
    root = np.maximum.accumulate(np.where(first, np.arange(shard.size), 0))
    rows = np.flatnonzero(~first)
    at, keys, children = root[rows], [], []
    while rows.size:
        key = at * 65 + np.bitwise_count(fp[rows] ^ fp[at])
        edge, lead, inverse = np.unique(key, return_index=True, return_inverse=True)
        child = rows[lead]
        keys.append(edge)
        children.append(child)
        rest = np.ones(rows.size, bool)
        rest[lead] = False
        rows, at = rows[rest], child[inverse][rest]
    if not keys:
        return root, np.empty(0, np.int64), np.empty(0, np.int64)
    key, child = np.concatenate(keys), np.concatenate(children)
    order = np.argsort(key)
    return root, key[order], child[order]


def linked(shard: np.ndarray, fp: np.ndarray, radius: int = RADIUS) -> np.ndarray:
    """For rows sorted by shard, the first row of each row's component within its shard."""
    root, keys, children = _forest(shard, fp)
    label = _labels(fp.size)
    size = np.bincount(root, minlength=fp.size)[root]
    asked = np.flatnonzero(size > 1)
    reach = np.cumsum(size[asked])
    lo = 0
    while lo < asked.size:
        hi = max(lo + 1, int(np.searchsorted(reach, (reach[lo - 1] if lo else 0) + FRONTIER)))
        query = asked[lo:hi]
        node = root[query]
        while query.size:
            d = np.bitwise_count(fp[query] ^ fp[node]).astype(np.int64)
            near = (d <= radius) & (query != node)
            _unite(label, query[near], node[near])
            begin = np.searchsorted(keys, node * 65 + np.maximum(d - radius, 0))
            count = np.searchsorted(keys, node * 65 + np.minimum(d + radius, 64), "right") - begin
            total = int(count.sum())
            step = np.arange(total) - np.repeat(np.cumsum(count) - count, count)
            query, node = np.repeat(query, count), children[np.repeat(begin, count) + step]
        lo = hi
    return label


def _search(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows sorted by shard -> links (a, b) from each row to the first of its component."""

    def links(held: pd.DataFrame) -> pd.DataFrame:
        fp = held["fp"].to_numpy()
        label = linked(held["shard"].to_numpy(), fp.view(np.uint64))
        own = np.flatnonzero(label != np.arange(label.size))
        return pd.DataFrame({"a": fp[own], "b": fp[label[own]]})

    held: list[pd.DataFrame] = []
    rows = 0
    for part in parts:
        held.append(part)
        rows += len(part)
        if rows >= FOREST_ROWS:
            whole = pd.concat(held, ignore_index=True)
            open_ = (whole["shard"] == whole["shard"].iat[-1]).to_numpy()
            if not open_.all():
                yield links(whole[~open_].reset_index(drop=True))
                whole = whole[open_].reset_index(drop=True)
            held, rows = [whole], 0
    if held:
        yield links(pd.concat(held, ignore_index=True))


def _block(x, bits: int, k: int):
    return F.shiftrightunsigned(x, bits * k).bitwiseAND(F.lit((1 << bits) - 1))


def shards(fps: DataFrame, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """``(shard, fp)``: each fingerprint under its four blocks.

    A shard over ``shard_rows`` is dealt again by four 12-bit blocks of the bits
    outside its own block, on one of which fingerprints within the radius agree too.
    The table of such shards holds at most 4 * 65536 ids, which bounds its broadcast.
    """
    x = F.col("fp")
    first = fps.select(
        "fp", F.explode(F.array(*(F.lit(k << 16).cast("long") + _block(x, 16, k) for k in range(4)))).alias("shard")
    )
    large = first.groupBy("shard").count().where(F.col("count") > shard_rows).select("shard", F.lit(True).alias("large"))
    dealt = first.join(F.broadcast(large), "shard", "left")
    low = F.expr("shiftleft(1L, cast(16 * shiftright(shard, 16) as int)) - 1L")  # bits below the shard's own block
    other = x.bitwiseAND(low).bitwiseOR(F.expr("shiftrightunsigned(fp, 16)").bitwiseAND(F.bitwise_not(low)))
    again = F.array(*(F.lit(1 << 40) + F.col("shard") * (1 << 14) + F.lit(k << 12) + _block(other, 12, k) for k in range(4)))
    return dealt.select("fp", F.explode(F.when(F.col("large"), again).otherwise(F.array("shard"))).alias("shard"))


def fingerprint_components(fps: DataFrame, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """Distinct ``fp`` -> ``(node, component)`` for the fingerprints that have a link."""
    found = (
        shards(fps, shard_rows).repartition(F.col("shard")).sortWithinPartitions("shard", "fp").mapInPandas(_search, "a long, b long")
    )
    return components(found)


def near_duplicates(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shard_rows: int = SHARD_ROWS
) -> DataFrame:
    """One row per document: ``doc_id, text_key, fp, component_id, first``.

    ``component_id`` is the least id that can be reached over links of three or fewer
    differing bits (null if all of them are null). ``text_key`` (xxhash64 of the
    text) with the id names a row; ``first`` is true for the component's least
    (id, text_key), so rows that are repeated whole share it. Null and empty texts
    have fingerprint zero and link like any other; very long texts are read whole. Other
    columns of ``docs`` don't matter, whatever their names; an empty table gives no rows.
    """
    keyed = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text"), F.xxhash64(f"`{text}`").alias("text_key"))
    rows = written(fingerprints(keyed, "text", ("doc_id", "text_key")), "fingerprints")
    fps = written(
        rows.groupBy("fp").agg(F.min("doc_id").alias("least_id"), F.min(F.struct("doc_id", "text_key")).alias("least")), "distinct"
    )
    found = fingerprint_components(fps.select("fp"), shard_rows)
    member = fps.join(found.withColumnRenamed("node", "fp"), "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    group = member.groupBy("component").agg(F.min("least_id").alias("component_id"), F.min("least").alias("least"))
    by_fp = member.select("fp", "component").join(group, "component").drop("component")
    return rows.join(by_fp, "fp").select(
        "doc_id", "text_key", "fp", "component_id", F.struct("doc_id", "text_key").eqNullSafe(F.col("least")).alias("first")
    )


def firsts(docs: DataFrame, found: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay: one of each component of :func:`near_duplicates`.

    Of rows that have the least id and text of their component, the first by hash and values of
    the other columns stays. Columns may have any names and come back unchanged.
    A task keeps one row of each id and text before any moves, so that rows repeated by the million are
    no large group anywhere.
    """
    # One hash partitioning by these three serves the join and the window.
    row = unused(docs.columns, "id", "no_id", "key")
    other, nth = unused(docs.columns, "other", "nth")
    own = F.col(f"`{doc_id}`")
    values = lambda c: (F.coalesce(c, F.lit(0)), F.isnull(c))
    least = found.where("first").select(*(x.alias(n) for x, n in zip((*values(F.col("doc_id")), F.col("text_key")), row)))
    keyed = docs.select("*", *(x.alias(n) for x, n in zip((*values(own), F.xxhash64(f"`{text}`")), row)))
    # Maps have neither an order nor a hash of their own; as text they have both.
    rest = [F.to_json(F.struct(F.col(f"`{f.name}`"))) if "map<" in f.dataType.simpleString() else F.col(f"`{f.name}`") for f in docs.schema if f.name != text]
    by = Window.partitionBy(*row).orderBy(other, *rest)
    one = keyed.withColumn(other, F.xxhash64(*rest)).withColumn(nth, F.row_number().over(by)).where(F.col(nth) == 1)
    return one.join(least.distinct(), row, "left_semi").select(*(F.col(f"`{c}`") for c in docs.columns))
