"""Exact medians and other values by rank, for keys with any number of rows.

A key of up to :data:`LISTED` values is sorted as one list. For larger ones the value is found in rounds: a
bounded sketch of each key's values gives two of them with the wanted rank between, the values
below, at, between and above those are counted, and only the ones strictly between go on. A round
leaves about a hundredth of them, however many are equal, so a few rounds do for any number; no
list, sort or task ever holds a large key.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from colloquy.sources.scratch import written

#: Values of a key that are sorted as one list; points of a sketch, whose ranks are right to a tenth of their distance.
LISTED, POINTS = 1_000_000, 256

#: Places of ranks, from 0, by the number of values.
LOWER: Callable[[Column], Column] = lambda n: F.floor((n - 1) / 2)
UPPER: Callable[[Column], Column] = lambda n: F.floor(n / 2)


def by_rank(rows: DataFrame, by: list[str], value: str, places: dict[str, Callable[[Column], Column]], listed: int | None = None) -> DataFrame:
    """``by`` and, for each name of ``places``, the value at that place of the key's values in order.

    Nulls don't count, and a key that has nothing else is left out. Equal values are equal, whatever the order.
    """
    listed = LISTED if listed is None else listed
    x = rows.where(F.col(value).isNotNull()).select(*by, F.col(value).cast("double").alias("_x"))
    n = x.groupBy(*by).agg(F.count("*").alias("_n"))
    large = n.where(F.col("_n") > listed)
    if (n.agg(F.max("_n")).first()[0] or 0) <= listed:
        return _listed(x, by, places)
    large = written(large, "large-keys")
    mine = x.join(large.select(*by), _same(x, large, by), "left_semi")
    rest = x.join(large.select(*by), _same(x, large, by), "left_anti")
    return _listed(rest, by, places).unionByName(_in_rounds(mine, large, by, places, listed))


def _same(a: DataFrame, b: DataFrame, by: list[str]) -> Column:
    """Equal keys, nulls too."""
    out = F.lit(True)
    for c in by:
        out = out & a[c].eqNullSafe(b[c])
    return out


def _listed(x: DataFrame, by: list[str], places: dict) -> DataFrame:
    lists = x.groupBy(*by).agg(F.sort_array(F.collect_list("_x")).alias("_s"))
    return lists.select(*by, *(F.get("_s", place(F.size("_s")).cast("int")).alias(name) for name, place in places.items()))


def _in_rounds(x: DataFrame, large: DataFrame, by: list[str], places: dict, listed: int) -> DataFrame:
    wanted = F.explode(F.array(*(F.struct(F.lit(name).alias("name"), place(F.col("_n")).cast("long").alias("k")) for name, place in places.items())))
    none = F.lit(None).cast("double")
    state = written(large.select(*by, wanted.alias("w"), "_n").select(*by, "w.name", "w.k", F.col("_n").alias("m"), none.alias("lo"), none.alias("hi")), "ranks")
    found = None
    key = [*by, "name"]
    while not state.isEmpty():
        open_ = x.join(state, _same(x, state, by)).select(*(state[c] for c in state.columns), "_x")
        open_ = open_.where((F.col("lo").isNull() | (F.col("_x") > F.col("lo"))) & (F.col("hi").isNull() | (F.col("_x") < F.col("hi"))))
        few = open_.where(F.col("m") <= listed).groupBy(*key).agg(F.sort_array(F.collect_list("_x")).alias("_s"), F.first("k").alias("k"))
        done = few.select(*key, F.get("_s", F.col("k").cast("int")).alias("v"))
        many = open_.where(F.col("m") > listed)
        sketch = many.groupBy(*key).agg(F.percentile_approx("_x", [i / POINTS for i in range(POINTS + 1)], 10 * POINTS).alias("q"))
        at = F.floor(F.col("k") * POINTS / F.col("m")).cast("int")
        ends = many.join(sketch.withColumnsRenamed({c: f"_{c}" for c in key}), [many[c].eqNullSafe(F.col(f"_{c}")) for c in key])
        ends = ends.withColumns({"l": F.get("q", F.greatest(at - 1, F.lit(0))), "u": F.get("q", F.least(at + 2, F.lit(POINTS)))})
        count = lambda c: F.count_if(c)
        v = F.col("_x")
        seen = ends.groupBy(*key).agg(
            F.first("k").alias("k"), F.first("m").alias("m"), F.first("lo").alias("lo"), F.first("hi").alias("hi"), F.first("l").alias("l"), F.first("u").alias("u"),
            count(v < F.col("l")).alias("a"), count(v == F.col("l")).alias("b"),
            count((v > F.col("l")) & (v < F.col("u"))).alias("c"), count((v == F.col("u")) & (F.col("u") > F.col("l"))).alias("d"),
        )
        a, b, c, d, k = (F.col(x_) for x_ in "abcdk")
        part = F.when(k < a, 0).when(k < a + b, 1).when(k < a + b + c, 2).when(k < a + b + c + d, 3).otherwise(4)
        seen = written(seen.withColumn("part", part), "counts")
        hit = seen.where("part in (1, 3)").select(*key, F.when(F.col("part") == 1, F.col("l")).otherwise(F.col("u")).alias("v"))
        now = written(done.unionByName(hit), "found")
        found = now if found is None else found.unionByName(now)
        p = F.col("part")
        state = written(
            seen.where("part in (0, 2, 4)").select(
                *key, (k - F.when(p == 0, 0).when(p == 2, a + b).otherwise(a + b + c + d)).alias("k"),
                F.when(p == 0, a).when(p == 2, c).otherwise(F.col("m") - a - b - c - d).alias("m"),
                F.when(p == 0, F.col("lo")).when(p == 2, F.col("l")).otherwise(F.col("u")).alias("lo"),
                F.when(p == 0, F.col("l")).when(p == 2, F.col("u")).otherwise(F.col("hi")).alias("hi"),
            ),
            "ranks",
        )
    return found.groupBy(*by).agg(*(F.max(F.when(F.col("name") == name, F.col("v"))).alias(name) for name in places))


def medians(rows: DataFrame, by: list[str], value: str, name: str = "median", listed: int | None = None) -> DataFrame:
    """``by`` and the exact median of each key, the mean of two middle values."""
    both = by_rank(rows, by, value, {"_a": LOWER, "_b": UPPER}, listed)
    return both.select(*by, (F.col("_a") * 0.5 + F.col("_b") * 0.5).alias(name))
