"""Exact quantiles of groups of any size, without a map of a group's values in one task.

Values are counted per group, range-partitioned by group and value, and written, so that a
group may spread over many partitions. A row a group and partition tells whether wanted ranks
lie in it; only what holds one is read again, and finds its ranks by a running count.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from matchbook.operators.prefix import ranged


def _same(a: Sequence[str], b: Sequence[str]) -> Column:
    return reduce(Column.__and__, (F.col(x).eqNullSafe(F.col(y)) for x, y in zip(a, b, strict=True)), F.lit(True))


def at_ranks(rows: DataFrame, by: Sequence[str], value: str | Column, wanted: Callable[[Column], Sequence[Column]], weight: Column | None = None) -> DataFrame:
    """by, n and at: of each group the number of its values and an array of those at the
    wanted ranks (from 0, ascending), null where there is no such rank. wanted gives a few
    ranks from n. Null values and NaN are no values, groups without others have no row; a null
    key is a group, and without `by` all rows are one. weight: how often a row counts, if not
    once; rows with weights are taken to be counted already and are not counted again."""
    keys = [f"__k{i}" for i in range(len(by))]
    v = F.col(value) if isinstance(value, str) else value
    given = rows.select(*[F.col(c).alias(k) for c, k in zip(by, keys, strict=True)], F.nanvl(v.cast("double"), F.lit(None)).alias("__v"), (F.lit(1) if weight is None else weight).cast("long").alias("__w"))
    counts = given.where("__v IS NOT NULL")
    # equal values lie in one partition either way, so weighted ones may repeat
    counts = counts.withColumnRenamed("__w", "__c") if weight is not None else counts.groupBy(*keys, "__v").agg(F.sum("__w").alias("__c"))
    placed = ranged(counts, [*keys, "__v"], "ranks")

    # a row a group and partition
    group = Window.partitionBy(*keys)
    before = F.coalesce(F.sum("here").over(group.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = placed.groupBy(*keys, "__part").agg(F.sum("__c").alias("here")).withColumns({"before": before, "n": F.sum("here").over(group)})
    ranks = [r.cast("long") for r in wanted(F.col("n"))]
    here = reduce(Column.__or__, ((r >= F.col("before")) & (r < F.col("before") + F.col("here")) for r in ranks))
    parts = parts.where(here).select(*[F.col(k).alias(f"_{k}") for k in keys], F.col("__part").alias("__of"), "before", "n")

    inside = Window.partitionBy(*keys, "__part").orderBy("__v").rowsBetween(Window.unboundedPreceding, 0)
    read = placed.join(parts, (F.col("__part") == F.col("__of")) & _same(keys, [f"_{k}" for k in keys]))
    read = read.withColumn("upto", F.col("before") + F.sum("__c").over(inside))
    hit = [F.max(F.when((r < F.col("upto")) & (r >= F.col("upto") - F.col("__c")), F.col("__v"))) for r in ranks]
    found = read.groupBy(*keys, "n").agg(F.array(*hit).alias("at"))
    return found.select(*[F.col(k).alias(c) for c, k in zip(by, keys, strict=True)], "n", "at")


def quantiles(rows: DataFrame, by: Sequence[str], value: str | Column, shares: Sequence[float]) -> DataFrame:
    """by and q: an array of the quantiles at these shares, by linear interpolation between
    the two values around a rank. Groups and values as in at_ranks."""

    def places(n: Column) -> list[Column]:
        return [F.lit(float(p)) * (n - 1) for p in shares]

    found = at_ranks(rows, by, value, lambda n: [f(x) for x in places(n) for f in (F.floor, F.ceil)])

    def between(i: int, x: Column) -> Column:
        low, high = F.col("at")[2 * i], F.col("at")[2 * i + 1]
        return low + (high - low) * (x - F.floor(x))

    return found.select(*by, F.array(*[between(i, x) for i, x in enumerate(places(F.col("n")))]).alias("q"))


def with_quantiles(groups: DataFrame, rows: DataFrame, by: Sequence[str], value: str | Column, shares: Mapping[str, float]) -> DataFrame:
    """groups (a row each of `by`; one row without) with a column for each named share of
    rows' values, null where a group has no value."""
    q = quantiles(rows, by, value, list(shares.values())).select(*[F.col(c).alias(f"__by{i}") for i, c in enumerate(by)], F.col("q").alias("__q"))
    # without keys both sides are one row
    joined = groups.join(q, _same(by, [f"__by{i}" for i in range(len(by))]), "left") if by else groups.join(F.broadcast(q), F.lit(True), "left")
    return joined.select(*groups.columns, *[F.col("__q")[i].alias(name) for i, name in enumerate(shares)])
