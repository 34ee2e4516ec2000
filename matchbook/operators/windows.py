"""Ordered analytics: sessions, top rows, ranks, leave-one-out, corrections."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from matchbook.operators.prefix import ranged, running_sums
from matchbook.operators.quantiles import at_ranks
from matchbook.session import stage_table


def sessions(rows: DataFrame, keys: Sequence[str], t: str, gap: int, id_col: str) -> DataFrame:
    """rows with session (from 1, per key; null keys are keys): a row more than `gap`
    microseconds after the one before starts a new one; exactly `gap` stays. t is in
    microseconds. Without keys all rows are one sequence.

    A segmented scan: rows lie in range partitions of key and time, so a hot key is spread over
    many, and are cut within them. Of each key and partition one row tells the first and the
    last time and the number of starts; from these follows how many sessions begin before a
    partition and whether it goes on with the last. Only keys that cross into a partition
    have something to carry: one a partition at most."""
    names = [f"__k{i}" for i in range(len(keys))]
    placed = ranged(rows, [*keys, t, id_col], "sessions").withColumns(dict(zip(names, map(F.col, keys), strict=True)))
    w = Window.partitionBy(*names, "__part").orderBy(t, id_col)
    cut = placed.withColumn("__starts", F.when(F.col(t) - F.lag(t).over(w) <= gap, 0).otherwise(1)).withColumn("session", F.sum("__starts").over(w))
    parts = cut.groupBy(*names, "__part").agg(F.min(t).alias("first"), F.max(t).alias("last"), F.sum("__starts").alias("n"))
    order = Window.partitionBy(*names).orderBy("__part")
    goes_on = F.coalesce((F.col("first") - F.lag("last").over(order) <= gap).cast("int"), F.lit(0))
    parts = parts.withColumn("goes_on", goes_on).withColumn("__base", F.sum(F.col("n") - F.col("goes_on")).over(order) - F.col("n"))
    carried = parts.where("__base <> 0").select(*[F.col(k).alias(f"_{k}") for k in names], F.col("__part").alias("__of"), "__base")
    same = F.col("__part") == F.col("__of")
    for k in names:
        same = same & F.col(k).eqNullSafe(F.col(f"_{k}"))
    out = cut.join(F.broadcast(carried), same, "left")  # a row a partition at most
    return out.withColumn("session", F.col("session") + F.coalesce("__base", F.lit(0))).select(*rows.columns, "session")


def top(rows: DataFrame, by: Sequence[str], order: Sequence[Column], n: int = 1, rank: str = "rank") -> DataFrame:
    """The first n rows of each group; the order must end in a unique column."""
    return rows.withColumn(rank, F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col(rank) <= n)


def average_rank(rows: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """rows with average_rank of the value in its group, ties sharing their mean, and min_rank
    from the top, ties sharing the best; nulls are left out by the caller. Rows are not sorted: distinct values are counted, their ranks are running
    counts over range partitions, and rows look theirs up."""
    keys = [*by, value]
    own = [f"__r{i}" for i in range(len(keys))]
    counts = rows.groupBy(*[F.col(c).alias(o) for c, o in zip(keys, own, strict=True)]).agg(F.count("*").alias("__c"))
    sizes = counts.groupBy(*[F.col(o).alias(f"_{o}") for o in own[:-1]]).agg(F.sum("__c").alias("__n"))
    of = reduce(Column.__and__, (F.col(o).eqNullSafe(F.col(f"_{o}")) for o in own[:-1]), F.lit(True))
    ranks = running_sums(counts, own[:-1], own[-1], ["__c"]).join(sizes, of)
    above = F.col("__n") - F.col("before___c") - F.col("__c")
    ranks = ranks.select(*own, (F.col("before___c") + 1 + (F.col("__c") - 1) / 2).alias("average_rank"), (above + 1).alias("min_rank"))
    same = reduce(Column.__and__, (F.col(c).eqNullSafe(F.col(o)) for c, o in zip(keys, own, strict=True)))
    return rows.join(stage_table(ranks, "ranks").hint("shuffle_hash"), same).drop(*own)


def spread_picks(rows: DataFrame, by: Sequence[str], order: Sequence[Column], k: int) -> DataFrame:
    """k rows of each group at even distances of its order, first and last included; all of
    a group of at most k."""
    w = Window.partitionBy(*by).orderBy(*order)
    n = F.count("*").over(Window.partitionBy(*by))
    marked = rows.withColumn("at", F.row_number().over(w) - 1).withColumn("of", n)
    place = F.floor(F.col("at") * (k - 1) / F.greatest(F.col("of") - 1, F.lit(1)) + 0.5)
    before = F.floor((F.col("at") - 1) * (k - 1) / F.greatest(F.col("of") - 1, F.lit(1)) + 0.5)
    return marked.where((F.col("of") <= k) | (F.col("at") == 0) | (place != before))


def leave_one_out(groups: DataFrame, by: Sequence[str], id_col: str, value: str) -> DataFrame:
    """For each row the median and the scaled median absolute deviation of the other rows of
    its group, the difference from that median and its robust z. Null values have no peers'
    part. Alone in a group: nulls.

    A row's peers' median depends only on whether its value lies below, at or above the middle
    one, so a group has at most three of them (and that of all, for null values); it takes the
    three values around the middle, found by their ranks over range partitions. The same holds
    for the distances from each of these medians. So no group is ranked in one task, and rows
    only meet what is known of their group. NaN counts as null."""
    usual = [F.col(c).isNotNull() for c in by]
    rows = groups.where(reduce(lambda x, y: x & y, usual)) if usual else groups
    v = F.nanvl(F.col(value).cast("double"), F.lit(None))

    def middle(df: DataFrame, keys: Sequence[str], x: Column, weight: Column) -> DataFrame:
        """keys, __n, the middle value __p1 and medians: without a value below, at or above
        the middle one, and of all."""
        found = at_ranks(df, keys, x, lambda n: [F.floor(n / 2) + d for d in (-1, 0, 1)], weight)
        even, (p0, p1, p2) = F.col("n") % 2 == 0, (F.col("at")[i] for i in range(3))
        left_out = (F.when(even, p1).otherwise((p1 + p2) / 2), (p0 + p2) / 2, F.when(even, p0).otherwise((p0 + p1) / 2), F.when(even, (p0 + p1) / 2).otherwise(p1))
        return found.select(*keys, F.struct(F.col("n").alias("n"), p1.alias("p1"), F.array(*left_out).alias("m")).alias("__of"))

    def case(x: Column, of: str) -> Column:
        p1, odd = F.col(f"{of}.p1"), F.col(f"{of}.n") % 2 == 1
        return F.when(x < p1, 0).when((x == p1) & odd, 1).otherwise(2)

    keys = [f"__g{i}" for i in range(len(by))]
    named = [F.col(c).alias(k) for c, k in zip(by, keys, strict=True)]
    counts = stage_table(rows.groupBy(*named, v.alias("__v")).agg(F.count("*").alias("__n")), "peers")
    medians = stage_table(middle(counts, keys, F.col("__v"), F.col("__n")), "peers-medians")
    # each distinct value of a group at its distance from each of the group's medians
    away = counts.join(medians.select(*keys, F.posexplode("__of.m").alias("__c", "__m")), keys).where("__m IS NOT NULL")
    scales = middle(away, [*keys, "__c"], F.abs(F.col("__v") - F.col("__m")), F.col("__n")).withColumnRenamed("__of", "__scale")

    on = reduce(lambda x, y: x & y, (F.col(c) == F.col(k) for c, k in zip(by, keys, strict=True)), F.lit(True))
    met = rows.join(medians, on, "left").drop(*keys).withColumn("__case", F.when(v.isNull(), 3).otherwise(case(v, "__of")))
    met = met.withColumn("peer_median", F.col("__of.m")[F.col("__case")])
    met = met.join(scales, on & (F.col("__case") == F.col("__c")), "left")
    own = F.when(F.col("__case") == 3, 3).otherwise(case(F.abs(v - F.col("peer_median")), "__scale"))
    out = met.withColumn("peer_scale", 1.4826 * F.col("__scale.m")[own]).withColumn("delta", v - F.col("peer_median"))
    return out.withColumn("z", F.col("delta") / F.nullif(F.col("peer_scale"), F.lit(0.0))).select(*groups.columns, "peer_median", "peer_scale", "delta", "z")


def median_of(sorted_array: str) -> Column:
    """Median of a sorted array, null if empty."""
    a, n = F.col(sorted_array), F.size(sorted_array)
    return F.when(n > 0, (F.get(a, F.floor((n - 1) / 2).cast("int")) + F.get(a, F.floor(n / 2).cast("int"))) / 2)


def benjamini_hochberg(rows: DataFrame, p: str) -> DataFrame:
    """rows with q: p * n / rank, made monotone from the largest p down, at most 1. Ties share
    the best of their ranks' values. Null p and NaN are no tests and have a null q.

    Ranks are running counts over range partitions; the least value from a p up is that of its
    partition's later rows and of one row a later partition."""
    x = F.nanvl(F.col(p).cast("double"), F.lit(None))
    counts = rows.where(x.isNotNull()).groupBy(x.alias("__p")).agg(F.count("*").alias("__c"))
    ranks = running_sums(counts, [], "__p", ["__c"])
    n = counts.agg(F.sum("__c").alias("__n"))
    # the last of equal p has the least value
    raw = ranks.join(F.broadcast(n)).select("__p", (F.col("__p") * F.col("__n") / (F.col("before___c") + F.col("__c"))).alias("__raw"))
    placed = ranged(raw, ["__p"], "bh")
    later = Window.orderBy("__part").rowsBetween(1, Window.unboundedFollowing)  # a row a partition
    behind = placed.groupBy("__part").agg(F.min("__raw").alias("low")).select(F.col("__part").alias("__of"), F.min("low").over(later).alias("__behind"))
    up = F.min("__raw").over(Window.partitionBy("__part").orderBy("__p").rowsBetween(0, Window.unboundedFollowing))
    found = placed.withColumn("__up", up).join(F.broadcast(behind), F.col("__part") == F.col("__of")).select("__p", F.least(F.lit(1.0), F.col("__up"), F.col("__behind")).alias("q"))
    return rows.join(found, x == F.col("__p"), "left").drop("__p")
