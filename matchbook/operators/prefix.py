"""Running sums and nearest values over one long axis, without a window over all rows in one task.

Rows are range-partitioned by the axis and written, so that a row's partition is fixed. A
window works within each partition; of what lies before or behind, a row a partition is enough.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from matchbook.session import stage_table


def ranged(rows: DataFrame, order: Sequence[str | Column], name: str, parts: int | None = None) -> DataFrame:
    """rows with __part: partitions in the order of the columns, fixed by a write."""
    columns = list(order) if parts is None else [parts, *order]
    return stage_table(rows.repartitionByRange(*columns).withColumn("__part", F.spark_partition_id()), name)


def running_sums(rows: DataFrame, by: Sequence[str], order: str, values: Sequence[str]) -> DataFrame:
    """rows with before_<value>: the sum over the group's rows of a smaller order, which is
    unique within a group. Null groups are a group."""
    keys = [f"__k{i}" for i in range(len(by))]
    placed = ranged(rows, [*by, order], "running").withColumns(dict(zip(keys, map(F.col, by), strict=True)))
    sums = placed.groupBy(*keys, "__part").agg(*[F.sum(v).alias(f"__s_{v}") for v in values])
    # a row a group and partition; one window partition a group
    earlier = Window.partitionBy(*keys).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    carried = sums.select(*[F.col(k).alias(f"_{k}") for k in keys], F.col("__part").alias("__of"), *[F.coalesce(F.sum(f"__s_{v}").over(earlier), F.lit(0)).alias(f"__c_{v}") for v in values])
    same = F.col("__part") == F.col("__of")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_{k}"))
    inside = Window.partitionBy(*keys, "__part").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    full = placed.join(carried, same).withColumns({f"before_{v}": F.col(f"__c_{v}") + F.coalesce(F.sum(v).over(inside), F.lit(0)) for v in values})
    return full.select(*rows.columns, *[f"before_{v}" for v in values])


def around(points: DataFrame, x: str, axis: DataFrame, y: str) -> DataFrame:
    """points with lower (largest y at or below x) and upper (smallest y at or above it);
    null where there is none, or x is null."""
    given = points.select(F.struct(*points.columns).alias("__row"), F.col(x).cast("double").alias("__x"))
    marks = axis.where(F.col(y).isNotNull()).select(F.col(y).cast("double").alias("__y")).distinct()
    both = given.select("__row", "__x", F.lit(None).cast("double").alias("__y")).unionByName(marks.select(F.lit(None).cast(given.schema["__row"].dataType).alias("__row"), F.col("__y").alias("__x"), "__y"))
    placed = ranged(both, ["__x"], "around")
    ends = placed.groupBy("__part").agg(F.max("__y").alias("high"), F.min("__y").alias("low"))
    by_part = Window.orderBy("__part")  # a row a partition
    ends = ends.select(F.col("__part").alias("__of"), F.max("high").over(by_part.rowsBetween(Window.unboundedPreceding, -1)).alias("__below"), F.min("low").over(by_part.rowsBetween(1, Window.unboundedFollowing)).alias("__above"))
    # a frame by range takes in equal values
    inside = Window.partitionBy("__part").orderBy("__x")
    low = F.max("__y").over(inside.rangeBetween(Window.unboundedPreceding, 0))
    high = F.min("__y").over(inside.rangeBetween(0, Window.unboundedFollowing))
    found = placed.withColumns({"lower": low, "upper": high}).where("__row IS NOT NULL").join(ends, F.col("__part") == F.col("__of"))
    seen = F.col("__x").isNotNull()
    return found.select("__row.*", F.when(seen, F.coalesce("lower", "__below")).alias("lower"), F.when(seen, F.coalesce("upper", "__above")).alias("upper"))


def nearest_on_axis(points: DataFrame, x: str, axis: DataFrame, y: str, within: float | None = None) -> DataFrame:
    """points with nearest (the closest y, ties to the smaller) and gap; null beyond `within`."""
    found = around(points, x, axis, y)
    down, up = F.col(x) - F.col("lower"), F.col("upper") - F.col(x)
    found = found.withColumn("nearest", F.when(F.col("upper").isNull() | (down <= up), F.col("lower")).otherwise(F.col("upper")))
    found = found.withColumn("gap", F.abs(F.col(x) - F.col("nearest")))
    if within is not None:
        near = F.col("gap") <= within
        found = found.withColumns({"nearest": F.when(near, F.col("nearest")), "gap": F.when(near, F.col("gap"))})
    return found.drop("lower", "upper")
