"""Rows numbered by their place in files, and joins by that number.

A row's place is its file (by path), the block of the file it was read from, and its order
within the block. Rows are counted a block at a time and blocks are added up, so numbering
neither sorts all rows nor depends on how they were dealt to tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from matchbook.session import stage_table


def with_ordinals(rows: DataFrame, name: str = "ordinal") -> DataFrame:
    """rows as read from files (spark.read...., not filtered or joined) with their number from 0
    in the order of paths and lines."""
    # a task reads its blocks in order, so its ids grow within a block
    read = rows.select(F.struct(*rows.columns).alias("__row"), F.col("_metadata.file_path").alias("__file"), F.col("_metadata.file_block_start").alias("__block"), F.monotonically_increasing_id().alias("__id"))
    read = stage_table(read, "ordinals")
    blocks = read.groupBy("__file", "__block").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.orderBy("__file", "__block").rowsBetween(Window.unboundedPreceding, -1))  # a row a block
    blocks = blocks.select("__file", "__block", F.coalesce(before, F.lit(0)).alias("__before"))
    inside = F.row_number().over(Window.partitionBy("__file", "__block").orderBy("__id")) - 1
    return read.withColumn("__at", inside).join(blocks, ["__file", "__block"]).select("__row.*", (F.col("__before") + F.col("__at")).alias(name))


def repaired(rows: DataFrame, column: str, place: str, source: DataFrame, value: str, only: Column | None = None) -> DataFrame:
    """rows with `column` taken from the row of source (with ordinal) that `place` counts to,
    where that has a value; else as it was. only: rows that may be repaired. Places that are
    null, negative or beyond the source repair nothing."""
    found = source.select(F.col("ordinal").alias("__place"), F.col(value).cast(rows.schema[column].dataType).alias("__value")).where("__value IS NOT NULL")
    may = F.lit(True) if only is None else F.coalesce(only, F.lit(False))
    met = rows.join(found, F.col(place) == F.col("__place"), "left")
    return met.withColumn(column, F.when(may, F.coalesce("__value", column)).otherwise(F.col(column))).select(*rows.columns)


def side_by_side(a: DataFrame, b: DataFrame) -> DataFrame:
    """The rows of two numbered tables with equal ordinals next to each other, all of both;
    columns of b that a has too are named with _right."""
    other = b.select("ordinal", *[F.col(c).alias(f"{c}_right" if c in a.columns else c) for c in b.columns if c != "ordinal"])
    return a.join(other, "ordinal", "full")
