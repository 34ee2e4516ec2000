"""Work that goes on where it stopped: last state, what is pending, what is complete."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def latest(log: DataFrame, key: str, sequence: str) -> DataFrame:
    """The last record of each key; ties by all its values."""
    rest = [c for c in log.columns if c not in (key, sequence)]
    last = log.groupBy(key).agg(F.max(F.struct(sequence, *rest)).alias("r"))
    return last.select(key, *[F.col(f"r.{c}").alias(c) for c in (sequence, *rest)]).select(*log.columns)


def pending(work: DataFrame, log: DataFrame, key: str, done: Column, version: str | None = None, current: object = None) -> DataFrame:
    """Work whose key is not done in the log, or done by another version."""
    finished = log.where(done if version is None else done & (F.col(version) == F.lit(current)))
    return work.join(finished.select(key).distinct(), key, "left_anti")


def complete_groups(expected: DataFrame, log: DataFrame, group: str, key: str, done: Column) -> DataFrame:
    """group, n, complete: whether exactly the expected keys are present and all are done."""
    want = expected.select(group, key, F.lit(True).alias("wanted"), F.lit(None).cast("boolean").alias("ok"))
    have = log.select(group, key, F.lit(None).cast("boolean").alias("wanted"), done.alias("ok"))
    # rows are dealt first: keys are nearly unique, so tables of them before the shuffle save nothing
    both = want.union(have).repartition(group, key).groupBy(group, key).agg(F.bool_or("wanted").alias("wanted"), F.bool_or("ok").alias("ok"))
    # null keys are not the same
    good = F.col("wanted").isNotNull() & F.coalesce("ok", F.lit(False)) & F.col(group).isNotNull() & F.col(key).isNotNull()
    return both.groupBy(group).agg(F.count("wanted").alias("n"), F.bool_and(good).alias("complete"))


def with_error(value: Column, wanted: str, otherwise: str) -> Column:
    """struct(value, error): keeps a row whose value could not be had, with the reason."""
    return F.struct(value.alias(wanted), F.when(value.isNull(), otherwise).alias("error"))
