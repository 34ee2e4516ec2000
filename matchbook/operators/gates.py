"""Checks that give their violations as rows; `require` turns rows into an error."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def require(violations: DataFrame, what: str) -> None:
    """Raises ValueError with up to five violations if there is one."""
    if found := violations.limit(5).collect():
        raise ValueError(f"{what}: {[r.asDict() for r in found]}")


def require_columns(rows: DataFrame, names: Sequence[str]) -> None:
    if lacking := [n for n in names if n not in rows.columns]:
        raise ValueError(f"columns are missing: {lacking}")


def repeated_keys(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys that occur more than once, and how often."""
    return rows.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def wrong_counts(rows: DataFrame, by: Sequence[str], role: str, expected: dict[str, int]) -> DataFrame:
    """Groups whose number of rows of a role is not the expected one."""
    n = [F.count_if(F.col(role) == r).alias(f"n_{r}") for r in expected]
    bad = " OR ".join(f"n_{r} <> {k}" for r, k in expected.items())
    return rows.groupBy(*by).agg(*n).where(bad)


def leaks(rows: DataFrame, group: str, split: str) -> DataFrame:
    """Groups with rows in more than one split."""
    return rows.where(F.col(group).isNotNull()).groupBy(group).agg(F.countDistinct(split).alias("n_splits")).where("n_splits > 1")


def one_class_splits(rows: DataFrame, split: str, label: str) -> DataFrame:
    """Splits that lack a class."""
    return rows.groupBy(split).agg(F.count_if(F.col(label) == 1).alias("n1"), F.count_if(F.col(label) == 0).alias("n0")).where("n1 = 0 OR n0 = 0")


def shared(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Key values that both tables have and that should be disjoint."""
    return a.select(key).where(F.col(key).isNotNull()).intersect(b.select(key))


def orphans(children: DataFrame, parents: DataFrame, key: str) -> DataFrame:
    """Children whose parent is absent; a null key is an orphan."""
    return children.join(parents.select(key).distinct(), key, "left_anti")


def equal_slots(rows: DataFrame, slots: Sequence[str]) -> DataFrame:
    """Rows in which two of the slots hold the same value."""
    pairs = [(a, b) for k, a in enumerate(slots) for b in slots[k + 1 :]]
    bad = F.lit(False)
    for a, b in pairs:
        bad = bad | F.coalesce(F.col(a) == F.col(b), F.lit(False))
    return rows.where(bad)
