"""Bringing tables of any shape onto one schema."""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from matchbook.functions import text


def tidy_names(names: Sequence[str]) -> list[str]:
    """Lower case, runs of other signs as one underscore, repeats numbered _2, _3, ..."""
    out: list[str] = []
    for n in names:
        base = re.sub("[^a-z0-9]+", "_", n.lower()).strip("_") or "column"
        name, k = base, 2
        while name in out:
            name, k = f"{base}_{k}", k + 1
        out.append(name)
    return out


def tidy(df: DataFrame) -> DataFrame:
    return df.toDF(*tidy_names(df.columns))


def first_column(columns: Sequence[str], aliases: Sequence[str]) -> str | None:
    """The first alias that is a column, whatever its case and signs."""
    known = dict(zip(reversed(tidy_names(columns)), reversed(columns), strict=True))
    return next((known[a] for a in tidy_names(aliases) if a in known), None)


def find_column(columns: Sequence[str], include: Sequence[str], exclude: Sequence[str] = ()) -> str | None:
    """The first column whose name holds all words of include and none of exclude."""
    return next((c for c in columns if all(w in c.lower() for w in include) and not any(w in c.lower() for w in exclude)), None)


def best_time_column(df: DataFrame, words: Sequence[str] = ("utc", "datetime", "timestamp", "time", "date")) -> Column | None:
    """A timestamp from the first column, by word then position, of which a value parses;
    else from a date and a time column put together."""
    ordered = [c for w in words for c in df.columns if w in c.lower()]
    ordered = list(dict.fromkeys(ordered))
    for c in ordered:
        if not df.where(text.moment(F.col(c)).isNotNull()).isEmpty():
            return text.moment(F.col(c))
    day, hour = find_column(df.columns, ["date"]), find_column(df.columns, ["time"], ["date"])
    return text.moment(F.concat_ws(" ", day, hour)) if day and hour else None


@dataclass(frozen=True)
class SourceSpec:
    """Where a source's values come from: aliases and defaults by target column, and a role."""

    name: str
    aliases: dict[str, Sequence[str]] = field(default_factory=dict)
    defaults: dict[str, object] = field(default_factory=dict)


_CASTS = {"double": text.number, "timestamp": text.moment, "string": text.clean_text, "int": lambda c: text.number(c).cast("int"), "boolean": lambda c: text.flag(c, false_words=text.FALSE_WORDS)}


def canonical(df: DataFrame, target: T.StructType, spec: SourceSpec) -> DataFrame:
    """df on the target's columns and order: the first alias present, cast tolerantly, a
    missing or null value by the spec's default, else null; source names the spec."""
    out = []
    for f in target:
        kind = f.dataType.simpleString()
        found = first_column(df.columns, [f.name, *spec.aliases.get(f.name, ())])
        same = found and df.schema[found].dataType == f.dataType and kind != "string"
        value = F.lit(None).cast(f.dataType) if not found else F.col(found) if same else _CASTS[kind](F.col(found))
        if f.name in spec.defaults:
            value = F.coalesce(value, F.lit(spec.defaults[f.name]).cast(f.dataType))
        out.append(value.alias(f.name))
    return df.select(*out, F.lit(spec.name).alias("source"))


def union_all(frames: Sequence[DataFrame]) -> DataFrame:
    """Union by name, columns that a table lacks as null."""
    whole = frames[0]
    for f in frames[1:]:
        whole = whole.unionByName(f, allowMissingColumns=True)
    return whole


def flatten_structs(df: DataFrame) -> DataFrame:
    """Nested structs as columns a.b.c named a_b_c."""

    def leaves(schema: T.StructType, path: tuple[str, ...]) -> list[Column]:
        out = []
        for f in schema:
            at = (*path, f.name)
            if isinstance(f.dataType, T.StructType):
                out += leaves(f.dataType, at)
            else:
                out.append(F.col(".".join(f"`{p}`" for p in at)).alias("_".join(at)))
        return out

    return df.select(*leaves(df.schema, ()))


def ordinal_ids(df: DataFrame, prefix: str, order: Sequence[Column], digits: int = 6) -> DataFrame:
    """df with id: the prefix and the row's place in the order, padded. Places come from a
    range sort and the row counts of the partitions before, not from a single task."""
    from matchbook.session import stage_table

    placed = df.sort(*order).withColumn("part", F.spark_partition_id()).withColumn("at", F.monotonically_increasing_id())
    placed = stage_table(placed, "ordinal")
    sizes = placed.groupBy("part").agg(F.count("*").alias("n"))
    from pyspark.sql import Window

    base = sizes.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("base"))  # a row a partition
    place = F.col("base") + F.col("at").bitwiseAND((1 << 33) - 1) + 1
    return placed.join(F.broadcast(base), "part").withColumn("id", F.concat(F.lit(prefix), F.lpad(place.cast("string"), digits, "0"))).drop("part", "at", "base")
