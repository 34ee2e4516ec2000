"""Grouped aggregates: provenance-keeping merges, exact spreads, crosstabs, metrics."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from matchbook.functions.geo import safe_ratio
from matchbook.operators.quantiles import with_quantiles
from matchbook.session import stage_table


def steady_mean(c: str) -> Column:
    """Mean of doubles that no order of the rows changes: a plain sum of millions of them is off by
    what each addition rounds away. Multiples of 2**-36 are added up as two longs (an error, not a
    wrong mean, if 2**32 rows overflow them), only what is left of each value, and values beyond
    2**26, NaN and infinity, as doubles."""
    x = F.col(c).cast("double")
    units = F.when(F.abs(x) < float(1 << 26), F.floor(x * float(1 << 36))).otherwise(F.when(x.isNotNull(), F.lit(0).cast("long")))
    rest = x - units / F.lit(float(1 << 36))
    high, low = F.sum(F.shiftright(units, 31)), F.sum(units.bitwiseAND(F.lit((1 << 31) - 1)))
    whole = (high.cast("decimal(19,0)") * F.lit(1 << 31).cast("decimal(10,0)") + low.cast("decimal(19,0)")).cast("double")
    return (whole / float(1 << 36) + F.sum(rest)) / F.nullif(F.count(x), F.lit(0))


def first_value(c: str, order: Sequence[Column], blank: bool = False) -> Column:
    """The first non-null value in the order (blank: and non-blank); null if all are null."""
    given = F.col(c).isNotNull() if not blank else F.col(c).isNotNull() & (F.trim(c) != "")
    return F.min(F.when(given, F.struct(*order, F.col(c).alias("value")))).getField("value")


def joined_values(c: str, sep: str = "|") -> Column:
    """All distinct parts of delimited texts of a group, sorted, joined again."""
    parts = F.flatten(F.collect_set(F.split(F.col(c), F.concat(F.lit("\\Q"), F.lit(sep), F.lit("\\E")))))
    return F.array_join(F.array_sort(F.filter(F.array_distinct(parts), lambda p: F.trim(p) != "")), sep)


def ranked_merge(rows: DataFrame, key: str, ranked: Sequence[str], rank: Column, order: Column, first: Sequence[str], joined: Sequence[str], any_of: Sequence[str]) -> DataFrame:
    """A row a key: the columns `ranked` together from the row of the highest rank (ties:
    first in order), `first` each first non-null, `joined` as distinct parts, `any_of` true
    if true in any row, n_sources the rows. Null keys are a group of their own."""
    best = F.max(F.struct(rank.alias("r"), (-order).alias("o"), *ranked))
    out = rows.groupBy(key).agg(best.alias("best"), *[first_value(c, [order]).alias(c) for c in first], *[joined_values(c).alias(c) for c in joined], *[F.bool_or(F.coalesce(c, F.lit(False))).alias(c) for c in any_of], F.count("*").alias("n_sources"))
    return out.select(key, *[F.col(f"best.{c}").alias(c) for c in ranked], *first, *joined, *any_of, "n_sources")


def robust_scale(rows: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """by, median, mad, iqr, sd and scale: 1.4826 MAD, else IQR / 1.349, else the sample
    standard deviation, else 1: the first that is above 0."""
    spread = rows.groupBy(*by).agg(F.stddev_samp(value).alias("sd"))
    base = stage_table(with_quantiles(spread, rows, by, value, {"p25": 0.25, "median": 0.5, "p75": 0.75}), "robust-scale")
    middle = base.select(*[F.col(c).alias(f"__m{i}") for i, c in enumerate(by)], F.col("median").alias("__m"))
    same = reduce(lambda p, q: p & q, (F.col(c).eqNullSafe(F.col(f"__m{i}")) for i, c in enumerate(by)))
    away = rows.join(middle, same).select(*by, F.abs(F.col(value) - F.col("__m")).alias("__away"))
    out = with_quantiles(base, away, by, "__away", {"mad": 0.5}).select(*by, "median", "mad", (F.col("p75") - F.col("p25")).alias("iqr"), "sd")
    steps = [1.4826 * F.col("mad"), F.col("iqr") / 1.349, F.col("sd")]
    return out.withColumn("scale", F.coalesce(*[F.when(s > 1e-12, s) for s in steps], F.lit(1.0)))


def describe(rows: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """Exact count, mean, sd, minimum, quartiles and maximum."""
    out = rows.groupBy(*by).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("sd"), F.min(value).alias("min"), F.max(value).alias("max"))
    out = with_quantiles(out, rows, by, value, {"p25": 0.25, "p50": 0.5, "p75": 0.75})
    return out.select(*by, "n", "mean", "sd", "min", "p25", "p50", "p75", "max")


def crosstab(rows: DataFrame, a: str, b: str) -> DataFrame:
    """a, b, n with margins: 'All' stands for every value of that side."""
    both = rows.select(F.col(a).cast("string").alias(a), F.col(b).cast("string").alias(b))
    cubed = both.cube(a, b).agg(F.count("*").alias("n"), F.grouping(a).alias("ga"), F.grouping(b).alias("gb"))
    return cubed.select(F.when(F.col("ga") == 1, "All").otherwise(F.col(a)).alias(a), F.when(F.col("gb") == 1, "All").otherwise(F.col(b)).alias(b), "n")


def domain_counts(rows: DataFrame, c: str, domain: Sequence[str]) -> DataFrame:
    """A row for each value of a fixed domain, 0 where it does not occur."""
    values = rows.sparkSession.createDataFrame([(v,) for v in domain], f"{c} string")
    return values.join(rows.groupBy(c).agg(F.count("*").alias("n")), c, "left").select(c, F.coalesce("n", F.lit(0)).alias("n"))


def confusion(truth: str = "truth", guess: str = "guess") -> list[Column]:
    """tp, fp, tn, fn counts as aggregates."""
    cells = (("tp", 1, 1), ("fp", 0, 1), ("tn", 0, 0), ("fn", 1, 0))
    return [F.count_if((F.col(truth) == t) & (F.col(guess) == g)).alias(n) for n, t, g in cells]


def with_rates(counts: DataFrame) -> DataFrame:
    """Adds precision, recall, specificity, f1, accuracy and balanced_accuracy to tp, fp,
    tn, fn; null where a denominator is 0."""
    tp, fp, tn, fn = (F.col(c).cast("double") for c in ("tp", "fp", "tn", "fn"))
    rates = {"precision": safe_ratio(tp, tp + fp), "recall": safe_ratio(tp, tp + fn), "specificity": safe_ratio(tn, tn + fp), "f1": safe_ratio(2 * tp, 2 * tp + fp + fn), "accuracy": safe_ratio(tp + tn, tp + fp + tn + fn)}
    return counts.withColumns(rates).withColumn("balanced_accuracy", (F.col("recall") + F.col("specificity")) / 2)


def circular_mean(degrees: Column) -> tuple[Column, Column]:
    """(mean direction 0 to 360, resultant length 0 to 1) as aggregates."""
    s, c = F.avg(F.sin(F.radians(degrees))), F.avg(F.cos(F.radians(degrees)))
    return F.pmod(F.degrees(F.atan2(s, c)), F.lit(360.0)), F.sqrt(s * s + c * c)


def consensus(rows: DataFrame, by: Sequence[str]) -> DataFrame:
    """Of intervals (i_start, i_end) that should be one: what all share and what any covers,
    the spreads of both ends, and whether they overlap by more than a touch."""
    out = rows.groupBy(*by).agg(F.count("*").alias("n"), F.max("i_start").alias("shared_start"), F.min("i_end").alias("shared_end"), F.min("i_start").alias("union_start"), F.max("i_end").alias("union_end"))
    return out.withColumn("start_spread", F.col("shared_start") - F.col("union_start")).withColumn("end_spread", F.col("union_end") - F.col("shared_end")).withColumn("overlaps", F.col("shared_end") > F.col("shared_start"))


def combine_first(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """All keys of two tables with unique keys; each column from a where it is there and not
    null, else from b. Columns are those of a, then what b alone has. Null keys don't meet."""
    columns = [*a.columns, *[c for c in b.columns if c not in a.columns]]
    x, y = a.select(F.struct("*").alias("x"), F.col(key).alias("k")), b.select(F.struct("*").alias("y"), F.col(key).alias("k"))

    def pick(c: str) -> Column:
        sides = [F.col(f"{s}.{c}") for s, t in (("x", a), ("y", b)) if c in t.columns]
        return F.coalesce(*sides).alias(c)

    return x.join(y, "k", "full").select(*map(pick, columns))


def seeded_sample(rows: DataFrame, by: Sequence[str], id_col: str, n: int | Column, seed: int = 0) -> DataFrame:
    """At most n rows of each group (n may be a column over the groups), drawn by the md5 of seed
    and id: reruns, other partitionings and SQL engines draw the same. Null ids come first."""
    draw = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))))
    place = F.row_number().over(Window.partitionBy(*by).orderBy("draw", id_col))
    return rows.withColumn("draw", draw).withColumn("place", place).where(F.col("place") <= n).drop("draw", "place")


def label_conflicts(rows: DataFrame, by: Sequence[str], label: str) -> DataFrame:
    """Groups that hold both labels, with how many of each: a gate, empty when all is well."""
    return rows.groupBy(*by).agg(F.count_if(F.col(label) == 1).alias("n_positive"), F.count_if(F.col(label) == 0).alias("n_negative")).where("n_positive > 0 AND n_negative > 0")


def demeaned(rows: DataFrame, by: Sequence[str], value: str, name: str) -> DataFrame:
    """rows with `name`: the value less the mean of its group (null keys are a group). Means are
    combined before the shuffle and joined, so no group has to lie in one task."""
    means = rows.groupBy(*[F.col(c).alias(f"_{c}") for c in by]).agg(F.avg(value).alias("_mean"))
    same = reduce(lambda p, q: p & q, (F.col(c).eqNullSafe(F.col(f"_{c}")) for c in by))
    return rows.join(means, same).select(*rows.columns, (F.col(value) - F.col("_mean")).alias(name))
