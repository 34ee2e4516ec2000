"""Statistics of paired and grouped benchmarks, as aggregates and closed forms."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from matchbook.operators.prefix import ranged, running_sums
from matchbook.operators.quantiles import quantiles, with_quantiles
from matchbook.session import stage_table

#: Rows of a part of a bootstrap, which a task holds.
_PART_ROWS = 100_000


def auroc(rows: DataFrame, score: str, truth: str, by: Sequence[str] = ()) -> DataFrame:
    """by, n1, n0, u, auc: the chance that a positive scores above a negative, ties half.

    Rows are counted per score first, so the running count that ranks need works on
    distinct scores; null scores or labels take no part; null with one class alone."""
    counts = rows.where(F.col(score).isNotNull() & F.col(truth).isin(0, 1)).groupBy(*by, score).agg(F.count_if(F.col(truth) == 1).alias("p"), F.count_if(F.col(truth) == 0).alias("m"))
    placed = running_sums(counts, by, score, ["m"])
    sums = placed.withColumn("u", F.col("p") * (F.col("before_m") + F.col("m") / 2)).groupBy(*by).agg(F.sum("p").alias("n1"), F.sum("m").alias("n0"), F.sum("u").alias("u"))
    return sums.withColumn("auc", F.when((F.col("n1") > 0) & (F.col("n0") > 0), F.col("u") / (F.col("n1") * F.col("n0"))))


def cliffs_delta(auc: Column) -> tuple[Column, Column]:
    """(delta, its usual name) from the area under the curve."""
    d = 2 * auc - 1
    size = F.abs(d)
    return d, F.when(d.isNull(), None).when(size < 0.147, "negligible").when(size < 0.33, "small").when(size < 0.474, "medium").otherwise("large")


def wilson(k: Column, n: Column, z: float = 1.96) -> tuple[Column, Column]:
    """Bounds of a share k / n; null for n = 0."""
    p, m = k / F.nullif(n, F.lit(0)), F.nullif(n, F.lit(0)).cast("double")
    mid, half, scale = p + z * z / (2 * m), z * F.sqrt(p * (1 - p) / m + z * z / (4 * m * m)), 1 + z * z / m
    return (mid - half) / scale, (mid + half) / scale


def sign_test(wins: str, losses: str) -> Column:
    """Exact two-sided p of wins against losses (ties dropped before), at most 1; 1 without any."""
    n, k = f"({wins} + {losses})", f"least({wins}, {losses})"
    # ln C(n, i) as a running sum over i
    tail = f"aggregate(sequence(0L, {k}), named_struct('c', 0D, 's', 0D), (a, i) -> named_struct('c', a.c + ln(greatest({n} - i, 1L)) - ln(i + 1), 's', a.s + exp(a.c - {n} * ln(2D))), a -> a.s)"
    return F.expr(f"CASE WHEN {n} = 0 THEN 1D ELSE least(1D, 2 * {tail}) END")


def paired(rows: DataFrame, pair: str, role: str, value: str, positive: str, control: str) -> DataFrame:
    """A row a pair with the value of its positive and its control; pairs lacking one drop out."""
    sides = rows.groupBy(pair).agg(F.max(F.when(F.col(role) == positive, F.col(value))).alias("pos"), F.max(F.when(F.col(role) == control, F.col(value))).alias("neg"))
    return sides.where("pos IS NOT NULL AND neg IS NOT NULL").withColumn("diff", F.col("pos") - F.col("neg"))


def paired_summary(pairs: DataFrame) -> DataFrame:
    """n, wins, losses, ties, win and tie fraction, mean and median difference, sign-test p."""
    s = pairs.agg(F.count("*").alias("n"), F.count_if(F.col("diff") > 0).alias("wins"), F.count_if(F.col("diff") < 0).alias("losses"), F.count_if(F.col("diff") == 0).alias("ties"), F.avg("diff").alias("mean_diff"))
    s = with_quantiles(s, pairs, [], "diff", {"median_diff": 0.5})
    return s.withColumn("win_fraction", F.col("wins") / F.nullif(F.col("n"), F.lit(0))).withColumn("tie_fraction", F.col("ties") / F.nullif(F.col("n"), F.lit(0))).withColumn("p_sign", sign_test("wins", "losses"))


def _taken(hashes: np.ndarray, reps: np.ndarray, seed: int) -> np.ndarray:
    """How often rows (their hashes) are taken in replicates: Poisson counts of mean 1, a row
    of the result a replicate."""
    with np.errstate(over="ignore"):
        x = hashes.astype(np.uint64)[None, :] + (reps.astype(np.uint64)[:, None] + np.uint64(seed << 32)) * np.uint64(0x9E3779B97F4A7C15)
        for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
        x ^= x >> np.uint64(31)
    total, limits, term = 0.0, [], np.exp(-1.0)
    for k in range(20):  # a float's 53 bits hold no rarer count
        total += term
        limits.append(total)
        term /= k + 1
    return np.searchsorted(np.array(limits), (x >> np.uint64(11)) / float(1 << 53), side="right")


def bootstrap(rows: DataFrame, id_col: str, value: str, replicates: int, seed: int = 1, strata: Sequence[str] = ()) -> DataFrame:
    """strata, mean, mean_lo, mean_hi, median_lo, median_hi: percentile intervals of 95 %.

    Every row draws, in every replicate, how often it is taken (a Poisson count of mean 1)
    from its id, the replicate and the seed alone, so that no row has to meet another and
    reruns agree. Whole pairs are drawn if rows are pairs; strata are drawn apart.

    Rows are cut into parts by stratum and value. A part gives the replicates' weights and
    sums; running weights over the parts say which part holds a replicate's middle, and that
    part finds it. Parts hold about _PART_ROWS rows, however often a value occurs."""
    kinds = dict(rows.dtypes)
    own = rows.where(F.col(value).isNotNull()).select(*strata, F.col(value).cast("double").alias("__v"), F.xxhash64(id_col).alias("__h"))
    own = stage_table(own, "bootstrap")
    parts = ranged(own, [*strata, "__v", "__h"], "bootstrap-parts", own.count() // _PART_ROWS + 1)
    keys, named = [*strata, "__part"], "".join(f"{c} {kinds[c]}, " for c in strata) + "__part int, "
    step = 64

    def add_up(pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        for a in range(0, replicates, step):
            reps = np.arange(a, min(a + step, replicates))
            times = np.zeros((len(reps), 2))
            for b in range(0, len(pdf), 1 << 14):
                t = _taken(pdf["__h"].to_numpy()[b : b + (1 << 14)], reps, seed)
                times += np.stack([t.sum(1), t @ pdf["__v"].to_numpy()[b : b + (1 << 14)]], 1)
            out.append(pd.DataFrame({"__rep": reps, "__w": times[:, 0].astype(np.int64), "__s": times[:, 1]}))
        return pd.concat(out).assign(**{k: pdf[k].iloc[0] for k in keys})

    def find(pdf: pd.DataFrame, wanted: pd.DataFrame) -> pd.DataFrame:
        if not len(pdf) or not len(wanted):
            return pd.DataFrame(columns=[*strata, "__rep", "__v"])
        pdf = pdf.sort_values(["__v", "__h"])
        out = []
        for rep, ranks in wanted.groupby("__rep")["__rank"]:
            upto = np.cumsum(_taken(pdf["__h"].to_numpy(), np.array([rep]), seed)[0])
            out.append(pd.DataFrame({"__rep": rep, "__v": pdf["__v"].to_numpy()[np.searchsorted(upto, ranks.to_numpy(), side="right")]}))
        return pd.concat(out).assign(**{k: pdf[k].iloc[0] for k in strata})

    sums = stage_table(parts.groupBy(*keys).applyInPandas(add_up, named + "__rep int, __w long, __s double"), "bootstrap-sums")
    means = sums.groupBy(*strata, "__rep").agg((F.sum("__s") / F.nullif(F.sum("__w"), F.lit(0))).alias("mean"))
    group = Window.partitionBy(*strata, "__rep")
    placed = sums.withColumn("__n", F.sum("__w").over(group)).withColumn("__before", F.sum("__w").over(group.orderBy("__part")) - F.col("__w"))
    both = placed.withColumn("__rank", F.explode(F.expr("array((__n - 1) div 2, __n div 2)"))).where("__n > 0 AND __rank >= __before AND __rank < __before + __w")
    wanted = both.select(*keys, "__rep", (F.col("__rank") - F.col("__before")).alias("__rank"))
    columns = "".join(f"{c} {kinds[c]}, " for c in strata) + "__rep int, __v double"
    middles = parts.groupBy(*keys).cogroup(wanted.groupBy(*keys)).applyInPandas(find, columns)
    medians = middles.groupBy(*strata, "__rep").agg(F.avg("__v").alias("median"))

    def bounds(m: str) -> list[Column]:
        return [F.expr(f"percentile({m}, {p})").alias(f"{m}_{n}") for n, p in (("lo", 0.025), ("hi", 0.975))]

    a = means.groupBy(*strata).agg(F.count("mean").alias("n_replicates"), *bounds("mean")).alias("a")
    b = medians.groupBy(*strata).agg(*bounds("median")).alias("b")
    same = F.lit(True)
    for c in strata:
        same = same & F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}"))
    # a row a stratum on both sides
    return a.join(F.broadcast(b), same).select(*[f"a.{c}" for c in strata], "n_replicates", "mean_lo", "mean_hi", "median_lo", "median_hi")


def bootstrap_auc(rows: DataFrame, id_col: str, score: str, truth: str, replicates: int, seed: int = 1) -> DataFrame:
    """n_replicates, auc, auc_lo, auc_hi: the area under the curve and a percentile interval of
    95 %. Rows of one id are drawn together, as often as that id draws, so pairs or sites stay
    whole. Null scores and labels other than 0 and 1 take no part; replicates that lack a
    class don't count; without both classes all but n_replicates is null.

    Rows are cut into parts by score. A part gives, a replicate, the weights of both classes
    and the wins among its inner scores; its first and last score may go on in other parts and
    are given apart, to be added up. What lies below a part is a running sum over the parts."""
    own = rows.where(F.col(score).isNotNull() & F.col(truth).isin(0, 1)).select(F.col(score).cast("double").alias("__s"), (F.col(truth) == 1).alias("__y"), F.xxhash64(id_col).alias("__h"))
    own = stage_table(own, "bootstrap-auc")
    parts = ranged(own, ["__s", "__h"], "bootstrap-auc-parts", own.count() // _PART_ROWS + 1)
    step = 16

    def add_up(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("__s")
        line, y, hashes = pdf["__s"].to_numpy(), pdf["__y"].to_numpy(), pdf["__h"].to_numpy()
        starts = np.flatnonzero(np.concatenate([[True], line[1:] != line[:-1]]))
        n, out = len(starts), []
        for a in range(0, replicates, step):
            reps = np.arange(a, min(a + step, replicates))
            times = _taken(hashes, reps, seed)
            pos, neg = (np.add.reduceat(times * side, starts, axis=1) for side in (y, ~y))
            # first score, those between, last score
            for lo, hi in sorted({(0, 1), (1, n - 1), (n - 1, n)}):
                if lo >= hi:
                    continue
                p, m = pos[:, lo:hi].astype(float), neg[:, lo:hi].astype(float)
                wins = (p * (np.cumsum(m, 1) - m / 2)).sum(1) if hi - lo > 1 else np.zeros(len(reps))
                out.append(pd.DataFrame({"__rep": reps, "__lo": line[starts[lo]], "__hi": line[starts[hi - 1]], "__p": p.sum(1), "__m": m.sum(1), "__u": wins}))
        return pd.concat(out)

    sums = parts.groupBy("__part").applyInPandas(add_up, "__rep int, __lo double, __hi double, __p double, __m double, __u double")
    sums = stage_table(sums.groupBy("__rep", "__lo", "__hi").agg(F.sum("__p").alias("p"), F.sum("__m").alias("m"), F.sum("__u").alias("u")), "bootstrap-auc-sums")
    below = F.coalesce(F.sum("m").over(Window.partitionBy("__rep").orderBy("__lo").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    wins = F.when(F.col("__lo") == F.col("__hi"), F.col("p") * F.col("m") / 2).otherwise(F.col("u")) + F.col("p") * F.col("below")
    each = sums.withColumn("below", below).groupBy("__rep").agg((F.sum(wins) / F.nullif(F.sum("p") * F.sum("m"), F.lit(0.0))).alias("auc"))
    # as many rows as replicates
    ends = each.agg(F.count("auc").alias("n_replicates"), F.expr("percentile(auc, 0.025)").alias("auc_lo"), F.expr("percentile(auc, 0.975)").alias("auc_hi"))
    point = auroc(own.withColumn("__y", F.col("__y").cast("int")), "__s", "__y").select("auc")
    return ends.join(F.broadcast(point), F.lit(True), "left").select("n_replicates", "auc", "auc_lo", "auc_hi")


def normal_tails(z: Column) -> Column:
    """The chance that a standard normal value lies at least as far from 0, to about 1e-12."""
    x = F.abs(z)
    # ascending series of the distribution function; beyond 6 the continued fraction
    series = F.aggregate(F.sequence(F.lit(1), F.lit(120)), F.struct(x.alias("t"), x.alias("s")), lambda a, k: F.struct((a["t"] * x * x / (2 * k + 1)).alias("t"), (a["s"] + a["t"] * x * x / (2 * k + 1)).alias("s")), lambda a: a["s"])
    density = F.exp(-x * x / 2) / 2.5066282746310002
    fraction = F.aggregate(F.sequence(F.lit(40), F.lit(1), F.lit(-1)), x.cast("double"), lambda a, k: x + k / a)
    return F.when(x < 6, F.greatest(F.lit(0.0), 1 - 2 * density * series)).otherwise(2 * density / fraction)


#: Up to so many values the null distribution of ranks is counted out; beyond, the normal tail.
EXACT = 25


def _two_sided(counts: Column, at: Column) -> Column:
    """2 * the smaller tail of a distribution given as counts, at a place and beyond it."""
    total = F.aggregate(counts, F.lit(0.0), lambda a, c: a + c)
    low = F.aggregate(F.slice(counts, F.lit(1), (at + 1).cast("int")), F.lit(0.0), lambda a, c: a + c)
    high = F.aggregate(F.slice(counts, (at + 1).cast("int"), F.size(counts)), F.lit(0.0), lambda a, c: a + c)
    return F.least(F.lit(1.0), 2 * F.least(low, high) / total)


def signed_rank_test(rows: DataFrame, diff: str, by: Sequence[str] = ()) -> DataFrame:
    """Wilcoxon's signed-rank test of paired differences: by, n (zeros and nulls left out),
    w_plus with tied sizes sharing their mean rank, z, corrected for ties (null for n = 0), and
    the two-sided p: for n up to EXACT from all ways to choose signs, given the ties, beyond
    that from the normal tail of z, without a correction for continuity; 1 for n = 0."""
    sizes = rows.where(F.col(diff).isNotNull() & (F.col(diff) != 0)).groupBy(*by, F.abs(diff).alias("size")).agg(F.count("*").alias("k"), F.count_if(F.col(diff) > 0).alias("p"))
    placed = stage_table(running_sums(sizes, by, "size", ["k"]), "signed-ranks")
    t = placed.groupBy(*by).agg(F.coalesce(F.sum("k"), F.lit(0)).alias("n"), F.sum(F.col("p") * (F.col("before_k") + (F.col("k") + 1) / 2)).alias("w_plus"), F.sum(F.col("k").cast("double") * F.col("k") * F.col("k") - F.col("k")).alias("ties"))
    n = F.col("n").cast("double")
    spread = F.sqrt(n * (n + 1) * (2 * n + 1) / 24 - F.col("ties") / 48)
    t = t.withColumn("z", (F.col("w_plus") - n * (n + 1) / 4) / F.nullif(spread, F.lit(0.0)))
    t = _with_ranks(t, placed, by)

    def add(counts: Column, r: Column) -> Column:
        return F.transform(counts, lambda c, i: c + F.when(i >= r, F.get(counts, i - r)).otherwise(0.0))

    start = F.transform(F.sequence(F.lit(0), (n * (n + 1)).cast("int")), lambda i: (i == 0).cast("double"))
    exact = _two_sided(F.aggregate("ranks", start, add), F.round(2 * F.col("w_plus")))
    p = F.when(F.col("n") == 0, 1.0).when(F.col("ranks").isNotNull(), exact).otherwise(normal_tails(F.col("z")))
    return t.select(*by, "n", "w_plus", "z", p.alias("p"))


def signed_rank(rows: DataFrame, diff: str, by: Sequence[str] = ()) -> DataFrame:
    """The statistic of signed_rank_test without its p: by, n, w_plus, z."""
    return signed_rank_test(rows, diff, by).drop("p")


def rank_sum(rows: DataFrame, value: str, truth: str, by: Sequence[str] = ()) -> DataFrame:
    """Mann-Whitney's test of positives (truth 1) against others (0): by, n1, n0, u, z, corrected
    for ties, and the two-sided p: for n1 + n0 up to EXACT from all ways to choose the
    positives, given the ties, beyond that from the normal tail, without a correction for
    continuity; nulls take no part; null z and p of 1 where a class is missing."""
    sizes = rows.where(F.col(value).isNotNull() & F.col(truth).isin(0, 1)).groupBy(*by, F.col(value).cast("double").alias("size")).agg(F.count("*").alias("k"), F.count_if(F.col(truth) == 1).alias("p"))
    placed = stage_table(running_sums(sizes, by, "size", ["k"]), "rank-sums")
    t = placed.groupBy(*by).agg(F.coalesce(F.sum("k"), F.lit(0)).alias("n"), F.coalesce(F.sum("p"), F.lit(0)).alias("n1"), F.sum(F.col("p") * (F.col("before_k") + (F.col("k") + 1) / 2)).alias("w"), F.sum(F.col("k").cast("double") * F.col("k") * F.col("k") - F.col("k")).alias("ties"))
    n, n1 = F.col("n").cast("double"), F.col("n1").cast("double")
    n0 = n - n1
    u = F.col("w") - n1 * (n1 + 1) / 2
    spread = F.sqrt(n1 * n0 / 12 * (n + 1 - F.col("ties") / (n * F.nullif(n - 1, F.lit(0.0)))))
    t = _with_ranks(t.withColumns({"u": u, "z": (u - n1 * n0 / 2) / F.nullif(spread, F.lit(0.0))}), placed, by)

    # counts by (chosen, sum of ranks), chosen * wide + sum
    wide = (n * (n + 1)).cast("int") + 1

    def add(counts: Column, r: Column) -> Column:
        return F.transform(counts, lambda c, i: c + F.when((i >= wide + r) & (i % wide >= r), F.get(counts, i - wide - r)).otherwise(0.0))

    start = F.transform(F.sequence(F.lit(0), (wide * (F.col("n1").cast("int") + 1) - 1).cast("int")), lambda i: (i == 0).cast("double"))
    chosen = F.slice(F.aggregate("ranks", start, add), (F.col("n1").cast("int") * wide + 1).cast("int"), wide)
    p = F.when((n1 == 0) | (n0 == 0), 1.0).when(F.col("ranks").isNotNull(), _two_sided(chosen, F.round(2 * F.col("w")))).otherwise(F.coalesce(normal_tails(F.col("z")), F.lit(1.0)))
    return t.select(*by, "n1", (F.col("n") - F.col("n1")).alias("n0"), "u", "z", p.alias("p"))


def _with_ranks(t: DataFrame, placed: DataFrame, by: Sequence[str]) -> DataFrame:
    """t with ranks: twice the mean ranks of all values of a group of at most EXACT, else null."""
    keys = [f"__b{i}" for i in range(len(by))]
    few = t.where(F.col("n").between(1, EXACT)).select(*[F.col(c).alias(k) for c, k in zip(by, keys, strict=True)], F.lit(True).alias("__few"))
    same = F.lit(True)
    for c, k in zip(by, keys, strict=True):
        same = same & F.col(c).eqNullSafe(F.col(k))
    own = F.array_repeat((2 * F.col("before_k") + F.col("k") + 1).cast("int"), F.col("k").cast("int"))
    # groups of EXACT values at most
    ranks = placed.join(few, same).groupBy(*keys).agg(F.flatten(F.collect_list(own)).alias("ranks"))
    return t.join(ranks, same, "left").drop(*keys)


def absorbed_r2(rows: DataFrame, group: str, y: str, xs: Sequence[str]) -> DataFrame:
    """n, n_groups, r2, r2_within and coefficients of least squares of y on xs and a level for
    each group. Rows with a null or NaN among y and xs are left out; null groups are a group.

    The levels are absorbed: y and xs less their groups' means have the same coefficients
    (Frisch and Waugh), so however many groups there are, one matrix of sums of products is
    left to solve. Directions that the rows don't tell apart get the smallest coefficients."""
    names = [y, *xs]
    clean = {f"__x{i}": F.nanvl(F.col(c).cast("double"), F.lit(None)) for i, c in enumerate(names)}
    cols = list(clean)
    own = rows.select(F.col(group).alias("__g"), *[v.alias(k) for k, v in clean.items()]).dropna(subset=cols)
    own = stage_table(own, "absorbed")
    # less the overall means first, which loses fewer digits
    overall = own.agg(*[F.avg(c).alias(f"a_{c}") for c in cols])
    own = own.join(F.broadcast(overall)).select("__g", *[(F.col(c) - F.col(f"a_{c}")).alias(c) for c in cols])
    pairs = [(i, j) for i in range(len(cols)) for j in range(i, len(cols))]
    sums = own.groupBy("__g").agg(F.count("*").alias("n"), *[F.sum(c).alias(f"s_{c}") for c in cols], *[F.sum(F.col(cols[i]) * F.col(cols[j])).alias(f"p_{i}_{j}") for i, j in pairs])
    inside = [F.sum(F.col(f"p_{i}_{j}") - F.col(f"s_{cols[i]}") * F.col(f"s_{cols[j]}") / F.col("n")) for i, j in pairs]
    gram = sums.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count("*").alias("n_groups"), F.sum("p_0_0").alias("total"), F.array(*inside).alias("gram"))
    k = len(xs)

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:  # one row
            for r in pdf.itertuples():
                g = np.zeros((k + 1, k + 1))
                if r.n:
                    for (i, j), v in zip(pairs, r.gram, strict=True):
                        g[i, j] = g[j, i] = v
                scale = np.sqrt(np.maximum(np.diag(g)[1:], 1e-300))
                b = np.linalg.lstsq(g[1:, 1:] / scale / scale[:, None], g[1:, 0] / scale, rcond=1e-10)[0] / scale
                explained = float(b @ g[1:, 0])
                rest = g[0, 0] - explained
                yield pd.DataFrame({"n": [r.n], "n_groups": [r.n_groups], "r2": [1 - rest / r.total if r.n and r.total > 0 else None], "r2_within": [explained / g[0, 0] if g[0, 0] > 0 else None], "coefficients": [b.tolist()]})

    return gram.mapInPandas(solve, "n long, n_groups long, r2 double, r2_within double, coefficients array<double>")



def between_group_r2(rows: DataFrame, group: str, value: str) -> DataFrame:
    """n, n_groups, r2: share of the variance that group means explain; null for n below 3
    or without variance."""
    parts = rows.where(F.col(value).isNotNull()).groupBy(group).agg(F.count("*").alias("k"), F.sum(value).alias("s"), F.sum(F.col(value) * F.col(value)).alias("ss"))
    t = parts.agg(F.sum("k").alias("n"), F.count("*").alias("n_groups"), F.sum("s").alias("s"), F.sum("ss").alias("ss"), F.sum(F.col("s") * F.col("s") / F.col("k")).alias("b"))
    total = F.col("ss") - F.col("s") * F.col("s") / F.col("n")
    return t.select("n", "n_groups", F.when((F.col("n") >= 3) & (total > 0), (F.col("b") - F.col("s") * F.col("s") / F.col("n")) / total).alias("r2"))


def shift(train: DataFrame, test: DataFrame, value: str) -> DataFrame:
    """How far a feature moved: |difference of medians| / train IQR, and the share of test
    values outside the train's 1st to 99th percentile."""
    a = stage_table(quantiles(train, [], value, [0.01, 0.25, 0.5, 0.75, 0.99]), "shift")
    # one row
    b = test.join(F.broadcast(a), F.lit(True), "left").agg(F.avg((~F.col(value).between(F.col("q")[0], F.col("q")[4])).cast("double")).alias("outside"), F.first("q").alias("q"))
    b = with_quantiles(b, test, [], value, {"m": 0.5})
    return b.select((F.abs(F.col("m") - F.col("q")[2]) / F.nullif(F.col("q")[3] - F.col("q")[1], F.lit(0.0))).alias("median_shift"), "outside")
