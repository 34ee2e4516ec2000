"""Queries of ordered analytics, statistics, assignment, splits and models."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from matchbook.operators import aggregates, assignment, gates, joins, prefix, quantiles, statistics, windows
from matchbook.plans.registry import query, r6
from matchbook.session import load


def _orders(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority", "o_totalprice", "o_orderdate")


def _labelled(spark: SparkSession, d: str) -> DataFrame:
    docs = load(spark, d, "documents").select("doc_id", "lang", "source", "n_chars")
    return docs.join(load(spark, d, "labels"), "doc_id")


@query("""
WITH o AS (SELECT o_orderkey, o_custkey, o_totalprice AS v FROM orders),
p AS (SELECT a.o_orderkey, a.v, median(b.v) AS m FROM o a LEFT JOIN o b ON a.o_custkey = b.o_custkey AND a.o_orderkey <> b.o_orderkey GROUP BY ALL),
s AS (SELECT p.o_orderkey, median(abs(b.v - m)) * 1.4826 AS sc FROM p JOIN o a ON a.o_orderkey = p.o_orderkey LEFT JOIN o b ON a.o_custkey = b.o_custkey AND a.o_orderkey <> b.o_orderkey GROUP BY ALL)
SELECT p.o_orderkey, round(m, 6) AS peer_median, round(v - m, 6) AS delta, round((v - m) / nullif(sc, 0), 6) AS z FROM p JOIN s ON p.o_orderkey = s.o_orderkey""")
def loo_robust_z(spark: SparkSession, d: str) -> DataFrame:
    """Each order against the median and spread of the customer's other orders."""
    out = windows.leave_one_out(_orders(spark, d).select("o_orderkey", "o_custkey", F.col("o_totalprice").alias("v")), ["o_custkey"], "o_orderkey", "v")
    return out.select("o_orderkey", r6("peer_median").alias("peer_median"), r6("delta").alias("delta"), r6("z").alias("z"))


@query("SELECT o_orderkey, round(((SELECT count(*) FROM orders r WHERE r.o_custkey = o.o_custkey AND r.o_orderstatus = 'F' AND r.o_totalprice < o.o_totalprice) + (SELECT count(*) FROM orders r WHERE r.o_custkey = o.o_custkey AND r.o_orderstatus = 'F' AND r.o_totalprice = o.o_totalprice) / 2e0) / nullif((SELECT count(*) FROM orders r WHERE r.o_custkey = o.o_custkey AND r.o_orderstatus = 'F'), 0), 6) AS percentile FROM orders o WHERE o_orderstatus <> 'F'")
def midrank_percentile(spark: SparkSession, d: str) -> DataFrame:
    """Where an order lies among the customer's finished ones: (less + half equal) / n."""
    o = _orders(spark, d).withColumn("ref", (F.col("o_orderstatus") == "F").cast("int"))
    below = F.sum("ref").over(Window.partitionBy("o_custkey").orderBy("o_totalprice").rangeBetween(Window.unboundedPreceding, 0))
    equal = F.sum("ref").over(Window.partitionBy("o_custkey", "o_totalprice"))
    n = F.sum("ref").over(Window.partitionBy("o_custkey"))
    placed = o.withColumns({"below": below, "equal": equal, "n": n})
    return placed.where("ref = 0").select("o_orderkey", r6((F.col("below") - F.col("equal") / 2) / F.nullif(F.col("n"), F.lit(0))).alias("percentile"))


@query("SELECT l_orderkey, l_linenumber, rank() OVER (PARTITION BY l_suppkey ORDER BY l_quantity) + (count(*) OVER (PARTITION BY l_suppkey, l_quantity) - 1) / 2e0 AS average_rank, rank() OVER (PARTITION BY l_suppkey ORDER BY l_quantity DESC) AS min_rank FROM lineitem")
def average_rank(spark: SparkSession, d: str) -> DataFrame:
    """Ranks whose ties share their mean, and competition ranks from the top."""
    lines = load(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", "l_quantity")
    return windows.average_rank(lines, ["l_suppkey"], "l_quantity").select("l_orderkey", "l_linenumber", "average_rank", "min_rank")


@query("SELECT o_orderkey, CASE WHEN row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) % 2 = 1 THEN 'calibration' ELSE 'model' END AS role, round(o_totalprice - avg(o_totalprice) OVER (PARTITION BY o_custkey), 6) AS demeaned, count(*) OVER (PARTITION BY o_custkey) AS n_group FROM orders")
def alternating_roles(spark: SparkSession, d: str) -> DataFrame:
    """Roles in turn over a group's time order; values less their group's mean; group sizes."""
    at, whole = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")), Window.partitionBy("o_custkey")
    return _orders(spark, d).select("o_orderkey", F.when(at % 2 == 1, "calibration").otherwise("model").alias("role"), r6(F.col("o_totalprice") - F.avg("o_totalprice").over(whole)).alias("demeaned"), F.count("*").over(whole).alias("n_group"))


@query("""
WITH r AS (SELECT o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) - 1 AS pos, count(*) OVER (PARTITION BY o_custkey) AS n FROM orders)
SELECT o_orderkey FROM r WHERE n <= 5 OR pos = 0 OR floor(pos * 4 / greatest(n - 1, 1) + 0.5e0) <> floor((pos - 1) * 4 / greatest(n - 1, 1) + 0.5e0)""")
def even_spread_pick(spark: SparkSession, d: str) -> DataFrame:
    """Five orders of each customer at even distances in time."""
    return windows.spread_picks(_orders(spark, d), ["o_custkey"], [F.col("o_orderdate"), F.col("o_orderkey")], 5).select("o_orderkey")


@query("SELECT o_orderkey, score, rank FROM (SELECT o_orderkey, round(o_totalprice / 1000 + 100 * CAST(o_orderpriority <> '1-URGENT' AS INTEGER), 6) AS score, row_number() OVER (PARTITION BY o_custkey, o_orderstatus ORDER BY o_totalprice / 1000 + 100 * CAST(o_orderpriority <> '1-URGENT' AS INTEGER), o_orderkey) AS rank FROM orders) WHERE rank <= 2")
def quota_take(spark: SparkSession, d: str) -> DataFrame:
    """Two rows of each group by a weighted priority score."""
    score = F.col("o_totalprice") / 1000 + 100 * (F.col("o_orderpriority") != "1-URGENT").cast("int")
    return windows.top(_orders(spark, d).withColumn("score", score), ["o_custkey", "o_orderstatus"], [F.col("score"), F.col("o_orderkey")], 2).select("o_orderkey", r6("score").alias("score"), "rank")


@query("""
WITH p AS (SELECT a.o_orderkey, b.o_orderkey AS ref, abs(dayofyear(a.o_orderdate) - dayofyear(b.o_orderdate)) AS dd, abs(epoch_us(a.o_orderdate) - epoch_us(b.o_orderdate)) AS dt, b.o_orderstatus <> 'F' AS other
  FROM orders a JOIN orders b ON a.o_custkey = b.o_custkey AND a.o_orderkey <> b.o_orderkey),
k AS (SELECT *, least(dd, 366 - dd) AS season, row_number() OVER (PARTITION BY o_orderkey ORDER BY other, least(dd, 366 - dd), dt, ref) AS n FROM p)
SELECT o_orderkey, ref, season FROM k WHERE n = 1""")
def seasonal_reference(spark: SparkSession, d: str) -> DataFrame:
    """For each order another of the customer: finished first, nearest in season, then in time."""
    o = _orders(spark, d).select("o_orderkey", "o_custkey", (F.col("o_orderstatus") != "F").alias("other"), F.col("o_orderdate").alias("day"))
    return joins.seasonal_reference(o, "o_custkey", "day", "other", "o_orderkey").select("o_orderkey", "ref", "season")


_SCORED = "WITH s AS (SELECT d.doc_id, d.lang, d.source, d.n_chars, l.quality, l.toxic FROM documents d JOIN labels l ON d.doc_id = l.doc_id)"


@query(_SCORED + """, r AS (SELECT *, rank() OVER (ORDER BY n_chars) + (count(*) OVER (PARTITION BY n_chars) - 1) / 2e0 AS k FROM s WHERE n_chars IS NOT NULL),
t AS (SELECT sum(k) FILTER (WHERE quality = 1) AS r1, count(*) FILTER (WHERE quality = 1) AS n1, count(*) FILTER (WHERE quality = 0) AS n0 FROM r)
SELECT n1, n0, round(r1 - n1 * (n1 + 1) / 2e0, 6) AS u, round((r1 - n1 * (n1 + 1) / 2e0) / (n1 * n0), 6) AS auc FROM t""")
def auroc_rank(spark: SparkSession, d: str) -> DataFrame:
    """Area under the curve of the length as a score for quality, ties half."""
    return statistics.auroc(_labelled(spark, d), "n_chars", "quality").select("n1", "n0", r6("u").alias("u"), r6("auc").alias("auc"))


@query(_SCORED + """, p AS (SELECT a.lang, avg(CASE WHEN a.n_chars > b.n_chars THEN 1e0 WHEN a.n_chars = b.n_chars THEN 0.5e0 ELSE 0e0 END) AS auc FROM s a JOIN s b ON a.lang = b.lang AND a.quality = 1 AND b.quality = 0 GROUP BY a.lang)
SELECT lang, round(2 * auc - 1, 6) AS delta, CASE WHEN abs(2 * auc - 1) < 0.147 THEN 'negligible' WHEN abs(2 * auc - 1) < 0.33 THEN 'small' WHEN abs(2 * auc - 1) < 0.474 THEN 'medium' ELSE 'large' END AS effect FROM p""")
def cliffs_delta(spark: SparkSession, d: str) -> DataFrame:
    """Effect size of quality on length by language."""
    delta, name = statistics.cliffs_delta(F.col("auc"))
    return statistics.auroc(_labelled(spark, d), "n_chars", "quality", ["lang"]).where("auc IS NOT NULL").select("lang", r6(delta).alias("delta"), name.alias("effect"))


def _pairs(spark: SparkSession, d: str) -> DataFrame:
    o = _orders(spark, d).withColumn("role", F.when(F.col("o_orderstatus") == "F", "pos").otherwise("neg"))
    return statistics.paired(o, "o_custkey", "role", "o_totalprice", "pos", "neg")


_PAIRS = "WITH p AS (SELECT o_custkey, max(o_totalprice) FILTER (WHERE o_orderstatus = 'F') AS pos, max(o_totalprice) FILTER (WHERE o_orderstatus <> 'F') AS neg FROM orders GROUP BY 1 HAVING pos IS NOT NULL AND neg IS NOT NULL)"


@query(_PAIRS + "SELECT count(*) AS n, count(*) FILTER (WHERE pos > neg) AS wins, count(*) FILTER (WHERE pos < neg) AS losses, count(*) FILTER (WHERE pos = neg) AS ties, round(avg(pos - neg), 6) AS mean_diff, round(median(pos - neg), 6) AS median_diff, round(count(*) FILTER (WHERE pos > neg) / count(*), 6) AS win_fraction FROM p")
def paired_wins(spark: SparkSession, d: str) -> DataFrame:
    """Dearest finished against dearest open order of each customer."""
    s = statistics.paired_summary(_pairs(spark, d))
    return s.select("n", "wins", "losses", "ties", r6("mean_diff").alias("mean_diff"), r6("median_diff").alias("median_diff"), r6("win_fraction").alias("win_fraction"))


@query(_PAIRS + """, x AS (SELECT pos - neg AS diff FROM p WHERE pos <> neg), r AS (SELECT diff, rank() OVER (ORDER BY abs(diff)) + (count(*) OVER (PARTITION BY abs(diff)) - 1) / 2e0 AS k, count(*) OVER (PARTITION BY abs(diff)) AS c FROM x),
t AS (SELECT count(*) AS n, sum(k) FILTER (WHERE diff > 0) AS w, sum(CAST(c AS DOUBLE) * c - 1) AS ties FROM r)
SELECT n, round(w, 6) AS w_plus, round((w - n * (n + 1) / 4e0) / sqrt(n * (n + 1e0) * (2 * n + 1) / 24 - ties / 48), 6) AS z FROM t""")
def signed_rank(spark: SparkSession, d: str) -> DataFrame:
    """Wilcoxon's signed ranks of the paired differences."""
    return statistics.signed_rank(_pairs(spark, d), "diff").select("n", r6("w_plus").alias("w_plus"), r6("z").alias("z"))


#: The chance of a standard normal value beyond z on either side, by Simpson's rule on 2,000 steps.
_TAILS = "greatest(0e0, 1 - 2 * abs(z) / 6000 * list_sum(list_transform(range(0, 2001), lambda i: (CASE WHEN i IN (0, 2000) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END) * exp(-(z * i / 2000e0) * (z * i / 2000e0) / 2) / sqrt(2 * pi()))))"


@query(_PAIRS + f""", x AS (SELECT o_custkey % 10 AS g, pos - neg AS diff FROM p WHERE pos <> neg), r AS (SELECT g, diff, rank() OVER (PARTITION BY g ORDER BY abs(diff)) + (count(*) OVER (PARTITION BY g, abs(diff)) - 1) / 2e0 AS k, count(*) OVER (PARTITION BY g, abs(diff)) AS c FROM x),
t AS (SELECT g, count(*) AS n, coalesce(sum(k) FILTER (WHERE diff > 0), 0) AS w, sum(CAST(c AS DOUBLE) * c - 1) AS ties FROM r GROUP BY g), y AS (SELECT g, n, (w - n * (n + 1) / 4e0) / sqrt(n * (n + 1e0) * (2 * n + 1) / 24 - ties / 48) AS z FROM t)
SELECT g, n, round({_TAILS}, 6) AS p FROM y WHERE n > 25""")
def signed_rank_p(spark: SparkSession, d: str) -> DataFrame:
    """Two-sided p of the paired differences in ten groups, those that take the normal tail."""
    pairs = _pairs(spark, d).withColumn("g", F.col("o_custkey") % 10)
    return statistics.signed_rank_test(pairs, "diff", ["g"]).where(F.col("n") > statistics.EXACT).select("g", "n", r6("p").alias("p"))


@query(_SCORED + f""", r AS (SELECT lang, quality, rank() OVER (PARTITION BY lang ORDER BY n_chars) + (count(*) OVER (PARTITION BY lang, n_chars) - 1) / 2e0 AS k, count(*) OVER (PARTITION BY lang, n_chars) AS c FROM s WHERE n_chars IS NOT NULL AND quality IN (0, 1)),
t AS (SELECT lang, count(*)::DOUBLE AS n, count(*) FILTER (WHERE quality = 1)::DOUBLE AS n1, sum(k) FILTER (WHERE quality = 1) AS w, sum(CAST(c AS DOUBLE) * c - 1) AS ties FROM r GROUP BY lang),
y AS (SELECT lang, n, n1, n - n1 AS n0, w - n1 * (n1 + 1) / 2 AS u, (w - n1 * (n1 + 1) / 2 - n1 * (n - n1) / 2) / sqrt(n1 * (n - n1) / 12 * (n + 1 - ties / (n * (n - 1)))) AS z FROM t)
SELECT lang, n1::BIGINT AS n1, n0::BIGINT AS n0, round(u, 6) AS u, round({_TAILS}, 6) AS p FROM y WHERE n > 25""")
def rank_sum_p(spark: SparkSession, d: str) -> DataFrame:
    """Whether good documents of a language are longer: Mann-Whitney's U and two-sided p."""
    t = statistics.rank_sum(_labelled(spark, d), "n_chars", "quality", ["lang"])
    return t.where(F.col("n1") + F.col("n0") > statistics.EXACT).select("lang", "n1", "n0", r6("u").alias("u"), r6("p").alias("p"))


@query("""WITH t AS (SELECT l_suppkey AS g, l_extendedprice::DOUBLE AS y, l_quantity::DOUBLE AS a, l_discount::DOUBLE AS b FROM lineitem),
m AS (SELECT y - avg(y) OVER w AS y, a - avg(a) OVER w AS a, b - avg(b) OVER w AS b FROM t WINDOW w AS (PARTITION BY g)),
s AS (SELECT sum(y * y) AS yy, sum(a * a) AS aa, sum(b * b) AS bb, sum(a * b) AS ab, sum(a * y) AS ay, sum(b * y) AS by_ FROM m),
c AS (SELECT *, (ay * bb - by_ * ab) / (aa * bb - ab * ab) AS ca, (by_ * aa - ay * ab) / (aa * bb - ab * ab) AS cb FROM s)
SELECT (SELECT count(*) FROM t) AS n, (SELECT count(DISTINCT g) FROM t) AS n_groups, round(1 - (yy - ca * ay - cb * by_) / (SELECT var_pop(y) * count(*) FROM t), 6) AS r2, round((ca * ay + cb * by_) / yy, 6) AS r2_within, round(ca, 6) AS per_unit FROM c""")
def absorbed_r2(spark: SparkSession, d: str) -> DataFrame:
    """How well quantity and discount explain a price beside a level for each supplier."""
    t = statistics.absorbed_r2(load(spark, d, "lineitem"), "l_suppkey", "l_extendedprice", ["l_quantity", "l_discount"])
    return t.select("n", "n_groups", r6("r2").alias("r2"), r6("r2_within").alias("r2_within"), r6(F.col("coefficients")[0]).alias("per_unit"))


@query("""WITH s AS (SELECT DISTINCT CAST(s_acctbal AS DOUBLE) AS y FROM supplier), c AS (SELECT c_custkey, CAST(c_acctbal AS DOUBLE) AS x FROM customer),
b AS (SELECT c.*, lo.y AS lower FROM c ASOF LEFT JOIN s lo ON c.x >= lo.y), u AS (SELECT b.*, hi.y AS upper FROM b ASOF LEFT JOIN s hi ON b.x <= hi.y)
SELECT c_custkey, round(CASE WHEN upper IS NULL OR x - lower <= upper - x THEN lower ELSE upper END, 6) AS nearest, round(least(coalesce(x - lower, 1e300), coalesce(upper - x, 1e300)), 6) AS gap FROM u""")
def nearest_balance(spark: SparkSession, d: str) -> DataFrame:
    """For each customer the nearest balance that a supplier has, ties to the smaller."""
    c = load(spark, d, "customer").select("c_custkey", F.col("c_acctbal").cast("double").alias("x"))
    out = prefix.nearest_on_axis(c, "x", load(spark, d, "supplier"), "s_acctbal")
    return out.select("c_custkey", r6("nearest").alias("nearest"), r6("gap").alias("gap"))


@query("""WITH t AS (SELECT o_custkey % 40 AS g, count(*) FILTER (WHERE o_orderstatus = 'F') AS w, count(*) FILTER (WHERE o_orderstatus = 'O') AS l FROM orders GROUP BY 1)
SELECT g, w, l, round(least(1, 2 * (SELECT sum(exp(lgamma(w + l + 1) - lgamma(i + 1) - lgamma(w + l - i + 1) - (w + l) * ln(2))) FROM generate_series(0, least(w, l)) s(i))), 6) AS p FROM t""")
def sign_test(spark: SparkSession, d: str) -> DataFrame:
    """Exact two-sided sign test of finished against open orders in forty groups."""
    t = _orders(spark, d).groupBy((F.col("o_custkey") % 40).alias("g")).agg(F.count_if(F.col("o_orderstatus") == "F").alias("w"), F.count_if(F.col("o_orderstatus") == "O").alias("l"))
    return t.select("g", "w", "l", r6(statistics.sign_test("w", "l")).alias("p"))


@query(_SCORED + """, c AS (SELECT lang, CAST(sum(quality) AS DOUBLE) AS k, CAST(count(*) AS DOUBLE) AS n FROM s GROUP BY 1)
SELECT lang, round((k / n + 3.8416e0 / (2 * n) - 1.96e0 * sqrt(k / n * (1 - k / n) / n + 3.8416e0 / (4 * n * n))) / (1 + 3.8416e0 / n), 6) AS lo, round((k / n + 3.8416e0 / (2 * n) + 1.96e0 * sqrt(k / n * (1 - k / n) / n + 3.8416e0 / (4 * n * n))) / (1 + 3.8416e0 / n), 6) AS hi FROM c""")
def wilson_ci(spark: SparkSession, d: str) -> DataFrame:
    c = _labelled(spark, d).groupBy("lang").agg(F.sum("quality").alias("k"), F.count("*").alias("n"))
    lo, hi = statistics.wilson(F.col("k"), F.col("n"))
    return c.select("lang", r6(lo).alias("lo"), r6(hi).alias("hi"))


@query(_SCORED + """, m AS (SELECT avg(n_chars) AS m FROM s), g AS (SELECT source, count(*) AS k, avg(n_chars) AS gm FROM s GROUP BY 1)
SELECT (SELECT count(*) FROM s) AS n, (SELECT count(*) FROM g) AS n_groups, round((SELECT sum(k * (gm - m) * (gm - m)) FROM g, m) / (SELECT sum((n_chars - m) * (n_chars - m)) FROM s, m), 6) AS r2, (SELECT round(regr_r2(n_chars, quality), 6) FROM s) AS r2_line, (SELECT round(corr(n_chars, toxic), 6) FROM s) AS r""")
def ols_r2_group(spark: SparkSession, d: str) -> DataFrame:
    """Variance of the length that sources explain; a line's R2; a correlation."""
    s = _labelled(spark, d)
    line = s.agg(r6(F.regr_r2("n_chars", "quality")).alias("r2_line"), r6(F.corr("n_chars", "toxic")).alias("r"))
    one = statistics.between_group_r2(s.withColumn("x", F.col("n_chars").cast("double")), "source", "x")
    return one.join(F.broadcast(line)).select("n", "n_groups", r6("r2").alias("r2"), "r2_line", "r")  # one row each


_RATES = "round(tp / nullif(tp + fp, 0), 6) AS precision, round(tp / nullif(tp + fn, 0), 6) AS recall, round(tn / nullif(tn + fp, 0), 6) AS specificity, round(2 * tp / nullif(2 * tp + fp + fn, 0), 6) AS f1, round((tp + tn) / nullif(tp + fp + tn + fn, 0), 6) AS accuracy"
_CELLS = "count(*) FILTER (WHERE quality = 1 AND toxic = 1) AS tp, count(*) FILTER (WHERE quality = 0 AND toxic = 1) AS fp, count(*) FILTER (WHERE quality = 0 AND toxic = 0) AS tn, count(*) FILTER (WHERE quality = 1 AND toxic = 0) AS fn"
_NAMES = ("precision", "recall", "specificity", "f1", "accuracy")


@query(_SCORED + f", c AS (SELECT source, {_CELLS} FROM s GROUP BY 1) SELECT source, tp, fp, tn, fn, {_RATES} FROM c")
def confusion_metrics(spark: SparkSession, d: str) -> DataFrame:
    """Counts and rates of toxicity as a guess of quality, by source."""
    c = _labelled(spark, d).groupBy("source").agg(*aggregates.confusion("quality", "toxic"))
    return aggregates.with_rates(c).select("source", "tp", "fp", "tn", "fn", *[r6(n).alias(n) for n in _NAMES])


@query(_SCORED + ", c AS (SELECT CASE WHEN n_chars > 0 AND n_chars <= 1000 THEN 'short' WHEN n_chars > 1000 AND n_chars <= 3000 THEN 'mid' WHEN n_chars > 3000 THEN 'long' END AS bin, count(*) AS n, count(*) FILTER (WHERE quality = 1) AS positives, count(*) FILTER (WHERE quality = 1 AND toxic = 1) AS tp FROM s GROUP BY 1) SELECT bin, n, positives, round(tp / nullif(positives, 0), 6) AS recall FROM c WHERE bin IS NOT NULL")
def confusion_by_bin(spark: SparkSession, d: str) -> DataFrame:
    """Recall by length; bins without rows do not appear."""
    from matchbook.functions.text import binned

    s = _labelled(spark, d).withColumn("bin", binned(F.col("n_chars"), [0, 1000, 3000, 1 << 60], ["short", "mid", "long"])).where("bin IS NOT NULL")
    c = s.groupBy("bin").agg(F.count("*").alias("n"), F.count_if(F.col("quality") == 1).alias("positives"), F.count_if((F.col("quality") == 1) & (F.col("toxic") == 1)).alias("tp"))
    return c.select("bin", "n", "positives", r6(F.col("tp") / F.nullif(F.col("positives"), F.lit(0))).alias("recall"))


@query(_SCORED + f", c AS (SELECT source, {_CELLS} FROM s GROUP BY 1), r AS (SELECT tp / nullif(tp + fn, 0) AS recall, tn / nullif(tn + fp, 0) AS spec FROM c) SELECT count(*) AS n, round(avg(recall), 6) AS macro_recall, round(avg(spec), 6) AS macro_specificity FROM r")
def macro_site_metric(spark: SparkSession, d: str) -> DataFrame:
    """Metrics per source, then their plain mean."""
    c = aggregates.with_rates(_labelled(spark, d).groupBy("source").agg(*aggregates.confusion("quality", "toxic")))
    return c.agg(F.count("*").alias("n"), r6(F.avg("recall")).alias("macro_recall"), r6(F.avg("specificity")).alias("macro_specificity"))


@query("""WITH p AS (SELECT l_suppkey, avg(l_discount) - (SELECT avg(l_discount) FROM lineitem) AS x FROM lineitem GROUP BY 1), t AS (SELECT l_suppkey, round(least(1, exp(-abs(x) * 2000)), 12) AS p FROM p),
r AS (SELECT *, row_number() OVER (ORDER BY p) AS k, count(*) OVER () AS n FROM t)
SELECT l_suppkey, round(least(1, min(p * n / k) OVER (ORDER BY p, k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)), 6) AS q FROM r""")
def bh_qvalues(spark: SparkSession, d: str) -> DataFrame:
    """Corrected p-values of a hundred tests."""
    means = load(spark, d, "lineitem").groupBy("l_suppkey").agg(aggregates.steady_mean("l_discount").alias("m"))
    overall = load(spark, d, "lineitem").agg(aggregates.steady_mean("l_discount").alias("o"))
    tests = means.join(F.broadcast(overall)).select("l_suppkey", F.round(F.least(F.lit(1.0), F.exp(-F.abs(F.col("m") - F.col("o")) * 2000)), 12).alias("p"))
    return windows.benjamini_hochberg(tests, "p").select("l_suppkey", r6("q").alias("q"))


@query("""WITH t AS (SELECT quantile_cont(l_extendedprice, 0.01) AS a, quantile_cont(l_extendedprice, 0.25) AS b, median(l_extendedprice) AS m, quantile_cont(l_extendedprice, 0.75) AS c, quantile_cont(l_extendedprice, 0.99) AS e FROM lineitem WHERE l_returnflag <> 'R')
SELECT round(abs(median(l_extendedprice) - any_value(m)) / (any_value(c) - any_value(b)), 6) AS median_shift, round(avg(CAST(l_extendedprice < a OR l_extendedprice > e AS INTEGER)), 6) AS outside FROM lineitem, t WHERE l_returnflag = 'R'""")
def feature_shift(spark: SparkSession, d: str) -> DataFrame:
    rows = load(spark, d, "lineitem")
    out = statistics.shift(rows.where("l_returnflag <> 'R'"), rows.where("l_returnflag = 'R'"), "l_extendedprice")
    return out.select(r6("median_shift").alias("median_shift"), r6("outside").alias("outside"))


@query()
def bootstrap_ci(spark: SparkSession, d: str) -> DataFrame:
    """95 % intervals of the mean and median paired difference, 1,000 replicates."""
    out = statistics.bootstrap(_pairs(spark, d), "o_custkey", "diff", 1000)
    return out.select("n_replicates", *[r6(c).alias(c) for c in ("mean_lo", "mean_hi", "median_lo", "median_hi")])


@query()
def bootstrap_auc(spark: SparkSession, d: str) -> DataFrame:
    """The price as a score for finished orders, with an interval from customers drawn whole."""
    o = _orders(spark, d).withColumn("finished", (F.col("o_orderstatus") == "F").cast("int"))
    out = statistics.bootstrap_auc(o, "o_custkey", "o_totalprice", "finished", 500)
    return out.select("n_replicates", r6("auc").alias("auc"), r6("auc_lo").alias("auc_lo"), r6("auc_hi").alias("auc_hi"))


@query()
def stratified_bootstrap(spark: SparkSession, d: str) -> DataFrame:
    """The same within classes: recall of toxicity by quality."""
    rows = _labelled(spark, d).withColumn("hit", F.col("toxic").cast("double"))
    out = statistics.bootstrap(rows, "doc_id", "hit", 500, strata=["quality"])
    return out.select("quality", "n_replicates", r6("mean_lo").alias("mean_lo"), r6("mean_hi").alias("mean_hi"))


def _slot_costs(spark: SparkSession, d: str) -> DataFrame:
    o = _orders(spark, d)
    a, b = o.where("o_orderstatus = 'F'").alias("a"), o.where("o_orderstatus = 'O'").alias("b")
    gap = F.abs(F.datediff("a.o_orderdate", "b.o_orderdate"))
    pairs = a.join(b, F.col("a.o_custkey") == F.col("b.o_custkey")).select(F.col("a.o_custkey").alias("o_custkey"), F.col("a.o_orderkey").alias("slot"), F.col("b.o_orderkey").alias("candidate"), gap.cast("double").alias("cost"))
    return pairs.where("cost <= 1500")


@query()
def optimal_controls(spark: SparkSession, d: str) -> DataFrame:
    """The cheapest one-to-one choice of open orders as controls of finished ones, by customer."""
    return assignment.optimal(_slot_costs(spark, d), "o_custkey")


@query()
def greedy_one_to_one(spark: SparkSession, d: str) -> DataFrame:
    """Pairs taken in order of cost, each side once."""
    costs = _slot_costs(spark, d)
    return assignment.greedy(costs, [F.col("cost"), F.col("slot"), F.col("candidate")], "slot", "candidate")


@query()
def greedy_controls(spark: SparkSession, d: str) -> DataFrame:
    """Finished orders in turn, each taking the nearest open order that none before it took."""
    return assignment.greedy(_slot_costs(spark, d), [F.col("slot"), F.col("cost"), F.col("candidate")], "slot", "candidate")


@query()
def nested_group_folds(spark: SparkSession, d: str) -> DataFrame:
    """Customers dealt whole to test, validation and training with like shares of open orders."""
    o = _orders(spark, d).withColumn("finished", F.when(F.col("o_orderstatus") == "F", 1).when(F.col("o_orderstatus") == "O", 0))
    return assignment.nested_group_folds(o, "o_custkey", "finished")


@query("SELECT o_orderkey, CASE WHEN CAST('0x' || substr(md5('0:' || o_custkey), 1, 12) AS BIGINT) % 1000000 < 200000 THEN 'test' ELSE 'train' END AS split FROM orders")
def group_split(spark: SparkSession, d: str) -> DataFrame:
    """Whole customers to test or train by a hash."""
    return assignment.group_split(_orders(spark, d), "o_custkey", 0.2).select("o_orderkey", "split")


@query("""WITH g AS (SELECT o_custkey, count(*) AS n, CAST(round(avg(CAST(o_orderstatus = 'F' AS INTEGER))) AS INTEGER) AS mix FROM orders GROUP BY 1),
r AS (SELECT *, row_number() OVER (PARTITION BY mix ORDER BY n DESC, o_custkey) - 1 AS pos FROM g)
SELECT o_custkey, n, CAST(CASE WHEN (pos // 5) % 2 = 0 THEN pos % 5 ELSE 4 - pos % 5 END AS INTEGER) AS fold FROM r""")
def group_folds(spark: SparkSession, d: str) -> DataFrame:
    """Five folds of customers, balanced in size and class mix."""
    o = _orders(spark, d).withColumn("y", (F.col("o_orderstatus") == "F").cast("int"))
    return assignment.balanced_folds(o, "o_custkey", 5, "y")


@query("""WITH s AS (SELECT o_orderkey, o_custkey, CASE WHEN CAST('0x' || substr(md5('0:' || o_custkey), 1, 12) AS BIGINT) % 1000000 < 200000 THEN 'test' ELSE 'train' END AS split FROM orders)
SELECT l_orderkey, l_linenumber, 0.5e0 AS weight FROM lineitem WHERE l_returnflag = 'R' AND l_orderkey IN (SELECT o_orderkey FROM s WHERE split = 'train')""")
def weak_augmentation(spark: SparkSession, d: str) -> DataFrame:
    """Weakly labelled rows (returned lines) only of groups in train, at half weight."""
    train = assignment.group_split(_orders(spark, d), "o_custkey", 0.2).where("split = 'train'").select(F.col("o_orderkey").alias("l_orderkey"))
    weak = load(spark, d, "lineitem").where("l_returnflag = 'R'")
    return weak.join(train, "l_orderkey", "left_semi").select("l_orderkey", "l_linenumber", F.lit(0.5).alias("weight"))


@query("SELECT o_custkey, count(DISTINCT o_orderkey % 3) AS n_splits FROM orders GROUP BY 1 HAVING n_splits > 1")
def leakage_violations(spark: SparkSession, d: str) -> DataFrame:
    """Groups that a careless row-wise split would put on several sides."""
    return gates.leaks(_orders(spark, d).withColumn("split", F.col("o_orderkey") % 3), "o_custkey", "split")


@query(_SCORED + """, w AS (SELECT *, 1e0 / count(*) OVER (PARTITION BY source) * (count(*) OVER () / (2e0 * count(*) OVER (PARTITION BY quality))) AS w FROM s) SELECT doc_id, round(w / avg(w) OVER (), 6) AS weight FROM w""")
def training_weights(spark: SparkSession, d: str) -> DataFrame:
    return assignment.training_weights(_labelled(spark, d), "source", "quality").select("doc_id", r6("weight").alias("weight"))


@query(_SCORED + """, x AS (SELECT *, doc_id % 3 AS fold, n_chars / 20000e0 AS score FROM s), v AS (SELECT DISTINCT score AS t FROM x),
c AS (SELECT t FROM v UNION SELECT (t + lead(t) OVER (ORDER BY t)) / 2 FROM v UNION SELECT 0e0 UNION SELECT 1e0),
m AS (SELECT t, fold, count(*) FILTER (WHERE score >= t AND quality = 1) / count(*) FILTER (WHERE quality = 1) AS recall, count(*) FILTER (WHERE score >= t AND quality = 0) / count(*) FILTER (WHERE quality = 0) AS fpr FROM c, x WHERE t IS NOT NULL GROUP BY ALL),
a AS (SELECT t, round(avg((recall + 1 - fpr) / 2), 9) AS mean_ba, round(min((recall + 1 - fpr) / 2), 9) AS min_ba, round(avg(recall), 9) AS recall FROM m GROUP BY 1)
SELECT round(t, 6) AS threshold, round(mean_ba, 6) AS mean_ba, round(min_ba, 6) AS min_ba, round(recall, 6) AS recall FROM a ORDER BY a.mean_ba DESC, a.min_ba DESC, a.recall DESC, t LIMIT 1""")
def threshold_search(spark: SparkSession, d: str) -> DataFrame:
    """The best threshold of the length for quality, over three folds."""
    x = _labelled(spark, d).withColumn("fold", F.col("doc_id") % 3).withColumn("score", F.col("n_chars") / 20000.0)
    out = assignment.threshold_search(x, "score", "quality", "fold")
    return out.select(*[r6(c).alias(c) for c in ("threshold", "mean_ba", "min_ba", "recall")])


@query(_SCORED + "SELECT round((median(n_chars) FILTER (WHERE quality = 1) + median(n_chars) FILTER (WHERE quality = 0)) / 2, 6) AS threshold, CASE WHEN median(n_chars) FILTER (WHERE quality = 1) >= median(n_chars) FILTER (WHERE quality = 0) THEN 'above' ELSE 'below' END AS positive FROM s")
def median_midpoint(spark: SparkSession, d: str) -> DataFrame:
    """Threshold half-way between the classes' medians."""
    q = quantiles.quantiles(_labelled(spark, d), ["quality"], "n_chars", [0.5])
    t = q.agg(*[F.max(F.when(F.col("quality") == k, F.col("q")[0])).alias(f"m{k}") for k in (1, 0)])
    return t.select(r6((F.col("m1") + F.col("m0")) / 2).alias("threshold"), F.when(F.col("m1") >= F.col("m0"), "above").otherwise("below").alias("positive"))


@query(_SCORED.replace("SELECT d.doc_id, ", "SELECT d.doc_id AS id, ") + ", g AS (SELECT source, sum(quality) AS p, count(quality) AS n FROM s GROUP BY 1) SELECT s.id AS doc_id, s.source, round(((SELECT sum(p) FROM g) - p) / ((SELECT sum(n) FROM g) - n), 6) AS score FROM s JOIN g ON s.source IS NOT DISTINCT FROM g.source")
def prior_dummy(spark: SparkSession, d: str) -> DataFrame:
    """What a model that knows only the other sources' share of good documents would say."""
    from matchbook.operators.models import prior_scores

    return prior_scores(_labelled(spark, d), "source", "doc_id", "quality").select("doc_id", "source", r6("score").alias("score"))


@query()
def logo_logistic(spark: SparkSession, d: str) -> DataFrame:
    """Leave one group out: a balanced logistic model on the rest, scores of the held-out group."""
    from matchbook.operators.models import leave_one_group_out

    rows = load(spark, d, "embeddings").where("label IS NOT NULL")
    width = rows.agg(F.max(F.size("embedding"))).first()[0] or 0
    e = rows.select("vec_id", (F.col("label") % 2).alias("y"), F.floor(F.col("vec_id") % 4).alias("site"), *[F.get("embedding", F.lit(i)).cast("double").alias(f"x{i}") for i in range(width)])
    return leave_one_group_out(e, "site", "vec_id", [f"x{i}" for i in range(width)], "y")
