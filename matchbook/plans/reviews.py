"""Queries that review groups: extremes, errors, calibration, merges, splits, completeness."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from matchbook.functions import text
from matchbook.functions.geo import safe_ratio
from matchbook.operators import aggregates, assignment, gates, incremental, joins, quantiles, statistics
from matchbook.operators.graph import connected_components
from matchbook.operators.joins import HOUR, micros
from matchbook.plans.analytics import _SCORED, _labelled
from matchbook.plans.events import _ALL_INTERVALS, _intervals
from matchbook.plans.registry import query, r6
from matchbook.session import load, shared_dir
from matchbook.sources import readers, sinks


@query("""
WITH m AS (SELECT o_custkey, max(o_totalprice) AS p FROM orders WHERE o_orderstatus = 'F' GROUP BY 1)
SELECT m.o_custkey, count(*) FILTER (WHERE o_orderstatus <> 'F') AS n_controls, 1 + count(*) FILTER (WHERE o_orderstatus <> 'F' AND o_totalprice > p) AS rank,
  count(*) FILTER (WHERE o_orderstatus <> 'F' AND o_totalprice >= p) = 0 AS most_extreme FROM m JOIN orders o ON m.o_custkey = o.o_custkey GROUP BY m.o_custkey""")
def group_extremes(spark: SparkSession, d: str) -> DataFrame:
    """Whether a customer's dearest finished order is above all the others, and its rank among them."""
    o = load(spark, d, "orders").select("o_custkey", "o_orderstatus", "o_totalprice")
    top = o.where("o_orderstatus = 'F'").groupBy("o_custkey").agg(F.max("o_totalprice").alias("p"))
    control = F.col("o_orderstatus") != "F"
    g = o.join(top, "o_custkey").groupBy("o_custkey").agg(F.count_if(control).alias("n_controls"), (1 + F.count_if(control & (F.col("o_totalprice") > F.col("p")))).alias("rank"), F.count_if(control & (F.col("o_totalprice") >= F.col("p"))).alias("n"))
    return g.select("o_custkey", "n_controls", "rank", (F.col("n") == 0).alias("most_extreme"))


@query("""
WITH e AS (SELECT l_returnflag AS kind, l_extendedprice * (1 - l_discount) - l_extendedprice AS err, l_extendedprice AS truth FROM lineitem WHERE l_extendedprice > 0 AND l_linestatus = 'F')
SELECT kind, count(*) AS n, round(avg(abs(err)), 6) AS mae, round(avg(err), 6) AS bias, round(avg(100 * abs(err) / truth), 6) AS mean_percent, round(median(100 * abs(err) / truth), 6) AS median_percent FROM e GROUP BY 1""")
def quantification_error(spark: SparkSession, d: str) -> DataFrame:
    """Errors of reported against true amounts, absolute and in percent, and their bias."""
    x = load(spark, d, "lineitem").where("l_extendedprice > 0 AND l_linestatus = 'F'")
    err = F.col("l_extendedprice") * (1 - F.col("l_discount")) - F.col("l_extendedprice")
    e = x.select(F.col("l_returnflag").alias("kind"), err.alias("err"), (100 * F.abs(err) / F.col("l_extendedprice")).alias("pct"))
    out = e.groupBy("kind").agg(F.count("*").alias("n"), r6(F.avg(F.abs("err"))).alias("mae"), r6(F.avg("err")).alias("bias"), r6(F.avg("pct")).alias("mean_percent"))
    return quantiles.with_quantiles(out, e, ["kind"], "pct", {"median_percent": 0.5}).withColumn("median_percent", r6("median_percent"))


@query("""
WITH g AS (SELECT l_suppkey, avg(l_quantity) FILTER (WHERE l_returnflag = 'R') AS sm, median(l_quantity) FILTER (WHERE l_returnflag = 'R') AS sq, avg(l_quantity) FILTER (WHERE l_returnflag <> 'R') AS bm, median(l_quantity) FILTER (WHERE l_returnflag <> 'R') AS bq,
  stddev_samp(l_quantity) FILTER (WHERE l_returnflag <> 'R') AS sd, quantile_cont(l_quantity, 0.75) FILTER (WHERE l_returnflag <> 'R') - quantile_cont(l_quantity, 0.25) FILTER (WHERE l_returnflag <> 'R') AS iqr FROM lineitem GROUP BY 1)
SELECT l_suppkey, round(CASE WHEN sd > 1e-12 THEN (sm - bm) / sd END, 6) AS z, round(CASE WHEN iqr / 1.349e0 > 1e-12 THEN (sq - bq) / (iqr / 1.349e0) END, 6) AS robust_z, round(CASE WHEN abs(bm) > 1e-12 THEN 100 * (sm - bm) / bm END, 6) AS percent FROM g""")
def source_background_z(spark: SparkSession, d: str) -> DataFrame:
    """A supplier's returned lines against its others: plain and robust z, and percent."""
    src = lambda is_source, c: F.when((F.col("l_returnflag") == "R") if is_source else (F.col("l_returnflag") != "R"), F.col(c))
    x = load(spark, d, "lineitem").select("l_suppkey", src(True, "l_quantity").alias("s"), src(False, "l_quantity").alias("b"))
    g = x.groupBy("l_suppkey").agg(F.avg("s").alias("sm"), F.avg("b").alias("bm"), F.stddev_samp("b").alias("sd"))
    # both sides in one pass
    both = x.select("l_suppkey", F.col("s").isNotNull().alias("is_source"), F.coalesce("s", "b").alias("v"))
    q = quantiles.quantiles(both, ["l_suppkey", "is_source"], "v", [0.25, 0.5, 0.75]).groupBy("l_suppkey").agg(F.max(F.when(F.col("is_source"), F.col("q")[1])).alias("sq"), F.max(F.when(~F.col("is_source"), F.col("q"))).alias("q"))
    g = g.join(q, "l_suppkey", "left")
    away = F.col("sm") - F.col("bm")
    return g.select("l_suppkey", r6(safe_ratio(away, F.col("sd"))).alias("z"), r6(safe_ratio(F.col("sq") - F.col("q")[1], (F.col("q")[2] - F.col("q")[0]) / 1.349)).alias("robust_z"), r6(100 * safe_ratio(away, F.col("bm"))).alias("percent"))


@query(_SCORED + """, p AS (SELECT a.source, avg(CASE WHEN a.n_chars > b.n_chars THEN 1e0 WHEN a.n_chars = b.n_chars THEN 0.5e0 ELSE 0e0 END) AS auc FROM s a JOIN s b ON a.source = b.source AND a.quality = 1 AND b.quality = 0 GROUP BY 1)
SELECT source, CASE WHEN round(auc, 9) >= 0.7 THEN 'separates' WHEN abs(round(2 * auc - 1, 9)) >= 0.147 THEN 'weak' ELSE 'none' END AS decision FROM p""")
def combined_decision(spark: SparkSession, d: str) -> DataFrame:
    """An ordered rule over the curve's area and the effect size of each source."""
    auc = F.round("auc", 9)
    rules = [(auc >= 0.7, "separates"), (F.abs(F.round(2 * F.col("auc") - 1, 9)) >= 0.147, "weak")]
    return statistics.auroc(_labelled(spark, d), "n_chars", "quality", ["source"]).where("auc IS NOT NULL").select("source", text.first_reason(rules, "none").alias("decision"))


@query("""
WITH e AS (SELECT event_id, user_id, epoch_us(ts) AS t, epoch_us(ts) // 86400000000 AS day FROM events WHERE event_type = 'view'),
f AS (SELECT *, CASE WHEN t - lag(t) OVER w <= 3600000000 THEN 0 ELSE 1 END AS b FROM e WINDOW w AS (PARTITION BY user_id, day ORDER BY t, event_id)),
s AS (SELECT *, sum(b) OVER (PARTITION BY user_id, day ORDER BY t, event_id) AS k FROM f)
SELECT event_id, component, n_members FROM (SELECT event_id, min(event_id) OVER (PARTITION BY user_id, day, k) AS component, count(*) OVER (PARTITION BY user_id, day, k) AS n_members FROM s) WHERE n_members > 1""")
def possible_duplicates(spark: SparkSession, d: str) -> DataFrame:
    """Views of a user within an hour of each other as possible duplicates, joined to components
    within a UTC day; pairs across midnight are never compared."""
    e = load(spark, d, "events").where("event_type = 'view'").select("user_id", "event_id", micros("ts").alias("t")).withColumn("day", F.floor(F.col("t") / (24 * HOUR)))
    left, right = e.withColumnsRenamed({"event_id": "l_id", "t": "l_t"}), e.withColumnsRenamed({"event_id": "r_id", "t": "r_t"})
    links = joins.candidates_in_time(left, right, ["user_id", "day"], HOUR).where("l_id < r_id").select(F.col("l_id").alias("a"), F.col("r_id").alias("b"))
    c = connected_components(links)
    return c.join(c.groupBy("component").agg(F.count("*").alias("n_members")), "component").select(F.col("node").alias("event_id"), "component", "n_members")


@query(_ALL_INTERVALS + """, g AS (SELECT user_id, CAST(i_start // 86400000000 AS BIGINT) AS day, count(*) AS n, max(i_start) - min(i_start) AS a, max(i_end) - min(i_end) AS b, min(i_end) > max(i_start) AS o FROM i GROUP BY 1, 2)
SELECT user_id, day, concat_ws(' + ', CASE WHEN n >= 8 THEN 'too many' END, CASE WHEN a > 3600000000 THEN 'starts differ' END, CASE WHEN b > 3600000000 THEN 'ends differ' END, CASE WHEN NOT o THEN 'no shared time' END) AS reasons,
  n < 8 AND a <= 3600000000 AND b <= 3600000000 AND o AS safe FROM g WHERE n > 1""")
def merge_review(spark: SparkSession, d: str) -> DataFrame:
    """Whether a day's sessions of a user may be merged into one, and what speaks against it."""
    i = _intervals(spark, d).withColumn("day", F.floor(F.col("i_start") / (24 * HOUR)))
    g = aggregates.consensus(i, ["user_id", "day"]).where("n > 1")
    rules = [(F.col("n") >= 8, "too many"), (F.col("start_spread") > HOUR, "starts differ"), (F.col("end_spread") > HOUR, "ends differ"), (~F.col("overlaps"), "no shared time")]
    return g.select("user_id", "day", text.all_reasons(rules).alias("reasons")).withColumn("safe", F.col("reasons") == "")


@query("SELECT doc_id % 25 AS split, count(*) FILTER (WHERE toxic = 1) AS n1, count(*) FILTER (WHERE toxic = 0) AS n0 FROM labels GROUP BY 1 HAVING n1 = 0 OR n0 = 0")
def one_class_splits(spark: SparkSession, d: str) -> DataFrame:
    """Splits that lack toxic or clean documents."""
    return gates.one_class_splits(load(spark, d, "labels").withColumn("split", F.col("doc_id") % 25), "split", "toxic")


@query("SELECT p.o_orderkey AS a, q.o_orderkey AS b FROM orders p JOIN orders q ON p.o_custkey = q.o_custkey AND p.o_orderstatus = 'F' AND q.o_orderstatus = 'O' AND abs(epoch_us(p.o_orderdate) - epoch_us(q.o_orderdate)) <= 20 * 86400000000")
def close_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Finished and open orders of a customer that lie too close in time (20 days) for a pair."""
    o = load(spark, d, "orders").select(F.col("o_custkey").alias("c"), F.col("o_orderkey").alias("id"), micros("o_orderdate").alias("t"), "o_orderstatus")
    left = o.where("o_orderstatus = 'F'").select("c", F.col("id").alias("l_id"), F.col("t").alias("l_t"))
    right = o.where("o_orderstatus = 'O'").select("c", F.col("id").alias("r_id"), F.col("t").alias("r_t"))
    return joins.candidates_in_time(left, right, ["c"], 20 * 24 * HOUR).select(F.col("l_id").alias("a"), F.col("r_id").alias("b"))


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_partkey % 9 = l_suppkey % 9 OR l_partkey % 9 = l_linenumber OR l_suppkey % 9 = l_linenumber")
def equal_slots(spark: SparkSession, d: str) -> DataFrame:
    """Rows in which two of three slots hold one value."""
    x = load(spark, d, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_partkey") % 9).alias("t0"), (F.col("l_suppkey") % 9).alias("t90"), F.col("l_linenumber").cast("long").alias("t360"))
    return gates.equal_slots(x, ["t0", "t90", "t360"]).select("l_orderkey", "l_linenumber")


@query("""
WITH c AS (SELECT c_custkey, c_mktsegment || ':' || CASE WHEN c_acctbal < 0 THEN 'low' WHEN c_acctbal < 9000 THEN 'mid' ELSE 'high' END AS s FROM customer),
t AS (SELECT c_custkey, CASE WHEN count(*) OVER (PARTITION BY s) < 4 THEN 'other' ELSE s END AS stratum FROM c)
SELECT c_custkey, stratum, CASE WHEN row_number() OVER (PARTITION BY stratum ORDER BY md5('0:' || c_custkey), c_custkey) <= ceil(0.2e0 * count(*) OVER (PARTITION BY stratum)) THEN 'test' ELSE 'train' END AS split FROM t""")
def rare_strata_split(spark: SparkSession, d: str) -> DataFrame:
    """A stratified split in which strata of fewer than four customers become one."""
    s = F.concat_ws(":", "c_mktsegment", F.when(F.col("c_acctbal") < 0, "low").when(F.col("c_acctbal") < 9000, "mid").otherwise("high"))
    return assignment.stratified_split(load(spark, d, "customer").withColumn("stratum", s), "c_custkey", "stratum", 0.2, 4).select("c_custkey", "stratum", "split")


@query("""
WITH o AS (SELECT o_orderkey, o_custkey, o_totalprice AS v, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) % 2 = 1 AS cal FROM orders),
m AS (SELECT o_custkey, median(v) AS m, quantile_cont(v, 0.75) - quantile_cont(v, 0.25) AS iqr, stddev_samp(v) AS sd FROM o WHERE cal GROUP BY 1),
a AS (SELECT o.o_custkey, median(abs(v - m)) AS mad FROM o JOIN m ON o.o_custkey = m.o_custkey WHERE cal GROUP BY 1)
SELECT o_orderkey, round((v - m) / coalesce(CASE WHEN 1.4826e0 * mad > 1e-12 THEN 1.4826e0 * mad END, CASE WHEN iqr / 1.349e0 > 1e-12 THEN iqr / 1.349e0 END, CASE WHEN sd > 1e-12 THEN sd END, 1), 6) AS z
FROM o JOIN m ON o.o_custkey = m.o_custkey JOIN a ON o.o_custkey = a.o_custkey WHERE NOT cal""")
def site_calibration(spark: SparkSession, d: str) -> DataFrame:
    """Every second order of a customer sets its baseline; the others are given as robust z."""
    at = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey"))
    o = load(spark, d, "orders").select("o_orderkey", "o_custkey", F.col("o_totalprice").alias("v"), (at % 2 == 1).alias("cal"))
    base = aggregates.robust_scale(o.where("cal"), ["o_custkey"], "v").select("o_custkey", "median", "scale")
    return o.where("NOT cal").join(base, "o_custkey").select("o_orderkey", r6((F.col("v") - F.col("median")) / F.col("scale")).alias("z"))


@query("SELECT o_orderkey, epoch_us(CAST(CAST(o_orderdate AS DATE) AS TIMESTAMP)) + (o_orderkey * 37 % 86400) * 1000000 AS t FROM orders")
def seconds_of_day(spark: SparkSession, d: str) -> DataFrame:
    """Timestamps out of a date and seconds since midnight."""
    at = F.unix_micros(F.to_date("o_orderdate").cast("timestamp")) + (F.col("o_orderkey") * 37 % 86400).cast("long") * 1_000_000
    return load(spark, d, "orders").select("o_orderkey", at.alias("t"))


@query("SELECT event_id, 'T' || lpad(CAST(user_id % 60 AS VARCHAR), 2, '0') || 'SNF' AS tile, strftime(ts, '%Y%m%dT%H%M%S') AS stamp, event_type AS product FROM events WHERE user_id IS NOT NULL")
def scene_ids(spark: SparkSession, d: str) -> DataFrame:
    """Tile, time stamp and product out of scene names."""
    name = F.concat_ws("_", F.lit("S2"), F.col("event_type"), F.date_format("ts", "yyyyMMdd'T'HHmmss"), F.concat(F.lit("T"), F.lpad((F.col("user_id") % 60).cast("string"), 2, "0"), F.lit("SNF")))
    e = load(spark, d, "events").where("user_id IS NOT NULL").select("event_id", name.alias("scene"))
    return e.select("event_id", F.regexp_extract("scene", r"_(T\d{2}[A-Z]{3})(?:_|$)", 1).alias("tile"), F.regexp_extract("scene", r"_(\d{8}T\d{6})(?:_|$)", 1).alias("stamp"), F.regexp_extract("scene", r"^S2_([a-z]+)_", 1).alias("product"))


@query("""WITH s AS (SELECT vec_id, avg(CAST(abs(v) > 0.3 AS INTEGER)) AS invalid, quantile_cont(v, 0.9) - quantile_cont(v, 0.1) AS het, stddev_pop(v) AS sd FROM (SELECT vec_id, unnest(embedding)::DOUBLE AS v FROM embeddings) GROUP BY 1)
SELECT vec_id, round(greatest(0, least(1, 1 - invalid - het / 2 - sd / 2)), 6) AS quality FROM s""")
def patch_quality(spark: SparkSession, d: str) -> DataFrame:
    """One less the invalid share and half of two spreads, kept between 0 and 1."""
    px = load(spark, d, "embeddings").select("vec_id", F.explode("embedding").alias("x")).select("vec_id", F.col("x").cast("double").alias("v"))
    g = px.groupBy("vec_id").agg(F.avg((F.abs("v") > 0.3).cast("int")).alias("invalid"), F.expr("percentile(v, array(0.1, 0.9))").alias("q"), F.stddev_pop("v").alias("sd"))
    score = 1 - F.col("invalid") - (F.col("q")[1] - F.col("q")[0]) / 2 - F.col("sd") / 2
    return g.select("vec_id", r6(F.greatest(F.lit(0.0), F.least(F.lit(1.0), score))).alias("quality"))


@query(_SCORED + """, f AS (SELECT doc_id % 5 AS fold, count(*) FILTER (WHERE quality = 1 AND toxic = 1) / nullif(count(*) FILTER (WHERE quality = 1), 0) AS recall FROM s GROUP BY 1)
SELECT count(*) AS n_folds, round(avg(recall), 6) AS mean, round(min(recall), 6) AS least, round(max(recall), 6) AS most FROM f""")
def fold_summary(spark: SparkSession, d: str) -> DataFrame:
    """Each fold's result as a JSON record of its own; all read again into one summary."""
    c = aggregates.with_rates(_labelled(spark, d).groupBy((F.col("doc_id") % 5).alias("fold")).agg(*aggregates.confusion("quality", "toxic")))
    path = f"{shared_dir(spark)}/matchbook/folds-{uuid.uuid4().hex}"
    sinks.write_json_lines(c.select("fold", "recall"), path)
    f = readers.read_json_any(spark, path, T.StructType().add("fold", "long").add("recall", "double"))
    return f.agg(F.count("*").alias("n_folds"), r6(F.avg("recall")).alias("mean"), r6(F.min("recall")).alias("least"), r6(F.max("recall")).alias("most"))


@query("""
WITH l AS (SELECT l_orderkey, l_linenumber, bool_or(l_linestatus = 'F') AS ok FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders) GROUP BY 1, 2)
SELECT l_orderkey AS o_orderkey, bool_and(ok) AS complete FROM l GROUP BY 1""")
def complete_groups(spark: SparkSession, d: str) -> DataFrame:
    """Orders all of whose expected lines are in the log as finished."""
    lines = load(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), F.concat_ws(":", "l_orderkey", "l_linenumber").alias("line"), "l_linestatus")
    known = lines.join(load(spark, d, "orders").select("o_orderkey"), "o_orderkey", "left_semi")
    return incremental.complete_groups(known.select("o_orderkey", "line"), known, "o_orderkey", "line", F.col("l_linestatus") == "F").select("o_orderkey", "complete")


@query("SELECT l_orderkey, l_linenumber, o_custkey AS inherited FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_returnflag = 'R'")
def inherited_groups(spark: SparkSession, d: str) -> DataFrame:
    """Returned lines take over the customer of their order; orphans stop the query."""
    child = load(spark, d, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"), "l_linenumber")
    parent = load(spark, d, "orders").select("o_orderkey", F.col("o_custkey").alias("inherited"))
    gates.require(gates.orphans(child, parent, "o_orderkey"), "lines without an order")
    return joins.checked_join(child, parent, ["o_orderkey"], "inner", "many_to_one").select(F.col("o_orderkey").alias("l_orderkey"), "l_linenumber", "inherited")
