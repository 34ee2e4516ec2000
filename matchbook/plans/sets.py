"""Queries that build sets of rows: keys, combined tables, seeded draws, label gates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from matchbook.functions import text
from matchbook.operators import aggregates
from matchbook.plans.registry import query, r6
from matchbook.session import load


@query("""
WITH n AS (SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN 'Test Site ' || p_name WHEN 1 THEN p_brand || ' (Stack-' || CAST(p_size AS VARCHAR) || ')' WHEN 2 THEN ' None ' WHEN 3 THEN 'release, controlled' ELSE p_name END AS name FROM part)
SELECT p_partkey, array_to_string(list_filter(string_split(trim(regexp_replace(lower(CASE WHEN lower(trim(name)) IN ('', 'nan', 'none', '<na>') THEN '' ELSE name END), '[^a-z0-9]+', ' ', 'g')), ' '), lambda t: t NOT IN ('release', 'releases', 'stack', 'stacks', 'site', 'facility', 'controlled', 'methane', 'source', 'test', 'station')), ' ') AS site_key FROM n""")
def site_keys(spark: SparkSession, d: str) -> DataFrame:
    """Names as keys: tokens without those that say nothing about the place."""
    p = load(spark, d, "part")
    m = F.col("p_partkey") % 5
    stack = F.concat("p_brand", F.lit(" (Stack-"), F.col("p_size").cast("string"), F.lit(")"))
    name = F.when(m == 0, F.concat(F.lit("Test Site "), "p_name")).when(m == 1, stack).when(m == 2, " None ").when(m == 3, "release, controlled").otherwise(F.col("p_name"))
    return p.select("p_partkey", text.token_key(name).alias("site_key"))


@query("""
WITH w AS (SELECT o_orderkey AS k, ['release', 'no plume', 'No_Release', 'plume', 'TP', 'maybe'][1 + CAST(o_orderkey % 6 AS INTEGER)] AS t FROM orders)
SELECT k, CASE WHEN lower(t) IN ('positive', 'tp', 'plume', 'release', 'yes', 'true') THEN 1 WHEN lower(t) IN ('negative', 'tn', 'no plume', 'no_release', 'no', 'false') THEN 0 END AS label FROM w""")
def label_words(spark: SparkSession, d: str) -> DataFrame:
    """Labels from the words that tables use for them."""
    words = F.array(*map(F.lit, ("release", "no plume", "No_Release", "plume", "TP", "maybe")))
    return load(spark, d, "orders").select(F.col("o_orderkey").alias("k"), text.label(F.element_at(words, (F.col("o_orderkey") % 6 + 1).cast("int"))).alias("label"))


@query("""
WITH a AS (SELECT c_custkey AS k, CASE WHEN c_custkey % 3 <> 0 THEN c_acctbal END AS balance, c_name AS name FROM customer WHERE c_custkey % 4 <> 1),
b AS (SELECT s_suppkey AS k, s_acctbal AS balance, s_nationkey AS nation FROM supplier)
SELECT coalesce(a.k, b.k) AS k, round(coalesce(a.balance, b.balance), 6) AS balance, name, nation FROM a FULL JOIN b ON a.k = b.k""")
def combine_first(spark: SparkSession, d: str) -> DataFrame:
    """Two tables on one key: gaps of the first filled from the second."""
    a = load(spark, d, "customer").where("c_custkey % 4 <> 1").select(F.col("c_custkey").alias("k"), F.when(F.col("c_custkey") % 3 != 0, F.col("c_acctbal")).alias("balance"), F.col("c_name").alias("name"))
    b = load(spark, d, "supplier").select(F.col("s_suppkey").alias("k"), F.col("s_acctbal").alias("balance"), F.col("s_nationkey").alias("nation"))
    return aggregates.combine_first(a, b, "k").withColumn("balance", r6("balance"))


@query("""
WITH g AS (SELECT o_orderkey, o_custkey, o_orderstatus, count(*) OVER (PARTITION BY o_custkey, o_orderstatus) AS n, row_number() OVER (PARTITION BY o_custkey, o_orderstatus ORDER BY md5('7:' || CAST(o_orderkey AS VARCHAR)), o_orderkey) AS place FROM orders)
SELECT o_orderkey, o_custkey, o_orderstatus FROM g WHERE place <= least(3, greatest(n - 1, 1))""")
def seeded_group_sample(spark: SparkSession, d: str) -> DataFrame:
    """At most three orders of each customer and status, one less than there are where there
    are several, by a seeded draw."""
    n = F.count("*").over(Window.partitionBy("o_custkey", "o_orderstatus"))
    o = load(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", n.alias("n"))
    return aggregates.seeded_sample(o, ["o_custkey", "o_orderstatus"], "o_orderkey", F.least(F.lit(3), F.greatest(F.col("n") - 1, F.lit(1))), seed=7).drop("n")


@query("SELECT event_id, 'geo_' || printf('%.3f', 30 + (user_id * 7919 % 1000) / 1e2) || '_' || printf('%.3f', -120 + (user_id * 104729 % 1000) / 1e2) AS place FROM events")
def coordinate_keys(spark: SparkSession, d: str) -> DataFrame:
    """Keys of places that are given by coordinates alone."""
    lat, lon = 30 + (F.col("user_id") * 7919 % 1000) / 1e2, -120 + (F.col("user_id") * 104729 % 1000) / 1e2
    return load(spark, d, "events").select("event_id", text.coordinate_key(lat, lon).alias("place"))


@query("""
WITH w AS (SELECT p_partkey, unnest(string_split(p_type || ' ' || p_name || ' ' || p_type, ' ')) AS x, generate_subscripts(string_split(p_type || ' ' || p_name || ' ' || p_type, ' '), 1) AS i FROM part),
f AS (SELECT p_partkey, x, min(i) AS i FROM w WHERE trim(x) <> '' GROUP BY p_partkey, x)
SELECT p_partkey, string_agg(x, '|' ORDER BY i) AS words FROM f GROUP BY p_partkey""")
def ordered_words(spark: SparkSession, d: str) -> DataFrame:
    """Each word once, in the order of first places."""
    words = F.split(F.concat_ws(" ", "p_type", "p_name", "p_type"), " ")
    return load(spark, d, "part").select("p_partkey", F.array_join(text.ordered_distinct(words), "|").alias("words"))


@query("SELECT o_custkey, count(*) FILTER (WHERE o_orderkey % 2 = 1) AS n_positive, count(*) FILTER (WHERE o_orderkey % 2 = 0) AS n_negative FROM orders GROUP BY o_custkey HAVING n_positive > 0 AND n_negative > 0")
def label_conflicts(spark: SparkSession, d: str) -> DataFrame:
    """Groups in which both labels occur."""
    return aggregates.label_conflicts(load(spark, d, "orders").withColumn("label", F.col("o_orderkey") % 2), ["o_custkey"], "label")


@query("SELECT o_orderkey, round(o_totalprice - avg(o_totalprice) OVER (PARTITION BY o_custkey), 6) AS above_mean FROM orders")
def demeaned_prices(spark: SparkSession, d: str) -> DataFrame:
    """Each order's price less the mean of its customer."""
    out = aggregates.demeaned(load(spark, d, "orders").select("o_orderkey", "o_custkey", "o_totalprice"), ["o_custkey"], "o_totalprice", "above")
    return out.select("o_orderkey", r6("above").alias("above_mean"))
