"""Queries over sources, sinks and streams."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from matchbook.functions import text
from matchbook.operators import canonical, gates, incremental
from matchbook.operators.joins import micros
from matchbook.plans.registry import query, r6
from matchbook.session import TABLES, load, shared_dir
from matchbook.sources import readers, sinks
from matchbook.streaming import jobs


def _folder(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/matchbook/{name}-{uuid.uuid4().hex}"


@query("SELECT s_suppkey, s_name, s_nationkey, round(s_acctbal, 6) AS s_acctbal FROM supplier")
def delimited_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Suppliers written with semicolons; the separator is found again, types are cast."""
    path = _folder(spark, "delimited")
    sinks.write_delimited(load(spark, d, "supplier").select("s_suppkey", "s_name", "s_nationkey", "s_acctbal"), path, ";")
    t = readers.read_delimited(spark, path)
    return t.select(F.col("s_suppkey").cast("long").alias("s_suppkey"), "s_name", F.col("s_nationkey").cast("long").alias("s_nationkey"), r6(F.col("s_acctbal").cast("double")).alias("s_acctbal"))


@query("SELECT event_id, user_id, epoch_us(ts) AS t FROM events WHERE event_type = 'purchase'")
def json_log_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """An append-only log of JSON lines, read by a schema, bad lines left out."""
    path = _folder(spark, "log")
    e = load(spark, d, "events").where("event_type = 'purchase'").select("event_id", "user_id", micros("ts").alias("t"))
    sinks.write_json_lines(e.where("event_id % 2 = 0"), path)
    sinks.write_json_lines(e.where("event_id % 2 = 1"), path, append=True)
    schema = T.StructType().add("event_id", "long").add("user_id", "long").add("t", "long")
    return readers.read_catalog(spark, path, schema).select("event_id", "user_id", "t")


@query("""SELECT 'events' AS "table", count(*) AS n_rows, round(3 * avg(CAST(ts IS NOT NULL AS INT)) + 2 * avg(CAST(event_id IS NOT NULL OR user_id IS NOT NULL AS INT)) + avg(CAST(value IS NOT NULL AS INT)), 6) AS score FROM events
UNION ALL SELECT 'orders', count(*), round(3 * avg(CAST(o_orderdate IS NOT NULL AS INT)) + 2 * avg(CAST(o_orderkey IS NOT NULL OR o_custkey IS NOT NULL AS INT)), 6) FROM orders""")
def scored_sources(spark: SparkSession, d: str) -> DataFrame:
    """Tables that hold observations, by how well the columns that look like such are filled."""
    tables = {n: load(spark, d, n) for n in TABLES}
    out = readers.score_filled(tables, {"time": (r"^ts$|orderdate", 3), "key": (r"_id$|key$", 2), "value": (r"^value$", 1)}, 4.5)
    return out.select("table", "n_rows", r6("score").alias("score"))


@query("""WITH l AS (SELECT s_nationkey AS nation, s_suppkey, s_suppkey || ',' || s_name AS line FROM supplier),
f AS (SELECT nation, string_agg(line || chr(10), '' ORDER BY s_suppkey) AS content, count(*) AS n_rows FROM l GROUP BY nation)
SELECT nation, strlen(content)::BIGINT AS length, sha256(content) AS sha256, n_rows FROM f""")
def release_manifest(spark: SparkSession, d: str) -> DataFrame:
    """A release of a file of suppliers a nation: each file's length, digest and lines, once its
    counts have passed the gate."""
    path = _folder(spark, "release")
    s = load(spark, d, "supplier").select(F.col("s_nationkey").alias("nation"), "s_suppkey", F.concat_ws(",", F.col("s_suppkey").cast("string"), "s_name").alias("line"))
    s.repartition("nation").sortWithinPartitions("nation", "s_suppkey").select("nation", "line").write.partitionBy("nation").text(path)
    manifest = sinks.counted_manifest(spark, path, "*.txt").withColumn("nation", F.regexp_extract("part", "(\\d+)$", 1).cast("long"))
    gates.require(sinks.wrong_file_counts(manifest, s.groupBy("nation").agg(F.count("*").alias("n")), "nation"), "rows of a release")
    return manifest.select("nation", "length", "sha256", "n_rows")


@query("""SELECT CASE WHEN event_type IN ('view', 'click', 'purchase') AND user_id % 11 <> 0 THEN event_type ELSE 'unrouted' END AS route,
  CASE WHEN user_id % 11 = 0 THEN 'no route' WHEN event_type NOT IN ('view', 'click', 'purchase') THEN 'unknown route ' || event_type WHEN value > 20 THEN 'large' ELSE 'usual' END AS reason, event_id FROM events""")
def routed_events(spark: SparkSession, d: str) -> DataFrame:
    """Events written in one pass to a folder a route, each with the reason, and read again."""
    path = _folder(spark, "routed")
    e = load(spark, d, "events").select("event_id", "value", F.when(F.col("user_id") % 11 != 0, F.col("event_type")).alias("kind"))
    sinks.write_routed(e, "kind", ["view", "click", "purchase"], path, F.when(F.col("value") > 20, "large").otherwise("usual"))
    return spark.read.parquet(path).select("route", "reason", "event_id")


@query("""WITH f AS (SELECT *, CASE WHEN ts - lag(ts) OVER w <= INTERVAL 6 HOURS THEN 0 ELSE 1 END AS b FROM events WINDOW w AS (PARTITION BY user_id, event_type ORDER BY ts, event_id)),
s AS (SELECT *, sum(b) OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS k FROM f)
SELECT user_id, event_type, epoch_us(min(ts)) AS start_us, epoch_us(max(ts)) AS last_us, count(*) AS n FROM s GROUP BY user_id, event_type, k""")
def stream_sessions(spark: SparkSession, d: str) -> DataFrame:
    """Extension: sessions as a streaming job over the event files."""
    stream = jobs.event_stream(spark, d, load(spark, d, "events").schema)
    out = jobs.run_once(jobs.session_counts(stream))
    return out.select("user_id", "event_type", F.unix_micros("start").alias("start_us"), F.unix_micros("last").alias("last_us"), "n")


@query("SELECT epoch_us(ts) // 600000000 * 600000000 AS start_us, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def stream_buckets(spark: SparkSession, d: str) -> DataFrame:
    """Extension: 10-minute counts as a streaming job."""
    out = jobs.run_once(jobs.bucket_counts(jobs.event_stream(spark, d, load(spark, d, "events").schema)))
    return out.select(F.unix_micros("start").alias("start_us"), "event_type", "n")


@query("SELECT event_id, user_id, epoch_us(ts) AS t FROM events")
def stream_distinct(spark: SparkSession, d: str) -> DataFrame:
    """Extension: first of repeated events within a watermark."""
    out = jobs.run_once(jobs.distinct_events(jobs.event_stream(spark, d, load(spark, d, "events").schema)), "append")
    return out.select("event_id", "user_id", F.unix_micros("ts").alias("t"))


@query("SELECT c_custkey, round(CASE WHEN c_custkey % 4 <> 0 THEN c_acctbal END, 6) AS longitude, round(CASE WHEN c_custkey % 4 <> 0 THEN c_nationkey END, 6) AS latitude FROM customer")
def geojson_features(spark: SparkSession, d: str) -> DataFrame:
    """Customers as GeoJSON collections, read back a row a feature; every fourth is a line and has
    no point."""
    path = _folder(spark, "geojson")
    c = load(spark, d, "customer")
    kind = F.when(F.col("c_custkey") % 4 != 0, "Point").otherwise("LineString")
    at = F.when(F.col("c_custkey") % 4 != 0, F.format_string("[%s, %s]", "c_acctbal", "c_nationkey")).otherwise("[[0, 0], [1, 1]]")
    feature = F.format_string('{"type": "Feature", "properties": {"c_custkey": %s}, "geometry": {"type": "%s", "coordinates": %s}}', "c_custkey", kind, at)
    # collections of some two thousand features however many there are, a file each
    n = max(8, -(-c.count() // 2000))
    held = c.groupBy(F.pmod(F.xxhash64("c_custkey"), F.lit(n)).alias("k")).agg(F.concat(F.lit('{"type": "FeatureCollection", "features": ['), F.array_join(F.collect_list(feature), ","), F.lit("]}")).alias("text"))
    held.repartition("k").select("text").write.option("maxRecordsPerFile", 1).text(path)
    out = readers.read_geojson(spark, path, T.StructType().add("c_custkey", "long"))
    return out.select("c_custkey", r6("longitude").alias("longitude"), r6("latitude").alias("latitude"))


@query("SELECT o_orderkey, o_custkey, o_orderstatus AS order_status, epoch_us(o_orderdate) AS placed_us, round(o_totalprice, 6) AS price FROM orders")
def nested_json_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Orders as nested JSON, flattened, brought under tidy names, the time taken from the best of
    the columns that might hold it, and its columns found by words."""
    path = _folder(spark, "nested")
    o = load(spark, d, "orders")
    nested = o.select(F.struct(F.col("o_orderkey").alias("Order Key"), F.struct(F.col("o_custkey").alias("Cust-Key")).alias("who")).alias("ids"), F.struct(F.lit("n/a").alias("Date Note"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("UTC date")).alias("at"), F.col("o_orderstatus").alias("Order  Status"), F.col("o_totalprice").cast("double").alias("Total (price)"))
    sinks.write_json_lines(nested, path)
    t = canonical.tidy(readers.read_nested(readers.read_json_any(spark, path, nested.schema)))
    price, status = canonical.find_column(t.columns, ["price"]), canonical.first_column(t.columns, ["state", "order status"])
    return t.select(F.col("ids_order_key").alias("o_orderkey"), F.col("ids_who_cust_key").alias("o_custkey"), F.col(status).alias("order_status"), F.unix_micros(canonical.best_time_column(t)).alias("placed_us"), r6(price).alias("price"))


@query("""SELECT p_partkey, 'part_' || substr(sha1(p_name), 1, 16) AS content_id, CASE WHEN contains(lower(p_name), 'red') THEN 'warm' WHEN contains(lower(p_name), 'blue') THEN 'cold' ELSE p_name END AS tone,
  CASE WHEN p_size > 25 THEN p_size END AS value, CASE WHEN p_size > 25 THEN NULL ELSE 'too small' END AS error, CASE WHEN p_partkey % 3 <> 0 THEN 'scan/' || p_partkey % 3 || '.txt' END AS named, p_partkey % 3 = 1 AS found FROM part""")
def identified_parts(spark: SparkSession, d: str) -> DataFrame:
    """Ids from contents, synonyms, values kept with the reason why they are missing, and whether
    the file that a row names is among those there are."""
    path = _folder(spark, "scan")
    # one file of the two that rows name
    load(spark, d, "part").select(F.lit("x").alias("x")).limit(1).write.text(f"{path}/1.txt")
    files = readers.inventory(spark, path).select(F.regexp_extract("path", "(.*/[0-9]+\\.txt)/", 1).alias("path")).distinct()
    p = load(spark, d, "part").select("p_partkey", "p_name", "p_size", F.when(F.col("p_partkey") % 3 != 0, F.concat(F.lit("scan/"), (F.col("p_partkey") % 3).cast("string"), F.lit(".txt"))).alias("named"))
    got = incremental.with_error(F.when(F.col("p_size") > 25, F.col("p_size")), "value", "too small")
    out = readers.resolve(p, files, "named")
    return out.select("p_partkey", text.content_id("part_", F.col("p_name")).alias("content_id"), text.synonym(F.col("p_name"), [("red", "warm"), ("blue", "cold")]).alias("tone"), got.getField("value").alias("value"), got.getField("error").alias("error"), "named", "found")
