"""Queries over the event stream: matching in time, sessions, intervals."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from matchbook.functions import json_walk, text
from matchbook.functions.text import tier
from matchbook.operators import aggregates, joins, quantiles, windows
from matchbook.operators.joins import HOUR, micros
from matchbook.plans.registry import query, r6
from matchbook.session import load, shared_dir, stage_table
from matchbook.sources import ordinals

TIERS = ((1, "le_1h"), (3, "gt_1h_le_3h"), (12, "gt_3h_le_12h"), (24, "gt_12h_le_24h"))


def _side(spark: SparkSession, d: str, kind: str, side: str, *more: str) -> DataFrame:
    e = load(spark, d, "events").where(F.col("event_type") == kind)
    return e.select("user_id", F.col("event_id").alias(f"{side}_id"), micros("ts").alias(f"{side}_t"), *more)


_NEAREST = """
WITH l AS (SELECT event_id AS l_id, user_id, epoch_us(ts) AS l_t FROM events WHERE event_type = 'purchase'),
r AS (SELECT event_id AS r_id, user_id, epoch_us(ts) AS r_t, value FROM events WHERE event_type = 'view'),
m AS (SELECT l.*, r_id, r_t, value, row_number() OVER (PARTITION BY l_id ORDER BY abs(r_t - l_t), r_t, r_id) AS k
      FROM l LEFT JOIN r ON l.user_id = r.user_id AND abs(r_t - l_t) <= 86400000000)
"""


@query(_NEAREST + """
SELECT tier, count(*) AS n, count(DISTINCT user_id) AS users, round(median(h), 6) AS median_h FROM (
  SELECT user_id, abs(r_t - l_t) / 3.6e9 AS h,
    CASE WHEN r_t IS NULL THEN 'no_match' WHEN abs(r_t - l_t) / 3.6e9 <= 1 THEN 'le_1h' WHEN abs(r_t - l_t) / 3.6e9 <= 3 THEN 'gt_1h_le_3h'
         WHEN abs(r_t - l_t) / 3.6e9 <= 12 THEN 'gt_3h_le_12h' ELSE 'gt_12h_le_24h' END AS tier FROM m WHERE k = 1)
GROUP BY tier""")
def nearest_tier_summary(spark: SparkSession, d: str) -> DataFrame:
    """For each purchase the nearest view of the user within a day; the gaps by tier."""
    matched = joins.nearest(_side(spark, d, "purchase", "l"), _side(spark, d, "view", "r"), ["user_id"], 24 * HOUR)
    hours = F.abs(F.col("r_t") - F.col("l_t")) / 3.6e9
    # read twice: by the counts and by the medians
    tiered = stage_table(matched.select("user_id", hours.alias("h")).withColumn("tier", tier(F.col("h"), TIERS, "beyond")), "tiers")
    out = tiered.groupBy("tier").agg(F.count("*").alias("n"), F.countDistinct("user_id").alias("users"))
    return quantiles.with_quantiles(out, tiered, ["tier"], "h", {"median_h": 0.5}).withColumn("median_h", r6("median_h"))


@query(_NEAREST.replace("user_id, epoch_us(ts) AS l_t", "user_id, epoch_us(ts) AS l_t") + """,
w AS (SELECT l_id, avg(value) FILTER (WHERE abs(r_t - l_t) <= 3600000000) AS mean_1h, avg(value) FILTER (WHERE abs(r_t - l_t) <= 21600000000) AS mean_6h FROM m GROUP BY l_id)
SELECT m.l_id AS event_id, r_id, round(value, 6) AS nearest_value, round(mean_1h, 6) AS mean_1h, round(mean_6h, 6) AS mean_6h FROM m JOIN w USING (l_id) WHERE k = 1""")
def nearest_with_window_means(spark: SparkSession, d: str) -> DataFrame:
    """The nearest sample, and the means over closed windows of 1 and 6 hours around."""
    left, right = _side(spark, d, "purchase", "l"), _side(spark, d, "view", "r", "value")
    pairs = joins.candidates_in_time(left, right, ["user_id"], 24 * HOUR)
    gap = F.abs(F.col("r_t") - F.col("l_t"))
    best = F.min(F.struct(gap.alias("g"), "r_t", "r_id", "value")).alias("m")
    near = pairs.groupBy("l_id").agg(best, *[F.avg(F.when(gap <= k * HOUR, F.col("value"))).alias(f"mean_{k}h") for k in (1, 6)])
    return left.join(near, "l_id", "left").select(F.col("l_id").alias("event_id"), "m.r_id", r6("m.value").alias("nearest_value"), r6("mean_1h").alias("mean_1h"), r6("mean_6h").alias("mean_6h"))


@query(_NEAREST.rsplit("m AS", 1)[0] + """
s AS (SELECT l_id, CASE WHEN r_t < l_t THEN 'before' ELSE 'after' END AS side, r_id, r_t, l_t FROM l JOIN r ON l.user_id = r.user_id AND abs(r_t - l_t) <= 172800000000 AND r_t <> l_t),
k AS (SELECT *, row_number() OVER (PARTITION BY l_id, side ORDER BY abs(r_t - l_t), r_id) AS slot FROM s)
SELECT l_id, side, slot, r_id FROM k WHERE slot <= 2""")
def before_after_slots(spark: SparkSession, d: str) -> DataFrame:
    """The two nearest views strictly before and strictly after each purchase within 48 hours."""
    return joins.slots(_side(spark, d, "purchase", "l"), _side(spark, d, "view", "r"), ["user_id"], 48 * HOUR).select("l_id", "side", "slot", "r_id")


@query("""
WITH o AS (SELECT o_orderkey AS id, o_custkey AS c, epoch_us(o_orderdate) AS t FROM orders),
m AS (SELECT a.id, f.frame, b.id AS ref, row_number() OVER (PARTITION BY a.id, f.frame ORDER BY abs(b.t - (a.t - f.days * 86400000000)), b.t, b.id) AS k
      FROM o a CROSS JOIN (VALUES ('t90', 90::BIGINT), ('t360', 360::BIGINT)) f(frame, days)
      JOIN o b ON a.c = b.c AND abs(b.t - (a.t - f.days * 86400000000)) <= 45 * 86400000000)
SELECT o.id AS o_orderkey, max(ref) FILTER (WHERE frame = 't90' AND k = 1) AS t90, max(ref) FILTER (WHERE frame = 't360' AND k = 1) AS t360
FROM o LEFT JOIN m ON o.id = m.id GROUP BY o.id""")
def offset_asof_90_360(spark: SparkSession, d: str) -> DataFrame:
    """For each order the customer's order nearest to 90 and to 360 days before, within 45 days."""
    o = load(spark, d, "orders").select(F.col("o_custkey").alias("c"), F.col("o_orderkey").alias("r_id"), micros("o_orderdate").alias("r_t"))
    frames = F.array(*[F.struct(F.lit(n).alias("frame"), F.lit(k).alias("days")) for n, k in (("t90", 90), ("t360", 360))])
    left = o.select("c", F.col("r_id").alias("id"), "r_t", F.explode(frames).alias("f"))
    left = left.select("c", F.struct("id", "f.frame").alias("l_id"), (F.col("r_t") - F.col("f.days").cast("long") * (24 * HOUR)).alias("l_t"))
    pairs = joins.candidates_in_time(left, o, ["c"], 45 * 24 * HOUR)
    # both frames in one grouped minimum
    near = F.struct(F.abs(F.col("r_t") - F.col("l_t")), "r_t", "r_id")
    wide = pairs.groupBy(F.col("l_id.id").alias("o_orderkey")).agg(*[F.min(F.when(F.col("l_id.frame") == n, near)).getField("r_id").alias(n) for n in ("t90", "t360")])
    return o.select(F.col("r_id").alias("o_orderkey")).join(wide, "o_orderkey", "left")


@query("""
WITH l AS (SELECT event_id AS l_id, user_id, props, epoch_us(ts) AS t FROM events WHERE event_type = 'purchase'),
r AS (SELECT event_id AS r_id, user_id, props, epoch_us(ts) AS t FROM events WHERE event_type = 'click'),
p AS (SELECT l_id, r_id, 1 AS method, abs(l.t - r.t) AS gap FROM l JOIN r ON l.props = r.props AND abs(l.t - r.t) <= 86400000000
      UNION ALL SELECT l_id, r_id, 2, abs(l.t - r.t) FROM l JOIN r ON l.user_id = r.user_id AND abs(l.t - r.t) <= 86400000000),
k AS (SELECT *, row_number() OVER (PARTITION BY l_id ORDER BY method, gap, r_id) AS n FROM p)
SELECT l.l_id, r_id, CASE method WHEN 1 THEN 'exact' WHEN 2 THEN 'user' ELSE 'none' END AS method, round(gap / 3.6e9, 6) AS hours FROM l LEFT JOIN k ON l.l_id = k.l_id AND n = 1""")
def tiered_link_match(spark: SparkSession, d: str) -> DataFrame:
    """Purchases linked to clicks in time, by equal properties first, then by user."""
    left, right = _side(spark, d, "purchase", "l", "props"), _side(spark, d, "click", "r", "props")
    exact = joins.closest_in_time(left, right, ["props"], 24 * HOUR).select("l_id", "r_id", "gap", F.lit(1).alias("rank"), F.lit("exact").alias("method"))
    user = joins.closest_in_time(left, right, ["user_id"], 24 * HOUR).select("l_id", "r_id", "gap", F.lit(2).alias("rank"), F.lit("user").alias("method"))
    best = joins.best_of(exact.union(user), [F.col("rank"), F.col("gap"), F.col("r_id")], ["r_id", "method", "gap"])
    return left.join(best, "l_id", "left").select("l_id", "r_id", F.coalesce("method", F.lit("none")).alias("method"), r6(F.col("gap") / 3.6e9).alias("hours"))


_SPOT = "30 + (event_id * 7919 % 1000) / 1e2 AS la, -120 + (event_id * 104729 % 1000) / 1e2 AS lo"


def _spots(spark: SparkSession, d: str, kind: str, side: str) -> DataFrame:
    k = F.col(f"{side}_id").cast("long")
    e = _side(spark, d, kind, side, "props")
    return e.withColumns({f"{side}_lat": 30 + (k * 7919 % 1000) / 1e2, f"{side}_lon": -120 + (k * 104729 % 1000) / 1e2}).withColumn("user_id", F.when(F.col("user_id") % 3 != 0, F.col("user_id")))


@query(f"""
WITH l AS (SELECT event_id AS l_id, user_id, props, epoch_us(ts) AS t, {_SPOT} FROM events WHERE event_type = 'purchase'),
r AS (SELECT event_id AS r_id, user_id, props, epoch_us(ts) AS t, {_SPOT} FROM events WHERE event_type = 'click'),
p AS (SELECT l_id, r_id, l.props = r.props AS same, l.user_id = r.user_id AND l.user_id % 3 <> 0 AS usr, abs(l.t - r.t) AS gap,
  2 * 6371.0088 * asin(sqrt(least(1, pow(sin((radians(r.la) - radians(l.la)) / 2), 2) + cos(radians(l.la)) * cos(radians(r.la)) * pow(sin(radians(r.lo - l.lo) / 2), 2)))) AS km FROM l JOIN r ON abs(l.t - r.t) <= 10800000000),
k AS (SELECT l_id, r_id, CASE WHEN same THEN 'props' WHEN usr THEN 'user_id' ELSE 'place' END AS method, CASE WHEN same OR usr THEN 0 ELSE km END AS km, gap FROM p WHERE same OR usr OR km <= 150),
b AS (SELECT *, row_number() OVER (PARTITION BY l_id ORDER BY CASE method WHEN 'props' THEN 0 WHEN 'user_id' THEN 1 ELSE 2 END, round(km, 9), gap, r_id) AS n FROM k)
SELECT l.l_id, r_id, coalesce(method, 'unlinked') AS method, round(km, 6) AS km FROM l LEFT JOIN b ON l.l_id = b.l_id AND n = 1""")
def three_tier_links(spark: SparkSession, d: str) -> DataFrame:
    """Purchases linked to clicks within three hours: by equal properties, else by user, else by
    place within 150 km; closeness in time alone links nothing."""
    out = joins.linked_by_tiers(_spots(spark, d, "purchase", "l"), _spots(spark, d, "click", "r"), ["props", "user_id"], 3 * HOUR, 150.0)
    return out.select("l_id", "r_id", F.coalesce("method", F.lit("unlinked")).alias("method"), r6("distance").alias("km"))


@query("""
WITH l AS (SELECT event_id AS l_id, user_id, props, epoch_us(ts) AS t FROM events WHERE event_type = 'purchase'), r AS (SELECT event_id AS r_id, user_id, props, epoch_us(ts) AS t FROM events WHERE event_type = 'click')
SELECT l_id, r_id, CASE WHEN l.user_id = r.user_id AND l.props = r.props THEN 'key' ELSE 'time' END AS method FROM l JOIN r ON (l.user_id = r.user_id AND l.props = r.props) OR abs(l.t - r.t) <= 900000000""")
def same_acquisition(spark: SparkSession, d: str) -> DataFrame:
    """Purchases and clicks of the same user and properties, or within 15 minutes."""
    return joins.same_or_close(_side(spark, d, "purchase", "l", "props"), _side(spark, d, "click", "r", "props"), ["user_id", "props"], 900_000_000)


@query("SELECT event_id, epoch_us(date_trunc('second', ts)) AS t FROM events")
def offset_times(spark: SparkSession, d: str) -> DataFrame:
    """Times as text with offsets of several forms, or local without one, back to one clock."""
    e = load(spark, d, "events").select("event_id", F.date_trunc("second", F.col("ts").cast("timestamp")).alias("ts"))
    shifted = lambda minutes, form, end: F.concat(F.date_format(F.col("ts") + F.expr(f"INTERVAL {minutes} MINUTES"), form), F.lit(end))
    iso = "yyyy-MM-dd'T'HH:mm:ss"
    kind = F.col("event_id") % 5
    written = F.when(kind == 0, shifted(0, iso, "Z")).when(kind == 1, shifted(120, iso, "+02:00")).when(kind == 2, shifted(-210, "yyyy-MM-dd HH:mm:ss", "-0330")).when(kind == 3, shifted(540, iso, "+09")).otherwise(shifted(330, iso, ""))
    return e.select("event_id", F.unix_micros(text.utc_moment(written, "Asia/Kolkata")).alias("t"))


@query("""
WITH s AS (SELECT s_suppkey AS l_id, s_nationkey AS nk, 30 + (s_suppkey * 7919 % 1000) / 1e2 AS la, -120 + (s_suppkey * 104729 % 1000) / 1e2 AS lo FROM supplier),
c AS (SELECT c_custkey AS r_id, c_nationkey AS nk, 30 + (c_custkey * 7919 % 1000) / 1e2 AS la, -120 + (c_custkey * 104729 % 1000) / 1e2 AS lo FROM customer WHERE c_acctbal > 9000),
p AS (SELECT l_id, r_id, s.la AS a, s.lo AS b, c.la AS x, c.lo AS y, s.nk = c.nk AS same FROM s JOIN c ON true),
h AS (SELECT *, 2 * 6371.0088 * asin(sqrt(least(1, pow(sin((radians(x) - radians(a)) / 2), 2) + cos(radians(a)) * cos(radians(x)) * pow(sin(radians(y - b) / 2), 2)))) AS km FROM p),
u AS (SELECT l_id, r_id, km, 'primary' AS method FROM h WHERE same
      UNION ALL SELECT l_id, r_id, km, 'fallback' FROM h WHERE km <= 100 AND l_id NOT IN (SELECT l_id FROM h WHERE same)),
k AS (SELECT *, row_number() OVER (PARTITION BY l_id ORDER BY round(km, 6), r_id) AS n FROM u)
SELECT s.l_id, r_id, method, round(km, 6) AS km FROM s LEFT JOIN k ON s.l_id = k.l_id AND n = 1""")
def fallback_match(spark: SparkSession, d: str) -> DataFrame:
    """The nearest rich customer of a supplier's nation; within 100 km only where the nation has none."""
    from matchbook.plans.places import place

    s = load(spark, d, "supplier").select(F.col("s_suppkey").alias("l_id"), F.col("s_nationkey").alias("nation"), *place("s_suppkey", "l"))
    c = load(spark, d, "customer").where("c_acctbal > 9000").select(F.col("c_custkey").alias("r_id"), F.col("c_nationkey").alias("nation"), *place("c_custkey", "r"))
    from matchbook.functions.geo import haversine

    km = haversine(F.col("l_lat"), F.col("l_lon"), F.col("r_lat"), F.col("r_lon"))
    # places meet: of a nation's suppliers at one place and customers at one the first ones
    at = ["nation", "l_lat", "l_lon"]
    sites = s.groupBy(*at).agg(F.min("l_id").alias("l_id"))
    spots = c.groupBy("nation", "r_lat", "r_lon").agg(F.min("r_id").alias("r_id"))
    primary = sites.join(spots, "nation").select("l_id", "r_id", km.alias("distance"))
    without = sites.join(spots.select("nation").distinct(), "nation", "left_anti")
    near = joins.within_radius(without.drop("nation"), spots.groupBy("r_lat", "r_lon").agg(F.min("r_id").alias("r_id")), 100.0).select("l_id", "r_id", "distance")
    best = joins.best_of(joins.with_fallback(sites, primary, near), [F.round("distance", 6), F.col("r_id")], ["r_id", "method", "distance"])
    found = sites.join(best, "l_id").select(*[F.col(x).alias(f"__{x}") for x in at], "r_id", "method", "distance")
    same = F.col("nation").eqNullSafe(F.col("__nation")) & (F.col("l_lat") == F.col("__l_lat")) & (F.col("l_lon") == F.col("__l_lon"))
    return s.join(found, same, "left").select("l_id", "r_id", "method", r6("distance").alias("km"))


_SESSION = """
WITH e AS (SELECT user_id, event_type, event_id, value, epoch_us(ts) AS t FROM events),
f AS (SELECT *, CASE WHEN t - lag(t) OVER w <= 21600000000 THEN 0 ELSE 1 END AS b FROM e WINDOW w AS (PARTITION BY user_id, event_type ORDER BY t, event_id)),
s AS (SELECT *, sum(b) OVER (PARTITION BY user_id, event_type ORDER BY t, event_id) AS session FROM f)
"""


def _sessions(spark: SparkSession, d: str) -> DataFrame:
    e = load(spark, d, "events").select("user_id", "event_type", "event_id", "value", micros("ts").alias("t"))
    return windows.sessions(e, ["user_id", "event_type"], "t", 6 * HOUR, "event_id")


@query("""
WITH e AS (SELECT event_id, value, epoch_us(ts) AS t FROM events),
f AS (SELECT *, CASE WHEN t - lag(t) OVER (ORDER BY t, event_id) <= 600000000 THEN 0 ELSE 1 END AS b FROM e),
s AS (SELECT *, sum(b) OVER (ORDER BY t, event_id) AS session FROM f)
SELECT CAST(session AS BIGINT) AS session, count(*) AS n, min(t) AS start_us, max(t) AS end_us, (max(t) - min(t)) // 1000000 + 1 AS seconds, round(avg(value), 6) AS mean_value, round(median(value), 6) AS median_value FROM s GROUP BY session""")
def sessions_global(spark: SparkSession, d: str) -> DataFrame:
    """Gaps over 10 minutes cut the whole stream; a session's length counts its samples' second."""
    e = load(spark, d, "events").select("event_id", "value", micros("ts").alias("t"))
    s = stage_table(windows.sessions(e, [], "t", 600_000_000, "event_id"), "sessions")
    seconds = F.expr("(max(t) - min(t)) div 1000000 + 1")
    out = s.groupBy("session").agg(F.count("*").alias("n"), F.min("t").alias("start_us"), F.max("t").alias("end_us"), seconds.alias("seconds"), r6(F.avg("value")).alias("mean_value"))
    return quantiles.with_quantiles(out, s, ["session"], "value", {"median_value": 0.5}).withColumn("median_value", r6("median_value"))


@query(_SESSION + "SELECT user_id, event_type, CAST(session AS BIGINT) AS session, count(*) AS n, min(t) AS start_us, max(t) AS end_us FROM s GROUP BY ALL")
def sessions_keyed(spark: SparkSession, d: str) -> DataFrame:
    """Sessions per user and type; a gap of exactly 6 hours stays in."""
    return _sessions(spark, d).groupBy("user_id", "event_type", "session").agg(F.count("*").alias("n"), F.min("t").alias("start_us"), F.max("t").alias("end_us"))


@query(_SESSION + """, k AS (SELECT *, row_number() OVER (PARTITION BY user_id, event_type, session ORDER BY value DESC NULLS LAST, t, event_id) AS n FROM s)
SELECT user_id, event_type, CAST(session AS BIGINT) AS session, event_id, CASE WHEN n = 1 THEN 'kept' ELSE 'same session, lower value' END AS reason FROM k""")
def session_best_row(spark: SparkSession, d: str) -> DataFrame:
    """Each session's row of the highest value is kept, the others are given a reason."""
    s = windows.top(_sessions(spark, d), ["user_id", "event_type", "session"], [F.desc_nulls_last("value"), F.asc("t"), F.asc("event_id")], n=1 << 30)
    return s.select("user_id", "event_type", "session", "event_id", F.when(F.col("rank") == 1, "kept").otherwise("same session, lower value").alias("reason"))


_INTERVALS = _SESSION + """, i AS (SELECT user_id, event_type || ':' || session AS r_id, event_type, min(t) AS i_start, max(t) AS i_end FROM s WHERE event_type = 'view' GROUP BY user_id, event_type, session),
p AS (SELECT event_id AS l_id, user_id, t AS l_t FROM e WHERE event_type = 'click'),
g AS (SELECT p.*, r_id, greatest(0, i_start - l_t, l_t - i_end) AS gap FROM p JOIN i ON p.user_id = i.user_id AND greatest(0, i_start - l_t, l_t - i_end) <= 86400000000)
"""


def _gaps(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    s = _sessions(spark, d)
    i = s.where("event_type = 'view'").groupBy("user_id", F.concat_ws(":", "event_type", F.col("session").cast("string")).alias("r_id")).agg(F.min("t").alias("i_start"), F.max("t").alias("i_end"))
    p = load(spark, d, "events").where("event_type = 'click'").select("user_id", F.col("event_id").alias("l_id"), micros("ts").alias("l_t"))
    return p, joins.inside_intervals(p, i, ["user_id"], 24 * HOUR, 24 * HOUR)


@query(_INTERVALS + """, k AS (SELECT *, row_number() OVER (PARTITION BY l_id ORDER BY gap, r_id) AS n FROM g)
SELECT p.l_id, r_id, gap = 0 AS inside, round(gap / 3.6e9, 6) AS hours FROM p LEFT JOIN k ON p.l_id = k.l_id AND n = 1""")
def interval_inside_or_nearest(spark: SparkSession, d: str) -> DataFrame:
    """The user's view session that holds a click (closed ends), else the nearest within a day."""
    p, g = _gaps(spark, d)
    best = joins.best_of(g, [F.col("gap"), F.col("r_id")], ["r_id", "gap"])
    return p.join(best, "l_id", "left").select("l_id", "r_id", (F.col("gap") == 0).alias("inside"), r6(F.col("gap") / 3.6e9).alias("hours"))


@query(_INTERVALS + """, c AS (SELECT l_id, min(gap) AS gap, count(*) FILTER (WHERE gap = 0) AS n_inside, string_agg(r_id, ',' ORDER BY r_id) FILTER (WHERE gap <= 3600000000) AS close_ids FROM g GROUP BY l_id)
SELECT p.l_id, coalesce(n_inside, 0) AS n_inside, close_ids, CASE WHEN gap = 0 THEN 'overlap' WHEN gap <= 3600000000 THEN 'within_buffer' ELSE 'clean' END AS status FROM p LEFT JOIN c ON p.l_id = c.l_id""")
def interval_contamination(spark: SparkSession, d: str) -> DataFrame:
    """Whether a click falls into a session, within an hour of one, or is clean."""
    p, g = _gaps(spark, d)
    c = g.groupBy("l_id").agg(F.min("gap").alias("gap"), F.count_if(F.col("gap") == 0).alias("n_inside"), F.array_sort(F.collect_list(F.when(F.col("gap") <= HOUR, F.col("r_id")))).alias("close"))
    status = F.when(F.col("gap") == 0, "overlap").when(F.col("gap") <= HOUR, "within_buffer").otherwise("clean")
    return p.join(c, "l_id", "left").select("l_id", F.coalesce("n_inside", F.lit(0)).alias("n_inside"), F.when(F.size("close") > 0, F.array_join("close", ",")).alias("close_ids"), status.alias("status"))


_ALL_INTERVALS = _SESSION + """, i AS (SELECT user_id, event_type || ':' || session AS r_id, min(t) AS i_start, max(t) AS i_end FROM s GROUP BY user_id, event_type, session)
"""


def _intervals(spark: SparkSession, d: str) -> DataFrame:
    return _sessions(spark, d).groupBy("user_id", F.concat_ws(":", "event_type", F.col("session").cast("string")).alias("r_id")).agg(F.min("t").alias("i_start"), F.max("t").alias("i_end"))


@query(_ALL_INTERVALS + "SELECT p.user_id, p.r_id AS a, q.r_id AS b, least(p.i_end, q.i_end) - greatest(p.i_start, q.i_start) AS shared_us FROM i p JOIN i q ON p.user_id = q.user_id AND p.r_id < q.r_id AND p.i_start <= q.i_end AND q.i_start <= p.i_end")
def interval_overlap_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of a user's sessions of different types that share a moment; touching counts."""
    return joins.overlapping(_intervals(spark, d), ["user_id"], 24 * HOUR).select("user_id", "a", "b", F.expr("least(a_end, b_end) - greatest(a_start, b_start)").alias("shared_us"))


@query(_ALL_INTERVALS + """SELECT user_id, day, count(*) AS n, max(i_start) AS shared_start, min(i_end) AS shared_end, min(i_start) AS union_start, max(i_end) AS union_end,
  max(i_start) - min(i_start) AS start_spread, max(i_end) - min(i_end) AS end_spread, min(i_end) > max(i_start) AS overlaps
FROM (SELECT *, CAST(i_start // 86400000000 AS BIGINT) AS day FROM i) GROUP BY user_id, day""")
def interval_consensus(spark: SparkSession, d: str) -> DataFrame:
    """Sessions of a user that start on a day as claims of one interval: shared part and spreads."""
    i = _intervals(spark, d).withColumn("day", F.floor(F.col("i_start") / (24 * HOUR)))
    return aggregates.consensus(i, ["user_id", "day"])


@query("""
WITH l AS (SELECT event_id AS l_id, user_id, epoch_us(ts) AS l_t FROM events WHERE event_type = 'purchase'),
r AS (SELECT event_id AS r_id, user_id, epoch_us(ts) AS r_t, value FROM events WHERE event_type = 'view'),
b AS (SELECT l_id, r_t, value, row_number() OVER (PARTITION BY l_id ORDER BY r_t DESC, r_id) AS k FROM l JOIN r ON l.user_id = r.user_id AND r_t <= l_t AND l_t - r_t <= 86400000000),
a AS (SELECT l_id, r_t, value, row_number() OVER (PARTITION BY l_id ORDER BY r_t, r_id) AS k FROM l JOIN r ON l.user_id = r.user_id AND r_t >= l_t AND r_t - l_t <= 86400000000)
SELECT l.l_id, round(CASE WHEN a.r_t IS NULL THEN b.value WHEN b.r_t IS NULL THEN a.value WHEN a.r_t > b.r_t THEN b.value + (l_t - b.r_t) / (a.r_t - b.r_t) * (a.value - b.value) ELSE b.value END, 6) AS interpolated
FROM l LEFT JOIN b ON l.l_id = b.l_id AND b.k = 1 LEFT JOIN a ON l.l_id = a.l_id AND a.k = 1""")
def bracket_interpolate(spark: SparkSession, d: str) -> DataFrame:
    """The value between the views just before and just after a purchase, by time."""
    out = joins.bracket(_side(spark, d, "purchase", "l"), _side(spark, d, "view", "r", "value"), ["user_id"], 24 * HOUR, "value")
    return out.select("l_id", r6("interpolated").alias("interpolated"))


@query("""
WITH a AS (SELECT event_type, radians(value % 360) AS x FROM events)
SELECT event_type, round(((degrees(atan2(avg(sin(x)), avg(cos(x)))) % 360) + 360) % 360, 6) AS direction, round(sqrt(avg(sin(x)) * avg(sin(x)) + avg(cos(x)) * avg(cos(x))), 6) AS concentration FROM a GROUP BY event_type""")
def circular_mean(spark: SparkSession, d: str) -> DataFrame:
    """Mean direction of values read as angles, and how concentrated they are."""
    mean, length = aggregates.circular_mean(F.col("value") % 360)
    return load(spark, d, "events").groupBy("event_type").agg(r6(mean).alias("direction"), r6(length).alias("concentration"))


@query("SELECT epoch_us(ts) // 600000000 * 600000000 AS start_us, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def tumbling_counts(spark: SparkSession, d: str) -> DataFrame:
    """Counts per 10-minute bucket."""
    return load(spark, d, "events").groupBy(F.expr("unix_micros(cast(ts AS timestamp)) div 600000000 * 600000000").alias("start_us"), "event_type").agg(F.count("*").alias("n"))


@query("""
WITH l AS (SELECT user_id, event_id, epoch_us(ts) AS t, event_type, value FROM events)
SELECT user_id, max_by(event_id, struct_pack(t := t, e := event_id)) AS event_id, max(t) AS t FROM l GROUP BY user_id""")
def latest_state(spark: SparkSession, d: str) -> DataFrame:
    """The log's last record of each user."""
    from matchbook.operators.incremental import latest

    return latest(load(spark, d, "events").select("user_id", micros("ts").alias("t"), "event_id"), "user_id", "t").select("user_id", "event_id", "t")


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT user_id FROM events WHERE event_type = 'purchase' AND user_id IS NOT NULL)")
def pending_work(spark: SparkSession, d: str) -> DataFrame:
    """Customers without a finished (purchase) record in the log."""
    from matchbook.operators.incremental import pending

    work = load(spark, d, "customer").select("c_custkey")
    return pending(work, load(spark, d, "events").withColumnRenamed("user_id", "c_custkey"), "c_custkey", F.col("event_type") == "purchase")


_NESTED = """'{"event":' || props || ',"Tags":["' || event_type || '",{"deep":{"name":"n' || (user_id % 5) || '","none":null}},[]],"plume_source":{"LatMax":' || (event_id % 200 - 100) || ',"lon":"' || (event_id % 360 - 180) || '.5"}}'"""


def _nested(spark: SparkSession, d: str) -> DataFrame:
    return json_walk.nodes(load(spark, d, "events").select("event_id", F.expr(_NESTED).alias("doc")), "event_id", "doc")


@query(f"""
WITH n AS (SELECT event_id, t.fullkey, t.key, t.type, t.atom FROM (SELECT event_id, {_NESTED} AS doc FROM events) e, json_tree(e.doc) t),
s AS (SELECT event_id, json_extract_string(atom, '$') AS text FROM n WHERE type = 'VARCHAR' UNION ALL SELECT event_id, key FROM n WHERE key IS NOT NULL AND try_cast(key AS BIGINT) IS NULL)
SELECT event_id, text, count(*) AS n FROM s GROUP BY ALL""")
def json_strings(spark: SparkSession, d: str) -> DataFrame:
    """All strings of nested documents, keys and values, with how often they occur."""
    return json_walk.all_strings(_nested(spark, d), "event_id").groupBy("event_id", "text").agg(F.count("*").alias("n"))


@query("SELECT event_id, '/plume_source/latmax/lon' AS path, CAST(event_id % 200 - 100 AS DOUBLE) AS lat, CAST((event_id % 360 - 180) || '.5' AS DOUBLE) AS lon, 11 AS score FROM events WHERE event_id % 200 - 100 BETWEEN -90 AND 90 AND event_id % 360 - 180.5 > -180.5")
def json_coordinates(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of a latitude and a longitude anywhere in nested documents, scored by their path."""
    return json_walk.coordinate_pairs(_nested(spark, d), "event_id")


@query("SELECT event_id, epoch_us(ts) AS t, user_id FROM events WHERE NOT (event_id % 3 = 0 AND event_id % 7 = 0) UNION ALL SELECT event_id, NULL, user_id FROM events WHERE event_id % 3 = 0 AND event_id % 7 = 0")
def ordinal_repair(spark: SparkSession, d: str) -> DataFrame:
    """Every third event lost its time; it is taken by line number from a recovery file, which
    has blanks of its own, next to what another file says of the same lines."""
    e = load(spark, d, "events").select("event_id", "user_id", micros("ts").alias("t"))
    base = f"{shared_dir(spark)}/matchbook/recovery-{uuid.uuid4().hex}"
    # event ids count the rows; files and lines are in their order
    lines = e.repartitionByRange("event_id").sortWithinPartitions("event_id")
    lines.select("event_id", F.when(F.col("event_id") % 7 != 0, F.col("t")).alias("t")).write.option("header", True).csv(f"{base}/times")
    lines.select("user_id").write.option("header", True).csv(f"{base}/users")
    times = ordinals.with_ordinals(spark.read.option("header", True).schema("event_id long, t long").csv(f"{base}/times"))
    users = ordinals.with_ordinals(spark.read.option("header", True).schema("user_id long").csv(f"{base}/users"))
    lost = e.select("event_id", F.when(F.col("event_id") % 3 != 0, F.col("t")).alias("t"))
    found = ordinals.repaired(lost, "t", "event_id", times, "t", F.col("event_id") % 3 == 0)
    both = ordinals.side_by_side(times.select("ordinal", "event_id"), users)
    return found.join(both.select("event_id", "user_id"), "event_id").select("event_id", "t", "user_id")
