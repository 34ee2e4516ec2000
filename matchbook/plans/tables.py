"""Queries over the business tables and documents: canonical tables, dedup, aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from matchbook.functions import text
from matchbook.functions.geo import log_ratio, safe_ratio
from matchbook.operators import aggregates, canonical, gates, joins, quantiles, windows
from matchbook.operators.graph import connected_components
from matchbook.plans.registry import query, r6
from matchbook.session import load

_TARGET = T.StructType().add("entity", "string").add("label", "string").add("balance", "double").add("nation", "integer").add("phone", "string").add("grade", "string")


@query("""
SELECT 'customer' AS source, CAST(c_custkey AS VARCHAR) AS entity, c_name AS label, round(c_acctbal, 6) AS balance, CAST(c_nationkey AS INTEGER) AS nation, CAST(NULL AS VARCHAR) AS phone, 'unknown' AS grade FROM customer
UNION ALL SELECT 'supplier', CAST(s_suppkey AS VARCHAR), s_name, round(s_acctbal, 6), CAST(s_nationkey AS INTEGER), NULL, 'trusted' FROM supplier
UNION ALL SELECT 'part', CAST(p_partkey AS VARCHAR), p_name, round(p_retailprice, 6), NULL, NULL, NULL FROM part""")
def canonical_union(spark: SparkSession, d: str) -> DataFrame:
    """Three tables on one schema, by aliases and defaults of their sources."""
    specs = {
        "customer": canonical.SourceSpec("customer", {"entity": ["C CustKey"], "label": ["c-name"], "balance": ["c_acctbal"], "nation": ["c_nationkey"]}, {"grade": "unknown"}),
        "supplier": canonical.SourceSpec("supplier", {"entity": ["s_suppkey"], "label": ["s_name"], "balance": ["s_acctbal"], "nation": ["s_nationkey"]}, {"grade": "trusted"}),
        "part": canonical.SourceSpec("part", {"entity": ["p_partkey"], "label": ["p_name"], "balance": ["p_retailprice"]}),
    }
    whole = canonical.union_all([canonical.canonical(load(spark, d, n), _TARGET, s) for n, s in specs.items()])
    return whole.withColumn("balance", r6("balance"))


@query("""
SELECT o_orderkey, coalesce(CASE WHEN o_totalprice > 100000 THEN o_totalprice END, CASE WHEN o_custkey % 2 = 0 THEN CAST(o_custkey AS DOUBLE) END, 0e0) AS rate,
  CASE WHEN o_totalprice > 100000 THEN 'a' WHEN o_custkey % 2 = 0 THEN 'b' ELSE 'c' END AS rate_source FROM orders""")
def coalesce_with_source(spark: SparkSession, d: str) -> DataFrame:
    """The first value present and the column it came from."""
    o = load(spark, d, "orders").select("o_orderkey", F.when(F.col("o_totalprice") > 100000, F.col("o_totalprice")).alias("a"), F.when(F.col("o_custkey") % 2 == 0, F.col("o_custkey").cast("double")).alias("b"), F.lit(0.0).alias("c"))
    value, source = text.first_present(["a", "b", "c"])
    return o.select("o_orderkey", value.alias("rate"), source.alias("rate_source"))


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, CASE WHEN CAST(json_extract(props, '$.k') AS BIGINT) >= 5 THEN 'k=' || (json_extract(props, '$.k')) || '; x=1' END AS notes, CASE WHEN CAST(json_extract(props, '$.k') AS BIGINT) >= 5 THEN CAST(json_extract(props, '$.k') AS VARCHAR) END AS noted FROM events")
def json_note_value(spark: SparkSession, d: str) -> DataFrame:
    """A value out of JSON, and one mined from a note's key=value."""
    k = F.get_json_object("props", "$.k")
    e = load(spark, d, "events").select("event_id", k.cast("long").alias("k"), F.when(k.cast("long") >= 5, F.concat(F.lit("k="), k, F.lit("; x=1"))).alias("notes"))
    return e.withColumn("noted", text.note_value(F.col("notes"), "K"))


@query("""
WITH w AS (SELECT o_orderkey AS k, ['Positive', 'tn', ' 0.0', 'nan', 'RELEASE_ON', '?', 'no', '1'][1 + CAST(o_orderkey % 8 AS INTEGER)] AS t, ['yes', 'N', 'pass', '', '0'][1 + CAST(o_orderkey % 5 AS INTEGER)] AS b, ['1.5', ' 7 ', 'nan', 'x', '-2e3'][1 + CAST(o_orderkey % 5 AS INTEGER)] AS n FROM orders)
SELECT k, CASE WHEN lower(trim(t)) IN ('positive', 'release_on', '1') THEN 1 WHEN lower(trim(t)) IN ('tn', '0.0', 'no') THEN 0 END AS label,
  lower(b) IN ('yes', 'pass') AS truthy, CASE WHEN lower(b) IN ('yes', 'pass') THEN true WHEN lower(b) IN ('n', '0') THEN false END AS flag,
  CASE WHEN trim(n) IN ('nan', 'x') THEN NULL ELSE CAST(trim(n) AS DOUBLE) END AS number FROM w""")
def parse_labels(spark: SparkSession, d: str) -> DataFrame:
    """Labels, flags and numbers from untidy text."""

    def pick(words: list[str]) -> F.Column:
        return F.element_at(F.array(*map(F.lit, words)), (F.col("o_orderkey") % len(words) + 1).cast("int"))

    t, b, n = pick(["Positive", "tn", " 0.0", "nan", "RELEASE_ON", "?", "no", "1"]), pick(["yes", "N", "pass", "", "0"]), pick(["1.5", " 7 ", "nan", "x", "-2e3"])
    return load(spark, d, "orders").select(F.col("o_orderkey").alias("k"), text.label(t).alias("label"), text.flag(b).alias("truthy"), text.flag(b, false_words=text.FALSE_WORDS).alias("flag"), text.number(n).alias("number"))


@query("""
SELECT page_id, lower(regexp_extract(url, '^[a-zA-Z]+://([^/:]+)', 1)) AS host, coalesce(nullif(trim(regexp_extract(html, '<title>([^<]*)</title>', 1)), ''), '') AS title, len(html) AS n_chars,
  trim(regexp_replace(regexp_replace(lower(url), '[^a-z0-9]+', ' ', 'g'), '\\b(the|site|test|area)\\b', '', 'g')) <> '' AS named FROM pages""")
def page_fields(spark: SparkSession, d: str) -> DataFrame:
    """Fields out of raw pages by pattern."""
    title = F.trim(F.regexp_extract("html", "<title>([^<]*)</title>", 1))
    return load(spark, d, "pages").select("page_id", F.lower(F.regexp_extract("url", "^[a-zA-Z]+://([^/:]+)", 1)).alias("host"), title.alias("title"), F.length("html").alias("n_chars"), (text.token_key(F.col("url"), ("the", "site", "test", "area")) != "").alias("named"))


_DOCS = "WITH d AS (SELECT d.*, sha1(text) AS k, l.quality, l.toxic FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)"


def _docs(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "documents").join(load(spark, d, "labels"), "doc_id", "left").withColumn("k", F.sha1("text"))


@query(_DOCS + """, r AS (SELECT k, count(*) AS n_sources, bool_or(coalesce(toxic = 1, false)) AS any_toxic, string_agg(DISTINCT source, '|' ORDER BY source) AS sources, first(lang ORDER BY doc_id) FILTER (WHERE lang IS NOT NULL) AS lang FROM d GROUP BY k),
b AS (SELECT k, quality, doc_id, row_number() OVER (PARTITION BY k ORDER BY CASE WHEN quality IS NULL THEN 0 WHEN quality = 1 THEN 2 ELSE 1 END DESC, doc_id) AS n FROM d)
SELECT 'm_' || substr(r.k, 1, 16) AS master_id, b.quality AS label, b.doc_id, r.lang, r.sources, r.any_toxic, r.n_sources FROM r JOIN b ON r.k = b.k AND b.n = 1""")
def ranked_merge(spark: SparkSession, d: str) -> DataFrame:
    """Documents with one text as one record: the label of the surest row, other fields first
    non-null, sources joined."""
    rows = _docs(spark, d).withColumn("sources", F.col("source")).withColumn("any_toxic", F.col("toxic") == 1).withColumn("label", F.col("quality"))
    rank = F.when(F.col("quality").isNull(), 0).when(F.col("quality") == 1, 2).otherwise(1)
    out = aggregates.ranked_merge(rows, "k", ["label", "doc_id"], rank, F.col("doc_id"), ["lang"], ["sources"], ["any_toxic"])
    return out.select(F.concat(F.lit("m_"), F.substring("k", 1, 16)).alias("master_id"), "label", "doc_id", "lang", "sources", "any_toxic", "n_sources")


@query("SELECT doc_id, lang, source FROM (SELECT *, row_number() OVER (PARTITION BY sha1(text) ORDER BY n_chars DESC NULLS LAST, doc_id) AS n FROM documents) WHERE n = 1")
def dedup_first_row(spark: SparkSession, d: str) -> DataFrame:
    """The first row of each text, in a declared order."""
    rows = load(spark, d, "documents").select("doc_id", "lang", "source", "n_chars", F.sha1("text").alias("k"))
    return windows.top(rows, ["k"], [F.desc_nulls_last("n_chars"), F.asc("doc_id")]).select("doc_id", "lang", "source")


@query("""
WITH e AS (SELECT user_id, event_id, CASE WHEN event_id % 3 = 0 THEN value END AS v, CASE WHEN event_id % 4 = 0 THEN event_type END AS t FROM events)
SELECT user_id, round(first(v ORDER BY event_id) FILTER (WHERE v IS NOT NULL), 6) AS first_v, first(t ORDER BY event_id) FILTER (WHERE t IS NOT NULL) AS first_t, first(event_id ORDER BY event_id) AS first_row FROM e GROUP BY user_id""")
def first_non_null(spark: SparkSession, d: str) -> DataFrame:
    """The first non-null value of each column is not the first row."""
    e = load(spark, d, "events").select("user_id", "event_id", F.when(F.col("event_id") % 3 == 0, F.col("value")).alias("v"), F.when(F.col("event_id") % 4 == 0, F.col("event_type")).alias("t"))
    order = [F.col("event_id")]
    return e.groupBy("user_id").agg(r6(aggregates.first_value("v", order)).alias("first_v"), aggregates.first_value("t", order, blank=True).alias("first_t"), F.min("event_id").alias("first_row"))


@query("SELECT lang, string_agg(DISTINCT source, '|' ORDER BY source) AS sources, count(DISTINCT source) AS n FROM documents GROUP BY lang")
def join_unique_values(spark: SparkSession, d: str) -> DataFrame:
    """Distinct values of a group, joined; parts of already joined texts count each."""
    return load(spark, d, "documents").groupBy("lang").agg(aggregates.joined_values("source").alias("sources"), F.countDistinct("source").alias("n"))


@query(_DOCS + "SELECT k AS content, count(*) AS n, count(DISTINCT source) AS n_sources, count(DISTINCT quality) > 1 AS mixed_label FROM d GROUP BY k HAVING count(*) > 1")
def duplicate_content_groups(spark: SparkSession, d: str) -> DataFrame:
    """Texts that occur more than once, and whether their labels disagree."""
    g = _docs(spark, d).groupBy(F.col("k").alias("content")).agg(F.count("*").alias("n"), F.countDistinct("source").alias("n_sources"), F.countDistinct("quality").alias("q"))
    return g.where("n > 1").select("content", "n", "n_sources", (F.col("q") > 1).alias("mixed_label"))


@query("WITH d AS (SELECT doc_id, min(doc_id) OVER (PARTITION BY sha1(text)) AS component, count(*) OVER (PARTITION BY sha1(text)) AS n FROM documents) SELECT doc_id, component, n AS n_members FROM d WHERE n > 1")
def duplicate_components(spark: SparkSession, d: str) -> DataFrame:
    """Components of the graph whose links join each copy to the one before it."""
    rows = load(spark, d, "documents").select("doc_id", F.sha1("text").alias("k"))
    links = rows.withColumn("prev", F.lag("doc_id").over(Window.partitionBy("k").orderBy("doc_id"))).where("prev IS NOT NULL").select(F.col("prev").alias("a"), F.col("doc_id").alias("b"))
    c = connected_components(links)
    return c.join(c.groupBy("component").agg(F.count("*").alias("n_members")), "component").select(F.col("node").alias("doc_id"), "component", "n_members")


@query("SELECT coalesce(CASE WHEN grouping(o_orderstatus) = 1 THEN 'All' ELSE o_orderstatus END, '') AS o_orderstatus, CASE WHEN grouping(o_orderpriority) = 1 THEN 'All' ELSE o_orderpriority END AS o_orderpriority, count(*) AS n FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)")
def crosstab_margins(spark: SparkSession, d: str) -> DataFrame:
    """Two-way counts with totals of rows, columns and all."""
    return aggregates.crosstab(load(spark, d, "orders"), "o_orderstatus", "o_orderpriority")


@query("SELECT o_orderpriority, count(*) FILTER (WHERE o_orderstatus = 'F') AS F, count(*) FILTER (WHERE o_orderstatus = 'O') AS O, count(*) FILTER (WHERE o_orderstatus = 'P') AS P, count(*) FILTER (WHERE o_orderstatus = 'X') AS X FROM orders GROUP BY 1")
def unstack_zero_fill(spark: SparkSession, d: str) -> DataFrame:
    """Counts as columns of a fixed domain, zeros where nothing is."""
    return load(spark, d, "orders").groupBy("o_orderpriority").pivot("o_orderstatus", ["F", "O", "P", "X"]).count().na.fill(0)


@query("SELECT t AS event_type, count(event_id) AS n FROM (VALUES ('view'), ('click'), ('purchase'), ('refund')) v(t) LEFT JOIN events ON event_type = t GROUP BY t")
def fixed_domain_counts(spark: SparkSession, d: str) -> DataFrame:
    return aggregates.domain_counts(load(spark, d, "events"), "event_type", ["view", "click", "purchase", "refund"])


@query("SELECT event_type, count(*) AS n, count(DISTINCT user_id) AS users, round(100 * count(*) / sum(count(*)) OVER (), 6) AS percent FROM events GROUP BY event_type")
def value_counts(spark: SparkSession, d: str) -> DataFrame:
    """Counts of each value and their share of all."""
    g = load(spark, d, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.countDistinct("user_id").alias("users"))
    total = g.agg(F.sum("n").alias("total"))
    return g.join(F.broadcast(total)).select("event_type", "n", "users", r6(100 * F.col("n") / F.col("total")).alias("percent"))  # one row


@query("SELECT l_returnflag, count(l_extendedprice) AS n, round(avg(l_extendedprice), 6) AS mean, round(stddev_samp(l_extendedprice), 6) AS sd, round(min(l_extendedprice), 6) AS min, round(quantile_cont(l_extendedprice, 0.25), 6) AS p25, round(quantile_cont(l_extendedprice, 0.5), 6) AS p50, round(quantile_cont(l_extendedprice, 0.75), 6) AS p75, round(max(l_extendedprice), 6) AS max FROM lineitem GROUP BY 1")
def describe_exact(spark: SparkSession, d: str) -> DataFrame:
    out = aggregates.describe(load(spark, d, "lineitem"), ["l_returnflag"], "l_extendedprice")
    return out.select("l_returnflag", "n", *[r6(c).alias(c) for c in ("mean", "sd", "min", "p25", "p50", "p75", "max")])


@query("""
WITH m AS (SELECT l_suppkey, median(l_extendedprice) AS med, quantile_cont(l_extendedprice, 0.75) - quantile_cont(l_extendedprice, 0.25) AS iqr, stddev_samp(l_extendedprice) AS sd FROM lineitem GROUP BY 1),
a AS (SELECT l.l_suppkey, median(abs(l_extendedprice - med)) AS mad FROM lineitem l JOIN m ON l.l_suppkey = m.l_suppkey GROUP BY 1)
SELECT m.l_suppkey, round(med, 6) AS median, round(mad, 6) AS mad, round(coalesce(CASE WHEN 1.4826 * mad > 1e-12 THEN 1.4826 * mad END, CASE WHEN iqr / 1.349 > 1e-12 THEN iqr / 1.349 END, CASE WHEN sd > 1e-12 THEN sd END, 1), 6) AS scale FROM m JOIN a ON m.l_suppkey = a.l_suppkey""")
def robust_scale_by_group(spark: SparkSession, d: str) -> DataFrame:
    out = aggregates.robust_scale(load(spark, d, "lineitem"), ["l_suppkey"], "l_extendedprice")
    return out.select("l_suppkey", r6("median").alias("median"), r6("mad").alias("mad"), r6("scale").alias("scale"))


@query("SELECT l_shipmode_key, count(*) AS n, round(avg(l_quantity), 6) AS mean, round(median(l_quantity), 6) AS median, round(stddev_pop(l_quantity), 6) AS sd, round(quantile_cont(l_quantity, 0.1), 6) AS p10, round(quantile_cont(l_quantity, 0.9), 6) AS p90, min(l_quantity) AS min, max(l_quantity) AS max FROM (SELECT *, l_linestatus || l_returnflag AS l_shipmode_key FROM lineitem) GROUP BY 1")
def multi_reducer(spark: SparkSession, d: str) -> DataFrame:
    """Many reducers in one pass."""
    rows = load(spark, d, "lineitem").select(F.concat("l_linestatus", "l_returnflag").alias("l_shipmode_key"), "l_quantity")
    out = rows.groupBy("l_shipmode_key").agg(F.count("*").alias("n"), r6(F.avg("l_quantity")).alias("mean"), r6(F.stddev_pop("l_quantity")).alias("sd"), F.min("l_quantity").alias("min"), F.max("l_quantity").alias("max"))
    q = {"median": 0.5, "p10": 0.1, "p90": 0.9}
    return quantiles.with_quantiles(out, rows, ["l_shipmode_key"], "l_quantity", q).withColumns({c: r6(c) for c in q})


@query("SELECT o_custkey, epoch_us(make_timestamp(CAST(median(epoch_us(o_orderdate)) AS BIGINT))) AS median_us, mode_status FROM (SELECT *, first_value(o_orderstatus) OVER (PARTITION BY o_custkey ORDER BY c DESC, o_orderstatus) AS mode_status FROM (SELECT *, count(*) OVER (PARTITION BY o_custkey, o_orderstatus) AS c FROM orders)) GROUP BY o_custkey, mode_status")
def median_time_and_mode(spark: SparkSession, d: str) -> DataFrame:
    """Median of timestamps, and the most common value (ties: the first)."""
    o = load(spark, d, "orders")
    times = quantiles.quantiles(o, ["o_custkey"], F.unix_micros(F.col("o_orderdate").cast("timestamp")), [0.5])
    times = o.select("o_custkey").distinct().join(times, "o_custkey", "left").select("o_custkey", F.round(F.col("q")[0]).cast("long").alias("median_us"))
    common = o.groupBy("o_custkey", "o_orderstatus").count().groupBy("o_custkey").agg(F.min(F.struct((-F.col("count")).alias("c"), "o_orderstatus")).alias("m"))
    return times.join(common.select("o_custkey", F.col("m.o_orderstatus").alias("mode_status")), "o_custkey")


@query("""SELECT l_orderkey, l_linenumber, round(CASE WHEN abs(l_discount) > 1e-12 THEN l_tax / l_discount END, 6) AS ratio, round(CASE WHEN abs(l_tax + l_discount) > 1e-12 THEN (l_tax - l_discount) / (l_tax + l_discount) END, 6) AS nd,
  round(CASE WHEN l_tax > 0 AND l_discount > 0 THEN ln(l_tax / l_discount) END, 6) AS lr, CASE WHEN l_quantity > 0 AND l_quantity <= 10 THEN 'low' WHEN l_quantity > 10 AND l_quantity <= 30 THEN 'mid' WHEN l_quantity > 30 AND l_quantity <= 50 THEN 'high' END AS right_bin,
  CASE WHEN l_quantity >= 0 AND l_quantity < 10 THEN 'low' WHEN l_quantity >= 10 AND l_quantity < 30 THEN 'mid' WHEN l_quantity >= 30 AND l_quantity < 50 THEN 'high' END AS left_bin,
  concat_ws(' + ', CASE WHEN l_quantity > 40 THEN 'large' END, CASE WHEN l_discount = 0 THEN 'no discount' END, CASE WHEN l_returnflag = 'R' THEN 'returned' END) AS reasons,
  CASE WHEN l_returnflag = 'R' THEN 'REJECT' WHEN l_discount > 0.05 THEN 'STRONG' ELSE 'WEAK' END AS class FROM lineitem""")
def guarded_columns(spark: SparkSession, d: str) -> DataFrame:
    """Guarded ratios, bins closed on either side, joined reasons and an ordered classifier."""
    t, s, q = F.col("l_tax"), F.col("l_discount"), F.col("l_quantity")
    edges, names = [0, 10, 30, 50], ["low", "mid", "high"]
    nd = safe_ratio(t - s, t + s)
    rules = [(q > 40, "large"), (s == 0, "no discount"), (F.col("l_returnflag") == "R", "returned")]
    return load(spark, d, "lineitem").select("l_orderkey", "l_linenumber", r6(safe_ratio(t, s)).alias("ratio"), r6(nd).alias("nd"), r6(log_ratio(t, s)).alias("lr"), text.binned(q, edges, names).alias("right_bin"), text.binned(q, edges, names, "left").alias("left_bin"), text.all_reasons(rules).alias("reasons"), text.first_reason([(F.col("l_returnflag") == "R", "REJECT"), (s > 0.05, "STRONG")], "WEAK").alias("class"))


@query("""
SELECT o_orderkey FROM orders WHERE regexp_matches(lower(o_orderpriority), 'urgent|high') AND strftime(o_orderdate, '%H:%M:%S') = '00:00:00' AND o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_quantity BETWEEN 45 AND 50)
  AND o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0) AND ((o_orderdate >= TIMESTAMP '1995-01-01' AND o_orderdate < TIMESTAMP '1996-01-01' AND o_orderstatus = 'F') OR (o_orderdate >= TIMESTAMP '1997-01-01' AND o_orderdate < TIMESTAMP '1998-01-01'))""")
def keyword_window_filter(spark: SparkSession, d: str) -> DataFrame:
    """Keywords, time of day, semi and anti joins, and half-open windows by case."""
    o = load(spark, d, "orders").where(text.contains_any(F.col("o_orderpriority"), ["urgent", "high"]) & (F.date_format("o_orderdate", "HH:mm:ss") == "00:00:00"))
    in_case = F.expr("(o_orderdate >= timestamp_ntz'1995-01-01' AND o_orderdate < timestamp_ntz'1996-01-01' AND o_orderstatus = 'F') OR (o_orderdate >= timestamp_ntz'1997-01-01' AND o_orderdate < timestamp_ntz'1998-01-01')")
    large = load(spark, d, "lineitem").where(F.col("l_quantity").between(45, 50)).select(F.col("l_orderkey").alias("o_orderkey"))
    poor = load(spark, d, "customer").where("c_acctbal < 0").select(F.col("c_custkey").alias("o_custkey"))
    return o.where(in_case).join(large, "o_orderkey", "left_semi").join(poor, "o_custkey", "left_anti").select("o_orderkey")


@query("SELECT 'CR_INTERVAL_' || lpad(CAST(row_number() OVER (ORDER BY o_orderdate, o_orderkey) AS VARCHAR), 6, '0') AS id, o_orderkey FROM orders")
def ordinal_ids(spark: SparkSession, d: str) -> DataFrame:
    """Padded ordinals after a global sort, without a single task."""
    o = load(spark, d, "orders").select("o_orderkey", "o_orderdate")
    return canonical.ordinal_ids(o, "CR_INTERVAL_", [F.col("o_orderdate"), F.col("o_orderkey")]).select("id", "o_orderkey")


@query("SELECT 'orders' AS side, count(*) AS n, count(DISTINCT o_custkey) AS keys FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer) UNION ALL SELECT 'customers', count(*), count(DISTINCT c_custkey) FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
def unmatched_keys(spark: SparkSession, d: str) -> DataFrame:
    """Rows of either side that find no partner."""
    o = load(spark, d, "orders").select(F.col("o_custkey").alias("k"))
    c = load(spark, d, "customer").select(F.col("c_custkey").alias("k"))
    count = lambda rows, name: rows.agg(F.lit(name).alias("side"), F.count("*").alias("n"), F.countDistinct("k").alias("keys"))
    return count(gates.orphans(o, c, "k"), "orders").union(count(gates.orphans(c, o, "k"), "customers"))


@query("SELECT sha1(text) AS k, count(*) AS n FROM documents GROUP BY 1 HAVING count(*) > 1")
def cardinality_violations(spark: SparkSession, d: str) -> DataFrame:
    """Keys that break a one-to-one contract."""
    return gates.repeated_keys(load(spark, d, "documents").select(F.sha1("text").alias("k")), ["k"])


@query("SELECT o_custkey, count(*) FILTER (WHERE o_orderstatus = 'F') AS n_F, count(*) FILTER (WHERE o_orderstatus = 'O') AS n_O FROM orders GROUP BY 1 HAVING n_F <> 1 OR n_O <> 4")
def quota_violations(spark: SparkSession, d: str) -> DataFrame:
    """Groups without exactly one F and four O."""
    return gates.wrong_counts(load(spark, d, "orders"), ["o_custkey"], "o_orderstatus", {"F": 1, "O": 4})


@query("SELECT n_name, r_name, count(c_custkey) AS n, round(sum(c_acctbal), 6) AS balance FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ALL")
def checked_lookup(spark: SparkSession, d: str) -> DataFrame:
    """Many-to-one lookups whose contract is checked before they run."""
    n = load(spark, d, "nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_name", F.col("n_regionkey").alias("r_regionkey"))
    r = load(spark, d, "region").select("r_regionkey", "r_name")
    full = joins.checked_join(load(spark, d, "customer"), joins.checked_join(n, r, ["r_regionkey"], "inner", "many_to_one"), ["c_nationkey"], "inner", "many_to_one")
    return full.groupBy("n_name", "r_name").agg(F.count("c_custkey").alias("n"), r6(F.sum("c_acctbal")).alias("balance"))


@query("SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier WHERE s_acctbal > 9000")
def key_intersection(spark: SparkSession, d: str) -> DataFrame:
    """Key values that two sets share."""
    s = load(spark, d, "supplier").where("s_acctbal > 9000").select(F.col("s_nationkey").alias("k"))
    return gates.shared(load(spark, d, "customer").select(F.col("c_nationkey").alias("k")), s, "k")


@query("SELECT c_nationkey AS k FROM customer EXCEPT SELECT s_nationkey FROM supplier WHERE s_acctbal > 5000")
def key_difference(spark: SparkSession, d: str) -> DataFrame:
    s = load(spark, d, "supplier").where("s_acctbal > 5000").select(F.col("s_nationkey").alias("k"))
    return load(spark, d, "customer").select(F.col("c_nationkey").alias("k")).subtract(s)
