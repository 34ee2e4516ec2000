"""Queries over array patches: an embedding of 64 values stands for an 8 by 8 patch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from matchbook.functions import patches
from matchbook.operators import quantiles
from matchbook.plans.registry import query, r6
from matchbook.session import load

SIZE = 8
_PIXELS = """
WITH p AS (SELECT vec_id, label, unnest(range(0, 64)) AS i, unnest(embedding)::DOUBLE AS v FROM embeddings),
px AS (SELECT *, CAST(i // 8 AS INTEGER) AS r, CAST(i % 8 AS INTEGER) AS c, sqrt(pow(i // 8 - 3.5e0, 2) + pow(i % 8 - 3.5e0, 2)) AS rad, ((degrees(atan2(i % 8 - 3.5e0, 3.5e0 - i // 8)) + 360) % 360) AS dir FROM p)
"""


def _px(spark: SparkSession, d: str, *keep: str) -> DataFrame:
    return patches.pixels(load(spark, d, "embeddings"), "vec_id", "embedding", SIZE, keep)


@query(_PIXELS + "SELECT vec_id, count(v) AS n, round(avg(v), 6) AS mean, round(median(v), 6) AS median, round(stddev_pop(v), 6) AS sd, round(quantile_cont(v, 0.1), 6) AS p10, round(quantile_cont(v, 0.9), 6) AS p90 FROM px GROUP BY 1")
def patch_stats(spark: SparkSession, d: str) -> DataFrame:
    """Masked statistics of every patch."""
    out = patches.masked_stats(_px(spark, d), ["vec_id"])
    return out.select("vec_id", "n", *[r6(c).alias(c) for c in ("mean", "median", "sd", "p10", "p90")])


@query(_PIXELS + "SELECT vec_id, round(median(v) FILTER (WHERE rad <= 1.44e0), 6) AS center, round(median(v) FILTER (WHERE rad >= 2.4e0 AND rad <= 3.84e0), 6) AS ring, round(median(v) FILTER (WHERE rad <= 1.44e0) - median(v) FILTER (WHERE rad >= 2.4e0 AND rad <= 3.84e0), 6) AS contrast FROM px GROUP BY 1")
def center_ring_contrast(spark: SparkSession, d: str) -> DataFrame:
    out = patches.contrast(_px(spark, d), ["vec_id"], SIZE)
    return out.select("vec_id", *[r6(c).alias(c) for c in ("center", "ring", "contrast")])


@query(_PIXELS + """, s AS (SELECT vec_id, CAST(floor(((dir + 22.5e0) % 360) / 45) AS INTEGER) AS sector, avg(v) AS mean FROM px WHERE rad >= 1.2e0 AND rad <= 4e0 GROUP BY 1, 2)
SELECT vec_id, sector, round(mean, 6) AS mean FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY abs(mean) DESC, sector) AS k FROM s) WHERE k = 1""")
def sector_stats(spark: SparkSession, d: str) -> DataFrame:
    """The strongest of eight sectors of an annulus."""
    return patches.strongest_sector(_px(spark, d), ["vec_id"], SIZE, 0.15, 0.5).select("vec_id", "sector", r6("mean").alias("mean"))


@query(_PIXELS + """, o AS (SELECT *, abs((((dir - vec_id % 360 + 180) % 360) + 360) % 360 - 180) AS off FROM px WHERE rad >= 1.2e0 AND rad <= 4e0)
SELECT vec_id, round(avg(v) FILTER (WHERE off <= 45), 6) AS downwind, round(avg(v) FILTER (WHERE off >= 135), 6) AS upwind, round(avg(v) FILTER (WHERE off <= 45) - avg(v) FILTER (WHERE off >= 135), 6) AS contrast FROM o GROUP BY 1""")
def cone_contrast(spark: SparkSession, d: str) -> DataFrame:
    """Down- against upwind mean of each patch; its id stands for the wind's direction."""
    out = patches.cone(_px(spark, d), ["vec_id"], SIZE, (F.col("vec_id") % 360).cast("double"), 45.0, 0.15, 0.5)
    return out.select("vec_id", *[r6(c).alias(c) for c in ("downwind", "upwind", "contrast")])


@query(_PIXELS + """, u AS (SELECT label, r, c, median(v) AS usual FROM px WHERE vec_id % 2 = 0 GROUP BY ALL)
SELECT px.vec_id, count(v - usual) AS n, round(avg(v - usual), 6) AS mean_anomaly, round(max(abs(v - usual)), 6) AS largest FROM px LEFT JOIN u ON px.label = u.label AND px.r = u.r AND px.c = u.c WHERE vec_id % 2 = 1 GROUP BY 1""")
def patch_temporal_anomaly(spark: SparkSession, d: str) -> DataFrame:
    """Odd patches less the pixelwise median of the even ones of their label."""
    px = _px(spark, d, "label")
    a = patches.temporal_anomaly(px.where("vec_id % 2 = 1"), px.where("vec_id % 2 = 0"), ["label"])
    return a.groupBy("vec_id").agg(F.count("anomaly").alias("n"), r6(F.avg("anomaly")).alias("mean_anomaly"), r6(F.max(F.abs("anomaly"))).alias("largest"))


@query(_PIXELS + """, m AS (SELECT vec_id, median(v) AS m, stddev_pop(v) AS sd FROM px GROUP BY 1), a AS (SELECT px.vec_id, median(abs(v - m)) AS mad FROM px JOIN m ON px.vec_id = m.vec_id GROUP BY 1),
z AS (SELECT px.vec_id, r, c, (v - m) / CASE WHEN mad > 1e-12 THEN 1.4826e0 * mad ELSE sd END AS z FROM px JOIN m ON px.vec_id = m.vec_id JOIN a ON px.vec_id = a.vec_id)
SELECT vec_id, count(*) FILTER (WHERE z > 2) AS n_hot, round(max(z), 6) AS top FROM z GROUP BY 1""")
def robust_z_map(spark: SparkSession, d: str) -> DataFrame:
    """How many pixels stand out of each patch, and by how much at most."""
    z = patches.robust_z(_px(spark, d), ["vec_id"])
    return z.groupBy("vec_id").agg(F.count_if(F.col("z") > 2).alias("n_hot"), r6(F.max("z")).alias("top"))


@query(_PIXELS.replace("WITH p AS", "WITH RECURSIVE p AS") + """, h AS (SELECT vec_id, r, c FROM px WHERE v > 0.1e0),
w AS (SELECT vec_id, r, c, r * 8 + c AS node FROM h UNION SELECT w.vec_id, h.r, h.c, w.node FROM w JOIN h ON w.vec_id = h.vec_id AND abs(w.r - h.r) <= 1 AND abs(w.c - h.c) <= 1),
g AS (SELECT vec_id, r, c, min(node) AS region FROM w GROUP BY ALL), s AS (SELECT vec_id, region, count(*) AS n, sqrt(pow(avg(r) - 3.5e0, 2) + pow(avg(c) - 3.5e0, 2)) AS dist FROM g GROUP BY ALL)
SELECT vec_id, count(*) AS n_regions, max(n) AS largest, round(min(dist), 6) AS nearest FROM s GROUP BY 1""")
def mask_regions(spark: SparkSession, d: str) -> DataFrame:
    """Eight-connected regions of the pixels above a threshold."""
    g = patches.regions(_px(spark, d).where("v > 0.1"), "vec_id", SIZE, SIZE)
    return g.groupBy("vec_id").agg(F.count("*").alias("n_regions"), F.max("n").alias("largest"), r6(F.min("distance")).alias("nearest"))


@query(_PIXELS + """, h AS (SELECT vec_id, r, c FROM px WHERE v > 0.25e0), o AS (SELECT unnest([-1, 0, 1]) AS a), g AS (SELECT DISTINCT vec_id, r + x.a AS r, c + y.a AS c FROM h, o x, o y WHERE r + x.a BETWEEN 0 AND 7 AND c + y.a BETWEEN 0 AND 7)
SELECT vec_id, count(*) AS n FROM g GROUP BY 1""")
def dilated_mask(spark: SparkSession, d: str) -> DataFrame:
    hot = _px(spark, d).where("v > 0.25")
    return patches.dilate(hot, ["vec_id"], SIZE, SIZE).groupBy("vec_id").agg(F.count("*").alias("n"))


@query(_PIXELS + """, f AS (SELECT label, CAST(floor(rad) AS INTEGER) AS ring, avg(v) AS mean, median(v) AS median, count(*) AS n FROM px GROUP BY 1, 2) SELECT label, ring, round(mean, 6) AS mean, round(median, 6) AS median, n FROM f""")
def radial_profile(spark: SparkSession, d: str) -> DataFrame:
    """Mean and median by whole pixels from the centre, over all patches of a label."""
    px = _px(spark, d, "label").withColumn("ring", F.floor(patches.radius(SIZE)).cast("int"))
    out = px.groupBy("label", "ring").agg(r6(F.avg("v")).alias("mean"), F.count("*").alias("n"))
    return quantiles.with_quantiles(out, px, ["label", "ring"], "v", {"median": 0.5}).withColumn("median", r6("median"))


@query("""WITH h AS (SELECT vec_id, embedding[1:32] AS a, embedding[33:64] AS b FROM embeddings), z AS (SELECT vec_id, unnest(a)::DOUBLE AS x, unnest(b)::DOUBLE AS y FROM h)
SELECT vec_id, round(avg(CASE WHEN abs(x + y) > 1e-3 THEN (x - y) / (x + y) END), 6) AS nd, round(sum(x * y) / nullif(sum(x * x), 0), 6) AS c, count(*) FILTER (WHERE abs(x + y) > 1e-3) AS n FROM z GROUP BY 1""")
def band_indices(spark: SparkSession, d: str) -> DataFrame:
    """Normalised difference of two bands pixel by pixel, and the scalar between them."""
    e = load(spark, d, "embeddings").select("vec_id", *[F.expr(f"transform(slice(embedding, {s}, 32), x -> double(x))").alias(n) for n, s in (("a", 1), ("b", 33))])
    nd = e.select("vec_id", patches.band_difference(F.col("a"), F.col("b"), 1e-3).alias("nd"), "a", "b")
    flat = nd.select("vec_id", F.explode(F.arrays_zip("nd", "a", "b")).alias("p")).select("vec_id", "p.nd", F.col("p.a").alias("x"), F.col("p.b").alias("y"))
    c = patches.scalar_fit(flat, ["vec_id"], "x", "y")
    return flat.groupBy("vec_id").agg(r6(F.avg("nd")).alias("nd"), F.count("nd").alias("n")).join(c, "vec_id").select("vec_id", "nd", r6("c").alias("c"), "n")


@query(_PIXELS + """, w AS (SELECT b, i, exp(-abs(i - (b * 16 + 8)) / 4e0) AS w FROM (SELECT unnest(range(0, 4)) AS b), (SELECT unnest(range(0, 64)) AS i)), n AS (SELECT b, i, w / sum(w) OVER (PARTITION BY b) AS w FROM w)
SELECT vec_id, CAST(b AS INTEGER) AS band, round(sum(v * w), 6) AS v FROM px JOIN n ON px.i = n.i GROUP BY 1, 2""")
def spectral_response(spark: SparkSession, d: str) -> DataFrame:
    """Sixty-four channels to four bands by normalised response weights."""
    grid = spark.range(4).select(F.col("id").cast("int").alias("band")).join(spark.range(64).select(F.col("id").cast("int").alias("i")))
    raw = grid.withColumn("w", F.exp(-F.abs(F.col("i") - (F.col("band") * 16 + 8)) / 4.0))
    total = raw.groupBy("band").agg(F.sum("w").alias("total"))
    weights = F.broadcast(raw.join(total, "band").select("band", "i", (F.col("w") / F.col("total")).alias("w")))  # 256 rows
    values = load(spark, d, "embeddings").select("vec_id", F.posexplode("embedding").alias("i", "x"))
    return values.join(weights, "i").groupBy("vec_id", "band").agg(r6(F.sum(F.col("x").cast("double") * F.col("w"))).alias("v"))


@query("""WITH p AS (SELECT vec_id, embedding, CAST(abs(list_sum(embedding)) * 100 AS BIGINT) % 12 AS cls FROM embeddings), h AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(abs(x) * 60) AS INTEGER) % 12) AS s FROM p)
SELECT vec_id, round(len(list_filter(s, lambda x: x IN (8, 9))) / 64e0, 6) AS cloud, round(len(list_filter(s, lambda x: x = 3)) / 64e0, 6) AS shadow, round(len(list_filter(s, lambda x: x = 11)) / 64e0, 6) AS snow,
  len(list_filter(s, lambda x: x IN (8, 9))) / 64e0 <= 0.2e0 AND len(list_filter(s, lambda x: x = 11)) / 64e0 <= 0.05e0 AS passes FROM h""")
def scene_class_fractions(spark: SparkSession, d: str) -> DataFrame:
    """Shares of scene classes in a region, and whether they pass."""
    classes = F.transform("embedding", lambda x: F.floor(F.abs(x) * 60).cast("int") % 12)
    share = lambda *k: F.size(F.filter("s", lambda x: x.isin(*k))) / 64.0
    s = load(spark, d, "embeddings").select("vec_id", classes.alias("s"))
    return s.select("vec_id", r6(share(8, 9)).alias("cloud"), r6(share(3)).alias("shadow"), r6(share(11)).alias("snow"), ((share(8, 9) <= 0.2) & (share(11) <= 0.05)).alias("passes"))


@query("""WITH s AS (SELECT vec_id, list_avg(embedding) AS m, list_stddev_pop(embedding) AS sd, quantile_cont(abs(v), 0.99) AS p99 FROM (SELECT vec_id, embedding, unnest(embedding)::DOUBLE AS v FROM embeddings) GROUP BY ALL)
SELECT vec_id, CASE WHEN m >= 0.02 THEN 'vegetated' WHEN m >= 0.005 THEN 'mixed' WHEN sd >= 0.125 THEN 'heterogeneous' ELSE 'uniform' END AS background, CASE WHEN p99 > 0.3 THEN 10000 ELSE 1 END AS scale FROM s""")
def background_class(spark: SparkSession, d: str) -> DataFrame:
    """A class by mean and spread, and the scale that the largest values suggest."""
    s = _px(spark, d).groupBy("vec_id").agg(F.avg("v").alias("m"), F.stddev_pop("v").alias("sd"), F.expr("percentile(abs(v), 0.99)").alias("p99"))
    name = F.when(F.col("m") >= 0.02, "vegetated").when(F.col("m") >= 0.005, "mixed").when(F.col("sd") >= 0.125, "heterogeneous").otherwise("uniform")
    return s.select("vec_id", name.alias("background"), F.when(F.col("p99") > 0.3, 10000).otherwise(1).alias("scale"))


@query("""WITH p AS (SELECT vec_id, label, list_aggregate(list_transform(embedding[1:8], lambda v: CAST(CAST(floor(v::DOUBLE * 8) AS INTEGER) AS VARCHAR)), 'string_agg', ',') AS k FROM embeddings)
SELECT sha256(k) AS digest, min(vec_id) AS first_id, count(*) AS n, count(DISTINCT label) AS n_labels FROM p GROUP BY k""")
def pixel_content_groups(spark: SparkSession, d: str) -> DataFrame:
    """Patches by a digest of their first row's values in steps of an eighth: who comes first, how
    many there are, and whether they carry different labels."""
    steps = F.transform(F.slice("embedding", 1, SIZE), lambda v: F.floor(v.cast("double") * 8).cast("int").cast("string"))
    e = load(spark, d, "embeddings").select("vec_id", "label", F.sha2(F.array_join(steps, ","), 256).alias("digest"))
    return e.groupBy("digest").agg(F.min("vec_id").alias("first_id"), F.count("*").alias("n"), F.countDistinct("label").alias("n_labels"))


@query(_PIXELS + """, m AS (SELECT vec_id, v, rad / 3.5e0 AS q FROM px)
SELECT vec_id, round(avg(v) FILTER (WHERE q <= 0.15), 6) + 0 AS source, round(avg(v) FILTER (WHERE q <= 0.5), 6) + 0 AS center, round(avg(v) FILTER (WHERE q >= 0.65), 6) + 0 AS outer, count(v) FILTER (WHERE q <= 0.5) AS n_center FROM m GROUP BY 1""".replace(" AS outer", ' AS "outer"'))
def mask_means(spark: SparkSession, d: str) -> DataFrame:
    """Means of source, centre and surroundings by normalised radius."""
    out = patches.mask_means(_px(spark, d), ["vec_id"], SIZE)
    return out.select("vec_id", *[r6(c).alias(c) for c in ("source", "center", "outer")], "n_center")


@query(_PIXELS + """, b AS (SELECT vec_id, i % 16 AS px, CASE WHEN v > 0.4 THEN NULL WHEN abs(v) < 0.05 THEN 0 ELSE v END AS v FROM px),
g AS (SELECT vec_id, px, count(v) = 4 AND coalesce(bool_or(v <> 0), false) AS valid FROM b GROUP BY 1, 2) SELECT vec_id, count(*) FILTER (WHERE valid) AS n_valid FROM g GROUP BY 1""")
def valid_pixel_counts(spark: SparkSession, d: str) -> DataFrame:
    """Patches as four bands of 4 by 4: pixels with all bands finite and any not 0. Values above
    0.4 stand for missing ones, those within 0.05 of it for 0."""
    px = _px(spark, d).withColumn("at", (F.col("row") * SIZE + F.col("col")) % 16)
    v = F.when(F.col("v") > 0.4, None).when(F.abs("v") < 0.05, 0.0).otherwise(F.col("v"))
    bands = px.select("vec_id", F.floor(F.col("at") / 4).alias("row"), (F.col("at") % 4).alias("col"), v.alias("v"))
    return patches.valid_pixels(bands, ["vec_id"]).groupBy("vec_id").agg(F.count_if("valid").alias("n_valid"))


@query(_PIXELS + """, o AS (SELECT *, CASE WHEN vec_id % 7 <> 0 THEN radians(dir - vec_id % 360 - 180) END AS off FROM px),
a AS (SELECT vec_id, v, CASE WHEN abs(rad * sin(off)) <= 1.12e0 THEN rad * cos(off) END AS along FROM o)
SELECT vec_id, round(avg(v) FILTER (WHERE along BETWEEN 0.4e0 AND 3.6e0), 6) AS downwind, round(avg(v) FILTER (WHERE -along BETWEEN 0.4e0 AND 3.6e0), 6) AS upwind,
  round(avg(v) FILTER (WHERE along BETWEEN 0.4e0 AND 3.6e0) - avg(v) FILTER (WHERE -along BETWEEN 0.4e0 AND 3.6e0), 6) AS contrast FROM a GROUP BY 1""")
def wind_rectangle_contrast(spark: SparkSession, d: str) -> DataFrame:
    """Down- against upwind rectangle of each patch; its id stands for where the wind comes
    from, every seventh has none."""
    wind = F.when(F.col("vec_id") % 7 != 0, (F.col("vec_id") % 360).cast("double"))
    out = patches.wind_rectangles(_px(spark, d), ["vec_id"], SIZE, wind)
    return out.select("vec_id", *[r6(c).alias(c) for c in ("downwind", "upwind", "contrast")])


@query(_PIXELS + """, b AS (SELECT vec_id, r, quantile_cont(v * CASE WHEN vec_id % 2 = 0 THEN 5000 ELSE 1 END, 0.99) FILTER (WHERE v > 0) AS q FROM px GROUP BY 1, 2)
SELECT vec_id, round(median(q), 6) AS p99, CASE WHEN median(q) > 2 THEN 10000e0 ELSE 1e0 END AS scale FROM b GROUP BY 1""")
def inferred_scales(spark: SparkSession, d: str) -> DataFrame:
    """The scale of each patch's values; its rows stand for bands, every second is enlarged."""
    px = _px(spark, d).withColumn("v", F.col("v") * F.when(F.col("vec_id") % 2 == 0, 5000).otherwise(1))
    return patches.inferred_scale(px, ["vec_id"], "row").select("vec_id", r6("p99").alias("p99"), "scale")


@query("""
WITH px AS (SELECT vec_id, unnest(range(0, 64)) AS i, unnest(embedding)::DOUBLE AS v FROM embeddings),
p AS (SELECT vec_id, i // 8 AS r, i % 8 AS c, CASE WHEN v > 0.3 THEN NULL ELSE v END AS v FROM px),
s AS (SELECT unnest([12, 5]) AS size),
k AS (SELECT size, t, src, w FROM (SELECT size, t, unnest([lo, lo + 1]) AS src, unnest([1 - (x - lo), x - lo]) AS w FROM (SELECT *, CAST(floor(x) AS BIGINT) AS lo FROM (SELECT size, unnest(range(0, size)) AS t, unnest(range(0, size)) * 7e0 / (size - 1) AS x FROM s))) WHERE w > 0)
SELECT vec_id, a.size::INTEGER AS size, a.t::INTEGER AS row, b.t::INTEGER AS col, round(sum(a.w * b.w * v) / sum(CASE WHEN v IS NOT NULL THEN a.w * b.w END), 6) + 0 AS v
FROM p JOIN k a ON a.src = r JOIN k b ON b.src = c AND b.size = a.size GROUP BY ALL""")
def resized_patches(spark: SparkSession, d: str) -> DataFrame:
    """Patches brought to 12 and to 5 cells a side; values above 0.3 count as no data."""
    px = _px(spark, d).withColumn("v", F.when(F.col("v") <= 0.3, F.col("v")))
    sized = [patches.resize(px, ["vec_id"], SIZE, n).withColumn("size", F.lit(n)) for n in (12, 5)]
    return sized[0].unionByName(sized[1]).select("vec_id", "size", "row", "col", r6("v").alias("v"))


@query("""
WITH px AS (SELECT vec_id, unnest(range(0, 64)) AS i, unnest(embedding)::DOUBLE AS v FROM embeddings),
p AS (SELECT vec_id, i // 8 AS r, i % 8 AS c, v FROM px), w AS (SELECT *, greatest(0, least(3, vec_id % 8 - 2)) AS top, greatest(0, least(3, vec_id % 5 - 2)) AS lft FROM p),
cut AS (SELECT vec_id, r - top + 1 AS row, c - lft + 1 AS col, v FROM w WHERE r BETWEEN top AND top + 4 AND c BETWEEN lft AND lft + 4)
SELECT e.vec_id, g.row::INTEGER AS row, h.col::INTEGER AS col, round(coalesce(v, -1), 6) + 0 AS v FROM embeddings e, (SELECT unnest(range(0, 8)) AS row) g, (SELECT unnest(range(0, 8)) AS col) h LEFT JOIN cut ON cut.vec_id = e.vec_id AND cut.row = g.row AND cut.col = h.col""")
def cropped_and_padded(spark: SparkSession, d: str) -> DataFrame:
    """A window of five cells around a place that differs by patch, set into a grid of eight."""
    cut = patches.crop(_px(spark, d), SIZE, 5, F.col("vec_id") % 8, F.col("vec_id") % 5)
    return patches.pad(cut, ["vec_id"], 5, SIZE, -1.0).select("vec_id", "row", "col", r6("v").alias("v"))
