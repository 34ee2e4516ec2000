"""Dense patches as pixel rows (patch, row, col, v) and the statistics over them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def pixels(patches: DataFrame, id_col: str, array: str, width: int, keep: Sequence[str] = ()) -> DataFrame:
    """id, keep, row, col, v: a row a pixel of a flattened patch; NaN and infinity are null."""
    rows = patches.select(id_col, *keep, F.posexplode(array).alias("p", "x"))
    v = F.col("x").cast("double")
    return rows.select(id_col, *keep, F.floor(F.col("p") / width).cast("int").alias("row"), (F.col("p") % width).alias("col"), F.when(~F.isnan(v) & (F.abs(v) < float("inf")), v).alias("v"))


def radius(size: int) -> Column:
    """Distance of a pixel from the patch centre, in pixels."""
    mid = (size - 1) / 2
    return F.sqrt(F.pow(F.col("row") - mid, 2) + F.pow(F.col("col") - mid, 2))


def direction(size: int) -> Column:
    """Compass bearing of a pixel from the centre (row 0 is north), 0 to 360."""
    mid = (size - 1) / 2
    return F.pmod(F.degrees(F.atan2(F.col("col") - mid, mid - F.col("row"))) + 360, F.lit(360.0))


def zone(size: int, bounds: Sequence[tuple[str, float, float]]) -> Column:
    """The first zone whose share of the size (lo, hi) holds the pixel's radius; else null."""
    out = F.when(F.lit(False), "")
    for name, lo, hi in bounds:
        out = out.when((radius(size) >= lo * size) & (radius(size) <= hi * size), name)
    return out


#: Centre and ring as shares of the patch size.
CENTRE_RING = (("center", 0.0, 0.18), ("ring", 0.30, 0.48))


def normalised_radius(size: int) -> Column:
    """Distance from the centre in halves of the side: 1 in the middle of an edge."""
    return radius(size) / max((size - 1) / 2, 0.5)


#: Masks by normalised radius; the source lies within the centre.
SOURCE_CENTRE_OUTER = (("source", 0.0, 0.15), ("center", 0.0, 0.5), ("outer", 0.65, float("inf")))


def mask_means(px: DataFrame, by: Sequence[str], size: int, masks: Sequence[tuple[str, float, float]] = SOURCE_CENTRE_OUTER) -> DataFrame:
    """by and for each mask the mean of its valid pixels and their number; masks may overlap. A
    mask that holds no pixel of such a size has a null mean."""
    r = normalised_radius(size)
    sums = []
    for name, lo, hi in masks:
        v = F.when((r >= lo) & (r <= hi), F.col("v"))
        sums += [F.avg(v).alias(name), F.count(v).alias(f"n_{name}")]
    return px.groupBy(*by).agg(*sums)


def valid_pixels(bands: DataFrame, by: Sequence[str]) -> DataFrame:
    """by, row, col and valid of pixels given a row a band: valid where every band has a finite
    value and any of them isn't 0."""
    return bands.groupBy(*by, "row", "col").agg((F.bool_and(F.col("v").isNotNull()) & F.coalesce(F.bool_or(F.col("v") != 0), F.lit(False))).alias("valid"))


def masked_stats(px: DataFrame, by: Sequence[str]) -> DataFrame:
    """n, mean, median, population sd, 10th and 90th percentile of the valid pixels."""
    # a patch's pixels are few; one array of its values for all three
    out = px.groupBy(*by).agg(F.count("v").alias("n"), F.avg("v").alias("mean"), F.stddev_pop("v").alias("sd"), F.expr("percentile(v, array(0.5, 0.1, 0.9))").alias("__q"))
    return out.select(*by, "n", "mean", F.col("__q")[0].alias("median"), "sd", F.col("__q")[1].alias("p10"), F.col("__q")[2].alias("p90"))


def contrast(px: DataFrame, by: Sequence[str], size: int) -> DataFrame:
    """Median of the centre less median of the ring."""
    z = px.withColumn("zone", zone(size, CENTRE_RING)).where("zone IS NOT NULL")
    m = [F.expr(f"percentile(CASE WHEN zone = '{n}' THEN v END, 0.5)").alias(n) for n in ("center", "ring")]
    return z.groupBy(*by).agg(*m).withColumn("contrast", F.col("center") - F.col("ring"))


def sectors(px: DataFrame, by: Sequence[str], size: int, lo: float, hi: float) -> DataFrame:
    """Mean of each of eight sectors (0 is north, clockwise) of an annulus."""
    inside = px.where((radius(size) >= lo * size) & (radius(size) <= hi * size))
    sector = F.floor(F.pmod(direction(size) + 22.5, F.lit(360.0)) / 45).cast("int")
    return inside.withColumn("sector", sector).groupBy(*by, "sector").agg(F.avg("v").alias("mean"))


def strongest_sector(px: DataFrame, by: Sequence[str], size: int, lo: float, hi: float) -> DataFrame:
    """The sector whose mean is farthest from zero (ties: the first), and that mean."""
    s = sectors(px, by, size, lo, hi).where("mean IS NOT NULL")
    best = F.min(F.struct((-F.abs(F.col("mean"))).alias("o"), "sector", "mean"))
    return s.groupBy(*by).agg(best.alias("b")).select(*by, F.col("b.sector").alias("sector"), F.col("b.mean").alias("mean"))


def cone(px: DataFrame, by: Sequence[str], size: int, toward: Column, half_width: float, lo: float, hi: float) -> DataFrame:
    """Mean of the pixels of an annulus within half_width degrees of a direction (downwind),
    of those as near to the opposite one (upwind), and their difference."""
    off = F.abs(F.pmod(direction(size) - toward + 180, F.lit(360.0)) - 180)
    inside = px.where((radius(size) >= lo * size) & (radius(size) <= hi * size)).withColumn("off", off)
    down, up = F.avg(F.when(F.col("off") <= half_width, F.col("v"))), F.avg(F.when(F.col("off") >= 180 - half_width, F.col("v")))
    return inside.groupBy(*by).agg(down.alias("downwind"), up.alias("upwind")).withColumn("contrast", F.col("downwind") - F.col("upwind"))


def wind_rectangles(px: DataFrame, by: Sequence[str], size: int, wind_from: Column, near: float = 0.05, far: float = 0.45, half_width: float = 0.14) -> DataFrame:
    """Mean of the rectangle that the wind blows into, of the one that it comes from, and their
    difference. Distances along (near to far) and across the wind are shares of the size; a null
    wind gives nulls."""
    off = F.radians(direction(size) - wind_from - 180)
    along, across = radius(size) * F.cos(off), F.abs(radius(size) * F.sin(off))
    inside = px.withColumn("along", F.when(across <= half_width * size, along))
    down, up = (F.avg(F.when((sign * F.col("along")).between(near * size, far * size), F.col("v"))) for sign in (1, -1))
    return inside.groupBy(*by).agg(down.alias("downwind"), up.alias("upwind")).withColumn("contrast", F.col("downwind") - F.col("upwind"))


def inferred_scale(px: DataFrame, by: Sequence[str], band: str) -> DataFrame:
    """p99 (the median over bands of the 99th percentile of positive values) and the scale that
    it speaks for: 10000 above 2, else 1, also where nothing is positive."""
    bands = px.groupBy(*by, band).agg(F.expr("percentile(CASE WHEN v > 0 THEN v END, 0.99)").alias("q"))
    return bands.groupBy(*by).agg(F.expr("percentile(q, 0.5)").alias("p99")).withColumn("scale", F.when(F.col("p99") > 2, 10000.0).otherwise(1.0))


def robust_z(px: DataFrame, by: Sequence[str], least: int = 20) -> DataFrame:
    """z of each valid pixel against its patch: 1.4826 MAD, else the population sd, as scale;
    null with fewer than `least` valid pixels or no spread."""
    base = px.groupBy(*by).agg(F.count("v").alias("n"), F.expr("percentile(v, 0.5)").alias("m"), F.stddev_pop("v").alias("sd"))
    rows = px.join(base, list(by))
    mad = rows.groupBy(*by).agg(F.expr("percentile(abs(v - m), 0.5)").alias("mad"))
    scale = F.coalesce(F.when(F.col("mad") > 1e-12, 1.4826 * F.col("mad")), F.when(F.col("sd") > 1e-12, F.col("sd")))
    return rows.join(mad, list(by)).withColumn("z", F.when(F.col("n") >= least, (F.col("v") - F.col("m")) / scale)).drop("n", "m", "sd", "mad")


def temporal_anomaly(target: DataFrame, reference: DataFrame, by: Sequence[str]) -> DataFrame:
    """Per pixel of the target: v less the median of the reference stack's valid values at
    that place of the same group; null where either is missing."""
    stack = reference.where("v IS NOT NULL").groupBy(*by, "row", "col").agg(F.expr("percentile(v, 0.5)").alias("usual"))
    return target.join(stack, [*by, "row", "col"], "left").withColumn("anomaly", F.col("v") - F.col("usual"))


def band_difference(a: Column, b: Column, eps: float = 1e-12) -> Column:
    """(a - b) / (a + b) pixel by pixel of two arrays; null where the sum is within eps of 0."""
    return F.zip_with(a, b, lambda x, y: F.when(F.abs(x + y) > eps, (x - y) / (x + y)))


def scalar_fit(px: DataFrame, by: Sequence[str], x: str, y: str) -> DataFrame:
    """Least-squares scalar c of y = c x through the origin; null without any x."""
    return px.groupBy(*by).agg((F.sum(F.col(x) * F.col(y)) / F.nullif(F.sum(F.col(x) * F.col(x)), F.lit(0.0))).alias("c"))


def dilate(px: DataFrame, by: Sequence[str], height: int, width: int, times: int = 1) -> DataFrame:
    """Grows a set of pixels (by, row, col) by its eight neighbours, `times` times."""
    step = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in range(-times, times + 1) for b in range(-times, times + 1)])
    grown = px.select(*by, "row", "col", F.explode(step).alias("s")).select(*by, (F.col("row") + F.col("s.a")).alias("row"), (F.col("col") + F.col("s.b")).alias("col"))
    return grown.where(F.col("row").between(0, height - 1) & F.col("col").between(0, width - 1)).distinct()


def regions(px: DataFrame, id_col: str, width: int, size: int) -> DataFrame:
    """id, region, n, distance: the eight-connected regions of a set of pixels (id, row, col)
    with their number of pixels and their centroid's distance from the patch centre.

    Runs of a row are joined to runs of the row before by their overlap, so a patch's links
    are its runs; all patches are solved together as connected components."""
    from matchbook.operators.graph import connected_components

    w = Window.partitionBy(id_col, "row").orderBy("col")
    run = F.sum(F.when(F.col("col") - F.lag("col").over(w) == 1, 0).otherwise(1)).over(w)
    place = F.col("row") * width + F.col("col")
    marked = px.select(id_col, "row", "col").distinct().withColumn("run", run)
    runs = marked.groupBy(id_col, "row", "run").agg(F.min("col").alias("a"), F.max("col").alias("b"), F.min(place).alias("node"))
    key = F.xxhash64(F.lit("patch"), F.col(id_col), F.col("node"))
    runs = runs.withColumn("node", key)
    up = runs.select(id_col, (F.col("row") + 1).alias("row"), F.col("a").alias("ua"), F.col("b").alias("ub"), F.col("node").alias("above"))
    links = runs.join(up, [id_col, "row"]).where("ua <= b + 1 AND a <= ub + 1").select(F.col("node").alias("a"), F.col("above").alias("b"))
    comps = connected_components(links.union(runs.select("node", F.col("node").alias("b"))))
    whole = runs.join(comps, "node")
    mid = (size - 1) / 2
    n = F.sum(F.col("b") - F.col("a") + 1)
    out = whole.groupBy(id_col, "component").agg(n.alias("n"), (F.sum(F.col("row") * (F.col("b") - F.col("a") + 1)) / n).alias("cr"), (F.sum((F.col("a") + F.col("b")) / 2 * (F.col("b") - F.col("a") + 1)) / n).alias("cc"))
    return out.select(id_col, F.col("component").alias("region"), "n", F.sqrt(F.pow(F.col("cr") - mid, 2) + F.pow(F.col("cc") - mid, 2)).alias("distance"))


def _kernel(size: int, out: int) -> list[tuple[int, int, float]]:
    """(target, source, weight) along one axis: linear between the sources around a target,
    first and last on each other; a single target lies on the first source."""
    table = []
    for t in range(out):
        x = t * (size - 1) / (out - 1) if out > 1 else 0.0
        lo = min(int(x), size - 1)
        table += [(t, s, w) for s, w in ((lo, 1 - (x - lo)), (lo + 1, x - lo)) if w > 0]
    return table


def resize(px: DataFrame, by: Sequence[str], size: int, out: int) -> DataFrame:
    """by, row, col, v of patches of size x size brought to out x out by linear interpolation
    along both axes. Null pixels have no weight: a cell is the weighted mean of the valid ones
    among the up to four that it lies between, null without any."""
    axis = lambda name: F.broadcast(px.sparkSession.createDataFrame(_kernel(size, out), f"__{name} int, {name} int, __w{name} double"))
    # tables of at most two rows a target
    met = px.select(*by, F.col("row").cast("int").alias("row"), F.col("col").cast("int").alias("col"), "v").join(axis("row"), "row").join(axis("col"), "col")
    weight = F.when(F.col("v").isNotNull(), F.col("__wrow") * F.col("__wcol"))
    cells = met.groupBy(*by, "__row", "__col").agg((F.sum(weight * F.col("v")) / F.nullif(F.sum(weight), F.lit(0.0))).alias("v"))
    return cells.select(*by, F.col("__row").alias("row"), F.col("__col").alias("col"), "v")


def crop(px: DataFrame, size: int, out: int, row: Column | int, col: Column | int) -> DataFrame:
    """The pixels of an out x out window around (row, col), moved so that it lies within the
    patch, counted from the window's corner. ValueError if the patch is smaller."""
    if out > size:
        raise ValueError(f"a patch of {size} has no window of {out}")
    start = [F.greatest(F.lit(0), F.least(F.lit(size - out), (F.lit(c) if isinstance(c, int) else c) - out // 2)) for c in (row, col)]
    marked = px.withColumns({"__top": start[0], "__left": start[1]})
    inside = (F.col("row") >= F.col("__top")) & (F.col("row") < F.col("__top") + out) & (F.col("col") >= F.col("__left")) & (F.col("col") < F.col("__left") + out)
    return marked.where(inside).withColumns({"row": (F.col("row") - F.col("__top")).cast("int"), "col": (F.col("col") - F.col("__left")).cast("int")}).drop("__top", "__left")


def pad(px: DataFrame, by: Sequence[str], size: int, out: int, fill: float | None = None) -> DataFrame:
    """by, row, col, v of patches set in the middle of an out x out grid (the smaller margin
    above and to the left), `fill` around them; patches that are as large stay."""
    margin = (out - size) // 2
    moved = px.select(*by, (F.col("row") + margin).cast("int").alias("row"), (F.col("col") + margin).cast("int").alias("col"), "v")
    border = [(r, c) for r in range(out) for c in range(out) if not (margin <= r < margin + size and margin <= c < margin + size)]
    if not border:
        return moved
    # as many cells as the grid has
    cells = F.broadcast(px.sparkSession.createDataFrame(border, "row int, col int"))
    return moved.unionByName(px.select(*by).distinct().crossJoin(cells).withColumn("v", F.lit(fill).cast("double")))
