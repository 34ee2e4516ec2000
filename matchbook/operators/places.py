"""The nearest place on the sphere, however far it is.

The places to be found are range-partitioned by a k-d tree: a sample of them, as points in
space, is cut at medians into cells of about PER_CELL places, and every cell's box is drawn
around all places in it. A point opens cells in the order of their boxes' distance, one at
first, then four times as many a round, and is done when no unopened box is nearer than the
nearest place it has met. So the search widens only as far as it must, a point meets the
places of few cells, and no radius has to be known. Points on one spot are searched once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from matchbook.functions.geo import EARTH_KM, haversine
from matchbook.session import stage_table

#: Places of a cell, and cells at most: their boxes are held by every task, 48 bytes each.
PER_CELL, CELLS = 64, 1 << 14
#: Sampled places a cell from which the cuts are taken. They decide about speed alone.
SAMPLED = 16


def _space(lat: Column, lon: Column) -> Column:
    """The point on the unit sphere."""
    p, q = F.radians(lat), F.radians(lon)
    return F.array(F.cos(p) * F.cos(q), F.cos(p) * F.sin(q), F.sin(p))


def cuts(points: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Axis and cut of each inner node of a k-d tree in heap order (node k has 2k and 2k + 1;
    node 1 is the root). A node that can't be split has an infinite cut: all go to 2k."""
    axis, at = np.zeros(1 << depth, np.int64), np.full(1 << depth, np.inf)
    held = {1: points}
    for k in range(1, 1 << depth):
        own = held.pop(k)
        if len(own) > 1:
            wide = own.max(0) - own.min(0)
            axis[k] = int(wide.argmax())
            line = np.sort(own[:, axis[k]])
            if line[0] < line[-1]:
                middle = line[len(line) // 2]
                at[k] = middle if middle > line[0] else line[line > line[0]][0]
        right = own[:, axis[k]] >= at[k]
        held[2 * k], held[2 * k + 1] = own[~right], own[right]
    return axis, at


def _in_cells(axis: np.ndarray, cut: np.ndarray, depth: int):
    """Adds to places the cell of their point: from the root down, one comparison a level."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.column("at").flatten().to_numpy(zero_copy_only=False).reshape(-1, 3)
            node = np.ones(len(at), np.int64)
            for _ in range(depth):
                node = 2 * node + (at[np.arange(len(at)), axis[node]] >= cut[node])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(node)], names=[*batch.schema.names, "cell"])

    return run


def _opened(cells: np.ndarray, low: np.ndarray, high: np.ndarray, first: int, last: int):
    """Points with their bound to the cells of rank first..last by distance of the box that
    are not beyond the bound, and whether more such cells are left."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            step = max(1, (1 << 21) // max(1, len(cells)))
            for a in range(0, batch.num_rows, step):
                part = batch.slice(a, step)
                at = part.column("at").flatten().to_numpy(zero_copy_only=False).reshape(-1, 3)
                bound = part.column("bound").to_numpy(zero_copy_only=False)
                away = np.zeros((len(at), len(cells)))
                for k in range(3):
                    x = at[:, k, None]
                    away += np.maximum(0.0, np.maximum(low[None, :, k] - x, x - high[None, :, k])) ** 2
                order = np.argsort(away, 1, kind="stable")[:, : last + 1]
                near = np.take_along_axis(away, order, 1) <= bound[:, None]
                more = near[:, last] if near.shape[1] > last else np.zeros(len(at), bool)
                row, nth = np.nonzero(near[:, first:last])
                open_ = order[row, nth + first]
                rows = pa.array(row)
                yield pa.RecordBatch.from_arrays([part.column("spot").take(rows), pa.array(cells[open_]), pa.array(more[row])], names=["spot", "cell", "more"])

    return run


def nearest_place(left: DataFrame, right: DataFrame, earth: float = EARTH_KM) -> DataFrame:
    """left (l_id, l_lat, l_lon and more) with r_id and distance of the nearest row of right
    (r_id, r_lat, r_lon), ties to the smaller r_id. Rows of right without an id, and points that
    lack a coordinate or have one that is not finite, meet nothing: such left rows, and all if
    right is empty, have nulls. Repeated rows are answered each."""

    def finite(lat: str, lon: str) -> Column:
        return (F.abs(F.col(lat)) < float("inf")) & (F.abs(F.col(lon)) < float("inf")) & ~F.isnan(lat) & ~F.isnan(lon)

    places = right.where(finite("r_lat", "r_lon") & F.col("r_id").isNotNull()).groupBy(F.col("r_lat").cast("double").alias("r_lat"), F.col("r_lon").cast("double").alias("r_lon")).agg(F.min("r_id").alias("r_id"))
    places = stage_table(places.withColumn("at", _space(F.col("r_lat"), F.col("r_lon"))), "places")
    n = places.count()
    if not n:
        return left.withColumns({"r_id": F.lit(None).cast(right.schema["r_id"].dataType), "distance": F.lit(None).cast("double")})
    depth = max(1, int(np.ceil(np.log2(min(CELLS, max(2, n / PER_CELL))))))
    most = SAMPLED << depth
    # a bounded sample, evenly drawn by a hash
    drawn = places.where(F.pmod(F.xxhash64("r_lat", "r_lon"), F.lit(max(1, n // most))) == 0).select("at").limit(2 * most)
    sample = np.array([r["at"] for r in drawn.collect()] or [places.first()["at"]])
    schema = T.StructType([*places.schema.fields, T.StructField("cell", T.LongType())])
    celled = stage_table(places.mapInArrow(_in_cells(*cuts(sample, depth), depth), schema), "places-cells")
    ends = [f(F.col("at")[k]).alias(f"{name}{k}") for name, f in (("low", F.min), ("high", F.max)) for k in range(3)]
    boxes = celled.groupBy("cell").agg(*ends).orderBy("cell").toPandas()  # CELLS rows at most
    cells, low, high = boxes["cell"].to_numpy(np.int64), boxes[["low0", "low1", "low2"]].to_numpy(), boxes[["high0", "high1", "high2"]].to_numpy()

    spots = left.where(finite("l_lat", "l_lon")).select(F.col("l_lat").cast("double").alias("l_lat"), F.col("l_lon").cast("double").alias("l_lon")).distinct()
    spots = spots.withColumns({"spot": F.struct("l_lat", "l_lon"), "at": _space(F.col("l_lat"), F.col("l_lon")), "bound": F.lit(8.0)})
    known, first, size = None, 0, 1
    open_ = stage_table(spots.select("spot", "at", "bound"), "places-open")
    schema = "spot struct<l_lat: double, l_lon: double>, cell long, more boolean"
    answers = []
    while True:
        pairs = open_.select("spot", "at", "bound").mapInArrow(_opened(cells, low, high, first, first + size), schema)
        met = pairs.join(celled.select("cell", "r_id", "r_lat", "r_lon"), "cell")
        found = F.struct(haversine(F.col("spot.l_lat"), F.col("spot.l_lon"), F.col("r_lat"), F.col("r_lon"), earth).alias("distance"), "r_id")
        best = met.groupBy("spot").agg(F.min(found).alias("best"), F.max("more").alias("more"))
        if known is not None:
            best = open_.select("spot", F.col("best").alias("had")).join(best, "spot", "left").select("spot", F.least("had", "best").alias("best"), F.coalesce("more", F.lit(False)).alias("more"))
        best = stage_table(best, "places-best")
        first, size = first + size, size * 4
        # a chord a little longer than the distance, squared; a closed point keeps its answer
        chord = F.pow(2 * F.sin(F.least(F.col("best.distance") / (2 * earth), F.lit(1.5707963267948966))), 2) * (1 + 1e-9) + 1e-18
        answers.append(best.where(~F.col("more")).select("spot", "best"))
        known = best.where("more").select("spot", "best", _space(F.col("spot.l_lat"), F.col("spot.l_lon")).alias("at"), chord.alias("bound"))
        if first >= len(cells) or known.isEmpty():
            answers.append(known.select("spot", "best"))
            break
        open_ = known
    every = answers[0]
    for more in answers[1:]:
        every = every.union(more)
    every = every.select(F.col("spot.l_lat").alias("__lat"), F.col("spot.l_lon").alias("__lon"), F.col("best.r_id").alias("r_id"), F.col("best.distance").alias("distance"))
    return left.join(every, (F.col("l_lat").cast("double") == F.col("__lat")) & (F.col("l_lon").cast("double") == F.col("__lon")), "left").drop("__lat", "__lon")
