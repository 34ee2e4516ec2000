"""Nested JSON of any shape, walked level by level.

A level of all documents is one step: objects and arrays are opened into their members, what
is neither is a leaf. So there are as many steps as the deepest document has levels, and a
document's size matters to nobody but itself.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from matchbook.session import stage_table


def _kind(v: Column) -> Column:
    """OBJECT, ARRAY, or the type of a scalar."""
    return F.regexp_extract(F.schema_of_variant(v), "^[A-Z]+", 0)


def nodes(rows: DataFrame, id_col: str, json: str) -> DataFrame:
    """id, path, parent, key, kind and text of every member of the documents: path is
    /key/0/key from the root, key is null in arrays, kind OBJECT, ARRAY, STRING, ... and text
    the value of a scalar (null for containers and JSON's null). A root that is a scalar is a
    member with an empty path. Null texts and texts that are no JSON have none."""
    level = rows.select(id_col, F.lit(None).cast("string").alias("parent"), F.lit("").alias("path"), F.lit(None).cast("string").alias("key"), F.try_parse_json(json).alias("v")).where("v IS NOT NULL")
    found, root = [], True
    while True:
        level = stage_table(level.withColumn("kind", _kind(F.col("v"))), "json-level")
        held = F.col("kind").isin("OBJECT", "ARRAY")
        text = F.when(~held, F.try_variant_get("v", "$", "string"))
        found.append((level.where(~held) if root else level).select(id_col, "path", "parent", "key", "kind", text.alias("text")))
        opened = level.where(held)
        if opened.isEmpty():
            break
        members = opened.select(id_col, F.col("path").alias("parent"), "v").lateralJoin(rows.sparkSession.tvf.variant_explode(F.col("v").outer()))
        at = F.concat("parent", F.lit("/"), F.coalesce("key", F.col("pos").cast("string")))
        level, root = members.select(id_col, "parent", at.alias("path"), "key", F.col("value").alias("v")), False
    return reduce(DataFrame.union, found)


def all_strings(members: DataFrame, id_col: str) -> DataFrame:
    """id, path and text of all strings among nodes(): values, and keys of objects."""
    values = members.where("kind = 'STRING'").select(id_col, "path", "text")
    return values.unionByName(members.where("key IS NOT NULL").select(id_col, "path", F.col("key").alias("text")))


def coordinate_pairs(members: DataFrame, id_col: str) -> DataFrame:
    """id, path, lat, lon and score of pairs of members of one object whose keys hold "lat" and
    "lon", in any case, and whose values are numbers (or texts of some) in range. The score is
    1 and more where the path speaks of a maximum (5), an enhancement or plume (3), a source (2)."""
    number = members.where("key IS NOT NULL").select(id_col, "parent", F.lower("key").alias("key"), F.expr("try_cast(text AS double)").alias("x")).where("x IS NOT NULL")
    lat = number.where("contains(key, 'lat') AND x BETWEEN -90 AND 90").select(id_col, "parent", F.col("key").alias("lat_key"), F.col("x").alias("lat"))
    lon = number.where("contains(key, 'lon') AND x BETWEEN -180 AND 180").select(id_col, "parent", F.col("key").alias("lon_key"), F.col("x").alias("lon"))
    pairs = lat.join(lon, [id_col, "parent"])
    path = F.concat_ws("/", F.lower("parent"), "lat_key", "lon_key")
    score = 1 + sum((F.when(path.rlike(words), points).otherwise(0) for words, points in (("max", 5), ("enhance|plume", 3), ("source", 2))), F.lit(0))
    return pairs.select(id_col, path.alias("path"), "lat", "lon", score.alias("score"))
