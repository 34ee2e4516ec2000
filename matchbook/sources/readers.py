"""Readers for the file shapes that observation tables come in."""

from __future__ import annotations

import re
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from matchbook.operators.canonical import flatten_structs

SEPARATORS, ENCODINGS = (",", ";", "\t", "|"), ("UTF-8", "ISO-8859-1")
#: Lines that are looked at to find separator and encoding.
SNIFFED = 50


def sniff(spark: SparkSession, path: str) -> tuple[str, str]:
    """(separator, encoding) of delimited text by its first SNIFFED lines: the separator that
    parts most of them into as many fields as the header, of several fields, and among equals
    the one that the header holds most of; the first encoding that reads them without
    replacement signs."""
    for encoding in ENCODINGS:
        lines = [r[0] or "" for r in spark.read.option("encoding", encoding).option("sep", "\u0001").option("quote", "").csv(path).limit(SNIFFED).collect()]
        if not any("�" in x for x in lines):
            head = lines[0] if lines else ""
            agree = lambda s: sum(x.count(s) == head.count(s) for x in lines) if s in head else -1
            return max(SEPARATORS, key=lambda s: (agree(s), head.count(s))), encoding
    return ",", ENCODINGS[-1]


def read_delimited(spark: SparkSession, path: str, schema: T.StructType | None = None, sep: str | None = None, encoding: str | None = None) -> DataFrame:
    """Delimited text with a header; lines that don't fit are left out. Without a schema all
    columns are text, for the tolerant casts of canonical(): nothing is inferred."""
    found = (sep, encoding) if sep and encoding else sniff(spark, path)
    r = spark.read.option("header", True).option("sep", sep or found[0]).option("encoding", encoding or found[1]).option("mode", "DROPMALFORMED")
    df = (r.schema(schema) if schema else r).csv(path)
    # a mark of the encoding is no part of the first name
    return df.withColumnRenamed(df.columns[0], df.columns[0].lstrip("\ufeff")) if df.columns else df


def header(spark: SparkSession, path: str) -> list[str]:
    return read_delimited(spark, path).columns


def read_json_any(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """JSON lines; where the first line is no whole object, one JSON array or object a file."""
    r = spark.read if schema is None else spark.read.schema(schema)
    line = spark.read.text(path).where("trim(value) <> ''").limit(1).collect()
    first = line[0][0].strip() if line else "{}"
    return r.option("multiLine", not (first.startswith("{") and first.endswith("}"))).json(path)


def read_catalog(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """JSON lines by a schema; lines that aren't objects of it are left out. The line's file
    is kept as collection."""
    text = spark.read.text(path).withColumn("collection", F.input_file_name())
    parsed = text.select("collection", F.from_json("value", T.StructType([*schema.fields, T.StructField("_bad", T.StringType())]), {"columnNameOfCorruptRecord": "_bad"}).alias("j"))
    return parsed.where("j IS NOT NULL AND j._bad IS NULL").select("collection", *[F.col(f"j.{f.name}").alias(f.name) for f in schema])


def read_geojson(spark: SparkSession, path: str, properties: T.StructType) -> DataFrame:
    """A row a feature: its properties, and longitude and latitude of point geometries."""
    geometry = T.StructType().add("type", "string").add("coordinates", T.StringType())
    feature = T.StructType().add("properties", properties).add("geometry", geometry)
    rows = spark.read.schema(T.StructType().add("features", T.ArrayType(feature))).option("multiLine", True).json(path)
    f = rows.select(F.explode("features").alias("f"))
    point = F.when(F.col("f.geometry.type") == "Point", F.from_json("f.geometry.coordinates", T.ArrayType(T.DoubleType())))
    return f.select("f.properties.*", F.get(point, 0).alias("longitude"), F.get(point, 1).alias("latitude"))


def read_nested(df: DataFrame) -> DataFrame:
    """Nested objects as flat columns."""
    return flatten_structs(df)


def inventory(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """path, length and modification time of the files below a folder; contents aren't read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(path)
    return files.select("path", "length", "modificationTime")


def resolve(rows: DataFrame, files: DataFrame, column: str) -> DataFrame:
    """rows with found: whether the file that the column names (by its last part) exists in an
    inventory, and where."""
    name = lambda c: F.element_at(F.split(F.col(c), "/"), -1)
    known = files.groupBy(name("path").alias("__name")).agg(F.min("path").alias("found_path"))
    return rows.withColumn("__name", name(column)).join(known, "__name", "left").withColumn("found", F.col("found_path").isNotNull()).drop("__name")


def score_filled(tables: dict[str, DataFrame], classes: dict[str, tuple[str, float]], least: float) -> DataFrame:
    """table, n_rows, score: the weights of the field patterns times the share of rows in which a
    column that fits holds a value, added up; best first, only tables that reach the least
    score. Each table is read once, and only the columns that fit."""
    found = []
    for name, df in tables.items():
        shares = []
        for pattern, weight in classes.values():
            fits = [c for c in df.columns if re.search(pattern, c, re.IGNORECASE)]
            if fits:
                shares.append(weight * F.coalesce(F.avg(F.coalesce(*[F.col(c).cast("string") for c in fits]).isNotNull().cast("double")), F.lit(0.0)))
        found.append(df.agg(F.lit(name).alias("table"), F.count("*").alias("n_rows"), sum(shares, F.lit(0.0)).alias("score")))
    return reduce(DataFrame.union, found).where(F.col("score") >= least).orderBy(F.desc("score"), "table")


def score_columns(spark: SparkSession, tables: dict[str, Sequence[str]], classes: dict[str, tuple[str, float]], least: float) -> DataFrame:
    """table, score, classes: how well column names fit weighted field patterns, best first,
    only tables that reach the least score. Schemas alone are looked at."""
    rows = []
    for table, columns in tables.items():
        hits = [k for k, (pattern, _) in classes.items() if any(re.search(pattern, c, re.IGNORECASE) for c in columns)]
        rows.append((table, float(sum(classes[h][1] for h in hits)), sorted(hits)))
    return spark.createDataFrame(rows, "table string, score double, classes array<string>").where(F.col("score") >= least).orderBy(F.desc("score"), "table")
