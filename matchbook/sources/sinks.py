"""Writers. Spark's commit protocol makes each of them all or nothing."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def write_delimited(df: DataFrame, path: str, sep: str = ",") -> None:
    df.write.mode("overwrite").option("header", True).option("sep", sep).csv(path)


def write_json_lines(df: DataFrame, path: str, append: bool = False) -> None:
    """JSON lines; append adds files to a log that readers see once they are committed."""
    df.write.mode("append" if append else "overwrite").json(path)


def write_routed(df: DataFrame, route: str, known: Sequence[str], path: str, reason: Column | None = None) -> None:
    """Rows to a folder a route, path/route=<name>, with the reason, in one pass over them.
    Rows whose route is null or not a known one go to the route `unrouted`, their reason saying
    which; no row vanishes. Columns named route and reason are replaced."""
    r = F.col(route).cast("string")
    is_known = F.coalesce(r.isin(*known), F.lit(False))
    why = F.when(is_known, reason if reason is not None else F.lit("")).when(r.isNull(), "no route").otherwise(F.concat(F.lit("unknown route "), r))
    marked = df.withColumns({"__route": F.when(is_known, r).otherwise("unrouted"), "__reason": why}).drop("route", "reason")
    marked.withColumnsRenamed({"__route": "route", "__reason": "reason"}).write.mode("overwrite").partitionBy("route").parquet(path)


def release_manifest(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """file, length and SHA-256 of each file of a release folder."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(path)
    return files.select(F.element_at(F.split("path", "/"), -1).alias("file"), "length", F.sha2("content", 256).alias("sha256"))


def counted_manifest(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """The same with part (the file's folder) and n_rows, its lines: what a release is frozen with."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(path)
    end = lambda k: F.element_at(F.split("path", "/"), k)
    digests = files.select("path", end(-2).alias("part"), end(-1).alias("file"), "length", F.sha2("content", 256).alias("sha256"))
    lines = spark.read.option("pathGlobFilter", pattern).option("recursiveFileLookup", True).text(path)
    counts = lines.groupBy(F.col("_metadata.file_path").alias("path")).agg(F.count("*").alias("n_rows"))
    # both name a file by its URI
    plain = lambda c: F.regexp_replace(F.col(c), "^file:/+", "/")
    joined = digests.withColumn("__p", plain("path")).join(counts.select(plain("path").alias("__p"), "n_rows"), "__p", "left")
    return joined.select("part", "file", "length", "sha256", F.coalesce("n_rows", F.lit(0)).alias("n_rows"))


def wrong_file_counts(manifest: DataFrame, expected: DataFrame, key: str = "part") -> DataFrame:
    """A gate: keys whose rows in the manifest are not the expected n, missing and surplus ones
    too, with both counts; empty when all is well."""
    have = manifest.groupBy(key).agg(F.sum("n_rows").alias("found"))
    both = have.join(expected.select(key, F.col("n").alias("expected")), key, "full")
    return both.where("NOT (found <=> expected)").select(key, "expected", "found")


def changed_files(now: DataFrame, frozen: DataFrame) -> DataFrame:
    """Files that are missing, new or different against a frozen manifest."""
    both = now.alias("n").join(frozen.alias("f"), "file", "full")
    state = F.when(F.col("n.sha256").isNull(), "missing").when(F.col("f.sha256").isNull(), "new").when(F.col("n.sha256") != F.col("f.sha256"), "changed")
    return both.select("file", state.alias("state")).where("state IS NOT NULL")
