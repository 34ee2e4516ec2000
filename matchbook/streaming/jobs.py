"""Extensions: the event operators as Structured Streaming jobs.

Each takes a streaming DataFrame of events (user_id, event_type, ts, value, event_id)
and leaves source, sink and checkpoint to the caller; run_once drains what there is.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from matchbook.session import shared_dir


def event_stream(spark: SparkSession, sf_dir: str, schema: T.StructType) -> DataFrame:
    return spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir).withColumn("ts", F.col("ts").cast("timestamp"))


def session_counts(events: DataFrame, gap: str = "6 hours", late: str | None = None) -> DataFrame:
    """Sessions per user and type; with `late` a watermark closes them and late rows drop."""
    rows = events.withWatermark("ts", late) if late else events
    grouped = rows.groupBy(F.session_window("ts", gap).alias("w"), "user_id", "event_type")
    return grouped.agg(F.count("*").alias("n"), F.max("ts").alias("last")).select("user_id", "event_type", F.col("w.start").alias("start"), "last", "n")


def bucket_counts(events: DataFrame, width: str = "10 minutes", late: str | None = None) -> DataFrame:
    rows = events.withWatermark("ts", late) if late else events
    return rows.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "event_type", "n")


def distinct_events(events: DataFrame, late: str = "1 day") -> DataFrame:
    """The first of repeated event ids within the watermark."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"])


def run_once(stream: DataFrame, mode: str = "complete", checkpoint: str | None = None) -> DataFrame:
    """Drains the stream's source and gives the result table. Complete results replace the
    table with each batch, others are added; both are written by batch number, so a batch
    that is run again overwrites itself."""
    spark = stream.sparkSession
    base = f"{shared_dir(spark)}/matchbook/stream-{uuid.uuid4().hex}"
    last: list[str] = []

    def put(batch: DataFrame, number: int) -> None:
        path = f"{base}/out/batch={number}"
        batch.write.mode("overwrite").parquet(path)
        if mode == "complete":
            last.clear()
        last.append(path)

    q = stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint or f"{base}/checkpoint").trigger(availableNow=True).foreachBatch(put).start()
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(*last) if last else spark.createDataFrame([], stream.schema)
