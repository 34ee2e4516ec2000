"""Session factory, table loader and the shared working folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)


def local_session(cores: int | str = "*", app: str = "matchbook", memory: str = "4g") -> SparkSession:
    """A UTC session for tests and benches; a cluster brings its own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", memory)
        .getOrCreate()
    )


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One Parquet table of a data folder, read lazily so that Catalyst can prune it."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def views(spark: SparkSession, sf_dir: str, *names: str) -> None:
    """Registers tables as temp views for SQL texts."""
    for name in names:
        load(spark, sf_dir, name).createOrReplaceTempView(name)


def small_batches(spark: SparkSession, size: int = 4 << 20) -> None:
    """Rows go to Python in batches of `size` bytes, if the session has no limit of its own.
    By default a batch holds 10,000 rows, up to 64 MB, and each task has copies of it in the
    executor's memory, outside its heap, and in the Python worker."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(name) in ("67108864b", "64MB"):
        spark.conf.set(name, str(size))


_OWN: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or where
    that is unset (local tests) one folder of this process."""
    set_by_cluster = spark.conf.get("spark.checkpoint.dir", None)
    if set_by_cluster:
        return set_by_cluster.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not _OWN:
        _OWN.append(tempfile.mkdtemp(prefix="matchbook-"))
    return f"file://{_OWN[0]}"


def stage_table(df: DataFrame, name: str) -> DataFrame:
    """Writes df as Parquet below shared_dir and reads it again: cuts lineage in a
    form that outlives lost executors, and gives the planner true file sizes."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/matchbook/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
