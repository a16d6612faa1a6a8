"""Session settings every plan relies on, and the one way lineage is cut."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Hourly data is keyed in UTC; AQE splits skewed join partitions at run time.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.parquet.compression.codec": "snappy",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
    # Plans are built from thousands of small expressions; recording the Python line of each is slow.
    "spark.python.sql.dataFrameDebugging.enabled": "false",
}

#: Whether Spark drops the shuffle files of a query when it ends.
FREE_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def build_session(app: str = "fieldcast", master: str | None = None, **extra: str) -> SparkSession:
    """A session with the settings above; `extra` uses underscores for dots."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in SETTINGS.items():
        builder = builder.config(key, value)
    for key, value in extra.items():
        builder = builder.config(key.replace("_", "."), value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """A new folder below the one the cluster names in `spark.checkpoint.dir`.

    Only a local session without that setting gets a temporary folder of its own.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if root is None:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a shared folder")
        root = tempfile.mkdtemp(prefix="fieldcast-")
    return f"{root}/{uuid.uuid4().hex}"


def settle(df: DataFrame, compression: str | None = None) -> DataFrame:
    """Cut lineage: write the rows once as Parquet to shared storage and go on from there.

    A lost executor then costs a re-read, and later passes read only the columns they need.
    What was shuffled for the rows leaves the disks when they are written. Rows read many times over may name another `compression`.
    """
    spark, path = df.sparkSession, shared_folder(df.sparkSession)
    before = spark.conf.get(FREE_SHUFFLES, "false")
    spark.conf.set(FREE_SHUFFLES, "true")
    try:
        df.write.parquet(path, compression=compression)
    finally:
        spark.conf.set(FREE_SHUFFLES, before)
    return spark.read.schema(df.schema).parquet(path)


def spread(scan: DataFrame, rows: int = 100_000) -> DataFrame:
    """Give row-heavy work (regular expressions, pages) a task for so many rows, and as many tasks as there are cores.

    For a plain scan, whose rows are counted without reading them. One that comes in fewer pieces
    than that is redistributed, since tasks would grow with the table otherwise.
    """
    tasks = max(scan.sparkSession.sparkContext.defaultParallelism, -(-scan.count() // rows))
    pieces = scan._jdf.queryExecution().toRdd().getNumPartitions()
    return scan.repartition(tasks) if pieces < tasks else scan
