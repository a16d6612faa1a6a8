"""Table files: preference-ordered scans and partitioned sinks."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from fieldcast.schemas import OBS_HOURLY


def read_first(spark: SparkSession, paths: list[str], schema: StructType = OBS_HOURLY) -> DataFrame:
    """The first table of a preference list that exists: Parquet, or CSV by suffix."""
    for path in paths:
        try:
            return read_csv(spark, path, schema) if path.endswith(".csv") else spark.read.parquet(path)
        except AnalysisException as missing:
            if missing.getCondition() != "PATH_NOT_FOUND":
                raise
    raise FileNotFoundError(f"none of these tables exists: {paths}")


def read_csv(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    return spark.read.schema(schema).csv(path, header=True)


def write_zones(df: DataFrame, path: str) -> None:
    """One folder per zone, snappy Parquet; only the zones present are replaced.

    The rebalance hint gathers a zone's rows into files of even size and lets AQE split a
    zone that is much larger than the others.
    """
    df.hint("rebalance", "zone_id").write.mode("overwrite").option("compression", "snappy").option(
        "partitionOverwriteMode", "dynamic"
    ).partitionBy("zone_id").parquet(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").csv(path, header=True)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def as_json(df: DataFrame, key: list[str], name: str = "document") -> DataFrame:
    """Key columns plus the whole row as JSON text."""
    return df.select(*key, F.to_json(F.struct(*df.columns)).alias(name))


def union_all(frames: list[DataFrame]) -> DataFrame:
    """Stack tables by column name; a column one of them lacks is null there."""
    whole = frames[0]
    for frame in frames[1:]:
        whole = whole.unionByName(frame, allowMissingColumns=True)
    return whole
