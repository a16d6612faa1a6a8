"""Resumable ingest: new landed documents become hourly rows exactly once.

The stream's checkpoint remembers which files were read, so a restarted run continues
where the last one stopped instead of fetching everything again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from fieldcast.schemas import WEATHER_DOCUMENT
from fieldcast.sources.weather import archive_rows


def landed_rows(spark: SparkSession, landing: str, files_per_batch: int = 1000) -> DataFrame:
    docs = (
        spark.readStream.schema(WEATHER_DOCUMENT).option("maxFilesPerTrigger", files_per_batch).json(landing)
    )
    return archive_rows(docs)


def ingest_new(spark: SparkSession, landing: str, table: str, checkpoint: str) -> StreamingQuery:
    """Append everything that landed since the last run to the zone-partitioned table, then stop."""
    return (
        landed_rows(spark, landing)
        .writeStream.format("parquet")
        .partitionBy("zone_id")
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start(table)
    )
