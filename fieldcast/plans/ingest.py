"""Hourly zone tables that grow by deliveries, a partition for each zone and month.

Stored are the landed hours with their leave-one-out baselines, which depend on the other
stations of the same hour alone. A delivery therefore changes only the hours it adds
stations to: of the partitions that hold such hours these are worked out again, the
other hours of the partition are copied as they are, and no other partition is written. What depends
on a whole zone (its mean height, its stations' terrain) is not stored but joined when the
table is read, so the result is that of a full rebuild.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fieldcast.operators import terrain
from fieldcast.plans import features
from fieldcast.session import settle

PART = ["zone_id", "month"]
HOUR = ["zone_id", "point_id", "timestamp"]


def month_of(timestamp: str) -> Column:
    """Partition name of a time; rows without a time share one."""
    return F.coalesce(F.date_format(timestamp, "'m'yyyy'_'MM"), F.lit("none"))


def zone_hours(spark: SparkSession, table: str) -> DataFrame | None:
    """The stored rows, or nothing where no table is yet. Partition values are text, whatever they look like."""
    try:
        found = spark.read.parquet(table).schema
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return None
    text = T.StructType([T.StructField(f.name, T.StringType()) if f.name in PART else f for f in found.fields])
    return spark.read.schema(text).parquet(table)


def _of(rows: DataFrame, keys: DataFrame, names: list[str], how: str) -> DataFrame:
    """Rows whose key is, or is not, among the keys; null meets null."""
    at = F.struct(*names).alias("_key")
    return rows.withColumn("_key", at).join(keys.select(at).distinct(), "_key", how).drop("_key")


def ingest_zones(spark: SparkSession, observations: DataFrame, table: str) -> DataFrame:
    """Add the hours that the table lacks and return the stations that gained any.

    `observations` are landed hourly rows, in any portions. An hour is known by zone, station and
    time, nulls included; the first delivery of an hour counts, and of several rows in one
    delivery the least. Only partitions that gain hours are read whole and written again.
    """
    raw = observations.columns
    row = F.struct(*raw)
    once = observations.groupBy(F.struct(*HOUR).alias("_hour")).agg(F.min(row).alias("_row")).select("_row.*").withColumn("month", month_of("timestamp"))
    stored = zone_hours(spark, table)
    if stored is None:
        fresh = settle(once)
        whole = changed = fresh
    else:
        # The keys of the delivery's months are all that is read to find what is new.
        known = _of(stored.select(*HOUR, "month"), once.select(*PART), PART, "left_semi")
        fresh = settle(_of(once, known, HOUR, "left_anti"))
        whole = _of(stored, fresh, PART, "left_semi")
        hours = ["zone_id", "timestamp"]
        changed = _of(whole, fresh, hours, "left_semi").select(*raw, "month").unionByName(fresh)
    based = features.with_baselines(changed, source=changed)
    result = based if stored is None else based.unionByName(_of(whole, fresh, ["zone_id", "timestamp"], "left_anti").select(*based.columns))
    # Settled, because the partitions are read from the table that they are then written to.
    settle(result).hint("rebalance", *PART).write.mode("overwrite").option("compression", "snappy").option("partitionOverwriteMode", "dynamic").partitionBy(*PART).parquet(table)
    return fresh.select("zone_id", "point_id").distinct()


def zone_table(spark: SparkSession, table: str, dem: DataFrame | None = None, tiles: DataFrame | None = None, radii: tuple[float, float] = terrain.TPI_RADII_M) -> DataFrame:
    """The fleet training table of everything that landed: raster terrain where a tile covers the station, else the lattice."""
    return features.finish_zone_features(zone_hours(spark, table).drop("month"), dem, tiles, radii)
