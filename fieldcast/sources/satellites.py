"""Satellite search replies and cached telemetry."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldcast import catalogs
from fieldcast.functions.text import instant
from fieldcast.schemas import GRANULE_DOCUMENT, ITEM_DOCUMENT, TELEMETRY


def granule_rows(docs: DataFrame) -> DataFrame:
    """One row per granule: first bounding box, missing texts empty, bad times null."""
    entries = docs.select("dataset_id", F.explode("entries").alias("e"))
    box = F.try_element_at("e.boundbox", F.lit(1))
    return entries.select(
        F.coalesce("e.identifier", F.lit("")).alias("identifier"),
        F.coalesce("e.id", F.lit("")).alias("granule_id"),
        "dataset_id",
        F.coalesce("e.summary", F.lit("")).alias("summary"),
        instant(F.col("e.updated")).alias("updated"),
        F.coalesce("e.enclosureLink", F.lit("")).alias("enclosure_link"),
        *[box.getField(edge).try_cast("double").alias(edge) for edge in ("west", "south", "east", "north")],
    )


def item_rows(docs: DataFrame) -> DataFrame:
    """One row per catalogue item, located at its point geometry."""
    features = docs.select(F.explode("features").alias("f"))
    return features.select(
        F.col("f.id").alias("item_id"),
        F.col("f.collection").alias("collection"),
        F.try_element_at("f.geometry.coordinates", F.lit(1)).alias("longitude"),
        F.try_element_at("f.geometry.coordinates", F.lit(2)).alias("latitude"),
        instant(F.col("f.properties.datetime")).alias("acquired"),
        F.col("f.properties.Online").alias("online"),
        F.coalesce("f.properties.satellite", F.element_at(F.split("f.collection", "_"), 1)).alias("satellite"),
        F.coalesce("f.properties.attribution", F.lit(catalogs.BHOONIDHI_ATTRIBUTION)).alias("attribution"),
        F.col("f.properties.soil_moisture_m3_m3").alias("soil_moisture_m3_m3"),
    )


def parse_granules(texts: DataFrame, column: str = "value") -> DataFrame:
    return granule_rows(texts.select(F.from_json(column, GRANULE_DOCUMENT).alias("_d")).select("_d.*"))


def parse_items(texts: DataFrame, column: str = "value") -> DataFrame:
    return item_rows(texts.select(F.from_json(column, ITEM_DOCUMENT).alias("_d")).select("_d.*"))


def read_granules(spark: SparkSession, path: str) -> DataFrame:
    return granule_rows(spark.read.schema(GRANULE_DOCUMENT).json(path, multiLine=True))


def read_items(spark: SparkSession, path: str) -> DataFrame:
    return item_rows(spark.read.schema(ITEM_DOCUMENT).json(path, multiLine=True))


def read_telemetry(spark: SparkSession, path: str) -> DataFrame:
    return telemetry_rows(spark.read.schema(TELEMETRY).json(path))


def telemetry_rows(cache: DataFrame) -> DataFrame:
    """Cached records with defaults and the citation the data owner requires."""
    return cache.select(
        F.lower("location_key").alias("location_key"),
        F.coalesce("satellite", F.lit("INSAT-3DR")).alias("satellite"),
        "dataset_id",
        instant(F.col("timestamp")).alias("timestamp"),
        F.coalesce("cloud_fraction_pct", F.lit(0.0)).alias("cloud_fraction_pct"),
        "cloud_top_temp_c",
        F.coalesce("rainfall_rate_mmh", F.lit(0.0)).alias("rainfall_rate_mmh"),
        F.lit("cached").alias("source_status"),
        F.lit(catalogs.MOSDAC_ATTRIBUTION).alias("attribution"),
    )
