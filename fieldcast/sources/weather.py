"""Landed weather documents (parallel arrays) to hourly and daily rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldcast.schemas import DAILY_COLUMNS, FORECAST_COLUMNS, HOURLY_COLUMNS, POWER_DOCUMENT, WEATHER_DOCUMENT
from fieldcast.operators.quality import mask_nodata

PLACE = ["point_id", "zone_id", "latitude", "longitude"]


def read_documents(spark: SparkSession, path: str | list[str]) -> DataFrame:
    return spark.read.schema(WEATHER_DOCUMENT).json(path)


def parse_documents(texts: DataFrame, column: str = "value") -> DataFrame:
    """Documents held as text, one per row."""
    return texts.select(F.from_json(column, WEATHER_DOCUMENT).alias("_d")).select("_d.*")


def split_empty(docs: DataFrame, part: str = "hourly") -> tuple[DataFrame, DataFrame]:
    """(documents with a series, documents without any reading)."""
    size = F.coalesce(F.size(f"{part}.time"), F.lit(0))
    return docs.filter(size > 0), docs.filter(size <= 0)


def _rows(docs: DataFrame, part: str, columns: dict[str, str], keep: list[str | Column], replace: dict[str, Column]) -> DataFrame:
    """Zip the arrays of one part; shorter arrays are padded with null. Rows end where `time` ends.

    Entries with an unreadable time are left out here; `malformed_times` has them.
    """
    arrays = {"time": F.col(f"{part}.time")}
    arrays |= {name: F.coalesce(replace.get(name, F.col(f"{part}.{name}")), F.array().cast("array<double>")) for name in columns}
    lifted = docs.select(*keep, *[value.alias(f"_{name}") for name, value in arrays.items()])
    readable = F.try_to_timestamp(F.col("_time")) if part == "hourly" else F.try_to_date("_time")
    kept = [c for c in lifted.columns if not c.startswith("_")]
    zipped = F.arrays_zip(*[F.col(f"_{name}") for name in arrays])
    return lifted.select(*kept, F.explode(zipped).alias("_r")).select(*kept, "_r.*").filter(readable.isNotNull())


def malformed_times(docs: DataFrame, part: str) -> DataFrame:
    """Quarantine: entries of `hourly` or `daily` whose time cannot be read, with the place they came from."""
    read = F.try_to_timestamp(F.col("time")) if part == "hourly" else F.try_to_date("time").cast("timestamp")
    return docs.select(*PLACE, F.explode(f"{part}.time").alias("time")).where(F.col("time").isNotNull() & read.isNull())


def archive_rows(docs: DataFrame) -> DataFrame:
    """Hourly observations with a readable time. A missing gust series falls back to the wind series."""
    gusts = F.coalesce("hourly.wind_gusts_10m", "hourly.wind_speed_10m")
    rows = _rows(
        docs, "hourly", HOURLY_COLUMNS, [*PLACE, F.coalesce("elevation", F.lit(0.0)).alias("elevation_m")],
        {"wind_gusts_10m": gusts},
    )
    return rows.select(
        *PLACE,
        "elevation_m",
        F.try_to_timestamp(F.col("_time")).alias("timestamp"),
        *[F.col(f"_{name}").alias(column) for name, column in HOURLY_COLUMNS.items()],
    )


def forecast_rows(docs: DataFrame) -> DataFrame:
    """Hourly forecast; the solar column is direct-normal radiation, else shortwave."""
    rows = _rows(docs, "hourly", FORECAST_COLUMNS, [*PLACE, F.col("elevation").alias("elevation_m")], {})
    solar = F.coalesce("_direct_normal_irradiance", "_shortwave_radiation_instant")
    return rows.select(
        *PLACE,
        "elevation_m",
        F.try_to_timestamp(F.col("_time")).alias("timestamp"),
        *[
            (solar if column == "solar_radiation_w_m2" else F.col(f"_{name}")).alias(column)
            for name, column in FORECAST_COLUMNS.items()
        ],
    )


def daily_rows(docs: DataFrame) -> DataFrame:
    """Daily extremes and rain; unknown rain probability and weather code become 0."""
    rows = _rows(docs, "daily", DAILY_COLUMNS, PLACE, {})
    return rows.select(
        *PLACE,
        F.try_to_date("_time").alias("date"),
        F.col("_temperature_2m_max").alias("tmax_c"),
        F.col("_temperature_2m_min").alias("tmin_c"),
        F.col("_precipitation_sum").alias("precipitation_mm"),
        F.coalesce(F.col("_precipitation_probability_max").cast("int"), F.lit(0)).alias("rain_probability_pct"),
        F.coalesce(F.col("_weathercode").cast("int"), F.lit(0)).alias("weather_code"),
    )


def climate_rows(docs: DataFrame) -> DataFrame:
    """Daily history for climate normals."""
    return daily_rows(docs).select(
        "point_id", "date", "tmax_c", "tmin_c", "precipitation_mm", F.lit("archive").alias("source")
    )


def project_variables(docs: DataFrame, hourly: list[str]) -> DataFrame:
    """Rows with the requested hourly variables only; the reader prunes the other arrays."""
    return archive_rows(docs).select("point_id", "timestamp", *[HOURLY_COLUMNS[v] for v in hourly])


def read_power(spark: SparkSession, path: str) -> DataFrame:
    return power_rows(spark.read.schema(POWER_DOCUMENT).json(path))


def power_rows(docs: DataFrame) -> DataFrame:
    """Daily satellite climatology; the service's fill value becomes null, bad dates are left out."""
    values = ["t2m_c", "precip_corr_mm", "rh2m_pct", "solar_radiation_mj_m2"]
    return docs.filter(F.try_to_date("date", "yyyyMMdd").isNotNull() & F.col("date").rlike(r"^\d{8}$")).select(
        "point_id", F.try_to_date("date", "yyyyMMdd").alias("date"), *[mask_nodata(F.col(v)).alias(v) for v in values]
    )
