"""Regional baselines: what the other stations of a domain say about one station."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldcast.operators.keys import meet

# Target column -> baseline column.
TARGETS = {
    "temperature_2m_c": "baseline_temp_c",
    "soil_moisture_0_to_7cm_m3m3": "baseline_soil_moisture_m3m3",
    "relative_humidity_2m_pct": "baseline_relative_humidity_pct",
    "wind_speed_10m_kmh": "baseline_wind_speed_kmh",
    "vpd_local_kpa": "baseline_vpd_kpa",
}
TEMPERATURE_ONLY = {"temperature_2m_c": "baseline_temp_c"}

# Residual column -> (local column, baseline column).
RESIDUALS = {
    "residual_anomaly_c": ("temperature_2m_c", "baseline_temp_c"),
    "residual_soil_moisture_m3m3": ("soil_moisture_0_to_7cm_m3m3", "baseline_soil_moisture_m3m3"),
    "residual_vpd_kpa": ("vpd_local_kpa", "baseline_vpd_kpa"),
    "residual_wind_speed_kmh": ("wind_speed_10m_kmh", "baseline_wind_speed_kmh"),
}


def leave_one_out(
    df: DataFrame, domain: list[str], targets: dict[str, str], source: DataFrame | None = None
) -> DataFrame:
    """Mean of the other stations of the domain at that hour; a lone station keeps its own value.

    Sums and counts come from a map-side combined aggregate joined back by the domain keys,
    so a crowded domain is never sorted in one task and a skewed join side can be split.
    `source` is the same set of rows before other work was done on them; reading it for the
    sums keeps that work from running twice.
    """
    totals = (df if source is None else source).groupBy(*domain).agg(
        *[F.sum(c).alias(f"_sum_{c}") for c in targets],
        *[F.count(c).alias(f"_n_{c}") for c in targets],
    )
    joined = meet(df, totals, domain)
    others = {
        base: F.when(
            F.col(f"_n_{c}") > 1, (F.col(f"_sum_{c}") - F.col(c)) / F.nullif(F.col(f"_n_{c}") - 1, F.lit(0))
        ).otherwise(F.col(c))
        for c, base in targets.items()
    }
    return joined.withColumns(others).drop(
        *[f"_sum_{c}" for c in targets], *[f"_n_{c}" for c in targets]
    )


def domain_elevation(df: DataFrame) -> DataFrame:
    """Row-weighted mean elevation per zone, whatever zones there are."""
    return df.groupBy("zone_id").agg(F.avg("elevation_m").alias("domain_mean_elevation_m"))


def with_elevation_delta(df: DataFrame, source: DataFrame | None = None) -> DataFrame:
    """Height above the domain mean; a zone without any known height keeps its rows with null."""
    return meet(df, domain_elevation(df if source is None else source), ["zone_id"]).withColumn(
        "delta_elevation_m", F.col("elevation_m") - F.col("domain_mean_elevation_m")
    )


def hourly_mean(df: DataFrame, column: str, name: str) -> DataFrame:
    return df.groupBy("zone_id", "timestamp").agg(F.avg(column).alias(name))


def residuals(df: DataFrame, names: list[str] | None = None) -> DataFrame:
    return df.withColumns(
        {n: F.col(RESIDUALS[n][0]) - F.col(RESIDUALS[n][1]) for n in names or list(RESIDUALS)}
    )
