"""Downscaled forecasts: routing, scoring, and the hourly series the indices read."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldcast import catalogs
from fieldcast.functions import physics
from fieldcast.operators import indices, lookups, model_registry, residual_models, spatial, timeseries

SERIES_DIGITS = {
    "baseline_temp_c": 2, "downscaled_temp_1km_c": 2, "delta_t_c": 2, "relative_humidity_pct": 1,
    "wind_speed_kmh": 1, "solar_radiation_w_m2": 1, "soil_moisture_m3m3": 3, "rain_probability_pct": 1,
}


def zone_catalog(spark: SparkSession) -> DataFrame:
    """Zones with centroid, published metrics and live flag."""
    zones = lookups.with_benchmark(catalogs.zones(spark))
    return zones.withColumns(
        {
            "station_count": F.lit(catalogs.STATIONS_PER_ZONE),
            "is_live_deployment_zone": F.col("zone_id") == catalogs.LIVE_ZONE,
        }
    )


def region_filter(zones: DataFrame, region: str) -> DataFrame:
    """Leaderboard rows of a region preset; any other word keeps all."""
    numbers = catalogs.REGIONS.get(region)
    return zones.filter(F.col("zone_no").isin(numbers)) if numbers else zones


def first_hours(forecast: DataFrame, key: list[str], hours: int | Column) -> DataFrame:
    """The first N rows of each location's forecast."""
    if isinstance(hours, int):
        return timeseries.first_rows(forecast, key, "timestamp", hours).drop("_row_no")
    limit = hours
    numbered = timeseries.number_rows(forecast, key, "timestamp", "_row_no")
    return numbered.filter(F.col("_row_no") <= limit).drop("_row_no")


def covariate_map(overrides: str | None = None) -> Column:
    """What the prediction used, by name. A caller's values win."""
    names = [
        "elevation_m", "delta_elevation_m", "solar_radiation_w_m2", "soil_temperature_0_to_7cm_c",
        "soil_moisture_0_to_7cm_m3m3", "et0_evapotranspiration_mm", "thermal_inertia_lag_3h",
    ]
    pairs = [x for n in names for x in (F.lit(n), F.col(n))]
    pairs += [F.lit("predicted_residual_c"), F.round(physics.clamp_residual(F.col("predicted_residual_c")), 3)]
    used = F.create_map(*pairs)
    if overrides is None:
        return used
    given = F.coalesce(F.col(overrides), F.create_map().cast("map<string,double>"))
    kept = F.map_filter(used, lambda k, _: ~F.map_contains_key(given, k))
    return F.map_concat(kept, given)


def finish(scored: DataFrame, overrides: str | None = None) -> DataFrame:
    """Guard rails, display rounding, confidence and the covariate map."""
    residual = F.col("predicted_residual_c")
    return scored.withColumns(
        {
            "target_variable": F.lit("temperature_2m_c"),
            "baseline_value": F.round("baseline_temp_c", 2),
            "downscaled_value": physics.downscaled_temperature(F.col("baseline_temp_c"), residual),
            "confidence_score": physics.confidence(residual),
            "covariates_used": covariate_map(overrides),
        }
    )


def downscale(features: DataFrame, registry: DataFrame | None = None, default_zone: str = catalogs.LIVE_ZONE, inputs: list[str] | None = None) -> DataFrame:
    """Predict residuals with the latest registered model of each row's zone, or the default zone's where there is none.

    One pass over the rows serves all models. Without a registry the analytic lapse rate is used.
    """
    if registry is None:
        return finish(residual_models.lapse_score(features))
    routed = model_registry.routed(features, registry, default_zone)
    scored = model_registry.predict(routed, inputs or residual_models.FEATURES_28, "model_path", "predicted_residual_c")
    return finish(residual_models.with_residual(scored, F.col("predicted_residual_c")))


def hourly_series(downscaled: DataFrame, key: list[str]) -> DataFrame:
    """The index input: baseline, 1 km value and the weather that spraying depends on."""
    rain = "rain_probability_pct" if "rain_probability_pct" in downscaled.columns else "precipitation_probability_pct"
    values = {
        "baseline_temp_c": F.col("baseline_temp_c"),
        "downscaled_temp_1km_c": F.col("downscaled_value"),
        "delta_t_c": F.col("downscaled_value") - F.col("baseline_temp_c"),
        "relative_humidity_pct": F.col("relative_humidity_2m_pct"),
        "wind_speed_kmh": F.col("wind_speed_10m_kmh"),
        "solar_radiation_w_m2": F.col("solar_radiation_w_m2"),
        "soil_moisture_m3m3": F.col("soil_moisture_0_to_7cm_m3m3"),
        "rain_probability_pct": F.coalesce(F.col(rain), F.lit(0.0)),
    }
    return downscaled.select(
        *key, "timestamp", *[F.round(v, SERIES_DIGITS[n]).alias(n) for n, v in values.items()]
    )


def series_summary(series: DataFrame, key: list[str]) -> DataFrame:
    return series.groupBy(*key).agg(
        F.count(F.lit(1)).alias("hours_evaluated"), F.avg("delta_t_c").alias("mean_delta_t_c")
    )


def point_forecast(features: DataFrame, places: DataFrame, key: list[str]) -> DataFrame:
    """One row per place: zone, horizon, mean shift and the stress indices of its series.

    `features` are serving features already cut to the horizon (at most 168 rows per place).
    """
    series = hourly_series(downscale(features), key)
    report = indices.indices(series, key, short=True)
    routed = spatial.route(places.select(*key, "latitude", "longitude"))
    return routed.join(report, key).withColumnRenamed("hours", "hours_evaluated")
