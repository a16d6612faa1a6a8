"""Featured tables for training and serving, and downscaled forecasts."""

from __future__ import annotations

from pyspark.sql import functions as F

from fieldcast.operators import baselines, residual_models
from fieldcast.plans import features, fleet, forecasts
from fieldcast.registry import tables as t
from fieldcast.registry.base import query
from fieldcast.registry.index_queries import REPORT, STRESS_SQL, WINDOWS_SQL, FIRST_SQL
from fieldcast.registry.scalar_queries import CYCLES, LOCAL_SQL, SCORE, SPRAYABLE, vpd
from fieldcast.registry.terrain_queries import FRACTIONS_SQL, RADII, SAMPLED_SQL, lattice_sql, sample_sql
from fieldcast.registry.window_queries import ORDER

c = F.col
ID = "point_id:s timestamp:t"
POINTS_ONLY = "points AS (SELECT DISTINCT zone_id, point_id, point_no, latitude, longitude, elevation_m FROM obs)"
INVERSION = (
    "greatest(0.0e0, -delta_elevation_m) / greatest(0.5e0, wind_speed_10m_kmh) * (1 - least(1.0e0, greatest(0.0e0, solar_radiation_w_m2 / 1000.0e0))) "
    "AS nocturnal_inversion_index"
)
SLOPED = "solar_radiation_w_m2 / 1000.0e0 * (1 + sin(radians(slope_magnitude_deg)) * (aspect_sin * hour_sin + aspect_cos * hour_cos)) AS sloped_solar_insolation"


def base_features(source: str, lag: bool = True) -> str:
    """Columns every training table has, over a table with baselines."""
    change = f", coalesce(baseline_temp_c - lag(baseline_temp_c, 3) OVER {ORDER}, 0) AS thermal_inertia_lag_3h" if lag else ""
    return f"""centred AS (SELECT *, elevation_m - avg(elevation_m) OVER (PARTITION BY zone_id) AS delta_elevation_m FROM {source}),
featured AS (SELECT *, delta_elevation_m * -0.0065e0 AS theoretical_lapse_delta_c, temperature_2m_c - baseline_temp_c AS residual_anomaly_c, hour(timestamp) AS hour,
  dayofyear(timestamp) AS day_of_year, {CYCLES}, {vpd('baseline_temp_c', 'relative_humidity_2m_pct')} AS vapor_pressure_deficit_kpa, {INVERSION},
  greatest(0.0e0, solar_radiation_w_m2) / 1000.0e0 * greatest(0.0e0, -cos(2 * pi() * hour(timestamp) / 24.0e0)) AS solar_heating_interaction{change} FROM centred)"""


TRAIN_SQL = f"{t.BASED_SQL}, {base_features('based')}"
SINGLE = (
    "delta_elevation_m:d theoretical_lapse_delta_c:d baseline_temp_c:d residual_anomaly_c:d hour:i day_of_year:i hour_sin:d hour_cos:d doy_sin:d doy_cos:d "
    "vapor_pressure_deficit_kpa:d nocturnal_inversion_index:d solar_heating_interaction:d thermal_inertia_lag_3h:d"
)
FULL_SQL = f"""{TRAIN_SQL}, {POINTS_ONLY}, {lattice_sql('0.28e0')},
complete AS (SELECT *, {SLOPED}, soil_temperature_0_to_7cm_c - baseline_temp_c AS soil_air_thermal_gradient, et0_evapotranspiration_mm * vapor_pressure_deficit_kpa AS latent_cooling_potential
  FROM featured JOIN (SELECT zone_id, point_id, topographic_position_index, slope_magnitude_deg, aspect_sin, aspect_cos FROM lattice) USING (zone_id, point_id))"""
ALL_28 = " ".join(f"{x}:d" for x in residual_models.FEATURES_28)


@query("d1_training_features", f"{ID} {SINGLE}", f"WITH {TRAIN_SQL} SELECT * FROM featured")
def _(spark, sf):
    return features.engineer_features(t.obs(spark, sf))


@query("p2_model_inputs", f"{ID} {ALL_28}", f"WITH {FULL_SQL} SELECT * FROM complete")
def _(spark, sf):
    obs = t.obs(spark, sf)
    rows = features.complete_features(features.engineer_features(obs), stations=features.station_list(obs))
    return rows.select("point_id", "timestamp", *residual_models.FEATURES_28)


@query("p3_missing_inputs_only", f"{ID} vapor_pressure_deficit_kpa:d latent_cooling_potential:d thermal_inertia_lag_3h:d slope_magnitude_deg:d",
       f"""WITH {FULL_SQL} SELECT point_id, timestamp, 1.5e0 AS vapor_pressure_deficit_kpa, et0_evapotranspiration_mm * 1.5e0 AS latent_cooling_potential, thermal_inertia_lag_3h, slope_magnitude_deg FROM complete""")
def _(spark, sf):
    obs = t.obs(spark, sf)
    rows = features.engineer_features(obs).withColumn("vapor_pressure_deficit_kpa", F.lit(1.5))
    return features.complete_features(rows, stations=features.station_list(obs))


MULTI_SQL = f"""{LOCAL_SQL}, {POINTS_ONLY}, {lattice_sql('0.28e0')}, {base_features('based')},
complete AS (SELECT *, {SLOPED}, soil_temperature_0_to_7cm_c - baseline_temp_c AS soil_air_thermal_gradient, et0_evapotranspiration_mm * vapor_pressure_deficit_kpa AS latent_cooling_potential,
  soil_moisture_0_to_7cm_m3m3 - baseline_soil_moisture_m3m3 AS residual_soil_moisture_m3m3, vpd_local_kpa - baseline_vpd_kpa AS residual_vpd_kpa,
  wind_speed_10m_kmh - baseline_wind_speed_kmh AS residual_wind_speed_kmh,
  sum(precipitation_mm) OVER (PARTITION BY zone_id, point_id ORDER BY timestamp ROWS BETWEEN 167 PRECEDING AND CURRENT ROW) AS antecedent_precipitation_7d_mm,
  coalesce(lag(soil_moisture_0_to_7cm_m3m3, 24) OVER {ORDER}, first_value(soil_moisture_0_to_7cm_m3m3) OVER {ORDER}) AS soil_moisture_lag_24h_m3m3,
  sum(greatest(0.0e0, (temperature_2m_c - 10) / 24)) OVER (PARTITION BY zone_id, point_id, year(timestamp) ORDER BY timestamp ROWS UNBOUNDED PRECEDING) AS accumulated_gdd_c,
  et0_evapotranspiration_mm * vapor_pressure_deficit_kpa * solar_radiation_w_m2 / 1000.0e0 AS evaporative_demand, precipitation_mm / (slope_magnitude_deg + 1) AS infiltration_potential,
  greatest(0.0e0, -topographic_position_index) * relative_humidity_2m_pct / 100.0e0 AS valley_dew_potential, greatest(0.0e0, topographic_position_index) * wind_speed_10m_kmh / 10.0e0 AS ridge_wind_acceleration
  FROM featured JOIN (SELECT zone_id, point_id, topographic_position_index, slope_magnitude_deg, aspect_sin, aspect_cos FROM lattice) USING (zone_id, point_id))"""
MEMORY = (
    "antecedent_precipitation_7d_mm:d soil_moisture_lag_24h_m3m3:d accumulated_gdd_c:d evaporative_demand:d infiltration_potential:d valley_dew_potential:d "
    "ridge_wind_acceleration:d"
)


@query("d2_multitarget_features", f"{ID} {ALL_28} {MEMORY} " + " ".join(f"{r}:d" for r in baselines.RESIDUALS), f"WITH {MULTI_SQL} SELECT * FROM complete")
def _(spark, sf):
    return features.engineer_multitarget(t.obs(spark, sf))


# The raster is laid over the first zone, so that some stations are measured and others are not.
SHIFTED_DEM = t.DEM_SQL.replace("73.0e0", "76.0e0").replace("74.0e0", "77.0e0").replace("24.0e0", "31.0e0").replace("25.0e0", "32.0e0")
ZONE_SQL = f"""{LOCAL_SQL}, {POINTS_ONLY}, {base_features('based', lag=False)}, locations AS (SELECT point_id AS location_id, latitude, longitude, elevation_m FROM points), {SHIFTED_DEM},
{sample_sql(FRACTIONS_SQL)}, {SAMPLED_SQL}, {lattice_sql('0.45e0')},
ground AS (SELECT l.zone_id, l.point_id, CASE WHEN s.slope_magnitude_deg IS NULL THEN l.topographic_position_index ELSE s.tpi_9000m END AS topographic_position_index,
  coalesce(s.slope_magnitude_deg, l.slope_magnitude_deg) AS slope_magnitude_deg, CASE WHEN s.slope_magnitude_deg IS NULL THEN l.aspect_sin ELSE s.aspect_sin END AS aspect_sin,
  CASE WHEN s.slope_magnitude_deg IS NULL THEN l.aspect_cos ELSE s.aspect_cos END AS aspect_cos FROM lattice l JOIN sampled s ON s.location_id = l.point_id),
complete AS (SELECT * EXCLUDE (nocturnal_inversion_index), {SLOPED}, soil_temperature_0_to_7cm_c - baseline_temp_c AS soil_air_thermal_gradient,
  et0_evapotranspiration_mm * soil_moisture_0_to_7cm_m3m3 AS latent_cooling_potential,
  CASE WHEN hour >= 20 OR hour <= 6 THEN baseline_temp_c - soil_temperature_0_to_7cm_c ELSE 0 END AS nocturnal_inversion_index FROM featured JOIN ground USING (zone_id, point_id))"""
ZONE_COLUMNS = (
    "topographic_position_index:d slope_magnitude_deg:d aspect_sin:d aspect_cos:d baseline_temp_c:d baseline_vpd_kpa:d vapor_pressure_deficit_kpa:d sloped_solar_insolation:d "
    "soil_air_thermal_gradient:d latent_cooling_potential:d nocturnal_inversion_index:d residual_anomaly_c:d"
)


def shifted_tiles(spark, sf):
    edges = {"west": 3.0, "east": 3.0, "south": 7.0, "north": 7.0}
    return t.tiles(spark, sf).withColumns({e: c(e) + d for e, d in edges.items()})


@query("d3_zone_features", f"{ID} {ZONE_COLUMNS}", f"WITH {ZONE_SQL} SELECT * FROM complete")
def _(spark, sf):
    return features.engineer_zone_features(t.obs(spark, sf), t.dem(spark, sf), shifted_tiles(spark, sf), RADII)


# --- serving -----------------------------------------------------------------------------
SERVING_SQL = f"""{t.OBS_SQL}, {POINTS_ONLY}, {lattice_sql('0.45e0')},
gaps AS (SELECT * REPLACE (CASE WHEN k % 6 <> 0 THEN temperature_2m_c END AS temperature_2m_c, CASE WHEN k % 5 <> 0 THEN et0_evapotranspiration_mm END AS et0_evapotranspiration_mm,
  CASE WHEN k % 8 <> 0 THEN relative_humidity_2m_pct END AS relative_humidity_2m_pct) FROM obs),
lagged AS (SELECT *, coalesce(CASE WHEN row_number() OVER w > 3 AND temperature_2m_c - lag(temperature_2m_c, 3) OVER w IS NOT NULL THEN temperature_2m_c - lag(temperature_2m_c, 3) OVER w
  WHEN row_number() OVER w > 1 THEN temperature_2m_c - first_value(temperature_2m_c) OVER w END, 0) AS thermal_inertia_lag_3h FROM gaps WINDOW w AS {ORDER}),
filled AS (SELECT * REPLACE (coalesce(temperature_2m_c, 28) AS temperature_2m_c, coalesce(et0_evapotranspiration_mm, 0.1e0) AS et0_evapotranspiration_mm,
  coalesce(relative_humidity_2m_pct, 65) AS relative_humidity_2m_pct), coalesce(temperature_2m_c, 28) AS baseline_temp_c, elevation_m - 380 AS delta_elevation_m, {CYCLES} FROM lagged),
serving AS (SELECT *, delta_elevation_m * -0.0065e0 AS theoretical_lapse_delta_c, {vpd('baseline_temp_c', 'relative_humidity_2m_pct')} AS vapor_pressure_deficit_kpa, {INVERSION},
  greatest(0.0e0, solar_radiation_w_m2) / 1000.0e0 * greatest(0.0e0, -hour_cos) AS solar_heating_interaction, {SLOPED}, soil_temperature_0_to_7cm_c - baseline_temp_c AS soil_air_thermal_gradient,
  et0_evapotranspiration_mm * {vpd('baseline_temp_c', 'relative_humidity_2m_pct')} AS latent_cooling_potential
  FROM filled JOIN (SELECT zone_id, point_id, topographic_position_index, slope_magnitude_deg, aspect_sin, aspect_cos FROM lattice) USING (zone_id, point_id))"""


def serving(spark, sf, hours=None):
    from fieldcast.operators import spatial

    rows = t.obs(spark, sf)
    gaps = rows.withColumns(
        {
            "temperature_2m_c": F.when(c("k") % 6 != 0, c("temperature_2m_c")),
            "et0_evapotranspiration_mm": F.when(c("k") % 5 != 0, c("et0_evapotranspiration_mm")),
            "relative_humidity_2m_pct": F.when(c("k") % 8 != 0, c("relative_humidity_2m_pct")),
        }
    )
    ground = spatial.lattice_terrain(features.station_list(rows), spatial.FLEET_RADIUS_DEG, ["zone_id"])
    return features.serving_features(gaps, features.POINT, ground, hours=hours)


@query("d4_serving_features", f"{ID} {ALL_28}", f"WITH {SERVING_SQL} SELECT * FROM serving")
def _(spark, sf):
    return serving(spark, sf)


DOWN_SQL = f"""{SERVING_SQL},
down AS (SELECT *, round(baseline_temp_c, 2) AS baseline_value, round(baseline_temp_c + least(12.0e0, greatest(-12.0e0, delta_elevation_m * -0.0065e0)), 2) AS downscaled_value,
  delta_elevation_m * -0.0065e0 AS predicted_residual_c, round(least(0.99e0, greatest(0.7e0, 1 - abs(delta_elevation_m * -0.0065e0) / 30)) , 3) AS confidence_score FROM serving)"""


@query("d5_downscaled_forecast", f"{ID} baseline_value:d downscaled_value:d predicted_residual_c:d confidence_score:d", f"WITH {DOWN_SQL} SELECT * FROM down")
def _(spark, sf):
    return forecasts.downscale(serving(spark, sf))


HOUR_SERIES = """short AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY zone_id, point_id ORDER BY timestamp) AS nth FROM down) WHERE nth <= 48),
series AS (SELECT zone_id, point_id, timestamp, round(baseline_temp_c, 2) AS baseline_temp_c, downscaled_value AS downscaled_temp_1km_c, round(downscaled_value - baseline_temp_c, 2) AS delta_t_c,
  relative_humidity_2m_pct AS relative_humidity_pct, wind_speed_10m_kmh AS wind_speed_kmh, rain_probability_pct FROM short)"""
NO_SERIES_STRESS = STRESS_SQL.format(base="10", limit="38")[len(t.SERIES_SQL) + 1:]
FLAG_SQL = f"""flagged AS (SELECT *, {SCORE} AS suitability, ({SPRAYABLE}) AND {SCORE} >= 65 AS good, row_number() OVER {ORDER} AS rn FROM series),
islands AS (SELECT *, rn - row_number() OVER (PARTITION BY zone_id, point_id, good ORDER BY timestamp) AS window_id FROM flagged)"""


@query("d8_point_forecast", f"point_id:s latitude:d longitude:d in_exact_bounds:b hours_evaluated:i mean_delta_t_c:d {REPORT.replace('hours:i ', '', 1)}",
       f"""WITH {DOWN_SQL}, {HOUR_SERIES}, {NO_SERIES_STRESS}, {FLAG_SQL}, {WINDOWS_SQL}, {FIRST_SQL},
       mean_shift AS (SELECT zone_id, point_id, count(*) AS hours_evaluated, avg(delta_t_c) AS mean_delta_t_c FROM series GROUP BY 1, 2)
       SELECT points.point_id, latitude, longitude, TRUE AS in_exact_bounds, stress.* EXCLUDE (zone_id, point_id), gdd_accumulated_c_days, coalesce(spray_windows, 0) AS spray_windows, first_window_start,
         first_window_hours, first_window_score, hours_evaluated, mean_delta_t_c
       FROM points JOIN stress USING (zone_id, point_id) JOIN gdd USING (zone_id, point_id) JOIN mean_shift USING (zone_id, point_id) LEFT JOIN first_window USING (zone_id, point_id)""")
def _(spark, sf):
    places = t.points(spark, sf).select("point_id", "latitude", "longitude")
    return forecasts.point_forecast(serving(spark, sf, 48), places, ["point_id"])


@query("d22_dataset_manifest", "dataset_name:s start_time:t end_time:t spatial_points:i min_latitude:d max_latitude:d total_rows:i total_columns:i null_values:i max_abs_residual_c:d",
       f"""WITH {TRAIN_SQL} SELECT 'single_target' AS dataset_name, min(timestamp) AS start_time, max(timestamp) AS end_time, count(DISTINCT point_id) AS spatial_points, min(latitude) AS min_latitude,
       max(latitude) AS max_latitude, count(*) AS total_rows, 35 AS total_columns, 0 AS null_values, max(abs(residual_anomaly_c)) AS max_abs_residual_c FROM featured""")
def _(spark, sf):
    return fleet.dataset_manifest(features.engineer_features(t.obs(spark, sf)), "single_target")
