"""Featured tables for training and serving."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldcast.functions import physics
from fieldcast.operators.keys import meet
from fieldcast.operators import baselines, spatial, terrain, timeseries
from fieldcast.operators.quality import add_missing, drop_incomplete, serving_defaults
from fieldcast.session import settle

POINT = ["zone_id", "point_id"]
DOMAIN_HOUR = ["zone_id", "timestamp"]
TERRAIN = ["topographic_position_index", "slope_magnitude_deg", "aspect_sin", "aspect_cos"]


def _weather_interactions(temp: str = "baseline_temp_c") -> dict[str, Column]:
    return {
        "vapor_pressure_deficit_kpa": physics.vapour_pressure_deficit(F.col(temp), F.col("relative_humidity_2m_pct")),
        "nocturnal_inversion_index": physics.nocturnal_inversion(
            F.col("delta_elevation_m"), F.col("wind_speed_10m_kmh"), F.col("solar_radiation_w_m2")
        ),
        "solar_heating_interaction": physics.solar_heating(F.col("solar_radiation_w_m2"), F.col("hour_cos")),
    }


def _surface_interactions(variant: str = "standard") -> dict[str, Column]:
    """Slope, soil and evaporation terms. The fleet variant cools by soil moisture."""
    wet = "vapor_pressure_deficit_kpa" if variant == "standard" else "soil_moisture_0_to_7cm_m3m3"
    return {
        "sloped_solar_insolation": physics.sloped_insolation(
            F.col("solar_radiation_w_m2"), F.col("slope_magnitude_deg"), F.col("aspect_sin"), F.col("aspect_cos"),
            F.col("hour_sin"), F.col("hour_cos"),
        ),
        "soil_air_thermal_gradient": F.col("soil_temperature_0_to_7cm_c") - F.col("baseline_temp_c"),
        "latent_cooling_potential": F.col("et0_evapotranspiration_mm") * F.col(wet),
    }


def _extended_interactions() -> dict[str, Column]:
    return {
        "evaporative_demand": physics.evaporative_demand(
            F.col("et0_evapotranspiration_mm"), F.col("vapor_pressure_deficit_kpa"), F.col("solar_radiation_w_m2")
        ),
        "infiltration_potential": physics.infiltration_potential(
            F.col("precipitation_mm"), F.col("slope_magnitude_deg")
        ),
        "valley_dew_potential": physics.valley_dew(
            F.col("topographic_position_index"), F.col("relative_humidity_2m_pct")
        ),
        "ridge_wind_acceleration": physics.ridge_wind(
            F.col("topographic_position_index"), F.col("wind_speed_10m_kmh")
        ),
    }


def station_list(obs: DataFrame) -> DataFrame:
    return obs.select(*POINT, "latitude", "longitude", "elevation_m").distinct()


def with_terrain(df: DataFrame, points: DataFrame, also: list[str] | None = None) -> DataFrame:
    """Attach per-point terrain; a point without any gets the neutral values.

    `also` names further per-point columns that ride along, to save a join of the rows.
    """
    neutral = dict(zip(TERRAIN, spatial.NO_NEIGHBOURS.values()))
    joined = meet(df, points.select(*POINT, *TERRAIN, *(also or [])), POINT)
    return joined.withColumns({c: F.coalesce(c, F.lit(v)) for c, v in neutral.items()})


def with_domain(rows: DataFrame, source: DataFrame | None = None) -> DataFrame:
    return baselines.with_elevation_delta(rows, source).withColumn(
        "theoretical_lapse_delta_c", physics.lapse_delta(F.col("delta_elevation_m"))
    )


def _with_local_vpd(obs: DataFrame, targets: dict[str, str]) -> DataFrame:
    if "vpd_local_kpa" not in targets:
        return obs
    local = physics.vapour_pressure_deficit(F.col("temperature_2m_c"), F.col("relative_humidity_2m_pct"))
    return obs.withColumn("vpd_local_kpa", local)


def with_baselines(
    obs: DataFrame, targets: dict[str, str] = baselines.TARGETS, source: DataFrame | None = None
) -> DataFrame:
    """Leave-one-out baselines and residuals; `source` are the untouched observations."""
    slim = None if source is None else _with_local_vpd(source, targets)
    based = baselines.leave_one_out(_with_local_vpd(obs, targets), DOMAIN_HOUR, targets, slim)
    names = [n for n, (own, _) in baselines.RESIDUALS.items() if own in targets]
    return baselines.residuals(based, names)


def engineer_features(obs: DataFrame) -> DataFrame:
    """Single-target training table: baseline, residual, cycles, interactions, 3-row lag."""
    rows = timeseries.number_rows(obs, POINT, "timestamp", "_row_no")
    rows = with_baselines(with_domain(rows, obs), baselines.TEMPERATURE_ONLY, obs)
    rows = rows.withColumns(physics.calendar_columns(F.col("timestamp")))
    rows = rows.withColumns(_weather_interactions())
    lag = {"thermal_inertia_lag_3h": timeseries.difference("baseline_temp_c", 3)}
    rows = timeseries.near_rows(rows, POINT, "timestamp", lag, back=3, numbered="_row_no")
    return drop_incomplete(rows.drop("domain_mean_elevation_m", "_row_no"))


def engineer_multitarget(obs: DataFrame, radius: float = spatial.TRAINING_RADIUS_DEG, fill: bool = True) -> DataFrame:
    """Multi-target training table with terrain, memory terms and extended interactions.

    Filling the gaps passes over the finished rows again, so they are settled first; with
    `fill=False` nothing runs and the gaps stay.
    """
    # Row numbers and year-to-date degree days share one pass over the months.
    rows = timeseries.running_totals(
        obs, POINT, "timestamp", {"_row_no": F.lit(1).cast("bigint")},
        {"accumulated_gdd_c": F.coalesce(physics.hourly_degree_share(F.col("temperature_2m_c")), F.lit(0.0))},
    )
    rows = with_baselines(with_domain(rows, obs), source=obs)
    rows = rows.withColumns(physics.calendar_columns(F.col("timestamp")))
    heads = timeseries.first_known(obs, POINT, "timestamp", {"_head": "soil_moisture_0_to_7cm_m3m3"})
    ground = meet(spatial.lattice_terrain(station_list(obs), radius, ["zone_id"]), heads, POINT)
    rows = with_terrain(rows, ground, ["_head"])
    rows = rows.withColumns(_weather_interactions()).withColumns(_surface_interactions())
    memory = {
        "thermal_inertia_lag_3h": timeseries.difference("baseline_temp_c", 3),
        "antecedent_precipitation_7d_mm": timeseries.trailing_sum("precipitation_mm", 168),
        "_moisture_24h": lambda w: F.lag("soil_moisture_0_to_7cm_m3m3", 24).over(w),
    }
    rows = timeseries.near_rows(rows, POINT, "timestamp", memory, back=168, numbered="_row_no")
    rows = rows.withColumn("soil_moisture_lag_24h_m3m3", F.coalesce("_moisture_24h", "_head"))
    rows = rows.drop("_moisture_24h", "_head", "_row_no", "domain_mean_elevation_m")
    rows = rows.withColumns(_extended_interactions())
    if not fill:
        return rows
    return fill_gaps(settle(rows))


def fill_gaps(stored: DataFrame) -> DataFrame:
    """Fill the unknown numbers of a stored table within each station.

    One pass counts the gaps; only columns that have any are ordered and filled.
    """
    numbers = [f.name for f in stored.schema if f.dataType.typeName() == "double"]
    counts = stored.agg(*[F.count_if(F.col(n).isNull()).alias(n) for n in numbers]).first()
    gaps = [n for n in numbers if counts[n]]
    return timeseries.fill_within(stored, POINT, "timestamp", gaps) if gaps else stored


def engineer_zone_features(
    obs: DataFrame, dem: DataFrame | None = None, tiles: DataFrame | None = None,
    radii: tuple[float, float] = terrain.TPI_RADII_M,
) -> DataFrame:
    """Fleet training table: raster terrain where a tile covers the station, else the lattice."""
    return finish_zone_features(with_baselines(obs, source=obs), dem, tiles, radii, obs)


def finish_zone_features(
    based: DataFrame, dem: DataFrame | None = None, tiles: DataFrame | None = None, radii: tuple[float, float] = terrain.TPI_RADII_M, source: DataFrame | None = None
) -> DataFrame:
    """The rest of the fleet training table for hours that have their baselines; `source` are the same hours before that work."""
    source = based if source is None else source
    rows = with_domain(based, source).withColumns(physics.calendar_columns(F.col("timestamp")))
    stations = station_list(source)
    ground = spatial.lattice_terrain(stations, spatial.FLEET_RADIUS_DEG, ["zone_id"])
    if dem is not None:
        raster = terrain.sample_terrain(stations, dem, tiles, radii)
        ground = terrain.with_lattice_fallback(raster, ground, POINT)
    rows = with_terrain(rows, ground)
    rows = rows.withColumn("vapor_pressure_deficit_kpa", _weather_interactions()["vapor_pressure_deficit_kpa"])
    rows = rows.withColumns(_surface_interactions("fleet"))
    return rows.withColumn(
        "nocturnal_inversion_index",
        physics.night_soil_inversion(
            F.col("timestamp"), F.col("baseline_temp_c"), F.col("soil_temperature_0_to_7cm_c")
        ),
    ).drop("domain_mean_elevation_m")


def domain_lag(rows: DataFrame) -> DataFrame:
    """3-step change of the hourly domain mean, attached to every row of that hour."""
    means = baselines.hourly_mean(rows, "baseline_temp_c", "_mean")
    lagged = timeseries.near_rows(
        means, ["zone_id"], "timestamp", {"thermal_inertia_lag_3h": timeseries.difference("_mean", 3)}, back=3
    )
    return meet(rows, lagged.drop("_mean"), DOMAIN_HOUR)


def complete_features(
    rows: DataFrame, radius: float = spatial.TRAINING_RADIUS_DEG, stations: DataFrame | None = None
) -> DataFrame:
    """Add whichever model input is missing, then treat unknown numbers as zero.

    `stations` saves a pass over `rows` when the station list is at hand.
    """
    temp = "baseline_temp_c" if "baseline_temp_c" in rows.columns else "temperature_2m_c"
    rows = add_missing(rows, _weather_interactions(temp))
    if "thermal_inertia_lag_3h" not in rows.columns:
        rows = domain_lag(rows) if temp == "baseline_temp_c" else rows.withColumn("thermal_inertia_lag_3h", F.lit(0.0))
    if any(c not in rows.columns for c in TERRAIN):
        listed = station_list(rows) if stations is None else stations
        rows = with_terrain(rows.drop(*TERRAIN), spatial.lattice_terrain(listed, radius, ["zone_id"]))
    return add_missing(rows, _surface_interactions()).na.fill(0.0)


def serving_features(
    forecast: DataFrame, key: list[str], terrain_rows: DataFrame | None = None, covariates: str | None = None,
    domain_mean: float = physics.DEFAULT_DOMAIN_ELEVATION_M, hours: int | None = None,
) -> DataFrame:
    """Model inputs of a forecast series, with defaults for what the forecast lacks.

    `terrain_rows` has the key, a 2 km position index, slope and aspect components. `hours`
    keeps the first rows only, trimmed before they meet; what is left is short. Without it a
    series may be of any length and is worked on in blocks.
    """
    short = hours is not None
    rows = timeseries.first_rows(forecast, key, "timestamp", hours) if short else timeseries.number_rows(forecast, key, "timestamp", "_row_no")
    if short:
        rows = timeseries.near_rows(rows, key, "timestamp", {"_start": lambda w: F.first("temperature_2m_c").over(w)}, short=True)
    else:
        begun = rows.filter("_row_no = 1").select(*key, F.col("temperature_2m_c").alias("_start"))
        rows = meet(rows, begun, key)
    lag = {"thermal_inertia_lag_3h": timeseries.forecast_lag("temperature_2m_c", "_row_no", "_start")}
    rows = timeseries.near_rows(rows, key, "timestamp", lag, back=3, numbered="_row_no", short=short).drop("_row_no", "_start")
    rows = serving_defaults(rows, covariates)
    neutral = dict(zip(TERRAIN, spatial.NO_NEIGHBOURS.values()))
    if terrain_rows is not None:
        rows = rows.join(terrain_rows.select(*key, *TERRAIN), key, "left")
    rows = rows.withColumns(
        {c: F.coalesce(F.col(c), F.lit(v)) if terrain_rows is not None else F.lit(v) for c, v in neutral.items()}
    )
    rows = rows.withColumn("baseline_temp_c", F.col("temperature_2m_c"))
    rows = rows.withColumn("elevation_m", F.coalesce("elevation_m", F.lit(domain_mean)))
    rows = rows.withColumn("delta_elevation_m", F.col("elevation_m") - domain_mean)
    rows = rows.withColumn("theoretical_lapse_delta_c", physics.lapse_delta(F.col("delta_elevation_m")))
    rows = rows.withColumns(physics.calendar_columns(F.col("timestamp")))
    return rows.withColumns(_weather_interactions()).withColumns(_surface_interactions())
