"""Scalar functions over the hourly, daily, raster and text tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from fieldcast.functions import physics, spraying, text
from fieldcast.operators import baselines, residual_models, spatial
from fieldcast.plans import advisory, features, forecasts
from fieldcast.registry import tables as t
from fieldcast.registry.base import query
from fieldcast.schemas import EXTRACTION
from fieldcast.sources import rasters

ID = "point_id:s timestamp:t"


def svp(x: str) -> str:
    return f"0.61078e0 * exp(17.27e0 * {x} / ({x} + 237.3e0))"


def vpd(x: str, rh: str, floor: str = "1.0e0") -> str:
    return f"greatest(0.0e0, {svp(x)} - {svp(x)} * least(100.0e0, greatest({floor}, {rh})) / 100.0e0)"


def obs_query(name: str, columns: str, select: str, source: str = "obs", ctes: str | None = None):
    return query(name, f"{ID} {columns}", f"WITH {ctes or t.OBS_SQL} SELECT point_id, timestamp, {select} FROM {source}")


def keep(df, **columns):
    return df.select("point_id", "timestamp", *[v.alias(k) for k, v in columns.items()])


c = F.col


@obs_query("f1_saturation_vapour_pressure", "es_kpa:d", f"{svp('temperature_2m_c')} AS es_kpa")
def _(spark, sf):
    return keep(t.obs(spark, sf), es_kpa=physics.saturation_vapour_pressure(c("temperature_2m_c")))


@obs_query(
    "f2_vapour_pressure_deficit", "vpd_training:d vpd_index:d",
    f"{vpd('temperature_2m_c', 'relative_humidity_2m_pct - 2')} AS vpd_training, "
    f"{vpd('temperature_2m_c', 'relative_humidity_2m_pct - 2', '0.0e0')} AS vpd_index",
)
def _(spark, sf):
    dry = c("relative_humidity_2m_pct") - 2
    return keep(
        t.obs(spark, sf),
        vpd_training=physics.vapour_pressure_deficit(c("temperature_2m_c"), dry),
        vpd_index=physics.vapour_pressure_deficit(c("temperature_2m_c"), dry, 0.0),
    )


@obs_query(
    "f3_leak_free_vpd", "vpd_local_kpa:d vapor_pressure_deficit_kpa:d",
    f"{vpd('temperature_2m_c', 'relative_humidity_2m_pct')} AS vpd_local_kpa, "
    f"{vpd('baseline_temp_c', 'relative_humidity_2m_pct')} AS vapor_pressure_deficit_kpa",
    "based", t.BASED_SQL,
)
def _(spark, sf):
    rows = features.with_baselines(t.obs(spark, sf))
    return keep(
        rows, vpd_local_kpa=c("vpd_local_kpa"),
        vapor_pressure_deficit_kpa=physics.vapour_pressure_deficit(c("baseline_temp_c"), c("relative_humidity_2m_pct")),
    )


@obs_query(
    "f4_lapse_adjustment", "delta_elevation_m:d theoretical_lapse_delta_c:d",
    "elevation_m - m AS delta_elevation_m, (elevation_m - m) * -0.0065e0 AS theoretical_lapse_delta_c",
    "obs JOIN (SELECT zone_id, avg(elevation_m) AS m FROM obs GROUP BY 1) USING (zone_id)",
)
def _(spark, sf):
    return features.with_domain(t.obs(spark, sf))


ALL_TARGETS = {c_: b for c_, b in baselines.TARGETS.items()}
LOCAL_SQL = f"""{t.OBS_SQL},
local AS (SELECT *, {vpd('temperature_2m_c', 'relative_humidity_2m_pct')} AS vpd_local_kpa FROM obs),
based AS ({t.loo_sql('local', ALL_TARGETS)})"""


@obs_query(
    "f5_residual_targets", " ".join(f"{r}:d" for r in baselines.RESIDUALS),
    ", ".join(f"{own} - {base} AS {r}" for r, (own, base) in baselines.RESIDUALS.items()), "based", LOCAL_SQL,
)
def _(spark, sf):
    return features.with_baselines(t.obs(spark, sf))


CYCLES = (
    "sin(2 * pi() * hour(timestamp) / 24.0e0) AS hour_sin, cos(2 * pi() * hour(timestamp) / 24.0e0) AS hour_cos, "
    "sin(2 * pi() * dayofyear(timestamp) / 365.25e0) AS doy_sin, cos(2 * pi() * dayofyear(timestamp) / 365.25e0) AS doy_cos"
)


@obs_query(
    "f6_calendar_cycles", "hour:i day_of_year:i hour_sin:d hour_cos:d doy_sin:d doy_cos:d",
    f"hour(timestamp) AS hour, dayofyear(timestamp) AS day_of_year, {CYCLES}",
)
def _(spark, sf):
    return t.obs(spark, sf).withColumns(physics.calendar_columns(c("timestamp")))


@query(
    "f6b_hour_angle_with_minutes", "event_id:i hour_sin:d hour_cos:d",
    "SELECT event_id, sin(2 * pi() * (hour(ts) + minute(ts) / 60.0e0) / 24) AS hour_sin, "
    "cos(2 * pi() * (hour(ts) + minute(ts) / 60.0e0) / 24) AS hour_cos FROM events",
)
def _(spark, sf):
    angle = physics.hour_angle(c("ts"), with_minutes=True)
    return t.table(spark, sf, "events").select("event_id", F.sin(angle).alias("hour_sin"), F.cos(angle).alias("hour_cos"))


INVERSION = (
    "greatest(0.0e0, 381.0e0 - elevation_m) / greatest(0.5e0, wind_speed_10m_kmh) "
    "* (1 - least(1.0e0, greatest(0.0e0, solar_radiation_w_m2 / 1000.0e0)))"
)


@obs_query("f7_nocturnal_inversion", "nocturnal_inversion_index:d", f"{INVERSION} AS nocturnal_inversion_index")
def _(spark, sf):
    value = physics.nocturnal_inversion(c("elevation_m") - 381.0, c("wind_speed_10m_kmh"), c("solar_radiation_w_m2"))
    return keep(t.obs(spark, sf), nocturnal_inversion_index=value)


@obs_query(
    "f7b_night_soil_inversion", "nocturnal_inversion_index:d",
    "CASE WHEN hour(timestamp) >= 20 OR hour(timestamp) <= 6 THEN baseline_temp_c - soil_temperature_0_to_7cm_c ELSE 0.0e0 END "
    "AS nocturnal_inversion_index", "based", t.BASED_SQL,
)
def _(spark, sf):
    rows = baselines.leave_one_out(t.obs(spark, sf), features.DOMAIN_HOUR, baselines.TEMPERATURE_ONLY)
    value = physics.night_soil_inversion(c("timestamp"), c("baseline_temp_c"), c("soil_temperature_0_to_7cm_c"))
    return keep(rows, nocturnal_inversion_index=value)


HOUR_COS = "cos(2 * pi() * hour(timestamp) / 24.0e0)"
HOUR_SIN = "sin(2 * pi() * hour(timestamp) / 24.0e0)"


@obs_query(
    "f8_solar_heating", "solar_heating_interaction:d",
    f"greatest(0.0e0, solar_radiation_w_m2) / 1000.0e0 * greatest(0.0e0, -({HOUR_COS})) AS solar_heating_interaction",
)
def _(spark, sf):
    value = physics.solar_heating(c("solar_radiation_w_m2"), F.cos(physics.hour_angle(c("timestamp"))))
    return keep(t.obs(spark, sf), solar_heating_interaction=value)


# A slope and an aspect per station, derived from its number.
SLOPE, ASPECT = "(point_no % 30) * 1.0e0", "radians((point_no * 37) % 360)"


def slope_of(df):
    aspect = F.radians(((c("point_no") * 37) % 360).cast("double"))
    return (c("point_no") % 30) * 1.0, F.sin(aspect), F.cos(aspect)


@obs_query(
    "f9_sloped_insolation", "sloped_solar_insolation:d",
    f"solar_radiation_w_m2 / 1000.0e0 * (1 + sin(radians({SLOPE})) * (sin({ASPECT}) * {HOUR_SIN} + cos({ASPECT}) * {HOUR_COS})) "
    "AS sloped_solar_insolation",
)
def _(spark, sf):
    rows = t.obs(spark, sf)
    angle = physics.hour_angle(c("timestamp"))
    value = physics.sloped_insolation(c("solar_radiation_w_m2"), *slope_of(rows), F.sin(angle), F.cos(angle))
    return keep(rows, sloped_solar_insolation=value)


@obs_query(
    "f10_soil_air_gradient", "soil_air_thermal_gradient:d",
    "soil_temperature_0_to_7cm_c - baseline_temp_c AS soil_air_thermal_gradient", "based", t.BASED_SQL,
)
def _(spark, sf):
    rows = baselines.leave_one_out(t.obs(spark, sf), features.DOMAIN_HOUR, baselines.TEMPERATURE_ONLY)
    return keep(rows, soil_air_thermal_gradient=c("soil_temperature_0_to_7cm_c") - c("baseline_temp_c"))


@obs_query(
    "f11_latent_cooling", "by_deficit:d by_moisture:d",
    f"et0_evapotranspiration_mm * {vpd('baseline_temp_c', 'relative_humidity_2m_pct')} AS by_deficit, "
    "et0_evapotranspiration_mm * soil_moisture_0_to_7cm_m3m3 AS by_moisture", "based", t.BASED_SQL,
)
def _(spark, sf):
    rows = baselines.leave_one_out(t.obs(spark, sf), features.DOMAIN_HOUR, baselines.TEMPERATURE_ONLY)
    deficit = physics.vapour_pressure_deficit(c("baseline_temp_c"), c("relative_humidity_2m_pct"))
    et0 = c("et0_evapotranspiration_mm")
    return keep(rows, by_deficit=et0 * deficit, by_moisture=et0 * c("soil_moisture_0_to_7cm_m3m3"))


@obs_query(
    "f12_evaporative_demand", "evaporative_demand:d",
    f"et0_evapotranspiration_mm * {vpd('temperature_2m_c', 'relative_humidity_2m_pct')} * solar_radiation_w_m2 / 1000.0e0 AS evaporative_demand",
)
def _(spark, sf):
    deficit = physics.vapour_pressure_deficit(c("temperature_2m_c"), c("relative_humidity_2m_pct"))
    value = physics.evaporative_demand(c("et0_evapotranspiration_mm"), deficit, c("solar_radiation_w_m2"))
    return keep(t.obs(spark, sf), evaporative_demand=value)


@obs_query("f13_infiltration", "infiltration_potential:d", f"precipitation_mm / ({SLOPE} + 1) AS infiltration_potential")
def _(spark, sf):
    rows = t.obs(spark, sf)
    return keep(rows, infiltration_potential=physics.infiltration_potential(c("precipitation_mm"), slope_of(rows)[0]))


@obs_query(
    "f14_valley_and_ridge", "valley_dew_potential:d ridge_wind_acceleration:d",
    "greatest(0.0e0, 420.0e0 - elevation_m) * relative_humidity_2m_pct / 100.0e0 AS valley_dew_potential, "
    "greatest(0.0e0, elevation_m - 420.0e0) * wind_speed_10m_kmh / 10.0e0 AS ridge_wind_acceleration",
)
def _(spark, sf):
    tpi = c("elevation_m") - 420.0
    return keep(
        t.obs(spark, sf),
        valley_dew_potential=physics.valley_dew(tpi, c("relative_humidity_2m_pct")),
        ridge_wind_acceleration=physics.ridge_wind(tpi, c("wind_speed_10m_kmh")),
    )


@obs_query(
    "f15_clamped_downscaling", "downscaled_value:d",
    "round(baseline_temp_c + least(12.0e0, greatest(-12.0e0, temperature_2m_c - baseline_temp_c)) + 1e-9, 2) AS downscaled_value",
    "based", t.BASED_SQL,
)
def _(spark, sf):
    rows = baselines.leave_one_out(t.obs(spark, sf), features.DOMAIN_HOUR, baselines.TEMPERATURE_ONLY)
    residual = c("temperature_2m_c") - c("baseline_temp_c")
    return keep(rows, downscaled_value=physics.downscaled_temperature(c("baseline_temp_c") + 1e-9, residual))


@obs_query(
    "f16_confidence", "confidence_score:d",
    "round(least(0.99e0, greatest(0.7e0, 1 - abs(least(12.0e0, greatest(-12.0e0, temperature_2m_c - 25.0e0 + 1e-7))) / 30.0e0)), 3) AS confidence_score",
)
def _(spark, sf):
    return keep(t.obs(spark, sf), confidence_score=physics.confidence(c("temperature_2m_c") - 25.0 + 1e-7))


SCORE = """greatest(0.0e0, least(100.0e0, 95.0e0
  - CASE WHEN wind_speed_kmh > 14 THEN 50 WHEN wind_speed_kmh < 3 THEN 15 ELSE 0 END
  - CASE WHEN rain_probability_pct > 25 THEN 60 ELSE 0 END
  - CASE WHEN downscaled_temp_1km_c > 34 THEN 45 WHEN downscaled_temp_1km_c < 12 THEN 20 ELSE 0 END
  - CASE WHEN relative_humidity_pct > 90 THEN 15 ELSE 0 END))"""
SPRAYABLE = "NOT (wind_speed_kmh > 14 OR rain_probability_pct > 25 OR downscaled_temp_1km_c > 34)"


@obs_query("f17_spray_suitability", "suitability:d", f"{SCORE} AS suitability", "series", t.SERIES_SQL)
def _(spark, sf):
    args = [c(x) for x in ("downscaled_temp_1km_c", "relative_humidity_pct", "wind_speed_kmh", "rain_probability_pct")]
    return keep(t.series(spark, sf), suitability=spraying.suitability(*args))


@obs_query(
    "f18_sprayable_and_reason", "is_sprayable:b limiting:s",
    f"""{SPRAYABLE} AS is_sprayable,
    CASE WHEN relative_humidity_pct > 90 THEN 'High humidity (dew dilution / delayed drying)'
      WHEN downscaled_temp_1km_c > 34 THEN 'High temperature (' || printf('%.1f', round(downscaled_temp_1km_c + 1e-7, 1)) || '°C: droplet evaporation risk)'
      WHEN rain_probability_pct > 25 THEN 'Rain probability (' || printf('%.0f', rain_probability_pct) || '% > 25%: washout risk)'
      WHEN wind_speed_kmh > 14 THEN 'High wind (' || printf('%.1f', wind_speed_kmh) || ' km/h > 14 km/h: chemical drift risk)'
      WHEN wind_speed_kmh < 3 THEN 'Calm air (sub-optimal canopy penetration)' ELSE 'None' END AS limiting""",
    "series", t.SERIES_SQL,
)
def _(spark, sf):
    temp, humidity, wind, rain = [
        c(x) for x in ("downscaled_temp_1km_c", "relative_humidity_pct", "wind_speed_kmh", "rain_probability_pct")
    ]
    return keep(
        t.series(spark, sf), is_sprayable=spraying.sprayable(temp, wind, rain),
        limiting=spraying.limiting_reason(temp, humidity, wind, rain),
    )


@obs_query(
    "f19_soil_moisture_class", "moisture_status:s",
    f"CASE WHEN soil_moisture_0_to_7cm_m3m3 < 0.12e0 THEN '{advisory.DRY_TEXT}' WHEN soil_moisture_0_to_7cm_m3m3 < 0.22e0 "
    f"THEN '{advisory.MOIST_TEXT}' ELSE '{advisory.WET_TEXT}' END AS moisture_status",
)
def _(spark, sf):
    return keep(t.obs(spark, sf), moisture_status=advisory.moisture_status(c("soil_moisture_0_to_7cm_m3m3")))


METRES = {
    "m_per_deg_lon": "abs(111412.84e0 * cos(radians(latitude)) - 93.5e0 * cos(3 * radians(latitude)))",
    "m_per_deg_lat": "abs(111132.92e0 - 559.82e0 * cos(2 * radians(latitude)) + 1.175e0 * cos(4 * radians(latitude)))",
}


@query(
    "f20_metres_per_degree", "location_id:s m_per_deg_lon:d m_per_deg_lat:d",
    f"WITH {t.LOCATIONS_SQL} SELECT location_id, {', '.join(f'{v} AS {k}' for k, v in METRES.items())} FROM locations",
)
def _(spark, sf):
    lon, lat = physics.metres_per_degree(c("latitude"))
    return t.locations(spark, sf).select("location_id", lon.alias("m_per_deg_lon"), lat.alias("m_per_deg_lat"))


@query(
    "f21_aspect_components", "p_partkey:i aspect_sin:d aspect_cos:d",
    "SELECT p_partkey, CASE WHEN p_size % 5 = 0 THEN 0.0e0 ELSE sin(radians(p_size * 7.0e0)) END AS aspect_sin, "
    "CASE WHEN p_size % 5 = 0 THEN 0.0e0 ELSE cos(radians(p_size * 7.0e0)) END AS aspect_cos FROM part",
)
def _(spark, sf):
    aspect = F.when(c("p_size") % 5 != 0, c("p_size") * 7.0)
    sine, cosine = physics.aspect_components(aspect)
    return t.table(spark, sf, "part").select("p_partkey", sine.alias("aspect_sin"), cosine.alias("aspect_cos"))


NATION_BOXES = "SELECT c_nationkey, min(latitude) AS south, min(latitude) + 0.7e0 AS north, min(longitude) AS west, min(longitude) + 0.7e0 AS east FROM locations JOIN customer ON ordinal = c_custkey GROUP BY 1"


@query(
    "f22_box_lattice", "c_nationkey:i point_id:s latitude:d longitude:d",
    f"""WITH {t.LOCATIONS_SQL}, boxes AS ({NATION_BOXES}),
    sized AS (SELECT *, CAST(ceil((north + 0.07e0 - south) / 0.14e0) AS INTEGER) AS nr, CAST(ceil((east + 0.07e0 - west) / 0.14e0) AS INTEGER) AS nc FROM boxes),
    rows_ AS (SELECT *, unnest(range(nr)) AS i FROM sized), cells AS (SELECT *, unnest(range(nc)) AS j FROM rows_)
    SELECT c_nationkey, printf('GRID_%03d', i * nc + j + 1) AS point_id, round(south + i * 0.14e0, 4) AS latitude, round(west + j * 0.14e0, 4) AS longitude FROM cells""",
)
def _(spark, sf):
    placed = t.locations(spark, sf).join(t.table(spark, sf, "customer"), c("ordinal") == c("c_custkey"))
    boxes = placed.groupBy("c_nationkey").agg(F.min("latitude").alias("south"), F.min("longitude").alias("west"))
    boxes = boxes.withColumns({"north": c("south") + 0.7, "east": c("west") + 0.7})
    return spatial.box_lattice(boxes, ["c_nationkey"], 0.14)


@query(
    "f23_zone_lattice", "point_id:s latitude:d longitude:d zone_id:s zone_name:s",
    f"""WITH {t.POINTS_SQL}, want AS (SELECT zone_id, count(*) AS n FROM points GROUP BY 1),
    sized AS (SELECT *, CAST(ceil(sqrt(n)) AS INTEGER) AS side FROM want JOIN zones USING (zone_id)),
    cells AS (SELECT *, unnest(range(n)) AS i FROM sized)
    SELECT printf('%s_PT_%03d', zone_id, i + 1) AS point_id, zone_id, zone_name,
      round(south + 0.1e0 + (i // side) * (north - south - 0.2e0) / greatest(side - 1, 1), 4) AS latitude,
      round(west + 0.1e0 + (i % side) * (east - west - 0.2e0) / greatest(side - 1, 1), 4) AS longitude FROM cells""",
)
def _(spark, sf):
    return spatial.zone_lattice(t.points(spark, sf).groupBy("zone_id").agg(F.count("*").alias("points_count")))


@query(
    "f24_text_fingerprint", "doc_id:s fingerprint:s",
    r"SELECT CAST(doc_id AS VARCHAR) AS doc_id, substr(sha256(regexp_replace(text, '^\s+|\s+$', '', 'g')), 1, 16) AS fingerprint FROM documents",
)
def _(spark, sf):
    return t.table(spark, sf, "documents").select(c("doc_id").cast("string").alias("doc_id"), text.fingerprint(c("text")).alias("fingerprint"))


FENCED = """SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'Sure:' || chr(10) || '```json' || chr(10) || body || chr(10) || '```' WHEN 1 THEN '```' || body || '```'
  WHEN 2 THEN '  ' || body ELSE 'no json here' END AS reply FROM
  (SELECT event_id, '{"district": "' || event_type || '", "min_temp_c": ' || event_id % 40 || ', "max_temp_c": ' || (20 + event_id % 30) || '}' AS body FROM events)"""


def fenced(spark, sf):
    e = c("event_id")
    body = F.concat(
        F.lit('{"district": "'), c("event_type"), F.lit('", "min_temp_c": '), (e % 40).cast("string"),
        F.lit(', "max_temp_c": '), (20 + e % 30).cast("string"), F.lit("}"),
    )
    reply = (
        F.when(e % 4 == 0, F.concat(F.lit("Sure:\n```json\n"), body, F.lit("\n```")))
        .when(e % 4 == 1, F.concat(F.lit("```"), body, F.lit("```")))
        .when(e % 4 == 2, F.concat(F.lit("  "), body))
        .otherwise("no json here")
    )
    return t.table(spark, sf, "events").select("event_id", reply.alias("reply"))


@query(
    "f25_unfence_and_parse", "event_id:i district:s min_temp_c:d max_temp_c:d",
    f"""SELECT event_id, json_extract_string(j, '$.district') AS district, CAST(json_extract(j, '$.min_temp_c') AS DOUBLE) AS min_temp_c,
    CAST(json_extract(j, '$.max_temp_c') AS DOUBLE) AS max_temp_c FROM
    (SELECT event_id, CASE WHEN json_valid(b) THEN b END AS j FROM (SELECT event_id, regexp_extract(reply, '(\\{{.*\\}})', 1) AS b FROM ({FENCED})))""",
)
def _(spark, sf):
    parsed = F.from_json(text.unfence(c("reply")), EXTRACTION, {"mode": "PERMISSIVE"})
    return fenced(spark, sf).select("event_id", parsed.alias("p")).select("event_id", "p.*")


@query(
    "f26_tile_corner", "tile:s south:d west:d",
    "SELECT tile, s * lat AS south, w * lon AS west FROM (SELECT DISTINCT printf('%s%02d%s%03d', CASE WHEN p_partkey % 2 = 0 THEN 'N' ELSE 's' END, p_size, "
    "CASE WHEN p_partkey % 3 = 0 THEN 'w' ELSE 'E' END, p_size * 3) AS tile, CASE WHEN p_partkey % 2 = 0 THEN 1.0e0 ELSE -1.0e0 END AS s, "
    "CASE WHEN p_partkey % 3 = 0 THEN -1.0e0 ELSE 1.0e0 END AS w, p_size AS lat, p_size * 3 AS lon FROM part)",
)
def _(spark, sf):
    key = c("p_partkey")
    tile = F.format_string(
        "%s%02d%s%03d", F.when(key % 2 == 0, "N").otherwise("s"), c("p_size"), F.when(key % 3 == 0, "w").otherwise("E"), c("p_size") * 3
    )
    south, west = rasters.corner(c("tile"))
    return t.table(spark, sf, "part").select(tile.alias("tile")).distinct().select("tile", south.alias("south"), west.alias("west"))


@query(
    "f27_clock_text", "event_id:i label:s",
    "SELECT event_id, 'From ' || strftime(ts, '%H:%M') || ' value ' || printf('%.2f', round(value + 1e-7, 2)) AS label FROM events",
)
def _(spark, sf):
    label = F.concat(F.lit("From "), text.clock(c("ts")), F.lit(" value "), text.fixed(c("value"), 2))
    return t.table(spark, sf, "events").select("event_id", label.alias("label"))


@query(
    "f28_iso_instant", "event_id:i moment:t",
    "SELECT event_id, CASE WHEN event_id % 5 = 4 THEN NULL ELSE date_trunc('second', ts) END AS moment FROM events",
)
def _(spark, sf):
    e = c("event_id")
    stamp = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")
    raw = (
        F.when(e % 5 == 0, F.concat(stamp, F.lit("Z")))
        .when(e % 5 == 1, F.concat(stamp, F.lit("+00:00")))
        .when(e % 5 == 2, stamp)
        .when(e % 5 == 3, F.date_format("ts", "yyyy-MM-dd HH:mm:ss"))
        .otherwise("not a time")
    )
    return t.table(spark, sf, "events").select("event_id", raw.alias("raw")).select("event_id", text.instant(c("raw")).alias("moment"))


@obs_query(
    "f29_lapse_downscale", "predicted_residual_c:d downscaled_temp_c:d",
    "(elevation_m - 380.0e0) * -0.0065e0 AS predicted_residual_c, temperature_2m_c + (elevation_m - 380.0e0) * -0.0065e0 AS downscaled_temp_c",
)
def _(spark, sf):
    rows = t.obs(spark, sf).withColumns({"delta_elevation_m": c("elevation_m") - 380.0, "baseline_temp_c": c("temperature_2m_c")})
    return residual_models.lapse_score(rows)


USED = [
    "elevation_m", "delta_elevation_m", "solar_radiation_w_m2", "soil_temperature_0_to_7cm_c",
    "soil_moisture_0_to_7cm_m3m3", "et0_evapotranspiration_mm", "thermal_inertia_lag_3h", "predicted_residual_c",
]


@query(
    "f30_covariate_map", "point_id:s timestamp:t name:s value:d",
    f"""WITH {t.OBS_SQL}, used AS (SELECT *, elevation_m - 380.0e0 AS delta_elevation_m, 0.0e0 AS thermal_inertia_lag_3h,
      round((elevation_m - 380.0e0) * -0.0065e0, 3) AS predicted_residual_c FROM obs)
    """ + " UNION ALL ".join(
        f"SELECT point_id, timestamp, '{n}' AS name, " + (
            "CASE WHEN k % 2 = 0 THEN k * 1.0e0 ELSE et0_evapotranspiration_mm END" if n == "et0_evapotranspiration_mm" else n
        ) + " AS value FROM used" for n in USED
    ) + " UNION ALL SELECT point_id, timestamp, 'sensor' AS name, 7.5e0 AS value FROM used WHERE k % 2 = 0",
)
def _(spark, sf):
    given = F.when(c("k") % 2 == 0, F.create_map(F.lit("et0_evapotranspiration_mm"), c("k") * 1.0, F.lit("sensor"), F.lit(7.5)))
    rows = t.obs(spark, sf).withColumns(
        {
            "delta_elevation_m": c("elevation_m") - 380.0, "thermal_inertia_lag_3h": F.lit(0.0), "given": given,
            "predicted_residual_c": (c("elevation_m") - 380.0) * -0.0065,
        }
    )
    used = forecasts.covariate_map("given")
    return rows.select("point_id", "timestamp", F.explode(used).alias("name", "value"))
