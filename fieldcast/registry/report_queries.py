"""Reports with rules from published definitions."""

from __future__ import annotations

from pyspark.sql import functions as F

from fieldcast import catalogs
from fieldcast.operators import indices, lookups, timeseries
from fieldcast.plans import features, fleet, forecasts, reports
from fieldcast.registry import feature_queries, join_queries
from fieldcast.registry import tables as t
from fieldcast.registry.base import ORACLES, query
from fieldcast.registry.index_queries import DEFAULT_STRESS
from fieldcast.sources import weather

c = F.col
KEY = features.POINT
ORDER = "(PARTITION BY zone_id, point_id ORDER BY timestamp)"

WET_BULB = """(downscaled_temp_1km_c * atan(0.151977e0 * sqrt(relative_humidity_pct + 8.313659e0)) + atan(downscaled_temp_1km_c + relative_humidity_pct)
  - atan(relative_humidity_pct - 1.676331e0) + 0.00391838e0 * relative_humidity_pct ** 1.5e0 * atan(0.023101e0 * relative_humidity_pct) - 4.686035e0)"""
ASSESSED_SQL = f"""{t.SERIES_SQL},
soon AS (SELECT *, sum(precipitation_mm) OVER w AS rain_soon_mm, max(rain_probability_pct) OVER w AS rain_chance_soon_pct FROM series
  WINDOW w AS (PARTITION BY zone_id, point_id ORDER BY timestamp ROWS BETWEEN CURRENT ROW AND 3 FOLLOWING)),
coded AS (SELECT *, concat_ws(',', CASE WHEN wind_speed_kmh > 14 THEN 'WIND_STRONG' END, CASE WHEN rain_soon_mm > 0 OR rain_chance_soon_pct > 25 THEN 'RAIN_SOON' END,
    CASE WHEN downscaled_temp_1km_c > 34 THEN 'TOO_HOT' END) AS blocks,
  concat_ws(',', CASE WHEN wind_speed_kmh < 3 THEN 'WIND_CALM' END, CASE WHEN downscaled_temp_1km_c < 12 THEN 'TOO_COLD' END, CASE WHEN relative_humidity_pct > 90 THEN 'HUMID_AIR' END) AS cautions,
  downscaled_temp_1km_c - {WET_BULB} AS wet_bulb_gap_c FROM soon),
assessed AS (SELECT *, CASE WHEN blocks <> '' THEN 'unsuitable' WHEN cautions <> '' THEN 'marginal' ELSE 'good' END AS status FROM coded)"""


def assessed(spark, sf):
    return reports.spray_assessment(t.series(spark, sf), KEY)


@query("c1_spray_assessment", "point_id:s timestamp:t status:s blocks:s cautions:s rain_soon_mm:d rain_chance_soon_pct:d wet_bulb_gap_c:d", f"WITH {ASSESSED_SQL} SELECT * FROM assessed")
def _(spark, sf):
    return assessed(spark, sf).withColumns({x: F.array_join(x, ",") for x in ("blocks", "cautions")})


RANKED_SQL = f"""{ASSESSED_SQL},
marked AS (SELECT *, status <> 'unsuitable' AS usable, row_number() OVER {ORDER} AS rn FROM assessed),
island AS (SELECT *, rn - row_number() OVER (PARTITION BY zone_id, point_id, usable ORDER BY timestamp) AS w FROM marked),
windows AS (SELECT zone_id, point_id, min(timestamp) AS window_start, max(timestamp) AS window_end, count(*) AS duration_h, count(*) FILTER (status = 'good') AS good_hours,
  count(*) FILTER (status = 'marginal') AS marginal_hours, avg(wind_speed_kmh) AS mean_wind_kmh, max(rain_chance_soon_pct) AS max_rain_probability_pct, avg(wet_bulb_gap_c) AS mean_wet_bulb_gap_c,
  CASE WHEN count(*) FILTER (status = 'marginal') = 0 THEN 'good' ELSE 'marginal' END AS quality FROM island WHERE usable GROUP BY zone_id, point_id, w HAVING count(*) >= 2)"""


@query("c2_ranked_spray_windows",
       "point_id:s window_rank:i window_start:t window_end:t duration_h:i good_hours:i marginal_hours:i quality:s mean_wind_kmh:d max_rain_probability_pct:d mean_wet_bulb_gap_c:d",
       f"WITH {RANKED_SQL} SELECT *, row_number() OVER (PARTITION BY zone_id, point_id ORDER BY window_start) AS window_rank FROM windows")
def _(spark, sf):
    return reports.spray_report(assessed(spark, sf), KEY)


@query("c2_spray_summary", "point_id:s horizon_h:i windows:i best_window_start:t cleanest_window_start:t blocking_hours_by_reason:s",
       f"""WITH {RANKED_SQL}, best AS (SELECT zone_id, point_id, count(*) AS windows, min(window_start) AS best_window_start, min(window_start) FILTER (quality = 'good') AS cleanest_window_start FROM windows GROUP BY 1, 2),
       reasons AS (SELECT zone_id, point_id, '{{' || string_agg('"' || reason || '":' || n, ',' ORDER BY reason) || '}}' AS blocking_hours_by_reason FROM
         (SELECT zone_id, point_id, reason, count(*) AS n FROM (SELECT zone_id, point_id, unnest(string_split(blocks, ',')) AS reason FROM assessed WHERE blocks <> '') GROUP BY 1, 2, 3) GROUP BY 1, 2),
       places AS (SELECT zone_id, point_id, count(*) AS horizon_h FROM assessed GROUP BY 1, 2)
       SELECT places.*, coalesce(windows, 0) AS windows, best_window_start, cleanest_window_start, blocking_hours_by_reason FROM places LEFT JOIN best USING (zone_id, point_id) LEFT JOIN reasons USING (zone_id, point_id)""")
def _(spark, sf):
    return reports.spray_summary(assessed(spark, sf), KEY).withColumn("blocking_hours_by_reason", F.to_json("blocking_hours_by_reason"))


@query("c3_daily_record", "point_id:s date:y tmax_c:d tmin_c:d precipitation_mm:d source:s",
       f"""WITH {t.DAILY_SQL} SELECT point_id, date, tmax_c, tmin_c, precipitation_mm, CASE WHEN status = 'F' THEN 'archive' ELSE 'forecast' END AS source FROM daily""")
def _(spark, sf):
    rows = t.daily(spark, sf)
    archive = rows.filter("status = 'F'").withColumn("source", F.lit("archive"))
    return lookups.merge_daily(archive, rows.withColumn("source", F.lit("forecast")), ["point_id"])


# Degree-day thresholds are a parameter of the report; these are plausible values for a check.
THRESHOLDS = [(crop, stage, 350.0 * (ordinal - 1)) for crop, stage, ordinal, *_ in catalogs.stage_rows()]
SOWN_SQL = f"""{t.DAILY_SQL},
thresholds AS (SELECT * FROM (VALUES {t.values(THRESHOLDS)}) AS s(crop_key, stage, gdd_threshold)),
crop_list AS (SELECT row_number() OVER () - 1 AS crop_no, * FROM (VALUES {t.values([(x[0], x[3], x[6]) for x in catalogs.CROPS])}) AS c(crop_key, base_temp_c, upper_temp_c)),
sowings AS (SELECT DISTINCT point_id, year(date) AS year, crop_key, base_temp_c, upper_temp_c, make_date(year(date), 6, 15) AS sowing_date FROM daily JOIN crop_list ON CAST(substr(point_id, 4) AS BIGINT) % 6 = crop_no),
grown AS (SELECT d.point_id, year(date) AS year, date, crop_key, sowing_date, greatest(0.0e0, (greatest(least(tmax_c, upper_temp_c), base_temp_c) + greatest(least(tmin_c, upper_temp_c), base_temp_c)) / 2 - base_temp_c) AS dd
  FROM daily d JOIN sowings ON sowings.point_id = d.point_id AND sowings.year = year(date) WHERE date >= sowing_date)"""


def sown(spark, sf):
    """A season sown in June of every year, reported as of the end of that year."""
    rows = t.daily(spark, sf).withColumn("year", F.year("date"))
    names = F.array(*[F.lit(x[0]) for x in catalogs.CROPS])
    number = F.substring("point_id", 4, 20).cast("bigint") % 6
    stations = rows.select("point_id", "year").distinct().withColumn("crop_key", F.element_at(names, (number + 1).cast("int")))
    limits = catalogs.crops(spark).select("crop_key", "base_temp_c", c("critical_max_temp_c").alias("upper_temp_c"))
    sowings = stations.join(F.broadcast(limits), "crop_key").withColumn("sowing_date", F.make_date("year", F.lit(6), F.lit(15)))
    stages = spark.createDataFrame(THRESHOLDS, "crop_key string, stage string, gdd_threshold double")
    return rows, sowings, F.broadcast(stages)


@query("c4_phenology", "point_id:s year:i crop_key:s observed_days:i accumulated_gdd:d days_after_sowing:i current_stage:s next_stage:s gdd_to_next_stage:d stage_progress_pct:d",
       f"""WITH {SOWN_SQL}, total AS (SELECT point_id, year, crop_key, sum(dd) AS accumulated_gdd, count(*) AS observed_days, date_diff('day', min(sowing_date), max(date)) AS days_after_sowing FROM grown GROUP BY 1, 2, 3),
       steps AS (SELECT total.*, max(gdd_threshold) FILTER (gdd_threshold <= accumulated_gdd) AS done, min(gdd_threshold) FILTER (gdd_threshold > accumulated_gdd) AS todo,
         arg_max(stage, gdd_threshold) FILTER (gdd_threshold <= accumulated_gdd) AS current_stage, arg_min(stage, gdd_threshold) FILTER (gdd_threshold > accumulated_gdd) AS next_stage
         FROM total JOIN thresholds USING (crop_key) GROUP BY ALL)
       SELECT *, todo - accumulated_gdd AS gdd_to_next_stage, (accumulated_gdd - done) / nullif(todo - done, 0) * 100 AS stage_progress_pct FROM steps""")
def _(spark, sf):
    rows, sowings, stages = sown(spark, sf)
    return reports.phenology(rows, sowings, stages, ["point_id", "year"])


@query("c4_stage_dates", "point_id:s year:i crop_key:s stage:s gdd_threshold:d date:y basis:s",
       f"""WITH {SOWN_SQL}, run AS (SELECT *, sum(dd) OVER (PARTITION BY point_id, year ORDER BY date ROWS UNBOUNDED PRECEDING) AS g FROM grown)
       SELECT point_id, year, crop_key, stage, gdd_threshold, min(run.date) FILTER (g >= gdd_threshold) AS date, CASE WHEN min(run.date) FILTER (g >= gdd_threshold) IS NULL THEN 'not_reached' ELSE 'observed' END AS basis
       FROM run JOIN thresholds USING (crop_key) GROUP BY ALL""")
def _(spark, sf):
    rows, sowings, stages = sown(spark, sf)
    return reports.stage_dates(rows, sowings, stages, ["point_id", "year"])


NORMAL_SQL = f"""{t.DAILY_SQL},
normal AS (SELECT point_id, dayofyear(date) AS doy, avg(tmax_c) AS nx, avg(tmin_c) AS nn, avg(precipitation_mm) AS nr FROM daily WHERE year(date) BETWEEN 1991 AND 2000 GROUP BY 1, 2),
joined AS (SELECT d.*, nx, nn, nr FROM daily d LEFT JOIN normal n ON n.point_id = d.point_id AND n.doy = dayofyear(d.date))"""
PERIOD = (1991, 2000)


@query("c5_rainfall_departure", "point_id:s year:i start_date:y end_date:y days:i rainfall_mm:d normal_mm:d departure_pct:d category:s",
       f"""WITH {NORMAL_SQL}, p AS (SELECT point_id, year(date) AS year, min(date) AS start_date, max(date) AS end_date, count(*) AS days, sum(precipitation_mm) AS rainfall_mm, sum(nr) AS normal_mm FROM joined GROUP BY 1, 2),
       q AS (SELECT *, CASE WHEN normal_mm >= 1 THEN (rainfall_mm - normal_mm) / nullif(normal_mm, 0) * 100 END AS departure_pct FROM p)
       SELECT *, CASE WHEN normal_mm < 1 THEN 'Dry season' WHEN rainfall_mm <= 0 THEN 'No Rain' WHEN round(departure_pct) >= 60 THEN 'Large Excess' WHEN round(departure_pct) >= 20 THEN 'Excess'
         WHEN round(departure_pct) >= -19 THEN 'Normal' WHEN round(departure_pct) >= -59 THEN 'Deficient' WHEN round(departure_pct) >= -99 THEN 'Large Deficient' ELSE 'No Rain' END AS category FROM q""")
def _(spark, sf):
    rows = t.daily(spark, sf)
    return reports.rainfall_departure(rows, reports.normals(rows, ["point_id"], PERIOD), ["point_id"], [F.year("date").alias("year")])


ANOMALY_SQL = f"""{NORMAL_SQL},
anomaly AS (SELECT point_id, date, tmax_c, tmin_c, tmax_c - nx AS tmax_departure_c, tmin_c - nn AS tmin_departure_c,
  CASE WHEN tmax_c >= 47 OR (tmax_c >= 40 AND round(tmax_c - nx + 1e-9, 1) > 6.4e0) THEN 'severe heat wave' WHEN tmax_c >= 45 OR (tmax_c >= 40 AND round(tmax_c - nx + 1e-9, 1) >= 4.5e0) THEN 'heat wave' ELSE 'none' END AS heat_wave,
  CASE WHEN tmin_c <= 2 OR (tmin_c <= 10 AND round(tmin_c - nn + 1e-9, 1) < -6.4e0) THEN 'severe cold wave' WHEN tmin_c <= 4 OR (tmin_c <= 10 AND round(tmin_c - nn + 1e-9, 1) <= -4.5e0) THEN 'cold wave' ELSE 'none' END AS cold_wave FROM joined)"""


def anomalies(spark, sf):
    rows = t.daily(spark, sf)
    return reports.temperature_anomalies(rows, reports.normals(rows, ["point_id"], PERIOD), ["point_id"])


@query("c6_temperature_anomalies", "point_id:s date:y tmax_departure_c:d tmin_departure_c:d heat_wave:s cold_wave:s", f"WITH {ANOMALY_SQL} SELECT * FROM anomaly")
def _(spark, sf):
    return anomalies(spark, sf)


def _departed(name: str, where: str) -> str:
    """Rain of a station's days within a window against its normal."""
    pct = f"CASE WHEN {name}_normal_mm >= 1 THEN ({name}_rainfall_mm - {name}_normal_mm) / {name}_normal_mm * 100 END"
    return f"""{name}_sums AS (SELECT point_id, min(date) AS {name}_start_date, max(date) AS {name}_end_date, count(*) AS {name}_days, sum(precipitation_mm) AS {name}_rainfall_mm, sum(nr) AS {name}_normal_mm
      FROM joined JOIN asked USING (point_id) WHERE {where} GROUP BY 1),
    {name}_rain AS (SELECT *, CASE WHEN {name}_normal_mm < 1 THEN 'Dry season' WHEN {name}_rainfall_mm <= 0 THEN 'No Rain' WHEN round(pct) >= 60 THEN 'Large Excess' WHEN round(pct) >= 20 THEN 'Excess'
      WHEN round(pct) >= -19 THEN 'Normal' WHEN round(pct) >= -59 THEN 'Deficient' WHEN round(pct) >= -99 THEN 'Large Deficient' ELSE 'No Rain' END AS {name}_category, pct AS {name}_departure_pct
      FROM (SELECT *, {pct} AS pct FROM {name}_sums))"""


CLIMATE_SQL = f"""{ANOMALY_SQL},
asked AS (SELECT *, make_date(year(as_of), CASE WHEN month(as_of) < 3 THEN 1 WHEN month(as_of) < 6 THEN 3 WHEN month(as_of) < 10 THEN 6 ELSE 10 END, 1) AS begun FROM (SELECT point_id, max(date) - 7 AS as_of FROM daily GROUP BY 1)),
{_departed('season', 'date BETWEEN begun AND as_of')}, {_departed('forecast', 'date > as_of AND date <= as_of + 7')},
warmth AS (SELECT point_id, count(*) AS days, avg(tmax_departure_c) AS mean_tmax_departure_c, avg(tmin_departure_c) AS mean_tmin_departure_c,
  count(*) FILTER (heat_wave <> 'none') AS heat_wave_days, count(*) FILTER (cold_wave <> 'none') AS cold_wave_days FROM anomaly GROUP BY 1),
years AS (SELECT point_id, count(DISTINCT year(date)) FILTER (year(date) BETWEEN 1991 AND 2000) AS normal_years FROM daily GROUP BY 1),
climate AS (SELECT *, '1991-2000' AS normal_period, CASE WHEN month(as_of) < 3 THEN 'Winter (Jan-Feb)' WHEN month(as_of) < 6 THEN 'Pre-Monsoon Summer (Mar-May)' WHEN month(as_of) < 10 THEN 'Monsoon (Jun-Sep)' ELSE 'Post-Monsoon (Oct-Dec)' END AS imd_season
  FROM warmth JOIN asked USING (point_id) JOIN years USING (point_id) LEFT JOIN season_rain USING (point_id) LEFT JOIN forecast_rain USING (point_id))"""
RAIN_PART = "{0}_start_date:y {0}_end_date:y {0}_days:i {0}_rainfall_mm:d {0}_normal_mm:d {0}_departure_pct:d {0}_category:s"


def climate(spark, sf):
    """As of a week before each station's last day: the days after it stand for the forecast."""
    rows = t.daily(spark, sf)
    asked = rows.groupBy("point_id").agg(F.date_sub(F.max("date"), 7).alias("as_of"))
    return reports.climatology(rows, ["point_id"], PERIOD, asked)


@query("c7_climatology", f"point_id:s as_of:y normal_period:s normal_years:i imd_season:s {RAIN_PART.format('season')} {RAIN_PART.format('forecast')} days:i mean_tmax_departure_c:d mean_tmin_departure_c:d heat_wave_days:i cold_wave_days:i",
       f"WITH {CLIMATE_SQL} SELECT * FROM climate")
def _(spark, sf):
    return climate(spark, sf)


@query("c8_power_daily", "point_id:s date:y t2m_c:d precip_corr_mm:d rh2m_pct:d",
       f"""WITH {t.DAILY_SQL} SELECT point_id, date, CASE WHEN order_no % 5 = 0 THEN NULL ELSE (tmax_c + tmin_c) / 2 END AS t2m_c, precipitation_mm AS precip_corr_mm,
       CASE WHEN order_no % 7 = 0 THEN NULL ELSE order_no % 100 END AS rh2m_pct FROM daily WHERE order_no % 11 > 0""")
def _(spark, sf):
    order = c("order_no")
    docs = t.daily(spark, sf).select(
        "point_id", F.when(order % 11 == 0, F.lit("unknown")).otherwise(F.date_format("date", "yyyyMMdd")).alias("date"),
        F.when(order % 5 == 0, F.lit(-999.0)).otherwise((c("tmax_c") + c("tmin_c")) / 2).alias("t2m_c"), c("precipitation_mm").alias("precip_corr_mm"),
        F.when(order % 7 == 0, F.lit(-998.995)).otherwise((order % 100).cast("double")).alias("rh2m_pct"), F.lit(None).cast("double").alias("solar_radiation_mj_m2"),
    )
    return weather.power_rows(docs)


RULES = [
    ("HOT_HOURS", "heat_stress_hours", ">=", 10.0, "Severe", "Irrigate in the evening"), ("DRY_AIR", "mean_vpd_kpa", ">=", 1.5, "Moderate", "Check soil moisture"),
    ("COLD_NIGHT", "inversion_strength_c", ">=", 0.6, "Low", "Watch low plots"), ("FEW_DEGREE_DAYS", "gdd_accumulated_c_days", "<=", 80.0, "Moderate", "Delay sowing"),
]
RULES_SQL = f"rules AS (SELECT * FROM (VALUES {t.values([(*r, i, s) for i, (r, s) in enumerate(zip(RULES, [3, 2, 1, 2]))])}) AS r(rule_id, metric, cmp, threshold, risk_level, action, rule_no, score))"


@query("c9_rule_advisories", "point_id:s risk_level:s recommended_action:s matched_rules:s evidence:s",
       f"""WITH {DEFAULT_STRESS}, {RULES_SQL}, long_ AS (SELECT zone_id, point_id, 'heat_stress_hours' AS metric, heat_stress_hours * 1.0e0 AS value FROM stress UNION ALL SELECT zone_id, point_id, 'mean_vpd_kpa', mean_vpd_kpa FROM stress
         UNION ALL SELECT zone_id, point_id, 'inversion_strength_c', inversion_strength_c FROM stress UNION ALL SELECT zone_id, point_id, 'gdd_accumulated_c_days', gdd_accumulated_c_days FROM gdd),
       fired AS (SELECT *, metric || ' ' || cmp || ' ' || printf('%.2f', threshold) || ' : ' || printf('%.2f', round(value + 1e-7, 2)) AS ev FROM long_ JOIN rules USING (metric)
         WHERE (cmp = '>=' AND value >= threshold) OR (cmp = '<=' AND value <= threshold))
       SELECT zone_id, point_id, arg_min(risk_level, (-score, rule_id)) AS risk_level, arg_min(action, (-score, rule_id)) AS recommended_action, string_agg(rule_id, ',' ORDER BY -score, rule_id) AS matched_rules,
         string_agg(ev, ';' ORDER BY -score, rule_id) AS evidence FROM fired GROUP BY 1, 2""")
def _(spark, sf):
    facts = indices.stress_indices(t.series(spark, sf), KEY).select(*KEY, "heat_stress_hours", "mean_vpd_kpa", "inversion_strength_c", "gdd_accumulated_c_days")
    rules = spark.createDataFrame(RULES, "rule_id string, metric string, comparison string, threshold double, risk_level string, action string")
    return reports.rule_advisories(facts, F.broadcast(rules), KEY).withColumns(
        {"matched_rules": F.array_join("matched_rules", ","), "evidence": F.array_join("evidence", ";")}
    )


def own_station(rows):
    """Daily stations under the ids of the hourly ones: station n there is point n - 1 here."""
    return rows.withColumn("point_id", F.format_string("GRID_%03d", F.substring("point_id", 4, 20).cast("bigint") - 1))


def payload(spark, sf):
    """All parts of a location's report; a part it has no data for is left out of its document."""
    # Nearly every part passes over both tables, some several times: events and line items are read and grouped once.
    rows, _ = t.stored(t.obs, spark, sf), t.stored(t.daily, spark, sf, drop=("order_no", "status"))
    key, series = ["point_id"], t.series(spark, sf)
    first = F.min_by(F.struct("timestamp", "temperature_2m_c", "relative_humidity_2m_pct", "wind_speed_10m_kmh"), "timestamp").alias("_b")
    day = rows.groupBy("point_id", F.to_date("timestamp").alias("date")).agg(
        F.max("temperature_2m_c").alias("temperature_max_c"), F.min("temperature_2m_c").alias("temperature_min_c"), F.sum("precipitation_mm").alias("precipitation_sum_mm"),
        F.max("rain_probability_pct").alias("precipitation_probability_pct"),
    )
    outlook = timeseries.first_rows(day, key, "date", 7).drop("_row_no")
    rules = spark.createDataFrame(RULES, "rule_id string, metric string, comparison string, threshold double, risk_level string, action string")
    facts = indices.stress_indices(series, KEY).select("point_id", "heat_stress_hours", "mean_vpd_kpa", "inversion_strength_c", "gdd_accumulated_c_days")
    grown, sowings, stages = sown(spark, sf)
    stage = reports.phenology(grown, sowings, stages, ["point_id", "year"]).groupBy("point_id").agg(F.max_by(F.struct("year", "crop_key", "current_stage", "next_stage", "accumulated_gdd"), "year").alias("_p"))
    points = t.points(spark, sf).select("zone_id", "point_id", "latitude", "longitude", "elevation_m")
    served = forecasts.downscale(feature_queries.serving(spark, sf, 1))
    parts = {
        "agro_climatic_zone": points.join(catalogs.zones(spark).select("zone_id", "zone_no", "zone_name", "focus_domain"), "zone_id", "left"),
        "baseline_weather": rows.groupBy(*key).agg(first).select("point_id", "_b.*"),
        "downscaled_weather": served.select("point_id", "timestamp", "baseline_value", "downscaled_value", "confidence_score"),
        "advisory": reports.rule_advisories(facts, rules, key),
        "bhoonidhi": fleet.satellite_context(points, join_queries.items(spark, sf), key).select("point_id", "matched_items", "soil_moisture_m3_m3", "collections", "attribution"),
        "daily_forecast": outlook.groupBy(*key).agg(F.sort_array(F.collect_list(F.struct("date", "temperature_max_c", "temperature_min_c", "precipitation_sum_mm", "precipitation_probability_pct"))).alias("days")),
        "spray_windows": reports.spray_summary(reports.spray_assessment(series, KEY), KEY).drop("zone_id"),
        "phenology": own_station(stage.select("point_id", "_p.*")),
        "climatology": own_station(climate(spark, sf)),
    }
    return reports.combined(parts, key)


@query("c10_combined_payload", "point_id:s payload:s")
def _(spark, sf):
    return payload(spark, sf)


def _part(name: str) -> str:
    return f"({ORACLES[name]})"


GRID = "printf('GRID_%03d', CAST(substr(point_id, 4) AS BIGINT) - 1) AS point_id"


@query("c10_payload_fields",
       "point_id:s zone_name:s temperature:d served:d confidence:d risk:s matched:i days:i first_max:d windows:i horizon:i year:i stage:s season:s heat_days:i season_rain:d",
       f"""WITH {t.OBS_SQL}, {join_queries.ITEMS_SQL}, points AS (SELECT DISTINCT point_id, zone_id, latitude, longitude FROM obs),
       base AS (SELECT point_id, arg_min(temperature_2m_c, timestamp) AS temperature FROM obs GROUP BY 1),
       served AS (SELECT point_id, arg_min(downscaled_value, timestamp) AS served, arg_min(confidence_score, timestamp) AS confidence FROM {_part('d5_downscaled_forecast')} GROUP BY 1),
       near AS (SELECT point_id, count(*) AS matched FROM points l JOIN items i ON l.latitude BETWEEN i.latitude - 0.25e0 AND i.latitude + 0.25e0 AND l.longitude BETWEEN i.longitude - 0.25e0 AND i.longitude + 0.25e0 GROUP BY 1),
       days AS (SELECT point_id, CAST(timestamp AS DATE) AS date, max(temperature_2m_c) AS warmest FROM obs GROUP BY 1, 2),
       outlook AS (SELECT point_id, least(count(*), 7) AS days, arg_min(warmest, date) AS first_max FROM days GROUP BY 1),
       stages AS (SELECT {GRID}, max(year) AS year, arg_max(current_stage, year) AS stage FROM {_part('c4_phenology')} GROUP BY 1),
       climate AS (SELECT {GRID}, imd_season AS season, heat_wave_days AS heat_days, season_rainfall_mm AS season_rain FROM {_part('c7_climatology')})
       SELECT point_id, zone_name, temperature, served, confidence, a.risk_level AS risk, coalesce(matched, 0) AS matched, days, first_max, windows, horizon_h AS horizon, year, stage, season, heat_days, season_rain
       FROM points LEFT JOIN zones USING (zone_id) JOIN base USING (point_id) JOIN served USING (point_id) LEFT JOIN {_part('c9_rule_advisories')} a USING (point_id) LEFT JOIN near USING (point_id) JOIN outlook USING (point_id)
       LEFT JOIN {_part('c2_spray_summary')} s USING (point_id) LEFT JOIN stages USING (point_id) LEFT JOIN climate USING (point_id)""")
def _(spark, sf):
    # Read back from the documents, as a client would.
    at = lambda path, kind="string": F.get_json_object("payload", f"$.{path}").cast(kind)
    return payload(spark, sf).select(
        "point_id", at("agro_climatic_zone.zone_name").alias("zone_name"), at("baseline_weather.temperature_2m_c", "double").alias("temperature"),
        at("downscaled_weather.downscaled_value", "double").alias("served"), at("downscaled_weather.confidence_score", "double").alias("confidence"), at("advisory.risk_level").alias("risk"),
        at("bhoonidhi.matched_items", "bigint").alias("matched"), F.json_array_length(at("daily_forecast.days")).alias("days"), at("daily_forecast.days[0].temperature_max_c", "double").alias("first_max"),
        at("spray_windows.windows", "bigint").alias("windows"), at("spray_windows.horizon_h", "bigint").alias("horizon"), at("phenology.year", "bigint").alias("year"), at("phenology.current_stage").alias("stage"),
        at("climatology.imd_season").alias("season"), at("climatology.heat_wave_days", "bigint").alias("heat_days"), at("climatology.season_rainfall_mm", "double").alias("season_rain"),
    )
