"""Projections, filters, defaults, validation and data-quality gates."""

from __future__ import annotations

from pyspark.sql import functions as F

from fieldcast import catalogs
from fieldcast.functions.text import real_warnings
from fieldcast.operators import metrics, quality, splits, timeseries
from fieldcast.plans import features, forecasts
from fieldcast.registry import tables as t
from fieldcast.registry.aggregate_queries import PROFILE, PROFILE_SQL, SPLIT_SQL, profiled
from fieldcast.registry.base import query
from fieldcast.registry.window_queries import KEY, ORDER
from fieldcast.sources import weather

c = F.col
ID = "point_id:s timestamp:t"
GAPPY_SQL = f"""{t.OBS_SQL}, gappy AS (SELECT *, CASE WHEN k % 7 <> 2 THEN temperature_2m_c END AS tc, CASE WHEN k % 4 = 1 THEN precipitation_mm END AS rain FROM obs)"""


def gappy(spark, sf):
    return t.obs(spark, sf).withColumns(
        {"tc": F.when(c("k") % 7 != 2, c("temperature_2m_c")), "rain": F.when(c("k") % 4 == 1, c("precipitation_mm"))}
    )


@query("p1_requested_variables", f"{ID} temperature_2m_c:d wind_speed_10m_kmh:d", f"WITH {t.OBS_SQL} SELECT * FROM obs")
def _(spark, sf):
    docs = weather.parse_documents(t.weather_texts(spark, sf))
    return weather.project_variables(docs, ["temperature_2m", "wind_speed_10m"])


@query("p4_incomplete_rows", "rows:i kept:i dropped:i",
       f"WITH {GAPPY_SQL} SELECT count(*) AS rows, count(*) FILTER (tc IS NOT NULL AND rain IS NOT NULL) AS kept, count(*) FILTER (tc IS NULL OR rain IS NULL) AS dropped FROM gappy")
def _(spark, sf):
    return quality.completeness(gappy(spark, sf))


@query("p4_complete_rows", f"{ID} tc:d rain:d", f"WITH {GAPPY_SQL} SELECT * FROM gappy WHERE tc IS NOT NULL AND rain IS NOT NULL")
def _(spark, sf):
    return quality.drop_incomplete(gappy(spark, sf))


@query("p5_zero_for_unknown", f"{ID} tc:d rain:d", f"WITH {GAPPY_SQL} SELECT point_id, timestamp, coalesce(tc, 0) AS tc, coalesce(rain, 0) AS rain FROM gappy")
def _(spark, sf):
    return gappy(spark, sf).na.fill(0.0)


FILL = """coalesce(first_value({x} IGNORE NULLS) OVER (PARTITION BY zone_id, point_id ORDER BY timestamp ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING),
  last_value({x} IGNORE NULLS) OVER (PARTITION BY zone_id, point_id ORDER BY timestamp ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) AS {x}"""


@query("p6_fill_within_point", f"{ID} tc:d rain:d", f"WITH {GAPPY_SQL} SELECT point_id, timestamp, {FILL.format(x='tc')}, {FILL.format(x='rain')} FROM gappy")
def _(spark, sf):
    return timeseries.fill_within(gappy(spark, sf), KEY, "timestamp", ["tc", "rain"])


@query("p7_points_in_and_out", f"{ID} held_out:b",
       f"WITH {SPLIT_SQL} SELECT point_id, timestamp, part = 'test' AS held_out FROM obs JOIN split USING (zone_id, point_id)")
def _(spark, sf):
    rows = t.obs(spark, sf)
    test = splits.three_way(rows, ["zone_id"]).filter("part = 'test'")
    inside = splits.keep_points(rows, test, KEY).withColumn("held_out", F.lit(True))
    return inside.unionByName(splits.drop_points(rows, test, KEY).withColumn("held_out", F.lit(False)))


@query("p8_monsoon_months", "point_id:s date:y precipitation_mm:d", f"WITH {t.DAILY_SQL} SELECT * FROM daily WHERE month(date) IN (6, 7, 8, 9)")
def _(spark, sf):
    return t.daily(spark, sf).filter(F.month("date").isin(dict(catalogs.SEASONS)["Monsoon (Jun-Sep)"]))


@query("p9_first_hours", f"{ID} temperature_2m_c:d",
       f"WITH {t.OBS_SQL} SELECT * FROM (SELECT *, row_number() OVER {ORDER} AS rn FROM obs) WHERE rn <= 48")
def _(spark, sf):
    return forecasts.first_hours(t.obs(spark, sf), KEY, 48)


@query("p10_known_days_since", "point_id:s date:y tmax_c:d tmin_c:d",
       f"WITH {t.DAILY_SQL} SELECT * FROM daily WHERE tmin_c > 3 AND date >= DATE '1997-03-01'")
def _(spark, sf):
    rows = t.daily(spark, sf).withColumn("tmin_c", F.when(c("tmin_c") > 3, c("tmin_c")))
    return rows.filter("tmax_c is not null and tmin_c is not null").filter(c("date") >= F.lit("1997-03-01").cast("date"))


@query("p11_serving_defaults", f"{ID} solar_radiation_w_m2:d soil_temperature_0_to_7cm_c:d soil_moisture_0_to_7cm_m3m3:d et0_evapotranspiration_mm:d surface_pressure_hpa:d relative_humidity_2m_pct:d",
       f"""WITH {t.OBS_SQL} SELECT point_id, timestamp, CASE WHEN k % 5 = 0 THEN 77.0e0 ELSE solar_radiation_w_m2 END AS solar_radiation_w_m2,
       CASE WHEN k % 3 = 0 THEN temperature_2m_c ELSE soil_temperature_0_to_7cm_c END AS soil_temperature_0_to_7cm_c,
       CASE WHEN k % 3 = 0 THEN 0.25e0 ELSE soil_moisture_0_to_7cm_m3m3 END AS soil_moisture_0_to_7cm_m3m3, et0_evapotranspiration_mm,
       CASE WHEN k % 4 = 0 THEN 960.0e0 ELSE surface_pressure_hpa END AS surface_pressure_hpa, relative_humidity_2m_pct FROM obs""")
def _(spark, sf):
    rows = t.obs(spark, sf).withColumns(
        {
            "soil_temperature_0_to_7cm_c": F.when(c("k") % 3 != 0, c("soil_temperature_0_to_7cm_c")),
            "soil_moisture_0_to_7cm_m3m3": F.when(c("k") % 3 != 0, c("soil_moisture_0_to_7cm_m3m3")),
            "surface_pressure_hpa": F.when(c("k") % 4 != 0, c("surface_pressure_hpa")),
            "given": F.when(c("k") % 5 == 0, F.create_map(F.lit("solar_radiation_w_m2"), F.lit(77.0))),
        }
    )
    return quality.serving_defaults(rows, "given")


@query("p12_request_checks", "location_id:s errors:s valid:b",
       f"""WITH {t.LOCATIONS_SQL}, r AS (SELECT location_id, latitude * 2.9e0 AS latitude, longitude, ordinal % 200 AS forecast_hours, elevation_m * 16 AS elevation_m FROM locations),
       e AS (SELECT location_id, concat_ws(';', CASE WHEN NOT latitude BETWEEN -90 AND 90 THEN 'latitude out of range' END, CASE WHEN NOT longitude BETWEEN -180 AND 180 THEN 'longitude out of range' END,
       CASE WHEN NOT forecast_hours BETWEEN 6 AND 168 THEN 'forecast_hours out of range' END, CASE WHEN NOT elevation_m BETWEEN -500 AND 9000 THEN 'elevation_m out of range' END) AS errors FROM r)
       SELECT *, errors = '' AS valid FROM e""")
def _(spark, sf):
    rows = t.locations(spark, sf).withColumns(
        {"latitude": c("latitude") * 2.9, "forecast_hours": c("ordinal") % 200, "elevation_m": c("elevation_m") * 16}
    )
    checked = quality.with_errors(rows, quality.range_errors(quality.REQUEST_RANGES))
    valid, quarantine = quality.split_valid(checked)
    stacked = valid.withColumns({"errors": F.lit(""), "valid": F.lit(True)}).unionByName(
        quarantine.withColumns({"errors": F.array_join("errors", ";"), "valid": F.lit(False)})
    )
    return stacked


@query("p13_order_checks", "point_id:s date:y errors:s",
       f"""WITH {t.DAILY_SQL} SELECT point_id, date, concat_ws(';', CASE WHEN tmin_c * 3 > tmax_c THEN 'min_temp_c above max_temp_c' END,
       CASE WHEN precipitation_mm > 8 THEN 'rainfall_min_mm above rainfall_max_mm' END) AS errors FROM daily""")
def _(spark, sf):
    rows = t.daily(spark, sf).withColumns(
        {"min_temp_c": c("tmin_c") * 3, "max_temp_c": c("tmax_c"), "rainfall_min_mm": c("precipitation_mm"), "rainfall_max_mm": F.lit(8.0)}
    )
    checks = quality.order_errors([("min_temp_c", "max_temp_c"), ("rainfall_min_mm", "rainfall_max_mm")])
    return quality.with_errors(rows, checks).withColumn("errors", F.array_join("errors", ";"))


@query("p14_fill_value_to_null", f"{ID} masked:d",
       f"WITH {t.OBS_SQL} SELECT point_id, timestamp, CASE WHEN k % 8 = 0 THEN NULL WHEN k % 8 = 1 THEN -998.5e0 ELSE temperature_2m_c END AS masked FROM obs")
def _(spark, sf):
    raw = F.when(c("k") % 8 == 0, -999.0 + (c("k") % 3) / 1000.0).when(c("k") % 8 == 1, -998.5).otherwise(c("temperature_2m_c"))
    return t.obs(spark, sf).withColumn("masked", quality.mask_nodata(raw))


@query("p15_real_warnings", "event_id:i warnings:s",
       """SELECT event_id, CASE event_id % 4 WHEN 0 THEN '' WHEN 1 THEN event_type || '|Squall' WHEN 2 THEN 'Squall' ELSE '' END AS warnings FROM events""")
def _(spark, sf):
    e = c("event_id")
    listed = (
        F.when(e % 4 == 0, F.array(F.lit(" NIL "), F.lit("")))
        .when(e % 4 == 1, F.array(c("event_type"), F.lit(" Squall ")))
        .when(e % 4 == 2, F.array(F.lit("No severe weather warning"), F.lit("Squall"), F.lit("none")))
    )
    return t.table(spark, sf, "events").select("event_id", F.array_join(real_warnings(listed), "|").alias("warnings"))


@query("p19_quality_gates", PROFILE + " no_nulls:b enough_rows:b passed:b",
       f"SELECT *, null_values = 0 AS no_nulls, total_rows > 1000 AS enough_rows, null_values = 0 AND total_rows > 1000 AS passed FROM ({PROFILE_SQL})")
def _(spark, sf):
    return quality.gates(profiled(spark, sf), 1000)
