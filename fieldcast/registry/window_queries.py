"""Ordered and per-hour window operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from fieldcast.functions import physics, spraying
from fieldcast.operators import baselines, indices, lookups, splits, timeseries
from fieldcast.plans import features
from fieldcast.registry import tables as t
from fieldcast.registry.base import query
from fieldcast.registry.scalar_queries import LOCAL_SQL, SCORE, SPRAYABLE

c = F.col
KEY = features.POINT
ID = "point_id:s timestamp:t"
ORDER = "(PARTITION BY zone_id, point_id ORDER BY timestamp)"


@query("w1_leave_one_out", f"{ID} baseline_temp_c:d residual_anomaly_c:d",
       f"WITH {t.BASED_SQL} SELECT *, temperature_2m_c - baseline_temp_c AS residual_anomaly_c FROM based")
def _(spark, sf):
    return features.with_baselines(t.obs(spark, sf), baselines.TEMPERATURE_ONLY)


@query("w2_leave_one_out_five", f"{ID} " + " ".join(f"{b}:d" for b in baselines.TARGETS.values()),
       f"WITH {LOCAL_SQL} SELECT * FROM based")
def _(spark, sf):
    return features.with_baselines(t.obs(spark, sf))


@query("w3_three_row_change", f"{ID} thermal_inertia_lag_3h:d",
       f"WITH {t.OBS_SQL} SELECT *, coalesce(temperature_2m_c - lag(temperature_2m_c, 3) OVER {ORDER}, 0) AS thermal_inertia_lag_3h FROM obs")
def _(spark, sf):
    lag = {"thermal_inertia_lag_3h": timeseries.difference("temperature_2m_c", 3)}
    return timeseries.near_rows(t.obs(spark, sf), KEY, "timestamp", lag, back=3)


@query("w4_domain_mean_change", "zone_id:s point_id:s timestamp:t thermal_inertia_lag_3h:d",
       f"""WITH {t.BASED_SQL}, m AS (SELECT zone_id, timestamp, avg(baseline_temp_c) AS m FROM based GROUP BY 1, 2),
       d AS (SELECT zone_id, timestamp, coalesce(m - lag(m, 3) OVER (PARTITION BY zone_id ORDER BY timestamp), 0) AS thermal_inertia_lag_3h FROM m)
       SELECT * FROM based LEFT JOIN d USING (zone_id, timestamp)""")
def _(spark, sf):
    return features.domain_lag(features.with_baselines(t.obs(spark, sf), baselines.TEMPERATURE_ONLY))


@query("w5_forecast_lag", f"{ID} thermal_inertia_lag_3h:d",
       f"""WITH {t.OBS_SQL}, f AS (SELECT *, CASE WHEN k % 10 <> 3 THEN temperature_2m_c END AS tc FROM obs)
       SELECT *, coalesce(CASE WHEN row_number() OVER w > 3 AND tc - lag(tc, 3) OVER w IS NOT NULL THEN tc - lag(tc, 3) OVER w
         WHEN row_number() OVER w > 1 THEN tc - first_value(tc) OVER w END, 0) AS thermal_inertia_lag_3h FROM f WINDOW w AS {ORDER}""")
def _(spark, sf):
    rows = t.obs(spark, sf).withColumn("tc", F.when(c("k") % 10 != 3, c("temperature_2m_c")))
    starts = rows.groupBy(*KEY).agg(F.min_by(F.struct("tc"), "timestamp").alias("_s")).select(*KEY, c("_s.tc").alias("_start"))
    numbered = timeseries.number_rows(rows, KEY, "timestamp", "_no").join(starts, KEY)
    lag = {"thermal_inertia_lag_3h": timeseries.forecast_lag("tc", "_no", "_start")}
    return timeseries.near_rows(numbered, KEY, "timestamp", lag, back=3, numbered="_no")


@query("w5b_simple_forecast_lag", f"{ID} lag_c:d",
       f"WITH {t.OBS_SQL} SELECT *, coalesce(round(temperature_2m_c - lag(temperature_2m_c, 3) OVER {ORDER} + 1e-9, 4), 0) AS lag_c FROM obs")
def _(spark, sf):
    lag = {"lag_c": lambda w: F.coalesce(F.round(c("temperature_2m_c") - F.lag("temperature_2m_c", 3).over(w) + 1e-9, 4), F.lit(0.0))}
    return timeseries.near_rows(t.obs(spark, sf), KEY, "timestamp", lag, back=3)


RUNS_SQL = f"""{t.SERIES_SQL},
flagged AS (SELECT *, {SCORE} AS suitability, ({SPRAYABLE}) AND {SCORE} >= 65 AS good, row_number() OVER {ORDER} AS rn FROM series),
islands AS (SELECT *, rn - row_number() OVER (PARTITION BY zone_id, point_id, good ORDER BY timestamp) AS window_id FROM flagged)"""


@query("w6_sprayable_runs", f"{ID} window_id:i", f"WITH {RUNS_SQL} SELECT * FROM islands WHERE good")
def _(spark, sf):
    return indices.spray_hours(t.series(spark, sf), KEY)


@query("w7_day_chunks", f"{ID} chunk:i", f"WITH {t.OBS_SQL} SELECT *, (row_number() OVER {ORDER} - 1) // 24 AS chunk FROM obs")
def _(spark, sf):
    numbered = timeseries.number_rows(t.obs(spark, sf), KEY, "timestamp")
    return numbered.withColumn("chunk", timeseries.chunk_number(c("row_no")))


@query("w8_trailing_rain", f"{ID} antecedent_precipitation_7d_mm:d",
       f"WITH {t.OBS_SQL} SELECT *, sum(precipitation_mm) OVER (PARTITION BY zone_id, point_id ORDER BY timestamp ROWS BETWEEN 167 PRECEDING AND CURRENT ROW) "
       "AS antecedent_precipitation_7d_mm FROM obs")
def _(spark, sf):
    trailing = {"antecedent_precipitation_7d_mm": timeseries.trailing_sum("precipitation_mm", 168)}
    return timeseries.near_rows(t.obs(spark, sf), KEY, "timestamp", trailing, back=168)


@query("w9_moisture_a_day_before", f"{ID} soil_moisture_lag_24h_m3m3:d",
       f"""WITH {t.OBS_SQL} SELECT *, coalesce(lag(soil_moisture_0_to_7cm_m3m3, 24) OVER {ORDER},
       first_value(soil_moisture_0_to_7cm_m3m3) OVER {ORDER}) AS soil_moisture_lag_24h_m3m3 FROM obs""")
def _(spark, sf):
    return timeseries.lag_with_backfill(
        t.obs(spark, sf), KEY, "timestamp", "soil_moisture_0_to_7cm_m3m3", 24, "soil_moisture_lag_24h_m3m3"
    )


@query("w10_year_to_date_degree_days", f"{ID} accumulated_gdd_c:d",
       f"""WITH {t.OBS_SQL} SELECT *, sum(greatest(0.0e0, (temperature_2m_c - 10) / 24)) OVER (PARTITION BY zone_id, point_id, year(timestamp)
       ORDER BY timestamp ROWS UNBOUNDED PRECEDING) AS accumulated_gdd_c FROM obs""")
def _(spark, sf):
    share = physics.hourly_degree_share(c("temperature_2m_c"))
    return timeseries.year_to_date(t.obs(spark, sf), KEY, "timestamp", share, "accumulated_gdd_c")


@query("w10_daily_degree_days", "point_id:s date:y accumulated_gdd_c:d",
       f"""WITH {t.DAILY_SQL} SELECT *, sum(greatest(0.0e0, (tmax_c + tmin_c) / 2 - 10)) OVER (PARTITION BY point_id, year(date)
       ORDER BY date ROWS UNBOUNDED PRECEDING) AS accumulated_gdd_c FROM daily""")
def _(spark, sf):
    gained = indices.degree_days(c("tmax_c"), c("tmin_c"), F.lit(10.0))
    return timeseries.year_to_date(t.daily(spark, sf), ["point_id"], "date", gained, "accumulated_gdd_c")


@query("w11_first_source_wins", "point_id:s date:y tmax_c:d source:s",
       f"""WITH {t.DAILY_SQL}, both_ AS (SELECT point_id, date, tmax_c, 'archive' AS source, 1 AS p FROM daily WHERE status = 'F'
       UNION ALL SELECT point_id, date, tmax_c + 1 AS tmax_c, 'forecast' AS source, 2 AS p FROM daily WHERE tmin_c > 1)
       SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY point_id, date ORDER BY p) AS rn FROM both_) WHERE rn = 1""")
def _(spark, sf):
    rows = t.daily(spark, sf)
    archive = rows.filter("status = 'F'").withColumn("source", F.lit("archive"))
    forecast = rows.filter("tmin_c > 1").withColumns({"tmax_c": c("tmax_c") + 1, "source": F.lit("forecast")})
    return lookups.merge_daily(archive, forecast, ["point_id"])


@query("w12_spatial_folds", "zone_id:s point_id:s fold:i",
       f"""WITH {t.POINTS_SQL} SELECT zone_id, point_id, ntile(5) OVER (PARTITION BY zone_id ORDER BY md5(point_id || '42'), point_id) AS fold FROM points""")
def _(spark, sf):
    return splits.folds(t.obs(spark, sf), ["zone_id"], 5)
