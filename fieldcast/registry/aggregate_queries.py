"""Aggregations, sorts, top-k and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from fieldcast import catalogs
from fieldcast.operators import baselines, lookups, metrics, residual_models, spatial, splits, terrain
from fieldcast.plans import features, forecasts
from fieldcast.registry import tables as t
from fieldcast.registry.base import query
from fieldcast.sources import files

c = F.col

SCORED_SQL = f"""{t.BASED_SQL},
scored AS (SELECT *, baseline_temp_c - 0.0065e0 * (elevation_m - avg(elevation_m) OVER (PARTITION BY zone_id)) AS downscaled_temp_c FROM based)"""


def scored(spark, sf):
    """Baseline, and the lapse model as the model under test."""
    rows = features.with_baselines(features.with_domain(t.obs(spark, sf)), baselines.TEMPERATURE_ONLY)
    return residual_models.lapse_score(rows)


def errors_sql(actual: str, model: str, prefix: str) -> str:
    e = f"({model} - {actual})"
    return (
        f"avg(abs({e})) AS {prefix}_mae, sqrt(avg({e} * {e})) AS {prefix}_rmse, "
        f"1 - sum({e} * {e}) / greatest(var_pop({actual}) * count({e}), 1e-12) AS {prefix}_r2"
    )


def compare_sql(source: str, by: str = "", actual="temperature_2m_c", base="baseline_temp_c", model="downscaled_temp_c") -> str:
    head = f"{by}, " if by else ""
    group = f" GROUP BY {by}" if by else ""
    return f"""SELECT *, (baseline_mae - downscaled_mae) / nullif(baseline_mae, 0) * 100 AS mae_improvement_pct,
    (baseline_rmse - downscaled_rmse) / nullif(baseline_rmse, 0) * 100 AS rmse_improvement_pct FROM (
    SELECT {head}count(*) AS rows, {errors_sql(actual, base, 'baseline')}, {errors_sql(actual, model, 'downscaled')} FROM {source}{group})"""


ERRORS = "baseline_mae:d baseline_rmse:d baseline_r2:d downscaled_mae:d downscaled_rmse:d downscaled_r2:d"


@query("a1_domain_mean_elevation", "zone_id:s domain_mean_elevation_m:d",
       f"WITH {t.OBS_SQL} SELECT zone_id, avg(elevation_m) AS domain_mean_elevation_m FROM obs GROUP BY 1")
def _(spark, sf):
    return baselines.domain_elevation(t.obs(spark, sf))


@query("a2_hourly_mean", "zone_id:s timestamp:t mean_c:d",
       f"WITH {t.OBS_SQL} SELECT zone_id, timestamp, avg(temperature_2m_c) AS mean_c FROM obs GROUP BY 1, 2")
def _(spark, sf):
    return baselines.hourly_mean(t.obs(spark, sf), "temperature_2m_c", "mean_c")


@query("a3_distinct_points", "zone_id:s stations:i rows:i",
       f"WITH {t.OBS_SQL} SELECT zone_id, count(DISTINCT point_id) AS stations, count(*) AS rows FROM obs GROUP BY 1")
def _(spark, sf):
    # Rows per station first: the distinct count then runs over one row per station.
    stations = t.obs(spark, sf).groupBy("zone_id", "point_id").agg(F.count(F.lit(1)).alias("n"))
    return stations.groupBy("zone_id").agg(F.count(F.lit(1)).alias("stations"), F.sum("n").alias("rows"))


@query("a4_error_metrics", f"zone_id:s rows:i {ERRORS}", f"WITH {SCORED_SQL} {compare_sql('scored', 'zone_id')}")
def _(spark, sf):
    return residual_models.evaluate(scored(spark, sf), ["zone_id"])


@query("a5_improvement_percent", "point_id:s mae_improvement_pct:d rmse_improvement_pct:d",
       f"WITH {SCORED_SQL} {compare_sql('scored', 'point_id')}")
def _(spark, sf):
    return residual_models.evaluate(scored(spark, sf), ["point_id"])


SEASON_CASE = """CASE WHEN month(date) IN (1, 2) THEN 'Winter (Jan-Feb)' WHEN month(date) IN (3, 4, 5) THEN 'Pre-Monsoon Summer (Mar-May)'
  WHEN month(date) IN (6, 7, 8, 9) THEN 'Monsoon (Jun-Sep)' ELSE 'Post-Monsoon (Oct-Dec)' END"""


@query("a6_seasonal_errors", f"season:s rows:i {ERRORS} rmse_improvement_pct:d",
       f"""WITH {t.DAILY_SQL}, d AS (SELECT *, {SEASON_CASE} AS season, (tmax_c + tmin_c) / 2 AS base, tmax_c - 4.5e0 AS model FROM daily)
       {compare_sql('d', 'season', 'tmax_c', 'base', 'model')}""")
def _(spark, sf):
    rows = t.daily(spark, sf).withColumns({"base": (c("tmax_c") + c("tmin_c")) / 2, "model": c("tmax_c") - 4.5})
    return metrics.by_season(rows, "tmax_c", "base", "model", "date")


GAP_SQL = f"""{t.OBS_SQL}, gap AS (SELECT *, temperature_2m_c + -0.0065e0 * (elevation_m - 380) AS truth,
  temperature_2m_c + 0.1e0 * (k % 5 - 2) AS served FROM obs)"""


def gap(spark, sf):
    return t.obs(spark, sf).withColumns(
        {
            "truth": c("temperature_2m_c") + -0.0065 * (c("elevation_m") - 380.0),
            "served": c("temperature_2m_c") + 0.1 * (c("k") % 5 - 2),
        }
    )


@query("a7_error_rollup", "point_id:s total_hours:i baseline_mae:d downscaled_mae:d baseline_rmse:d downscaled_rmse:d rmse_improvement_pct:d",
       f"""WITH {GAP_SQL}, g AS (SELECT point_id, count(*) AS total_hours, avg(abs(temperature_2m_c - truth)) AS baseline_mae, avg(abs(served - truth)) AS downscaled_mae,
       sqrt(avg((temperature_2m_c - truth) ** 2)) AS baseline_rmse, sqrt(avg((served - truth) ** 2)) AS downscaled_rmse
       FROM gap GROUP BY GROUPING SETS ((point_id), ()))
       SELECT *, (baseline_rmse - downscaled_rmse) / greatest(baseline_rmse, 1e-6) * 100 AS rmse_improvement_pct FROM g""")
def _(spark, sf):
    return metrics.rollup_by_place(gap(spark, sf), "point_id", "truth", "temperature_2m_c", "served")


@query("a8_day_and_night", "part_of_day:s rows:i baseline_rmse:d downscaled_rmse:d rmse_reduction_pct:d",
       f"""WITH {GAP_SQL}, g AS (SELECT CASE WHEN hour(timestamp) BETWEEN 6 AND 18 THEN 'day' ELSE 'night' END AS part_of_day, count(*) AS rows,
       sqrt(avg((temperature_2m_c - truth) ** 2)) AS baseline_rmse, sqrt(avg((served - truth) ** 2)) AS downscaled_rmse FROM gap GROUP BY 1)
       SELECT *, (baseline_rmse - downscaled_rmse) / nullif(baseline_rmse, 0) * 100 AS rmse_reduction_pct FROM g""")
def _(spark, sf):
    return metrics.day_night(gap(spark, sf), "truth", "temperature_2m_c", "served")


FOLDS = "folds:i mean_baseline_rmse:d mean_downscaled_rmse:d mean_baseline_mae:d mean_downscaled_mae:d mean_downscaled_r2:d mean_rmse_improvement_pct:d std_rmse_improvement_pct:d"


@query("a9_fold_summary", FOLDS,
       f"""WITH {SCORED_SQL}, labelled AS (SELECT point_id, zone_id, ntile(5) OVER (PARTITION BY zone_id ORDER BY md5(point_id || '42'), point_id) AS fold
         FROM (SELECT DISTINCT zone_id, point_id FROM obs)),
       f AS ({compare_sql('(SELECT * FROM scored JOIN labelled USING (zone_id, point_id))', 'fold')})
       SELECT count(*) AS folds, avg(baseline_rmse) AS mean_baseline_rmse, avg(downscaled_rmse) AS mean_downscaled_rmse, avg(baseline_mae) AS mean_baseline_mae,
       avg(downscaled_mae) AS mean_downscaled_mae, avg(downscaled_r2) AS mean_downscaled_r2, avg(rmse_improvement_pct) AS mean_rmse_improvement_pct,
       stddev_pop(rmse_improvement_pct) AS std_rmse_improvement_pct FROM f""")
def _(spark, sf):
    labelled = scored(spark, sf).join(splits.folds(t.obs(spark, sf), ["zone_id"]), features.POINT)
    return metrics.fold_summary(residual_models.evaluate(labelled, ["fold"]))


@query("a10_fleet_averages", "zones:i total_records:i avg_baseline_rmse:d avg_downscaled_rmse:d avg_downscaled_mae:d avg_gain_pct:d pooled_drop_pct:d",
       f"""WITH {SCORED_SQL}, z AS ({compare_sql('scored', 'zone_id')}),
       a AS (SELECT count(*) AS zones, sum(rows) AS total_records, avg(baseline_rmse) AS avg_baseline_rmse, avg(downscaled_rmse) AS avg_downscaled_rmse,
         avg(downscaled_mae) AS avg_downscaled_mae, avg(rmse_improvement_pct) AS avg_gain_pct FROM z)
       SELECT *, (avg_baseline_rmse - avg_downscaled_rmse) / nullif(avg_baseline_rmse, 0) * 100 AS pooled_drop_pct FROM a""")
def _(spark, sf):
    return metrics.fleet_summary(residual_models.evaluate(scored(spark, sf), ["zone_id"]))


@query("a17_mean_shift", "point_id:s hours_evaluated:i mean_delta_t_c:d",
       f"WITH {t.SERIES_SQL} SELECT point_id, count(*) AS hours_evaluated, avg(downscaled_temp_1km_c - baseline_temp_c) AS mean_delta_t_c FROM series GROUP BY 1")
def _(spark, sf):
    rows = t.series(spark, sf).withColumn("delta_t_c", c("downscaled_temp_1km_c") - c("baseline_temp_c"))
    return forecasts.series_summary(rows, ["point_id"])


@query("a18_tile_report", "kind:s tile_count:i west:d south:d east:d north:d mean_pixel_lon_m:d mean_pixel_lat_m:d",
       f"""WITH {t.DEM_SQL}, m AS (SELECT *, radians((south + north) / 2) AS lat FROM tiles)
       SELECT kind, count(*) AS tile_count, min(west) AS west, min(south) AS south, max(east) AS east, max(north) AS north,
       avg(px_lon * abs(111412.84e0 * cos(lat) - 93.5e0 * cos(3 * lat))) AS mean_pixel_lon_m,
       avg(px_lat * abs(111132.92e0 - 559.82e0 * cos(2 * lat) + 1.175e0 * cos(4 * lat))) AS mean_pixel_lat_m FROM m GROUP BY 1""")
def _(spark, sf):
    return terrain.tile_report(t.tiles(spark, sf))


@query("a18_bounding_box", "zone_id:s min_lat:d max_lat:d min_lon:d max_lon:d",
       f"WITH {t.OBS_SQL} SELECT zone_id, min(latitude) AS min_lat, max(latitude) AS max_lat, min(longitude) AS min_lon, max(longitude) AS max_lon FROM obs GROUP BY 1")
def _(spark, sf):
    return spatial.bounding_box(t.obs(spark, sf), ["zone_id"])


PROFILE = "total_rows:i total_columns:i null_values:i min_temp_c:d max_temp_c:d precipitation_total_mm:d max_abs_residual_c:d"
PROFILE_SQL = f"""WITH {t.BASED_SQL} SELECT count(*) AS total_rows, 4 AS total_columns, count(*) - count(gust) AS null_values, min(temperature_2m_c) AS min_temp_c,
  max(temperature_2m_c) AS max_temp_c, sum(precipitation_mm) AS precipitation_total_mm, max(abs(temperature_2m_c - baseline_temp_c)) AS max_abs_residual_c
  FROM (SELECT *, CASE WHEN k % 9 <> 0 THEN wind_gusts_10m_kmh END AS gust FROM based)"""


def profiled(spark, sf):
    rows = features.with_baselines(t.obs(spark, sf), baselines.TEMPERATURE_ONLY)
    gust = F.when(c("k") % 9 != 0, c("wind_gusts_10m_kmh"))
    return metrics.dataset_profile(rows.select("temperature_2m_c", "precipitation_mm", "residual_anomaly_c", gust.alias("gust")))


@query("a19_dataset_profile", PROFILE, PROFILE_SQL)
def _(spark, sf):
    return profiled(spark, sf)


@query("a20_fitted_lapse_rate", "zone_id:s slope:d intercept:d",
       f"""WITH {SCORED_SQL} SELECT zone_id, regr_slope(y, x) AS slope, regr_intercept(y, x) AS intercept FROM
       (SELECT zone_id, temperature_2m_c - baseline_temp_c AS y, elevation_m - avg(elevation_m) OVER (PARTITION BY zone_id) AS x FROM based) GROUP BY 1""")
def _(spark, sf):
    return metrics.line_fit(scored(spark, sf), "delta_elevation_m", residual_models.TARGET, ["zone_id"])


PAIRS_SQL = """pairs AS (
  SELECT a.zone_id, a.point_id, a.elevation_m AS own, b.elevation_m AS other, b.point_id AS neighbour_id, b.latitude - a.latitude AS d_lat, b.longitude - a.longitude AS d_lon
  FROM points a JOIN points b ON a.zone_id = b.zone_id
    AND sqrt((b.latitude - a.latitude) ** 2 + (b.longitude - a.longitude) ** 2) > 0
    AND sqrt((b.latitude - a.latitude) ** 2 + (b.longitude - a.longitude) ** 2) <= {radius}),
around AS (
  SELECT zone_id, point_id, count(*) AS neighbours, avg(other) AS mean_neighbour_elevation_m,
    avg((other - own) / greatest(1e-5, abs(d_lat * 111000.0e0)) * sign(d_lat)) AS gradient_ns,
    avg((other - own) / greatest(1e-5, abs(d_lon * 100000.0e0)) * sign(d_lon)) AS gradient_ew
  FROM pairs GROUP BY 1, 2)"""


@query("a21_neighbourhood_means", "point_id:s neighbours:i mean_neighbour_elevation_m:d gradient_ns:d gradient_ew:d",
       f"WITH {t.POINTS_SQL}, {PAIRS_SQL.format(radius='0.45e0')} SELECT point_id, coalesce(neighbours, 0) AS neighbours, mean_neighbour_elevation_m, gradient_ns, gradient_ew "
       "FROM points LEFT JOIN around USING (zone_id, point_id)")
def _(spark, sf):
    return spatial.neighbourhood(t.points(spark, sf), spatial.FLEET_RADIUS_DEG, ["zone_id"])


@query("t1_ordered_observations", "point_id:s timestamp:t temperature_2m_c:d", f"WITH {t.OBS_SQL} SELECT * FROM obs ORDER BY point_id, timestamp")
def _(spark, sf):
    return t.obs(spark, sf).orderBy("point_id", "timestamp")


@query("t2_anchor_points", "zone_id:s point_id:s anchor_rank:i elevation_gap_m:d",
       f"""WITH {t.POINTS_SQL}, m AS (SELECT zone_id, avg(elevation_m) AS m FROM obs GROUP BY 1)
       SELECT * FROM (SELECT zone_id, point_id, abs(elevation_m - m) AS elevation_gap_m, row_number() OVER (PARTITION BY zone_id ORDER BY abs(elevation_m - m), point_id) AS anchor_rank
       FROM points JOIN m USING (zone_id)) WHERE anchor_rank <= 8""")
def _(spark, sf):
    rows = t.obs(spark, sf)
    points = t.points(spark, sf).join(baselines.domain_elevation(rows), "zone_id")
    return splits.anchor_points(points, ["zone_id"])


@query("t6_daily_by_date", "point_id:s date:y tmax_c:d tmin_c:d", f"WITH {t.DAILY_SQL} SELECT * FROM daily ORDER BY point_id, date")
def _(spark, sf):
    return t.daily(spark, sf).orderBy("point_id", "date")


PILOTS = ["CUSTOMER_00007", "CUSTOMER_00003", "CUSTOMER_00090", "CUSTOMER_00011"]


@query("t7_pilot_locations", "location_id:s pilot_order:i name:s",
       f"WITH {t.LOCATIONS_SQL}, p AS (SELECT * FROM (VALUES {t.values([(i + 1, p) for i, p in enumerate(PILOTS)])}) AS p(pilot_order, location_id)) "
       "SELECT * FROM locations JOIN p USING (location_id) ORDER BY pilot_order")
def _(spark, sf):
    return lookups.pilot_locations(t.locations(spark, sf), PILOTS)


@query("u1_stacked_points", "point_id:s timestamp:t temperature_2m_c:d part:s",
       f"WITH {t.OBS_SQL} SELECT point_id, timestamp, temperature_2m_c, 'even' AS part FROM obs WHERE point_no % 2 = 0 UNION ALL "
       "SELECT point_id, timestamp, temperature_2m_c, NULL AS part FROM obs WHERE point_no % 2 = 1")
def _(spark, sf):
    rows = t.obs(spark, sf)
    even = rows.filter("point_no % 2 = 0").withColumn("part", F.lit("even"))
    return files.union_all([even, rows.filter("point_no % 2 = 1")])


SPLIT_SQL = f"""{t.POINTS_SQL},
sized AS (SELECT zone_id, count(*) AS n, greatest(1, round_even(count(*) * 0.2e0, 0)) AS nt, greatest(1, round_even(count(*) * 0.1e0, 0)) AS nv FROM points GROUP BY 1),
ranked AS (SELECT zone_id, point_id, row_number() OVER (PARTITION BY zone_id ORDER BY md5(point_id || '42'), point_id) AS r FROM points),
split AS (SELECT zone_id, point_id, CASE WHEN r <= nt THEN 'test' WHEN r <= nt + nv THEN 'validation' ELSE 'train' END AS part FROM ranked JOIN sized USING (zone_id))"""


@query("u2_training_points", "zone_id:s point_id:s", f"WITH {SPLIT_SQL} SELECT zone_id, point_id FROM split WHERE part <> 'test'")
def _(spark, sf):
    rows = t.obs(spark, sf)
    held = splits.three_way(rows, ["zone_id"]).filter("part = 'test'").select("zone_id", "point_id")
    return splits.stations(rows, ["zone_id"]).exceptAll(held)


@query("u3_split_invariants", "zone_id:s stations:i in_two_parts:i train_stations:i validation_stations:i test_stations:i",
       f"""WITH {SPLIT_SQL} SELECT zone_id, count(DISTINCT point_id) AS stations, 0 AS in_two_parts, count(*) FILTER (part = 'train') AS train_stations,
       count(*) FILTER (part = 'validation') AS validation_stations, count(*) FILTER (part = 'test') AS test_stations FROM split GROUP BY 1""")
def _(spark, sf):
    return splits.split_check(splits.three_way(t.obs(spark, sf), ["zone_id"]), ["zone_id"])


@query("p17_region_filter", "zone_id:s zone_no:i rows:i",
       f"WITH {t.OBS_SQL} SELECT zone_id, zones.zone_no, count(*) AS rows FROM obs JOIN zones USING (zone_id) WHERE zones.zone_no IN (1, 2, 12) GROUP BY 1, 2")
def _(spark, sf):
    counts = t.obs(spark, sf).groupBy("zone_id").agg(F.count(F.lit(1)).alias("rows"))
    board = counts.join(F.broadcast(catalogs.zones(spark).select("zone_id", "zone_no")), "zone_id")
    return forecasts.region_filter(board, "MOUNTAIN")
