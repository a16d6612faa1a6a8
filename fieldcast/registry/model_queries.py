"""Splits, models and evaluation. Tree models have no SQL twin; their inputs and metrics do."""

from __future__ import annotations

from pyspark.sql import functions as F

from fieldcast.operators import boosting, metrics, model_registry, residual_models, splits
from fieldcast.plans import features, fleet, forecasts, ingest
from fieldcast.registry import tables as t
from fieldcast.registry.aggregate_queries import ERRORS, GAP_SQL, SCORED_SQL, SEASON_CASE, SPLIT_SQL, compare_sql, errors_sql, gap, scored
from fieldcast.registry.base import query
from fieldcast.registry.feature_queries import RADII, ZONE_SQL, shifted_tiles
from fieldcast.session import settle, shared_folder

c = F.col
DOMAIN = ["zone_id"]
GAINS = "mae_improvement_pct:d rmse_improvement_pct:d"
TEMP_SQL = "30.0e0 - 0.0065e0 * elevation_m + 0.05e0 * relative_humidity_2m_pct + (37 * event_no) % 100 / 100.0e0"
#: Days of the month stand for months, so that the hours cover two years.
MOVED_SQL = "timestamp + to_months(CAST((day(timestamp) - 1) % 24 AS INTEGER))"
SIGNAL_SQL = f"""{t.OBS_SQL}, raw_signal AS (SELECT * REPLACE ({TEMP_SQL} AS temperature_2m_c) FROM obs),
signal AS ({t.loo_sql('raw_signal', {'temperature_2m_c': 'baseline_temp_c'})})"""


def signal(spark, sf):
    """Model inputs of observations whose temperature depends on height, humidity and noise."""
    noise = (37 * c("event_no")) % 100 / 100.0
    temp = 30.0 - 0.0065 * c("elevation_m") + 0.05 * c("relative_humidity_2m_pct") + noise
    obs = t.obs(spark, sf).withColumn("temperature_2m_c", temp)
    rows = features.complete_features(features.engineer_features(obs), stations=features.station_list(obs))
    # Fits pass over the rows many times; the plan behind them runs once.
    return settle(rows.select("zone_id", "point_id", "timestamp", "temperature_2m_c", "residual_anomaly_c", "latitude", "longitude", *residual_models.FEATURES_28))


def two_years(rows):
    return rows.withColumn("timestamp", F.expr("timestamp + make_interval(0, CAST((day(timestamp) - 1) % 24 AS INT))"))


def plain_errors(rows, by):
    """Counts and errors of the coarse baseline, which need no model."""
    return residual_models.evaluate(residual_models.with_residual(rows, F.lit(0.0)), by)


@query("m1_three_way_split", "zone_id:s point_id:s part:s", f"WITH {SPLIT_SQL} SELECT * FROM split")
def _(spark, sf):
    return splits.three_way(t.obs(spark, sf), DOMAIN)


@query("m2_evenly_spaced_split", "zone_id:s point_id:s part:s",
       f"""WITH {t.POINTS_SQL}, n AS (SELECT zone_id, count(*) AS n, CAST(greatest(1, round_even(count(*) * 0.22e0, 0)) AS BIGINT) AS k FROM points GROUP BY 1),
       chosen AS (SELECT DISTINCT zone_id, i * (n - 1) // greatest(k - 1, 1) AS r FROM (SELECT *, unnest(range(k)) AS i FROM n)),
       ranked AS (SELECT zone_id, point_id, row_number() OVER (PARTITION BY zone_id ORDER BY point_id) - 1 AS r FROM points)
       SELECT ranked.*, CASE WHEN chosen.r IS NULL THEN 'train' ELSE 'test' END AS part FROM ranked LEFT JOIN chosen USING (zone_id, r)""")
def _(spark, sf):
    return splits.evenly_spaced(t.obs(spark, sf), DOMAIN)


@query("m3_spatial_cross_validation", f"zone_id:s fold:i rows:i val_points_count:i best_iteration:i {ERRORS} {GAINS}")
def _(spark, sf):
    return residual_models.cross_validate(signal(spark, sf))


BASE = "baseline_mae:d baseline_rmse:d baseline_r2:d"
BASE_SQL = errors_sql("temperature_2m_c", "baseline_temp_c", "baseline")


@query("m3_fold_baselines", f"zone_id:s fold:i rows:i val_points_count:i {BASE}",
       f"""WITH {SIGNAL_SQL}, listed AS (SELECT zone_id, point_id, ntile(5) OVER (PARTITION BY zone_id ORDER BY md5(point_id || '42'), point_id) AS fold FROM (SELECT DISTINCT zone_id, point_id FROM signal))
       SELECT zone_id, fold, count(*) AS rows, count(DISTINCT point_id) AS val_points_count, {BASE_SQL} FROM signal JOIN listed USING (zone_id, point_id) GROUP BY 1, 2""")
def _(spark, sf):
    rows = signal(spark, sf)
    labelled = rows.join(splits.folds(rows, DOMAIN), features.POINT)
    stations = labelled.groupBy("zone_id", "fold").agg(F.count_distinct("point_id").alias("val_points_count"))
    return plain_errors(labelled, ["zone_id", "fold"]).join(stations, ["zone_id", "fold"])


@query("m3_cross_validation_summary", "zone_id:s folds:i mean_baseline_rmse:d mean_downscaled_rmse:d mean_rmse_improvement_pct:d std_rmse_improvement_pct:d")
def _(spark, sf):
    return metrics.fold_summary(residual_models.cross_validate(signal(spark, sf)), DOMAIN)


def zone_models(rows, settings=residual_models.ZONE):
    labels = splits.three_way(rows, DOMAIN)
    return labels, residual_models.train_zone_models(rows, labels, settings)


@query("m4_boosted_residual_model", f"zone_id:s rows:i {ERRORS} {GAINS}")
def _(spark, sf):
    rows = signal(spark, sf)
    labels, trees = zone_models(rows)
    test = splits.keep_points(rows, labels.filter("part = 'test'"), features.POINT)
    return residual_models.evaluate(residual_models.score_trees(test, trees), DOMAIN)


@query("m4_split_baselines", f"zone_id:s part:s rows:i {BASE}",
       f"WITH {SIGNAL_SQL}, {SPLIT_SQL[len(t.OBS_SQL) + 2:]} SELECT zone_id, part, count(*) AS rows, {BASE_SQL} FROM signal JOIN split USING (zone_id, point_id) GROUP BY 1, 2")
def _(spark, sf):
    rows = signal(spark, sf)
    return plain_errors(rows.join(splits.three_way(rows, DOMAIN), features.POINT), ["zone_id", "part"])


@query("m5_quality_gate", "zone_id:s baseline_rmse:d downscaled_rmse:d gate_passed:b",
       f"WITH {SCORED_SQL} SELECT *, downscaled_rmse < baseline_rmse AND downscaled_mae < baseline_mae AS gate_passed FROM ({compare_sql('scored', 'zone_id')})")
def _(spark, sf):
    return metrics.quality_gate(residual_models.evaluate(scored(spark, sf), DOMAIN))


@query("m6_model_registry", "zone_id:s version:s test_samples:i train_samples:i val_samples:i trees:i stored_trees:i downscaled_rmse:d gate_passed:b anchor_mean_elevation_m:d anchor_points:s min_lat:d max_lon:d features_list:s")
def _(spark, sf):
    rows, root = signal(spark, sf), shared_folder(spark)
    labels, trees = zone_models(rows)
    residual_models.register(rows, labels, trees, root, "1")
    latest = model_registry.current(model_registry.entries(spark, root))
    # What the registered paths hold, read back from there.
    stored = spark.read.parquet(f"{root}/trees/version=1").groupBy("model").agg(F.count_if(c("tree") >= 0).alias("stored_trees"))
    return latest.join(stored, latest["zone_id"] == stored["model"])


def importances(spark, sf):
    return boosting.importance(zone_models(signal(spark, sf))[1], residual_models.FEATURES_28)


@query("m7_feature_importances", "zone_id:s feature:s importance:d")
def _(spark, sf):
    return importances(spark, sf).withColumnRenamed("model", "zone_id")


@query("t3_top_importances", "zone_id:s rank:i feature:s importance:d")
def _(spark, sf):
    return residual_models.top_importances(importances(spark, sf)).withColumnRenamed("model", "zone_id")


@query("m8_random_forest", f"zone_id:s rows:i {ERRORS} {GAINS}")
def _(spark, sf):
    rows = signal(spark, sf)
    labelled = rows.join(splits.three_way(rows, DOMAIN), features.POINT)
    scored = residual_models.forest_score(labelled.filter("part = 'train'"), labelled.filter("part = 'test'"), residual_models.FEATURES_21)
    return residual_models.evaluate(scored, DOMAIN)


@query("m9_shallow_and_deep_boosting", f"n_features:i rows:i {ERRORS} {GAINS}")
def _(spark, sf):
    rows = signal(spark, sf)
    labels = splits.three_way(rows, DOMAIN)
    test, table = splits.keep_points(rows, labels.filter("part = 'test'"), features.POINT), None
    unheld = labels.filter("part <> 'validation'")
    for names, settings, parts in ((residual_models.FEATURES_17, residual_models.SHALLOW, unheld), (residual_models.FEATURES_21, residual_models.DEEP, labels), (residual_models.FEATURES_28, residual_models.DEEP, labels)):
        trees = residual_models.train_zone_models(rows, parts, settings, names)
        row = residual_models.evaluate(residual_models.score_trees(test, trees, names)).withColumn("n_features", F.lit(len(names)))
        table = row if table is None else table.unionByName(row)
    return table


@query("m10_lapse_models", f"model:s rows:i {ERRORS} {GAINS}",
       f"""WITH {SCORED_SQL}, line AS (SELECT zone_id, regr_slope(y, x) AS b, regr_intercept(y, x) AS a FROM (SELECT zone_id, temperature_2m_c - baseline_temp_c AS y,
         elevation_m - avg(elevation_m) OVER (PARTITION BY zone_id) AS x FROM based) GROUP BY 1),
       fitted AS (SELECT * REPLACE (baseline_temp_c + a + b * (elevation_m - m) AS downscaled_temp_c) FROM scored JOIN line USING (zone_id) JOIN (SELECT zone_id, avg(elevation_m) AS m FROM obs GROUP BY 1) USING (zone_id))
       SELECT 'standard' AS model, * FROM ({compare_sql('scored')}) UNION ALL SELECT 'fitted' AS model, * FROM ({compare_sql('fitted')})""")
def _(spark, sf):
    rows = scored(spark, sf)
    fitted = residual_models.fitted_lapse_score(rows, rows, DOMAIN)
    return (
        residual_models.evaluate(rows).withColumn("model", F.lit("standard"))
        .unionByName(residual_models.evaluate(fitted).withColumn("model", F.lit("fitted")))
    )


def board(spark, sf):
    rows = signal(spark, sf)
    return residual_models.leaderboard(rows, splits.three_way(rows, DOMAIN))


@query("m11_leaderboard", f"model:s n_features:i rows:i {ERRORS} {GAINS}")
def _(spark, sf):
    return board(spark, sf)


@query("u5_stacked_leaderboard", "model:s downscaled_rmse:d rank:i")
def _(spark, sf):
    from pyspark.sql import Window as W

    # Seven rows, one per model.
    return board(spark, sf).withColumn("rank", F.row_number().over(W.partitionBy("rows").orderBy("downscaled_rmse")))


@query("m12_fleet_training", f"zone_id:s records:i stations:i test_samples:i trees:i {ERRORS} {GAINS} gate_passed:b error:s")
def _(spark, sf):
    return fleet.train_fleet(signal(spark, sf), shared_folder(spark))


@query("m13_temporal_holdout", f"scope:s rows:i {ERRORS} {GAINS}",
       f"""WITH {SCORED_SQL}, {SPLIT_SQL[len(t.OBS_SQL) + 2:]}, moved AS (SELECT * REPLACE ({MOVED_SQL} AS timestamp) FROM scored),
       year_of AS (SELECT *, timestamp AS date FROM moved WHERE year(timestamp) = 2025), seasons AS (SELECT *, {SEASON_CASE} AS scope FROM year_of)
       SELECT 'all_points' AS scope, * FROM ({compare_sql('year_of')}) UNION ALL BY NAME SELECT 'unseen_points' AS scope, * FROM ({compare_sql("(SELECT * FROM year_of JOIN split USING (zone_id, point_id) WHERE part = 'test')")})
       UNION ALL BY NAME ({compare_sql('seasons', 'scope')})""")
def _(spark, sf):
    return fleet.temporal_holdout(two_years(scored(spark, sf)), splits.three_way(t.obs(spark, sf), DOMAIN), 2025)


@query("m13_trained_holdout", f"scope:s rows:i {ERRORS} {GAINS}")
def _(spark, sf):
    return fleet.trained_holdout(two_years(signal(spark, sf)), 2025)


@query("m14_serving_gap", "point_id:s total_hours:i baseline_mae:d downscaled_mae:d baseline_rmse:d downscaled_rmse:d rmse_improvement_pct:d",
       f"""WITH {GAP_SQL}, g AS (SELECT point_id, count(*) AS total_hours, avg(abs(temperature_2m_c - truth)) AS baseline_mae, avg(abs(served - truth)) AS downscaled_mae,
       sqrt(avg((temperature_2m_c - truth) ** 2)) AS baseline_rmse, sqrt(avg((served - truth) ** 2)) AS downscaled_rmse FROM gap GROUP BY GROUPING SETS ((point_id), ()))
       SELECT *, (baseline_rmse - downscaled_rmse) / greatest(baseline_rmse, 1e-6) * 100 AS rmse_improvement_pct FROM g""")
def _(spark, sf):
    rows = gap(spark, sf).withColumns({"delta_elevation_m": c("elevation_m") - 380.0, "downscaled_value": c("served")})
    pairs = fleet.serving_gap(rows, t.obs(spark, sf), features.POINT)
    return metrics.rollup_by_place(pairs, "point_id", "t_proxy", "t_base", "downscaled_value")


RAISED_SQL = "SELECT zone_id, arg_min(point_id, md5(point_id || strftime(timestamp, '%Y-%m-%d %H'))) AS point_id, arg_min(timestamp, md5(point_id || strftime(timestamp, '%Y-%m-%d %H'))) AS timestamp FROM obs GROUP BY 1"


@query("m15_leakage_audit", "zone_id:s point_id:s timestamp:t max_feature_change:d target_change:d",
       f"WITH {t.OBS_SQL} SELECT *, 0.0e0 AS max_feature_change, 5.0e0 AS target_change FROM ({RAISED_SQL})")
def _(spark, sf):
    # One station at one hour per zone, so that no two raised values meet in one baseline.
    return fleet.leakage_audit(t.obs(spark, sf), 5.0)


def fleet_registry(spark, sf):
    """Registered models of all zones but the last by name, whose rows the default zone's model serves."""
    rows, root = signal(spark, sf), shared_folder(spark)
    last = rows.agg(F.max("zone_id")).first()[0]
    taught = rows.filter(c("zone_id") != last) if rows.select("zone_id").distinct().count() > 1 else rows
    labels, trees = zone_models(taught)
    residual_models.register(taught, labels, trees, root, "1")
    return rows, model_registry.entries(spark, root)


@query("m16_batch_scoring", "point_id:s timestamp:t zone_id:s model_zone:s downscaled_value:d confidence_score:d")
def _(spark, sf):
    rows, registry = fleet_registry(spark, sf)
    return forecasts.downscale(rows, registry, registry.agg(F.min("zone_id")).first()[0])


@query("d23_zone_ingest", "zone_id:s stations:i rows:i mean_baseline:d mean_delta:d mean_position:d mean_slope:d mean_insolation:d",
       f"""WITH {ZONE_SQL} SELECT zone_id, count(DISTINCT point_id) AS stations, count(*) AS rows, avg(baseline_temp_c) AS mean_baseline, avg(abs(delta_elevation_m)) AS mean_delta,
       avg(topographic_position_index) AS mean_position, avg(slope_magnitude_deg) AS mean_slope, avg(sloped_solar_insolation) AS mean_insolation FROM complete GROUP BY 1""")
def _(spark, sf):
    rows, table = t.obs(spark, sf), shared_folder(spark)
    # Low stations land first, then high ones alone, then everything: later hours of all stations.
    early = F.dayofmonth("timestamp") <= 14
    ingest.ingest_zones(spark, rows.where((c("elevation_m") < 500) & early), table)
    ingest.ingest_zones(spark, rows.where((c("elevation_m") >= 500) & early), table)
    ingest.ingest_zones(spark, rows, table)
    return ingest.zone_table(spark, table, t.dem(spark, sf), shifted_tiles(spark, sf), RADII).groupBy("zone_id").agg(
        F.count_distinct("point_id").alias("stations"), F.count(F.lit(1)).alias("rows"), F.avg("baseline_temp_c").alias("mean_baseline"), F.avg(F.abs("delta_elevation_m")).alias("mean_delta"),
        F.avg("topographic_position_index").alias("mean_position"), F.avg("slope_magnitude_deg").alias("mean_slope"), F.avg("sloped_solar_insolation").alias("mean_insolation"),
    )
