"""Residual temperature models: boosted trees per zone, a forest, lapse lines, and how they compare."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import RandomForestRegressor
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from fieldcast.functions.physics import lapse_delta
from fieldcast.operators import boosting, forest, metrics, model_registry, spatial, splits
from fieldcast.operators.keys import meet
from fieldcast.session import settle

TARGET = "residual_anomaly_c"

# --- fixed values: model inputs in their order ------------------------------------------
FEATURES_28 = [
    "delta_elevation_m", "theoretical_lapse_delta_c", "elevation_m", "topographic_position_index", "slope_magnitude_deg", "aspect_sin", "aspect_cos",
    "baseline_temp_c", "relative_humidity_2m_pct", "surface_pressure_hpa", "wind_speed_10m_kmh", "precipitation_mm", "solar_radiation_w_m2",
    "shortwave_radiation_w_m2", "soil_temperature_0_to_7cm_c", "soil_moisture_0_to_7cm_m3m3", "et0_evapotranspiration_mm", "vapor_pressure_deficit_kpa",
    "nocturnal_inversion_index", "solar_heating_interaction", "sloped_solar_insolation", "thermal_inertia_lag_3h", "soil_air_thermal_gradient",
    "latent_cooling_potential", "hour_sin", "hour_cos", "doy_sin", "doy_cos",
]
#: Inputs that the models with 21 and with 17 inputs do without.
NOT_IN_21 = ["topographic_position_index", "slope_magnitude_deg", "aspect_sin", "aspect_cos", "sloped_solar_insolation", "soil_air_thermal_gradient", "latent_cooling_potential"]
NOT_IN_17 = [*NOT_IN_21, "vapor_pressure_deficit_kpa", "nocturnal_inversion_index", "solar_heating_interaction", "thermal_inertia_lag_3h"]
FEATURES_21 = [f for f in FEATURES_28 if f not in NOT_IN_21]
FEATURES_17 = [f for f in FEATURES_28 if f not in NOT_IN_17]

# --- fixed values: how each model is trained ---------------------------------------------
ZONE = boosting.Settings(trees=6000, depth=8, rate=0.03, patience=200)
FLEET = boosting.Settings(trees=6000, depth=9, rate=0.03, patience=200)
FOLDS = boosting.Settings(trees=1000, depth=8, rate=0.03, patience=50)
SHALLOW = boosting.Settings(trees=300, depth=6, rate=0.05, rows=1.0, columns=1.0)
DEEP = boosting.Settings(trees=1200, depth=8, rate=0.03, patience=50)
FOREST = forest.Settings(trees=300, depth=14)


def assembler(features: list[str]) -> VectorAssembler:
    return VectorAssembler(inputCols=features, outputCol="features", handleInvalid="error")


def mllib_forest(s: forest.Settings) -> RandomForestRegressor:
    return RandomForestRegressor(
        labelCol=TARGET, featuresCol="features", predictionCol="predicted_residual_c", numTrees=s.trees, maxDepth=s.depth, maxBins=s.bins,
        minInstancesPerNode=s.least, featureSubsetStrategy="sqrt", seed=s.seed, maxMemoryInMB=512,
    )


def fit(rows: DataFrame, estimator, features: list[str]) -> PipelineModel:
    return Pipeline(stages=[assembler(features), estimator]).fit(rows)


def train_zone_models(rows: DataFrame, labels: DataFrame, settings: boosting.Settings = ZONE, features: list[str] | None = None) -> DataFrame:
    """Trees of every zone's own model, fitted on its training stations and stopped early on its validation stations.

    A zone without any training station has no trees; one without validation stations runs all rounds.
    """
    known = rows.join(labels, ["zone_id", "point_id"]).filter(F.col("part") != "test")
    held = F.array(F.col("part") == "validation")
    return boosting.fit(known, features or FEATURES_28, TARGET, F.array("zone_id"), held, settings)


def forest_score(train: DataFrame, rows: DataFrame, features: list[str], settings: forest.Settings = FOREST) -> DataFrame:
    """Prediction of one forest fitted on `train` and the temperature it implies.

    More rows than `memory_rows` are fitted by MLlib's forest, which deals rows rather than trees to tasks, at the same settings.
    """
    if train.count() > settings.memory_rows:
        model = fit(train, mllib_forest(settings), features)
        return with_residual(model.transform(rows).drop("features"), F.col("predicted_residual_c"))
    return score_trees(rows, forest.fit(train, features, TARGET, settings), features, F.lit(forest.NAME))


def score_trees(rows: DataFrame, trees: DataFrame, features: list[str] | None = None, model: Column | None = None, folder: str | None = None) -> DataFrame:
    """Prediction of each row's model (its zone's, unless named) and the temperature it implies; null where there is no such model.

    `folder` is where the trees are published, if they are.
    """
    features = features or FEATURES_28
    path = folder or model_registry.publish(trees)
    own = F.col("zone_id") if model is None else model
    named = trees.filter("tree = -1").select(F.col("model").alias("_name"))
    found = rows.withColumn("_model", own).join(named, F.col("_model") == F.col("_name"), "left").withColumn("_path", model_registry.path_of(path, F.col("_name")))
    scored = model_registry.predict(found.drop("_model", "_name"), features, "_path", "predicted_residual_c")
    return with_residual(scored.drop("_path"), F.col("predicted_residual_c"))


def with_residual(rows: DataFrame, residual: Column) -> DataFrame:
    return rows.withColumn("predicted_residual_c", residual).withColumn(
        "downscaled_temp_c", F.col("baseline_temp_c") + F.col("predicted_residual_c")
    )


def lapse_score(rows: DataFrame) -> DataFrame:
    """The analytic model: standard lapse rate times the height above the domain."""
    return with_residual(rows, lapse_delta(F.col("delta_elevation_m")))


def fitted_lapse_score(train: DataFrame, rows: DataFrame, domain: list[str]) -> DataFrame:
    """One-variable least squares of the residual on height, fitted on `train` per domain."""
    line = metrics.line_fit(train, "delta_elevation_m", TARGET, domain)
    joined = meet(rows, line, domain)
    return with_residual(joined, F.col("intercept") + F.col("slope") * F.col("delta_elevation_m")).drop(
        "slope", "intercept"
    )


def evaluate(scored: DataFrame, by: list[str] | None = None) -> DataFrame:
    return metrics.compare(scored, "temperature_2m_c", "baseline_temp_c", "downscaled_temp_c", by)


def top_importances(table: DataFrame, count: int = 10) -> DataFrame:
    """The inputs with the largest share in each model, ties by name."""
    ranked = F.row_number().over(W.partitionBy("model").orderBy(F.desc("importance"), "feature"))
    return table.withColumn("rank", ranked).filter(F.col("rank") <= count)


def cross_validate(rows: DataFrame, k: int = 5, features: list[str] | None = None, settings: boosting.Settings = FOLDS) -> DataFrame:
    """Spatial k-fold of every zone: metrics, stations and best round of each fold, whose stations are scored unseen.

    All folds of all zones are fitted side by side. The stations of a fold also stop its model early.
    """
    labelled = settle(rows.join(splits.folds(rows, ["zone_id"], k), ["zone_id", "point_id"]))
    name = lambda fold: F.concat("zone_id", F.lit(" "), fold.cast("string"))
    folds = F.array(*[F.lit(i) for i in range(1, k + 1)])
    trees = boosting.fit(labelled, features or FEATURES_28, TARGET, F.transform(folds, name), F.transform(folds, lambda i: i == F.col("fold")), settings)
    scored = score_trees(labelled, trees, features, name(F.col("fold")))
    table = evaluate(scored, ["zone_id", "fold"])
    stations = labelled.groupBy("zone_id", "fold").agg(F.count_distinct("point_id").alias("val_points_count"))
    rounds = trees.filter("tree = -1").select(F.col("model").alias("_model"), F.col("best_round").alias("best_iteration"))
    listed = table.join(stations, ["zone_id", "fold"]).withColumn("_model", name(F.col("fold")))
    return listed.join(rounds, "_model", "left").drop("_model")


def leaderboard(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """Baseline, two lapse models, a forest and three boosted models against the same held-out stations of every zone."""
    labelled = settle(rows.join(labels, ["zone_id", "point_id"]))
    train, test = labelled.filter("part = 'train'"), labelled.filter("part = 'test'")
    unheld = labels.filter("part <> 'validation'")
    entries = [
        ("coarse_baseline", 0, with_residual(test, F.lit(0.0))),
        ("standard_lapse", 1, lapse_score(test)),
        ("fitted_lapse", 1, fitted_lapse_score(train, test, ["zone_id"])),
        ("random_forest", 21, forest_score(train, test, FEATURES_21)),
        ("boosted_17", 17, score_trees(test, train_zone_models(rows, unheld, SHALLOW, FEATURES_17), FEATURES_17)),
        ("boosted_21", 21, score_trees(test, train_zone_models(rows, labels, DEEP, FEATURES_21), FEATURES_21)),
        ("boosted_28", 28, score_trees(test, train_zone_models(rows, labels, DEEP, FEATURES_28), FEATURES_28)),
    ]
    table = None
    for name, inputs, scored in entries:
        row = evaluate(scored).withColumns({"model": F.lit(name), "n_features": F.lit(inputs)})
        table = row if table is None else table.unionByName(row)
    return table


def register(rows: DataFrame, labels: DataFrame, trees: DataFrame, root: str, version: str, features: list[str] | None = None) -> DataFrame:
    """Publish every zone's trees and add a registry row for each: hold-out errors, gate, anchors, extent, inputs and the path that loads.

    Errors are those on the test stations, which the model has not seen. Anchors are at most eight per zone. Returns the rows added.
    """
    features = features or FEATURES_28
    folder = model_registry.publish(trees, root, version)
    held_out = rows.join(labels.filter("part = 'test'"), ["zone_id", "point_id"], "left_semi")
    results = metrics.quality_gate(evaluate(score_trees(held_out, trees, features, folder=folder), ["zone_id"])).withColumnRenamed("rows", "test_samples")
    sizes = rows.join(labels, ["zone_id", "point_id"]).groupBy("zone_id").agg(
        F.count_if(F.col("part") == "train").alias("train_samples"), F.count_if(F.col("part") == "validation").alias("val_samples")
    )
    stations = rows.select("zone_id", "point_id", "latitude", "longitude", "elevation_m").distinct()
    means = rows.groupBy("zone_id").agg(F.avg("elevation_m").alias("domain_mean_elevation_m"))
    anchors = splits.anchor_points(stations.join(means, "zone_id"), ["zone_id"]).groupBy("zone_id").agg(
        F.avg("elevation_m").alias("anchor_mean_elevation_m"), F.to_json(F.sort_array(F.collect_list(F.struct("point_id", "latitude", "longitude", "elevation_m")))).alias("anchor_points")
    )
    models = trees.filter("tree = -1").select(F.col("model").alias("zone_id"), "rounds", (F.col("best_round") + 1).alias("trees"), "validation_rmse")
    listed = models.join(sizes, "zone_id").join(results, "zone_id", "left").join(means, "zone_id").join(anchors, "zone_id").join(spatial.bounding_box(rows, ["zone_id"]), "zone_id")
    added = listed.withColumns({
        "version": F.lit(version), "model_path": model_registry.path_of(folder, F.col("zone_id")), "features_list": F.to_json(F.array(*[F.lit(f) for f in features])),
        "trained_at": F.current_timestamp(),
    })
    model_registry.append(added, root)
    return model_registry.entries(rows.sparkSession, root).filter(F.col("version") == version)
