"""Zone fleets: ingest, training, evaluation, leakage audit and satellite context."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldcast import catalogs
from fieldcast.operators import boosting, lookups, metrics, residual_models, spatial, splits
from fieldcast.operators.keys import meet
from fieldcast.plans import features
from fieldcast.session import settle

DOMAIN = ["zone_id"]


def dataset_manifest(df: DataFrame, name: str) -> DataFrame:
    """One row that describes a featured table: extent, stations, profile and columns."""
    one = F.lit(1).alias("_one")
    extent = df.agg(
        one,
        F.min("timestamp").alias("start_time"),
        F.max("timestamp").alias("end_time"),
        *[F.min(c).alias(f"min_{c}") for c in ("latitude", "longitude")],
        *[F.max(c).alias(f"max_{c}") for c in ("latitude", "longitude")],
    )
    stations = df.select("zone_id", "point_id").distinct().agg(one, F.count(F.lit(1)).alias("spatial_points"))
    profile = metrics.dataset_profile(df).withColumn("_one", one)
    return (
        extent.join(stations, "_one")
        .join(profile, "_one")
        .drop("_one")
        .withColumns({"dataset_name": F.lit(name), "columns": F.lit(",".join(df.columns))})
    )


def train_fleet(rows: DataFrame, root: str, version: str = "1", settings: boosting.Settings = residual_models.FLEET) -> DataFrame:
    """Train, evaluate and register every zone's own model, all of them side by side.

    One row per zone. A zone that cannot be trained or tested becomes a row with its error and
    does not stop the others.
    """
    labels = splits.three_way(rows, DOMAIN)
    trees = residual_models.train_zone_models(rows, labels, settings)
    added = residual_models.register(rows, labels, trees, root, version)
    sizes = rows.groupBy("zone_id").agg(F.count(F.lit(1)).alias("records"), F.count_distinct("point_id").alias("stations"))
    error = F.when(F.col("trees").isNull(), "no training station").when(F.col("test_samples").isNull(), "no test station")
    return meet(sizes, added, DOMAIN).withColumn("error", error)


def temporal_holdout(scored: DataFrame, labels: DataFrame, unseen_year: int) -> DataFrame:
    """Errors in a year: all stations, those of the test split, and each season."""
    year = scored.filter(F.year("timestamp") == unseen_year)
    unseen = splits.keep_points(year, labels.filter("part = 'test'"), ["zone_id", "point_id"])
    seasons = residual_models.evaluate(year.withColumn("scope", metrics.season(F.col("timestamp"))), ["scope"])
    everything = residual_models.evaluate(year).withColumn("scope", F.lit("all_points"))
    return everything.unionByName(residual_models.evaluate(unseen).withColumn("scope", F.lit("unseen_points"))).unionByName(seasons)


def trained_holdout(rows: DataFrame, unseen_year: int, settings: boosting.Settings = residual_models.ZONE) -> DataFrame:
    """Models of the years before, evaluated in a year they never saw; the test stations were not in their training either."""
    labels = splits.three_way(rows, DOMAIN)
    before = rows.filter(F.year("timestamp") < unseen_year)
    trees = residual_models.train_zone_models(before, labels, settings)
    scored = residual_models.score_trees(rows.filter(F.year("timestamp") == unseen_year), trees)
    return temporal_holdout(settle(scored), labels, unseen_year)


def serving_gap(served: DataFrame, coarse: DataFrame, key: list[str]) -> DataFrame:
    """Served and coarse temperature of the same hour beside the lapse-rate proxy truth."""
    hour = [*key, "timestamp"]
    pairs = served.select(*hour, "delta_elevation_m", "downscaled_value").join(
        coarse.select(*hour, F.col("temperature_2m_c").alias("t_base")), hour
    )
    proxy = F.col("t_base") + F.lit(-0.0065) * F.col("delta_elevation_m")
    return pairs.withColumn("t_proxy", proxy)


def raise_one_reading(obs: DataFrame, bump_c: float) -> DataFrame:
    """Add `raised`: true on one reading per zone, picked by hash, and `bumped_temp_c`."""
    order = F.md5(F.concat("point_id", F.date_format("timestamp", "yyyy-MM-dd HH")))
    picked = obs.groupBy("zone_id").agg(F.min_by(F.struct("point_id", "timestamp"), order).alias("_p"))
    hit = (F.col("point_id") == F.col("_p.point_id")) & (F.col("timestamp") == F.col("_p.timestamp"))
    marked = meet(obs, picked, ["zone_id"]).withColumn("raised", F.coalesce(hit, F.lit(False)))
    bump = F.when(F.col("raised"), F.lit(bump_c)).otherwise(F.lit(0.0))
    return marked.withColumn("bumped_temp_c", F.col("temperature_2m_c") + bump).drop("_p")


def leakage_audit(obs: DataFrame, bump_c: float, names: list[str] | None = None) -> DataFrame:
    """Change in the features and in the target of a reading whose own temperature is raised.

    A leak-free plan changes the target by the bump and no feature at all.
    """
    names = names or residual_models.FEATURES_28
    marked = settle(raise_one_reading(obs, bump_c))
    hour = ["zone_id", "point_id", "timestamp"]
    target = residual_models.TARGET
    stations = features.station_list(marked)

    def run(rows: DataFrame) -> DataFrame:
        table = features.complete_features(features.engineer_features(rows), stations=stations)
        return table.filter("raised").select(*hour, *names, target)

    before = run(marked.drop("bumped_temp_c"))
    after = run(marked.drop("temperature_2m_c").withColumnRenamed("bumped_temp_c", "temperature_2m_c"))
    old = before.select(*hour, *[F.col(n).alias(f"_b_{n}") for n in [*names, target]])
    biggest = F.greatest(*[F.abs(F.col(n) - F.col(f"_b_{n}")) for n in names])
    return old.join(after, hour).select(
        *hour, biggest.alias("max_feature_change"), (F.col(target) - F.col(f"_b_{target}")).alias("target_change")
    )


def satellite_context(points: DataFrame, items: DataFrame, key: list[str], reach_deg: float = 0.25) -> DataFrame:
    """Per point and collection: how many items lie within reach, and their mean measured moisture.

    Items of one place and points of one place are merged before they meet, so repeated
    passes over a field do not multiply rows. Points without any item stay.
    """
    spots = items.groupBy("collection", "latitude", "longitude").agg(
        F.count(F.lit(1)).alias("n"), F.sum("soil_moisture_m3_m3").alias("m"), F.count("soil_moisture_m3_m3").alias("k")
    )
    footprints = spots.select(
        "collection", "n", "m", "k",
        (F.col("longitude") - reach_deg).alias("west"), (F.col("longitude") + reach_deg).alias("east"),
        (F.col("latitude") - reach_deg).alias("south"), (F.col("latitude") + reach_deg).alias("north"),
    )
    sites = points.select("latitude", "longitude").distinct()
    near = spatial.covering(sites, footprints).groupBy("latitude", "longitude").agg(
        F.sum("n").alias("matched_items"),
        (F.sum("m") / F.nullif(F.sum("k"), F.lit(0))).alias("soil_moisture_m3_m3"),
        F.array_join(F.sort_array(F.collect_set("collection")), ",").alias("collections"),
    )
    return points.join(near, ["latitude", "longitude"], "left").withColumns(
        {
            "matched_items": F.coalesce("matched_items", F.lit(0)),
            "attribution": F.lit(catalogs.BHOONIDHI_ATTRIBUTION),
        }
    )


def telemetry_for(requests: DataFrame, locations: DataFrame, telemetry: DataFrame) -> DataFrame:
    """Telemetry of the location an identifier resolves to; unknown identifiers keep nulls."""
    found = lookups.find_locations(requests, locations)
    return lookups.with_telemetry(found, telemetry, "location_id").withColumn(
        "success", F.col("location_id").isNotNull()
    )
