"""Spatial hold-outs. Whole stations go to one side; ranking runs over the station list,
never over the hourly rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def stations(df: DataFrame, domain: list[str]) -> DataFrame:
    return df.select(*domain, "point_id").distinct()


def seeded_order(seed: int) -> Column:
    return F.md5(F.concat(F.col("point_id"), F.lit(str(seed))))


def _counted(points: DataFrame, domain: list[str], fraction: dict[str, float]) -> DataFrame:
    totals = points.groupBy(*domain).agg(F.count(F.lit(1)).alias("_n"))
    sizes = {
        f"_{name}": F.greatest(F.lit(1), F.rint(F.col("_n") * share)).cast("bigint")
        for name, share in fraction.items()
    }
    return totals.withColumns(sizes)


def three_way(
    df: DataFrame, domain: list[str], test: float = 0.20, validation: float = 0.10, seed: int = 42
) -> DataFrame:
    """station -> test / validation / train. Hold-outs have one station at least and shrink,
    validation first, until a training station is left."""
    points = stations(df, domain)
    sized = _counted(points, domain, {"test": test, "val": validation})
    excess = F.greatest(F.lit(0), F.col("_test") + F.col("_val") - F.col("_n") + 1)
    sized = sized.withColumn("_excess", excess).withColumn(
        "_val_kept", F.greatest(F.lit(1), F.col("_val") - F.col("_excess"))
    )
    rest = F.col("_excess") - (F.col("_val") - F.col("_val_kept"))
    sized = sized.withColumn("_test_kept", F.greatest(F.lit(1), F.col("_test") - rest)).select(
        *domain, "_val_kept", "_test_kept"
    )
    rank = F.row_number().over(W.partitionBy(*domain).orderBy(seeded_order(seed), "point_id"))
    ranked = points.withColumn("_rank", rank).join(sized, domain)
    part = (
        F.when(F.col("_rank") <= F.col("_test_kept"), "test")
        .when(F.col("_rank") <= F.col("_test_kept") + F.col("_val_kept"), "validation")
        .otherwise("train")
    )
    return ranked.select(*domain, "point_id", part.alias("part"))


def evenly_spaced(df: DataFrame, domain: list[str], test: float = 0.22) -> DataFrame:
    """station -> test / train with test stations evenly spread over the sorted list."""
    points = stations(df, domain)
    sized = _counted(points, domain, {"test": test})
    spread = F.floor(F.col("_i") * (F.col("_n") - 1) / F.greatest(F.col("_test") - 1, F.lit(1)))
    chosen = (
        sized.withColumn("_i", F.explode(F.expr("sequence(0L, _test - 1)")))
        .select(*domain, (spread + 1).alias("_rank"))
        .distinct()
        .withColumn("_hit", F.lit(True))
    )
    rank = F.row_number().over(W.partitionBy(*domain).orderBy("point_id")).cast("bigint")
    ranked = points.withColumn("_rank", rank)
    part = F.when(F.col("_hit"), "test").otherwise("train")
    return ranked.join(chosen, [*domain, "_rank"], "left").select(*domain, "point_id", part.alias("part"))


def folds(df: DataFrame, domain: list[str], k: int = 5, seed: int = 42) -> DataFrame:
    """station -> fold 1..k, seeded; the first folds take the remainder."""
    spec = W.partitionBy(*domain).orderBy(seeded_order(seed), "point_id")
    return stations(df, domain).withColumn("fold", F.ntile(k).over(spec))


def keep_points(df: DataFrame, points: DataFrame, key: list[str]) -> DataFrame:
    return df.join(points.select(*key).distinct(), key, "left_semi")


def drop_points(df: DataFrame, points: DataFrame, key: list[str]) -> DataFrame:
    return df.join(points.select(*key).distinct(), key, "left_anti")


def split_check(labels: DataFrame, domain: list[str]) -> DataFrame:
    """Invariants of a labelling: how many stations, how many labelled twice, how many per part."""
    per_point = labels.groupBy(*domain, "point_id").agg(F.count_distinct("part").alias("_parts"))
    twice = per_point.groupBy(*domain).agg(
        F.count(F.lit(1)).alias("stations"), F.count_if(F.col("_parts") > 1).alias("in_two_parts")
    )
    parts = labels.groupBy(*domain).agg(
        *[F.count_if(F.col("part") == p).alias(f"{p}_stations") for p in ("train", "validation", "test")]
    )
    return twice.join(parts, domain)


def anchor_points(points: DataFrame, domain: list[str], count: int = 8) -> DataFrame:
    """The stations of each domain closest to its mean elevation (`domain_mean_elevation_m`)."""
    gap = F.abs(F.col("elevation_m") - F.col("domain_mean_elevation_m"))
    spec = W.partitionBy(*domain).orderBy("elevation_gap_m", "point_id")
    return (
        points.withColumn("elevation_gap_m", gap)
        .withColumn("anchor_rank", F.row_number().over(spec))
        .filter(F.col("anchor_rank") <= count)
    )
