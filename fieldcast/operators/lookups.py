"""Keyed lookups with defaults. Only the fixed catalogues are broadcast; registries of any
size are left to the optimizer, which checks their size at run time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldcast import catalogs
from fieldcast.functions.text import strip


def one_each(records: DataFrame, key: str, order: Column) -> DataFrame:
    """The last record of each key in some order, so that a lookup never multiplies rows; ties go by the whole record."""
    rest = [c for c in records.columns if c != key]
    last = F.max(F.struct(order.alias("_order"), *rest)).alias("_last")
    return records.groupBy(key).agg(last).select(key, *[F.col(f"_last.{c}").alias(c) for c in rest])


def location_aliases(locations: DataFrame) -> DataFrame:
    """alias -> location_id from id, name, local name and id stem; the later location wins."""
    names = F.array(
        F.lower("location_id"),
        F.lower("name"),
        F.col("name_hi"),
        F.lower(F.regexp_replace("location_id", "_[^_]*$", "")),
    )
    return (
        locations.select("location_id", "ordinal", F.explode(names).alias("alias"))
        .filter("alias is not null")
        .groupBy("alias")
        .agg(F.max_by("location_id", "ordinal").alias("location_id"))
    )


def find_locations(requests: DataFrame, locations: DataFrame, identifier: str = "identifier") -> DataFrame:
    """Resolve free-form identifiers; what is unknown keeps null location columns."""
    asked = requests.withColumn("_alias", F.lower(strip(F.col(identifier))))
    aliases = location_aliases(locations).withColumnRenamed("alias", "_alias")
    known = one_each(locations, "location_id", F.col("ordinal")).drop("ordinal")
    return asked.join(aliases, "_alias", "left").join(known, "location_id", "left").drop("_alias")


def pilot_locations(locations: DataFrame, pilots: list[str]) -> DataFrame:
    """The pilot locations that exist, in the order of the list."""
    place = F.array_position(F.array(*[F.lit(p) for p in pilots]), F.col("location_id"))
    return (
        locations.filter(F.col("location_id").isin(pilots)).withColumn("pilot_order", place).orderBy("pilot_order")
    )


def crop_profiles(requests: DataFrame) -> DataFrame:
    """Crop and stage data for (`crop`, `crop_stage`); unknown crops fall back to the default crop,
    unknown stages to the third stage of the crop, marked by `stage_matched`."""
    spark = requests.sparkSession
    keys = [row[0] for row in catalogs.CROPS]
    wanted = F.upper(strip(F.col("crop")))
    stages = catalogs.crop_stages(spark)
    fields = ["stage_water_demand", "stage_critical_pest", "stage_sensitivity"]
    fallback = stages.filter(F.col("stage_ordinal") == catalogs.DEFAULT_STAGE_ORDINAL).select(
        "crop_key", *[F.col(f).alias(f"_default_{f}") for f in fields]
    )
    named = stages.select("crop_key", F.col("stage").alias("crop_stage"), *fields)
    return (
        requests.withColumn("crop_key", F.when(wanted.isin(keys), wanted).otherwise(F.lit(catalogs.DEFAULT_CROP)))
        .join(F.broadcast(catalogs.crops(spark)), "crop_key", "left")
        .join(F.broadcast(named), ["crop_key", "crop_stage"], "left")
        .join(F.broadcast(fallback), "crop_key", "left")
        .withColumn("stage_matched", F.col("stage_sensitivity").isNotNull())
        .withColumns({f: F.coalesce(f, f"_default_{f}") for f in fields})
        .drop(*[f"_default_{f}" for f in fields])
    )


def crop_triggers(profiles: DataFrame) -> DataFrame:
    """One row per request and disease trigger of its crop."""
    return profiles.join(F.broadcast(catalogs.disease_triggers(profiles.sparkSession)), "crop_key", "left")


def with_benchmark(rows: DataFrame) -> DataFrame:
    """Published zone metrics, or the default row for a zone without any."""
    columns = ["baseline_rmse_c", "model_rmse_c", "error_reduction_pct"]
    joined = rows.join(F.broadcast(catalogs.zone_benchmarks(rows.sparkSession)), "zone_id", "left")
    return joined.withColumns(
        {c: F.coalesce(c, F.lit(d)) for c, d in zip(columns, catalogs.DEFAULT_BENCHMARK)}
    )


def with_model(rows: DataFrame, registry: DataFrame, default_path: str) -> DataFrame:
    """Model path of the row's zone (the last by name if it has several), else the default model."""
    models = registry.groupBy("zone_id").agg(F.max("model_path").alias("_path"))
    return (
        rows.join(models, "zone_id", "left")
        .withColumn("is_default_model", F.col("_path").isNull())
        .withColumn("model_path", F.coalesce("_path", F.lit(default_path)))
        .drop("_path")
    )


def short_key(identifier: Column, known: list[str] | None = None) -> Column:
    """Normalised telemetry key: a known name inside the id, else the part before `_`."""
    cleaned = F.lower(strip(identifier))
    stem = F.split(cleaned, "_").getItem(0)
    cases = None
    for name in known or []:
        cases = (F if cases is None else cases).when(cleaned.contains(name), F.lit(name))
    return stem if cases is None else cases.otherwise(stem)


def with_telemetry(
    rows: DataFrame, telemetry: DataFrame, identifier: str, known: list[str] | None = None
) -> DataFrame:
    """Cached satellite telemetry by raw key first, by normalised key otherwise; the latest record of a key counts."""
    fields = [c for c in telemetry.columns if c != "location_key"]
    telemetry = one_each(telemetry, "location_key", F.col("timestamp"))

    def keyed(prefix: str) -> DataFrame:
        return telemetry.select(
            F.col("location_key").alias(f"{prefix}key"), *[F.col(f).alias(f"{prefix}{f}") for f in fields]
        )

    asked = rows.withColumns(
        {"_raw_key": F.lower(strip(F.col(identifier))), "_norm_key": short_key(F.col(identifier), known)}
    )
    joined = asked.join(keyed("_raw_"), "_raw_key", "left").join(keyed("_norm_"), "_norm_key", "left")
    # A raw hit wins as a whole record, so nulls inside it are kept.
    raw_hit = F.col("_raw_timestamp").isNotNull()
    return joined.withColumns(
        {f: F.when(raw_hit, F.col(f"_raw_{f}")).otherwise(F.col(f"_norm_{f}")) for f in fields}
    ).drop("_raw_key", "_norm_key", *[f"_raw_{f}" for f in fields], *[f"_norm_{f}" for f in fields])


def merge_daily(archive: DataFrame, forecast: DataFrame, key: list[str]) -> DataFrame:
    """Daily records of both sources, archive first: a full outer join on key and date."""
    fields = ["tmax_c", "tmin_c", "precipitation_mm", "source"]

    def whole(df: DataFrame, name: str) -> DataFrame:
        known = df.filter("tmax_c is not null and tmin_c is not null")
        return known.select(*key, "date", F.struct(*fields).alias(name))

    merged = whole(archive, "_a").join(whole(forecast, "_f"), [*key, "date"], "full")
    return merged.select(*key, "date", F.coalesce("_a", "_f").alias("_r")).select(*key, "date", "_r.*")


def pending(wanted: DataFrame, landed: DataFrame, key: list[str]) -> DataFrame:
    """What still has to be ingested."""
    return wanted.join(landed.select(*key).distinct(), key, "left_anti")
