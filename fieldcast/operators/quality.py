"""Validation, defaults and projections. Bad rows are labelled, never silently lost."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldcast.functions.physics import clip  # noqa: F401  (part of the public surface)
from fieldcast.functions.text import real_warnings

NODATA = -999.0
ELEVATION_RANGE_M = (-500.0, 9000.0)
HORIZON_RANGE_H = (6, 168)

# --- fixed values: allowed ranges of an extraction and of a request -------------------------
EXTRACTION_RANGES = {
    "min_temp_c": (-30.0, 60.0),
    "max_temp_c": (-30.0, 60.0),
    "rainfall_min_mm": (0.0, 1000.0),
    "rainfall_max_mm": (0.0, 1000.0),
    "wind_speed_kmh": (0.0, 400.0),
}
EXTRACTION_LENGTHS = {
    "district": 120, "valid_from": 50, "valid_to": 50, "rainfall_qualifier": 200,
    "wind_direction": 50, "weather_condition": 200, "advisory_text": 10000,
}
REQUEST_RANGES = {
    "latitude": (-90.0, 90.0),
    "longitude": (-180.0, 180.0),
    "forecast_hours": HORIZON_RANGE_H,
    "elevation_m": ELEVATION_RANGE_M,
}

# Serving defaults: value used when neither covariate nor forecast knows the quantity.
SERVING_DEFAULTS = {
    "temperature_2m_c": 28.0,
    "relative_humidity_2m_pct": 65.0,
    "surface_pressure_hpa": 960.0,
    "wind_speed_10m_kmh": 10.0,
    "precipitation_mm": 0.0,
    "solar_radiation_w_m2": 0.0,
    "shortwave_radiation_w_m2": 0.0,
    "soil_moisture_0_to_7cm_m3m3": 0.25,
    "et0_evapotranspiration_mm": 0.1,
}
COVARIATES = [
    "solar_radiation_w_m2", "shortwave_radiation_w_m2", "soil_temperature_0_to_7cm_c",
    "soil_moisture_0_to_7cm_m3m3", "et0_evapotranspiration_mm",
]


def range_errors(ranges: dict[str, tuple]) -> list[Column]:
    return [F.when(~F.col(c).between(low, high), F.lit(f"{c} out of range")) for c, (low, high) in ranges.items()]


def order_errors(pairs: list[tuple[str, str]]) -> list[Column]:
    return [F.when(F.col(low) > F.col(high), F.lit(f"{low} above {high}")) for low, high in pairs]


def length_errors(lengths: dict[str, int]) -> list[Column]:
    return [F.when(F.length(c) > n, F.lit(f"{c} too long")) for c, n in lengths.items()]


def with_errors(df: DataFrame, checks: list[Column]) -> DataFrame:
    """Add `errors`, the list of failed checks (empty = valid)."""
    return df.withColumn("errors", F.array_compact(F.array(*checks)))


def split_valid(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(valid rows without the error list, quarantined rows with it)."""
    return df.filter(F.size("errors") == 0).drop("errors"), df.filter(F.size("errors") > 0)


def extraction_checks() -> list[Column]:
    return (
        range_errors(EXTRACTION_RANGES)
        + length_errors(EXTRACTION_LENGTHS)
        + order_errors([("min_temp_c", "max_temp_c"), ("rainfall_min_mm", "rainfall_max_mm")])
    )


def mask_nodata(value: Column) -> Column:
    return F.when(F.abs(value - NODATA) < 0.01, F.lit(None).cast("double")).otherwise(value)


def valid_elevation(value: Column, nodata: Column | None = None) -> Column:
    """The value if it is finite and possible on Earth, else null."""
    low, high = ELEVATION_RANGE_M
    sane = ~F.isnan(value) & value.between(low, high)
    if nodata is not None:
        sane = sane & F.coalesce(value != nodata, F.lit(True))
    return F.when(sane, value)


def clean_warnings(df: DataFrame, column: str = "warnings") -> DataFrame:
    return df.withColumn(column, real_warnings(F.col(column)))


def add_missing(df: DataFrame, wanted: dict[str, Column]) -> DataFrame:
    """Add only those columns the table does not have yet."""
    absent = {name: value for name, value in wanted.items() if name not in df.columns}
    return df.withColumns(absent) if absent else df


def drop_incomplete(df: DataFrame) -> DataFrame:
    return df.na.drop("any")


def completeness(df: DataFrame) -> DataFrame:
    """Rows in, rows kept and rows dropped by `drop_incomplete`, in one pass."""
    whole = None
    for name in df.columns:
        known = F.col(name).isNotNull()
        whole = known if whole is None else whole & known
    return df.agg(F.count(F.lit(1)).alias("rows"), F.count_if(whole).alias("kept")).withColumn(
        "dropped", F.col("rows") - F.col("kept")
    )


def gates(profile: DataFrame, row_floor: int) -> DataFrame:
    """Pass/fail of a dataset profile: no nulls and more than `row_floor` rows."""
    return profile.withColumns(
        {"no_nulls": F.col("null_values") == 0, "enough_rows": F.col("total_rows") > row_floor}
    ).withColumn("passed", F.col("no_nulls") & F.col("enough_rows"))


def serving_defaults(df: DataFrame, covariates: str | None = None) -> DataFrame:
    """Covariate, then own value, then the constant. A true zero stays zero.

    `covariates` names an optional map column; soil temperature falls back to the air's.
    """
    def own(name: str) -> Column:
        value = F.col(name) if name in df.columns else F.lit(None).cast("double")
        if covariates and name in COVARIATES:
            return F.coalesce(F.try_element_at(F.col(covariates), F.lit(name)), value)
        return value

    filled = {name: F.coalesce(own(name), F.lit(default)) for name, default in SERVING_DEFAULTS.items()}
    soil = F.coalesce(own("soil_temperature_0_to_7cm_c"), filled["temperature_2m_c"])
    return df.withColumns({**filled, "soil_temperature_0_to_7cm_c": soil})


def first_known_elevation(document: Column, service: Column, constant: float | None = None) -> Column:
    known = F.coalesce(document, service)
    return known if constant is None else F.coalesce(known, F.lit(constant))
