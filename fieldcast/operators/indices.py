"""Crop stress indices of an hourly series, one row per location.

Input columns: the key, `timestamp`, `baseline_temp_c`, `downscaled_temp_1km_c`,
`relative_humidity_pct`, `wind_speed_kmh`, `rain_probability_pct`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldcast.functions import spraying
from fieldcast.functions.physics import clip, vapour_pressure_deficit
from fieldcast.operators.timeseries import chunk_number, count_runs, running_totals, runs

# --- fixed values ----------------------------------------------------------------------
INVERSION_GAP_C = 0.4
INVERSION_HOURS = 3
FROST_C = 2.0
DEFAULT_BASE_C = 10.0
DEFAULT_MAX_C = 38.0
WINDOW_LIMITING = "Optimal spray conditions"
WINDOW_ACTION = "Execute scheduled pesticide/fungicide/fertilizer foliar application"


def _spray_inputs() -> tuple[Column, Column, Column, Column]:
    return (
        F.col("downscaled_temp_1km_c"),
        F.col("relative_humidity_pct"),
        F.col("wind_speed_kmh"),
        F.coalesce("rain_probability_pct", F.lit(0.0)),
    )


def with_spray_columns(series: DataFrame) -> DataFrame:
    temp, humidity, wind, rain = _spray_inputs()
    return series.withColumns(
        {
            "suitability": spraying.suitability(temp, humidity, wind, rain),
            "is_sprayable": spraying.sprayable(temp, wind, rain),
            "limiting": spraying.limiting_reason(temp, humidity, wind, rain),
        }
    )


def spray_hours(series: DataFrame, key: list[str]) -> DataFrame:
    """Hours inside a candidate window, numbered by unbroken run."""
    scored = with_spray_columns(series)
    return runs(scored, key, "timestamp", spraying.in_window(*_spray_inputs()), "window_id")


def spray_windows(series: DataFrame, key: list[str]) -> DataFrame:
    """Runs of at least two good hours. The end is the start of the last hour."""
    return (
        spray_hours(series, key)
        .groupBy(*key, "window_id")
        .agg(
            F.min("timestamp").alias("start_time"),
            F.max("timestamp").alias("end_time"),
            F.count(F.lit(1)).alias("duration_hours"),
            F.avg("suitability").alias("suitability_score"),
        )
        .filter(F.col("duration_hours") >= spraying.MIN_WINDOW_HOURS)
        .withColumns({"limiting_factor": F.lit(WINDOW_LIMITING), "recommended_action": F.lit(WINDOW_ACTION)})
    )


def _first_window(opens: Column, end: str = "_end", hours: str = "_hours", score: str = "_score") -> list[Column]:
    """Start, end, length and score of the window that opens first."""
    return [
        F.min(opens).alias("first_window_start"),
        F.min_by(end, opens).alias("first_window_end"),
        F.min_by(hours, opens).alias("first_window_hours"),
        F.min_by(score, opens).alias("first_window_score"),
    ]


def earliest_windows(windows: DataFrame, key: list[str]) -> DataFrame:
    """Per location: how many windows, and the first of them."""
    first = _first_window(F.col("start_time"), "end_time", "duration_hours", "suitability_score")
    return windows.groupBy(*key).agg(F.count(F.lit(1)).alias("spray_windows"), *first)


def degree_days(t_max: Column, t_min: Column, base: Column) -> Column:
    return clip((t_max + t_min) / 2.0 - base, low=0.0)


def _hourly(series: DataFrame, base_c: Column | None, max_c: Column | None) -> DataFrame:
    temp = F.col("downscaled_temp_1km_c")
    gap = F.col("baseline_temp_c") - temp
    return series.withColumns(
        {
            "_base": F.lit(DEFAULT_BASE_C) if base_c is None else base_c,
            "_max": F.lit(DEFAULT_MAX_C) if max_c is None else max_c,
            "_vpd": vapour_pressure_deficit(temp, F.col("relative_humidity_pct"), 0.0),
            "_gap": F.when(gap > INVERSION_GAP_C, gap),
        }
    )


def _chunk_sums() -> list[Column]:
    """Partial results of one 24-row chunk."""
    temp = F.col("downscaled_temp_1km_c")
    return [
        F.count(F.lit(1)).alias("_hours"),
        F.sum("_vpd").alias("_vpd_sum"),
        F.count("_vpd").alias("_vpd_n"),
        F.max("_vpd").alias("_vpd_max"),
        F.count_if(temp > F.col("_max")).alias("_hot"),
        F.count("_gap").alias("_gap_n"),
        F.sum("_gap").alias("_gap_sum"),
        F.min(temp).alias("_t_min"),
        F.max(temp).alias("_t_max"),
        F.max("_base").alias("_base"),
        F.sum(F.col("downscaled_temp_1km_c") - F.col("baseline_temp_c")).alias("_shift"),
    ]


def _stress_columns(chunk: Column | None = None) -> list[Column]:
    """Results from the chunk rows; `chunk` tells chunk rows from others in a mixed table."""
    def of(name: str) -> Column:
        return F.col(name) if chunk is None else F.when(chunk, F.col(name))

    gained = degree_days(of("_t_max"), of("_t_min"), F.col("_base"))
    return [
        F.sum(of("_hours")).alias("hours"),
        (F.sum(of("_shift")) / F.sum(of("_hours"))).alias("mean_delta_t_c"),
        (F.sum(of("_vpd_sum")) / F.nullif(F.sum(of("_vpd_n")), F.lit(0))).alias("mean_vpd_kpa"),
        F.max(of("_vpd_max")).alias("max_vpd_kpa"),
        (F.sum(of("_gap_n")) >= INVERSION_HOURS).alias("thermal_inversion_risk"),
        F.coalesce(F.sum(of("_gap_sum")) / F.nullif(F.sum(of("_gap_n")), F.lit(0)), F.lit(0.0)).alias(
            "inversion_strength_c"
        ),
        (F.min(of("_t_min")) <= FROST_C).alias("frost_risk"),
        F.sum(gained).alias("gdd_accumulated_c_days"),
        F.sum(of("_hot")).alias("heat_stress_hours"),
    ]


def stress_indices(
    series: DataFrame, key: list[str], base_c: Column | None = None, max_c: Column | None = None, short: bool = False
) -> DataFrame:
    """Vapour pressure deficit, heat hours, inversion, frost and degree days per location.

    First one partial row per key and 24-row chunk, then one row per key, so a long series
    is never gathered whole.
    """
    one = {"_no": F.lit(1).cast("bigint")}
    rows = running_totals(_hourly(series, base_c, max_c), key, "timestamp", one, short=short)
    chunks = rows.withColumn("_chunk", chunk_number(F.col("_no"))).groupBy(*key, "_chunk").agg(*_chunk_sums())
    return chunks.groupBy(*key).agg(*_stress_columns())


def indices(
    series: DataFrame, key: list[str], base_c: Column | None = None, max_c: Column | None = None, short: bool = False
) -> DataFrame:
    """The full report row: stress indices plus the count of spray windows and the first one.

    Chunks and spray windows are two grouping sets of one aggregation over one ordered pass,
    so the series behind them is not computed once per part.
    """
    inputs = _spray_inputs()
    rows = _hourly(series, base_c, max_c).withColumn("suitability", spraying.suitability(*inputs))
    rows = count_runs(rows, key, "timestamp", spraying.in_window(*inputs), "_window", "_no", short)
    rows = rows.withColumn("_chunk", chunk_number(F.col("_no")))
    keys = [F.col(k) for k in key]
    sets = [[*keys, F.col("_chunk")], [*keys, F.col("_window")]]
    parts = rows.groupingSets(sets, *keys, F.col("_chunk"), F.col("_window")).agg(
        F.grouping("_chunk").alias("_is_window"),
        *_chunk_sums(),
        F.min("timestamp").alias("_start"),
        F.max("timestamp").alias("_end"),
        F.avg("suitability").alias("_score"),
    )
    window = (
        (F.col("_is_window") == 1) & F.col("_window").isNotNull() & (F.col("_hours") >= spraying.MIN_WINDOW_HOURS)
    )
    opens = F.when(window, F.col("_start"))
    return parts.groupBy(*key).agg(
        *_stress_columns(F.col("_is_window") == 0), F.count_if(window).alias("spray_windows"), *_first_window(opens)
    )
