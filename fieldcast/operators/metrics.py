"""Error metrics as plain aggregates, so that they combine map-side for any grouping."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldcast import catalogs

TINY = 1e-6


def errors(actual: Column, predicted: Column, prefix: str) -> list[Column]:
    """MAE, RMSE and R2 of one prediction."""
    miss = predicted - actual
    total = F.var_pop(actual) * F.count(miss)
    return [
        F.avg(F.abs(miss)).alias(f"{prefix}_mae"),
        F.sqrt(F.avg(miss * miss)).alias(f"{prefix}_rmse"),
        (1.0 - F.sum(miss * miss) / F.greatest(total, F.lit(1e-12))).alias(f"{prefix}_r2"),
    ]


def gain_pct(base: Column, model: Column) -> Column:
    """Improvement over the base in percent; null when the base is zero."""
    return (base - model) / F.nullif(base, F.lit(0.0)) * 100.0


def guarded_gain_pct(base: Column, model: Column) -> Column:
    return (base - model) / F.greatest(base, F.lit(TINY)) * 100.0


def compare(
    df: DataFrame, actual: str, baseline: str, model: str, by: list[str] | None = None
) -> DataFrame:
    """Baseline and model errors side by side, with the gain."""
    table = df.groupBy(*(by or [])).agg(
        F.count(F.lit(1)).alias("rows"),
        *errors(F.col(actual), F.col(baseline), "baseline"),
        *errors(F.col(actual), F.col(model), "downscaled"),
    )
    return table.withColumns(
        {
            "mae_improvement_pct": gain_pct(F.col("baseline_mae"), F.col("downscaled_mae")),
            "rmse_improvement_pct": gain_pct(F.col("baseline_rmse"), F.col("downscaled_rmse")),
        }
    )


def season(timestamp: Column) -> Column:
    month = F.month(timestamp)
    cases = None
    for name, months in catalogs.SEASONS:
        cases = (F if cases is None else cases).when(month.isin(months), F.lit(name))
    return cases


def by_season(df: DataFrame, actual: str, baseline: str, model: str, timestamp: str = "timestamp") -> DataFrame:
    return compare(df.withColumn("season", season(F.col(timestamp))), actual, baseline, model, ["season"])


def rollup_by_place(df: DataFrame, place: str, truth: str, baseline: str, model: str) -> DataFrame:
    """Errors per place and, with a null place, over all of them; one pass over the rows."""
    base, down = F.abs(F.col(baseline) - F.col(truth)), F.abs(F.col(model) - F.col(truth))
    table = df.groupingSets([[F.col(place)], []], F.col(place)).agg(
        F.count(F.lit(1)).alias("total_hours"),
        F.avg(base).alias("baseline_mae"),
        F.avg(down).alias("downscaled_mae"),
        F.sqrt(F.avg(base * base)).alias("baseline_rmse"),
        F.sqrt(F.avg(down * down)).alias("downscaled_rmse"),
    )
    return table.withColumn(
        "rmse_improvement_pct", guarded_gain_pct(F.col("baseline_rmse"), F.col("downscaled_rmse"))
    )


def day_night(df: DataFrame, truth: str, baseline: str, model: str, timestamp: str = "timestamp") -> DataFrame:
    """RMSE reduction by day (06 to 18 inclusive) and by night."""
    base, down = F.col(baseline) - F.col(truth), F.col(model) - F.col(truth)
    part = F.when(F.hour(timestamp).between(6, 18), F.lit("day")).otherwise(F.lit("night"))
    return (
        df.groupBy(part.alias("part_of_day"))
        .agg(
            F.count(F.lit(1)).alias("rows"),
            F.sqrt(F.avg(base * base)).alias("baseline_rmse"),
            F.sqrt(F.avg(down * down)).alias("downscaled_rmse"),
        )
        .withColumn("rmse_reduction_pct", gain_pct(F.col("baseline_rmse"), F.col("downscaled_rmse")))
    )


def fold_summary(folds: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Means over the folds and the population spread of the gain."""
    return folds.groupBy(*(by or [])).agg(
        F.count(F.lit(1)).alias("folds"),
        F.avg("baseline_rmse").alias("mean_baseline_rmse"),
        F.avg("downscaled_rmse").alias("mean_downscaled_rmse"),
        F.avg("baseline_mae").alias("mean_baseline_mae"),
        F.avg("downscaled_mae").alias("mean_downscaled_mae"),
        F.avg("downscaled_r2").alias("mean_downscaled_r2"),
        F.avg("rmse_improvement_pct").alias("mean_rmse_improvement_pct"),
        F.stddev_pop("rmse_improvement_pct").alias("std_rmse_improvement_pct"),
    )


def fleet_summary(zones: DataFrame) -> DataFrame:
    """Macro averages over zones, the record total and the drop of the averaged errors."""
    return zones.agg(
        F.count(F.lit(1)).alias("zones"),
        F.sum("rows").alias("total_records"),
        F.avg("baseline_rmse").alias("avg_baseline_rmse"),
        F.avg("downscaled_rmse").alias("avg_downscaled_rmse"),
        F.avg("downscaled_mae").alias("avg_downscaled_mae"),
        F.avg("rmse_improvement_pct").alias("avg_gain_pct"),
    ).withColumn("pooled_drop_pct", gain_pct(F.col("avg_baseline_rmse"), F.col("avg_downscaled_rmse")))


def quality_gate(metrics: DataFrame) -> DataFrame:
    """A model passes when both its RMSE and its MAE are below the baseline's."""
    return metrics.withColumn(
        "gate_passed",
        (F.col("downscaled_rmse") < F.col("baseline_rmse")) & (F.col("downscaled_mae") < F.col("baseline_mae")),
    )


def line_fit(df: DataFrame, x: str, y: str, by: list[str] | None = None) -> DataFrame:
    """One-variable least squares."""
    return df.groupBy(*(by or [])).agg(
        F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept")
    )


def dataset_profile(df: DataFrame) -> DataFrame:
    """Rows, columns, nulls and ranges of a featured table in a single pass."""
    nulls = sum((F.count_if(F.col(c).isNull()) for c in df.columns), F.lit(0).cast("bigint"))
    return df.agg(
        F.count(F.lit(1)).alias("total_rows"),
        F.lit(len(df.columns)).cast("bigint").alias("total_columns"),
        nulls.alias("null_values"),
        F.min("temperature_2m_c").alias("min_temp_c"),
        F.max("temperature_2m_c").alias("max_temp_c"),
        F.sum("precipitation_mm").alias("precipitation_total_mm"),
        F.max(F.abs("residual_anomaly_c")).alias("max_abs_residual_c"),
    )
