"""Report tables whose shape is agreed but whose rules come from published definitions.

Spray codes reuse the thresholds of the spray index; wet-bulb temperature is Stull (2011);
rainfall, heat-wave and cold-wave classes are the India Meteorological Department's.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldcast import catalogs
from fieldcast.functions import spraying
from fieldcast.functions.text import fixed
from fieldcast.operators import metrics, timeseries

# --- fixed values ----------------------------------------------------------------------
RAINFAST_HOURS = 4
NORMAL_PERIOD = (1991, 2020)
DRY_NORMAL_MM = 1.0
RAIN_CLASSES = [(60.0, "Large Excess"), (20.0, "Excess"), (-19.0, "Normal"), (-59.0, "Deficient"), (-99.0, "Large Deficient")]
HEAT_FROM_C, HEAT_C, SEVERE_HEAT_C = 40.0, 45.0, 47.0
COLD_FROM_C, COLD_C, SEVERE_COLD_C = 10.0, 4.0, 2.0
WAVE_DEPARTURE_C, SEVERE_DEPARTURE_C = 4.5, 6.4
SEVERITY = {"Severe": 3, "Moderate": 2, "Low": 1}


def wet_bulb(temp_c: Column, humidity_pct: Column) -> Column:
    rh = humidity_pct
    return (
        temp_c * F.atan(0.151977 * F.sqrt(rh + 8.313659))
        + F.atan(temp_c + rh)
        - F.atan(rh - 1.676331)
        + 0.00391838 * F.pow(rh, F.lit(1.5)) * F.atan(0.023101 * rh)
        - 4.686035
    )


def spray_assessment(series: DataFrame, key: list[str], rainfast: int = RAINFAST_HOURS) -> DataFrame:
    """Status of every hour with its block and caution codes. Rain counts over the rain-free
    period that starts with the hour."""
    soon = {
        "rain_soon_mm": lambda w: F.sum("precipitation_mm").over(w.rowsBetween(0, rainfast - 1)),
        "rain_chance_soon_pct": lambda w: F.max("rain_probability_pct").over(w.rowsBetween(0, rainfast - 1)),
    }
    rows = timeseries.near_rows(series, key, "timestamp", soon, ahead=rainfast)
    temp, humidity, wind = (F.col(c) for c in ("downscaled_temp_1km_c", "relative_humidity_pct", "wind_speed_kmh"))
    blocks = F.array_compact(
        F.array(
            F.when(wind > spraying.WIND_HIGH_KMH, F.lit("WIND_STRONG")),
            F.when(
                (F.col("rain_soon_mm") > 0) | (F.col("rain_chance_soon_pct") > spraying.RAIN_CHANCE_PCT),
                F.lit("RAIN_SOON"),
            ),
            F.when(temp > spraying.HOT_C, F.lit("TOO_HOT")),
        )
    )
    cautions = F.array_compact(
        F.array(
            F.when(wind < spraying.WIND_LOW_KMH, F.lit("WIND_CALM")),
            F.when(temp < spraying.COLD_C, F.lit("TOO_COLD")),
            F.when(humidity > spraying.HUMID_PCT, F.lit("HUMID_AIR")),
        )
    )
    rows = rows.withColumns({"blocks": blocks, "cautions": cautions, "wet_bulb_gap_c": temp - wet_bulb(temp, humidity)})
    status = F.when(F.size("blocks") > 0, "unsuitable").when(F.size("cautions") > 0, "marginal").otherwise("good")
    return rows.withColumn("status", status)


def spray_report(assessed: DataFrame, key: list[str]) -> DataFrame:
    """Windows of usable hours, ranked by start within each location."""
    usable = timeseries.runs(assessed, key, "timestamp", F.col("status") != "unsuitable", "window_id")
    windows = usable.groupBy(*key, "window_id").agg(
        F.min("timestamp").alias("window_start"),
        F.max("timestamp").alias("window_end"),
        F.count(F.lit(1)).alias("duration_h"),
        F.count_if(F.col("status") == "good").alias("good_hours"),
        F.count_if(F.col("status") == "marginal").alias("marginal_hours"),
        F.avg("wind_speed_kmh").alias("mean_wind_kmh"),
        F.max("rain_chance_soon_pct").alias("max_rain_probability_pct"),
        F.avg("wet_bulb_gap_c").alias("mean_wet_bulb_gap_c"),
    )
    windows = windows.filter(F.col("duration_h") >= spraying.MIN_WINDOW_HOURS).withColumn(
        "quality", F.when(F.col("marginal_hours") == 0, "good").otherwise("marginal")
    )
    # Window ranks: at most one window per two hours of the horizon.
    return timeseries.number_rows(windows, key, "window_start", "window_rank")


def blocked_hours(assessed: DataFrame, key: list[str]) -> DataFrame:
    """Blocked hours per location and reason."""
    reasons = assessed.select(*key, F.explode("blocks").alias("reason"))
    return reasons.groupBy(*key, "reason").agg(F.count(F.lit(1)).alias("hours"))


def spray_summary(assessed: DataFrame, key: list[str]) -> DataFrame:
    """Per location: number of windows, the earliest, the earliest clean one, hours blocked by reason."""
    windows = spray_report(assessed, key)
    clean = F.when(F.col("quality") == "good", F.col("window_start"))
    best = windows.groupBy(*key).agg(
        F.count(F.lit(1)).alias("windows"),
        F.min("window_start").alias("best_window_start"),
        F.min(clean).alias("cleanest_window_start"),
    )
    pairs = F.sort_array(F.collect_list(F.struct("reason", "hours")))
    reasons = blocked_hours(assessed, key).groupBy(*key).agg(
        F.map_from_entries(pairs).alias("blocking_hours_by_reason")
    )
    places = assessed.groupBy(*key).agg(F.count(F.lit(1)).alias("horizon_h"))
    return (
        places.join(best, key, "left").join(reasons, key, "left").withColumn("windows", F.coalesce("windows", F.lit(0)))
    )


def daily_degree_days(daily: DataFrame, base: Column, upper: Column) -> DataFrame:
    """Degree days of a day with both extremes capped at the upper limit."""
    high, low = F.least("tmax_c", upper), F.greatest(F.least("tmin_c", upper), base)
    return daily.withColumn("degree_days", F.greatest(F.lit(0.0), (F.greatest(high, base) + low) / 2.0 - base))


def phenology(daily: DataFrame, sowings: DataFrame, stages: DataFrame, key: list[str]) -> DataFrame:
    """Stage reached and next stage from degree days since sowing.

    `sowings` has key, crop_key, sowing_date, base_temp_c and upper_temp_c; `stages` has crop_key,
    stage and gdd_threshold.
    """
    grown = daily.join(sowings, key).filter(F.col("date") >= F.col("sowing_date"))
    grown = daily_degree_days(grown, F.col("base_temp_c"), F.col("upper_temp_c"))
    totals = grown.groupBy(*key, "crop_key", "sowing_date").agg(
        F.sum("degree_days").alias("accumulated_gdd"),
        F.count("degree_days").alias("observed_days"),
        F.max("date").alias("as_of"),
    )
    reached = F.col("gdd_threshold") <= F.col("accumulated_gdd")
    step = F.struct("gdd_threshold", "stage")
    # A crop has a handful of stages, so each location meets a handful of rows.
    timeline = totals.join(stages, "crop_key")
    report = timeline.groupBy(*key, "crop_key", "sowing_date", "as_of", "accumulated_gdd", "observed_days").agg(
        F.max(F.when(reached, step)).alias("_now"), F.min(F.when(~reached, step)).alias("_next")
    )
    done, todo = F.col("_now.gdd_threshold"), F.col("_next.gdd_threshold")
    return report.select(
        *key, "crop_key", "sowing_date", "as_of", "observed_days", "accumulated_gdd",
        F.date_diff("as_of", "sowing_date").alias("days_after_sowing"),
        F.col("_now.stage").alias("current_stage"),
        F.col("_next.stage").alias("next_stage"),
        (todo - F.col("accumulated_gdd")).alias("gdd_to_next_stage"),
        ((F.col("accumulated_gdd") - done) / F.nullif(todo - done, F.lit(0.0)) * 100.0).alias("stage_progress_pct"),
    )


def stage_dates(daily: DataFrame, sowings: DataFrame, stages: DataFrame, key: list[str]) -> DataFrame:
    """First day on which each stage's threshold is met; `not_reached` without such a day."""
    grown = daily.join(sowings, key).filter(F.col("date") >= F.col("sowing_date"))
    grown = daily_degree_days(grown, F.col("base_temp_c"), F.col("upper_temp_c"))
    running = timeseries.running_totals(grown, key, "date", {"gdd_so_far": F.coalesce("degree_days", F.lit(0.0))})
    met = F.when(F.col("gdd_so_far") >= F.col("gdd_threshold"), F.col("date"))
    return (
        running.join(stages, "crop_key")
        .groupBy(*key, "crop_key", "stage", "gdd_threshold")
        .agg(F.min(met).alias("date"))
        .withColumn("basis", F.when(F.col("date").isNull(), "not_reached").otherwise("observed"))
    )


def normals(daily: DataFrame, key: list[str], period: tuple[int, int] = NORMAL_PERIOD) -> DataFrame:
    """Day-of-year means over the normal period."""
    within = daily.filter(F.year("date").between(*period))
    return within.groupBy(*key, F.dayofyear("date").alias("day_of_year")).agg(
        F.avg("tmax_c").alias("tmax_normal_c"),
        F.avg("tmin_c").alias("tmin_normal_c"),
        F.avg("precipitation_mm").alias("rain_normal_mm"),
    )


def with_normals(daily: DataFrame, normal: DataFrame, key: list[str]) -> DataFrame:
    return daily.withColumn("day_of_year", F.dayofyear("date")).join(normal, [*key, "day_of_year"], "left")


def rain_category(rain: Column, normal: Column, departure: Column) -> Column:
    cases = F.when(normal < DRY_NORMAL_MM, "Dry season").when(rain <= 0, "No Rain")
    for limit, name in RAIN_CLASSES:
        cases = cases.when(F.round(departure, 0) >= limit, name)
    return cases.otherwise("No Rain")


def rainfall_departure(daily: DataFrame, normal: DataFrame, key: list[str], by: list[Column] | None = None) -> DataFrame:
    """Rain of a period against its normal, in percent and in classes."""
    table = with_normals(daily, normal, key).groupBy(*key, *(by or [])).agg(
        F.min("date").alias("start_date"),
        F.max("date").alias("end_date"),
        F.count(F.lit(1)).alias("days"),
        F.sum("precipitation_mm").alias("rainfall_mm"),
        F.sum("rain_normal_mm").alias("normal_mm"),
    )
    rain, usual = F.col("rainfall_mm"), F.col("normal_mm")
    table = table.withColumn(
        "departure_pct", F.when(usual >= DRY_NORMAL_MM, (rain - usual) / F.nullif(usual, F.lit(0.0)) * 100.0)
    )
    return table.withColumn("category", rain_category(rain, usual, F.col("departure_pct")))


def _wave(severe: Column, plain: Column, name: str) -> Column:
    return F.when(severe, f"severe {name}").when(plain, name).otherwise("none")


def temperature_anomalies(daily: DataFrame, normal: DataFrame, key: list[str]) -> DataFrame:
    """Daily extremes against their normals with heat-wave and cold-wave class."""
    rows = with_normals(daily, normal, key)
    up, down = F.col("tmax_c") - F.col("tmax_normal_c"), F.col("tmin_c") - F.col("tmin_normal_c")
    rows = rows.withColumns({"tmax_departure_c": up, "tmin_departure_c": down})
    hot, cold = F.col("tmax_c"), F.col("tmin_c")
    # Departures are reported to a tenth of a degree, and classed as reported.
    up, down = (F.round(F.col(f"{x}_departure_c") + 1e-9, 1) for x in ("tmax", "tmin"))
    heat = _wave(
        (hot >= SEVERE_HEAT_C) | ((hot >= HEAT_FROM_C) & (up > SEVERE_DEPARTURE_C)),
        (hot >= HEAT_C) | ((hot >= HEAT_FROM_C) & (up >= WAVE_DEPARTURE_C)),
        "heat wave",
    )
    chill = _wave(
        (cold <= SEVERE_COLD_C) | ((cold <= COLD_FROM_C) & (down < -SEVERE_DEPARTURE_C)),
        (cold <= COLD_C) | ((cold <= COLD_FROM_C) & (down <= -WAVE_DEPARTURE_C)),
        "cold wave",
    )
    return rows.withColumns({"heat_wave": heat, "cold_wave": chill})


def season_start(date: Column) -> Column:
    """First day of the season that a date lies in."""
    month, begun = F.month(date), None
    for _, months in catalogs.SEASONS:
        begun = (F if begun is None else begun).when(month.isin(months), F.lit(min(months)))
    return F.make_date(F.year(date), begun, F.lit(1))


def climatology(daily: DataFrame, key: list[str], period: tuple[int, int], asked: DataFrame, ahead: int = 7) -> DataFrame:
    """How the season so far and the coming days compare with the local climate, one row per location.

    `asked` has the key and `as_of`: the season runs from its first day to that day, the forecast over the
    `ahead` days behind it. Temperatures are compared over all days. A location without days in a
    window has nulls there.
    """
    normal = normals(daily, key, period)
    placed = daily.join(asked.select(*key, "as_of"), key)
    windows = {
        "season": (F.col("date") >= season_start(F.col("as_of"))) & (F.col("date") <= F.col("as_of")),
        "forecast": (F.col("date") > F.col("as_of")) & (F.col("date") <= F.date_add("as_of", ahead)),
    }
    warmth = temperature_anomalies(daily, normal, key).groupBy(*key).agg(
        F.count(F.lit(1)).alias("days"),
        F.avg("tmax_departure_c").alias("mean_tmax_departure_c"),
        F.avg("tmin_departure_c").alias("mean_tmin_departure_c"),
        F.count_if(F.col("heat_wave") != "none").alias("heat_wave_days"),
        F.count_if(F.col("cold_wave") != "none").alias("cold_wave_days"),
    )
    within = F.when(F.year("date").between(*period), F.year("date"))
    years = daily.groupBy(*key).agg(F.count_distinct(within).alias("normal_years"))
    table = warmth.join(asked.select(*key, "as_of"), key).join(years, key)
    for name, inside in windows.items():
        rain = rainfall_departure(placed.filter(inside).drop("as_of"), normal, key)
        table = table.join(rain.withColumnsRenamed({c: f"{name}_{c}" for c in rain.columns if c not in key}), key, "left")
    return table.withColumns({"normal_period": F.lit(f"{period[0]}-{period[1]}"), "imd_season": metrics.season(F.col("as_of"))})


def rule_advisories(facts: DataFrame, rules: DataFrame, key: list[str]) -> DataFrame:
    """Rules that fire per location, most severe first, each with its evidence.

    `rules` (a short table: rule_id, metric, comparison, threshold, risk_level, action) meets only the
    fact it names, so a location yields at most one row per rule.
    """
    metrics = [c for c in facts.columns if c not in key]
    long = facts.select(
        *key,
        F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in metrics])).alias("_f"),
    ).select(*key, "_f.*")
    over = (F.col("comparison") == ">=") & (F.col("value") >= F.col("threshold"))
    under = (F.col("comparison") == "<=") & (F.col("value") <= F.col("threshold"))
    fired = long.join(rules, "metric").filter(over | under)
    rank = None
    for name, score in SEVERITY.items():
        rank = (F if rank is None else rank).when(F.col("risk_level") == name, F.lit(score))
    evidence = F.concat_ws(
        " ", "metric", "comparison", fixed(F.col("threshold"), 2), F.lit(":"), fixed(F.col("value"), 2)
    )
    entry = F.struct((-rank).alias("order"), "rule_id", "risk_level", "action", evidence.alias("evidence"))
    return fired.groupBy(*key).agg(F.sort_array(F.collect_list(entry)).alias("triggered")).select(
        *key,
        F.element_at("triggered", 1)["risk_level"].alias("risk_level"),
        F.element_at("triggered", 1)["action"].alias("recommended_action"),
        F.transform("triggered", lambda t: t["rule_id"]).alias("matched_rules"),
        F.transform("triggered", lambda t: t["evidence"]).alias("evidence"),
    )


def combined(parts: dict[str, DataFrame], key: list[str]) -> DataFrame:
    """One JSON document per location; each part has one row per location."""
    whole = None
    for name, part in parts.items():
        fields = [c for c in part.columns if c not in key]
        packed = part.select(*key, F.struct(*fields).alias(name))
        whole = packed if whole is None else whole.join(packed, key, "left")
    return whole.select(*key, F.to_json(F.struct(*parts)).alias("payload"))
