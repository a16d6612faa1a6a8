"""Hand-computed cases and thresholds."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from fieldcast import catalogs
from fieldcast.functions import physics, spraying, text
from fieldcast.operators import baselines, indices, lookups, quality, residual_models, spatial, splits, timeseries
from fieldcast.plans import advisory, extraction, features, forecasts

START = datetime(2024, 6, 1)


def hourly(spark, values, name="x", key="P"):
    rows = [(key, START + timedelta(hours=i), v) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, f"point_id string, timestamp timestamp, {name} double")


def column(df, name, order="timestamp"):
    return [r[0] for r in df.orderBy(order).select(name).collect()]


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


def test_leave_one_out_of_three(spark):
    rows = [("Z", p, START, t) for p, t in (("a", 20.0), ("b", 30.0), ("c", 40.0))]
    df = spark.createDataFrame(rows, "zone_id string, point_id string, timestamp timestamp, temperature_2m_c double")
    out = baselines.residuals(baselines.leave_one_out(df, ["zone_id", "timestamp"], baselines.TEMPERATURE_ONLY), ["residual_anomaly_c"])
    assert [tuple(r) for r in out.orderBy("point_id").select("baseline_temp_c", "residual_anomaly_c").collect()] == [(35, -15), (30, 0), (25, 15)]


def test_lone_station_keeps_its_own_value(spark):
    df = spark.createDataFrame([("Z", "a", START, 21.0)], "zone_id string, point_id string, timestamp timestamp, temperature_2m_c double")
    assert baselines.leave_one_out(df, ["zone_id", "timestamp"], baselines.TEMPERATURE_ONLY).first()["baseline_temp_c"] == 21.0


SERIES = [24.0, 25.0, 27.0, 30.0, 34.0, 37.0]


def test_training_and_forecast_lags(spark):
    df = hourly(spark, SERIES)
    lag = timeseries.near_rows(df, ["point_id"], "timestamp", {"lag": timeseries.difference("x", 3)}, back=3)
    assert column(lag, "lag") == [0, 0, 0, 6, 9, 10]
    fc = features.serving_features(
        df.withColumnRenamed("x", "temperature_2m_c").withColumn("elevation_m", F.lit(400.0)), ["point_id"]
    )
    assert column(fc, "thermal_inertia_lag_3h") == [0, 1, 3, 6, 9, 10]


def test_vapour_pressure_deficit(spark):
    a, b = one(
        spark, physics.vapour_pressure_deficit(F.lit(25.0), F.lit(50.0)), physics.vapour_pressure_deficit(F.lit(30.0), F.lit(100.0))
    )
    assert 1.4 < a < 1.7 and b == 0


def test_residual_guard_rails_and_confidence(spark):
    row = one(
        spark, physics.clamp_residual(F.lit(15.0)), physics.clamp_residual(F.lit(-20.0)),
        physics.downscaled_temperature(F.lit(34.5), F.lit(2.163)), physics.confidence(F.lit(2.163)),
    )
    assert list(row) == [12, -12, 36.66, 0.928]


def test_null_stays_null_in_bounds(spark):
    assert one(spark, physics.clip(F.lit(None).cast("double"), 0.0, 1.0))[0] is None


@pytest.mark.parametrize(
    "temp, humidity, wind, rain, score, ok, reason",
    [
        (25.0, 60.0, 14.0, 0.0, 95, True, "None"),
        (25.0, 60.0, 14.1, 0.0, 45, False, "High wind (14.1 km/h > 14 km/h: chemical drift risk)"),
        (11.9, 90.1, 2.9, 25.0, 45, True, "High humidity (dew dilution / delayed drying)"),
        (34.0, 90.0, 3.0, 25.0, 95, True, "None"),
        (34.1, 50.0, 10.0, 26.0, 0, False, "High temperature (34.1°C: droplet evaporation risk)"),
        (30.0, 50.0, 20.0, 40.0, 0, False, "Rain probability (40% > 25%: washout risk)"),
    ],
)
def test_spray_rules(spark, temp, humidity, wind, rain, score, ok, reason):
    args = [F.lit(v) for v in (temp, humidity, wind, rain)]
    row = one(spark, spraying.suitability(*args), spraying.sprayable(args[0], args[2], args[3]), spraying.limiting_reason(*args))
    assert list(row) == [score, ok, reason]


def index_series(spark, rows):
    data = [("P", START + timedelta(hours=i), *r) for i, r in enumerate(rows)]
    return spark.createDataFrame(
        data, "point_id string, timestamp timestamp, baseline_temp_c double, downscaled_temp_1km_c double, relative_humidity_pct double, "
        "wind_speed_kmh double, rain_probability_pct double",
    )


def test_inversion_counts_only_gaps_above_the_limit(spark):
    gaps = [0.4, 0.5, 0.6, 0.7]
    df = index_series(spark, [(20.0, 20.0 - g, 50.0, 10.0, 0.0) for g in gaps])
    row = indices.indices(df, ["point_id"]).first()
    # 20 - 19.6 is a hair above 0.4 in binary, as in any engine; the case is built from 0.39.
    df = index_series(spark, [(20.0, 20.0 - g, 50.0, 10.0, 0.0) for g in [0.39, 0.5, 0.6, 0.7]])
    row = indices.indices(df, ["point_id"]).first()
    assert row["thermal_inversion_risk"] and row["inversion_strength_c"] == pytest.approx(0.6)


@pytest.mark.parametrize("low, frost", [(2.0, True), (2.01, False)])
def test_frost_limit(spark, low, frost):
    df = index_series(spark, [(low, low, 50.0, 10.0, 0.0), (9.0, 9.0, 50.0, 10.0, 0.0)])
    assert indices.indices(df, ["point_id"]).first()["frost_risk"] is frost


def test_spray_windows_need_two_hours_and_end_at_the_last_start(spark):
    good, windy = (25.0, 25.0, 60.0, 8.0, 0.0), (25.0, 25.0, 60.0, 30.0, 0.0)
    df = index_series(spark, [good, windy, good, good, good, windy, good])
    rows = indices.spray_windows(df, ["point_id"]).collect()
    assert [(r["start_time"], r["end_time"], r["duration_hours"]) for r in rows] == [(START + timedelta(hours=2), START + timedelta(hours=4), 3)]
    report = indices.indices(df, ["point_id"]).first()
    assert (report["spray_windows"], report["first_window_hours"]) == (1, 3)


def test_long_and_short_index_plans_agree(spark):
    df = index_series(spark, [(20.0 + i % 9, 18.0 + i % 13, 40.0 + i % 60, float(i % 20), float(i % 40)) for i in range(200)])
    a, b = indices.indices(df, ["point_id"]).first(), indices.indices(df, ["point_id"], short=True).first()
    stress, windows = indices.stress_indices(df, ["point_id"]).first(), indices.spray_windows(df, ["point_id"])
    for name in a.asDict():
        assert a[name] == pytest.approx(b[name]) if isinstance(a[name], float) else a[name] == b[name]
    assert stress["gdd_accumulated_c_days"] == pytest.approx(a["gdd_accumulated_c_days"]) and windows.count() == a["spray_windows"]


ROUTES = [
    (31.2, 76.5, "ACZ_01", True), (26.92, 75.79, "ACZ_14", True), (31.5, 77.5, "ACZ_01", True), (30.9, 75.85, "ACZ_06", True),
    (22.3039, 70.8022, "ACZ_13", False), (28.0, 77.0, "ACZ_14", True), (12.0, 93.0, "ACZ_15", True),
]


@pytest.mark.parametrize("lat, lon, zone, exact", ROUTES)
def test_routing(spark, lat, lon, zone, exact):
    df = spark.createDataFrame([(lat, lon)], "latitude double, longitude double")
    row = spatial.route(df).first()
    assert (row["zone_id"], row["in_exact_bounds"]) == (zone, exact)
    assert row["is_live_deployment_zone"] == (zone == catalogs.LIVE_ZONE)


def test_crop_fallbacks(spark):
    df = spark.createDataFrame([(1, "unobtainium", "Sowing"), (2, " bajra ", "Nope")], "id int, crop string, crop_stage string")
    a, b = lookups.crop_profiles(df).orderBy("id").collect()
    assert (a["crop_key"], a["stage_critical_pest"], a["stage_matched"]) == ("BAJRA", "Shoot fly", True)
    assert (b["crop_key"], b["stage_critical_pest"], b["stage_matched"], b["crop_stage"]) == ("BAJRA", "Ergot / Smut", False, "Nope")


def test_warnings_are_cleaned(spark):
    listed = F.array(F.lit("Nil"), F.lit(" Squall "), F.lit(""))
    assert one(spark, text.real_warnings(listed))[0] == ["Squall"]
    assert one(spark, text.real_warnings(F.lit(None).cast("array<string>")))[0] == []


@pytest.mark.parametrize("raw, key", [("14", "ACZ_14"), ("acz_01", "ACZ_01"), (" ACZ_07 ", "ACZ_07"), ("3", "ACZ_03")])
def test_zone_keys(spark, raw, key):
    assert one(spark, text.zone_key(F.lit(raw)))[0] == key


def stations(spark, n):
    return spark.createDataFrame([("Z", f"P{i:02d}") for i in range(n)], "zone_id string, point_id string")


@pytest.mark.parametrize("n, sizes", [(10, (7, 1, 2)), (3, (1, 1, 1)), (36, (25, 4, 7))])
def test_three_way_split_sizes(spark, n, sizes):
    parts = {r["part"]: r["count"] for r in splits.three_way(stations(spark, n), ["zone_id"]).groupBy("part").count().collect()}
    assert (parts["train"], parts["validation"], parts["test"]) == sizes


def test_hold_outs_shrink_until_a_training_station_is_left(spark):
    labels = splits.three_way(stations(spark, 4), ["zone_id"], test=0.6, validation=0.6)
    parts = {r["part"]: r["count"] for r in labels.groupBy("part").count().collect()}
    assert parts == {"train": 1, "validation": 1, "test": 2}


def test_evenly_spaced_split(spark):
    picked = splits.evenly_spaced(stations(spark, 10), ["zone_id"], 0.2).filter("part = 'test'").select("point_id").collect()
    assert sorted(r[0] for r in picked) == ["P00", "P09"]


def test_folds_differ_by_one_at_most(spark):
    counts = [r["count"] for r in splits.folds(stations(spark, 13), ["zone_id"], 5).groupBy("fold").count().orderBy("fold").collect()]
    assert counts == [3, 3, 3, 2, 2]


def test_order_checks_quarantine(spark):
    df = spark.createDataFrame([(30.0, 20.0), (10.0, 20.0)], "min_temp_c double, max_temp_c double")
    valid, bad = quality.split_valid(quality.with_errors(df, quality.order_errors([("min_temp_c", "max_temp_c")])))
    assert (valid.count(), bad.first()["errors"]) == (1, ["min_temp_c above max_temp_c"])


def test_true_zero_survives_the_defaults(spark):
    df = spark.createDataFrame([(0.0, None)], "et0_evapotranspiration_mm double, soil_moisture_0_to_7cm_m3m3 double")
    row = quality.serving_defaults(df).first()
    assert (row["et0_evapotranspiration_mm"], row["soil_moisture_0_to_7cm_m3m3"]) == (0.0, 0.25)


def test_model_inputs_are_28_and_subsets_nest():
    assert len(residual_models.FEATURES_28) == len(set(residual_models.FEATURES_28)) == 28
    assert len(residual_models.FEATURES_17) == 17 and len(residual_models.FEATURES_21) == 21
    assert set(residual_models.FEATURES_21) <= set(residual_models.FEATURES_28)


BULLETINS = {
    "dry": "Farm weather note, Mandla\nSky: Hazy sun with a cool breeze.\nMax temperature 31.5 C, minimum temperature 17.5 C.\nRainfall: Nil.\nCrop Advisory: Thin the chickpea rows.",
    "storm": "Evening update\nSky: Dark towering clouds.\nMax Temp: 27.0 C, Min Temp: 21.5 C.\nRainfall: 12 mm to 38 mm by dawn.\nWarnings: Flash flood watch, Lightning near the ghats.",
    "readings": "District: Koraput\nObserved Maximum Temperature: 24.8 C\nObserved Minimum Temperature: 11.2 C",
    "listed": "District: Latur\nValid: 17-02-2027 to 19-02-2027\nWarning 1: Dense fog\nWarning 2: Strong wind 35-45 km/h\nWarning 3: Ground frost",
    "words": "District: Palakkad\nRainfall: Light rainfall likely on the hills.\nWind: 9 km/h North-Easterly.",
    "spans": "Expected max temp 41-43 C, min temp 27-29 C. Wind 22-28 km/h.",
}


@pytest.fixture(scope="module")
def extracted(spark):
    df = spark.createDataFrame(list(BULLETINS.items()), "name string, raw_text string")
    return {r["name"]: r for r in extraction.extract_bulletins(df).collect()}


@pytest.mark.parametrize(
    "name, field, value",
    [
        ("dry", "max_temp_c", 31.5), ("dry", "min_temp_c", 17.5), ("dry", "rainfall_max_mm", 0.0), ("dry", "warnings", []),
        ("dry", "advisory_text", "Thin the chickpea rows."), ("dry", "weather_condition", "Hazy sun with a cool breeze"),
        ("storm", "rainfall_min_mm", 12.0), ("storm", "rainfall_max_mm", 38.0), ("storm", "advisory_text", None),
        ("storm", "warnings", ["Flash flood watch", "Lightning near the ghats."]),
        ("readings", "max_temp_c", 24.8), ("readings", "min_temp_c", 11.2), ("readings", "district", "Koraput"), ("readings", "rainfall_max_mm", None),
        ("listed", "valid_from", "17-02-2027"), ("listed", "valid_to", "19-02-2027"), ("listed", "wind_speed_kmh", 45.0),
        ("listed", "warnings", ["Dense fog", "Strong wind 35-45 km/h", "Ground frost"]),
        ("words", "rainfall_qualifier", "Light rainfall"), ("words", "rainfall_min_mm", None),
        ("words", "wind_direction", "North-Easterly"), ("words", "wind_speed_kmh", 9.0),
        ("spans", "min_temp_c", 27.0), ("spans", "max_temp_c", 43.0), ("spans", "wind_speed_kmh", 28.0),
    ],
)
def test_extraction(extracted, name, field, value):
    assert extracted[name][field] == value


def test_templates_leave_no_placeholder(spark):
    plan = advisory.fill(advisory.PROTECTION_TEXT)
    df = spark.createDataFrame([("Flowering", "Extreme", "Ergot", "Note.")], "crop_stage string, stage_sensitivity string, stage_critical_pest string, advisory_notes string")
    assert df.select(plan).first()[0] == "Critical Stage: Flowering (Sensitivity: Extreme). Primary pest/disease threat: Ergot. Note."


def test_override_wins_in_the_covariate_map(spark):
    names = ["elevation_m", "delta_elevation_m", "solar_radiation_w_m2", "soil_temperature_0_to_7cm_c", "soil_moisture_0_to_7cm_m3m3", "et0_evapotranspiration_mm", "thermal_inertia_lag_3h", "predicted_residual_c"]
    df = spark.range(1).select(*[F.lit(1.0).alias(n) for n in names], F.create_map(F.lit("elevation_m"), F.lit(9.0), F.lit("new"), F.lit(2.0)).alias("o"))
    used = df.select(forecasts.covariate_map("o")).first()[0]
    assert used["elevation_m"] == 9.0 and used["new"] == 2.0 and used["delta_elevation_m"] == 1.0 and len(used) == 9
