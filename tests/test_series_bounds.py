"""Windows that hold a value which is not finite, and series cut to a horizon."""

import math
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from fieldcast.operators import timeseries
from fieldcast.plans import features

START = datetime(2024, 1, 1)


def _series(spark, values, key="a"):
    return spark.createDataFrame([(key, START + timedelta(hours=i), v) for i, v in enumerate(values)], "key string, ts timestamp, x double")


@pytest.mark.parametrize("rows, block", [(1, 8), (2, 8), (5, 16), (7, 4096)])
def test_odd_values_touch_only_their_windows(spark, rows, block):
    rng = random.Random(rows)
    odd = [float("nan"), float("inf"), -float("inf"), 1e300, None]
    values = [rng.choice(odd) if rng.random() < 0.08 else float(rng.randint(-9, 9)) for _ in range(150)]
    got = timeseries.near_rows(_series(spark, values), ["key"], "ts", {"s": timeseries.trailing_sum("x", rows)}, back=rows, block_rows=block).orderBy("ts").collect()
    for i, r in enumerate(got):
        window = [v for v in values[max(0, i - rows + 1) : i + 1] if v is not None]
        want = None if not window else float("nan") if any(map(math.isnan, window)) or {float("inf"), -float("inf")} <= set(window) else sum(window)
        assert (r.s is None) == (want is None), i
        if want is not None:
            assert math.isnan(r.s) if math.isnan(want) else r.s == want or r.s == pytest.approx(want), i


def test_first_rows_are_trimmed_before_they_meet(spark):
    rng = random.Random(1)
    rows = [("hot" if i % 3 else f"k{i % 40}", START + timedelta(minutes=rng.randint(0, 9_000_000)), float(i)) for i in range(6000)] + [("hot", None, -1.0), (None, START, -2.0)]
    df = spark.createDataFrame(rows, "key string, ts timestamp, x double").repartition(9)
    first = timeseries.first_rows(df, ["key"], "ts", 12)
    plan = first._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") >= 2
    want = {}
    for key, ts, x in rows:
        want.setdefault(key, []).append((ts is not None, ts or START, x))
    got = {}
    for r in first.collect():
        got.setdefault(r.key, []).append((r._row_no, r.ts))
    assert {k: [(i + 1, t if known else None) for i, (known, t, _) in enumerate(sorted(v)[:12])] for k, v in want.items()} == {k: sorted(v, key=lambda p: p[0]) for k, v in got.items()}


def test_serving_features_of_long_series_match_short_ones(spark):
    rng = random.Random(3)
    rows = [("z", f"p{p}", START + timedelta(hours=h), rng.choice([None, rng.uniform(5, 40)]), 300.0 + p) for p in range(3) for h in range(200)]
    names = "relative_humidity_2m_pct surface_pressure_hpa wind_speed_10m_kmh precipitation_mm solar_radiation_w_m2 shortwave_radiation_w_m2 soil_temperature_0_to_7cm_c soil_moisture_0_to_7cm_m3m3 et0_evapotranspiration_mm".split()
    df = spark.createDataFrame(rows, "zone_id string, point_id string, timestamp timestamp, temperature_2m_c double, elevation_m double").withColumns({n: F.lit(1.0) for n in names})
    columns = ["point_id", "timestamp", "thermal_inertia_lag_3h", "baseline_temp_c", "hour_sin"]
    whole = features.serving_features(df, ["zone_id", "point_id"]).select(columns)
    cut = features.serving_features(df, ["zone_id", "point_id"], hours=60).select(columns)
    assert cut.count() == 180 and whole.count() == 600
    assert cut.exceptAll(whole).count() == 0
