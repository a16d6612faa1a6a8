"""A table that grew by deliveries is the table of one delivery, and only what changed is written."""

import os
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from fieldcast.plans import features, ingest

START = datetime(2024, 1, 30)


@pytest.fixture(scope="module")
def hours(spark):
    rng = random.Random(9)
    names = ["temperature_2m_c", "relative_humidity_2m_pct", "surface_pressure_hpa", "wind_speed_10m_kmh", "precipitation_mm", "solar_radiation_w_m2", "shortwave_radiation_w_m2",
             "soil_temperature_0_to_7cm_c", "soil_moisture_0_to_7cm_m3m3", "et0_evapotranspiration_mm"]
    rows = []
    for zone in ("0012", "ACZ_01", None):
        for p in range(5):
            for h in range(72):
                rows.append((zone, f"P{p}", START + timedelta(hours=h) if h or p else None, 20.0 + p / 10, 75.0 + p / 7, 300.0 + 40 * p, *[round(rng.uniform(1, 40), 2) for _ in names]))
    schema = "zone_id string, point_id string, timestamp timestamp, latitude double, longitude double, elevation_m double, " + ", ".join(f"{n} double" for n in names)
    return spark.createDataFrame(rows, schema)


def _files(table):
    return {os.path.relpath(os.path.join(d, f), table): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, fs in os.walk(table) for f in fs if f.endswith(".parquet")}


def _rounded(df):
    return sorted(tuple(round(v, 6) if isinstance(v, float) else str(v) for v in row) for row in df.select(sorted(df.columns)).collect())


def test_one_new_hour_rewrites_one_partition(spark, hours, tmp_path):
    table = str(tmp_path / "hours")
    late = (F.col("zone_id") == "ACZ_01") & (F.col("point_id") == "P3") & (F.col("timestamp") == F.lit(START + timedelta(hours=50)))
    assert ingest.ingest_zones(spark, hours.filter(~F.coalesce(late, F.lit(False))), table).count() == 15
    before = _files(table)
    assert len({os.path.dirname(f) for f in before}) == 3 * 2 + 3
    gained = ingest.ingest_zones(spark, hours.filter(late), table).collect()
    after = _files(table)
    assert [(r.zone_id, r.point_id) for r in gained] == [("ACZ_01", "P3")]
    changed = {os.path.dirname(f) for f, _ in set(before.items()) ^ set(after.items())}
    assert changed == {"zone_id=ACZ_01/month=m2024_02"}
    assert _rounded(ingest.zone_table(spark, table)) == _rounded(features.engineer_zone_features(hours))


def test_any_portions_give_the_same_table(spark, hours, tmp_path):
    table = str(tmp_path / "hours")
    lot = F.pmod(F.xxhash64("zone_id", "point_id", "timestamp"), F.lit(3))
    for k in (2, 0, 1):
        ingest.ingest_zones(spark, hours.filter((lot == k) | (lot == 2)), table)
    assert ingest.ingest_zones(spark, hours, table).count() == 0
    assert _rounded(ingest.zone_table(spark, table)) == _rounded(features.engineer_zone_features(hours))
    # The first delivery of an hour counts.
    ingest.ingest_zones(spark, hours.withColumn("temperature_2m_c", F.lit(-50.0)), table)
    assert ingest.zone_hours(spark, table).filter("temperature_2m_c < 0").count() == 0
