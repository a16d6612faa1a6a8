"""Neighbours and footprints in crowded cells, against brute force."""

import math
import random

import pytest
from pyspark.sql import functions as F

from fieldcast.operators import spatial

BOXES = "name string, west double, south double, east double, north double"


def test_a_pile_in_one_cell(spark):
    rng = random.Random(7)
    rows = [(f"p{i}", 26.0 + rng.random() * 0.2, 75.0 + rng.random() * 0.2, float(rng.randint(100, 900))) for i in range(300)] + [("far", 29.0, 70.0, 1.0), ("none", None, 75.0, 5.0)]
    df = spark.createDataFrame(rows, "name string, latitude double, longitude double, elevation_m double")
    crowded = {r.name: r for r in spatial.neighbourhood(df, 0.15, crowd=20).collect()}
    whole = {r.name: r for r in spatial.neighbourhood(df, 0.15).collect()}
    assert len(crowded) == len(rows)
    for name, lat, lon, z in rows:
        if lat is None:
            assert crowded[name].neighbours == 0
            continue
        near = [(b, c, h) for n, b, c, h in rows if b is not None and 0 < math.hypot(b - lat, c - lon) <= 0.15]
        assert crowded[name].neighbours == whole[name].neighbours == len(near)
        if near:
            assert crowded[name].mean_neighbour_elevation_m == pytest.approx(sum(h for *_, h in near) / len(near))
            pull = sum((h - z) * (1 if b > lat else -1 if b < lat else 0) / max(1e-5, abs((b - lat) * 111000.0)) for b, _, h in near) / len(near)
            assert crowded[name].gradient_ns == pytest.approx(pull, rel=1e-6, abs=1e-9)


def test_no_key_holds_a_crowd(spark):
    left = spark.range(900).select(F.lit(1).alias("cell"), F.col("id").alias("a"))
    right = spark.range(700).select(F.lit(1).alias("cell"), F.col("id").alias("b"))
    few = spark.range(5).select((F.col("id") + 2).alias("cell"), F.col("id").alias("a"))
    met = spatial.meet_in_cells(left.union(few), right.union(few.toDF("cell", "b")), ["cell"], 50)
    assert met.count() == 900 * 700 + 5 and met.distinct().count() == 900 * 700 + 5
    plan = met._jdf.queryExecution().optimizedPlan().toString()
    assert "_i" in plan and "Cartesian" not in plan


@pytest.mark.parametrize("crowd", [10, 2000])
def test_mixed_footprints(spark, crowd):
    rng = random.Random(crowd)
    points = [(round(rng.uniform(-40, 40), 3), round(rng.uniform(-179, 179), 3)) for _ in range(200)] + [(26.5, 75.5 + i / 1000) for i in range(60)]
    boxes = []
    for i in range(150):
        lat, lon = rng.choice(points) if i % 3 else (26.5, 75.5)
        size = rng.choice([0.0, 0.0005, 0.02, 0.5, 1.0, 7.0, 90.0, 360.0])
        boxes.append((f"b{i}", lon - size / 2, lat - size / 3, lon + size / 2, lat + size / 3))
    boxes += [("open", None, 1.0, 2.0, 3.0), ("turned", 10.0, 1.0, 5.0, 3.0)]
    df, found = spark.createDataFrame([*points, (None, 1.0)], "latitude double, longitude double"), spark.createDataFrame(boxes, BOXES)
    got = sorted((r.latitude, r.longitude, r.name) for r in spatial.covering(df, found, crowd).collect())
    want = sorted((lat, lon, n) for lat, lon in points for n, w, s, e, h in boxes if None not in (w, s, e, h) and w <= lon <= e and s <= lat <= h)
    assert got == want
    none = spatial.covering(df, found.limit(0))
    assert none.count() == 0 and "name" in none.columns


def test_candidates_are_within_a_small_factor_of_hits(spark):
    """Small boxes in a dense field and a few wide ones: what meets in cells is not much more than what is covered."""
    rng = random.Random(2)
    points = spark.createDataFrame([(20 + rng.random() * 4, 70 + rng.random() * 4) for _ in range(4000)], "latitude double, longitude double")
    boxes = [(f"s{i}", x, y, x + 0.25, y + 0.25) for i in range(400) for x, y in [(70 + rng.random() * 3.7, 20 + rng.random() * 3.7)]] + [("all", 69.0, 19.0, 75.0, 25.0), ("half", 69.0, 19.0, 72.0, 25.0)]
    met = spatial.covering(points, spark.createDataFrame(boxes, BOXES))
    hits = met.count()
    step = F.pow(F.lit(2.0), F.col("_size"))
    sized = spark.createDataFrame(boxes, BOXES).withColumn("_size", spatial._level(*[F.col(e) for e in ("west", "south", "east", "north")]))
    covers = sized.withColumn("r", F.explode(F.sequence(F.floor(F.col("south") / step), F.floor(F.col("north") / step)))).withColumn("c", F.explode(F.sequence(F.floor(F.col("west") / step), F.floor(F.col("east") / step))))
    assert covers.groupBy("name").count().agg(F.max("count")).first()[0] <= 9
    asked = points.crossJoin(sized.select("_size").distinct()).withColumns({"r": F.floor(F.col("latitude") / step), "c": F.floor(F.col("longitude") / step)})
    assert asked.join(covers, ["_size", "r", "c"]).count() < 5 * hits
