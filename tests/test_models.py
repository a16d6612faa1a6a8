"""Boosted models, their registry and scoring, against plain numpy and against each other."""

import dataclasses
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldcast.operators import boosting, forest, model_registry, residual_models
from fieldcast.plans import fleet, forecasts
from fieldcast.session import shared_folder

QUICK = boosting.Settings(trees=9, depth=3, rate=0.3, patience=4, bins=16, settle_rounds=3)
INPUTS = ["a", "b", "c"]


def _rows(spark, zones=("Z 1", "Z-1"), n=240):
    rng = random.Random(6)
    out = []
    for zone in zones:
        for i in range(n):
            a, b, c = rng.random(), rng.choice([0.0, 1.0, 2.0]), rng.gauss(0, 1)
            out.append((zone, f"P{i % 12:02d}", i, a, b, c if i % 37 else None, 2 * a + (b == 1.0) + (0.3 if zone == "Z-1" else 0.0) + rng.random() / 10))
    return spark.createDataFrame(out, "zone_id string, point_id string, timestamp long, a double, b double, c double, y double").repartition(5)


def _fit(rows, settings, held="point_id < 'P02'"):
    return boosting.fit(rows, INPUTS, "y", F.array("zone_id"), F.array(F.expr(held)), settings)


def test_both_ways_to_grow_give_the_same_trees(spark):
    rows = _rows(spark)
    alone = sorted(map(str, _fit(rows, QUICK).collect()))
    together = sorted(map(str, _fit(rows, dataclasses.replace(QUICK, memory_rows=10)).collect()))
    one_of_each = sorted(map(str, _fit(rows.filter("zone_id = 'Z 1' or timestamp < 50"), dataclasses.replace(QUICK, memory_rows=100)).collect()))
    assert alone == together and len(alone) > 4 and len(one_of_each) > 4


def test_first_cut_is_the_best_one(spark):
    rows = _rows(spark, ["Z"])
    whole = dataclasses.replace(QUICK, trees=1, rows=1.0, columns=1.0, shrink=0.0)
    trees = _fit(rows, whole, "false").orderBy("tree").collect()
    data = rows.toPandas()
    y = data["y"].to_numpy()
    assert trees[0]["value"] == pytest.approx([y.mean()], abs=1e-5)
    edges = boosting.cut_points(rows, INPUTS, "zone_id", whole.bins)["Z"]
    best = max(
        (len(l) * l.mean() ** 2 + len(r) * r.mean() ** 2, -k, -j) for k, cuts in enumerate(edges) for j, e in enumerate(cuts)
        for l, r in [(y[data[INPUTS[k]].fillna(np.inf).to_numpy() <= e], y[data[INPUTS[k]].fillna(np.inf).to_numpy() > e])] if len(l) and len(r)
    )
    assert trees[1]["feature"][0] == -best[1] and trees[1]["threshold"][0] == pytest.approx(edges[-best[1]][-best[2]])


def test_patience_keeps_trees_up_to_the_best_round(spark):
    rows = _rows(spark).withColumn("y", F.crc32(F.concat("point_id", F.col("timestamp").cast("string"))) % 100 / 100.0)
    first = _fit(rows, dataclasses.replace(QUICK, trees=400, patience=5)).filter("tree = -1").collect()
    kept = {r["model"]: r["n"] for r in _fit(rows, dataclasses.replace(QUICK, trees=400, patience=5)).filter("tree >= 0").groupBy("model").agg(F.count("*").alias("n")).collect()}
    for r in first:
        assert r["rounds"] < 400 and r["rounds"] - 1 - r["best_round"] == 5 and kept.get(r["model"], 0) == r["best_round"] + 1


def test_registered_models_predict_what_was_fitted(spark):
    rows, root = _rows(spark), shared_folder(spark)
    trees = _fit(rows, QUICK)
    folder = model_registry.publish(trees, root, "1")
    where = rows.withColumn("path", F.when(F.col("timestamp") % 5 > 0, model_registry.path_of(folder, F.col("zone_id"))))
    scored = model_registry.predict(where, INPUTS, "path", "p").toPandas()
    assert scored["p"].isna().sum() == scored["path"].isna().sum() > 0
    known = {zone: sorted(model_registry.load(path)) for zone, path in scored.dropna().groupby("zone_id")["path"].first().items()}
    for r in scored.dropna(subset=["path"]).itertuples():
        total = 0.0
        for _, _, feature, threshold, value in known[r.zone_id]:
            node, x = 0, [np.inf if np.isnan(v) else v for v in (r.a, r.b, r.c)]
            while feature[node] >= 0:
                node = 2 * node + 1 + (x[feature[node]] > threshold[node])
            total += value[node]
        assert r.p == pytest.approx(total)
    miss = scored.dropna(subset=["path"])
    assert np.mean((miss["p"] - miss["y"]) ** 2) < 0.5 * miss["y"].var()


def test_latest_version_serves_and_other_zones_fall_back(spark):
    root = shared_folder(spark)
    for version, path in (("1", "old"), ("2", "new")):
        model_registry.append(spark.createDataFrame([("A", version, path, version)], "zone_id string, version string, model_path string, trained_at string"), root)
    model_registry.append(spark.createDataFrame([("B", "1", "b", "1")], "zone_id string, version string, model_path string, trained_at string"), root)
    registry = model_registry.entries(spark, root)
    assert registry.count() == 3
    rows = spark.createDataFrame([("A",), ("B",), ("C",), (None,)], "zone_id string")
    got = {r["zone_id"]: (r["model_zone"], r["model_path"], r["is_default_model"]) for r in model_registry.routed(rows, registry, "A").collect()}
    assert got == {"A": ("A", "new", False), "B": ("B", "b", False), "C": ("A", "new", True), None: ("A", "new", True)}
    plan = model_registry.routed(rows, registry, "A")._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan


def _featured(spark, stations: dict[str, int]):
    rng = random.Random(2)
    rows = []
    for zone, count in stations.items():
        for p in range(count):
            for h in range(20):
                x = [rng.random() for _ in residual_models.FEATURES_28]
                rows.append((zone, f"{zone}{p}", h, 20.0 + x[0], x[0] - x[1], 10.0 + p, 20.0 + p, *x))
    names = ", ".join(f"{f} double" for f in residual_models.FEATURES_28)
    return spark.createDataFrame(rows, f"zone_id string, point_id string, h int, temperature_2m_c double, residual_anomaly_c double, latitude double, longitude double, {names}").withColumn(
        "timestamp", F.expr("timestamp'2024-03-01 00:00:00' + make_interval(0, 0, 0, 0, h)")
    )


def test_a_zone_that_cannot_be_trained_does_not_stop_the_others(spark):
    rows, root = _featured(spark, {"GOOD": 8, "LONE": 1}), shared_folder(spark)
    got = {r["zone_id"]: r for r in fleet.train_fleet(rows, root, settings=QUICK).collect()}
    assert got["GOOD"]["error"] is None and got["GOOD"]["trees"] > 0 and got["GOOD"]["test_samples"] == 40
    assert got["LONE"]["error"] == "no training station" and got["LONE"]["stations"] == 1
    served = forecasts.downscale(rows, model_registry.entries(spark, root), "GOOD", residual_models.FEATURES_28)
    zones = {(r["zone_id"], r["model_zone"], r["n"]) for r in served.groupBy("zone_id", "model_zone").agg(F.count("downscaled_value").alias("n")).collect()}
    assert zones == {("GOOD", "GOOD", 160), ("LONE", "GOOD", 20)}
    scans = served._jdf.queryExecution().optimizedPlan().toString().count("LogicalRDD")
    assert scans == 1


def test_folds_are_scored_unseen(spark):
    rows = _featured(spark, {"Z": 10})
    got = residual_models.cross_validate(rows, 5, settings=QUICK).collect()
    assert sorted(r["fold"] for r in got) == [1, 2, 3, 4, 5] and sum(r["rows"] for r in got) == 200 and all(r["val_points_count"] == 2 for r in got)


def test_importances_are_shares(spark):
    table = boosting.importance(_fit(_rows(spark), QUICK), INPUTS).collect()
    assert len(table) == 6
    for zone in ("Z 1", "Z-1"):
        shares = {r["feature"]: r["importance"] for r in table if r["model"] == zone}
        assert sum(shares.values()) == pytest.approx(1.0) and shares["c"] == min(shares.values())


def _plain_tree(codes, y, weight, tree, s, node=0, level=0):
    """Leaf mean of each row, one node after the other."""
    out = np.full(len(y), np.average(y, weights=weight) if weight.sum() else 0.0)
    if level == s.depth or weight.sum() < 2 * s.least:
        return out
    best = (1e-9, None, None)
    for k in forest.looked_at(tree, level, codes.shape[1], s)[node - (2**level - 1)].tolist():
        for cut in range(s.bins):
            left = codes[:, k] <= cut
            a, b = weight[left].sum(), weight[~left].sum()
            if min(a, b) >= s.least:
                gain = ((y * weight)[left].sum() ** 2 / a + (y * weight)[~left].sum() ** 2 / b - (y * weight).sum() ** 2 / (a + b)) / boosting.SCALE**2
                best = max(best, (gain, -k, -cut), key=lambda x: x[0])
    if best[1] is not None:
        right = codes[:, -best[1]] > -best[2]
        for side in (0, 1):
            at = right == side
            out[at] = _plain_tree(codes[at], y[at], weight[at], tree, s, 2 * node + 1 + side, level + 1)
    return out


def test_a_tree_of_the_forest_is_grown_node_by_node():
    rng = np.random.default_rng(4)
    codes, ids, s = rng.integers(0, 8, (300, 6)).astype(np.uint8), rng.integers(-(2**62), 2**62, 300), forest.Settings(depth=4, bins=8)
    y = np.round((codes[:, 0] + (codes[:, 1] > 3) * codes[:, 2] + rng.random(300)) * boosting.SCALE)
    for tree in range(3):
        weight = forest.times(ids, tree, s)
        assert 0.5 < (weight > 0).mean() < 0.75 and 0.8 < weight.mean() < 1.2
        feature, bin_, value, _ = forest.grow(codes, y, ids, tree, s)
        node = np.zeros(300, int)
        for _ in range(s.depth):
            node = boosting.step(codes, node, feature, bin_)
        seen = weight > 0
        assert value[node][seen] == pytest.approx(_plain_tree(codes[seen], y[seen], weight[seen], tree, s))


def test_a_forest_is_the_same_in_any_order_and_predicts(spark):
    rows, s = _rows(spark).withColumn("residual_anomaly_c", F.col("y")), forest.Settings(trees=20, depth=6)
    trees = forest.fit(rows, INPUTS, "y", s)
    assert sorted(map(str, trees.collect())) == sorted(map(str, forest.fit(rows.repartition(2), INPUTS, "y", s).collect())) and trees.count() == 21
    known = rows.withColumn("baseline_temp_c", F.lit(0.0))
    scored = residual_models.forest_score(known, known, INPUTS, s).toPandas()
    assert len(scored) == 480 and np.mean((scored["predicted_residual_c"] - scored["y"]) ** 2) < 0.1 * scored["y"].var()
    assert forest.fit(rows.limit(0), INPUTS, "y", s).count() == 0


def test_every_small_model_has_a_task_of_its_own(spark):
    """Models dealt by the hash of their names may share a task, which then takes as long as both."""
    zones = [f"Z{i}" for i in range(12)]
    rows = _rows(spark, zones, 24)
    seen = []
    whole, boosting.settle = boosting.settle, lambda df: seen.append(df) or whole(df)
    try:
        _fit(rows, QUICK)
    finally:
        boosting.settle = whole
    used = seen[-1].select("model", F.spark_partition_id().alias("task")).distinct().collect()
    assert len({r["task"] for r in used}) == len({r["model"] for r in used}) == 12


def test_packs_of_inputs_give_the_trees_of_single_ones(monkeypatch):
    """A wide node is summed once for each pack of inputs, so there must be fewer packs than inputs; also where rows change their order."""
    rng = np.random.default_rng(8)
    hour, height = rng.integers(0, 24, 900), rng.integers(0, 20, 900)
    columns = np.stack([hour, (hour * 7) % 24, height, 19 - height, rng.integers(0, 64, 900), rng.integers(0, 64, 900), np.zeros(900, int)]).astype(np.uint8)
    y, held, ids = columns[4] / 9.0 + (hour > 6) * height + rng.random(900), rng.random(900) < 0.2, rng.integers(-(2**62), 2**62, 900)
    packs = boosting.packed(columns)
    assert len(packs) < 4 and sorted(k for p in packs for k in p.inputs) == list(range(7))
    assert all((p.of[at][p.codes] == columns[k]).all() for p in packs for at, k in enumerate(p.inputs))
    settings, grown = dataclasses.replace(QUICK, trees=12, bins=64, depth=5, patience=20), []
    for wide in (10_000, 20):
        monkeypatch.setattr(boosting, "WIDE", wide)
        monkeypatch.setattr(boosting, "REORDER", 4)
        grown.append(boosting.grow(columns, y, held, ids, settings))
    assert grown[0].best == grown[1].best and len(grown[0].trees) == 12
    assert all(np.array_equal(a, b) for one, other in zip(grown[0].trees, grown[1].trees) for a, b in zip(one, other))


def test_a_task_of_the_forest_holds_a_piece_of_the_matrix_at_a_time(spark, monkeypatch):
    """Rows come piece by piece, the same pieces for every level, and trees in groups that fit the memory; the trees are those of all rows at once."""
    rng, s = np.random.default_rng(5), forest.Settings(trees=4, depth=6, bins=8)
    codes, ids = rng.integers(0, 8, (900, 6)).astype(np.uint8), rng.integers(-(2**62), 2**62, 900)
    y = np.round((codes[:, 0] + (codes[:, 1] > 3) * codes[:, 2] + rng.random(900)) * boosting.SCALE)
    whole = [forest.grow(codes, y, ids, tree, s) for tree in range(4)]
    spans = [(0, 1), (1, 400), (400, 900)]
    some = forest.grow_some(lambda: ((codes[a:b], y[a:b], ids[a:b]) for a, b in spans), [0, 1, 2, 3], 6, s)
    assert all(np.array_equal(a, b) for one, other in zip(whole, some) for a, b in zip(one, other))
    at_once = [forest.at_once(n, 21, residual_models.FOREST) for n in (100, 1_000_000, 24_000_000)]
    assert at_once[0] > at_once[1] > at_once[2] == 1
    rows = _rows(spark).withColumn("residual_anomaly_c", F.col("y"))
    kept = sorted(map(str, forest.fit(rows, INPUTS, "y", s).collect()))
    monkeypatch.setattr(forest, "KEPT", 0)
    monkeypatch.setattr(forest, "MEMORY", 1)
    assert kept == sorted(map(str, forest.fit(rows, INPUTS, "y", s).collect())) and len(kept) == 5


def test_pieces_are_whole_and_alike_every_time(tmp_path, spark, monkeypatch):
    monkeypatch.setattr(forest, "PIECE", 50)
    rows = spark.range(333).selectExpr("id", "cast(id as double) as y", "unhex(lpad(hex(id), 4, '0')) as codes").repartition(7)
    rows.mapInArrow(lambda batches: forest.blocks(batches, 2), "rows bigint, codes binary, y binary, id binary").write.parquet(f"{tmp_path}/m")
    files = sorted(spark.read.parquet(f"{tmp_path}/m").inputFiles())
    first, second = (list(forest.pieces(files, 2)) for _ in range(2))
    assert len(first) > 2 and all(np.array_equal(a, b) for one, other in zip(first, second, strict=True) for a, b in zip(one, other))
    codes, y, ids = (np.concatenate(x) for x in zip(*first))
    assert sorted(ids.tolist()) == list(range(333)) and np.array_equal(y, ids * boosting.SCALE) and np.array_equal(codes @ [256, 1], ids)
