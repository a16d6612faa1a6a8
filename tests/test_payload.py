"""The combined payload reads the hours and days it is made of from where they were written once."""

from __future__ import annotations

from datetime import datetime, timedelta

from fieldcast.registry import report_queries
from fieldcast.registry import tables as t

START = datetime(1999, 5, 1)


def _tables(spark, folder: str) -> str:
    hours = [(i, START + timedelta(hours=i // 6), i % 6, float(i % 70), '{"k": %d}' % (i % 90)) for i in range(900)]
    spark.createDataFrame(hours, "event_id bigint, ts timestamp, user_id bigint, value double, props string").write.parquet(f"{folder}/events.parquet")
    days = [(i, 1, 1 + i % 2, float(1 + i % 50), 0.01 * (i % 10), "F", START + timedelta(days=i // 3)) for i in range(600)]
    columns = "l_orderkey bigint, l_linenumber int, l_suppkey bigint, l_quantity double, l_discount double, l_linestatus string, l_shipdate timestamp"
    spark.createDataFrame(days, columns).write.parquet(f"{folder}/lineitem.parquet")
    spark.createDataFrame([(1,), (2,)], "s_suppkey bigint").write.parquet(f"{folder}/supplier.parquet")
    return folder


def test_payload_groups_events_and_line_items_once(spark, tmp_path):
    folder = _tables(spark, str(tmp_path / "tables"))
    t.forget()
    made = report_queries.payload(spark, folder)
    read = made.inputFiles()
    assert not [x for x in read if "events.parquet" in x or "lineitem.parquet" in x]
    rows = {r.point_id: r.payload for r in made.collect()}
    assert sorted(rows) == ["GRID_000", "GRID_001"]
    assert all('"phenology"' in x and '"climatology"' in x and '"baseline_weather"' in x for x in rows.values())


def test_stored_rows_are_those_of_the_plan(spark, tmp_path):
    folder = _tables(spark, str(tmp_path / "tables"))
    t.forget()
    planned = t.daily(spark, folder).drop("status")
    kept = t.stored(t.daily, spark, folder, drop=("status",))
    assert t.daily(spark, folder) is kept and kept.columns == planned.columns
    assert sorted(map(tuple, kept.collect()), key=str) == sorted(map(tuple, planned.collect()), key=str)
    t.forget()
    assert "status" in t.daily(spark, folder).columns
