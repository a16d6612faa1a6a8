"""Run registered queries beside their SQL twins in DuckDB and compare the values.

    python -m tests.compare [sf] [name part ...]
"""

from __future__ import annotations

import sys
import time
import traceback

import duckdb
import pandas as pd

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def canonical(frame: pd.DataFrame) -> list[tuple]:
    columns = sorted(frame.columns)

    def one(v):
        if v is None or v is pd.NaT or (isinstance(v, float) and v != v):
            return "∅"
        if hasattr(v, "item"):
            v = v.item()
        return repr(v)

    return sorted(tuple(one(v) for v in row) for row in frame[columns].itertuples(index=False, name=None))


def difference(mine: pd.DataFrame, theirs: pd.DataFrame) -> str | None:
    if sorted(mine.columns) != sorted(theirs.columns):
        return f"columns {sorted(mine.columns)} against {sorted(theirs.columns)}"
    a, b = canonical(mine.astype(object).where(mine.notna(), None)), canonical(theirs.astype(object).where(theirs.notna(), None))
    if len(a) != len(b):
        return f"{len(a)} rows against {len(b)}"
    wrong = [(x, y) for x, y in zip(a, b) if x != y]
    return f"{len(wrong)} of {len(a)} rows differ, first: {wrong[0]}" if wrong else None


def spark_session():
    from fieldcast.session import build_session

    spark = build_session(
        "fieldcast-tests", "local[8]", spark_sql_shuffle_partitions="8", spark_ui_enabled="false",
        spark_driver_memory="8g", spark_ui_showConsoleProgress="false",
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def main() -> int:
    sf = sys.argv[1] if len(sys.argv) > 1 else "0.01"
    wanted = sys.argv[2:]
    import __spark_entry__ as entry

    spark, sf_dir = spark_session(), f"/root/testdata/sf{sf}"
    con, queries, oracle, bad = connect(sf_dir), entry.queries(), entry.oracle_sql(), 0
    for name, run in queries.items():
        if wanted and not any(name == w or name.startswith(w) for w in wanted):
            continue
        begun = time.perf_counter()
        try:
            mine = run(spark, sf_dir).toPandas()
            took = time.perf_counter() - begun
            if name not in oracle:
                print(f"rows  {name:40} {len(mine):7} rows {took:6.2f}s")
                continue
            theirs = con.execute(oracle[name]).df()
            wrong = difference(mine, theirs)
            print(f"{'FAIL ' if wrong else 'ok   '} {name:40} {len(mine):7} rows {took:6.2f}s {wrong or ''}", flush=True)
            bad += bool(wrong)
        except Exception as failure:  # noqa: BLE001
            bad += 1
            lines = str(failure).strip().splitlines() or [""]
            print(f"ERROR {name:40} {type(failure).__name__}: {' | '.join(lines[:6])[:900]}", flush=True)
            if "-v" in wanted:
                traceback.print_exc()
    print("failures:", bad)
    return bad


if __name__ == "__main__":
    sys.exit(1 if main() else 0)
