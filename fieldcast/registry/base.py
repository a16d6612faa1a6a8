"""How a query and its SQL twin are registered, and how both are made comparable.

A column list such as `point_id:s timestamp:t value:d` names the result columns and their
kind: s text, i whole number, d double, b flag, t timestamp, y date. Doubles are compared
to six digits; the small offset keeps exact halves from rounding apart in two engines.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

TIE = 1.3e-8


def _spark(name: str, kind: str) -> Column:
    value = F.col(name)
    if kind == "d":
        return (F.round(value.cast("double") + TIE, 6) + 0.0).alias(name)
    if kind == "i":
        return value.cast("bigint").alias(name)
    if kind == "t":
        return F.date_format(value, "yyyy-MM-dd HH:mm:ss").alias(name)
    if kind == "y":
        return F.date_format(value, "yyyy-MM-dd").alias(name)
    return value.alias(name)


def _sql(name: str, kind: str) -> str:
    forms = {
        "d": f"round(CAST({name} AS DOUBLE) + {TIE}, 6) + 0.0e0",
        "i": f"CAST({name} AS BIGINT)",
        "t": f"strftime({name}, '%Y-%m-%d %H:%M:%S')",
        "y": f"strftime({name}, '%Y-%m-%d')",
    }
    return f"{forms.get(kind, name)} AS {name}"


def _spec(columns: str) -> list[tuple[str, str]]:
    return [tuple(c.split(":")) for c in columns.split()]


def query(name: str, columns: str, sql: str | None = None):
    """Register a function (spark, sf_dir) -> DataFrame under a name, with its SQL if there is one."""
    spec = _spec(columns)

    def register(build: Callable[[SparkSession, str], DataFrame]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            from fieldcast.registry import tables

            tables.forget()
            spark.conf.set("spark.sql.session.timeZone", "UTC")
            return build(spark, sf_dir).select(*[_spark(*c) for c in spec])

        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = run
        if sql:
            ORACLES[name] = f"SELECT {', '.join(_sql(*c) for c in spec)} FROM ({sql}) AS result"
        return build

    return register
