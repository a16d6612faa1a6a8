"""Ordered operators over one series per key.

A key may hold a large share of all rows, so no operator here sorts a whole series in
one task. Running totals are built per calendar month first and carried over from month
to month; operators that reach a fixed number of rows away work on blocks of rows with
that many rows copied in from the neighbouring blocks. Both give the same rows as a plain window.

`short=True` is for series whose length has a bound, such as a forecast cut to its horizon
of at most 168 hours: there the plain window is used, as its groups are small.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from fieldcast.operators.keys import AT, meet

MONTH = "_month"
BLOCK = "_block"
BLOCK_ROWS = 4096


def _before(spec: WindowSpec) -> WindowSpec:
    return spec.rowsBetween(W.unboundedPreceding, -1)


def running_totals(
    df: DataFrame, key: list[str], order: str, totals: dict[str, Column], yearly: dict[str, Column] | None = None,
    short: bool = False,
) -> DataFrame:
    """Add running sums, in `order`, within `key`; those in `yearly` restart each calendar year.

    Every value is a non-null expression over the row. Rows without a key are a series of
    their own, and rows without a time come first. The monthly sums are a second pass
    over `df`, so call this on a stored or cheap table rather than after heavy joins.
    """
    values = {**totals, **(yearly or {})}
    if short:
        spec, year = W.partitionBy(*key), W.partitionBy(*key, F.year(order))
        sums = {
            n: F.sum(v).over((spec if n in totals else year).orderBy(order).rowsBetween(W.unboundedPreceding, 0))
            for n, v in values.items()
        }
        return df.withColumns(sums)
    rows = df.withColumns({f"_add_{name}": value for name, value in values.items()} | {AT: F.struct(*key, F.date_trunc("month", order).alias(MONTH))})
    # One row per key and month: a century of hours is at most 1200 rows per key.
    months = rows.groupBy(AT).agg(*[F.sum(f"_add_{n}").alias(f"_sum_{n}") for n in values])
    own, month = [F.col(f"{AT}.{k}") for k in key], F.col(f"{AT}.{MONTH}")
    ahead = _before(W.partitionBy(*own).orderBy(month))
    ahead_this_year = _before(W.partitionBy(*own, F.year(month)).orderBy(month))
    carried = months.select(
        AT,
        *[
            F.coalesce(F.sum(f"_sum_{n}").over(ahead if n in totals else ahead_this_year), F.lit(0)).alias(
                f"_carry_{n}"
            )
            for n in values
        ],
    )
    inside = W.partitionBy(AT).orderBy(order).rowsBetween(W.unboundedPreceding, 0)
    summed = rows.join(carried, AT).withColumns(
        {name: F.col(f"_carry_{name}") + F.sum(f"_add_{name}").over(inside) for name in values}
    )
    return summed.drop(AT, *[f"_add_{n}" for n in values], *[f"_carry_{n}" for n in values])


def number_rows(df: DataFrame, key: list[str], order: str, name: str = "row_no", short: bool = False) -> DataFrame:
    """1, 2, 3, ... within each key."""
    return running_totals(df, key, order, {name: F.lit(1).cast("bigint")}, short=short)


def near_rows(
    df: DataFrame,
    key: list[str],
    order: str,
    columns: dict[str, Callable[[WindowSpec], Column]],
    back: int = 0,
    ahead: int = 0,
    numbered: str | None = None,
    block_rows: int = BLOCK_ROWS,
    short: bool = False,
) -> DataFrame:
    """Evaluate window expressions that reach at most `back` rows into the past and `ahead`
    rows into the future. `numbered` names an existing row number column."""
    if short:
        plain = W.partitionBy(*key).orderBy(order)
        return df.withColumns({name: make(plain) for name, make in columns.items()})
    if back + ahead >= block_rows:
        raise ValueError("a block must be longer than the reach of the windows")
    row_no = numbered or "_row_no"
    rows = df if numbered else number_rows(df, key, order, row_no)
    place = (F.col(row_no) - 1) % block_rows
    home = F.floor((F.col(row_no) - 1) / block_rows)
    homes = F.array_compact(
        F.array(
            home,
            F.when(place >= block_rows - back, home + 1),
            F.when((place < ahead) & (home > 0), home - 1),
        )
    )
    blocks = rows.withColumn(BLOCK, F.explode(homes))
    spec = W.partitionBy(*key, BLOCK).orderBy(row_no)
    trailing = {name: make for name, make in columns.items() if isinstance(make, TrailingSum)}
    if trailing:
        # Dealt by block once; every window below finds its rows in place.
        blocks = blocks.repartition(*key, BLOCK)
        for name, make in trailing.items():
            blocks = blocks.withColumns(make.parts(name, [*key, BLOCK], row_no))
    # Filtering after the windows keeps the copied rows visible to them.
    result = blocks.withColumns({name: make(spec) if name not in trailing else make.whole(name, spec) for name, make in columns.items()})
    result = result.filter(F.col(BLOCK) == home).drop(BLOCK, *[part for name in trailing for part in TrailingSum.names(name)])
    return result if numbered else result.drop(row_no)


def difference(column: str, steps: int) -> Callable[[WindowSpec], Column]:
    """Change since `steps` rows ago; rows without such a predecessor give 0."""
    return lambda w: F.coalesce(F.col(column) - F.lag(column, steps).over(w), F.lit(0.0))


class TrailingSum:
    """Sum of the last `rows` rows, for `near_rows` with at least `rows` - 1 of them in reach.

    The series is cut into stretches of `rows` rows, summed from both ends. A window ends in one
    stretch and begins in the one before, so it is the front of the one plus the rear of the other:
    constant work per row, and a value that is not finite touches only windows that hold it.
    """

    def __init__(self, column: str, rows: int):
        self.column, self.rows, self.row_no = column, rows, ""

    @staticmethod
    def names(name: str) -> list[str]:
        return [f"_{part}_{name}" for part in ("front", "rear", "front_n", "rear_n")]

    def parts(self, name: str, keys: list[str], row_no: str) -> dict[str, Column]:
        self.row_no = row_no
        stretch = W.partitionBy(*keys, F.floor((F.col(row_no) - 1) / self.rows)).rowsBetween(W.unboundedPreceding, 0)
        up, down = stretch.orderBy(row_no), stretch.orderBy(F.desc(row_no))
        made = [F.sum(self.column).over(up), F.sum(self.column).over(down), F.count(self.column).over(up), F.count(self.column).over(down)]
        return dict(zip(self.names(name), [F.coalesce(x, F.lit(0.0)) if k < 2 else x for k, x in enumerate(made)]))

    def whole(self, name: str, w: WindowSpec) -> Column:
        front, rear, front_n, rear_n = self.names(name)
        # The last row of a stretch has its window in that stretch alone.
        last = F.col(self.row_no) % self.rows == 0
        begun, begun_n = (F.when(~last, F.lag(c, self.rows - 1).over(w)) for c in (rear, rear_n))
        return F.when(F.col(front_n) + F.coalesce(begun_n, F.lit(0)) > 0, F.col(front) + F.coalesce(begun, F.lit(0.0)))

    def __call__(self, w: WindowSpec) -> Column:
        """The plain window, for short series."""
        return F.sum(self.column).over(w.rowsBetween(-self.rows + 1, 0))


def trailing_sum(column: str, rows: int) -> TrailingSum:
    return TrailingSum(column, rows)


def first_rows(df: DataFrame, key: list[str], order: str, rows: int, name: str = "_row_no", lots: int = 64) -> DataFrame:
    """The first `rows` rows of each key, numbered; rows without a time come first.

    Trimmed map-side: a task keeps that many rows of a key, they meet in `lots` lots, and what
    is left of those meets per key. So a key with a large share of all rows is never sorted whole.
    """
    lot = F.pmod(F.xxhash64(order), F.lit(lots))
    some = F.row_number().over(W.partitionBy(*key, "_lot").orderBy(order))
    dealt = df.withColumn("_lot", lot).withColumn("_some", some).filter(F.col("_some") <= rows).drop("_some", "_lot")
    return dealt.withColumn(name, F.row_number().over(W.partitionBy(*key).orderBy(order))).filter(F.col(name) <= rows)


def first_known(df: DataFrame, key: list[str], order: str, columns: dict[str, str]) -> DataFrame:
    """One row per key with the first non-null value of each column."""
    return df.groupBy(*key).agg(
        *[
            F.min_by(column, F.when(F.col(column).isNotNull(), F.col(order))).alias(name)
            for name, column in columns.items()
        ]
    )


def lag_with_backfill(
    df: DataFrame, key: list[str], order: str, column: str, steps: int, name: str
) -> DataFrame:
    """Value `steps` rows earlier; the head of a series takes its first known value."""
    lagged = near_rows(df, key, order, {"_lag": lambda w: F.lag(column, steps).over(w)}, back=steps)
    heads = first_known(df, key, order, {"_head": column})
    return (
        meet(lagged, heads, key)
        .withColumn(name, F.coalesce("_lag", "_head"))
        .drop("_lag", "_head")
    )


def forecast_lag(value: str, row_no: str, first: str) -> Callable[[WindowSpec], Column]:
    """Serving rule: three rows back, else since the first row, else 0; unknown stays 0."""
    def make(w: WindowSpec) -> Column:
        three_back = F.col(value) - F.lag(value, 3).over(w)
        since_start = F.col(value) - F.col(first)
        return F.coalesce(
            F.when(F.col(row_no) > 3, three_back), F.when(F.col(row_no) > 1, since_start), F.lit(0.0)
        )

    return make


def year_to_date(df: DataFrame, key: list[str], order: str, value: Column, name: str) -> DataFrame:
    """Running sum that restarts every calendar year."""
    return running_totals(df, key, order, {}, {name: value})


def fill_within(df: DataFrame, key: list[str], order: str, columns: list[str]) -> DataFrame:
    """Take the next known value of the same key, or the last known one at the end."""
    rows = df.withColumn(AT, F.struct(*key, F.date_trunc("month", order).alias(MONTH)))
    known = {c: F.when(F.col(c).isNotNull(), F.col(order)) for c in columns}
    months = rows.groupBy(AT).agg(
        *[F.min_by(c, known[c]).alias(f"_first_{c}") for c in columns],
        *[F.max_by(c, known[c]).alias(f"_last_{c}") for c in columns],
    )
    spec = W.partitionBy(*[F.col(f"{AT}.{k}") for k in key]).orderBy(F.col(f"{AT}.{MONTH}"))
    after = spec.rowsBetween(1, W.unboundedFollowing)
    carried = months.select(
        AT,
        *[F.first(f"_first_{c}", ignorenulls=True).over(after).alias(f"_next_{c}") for c in columns],
        *[F.last(f"_last_{c}", ignorenulls=True).over(_before(spec)).alias(f"_prev_{c}") for c in columns],
    )
    inside = W.partitionBy(AT).orderBy(order)
    filled = rows.join(carried, AT).withColumns(
        {
            f"_fill_{c}": F.coalesce(
                F.first(c, ignorenulls=True).over(inside.rowsBetween(0, W.unboundedFollowing)),
                F.col(f"_next_{c}"),
                F.last(c, ignorenulls=True).over(inside.rowsBetween(W.unboundedPreceding, 0)),
                F.col(f"_prev_{c}"),
            )
            for c in columns
        }
    )
    return filled.select(*[F.col(f"_fill_{c}").alias(c) if c in columns else F.col(c) for c in df.columns])


def count_runs(df: DataFrame, key: list[str], order: str, flag: Column, run: str, row_no: str, short: bool = False) -> DataFrame:
    """Number all rows, and number the unbroken runs of flagged rows (null on the others)."""
    one = F.lit(1).cast("bigint")
    counted = running_totals(
        df.withColumn("_flag", flag), key, order, {row_no: one, "_hits": F.col("_flag").cast("bigint")}, short=short
    )
    return counted.withColumn(run, F.when(F.col("_flag"), F.col(row_no) - F.col("_hits"))).drop("_flag", "_hits")


def runs(df: DataFrame, key: list[str], order: str, flag: Column, run: str = "run_id", short: bool = False) -> DataFrame:
    """Keep flagged rows and number the unbroken runs they form."""
    counted = count_runs(df, key, order, flag, run, "_all", short)
    return counted.filter(F.col(run).isNotNull()).drop("_all")


def chunk_number(row_no: Column, rows: int = 24) -> Column:
    return F.floor((row_no - 1) / rows)

