"""Connected components of a table of links, by contracting stars.

Every round first hangs the larger neighbours of a node on its smallest one, then the
smaller ones, so paths halve and the links end as one star for each component, around its
smallest node. Both steps are one aggregation with map-side combine and one join that AQE
can split, so a node with a third of all links is spread over tasks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldcast.session import settle


def _state(links: DataFrame) -> tuple:
    return tuple(links.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first())


def _hang(links: DataFrame, larger: bool) -> DataFrame:
    """Links (a > b) after one step; larger: both directions of a link count as neighbours of a node."""
    near = links.union(links.select(F.col("b"), F.col("a"))) if larger else links
    least = near.groupBy(F.col("a").alias("node")).agg(F.min(F.least("a", "b")).alias("least"))
    met = near.join(least, near["a"] == least["node"])
    if larger:
        out = met.where("b > a").select(F.col("b").alias("a"), F.col("least").alias("b"))
    else:
        out = met.select(F.explode(F.array(F.struct("a", F.col("least").alias("b")), F.struct(F.col("b").alias("a"), F.col("least").alias("b")))).alias("x")).select("x.*")
    return out.where("a > b").distinct()


def components(links: DataFrame, left: str, right: str) -> DataFrame:
    """node, component: the smallest node that each linked node can reach, itself included.

    Nodes are whole numbers; nodes without a link to another have no row. Repeated links,
    links of a node with itself and links with a null end change nothing.
    """
    pairs = links.where(F.col(left).isNotNull() & F.col(right).isNotNull()).select(F.greatest(left, right).alias("a"), F.least(left, right).alias("b"))
    now = settle(pairs.where("a > b").distinct())
    state = _state(now)
    while state[0]:
        now = settle(_hang(_hang(now, True), False))
        before, state = state, _state(now)
        if state == before:
            break
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(now.select(F.col("b"), F.col("b")).distinct())
