"""Near-duplicate embeddings by a forest of random-projection trees.

A tree has one random direction for each level and a threshold for each node: a middle value of
the node's sample along that direction, where it is thinnest. Vectors near a threshold go both ways; near is `spill`
times the spread, along a random direction, of the difference of a pair that is just a link.
Vectors are compared in double precision within the leaves of all trees; what passes is a
link, and links are united into components. A node that is thick even there is a cluster about as wide as
a link; it stays one leaf, since each cut would part some of its pairs. Trees are added until
linked pairs of the sample meet often enough, however many levels the table needs.

The thresholds are fitted on at most `sample` vectors, which bounds what travels to every
task; every vector is put into every tree. A pair that meets in several leaves counts in the
first of them alone, which each task can tell from the leaves its vectors lie in, so links
are counted without ever writing pairs: a leaf gives one number for each vector and a
spanning forest. A leaf of more than `dense` vectors, such as a cluster with a third of all
rows, is dealt to tasks as pairs of its parts, and all of it is compared. Exact copies are
one node with a weight.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldcast.llm.components import components
from fieldcast.session import settle

COSINE, TREES, SPILL, LEAF, SAMPLE, DENSE = 0.9, 6, 0.36, 768, 20_000, 2048
#: Share of a node within the spill of its threshold from which on the node is not cut.
THICK = 0.3
#: Where thresholds may lie.
MIDDLE = (0.35, 0.4, 0.45, 0.5, 0.55, 0.6, 0.65)
#: Share of linked pairs that must meet; sample vectors it is measured on, pairs it takes, and trees at most.
RECALL, PROBED, LEAST_PAIRS, MOST_TREES = 0.95, 2000, 50, 24
#: Sample vectors that a split is made from at least.
LEAST_SAMPLE = 16
#: Levels of a tree at most, so that tree and node fit 32 bits.
LEVELS = 24


def unit(vectors: pa.Array, dimensions: int) -> tuple[np.ndarray, np.ndarray]:
    """Vectors of length one in double precision, and which rows have one: not null, of `dimensions` finite components, not zero."""
    rows = vectors.to_pylist()
    fits = np.array([v is not None and len(v) == dimensions and None not in v for v in rows], bool)
    x = np.array([v for v, ok in zip(rows, fits) if ok], float).reshape(-1, dimensions)
    most = np.abs(x).max(1, initial=0)
    good = np.isfinite(most) & (most > 0)
    fits[fits] = good
    return scaled(x[good]), fits


def scaled(x: np.ndarray) -> np.ndarray:
    x = x.astype(float)
    x /= np.abs(x).max(1, initial=0, keepdims=True)
    return x / np.linalg.norm(x, axis=1)[:, None]


@dataclass
class Forest:
    """directions: tree x dimension x level; thresholds: for each tree, by node number (root 1, children 2k and 2k + 1)."""

    directions: np.ndarray
    thresholds: list[dict[int, float]]
    spill: float

    def leaves(self, x: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For each tree and leaf: its number, and the rows in it."""
        for tree, (directions, nodes) in enumerate(zip(self.directions, self.thresholds)):
            places = x @ directions
            stack = [(1, np.arange(len(x)))]
            while stack:
                node, rows = stack.pop()
                if node not in nodes:
                    yield (tree << LEVELS) + node, rows
                    continue
                at = places[rows, node.bit_length() - 1] - nodes[node]
                stack += [(2 * node, rows[at <= self.spill]), (2 * node + 1, rows[at > -self.spill])]


def _tree(places: np.ndarray, n: int, spill: float, leaf: int) -> dict[int, float]:
    """The thresholds of one tree; places: where each sample vector lies along the direction of each level."""
    nodes, stack = {}, [(1, np.arange(len(places)))]
    while stack:
        node, rows = stack.pop()
        level = node.bit_length() - 1
        if level >= places.shape[1] or len(rows) < LEAST_SAMPLE or len(rows) * n <= leaf * len(places):
            continue
        at = places[rows, level]
        cuts = np.quantile(at, MIDDLE)
        around = (np.abs(at[:, None] - cuts) <= spill).mean(0)
        thinnest = min(range(len(cuts)), key=lambda k: (around[k], abs(MIDDLE[k] - 0.5)))
        if around[thinnest] > THICK:
            continue  # one tight cluster: cutting it further would part its pairs
        middle = nodes[node] = float(cuts[thinnest])
        stack += [(2 * node, rows[at <= middle + spill]), (2 * node + 1, rows[at > middle - spill])]
    return nodes


def meeting(forest: Forest, x: np.ndarray, cosine: float) -> tuple[int, int]:
    """How many pairs of x are links, and how many of them share a leaf."""
    near, together = np.triu(x @ x.T >= cosine, 1), np.zeros((len(x), len(x)), bool)
    for _, rows in forest.leaves(x):
        together[np.ix_(rows, rows)] = True
    return int(near.sum()), int((near & together).sum())


def grow(x: np.ndarray, n: int, cosine: float = COSINE, trees: int = TREES, spill: float = SPILL, leaf: int = LEAF, seed: int = 9) -> Forest:
    """A forest for n vectors, fitted on the sample x of them: `trees` trees, and more while too few linked pairs of the sample meet."""
    random, spill = np.random.default_rng(seed), spill * math.sqrt((2 - 2 * cosine) / x.shape[1])
    levels = min(LEVELS - 1, math.ceil(math.log2(max(2, n / leaf))) + 4)
    directions, thresholds = np.zeros((0, x.shape[1], levels)), []
    while True:
        more = random.normal(size=(trees if not thresholds else 2, x.shape[1], levels))
        more /= np.linalg.norm(more, axis=1, keepdims=True)
        directions = np.concatenate([directions, more])
        thresholds += [_tree(x @ d, n, spill, leaf) for d in more]
        forest = Forest(directions, thresholds, spill)
        pairs, found = meeting(forest, x[:PROBED], cosine)
        if pairs < LEAST_PAIRS or found >= RECALL * pairs or len(thresholds) + 2 > MOST_TREES:
            return forest


def _compare(table: pa.Table, cosine: float, dimensions: int, kind: type) -> pa.Table:
    """Of one leaf, or of two of its parts: links counted here for each vector, and links that span what is linked."""
    x = scaled(np.frombuffer(b"".join(table["vector"].to_pylist()), kind).reshape(-1, dimensions))
    ids, copies, side, leaf = table["node"].to_numpy(), table["copies"].to_numpy(), table["side"].to_numpy(), table["leaf"][0].as_py()
    order = np.lexsort((ids, side))
    x, ids, copies, side = x[order], ids[order], copies[order], side[order]
    n, m = len(x), int((side == 0).sum())
    near = x @ x.T >= cosine
    np.fill_diagonal(near, False)
    flat = [np.frombuffer(v, np.int32) for v in table["leaves"].take(pa.array(order)).to_pylist()]
    row, numbers = np.repeat(np.arange(n), [len(v) for v in flat]), np.concatenate(flat)
    earlier, column = np.unique(numbers[numbers < leaf], return_inverse=True)
    before = np.zeros((n, max(1, len(earlier))), np.float32)
    before[row[numbers < leaf], column] = 1
    counted = near & (before @ before.T == 0)
    if 0 < m < n:  # two parts: pairs within one of them are met where that part meets itself
        counted[:m, :m] = counted[m:, m:] = False
    links = counted @ copies
    out_a, out_b, left = [], [], np.ones(n, bool)
    for start in range(n):
        queue = [start] if left[start] else []
        left[start] = False
        while queue:
            node = queue.pop()
            found = np.flatnonzero(near[node] & left)
            left[found] = False
            out_a += [ids[node]] * len(found)
            out_b += ids[found].tolist()
            queue += found.tolist()
    some = np.flatnonzero(links)
    return pa.table({
        "a": pa.array([*ids[some].tolist(), *out_a], pa.int64()), "b": pa.array([*[None] * len(some), *out_b], pa.int64()),
        "links": pa.array([*links[some].tolist(), *[0] * len(out_a)], pa.int64()),
    })


def near_duplicates(
    vectors: DataFrame, vector: str = "embedding", key: str = "vec_id", cosine: float = COSINE, trees: int = TREES, spill: float = SPILL, leaf: int = LEAF, sample: int = SAMPLE, dense: int = DENSE
) -> DataFrame:
    """vec_id, n_links, component_id, kept: one row for each row of `vectors`.

    n_links counts the other rows linked directly, exact copies included. Vectors that are
    null, zero, or hold a null or non-finite component link with nothing, and so do those
    that are not of the length most vectors of the sample have. Rows with a null id take
    part; component_id is null only where no row of the component has an id. Repeated rows
    are copies of each other. No rows give no rows; other columns are not looked at.
    """
    one = F.xxhash64("vector")
    slim = vectors.select(F.col(key).cast("bigint").alias("vec_id"), F.col(vector).alias("vector")).withColumn("hash", F.struct(one.alias("x"), F.xxhash64(F.lit(1), "vector").alias("y")))
    usable = F.coalesce(F.forall("vector", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf"))) & F.exists("vector", lambda v: v != 0), F.lit(False))
    nodes = slim.where(usable).groupBy("hash").agg(F.first("vector").alias("vector"), F.min("vec_id").alias("least"), F.count(F.lit(1)).alias("copies"))
    nodes = settle(nodes.withColumn("node", F.coalesce("least", F.col("hash.x"))))
    n = nodes.count()
    taken = nodes.orderBy(F.xxhash64("hash.y"), "node").select("vector").limit(sample).toArrow()["vector"]
    sizes = [len(v) for v in taken.to_pylist()]
    dimensions = max(set(sizes), key=lambda s: (sizes.count(s), s)) if sizes else 1
    forest = grow(unit(taken, dimensions)[0], n, cosine, trees, spill, leaf)
    kind = np.float32 if vectors.schema[vector].dataType.elementType.typeName() == "float" else np.float64

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, fits = unit(batch.column("vector"), dimensions)
            batch = batch.filter(pa.array(fits))
            numbers: list[list[int]] = [[] for _ in range(len(x))]
            for number, rows in forest.leaves(x):
                for i in rows.tolist():
                    numbers[i].append(number)
            own = [np.array(v, kind).tobytes() for v in batch.column("vector").to_pylist()]
            packed = [np.array(v, np.int32).tobytes() for v in numbers]
            yield pa.record_batch({"node": batch.column("node"), "copies": batch.column("copies"), "vector": pa.array(own, pa.binary()), "within": pa.array(numbers, pa.list_(pa.int32())), "leaves": pa.array(packed, pa.binary())})

    placed = settle(nodes.select("node", "copies", "vector").mapInArrow(place, "node bigint, copies bigint, vector binary, within array<int>, leaves binary"))
    crowded = placed.select(F.explode("within").alias("leaf")).groupBy("leaf").count().select("leaf", F.ceil(F.col("count") / dense).cast("int").alias("parts")).where("parts > 1")
    dealt = placed.withColumn("leaf", F.explode("within")).join(crowded, "leaf", "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    own = F.pmod(F.xxhash64("node"), F.col("parts")).cast("int")
    pair = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda p: F.struct((F.least(p, own) * F.col("parts") + F.greatest(p, own)).alias("part"), (own > p).cast("int").alias("side")))
    dealt = dealt.select("leaf", "node", "copies", "vector", "leaves", F.explode(pair).alias("p")).select("leaf", "p.part", "p.side", "node", "copies", "vector", "leaves")
    met = settle(dealt.groupBy("leaf", "part").applyInArrow(lambda t: _compare(t, cosine, dimensions, kind), "a bigint, b bigint, links bigint"))

    counts = met.where("b IS NULL").groupBy(F.col("a").alias("node")).agg(F.sum("links").alias("links"))
    reached = components(met.where("b IS NOT NULL"), "a", "b")
    rooted = nodes.select("hash", "node", "least", "copies").join(reached, "node", "left").withColumn("root", F.coalesce("component", "node")).join(counts, "node", "left")
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    verdict = rooted.join(least, "root").select("hash", "component_id", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    found = slim.withColumn("usable", usable).join(verdict, "hash", "left")
    alone = ~F.col("usable")
    return found.select(
        "vec_id", F.when(alone, 0).otherwise(F.col("n_links")).cast("bigint").alias("n_links"), F.when(alone, F.col("vec_id")).otherwise(F.col("component_id")).alias("component_id")
    ).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
