"""Near-duplicates by the exact Jaccard similarity of word shingles; SimHash blocks and MinHash bands choose what is compared.

A text is the set of hashes of its word shingles. Texts whose SimHash fingerprints link (`simhash.links`)
are candidates. At similarity 0.8 fingerprints differ in some ten bits and seldom link, so those that
they lose are chosen by a second way: a text's MinHash values are cut into bands, and
texts that agree in a band are candidates: with 24 bands of 5 values a pair at similarity 0.8
meets in one with a chance of 0.9999, and at 0.9 or more practically always. Each band hangs
its texts on one of them, so candidates are stars, never pairs, and their components are the
blocks outside of which nothing can be linked.

Each candidate travels once to its block, where an index of the rarest shingles brings sets
together, all their shared shingles are counted and only exact similarities of at least `similarity` are links. Links are found by
walking from text to text, so a spanning forest of them leaves the task. A block of more than
`mass` shingles is dealt to tasks as pairs of its parts. Texts of one set are one node.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldcast.llm import simhash
from fieldcast.llm.components import components
from fieldcast.llm.rows import utf8
from fieldcast.session import settle

SHINGLE, SIMILARITY, BANDS, VALUES, SEED, MASS = 5, 0.8, 24, 5, 42, 1 << 20
#: Shingles whose MinHash values are worked out at once.
SLICE = 1 << 12


def shingles(text: bytes, shingle: int = SHINGLE, seed: int = SEED) -> np.ndarray:
    """The different hashes of a text's word shingles, sorted; a shorter text is one shingle, a wordless one has none."""
    return np.unique(simhash.hashes(text, shingle, seed))


def _mixers(n: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    random = np.random.default_rng(seed)
    return random.integers(0, 1 << 64, n, np.uint64) | np.uint64(1), random.integers(0, 1 << 64, n, np.uint64)


def band_keys(hashes: np.ndarray, factors: np.ndarray, terms: np.ndarray, bands: int) -> np.ndarray:
    """One key for each band; sets without a shingle share all of them."""
    least = np.full(len(factors), ~np.uint64(0))
    for i in range(0, len(hashes), SLICE):
        least = np.minimum(least, (hashes[i : i + SLICE, None] * factors + terms).min(0))
    rows = least.reshape(bands, -1)
    return np.array([xxhash.xxh64_intdigest(rows[k].tobytes(), k) for k in range(bands)], np.uint64).view(np.int64)


def _linked(sets: list[np.ndarray], similarity: float) -> Iterator[tuple[int, np.ndarray]]:
    """Links that connect whatever is connected: a set, and those not yet reached that are similar to it.

    Two similar sets share one of the rarest shingles of both, as many as may be missing and
    one more; only those are indexed. Sets that meet there and are not yet reached are counted out.
    """
    share = Fraction(str(similarity))
    sizes = np.array([len(s) for s in sets], np.int64)
    owner, edges = np.repeat(np.arange(len(sets)), sizes), np.concatenate([[0], np.cumsum(sizes)])
    values, code, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    rank = np.empty(len(values), np.int64)
    rank[np.argsort(count, kind="stable")] = np.arange(len(values))
    code = rank[code][np.lexsort((rank[code], owner))]
    rarest = sizes - -(-sizes * share.numerator // share.denominator) + 1
    rare = np.arange(len(code)) - edges[owner] < rarest[owner]
    left, mark, none = np.ones(len(sets), bool), np.zeros(len(values), bool), np.flatnonzero(sizes == 0)

    def index() -> tuple[np.ndarray, np.ndarray]:
        live = np.flatnonzero(rare & left[owner])
        live = live[np.argsort(code[live], kind="stable")]
        return owner[live], np.searchsorted(code[live], np.arange(len(values) + 1))

    if len(none) > 1:
        yield none[0], none[1:]
    left[none] = False
    (holders, first), indexed, remain = index(), len(sets), int(left.sum())
    for start in range(len(sets)):
        queue = [start] if left[start] else []
        remain -= int(left[start])
        left[start] = False
        while queue and remain:
            if 2 * remain < indexed:
                (holders, first), indexed = index(), remain
            node = queue.pop()
            own = code[edges[node] : edges[node + 1]]
            met = [holders[first[c] : first[c + 1]] for c in own[: rarest[node]].tolist()]
            met = np.unique(np.concatenate(met))
            met = met[left[met] & (sizes[met] * share.denominator >= sizes[node] * share.numerator) & (sizes[node] * share.denominator >= sizes[met] * share.numerator)]
            if not len(met):
                continue
            mark[own] = True
            many = sizes[met]
            ends = np.cumsum(many)
            at = np.repeat(edges[met] - ends + many, many) + np.arange(ends[-1])
            shared = np.add.reduceat(mark[code[at]].astype(np.int64), ends - many)
            mark[own] = False
            found = met[shared * share.denominator >= (many + sizes[node] - shared) * share.numerator]
            left[found] = False
            remain -= len(found)
            if len(found):
                yield node, found
                queue.extend(found.tolist())


def near_duplicates(
    docs: DataFrame, text: str = "text", key: str = "doc_id", shingle: int = SHINGLE, similarity: float = SIMILARITY, bands: int = BANDS, values: int = VALUES, seed: int = SEED, mass: int = MASS, bits: int = simhash.BITS, blocks: int = simhash.BLOCKS
) -> DataFrame:
    """doc_id, component_id: the smallest doc_id reachable over links of at least `similarity`; row, component: numbers of the row's id and text and of its component.

    Null and wordless texts are alike. A row with a null id takes part; component_id is null
    only where no row of the component has an id. Repeated rows each get their row. No rows
    give no rows; other columns are not looked at.
    """
    slim = docs.select(F.col(key).cast("bigint").alias("doc_id"), F.col(text).cast("string").alias("text")).withColumn("row", F.xxhash64("doc_id", "text"))
    factors, terms = _mixers(bands * values, seed)

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nodes, sizes, keys, prints = [], [], [], []
            for value in utf8(batch.column("text")):
                every = simhash.hashes(value, shingle, seed)
                own = np.unique(every)
                prints.append(simhash.majority(every))
                nodes.append(xxhash.xxh64_intdigest(own.tobytes(), seed))
                sizes.append(len(own))
                keys.append(band_keys(own, factors, terms, bands))
            flat = pa.array(np.concatenate(keys) if keys else np.zeros(0, np.int64))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(keys) + 1) * bands, pa.int32()), flat)
            yield pa.record_batch({"doc_id": batch.column("doc_id"), "row": batch.column("row"), "node": pa.array(np.array(nodes, np.uint64).view(np.int64)), "size": pa.array(sizes, pa.int64()), "print": pa.array(np.array(prints, np.uint64).view(np.int64)), "keys": lists})

    sketched = settle(slim.mapInArrow(sketch, "doc_id bigint, row bigint, node bigint, size bigint, print bigint, keys array<bigint>"))
    nodes = settle(sketched.groupBy("node").agg(F.min("doc_id").alias("least"), F.min("row").alias("row"), F.first("size").alias("size")))
    keyed = sketched.select("node", F.explode("keys").alias("key"))
    heads = keyed.groupBy("key").agg(F.min("node").alias("head"), F.max("node").alias("last")).where("head < last").select("key", "head")
    banded = keyed.join(heads, "key").where("node != head").select("node", "head")
    # Texts of one fingerprint hang on one of them, and such heads on each other where their fingerprints link.
    printed = settle(sketched.groupBy("print").agg(F.min("node").alias("head")))
    alike = sketched.select("node", "print").join(printed, "print").where("node != head").select("node", "head")
    ends = [printed.select(F.col("print").alias(side), F.col("head").alias(name)) for side, name in (("a", "node"), ("b", "head"))]
    close = simhash.links(printed.select("print"), bits, blocks).join(ends[0], "a").join(ends[1], "b").where("node != head").select("node", "head")
    reached = settle(components(banded.union(alike).union(close), "node", "head").withColumnRenamed("component", "block"))

    placed = nodes.join(reached, "node").select("row", "node", "block", "size")
    crowded = placed.groupBy("block").agg(F.ceil(F.sum("size") / mass).cast("int").alias("parts")).where("parts > 1")
    placed = placed.join(crowded, "block", "left").select("row", "node", "block", F.coalesce("parts", F.lit(1)).alias("parts"))
    own = F.pmod(F.xxhash64("node"), F.col("parts")).cast("int")
    pair = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda p: F.least(p, own) * F.col("parts") + F.greatest(p, own))
    dealt = slim.select("row", "text").join(placed, "row").select("block", "node", "text", F.explode(pair).alias("part"))

    def compare(table: pa.Table) -> pa.Table:
        ids, at = np.unique(table["node"].to_numpy(), return_index=True)
        texts = list(utf8(table["text"].take(pa.array(at))))
        out_a, out_b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for node, found in _linked([shingles(x, shingle, seed) for x in texts], similarity):
            out_a.append(np.full(len(found), ids[node]))
            out_b.append(ids[found])
        return pa.table({"a": pa.array(np.concatenate(out_a)), "b": pa.array(np.concatenate(out_b))})

    links = dealt.groupBy("block", "part").applyInArrow(compare, "a bigint, b bigint")
    rooted = nodes.join(components(links, "a", "b"), "node", "left").select("node", "least", F.coalesce("component", "node").alias("root"))
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    return sketched.select("doc_id", "node", "row").join(rooted.join(least, "root").select("node", "component_id", F.col("root").alias("component")), "node").drop("node")
