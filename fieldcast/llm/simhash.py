"""Near-duplicates by SimHash: pigeonhole blocks bring close fingerprints together, Hamming distance decides.

A fingerprint is cut into `blocks` blocks. Two that differ in at most `bits` bits agree in
at least blocks - bits of them, so they meet under at least one choice of that many blocks;
a key is a choice and the bits it covers. With 7 blocks and 4 bits a key covers 27 bits, so
unrelated fingerprints seldom meet at any size of the corpus the default is meant for; more
blocks cover more bits at more keys.

Copies share a fingerprint and are one node. Within a key, links are found by walking from
node to node and only a spanning forest of them leaves the task, never all pairs. A key of
more than `dense` nodes is dealt to tasks as pairs of its parts, so no task holds it whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldcast.llm.components import components
from fieldcast.llm.rows import utf8
from fieldcast.session import settle

SHINGLE, SEED, BITS, BLOCKS, DENSE = 4, 42, 4, 7, 4096
#: Shingles whose bits are counted at once.
SLICE = 1 << 15


def hashes(text: bytes, shingle: int = SHINGLE, seed: int = SEED) -> np.ndarray:
    """The hashes of a text's word shingles in order, repeats included; a shorter text is one shingle, a wordless one has none."""
    words = text.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    joined, n = b" ".join(words), max(1, len(words) - shingle + 1)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts, stops = [0, *ends[: n - 1].tolist()], (ends - 1)[min(shingle, len(words)) - 1 :].tolist()
    one = xxhash.xxh64_intdigest
    return np.fromiter((one(joined[a:b], seed) for a, b in zip(starts, stops)), np.uint64, n)


def majority(hashes: np.ndarray) -> int:
    """A bit is set where it is set in over half the hashes."""
    set_ = np.zeros(64, np.int64)
    for i in range(0, len(hashes), SLICE):
        set_ += np.unpackbits(hashes[i : i + SLICE].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(set_ * 2 > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprint(text: bytes, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """The SimHash of a text's word shingles."""
    return majority(hashes(text, shingle, seed))


def fingerprints(docs: DataFrame, text: str = "text", key: str = "doc_id", shingle: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """doc_id, print: one row for each row of `docs`; a null text is empty, and a text without words has print zero."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = np.fromiter((fingerprint(x, shingle, seed) for x in utf8(batch.column("text"))), np.uint64, batch.num_rows)
            yield pa.record_batch({"doc_id": batch.column("doc_id"), "print": pa.array(prints.view(np.int64))})

    return docs.select(F.col(key).cast("bigint").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(run, "doc_id bigint, print bigint")


def masks(blocks: int, bits: int) -> list[int]:
    """The bits that each choice of blocks - bits blocks covers."""
    edges = [64 * i // blocks for i in range(blocks + 1)]
    each = [((1 << edges[i + 1]) - 1) ^ ((1 << edges[i]) - 1) for i in range(blocks)]
    return [sum(some) for some in combinations(each, blocks - bits)]


def _forest(prints: np.ndarray, bits: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Links that connect whatever is connected among some distinct prints: from each reached node to those not yet reached."""
    left = np.sort(prints)
    while len(left) > 1:
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            node = queue.pop()
            near = np.bitwise_count(left ^ node) <= bits
            if near.any():
                found, left = left[near], left[~near]
                yield np.full(len(found), node), found
                queue.extend(found)


def links(prints: DataFrame, bits: int = BITS, blocks: int = BLOCKS, dense: int = DENSE) -> DataFrame:
    """a, b: pairs of distinct values of `print` at most `bits` bits apart that connect all that such pairs connect."""
    signed = [m - (1 << 64) if m >> 63 else m for m in masks(blocks, bits)]
    keys = F.posexplode(F.array(*[F.col("print").bitwiseAND(F.lit(m).cast("bigint")) for m in signed])).alias("choice", "key")
    keyed = prints.select("print", keys)
    crowded = keyed.groupBy("choice", "key").count().where(F.col("count") > dense).select("choice", "key", F.ceil(F.col("count") / dense).cast("int").alias("parts"))
    dealt = keyed.join(crowded, ["choice", "key"], "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    own = F.pmod(F.xxhash64("print"), F.col("parts")).cast("int")
    pair = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda x: F.least(x, own) * F.col("parts") + F.greatest(x, own))
    dealt = dealt.select("choice", "key", "print", F.explode(pair).alias("part"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = np.zeros((0, 4), np.int64)
        for batch in batches:
            now = np.column_stack([batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("choice", "key", "part", "print")])
            now = np.concatenate([rest, now])
            cut = np.flatnonzero((now[1:, :3] != now[:-1, :3]).any(1)) + 1
            last = cut[-1] if len(cut) else 0
            rest = now[last:]
            yield from out(now[:last])
        yield from out(rest)

    def out(rows: np.ndarray) -> Iterator[pa.RecordBatch]:
        if len(rows) < 2:
            return
        starts = np.concatenate([[0], np.flatnonzero((rows[1:, :3] != rows[:-1, :3]).any(1)) + 1, [len(rows)]])
        sizes, prints = np.diff(starts), np.ascontiguousarray(rows[:, 3]).view(np.uint64)
        two = starts[:-1][sizes == 2]
        near = two[np.bitwise_count(prints[two] ^ prints[two + 1]) <= bits]
        found = [(prints[near], prints[near + 1])]
        for i in np.flatnonzero(sizes > 2):
            found.extend(_forest(prints[starts[i] : starts[i + 1]], bits))
        a, b = (np.concatenate([x[i] for x in found]).astype(np.uint64).view(np.int64) for i in (0, 1))
        if len(a):
            yield pa.record_batch({"a": pa.array(a), "b": pa.array(b)})

    group = ["choice", "key", "part"]
    return dealt.repartition(*group).sortWithinPartitions(*group).mapInArrow(run, "a bigint, b bigint")


def near_duplicates(docs: DataFrame, text: str = "text", key: str = "doc_id", bits: int = BITS, blocks: int = BLOCKS) -> DataFrame:
    """doc_id, print, component_id: the smallest doc_id reachable over links of at most `bits` differing bits.

    Null and wordless texts have print zero and are linked like any other. A row with a null
    id takes part; component_id is null only where no row of the component has an id. Repeated
    rows each get their row. No rows give no rows; other columns are not looked at.
    """
    prints = settle(fingerprints(docs, text, key))
    nodes = settle(prints.groupBy("print").agg(F.min("doc_id").alias("least")))
    reached = components(links(nodes.select("print"), bits, blocks), "a", "b")
    rooted = nodes.join(reached, nodes["print"] == reached["node"], "left").select("print", "least", F.coalesce("component", "print").alias("root"))
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    return prints.join(rooted.join(least, "root").select("print", "component_id"), "print").select("doc_id", "print", "component_id")
