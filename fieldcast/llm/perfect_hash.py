"""Exact deduplication against history by a minimal perfect hash over distinct digests.

Texts are equal when they are identical without their ASCII white space. The digests of
history are dealt to shards by their own bits; each shard is one index row: the levels of a
minimal perfect hash and, by slot, the full digest, the copies seen and the locator of the
winner. A new digest is hashed to its slot and compared with all 32 bytes there: equal
makes it a repeat, anything else puts it among the nonmembers, which form own groups.

Digests are counted before they are dealt out, so a text with a third of all rows reaches
its shard once per task, and shards hold a bounded number of digests at every size.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldcast.llm.rows import SPACE, whole
from fieldcast.session import settle

#: Digests a shard is sized for, and the free places a level offers for each of its digests.
SHARD_DIGESTS = 20_000
ROOM = 2

INDEX = "shard int, sizes array<bigint>, bits binary, digests binary, chars array<bigint>, ids array<bigint>, copies array<bigint>"
GROUPS = "digest binary, keep_id bigint, group_size bigint, member boolean"


def digest(text: str) -> Column:
    """SHA-256 of a text without its white space."""
    return F.unhex(F.sha2(F.regexp_replace(whole(text), SPACE + "+", ""), 256))


def fingerprints(docs: DataFrame, is_history: Column, text: str = "text", key: str = "doc_id") -> DataFrame:
    """doc_id, digest of the text without white space, code points of the original text, whether it is history."""
    return docs.select(
        F.col(key).cast("bigint").alias("doc_id"), digest(text).alias("digest"), F.char_length(whole(text)).cast("bigint").alias("chars"),
        F.coalesce(is_history, F.lit(False)).alias("past"),
    )


def _places(digests: np.ndarray, level: int, size: int) -> np.ndarray:
    """Where each digest (four 64-bit words) falls among `size` places of a level."""
    mixed = np.full(len(digests), (0x9E3779B97F4A7C15 * (level + 1)) & (2**64 - 1), np.uint64)
    for word in range(4):
        mixed = (mixed ^ digests[:, word]) * np.uint64(0xBF58476D1CE4E5B9)
        mixed ^= mixed >> np.uint64(29)
    return (mixed % np.uint64(size)).astype(np.int64)


def build(digests: np.ndarray) -> tuple[list[int], np.ndarray]:
    """Level sizes and all levels' bits of a minimal perfect hash over distinct digests (n x 4 words).

    A digest alone at its place sets the bit there; those that meet go on to the next level.
    """
    sizes, levels = [], []
    while len(digests):
        size = ROOM * len(digests) + 1
        at = _places(digests, len(sizes), size)
        alone = np.bincount(at, minlength=size) == 1
        sizes.append(size)
        levels.append(alone)
        digests = digests[~alone[at]]
    return sizes, np.concatenate(levels) if levels else np.zeros(0, bool)


def slots(digests: np.ndarray, sizes: list[int], bits: np.ndarray) -> np.ndarray:
    """The slot of each digest: how many bits are set before its own; -1 where no level has its bit."""
    rank = np.cumsum(bits) - 1
    out, open_, base = np.full(len(digests), -1, np.int64), np.arange(len(digests)), 0
    for level, size in enumerate(sizes):
        at = base + _places(digests[open_], level, size)
        found = bits[at]
        out[open_[found]] = rank[at[found]]
        open_, base = open_[~found], base + size
    return out


def _words(column: pa.ChunkedArray | bytes) -> np.ndarray:
    flat = column if isinstance(column, bytes) else b"".join(column.to_pylist())
    return np.frombuffer(flat, np.uint64).reshape(-1, 4)


def _index(table: pa.Table) -> pa.Table:
    """One index row from the distinct digests of a shard."""
    digests = _words(table["digest"])
    sizes, bits = build(digests)
    order = np.argsort(slots(digests, sizes, bits))
    table = table.take(order)
    return pa.table({
        "shard": pa.array(table["shard"].to_pylist()[:1], pa.int32()), "sizes": pa.array([sizes], pa.list_(pa.int64())),
        "bits": pa.array([np.packbits(bits).tobytes()], pa.binary()), "digests": pa.array([digests[order].tobytes()], pa.binary()),
        "chars": pa.array([table["chars"].to_pylist()], pa.list_(pa.int64())), "ids": pa.array([table["id"].to_pylist()], pa.list_(pa.int64())),
        "copies": pa.array([table["copies"].to_pylist()], pa.list_(pa.int64())),
    })


def _better(a: tuple[int, int | None], b: tuple[int, int | None]) -> bool:
    """Whether the winner (code points, id) a stays before b: longer, then smaller id, null last."""
    return (-a[0], a[1] is None, a[1] or 0) < (-b[0], b[1] is None, b[1] or 0)


def _look_up(arrivals: pa.Table, index: pa.Table) -> pa.Table:
    """All groups of a shard: history's with the repeats counted in, then the nonmembers."""
    keep, size, member, digests, history = [], [], [], [], b""
    if index.num_rows:
        row = index.to_pylist()[0]
        history = row["digests"]
        keep, size = list(zip(row["chars"], row["ids"])), list(row["copies"])
        digests, member = [history[i : i + 32] for i in range(0, len(history), 32)], [True] * len(keep)
        bits = np.unpackbits(np.frombuffer(row["bits"], np.uint8), count=sum(row["sizes"])).astype(bool)
    if arrivals.num_rows:
        own = arrivals["digest"].to_pylist()
        at = slots(_words(arrivals["digest"]), row["sizes"], bits) if history else [-1] * len(own)
        for digest, slot, chars, id_, copies in zip(own, at, *(arrivals[c].to_pylist() for c in ("chars", "id", "copies"))):
            if slot >= 0 and history[32 * slot : 32 * slot + 32] == digest:
                size[slot] += copies
                if _better((chars, id_), keep[slot]):
                    keep[slot] = (chars, id_)
            else:
                digests.append(digest), keep.append((chars, id_)), size.append(copies), member.append(False)
    return pa.table({"digest": pa.array(digests, pa.binary()), "keep_id": pa.array([x[1] for x in keep], pa.int64()), "group_size": pa.array(size, pa.int64()), "member": pa.array(member, pa.bool_())})


def _shards(counted: DataFrame, n: int) -> DataFrame:
    return counted.withColumn("shard", F.pmod(F.xxhash64("digest"), F.lit(n)).cast("int"))


def build_index(history: DataFrame, n_shards: int) -> DataFrame:
    """One index row for each shard of distinct digests (digest, chars, id, copies)."""
    return _shards(history, n_shards).groupBy("shard").applyInArrow(_index, INDEX)


def look_up(arrivals: DataFrame, index: DataFrame, n_shards: int) -> DataFrame:
    """digest, keep_id, group_size, member (history knows the digest), one row for each distinct digest."""
    return _shards(arrivals, n_shards).groupBy("shard").cogroup(index.groupBy("shard")).applyInArrow(_look_up, GROUPS)


def exact_dedup(docs: DataFrame, is_history: Column, text: str = "text", key: str = "doc_id", shard_digests: int = SHARD_DIGESTS) -> DataFrame:
    """doc_id, keep_id, group_size, kept, digest, member: one row for each row of `docs`.

    `is_history` marks the rows that are indexed; the others are looked up. The longest
    original text of a group stays, then the smallest id. The result does not depend on the
    split into history and arrivals.

    A null text is empty, and all empty texts are one group. A null id counts as the largest
    and is kept only where no copy has an id. A row that occurs twice with one id counts
    twice in group_size, and both rows get the same verdict. No rows give no rows; columns
    other than the two named are not looked at.
    """
    prints = settle(fingerprints(docs, is_history, text, key))
    best = F.min(F.struct((-F.col("chars")).alias("c"), F.col("doc_id").isNull().alias("n"), F.col("doc_id").alias("d")))
    counted = settle(
        prints.groupBy("past", "digest").agg(best.alias("b"), F.count(F.lit(1)).alias("copies"))
        .select("past", "digest", (-F.col("b.c")).alias("chars"), F.col("b.d").alias("id"), "copies")
    )
    n = max(1, math.ceil(counted.count() / shard_digests))
    index = settle(build_index(counted.where("past").drop("past"), n))
    groups = look_up(counted.where("NOT past").drop("past"), index, n)
    return prints.join(groups, "digest").select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "digest", "member")
