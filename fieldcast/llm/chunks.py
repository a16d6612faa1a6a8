"""Rounds of questions between chunks of text and shards of a key space.

Some operators have one key for every byte or word: too many for one row each. Here texts
are dealt to chunks of a bounded number of bytes. A chunk works out its keys with numpy,
sorts them and drops its repeats, and sends each shard of the key space one row with the
keys that fall there. The shard answers all chunks in one row each, the answers in the
order of the keys, and the chunk takes up the next round with all answers it has had so far.

A key that a third of all texts have reaches its shard once for each chunk, whatever its
count. All rounds can be one lazy plan: texts and the answers of each round are shuffled to
their chunks once, and later rounds reuse those exchanges; a lost executor costs what Spark
recomputes of it. With many rounds, what they need of the texts and the answers are better written
as they come (`written`, `settle`): the questions of a round then leave the disks before the next
one asks, and texts are not read again.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldcast.llm.rows import buffers, whole
from fieldcast.session import settle

CHUNK_BYTES = 4 << 20
#: Bytes of text whose keys one shard is sized for.
SHARD_BYTES = 16 << 20

#: Bytes of text whose words are hashed at a time.
HASH_BYTES = 1 << 17

#: step and kind of question, shard, chunk, sorted keys, what goes with each of them.
ROWS = "step int, kind int, shard bigint, chunk bigint, keys binary, load binary, note binary"
_SCHEMA = pa.schema([("step", pa.int32()), ("kind", pa.int32()), ("shard", pa.int64()), ("chunk", pa.int64()), ("keys", pa.binary()), ("load", pa.binary()), ("note", pa.binary())])

#: A question: its kind, sorted distinct keys, an array that goes with them.
Question = tuple[int, np.ndarray, np.ndarray]


def chunked(docs: DataFrame, text: str = "text", key: str = "doc_id", chunk_bytes: int = CHUNK_BYTES, extra: dict[str, Column] | None = None) -> tuple[DataFrame, int]:
    """A row for each chunk with bundles of its rows (doc_id, text with null as empty, extra columns); how many high bits of a key name its shard."""
    extra = extra or {}
    slim = docs.select(F.col(key).cast("bigint").alias("doc_id"), whole(text).alias("text"), *(v.alias(k) for k, v in extra.items()))
    size = slim.agg(F.sum(F.octet_length("text") + F.lit(8))).first()[0] or 0
    n = max(1, math.ceil(size / chunk_bytes))
    chunk = F.pmod(F.xxhash64("doc_id", F.octet_length("text"), F.substring("text", 1, 64)), F.lit(n)).alias("chunk")
    def bundle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """One row for each chunk in a batch of texts: what goes there, compressed."""
        options = pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", 3))
        for batch in batches:
            of = batch.column("chunk").to_numpy()
            order = np.argsort(of, kind="stable")
            names, starts = np.unique(of[order], return_index=True)
            rows = pa.table(batch.drop_columns(["chunk"])).take(pa.array(order)).combine_chunks()
            bundles = []
            for first, end in zip(starts.tolist(), [*starts[1:].tolist(), len(order)]):
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, rows.schema, options=options) as writer:
                    # Taken, not sliced: a slice would bring all bytes of the batch along.
                    writer.write_table(rows.take(pa.array(np.arange(first, end))))
                bundles.append(sink.getvalue().to_pybytes())
            yield pa.record_batch({"chunk": pa.array(names, pa.int64()), "texts": pa.array(bundles, pa.binary())})

    dealt = slim.select(chunk, "doc_id", "text", *extra).mapInArrow(bundle, "chunk bigint, texts binary")
    return dealt.groupBy("chunk").agg(F.collect_list("texts").alias("texts")), max(0, math.ceil(math.log2(max(1, size / SHARD_BYTES))))


class Texts:
    """The texts of a chunk in order of (doc_id, text), null ids last: all their bytes, and where each text starts."""

    def __init__(self, table: pa.Table):
        self.chunk = table["chunk"][0].as_py()
        table = pa.concat_tables([pa.ipc.open_stream(b.as_buffer()).read_all() for b in table["texts"][0].values]).combine_chunks()
        ids = table["doc_id"].to_numpy(zero_copy_only=False) if not table["doc_id"].null_count else table["doc_id"].fill_null(np.iinfo(np.int64).max).to_numpy()
        order = np.argsort(ids, kind="stable")
        if len(ids) > len(np.unique(ids)):
            order = np.array(sorted(range(len(ids)), key=lambda i: (ids[i], table["text"][i].as_py())), np.int64)
        table = table.take(order)
        self.ids, self.keys = table["doc_id"], ids[order].astype(np.int64)
        self.bytes, self.at = buffers(table["text"])
        self.extra = {name: table[name] for name in table.column_names if name not in ("doc_id", "text")}


def cut(keys: np.ndarray, bits: int, width: int = 8) -> np.ndarray:
    """Keys without the low bits that do not travel: the shard's bits and `width` bytes do."""
    low = 64 - bits - 8 * width
    return keys if low <= 0 else (keys >> np.uint64(low)) << np.uint64(low)


def pack(rows: np.ndarray) -> bytes:
    """An array with all first bytes of its entries in front, then all second bytes, and so on, compressed.

    Sorted keys and small counts have planes that hardly change.
    """
    planes = np.ascontiguousarray(np.ascontiguousarray(rows).view(np.uint8).reshape(len(rows), -1).T) if len(rows) else rows
    return zstandard.ZstdCompressor(level=1).compress(planes.data if len(rows) else b"")


def unpack(data: bytes, width: int) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    return np.ascontiguousarray(planes.reshape(width, -1).T)


def _loads(rows: list[bytes], kind: np.dtype | type) -> np.ndarray:
    kind = np.dtype(kind)
    return np.concatenate([unpack(r, kind.itemsize) for r in rows]).view(kind).ravel() if rows else np.zeros(0, kind)


def written(chunks: DataFrame, work: Callable[[Texts], dict[str, np.ndarray]], kinds: dict[str, np.dtype]) -> DataFrame:
    """A row for each chunk with the arrays, named in `kinds`, that `work` makes of its texts; written once, for rounds that are queries of their own."""

    def run(own: pa.Table) -> pa.Table:
        here = Texts(own)
        made = work(here)
        return pa.table({"chunk": pa.array([here.chunk], pa.int64())} | {k: pa.array([pack(made[k].astype(kind))], pa.binary()) for k, kind in kinds.items()})

    return settle(chunks.groupBy("chunk").applyInArrow(run, "chunk bigint, " + ", ".join(f"{k} binary" for k in kinds)))


class Written:
    """The arrays of a chunk as `written` wrote them."""

    def __init__(self, table: pa.Table, kinds: dict[str, np.dtype]):
        self.chunk = table["chunk"][0].as_py()
        self.arrays = {k: _loads([table[k][0].as_py()], kind) for k, kind in kinds.items()}


def _send(step: int, chunk: int, kind: int, keys: np.ndarray, load: np.ndarray, bits: int, width: int, everywhere: bool) -> Iterator[tuple]:
    of = (keys >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(keys), np.int64)
    own = np.ascontiguousarray(((keys << np.uint64(bits)) if width < 8 else keys) >> np.uint64(64 - 8 * width))
    own = own.view(np.uint8).reshape(-1, 8)[:, :width]
    starts = np.searchsorted(of, np.arange((1 << bits) + 1))
    for shard, (a, b) in enumerate(zip(starts[:-1].tolist(), starts[1:].tolist())):
        if b > a or everywhere:
            yield step, kind, (kind << 32) + shard, chunk, pack(own[a:b]), pack(load[a:b]), None


def _table(rows: list[tuple]) -> pa.Table:
    columns = list(zip(*rows)) if rows else [()] * len(_SCHEMA)
    return pa.table([pa.array(c, f.type) for c, f in zip(columns, _SCHEMA)], schema=_SCHEMA)


class Said:
    """The answers a chunk has had: by step and kind, in the order of the keys it asked about."""

    def __init__(self, table: pa.Table):
        rows = [r for name in table.column_names if name.startswith("said_") for r in table[name][0].as_py() or ()]
        self.rows = sorted((tuple(r[c] for c in ("step", "kind", "shard", "load", "note")) for r in rows), key=lambda r: r[:3])

    def of(self, step: int, kind: int, kind_of: np.dtype | type) -> np.ndarray:
        return _loads([r[3] for r in self.rows if r[:2] == (step, kind)], kind_of)

    def notes(self, step: int, kind_of: np.dtype | type) -> np.ndarray:
        return np.array([np.frombuffer(r[4], kind_of) for r in self.rows if r[0] == step and r[4]])


def _beside(chunks: DataFrame, before: list[DataFrame]) -> DataFrame:
    """Chunks with the answers to each step so far. Texts and answers lie by chunk already, so nothing is shuffled for the join."""
    for k, said in enumerate(before):
        chunks = chunks.join(said.select("chunk", F.col("said").alias(f"said_{k}")).hint("merge"), "chunk", "left")
    return chunks


def ask(chunks: DataFrame, before: list[DataFrame], step: int, questions: Callable[..., list[Question]], bits: int, width: int = 8, everywhere: bool = False, read: Callable[[pa.Table], Texts | Written] = Texts) -> DataFrame:
    """What every chunk asks in this step, knowing the answers it has had. questions(what `read` makes of its row, Said)."""

    def rows(own: pa.Table) -> pa.Table:
        here = read(own)
        return _table([row for kind, keys, load in questions(here, Said(own)) for row in _send(step, here.chunk, kind, keys, load, bits, width, everywhere)])

    return _beside(chunks, before).groupBy("chunk").applyInArrow(rows, ROWS)


def answer(asked: DataFrame, decide: Callable[..., np.ndarray | tuple[np.ndarray, np.ndarray]], bits: int, load: dict[int, np.dtype | type], width: int = 8) -> DataFrame:
    """The answers to all questions, by chunk. For a shard, decide(kind, keys, load, chunk of each entry) gives one for each entry.

    A pair (answers, note) also sends a note, such as the shard's totals, to every chunk that asked there.
    """

    def run(table: pa.Table) -> pa.Table:
        rows = sorted(zip(*(table[c].to_pylist() for c in _SCHEMA.names)), key=lambda r: (r[3], r[0], r[1]))  # in one order whatever arrives first
        kind, shard = rows[0][1], rows[0][2] & 0xFFFFFFFF
        own = [unpack(r[4], width) for r in rows]
        sizes = [len(x) for x in own]
        raw = np.zeros((sum(sizes), 8), np.uint8)
        raw[:, :width] = np.concatenate(own)
        keys, entries = raw.view(np.uint64).ravel(), _loads([r[5] for r in rows], load[kind])
        found = decide(kind, keys, entries, np.repeat(np.array([r[3] for r in rows], np.int64), sizes))
        found, note = found if isinstance(found, tuple) else (found, None)
        ends = np.cumsum(sizes)
        return _table([(r[0], kind, shard, r[3], None, pack(found[e - n : e]), note.tobytes() if note is not None else None) for r, n, e in zip(rows, sizes, ends.tolist())])

    found = asked.groupBy("shard").applyInArrow(run, ROWS)
    return found.groupBy("chunk").agg(F.collect_list(F.struct("step", "kind", "shard", "load", "note")).alias("said"))


def finish(chunks: DataFrame, before: list[DataFrame], result: Callable[..., pa.Table], schema: str, read: Callable[[pa.Table], Texts | Written] = Texts) -> DataFrame:
    """The rows that every chunk makes of its texts, or of what `read` makes of its row, and all answers."""

    def run(own: pa.Table) -> pa.Table:
        return result(read(own), Said(own))

    return _beside(chunks, before).groupBy("chunk").applyInArrow(run, schema)


def order(keys: np.ndarray) -> np.ndarray:
    """The stable order of 64-bit keys.

    Numbers are sorted several times faster than places, so the leading bits in which keys differ are sorted with each
    place behind them. Keys that differ only in what was cut off may come out in the wrong order; then places are sorted.
    """
    if len(keys) < 2:
        return np.arange(len(keys))
    low = (len(keys) - 1).bit_length()
    same = 64 - (int(keys.min()) ^ int(keys.max())).bit_length()
    if same == 64:
        return np.arange(len(keys))
    cut, behind = np.uint64(low), np.arange(len(keys), dtype=np.uint64)
    behind |= ((keys << np.uint64(same)) >> cut) << cut
    behind.sort()
    behind &= np.uint64((1 << low) - 1)
    found = behind.view(np.int64)
    ordered = keys[found]
    # If keys are in order so are the places of equal ones, since nothing stands between them.
    return found if (ordered[1:] >= ordered[:-1]).all() else np.argsort(keys, kind="stable")


def distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct 64-bit keys in order, and which of them each key is."""
    by = order(keys)
    ordered = keys[by]
    first = np.ones(len(keys), bool)
    first[1:] = ordered[1:] != ordered[:-1]
    back = np.empty(len(keys), np.int64)
    back[by] = np.cumsum(first) - 1
    return ordered[first], back


class Groups:
    """Equal keys among entries: sums and the like over each group, spread back to its entries."""

    def __init__(self, keys: np.ndarray):
        self.order = order(keys)
        ordered = keys[self.order]
        self.starts = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]])) if len(keys) else np.zeros(0, np.int64)
        self.sizes = np.diff(np.append(self.starts, len(keys)))

    def of(self, ufunc: np.ufunc, values: np.ndarray) -> np.ndarray:
        """One figure for each group."""
        return ufunc.reduceat(values[self.order], self.starts) if len(values) else values

    def back(self, figures: np.ndarray) -> np.ndarray:
        out = np.empty(len(self.order), figures.dtype)
        out[self.order] = np.repeat(figures, self.sizes)
        return out


# Hashes of stretches: with odd B, (sum over i of v[i] * B^i, from a to b) * B^-a is the same wherever the stretch stands.
_BASE = 0x9E3779B97F4A7C15 | 1
_powers: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    if len(_powers.get(base, ())) < n:
        values = np.full(max(n, 1 << 16), base, np.uint64)
        values[0] = 1
        _powers[base] = np.multiply.accumulate(values)
    return _powers[base][:n]


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


class Stretches:
    """Hashes of any stretch of a sequence of 64-bit values."""

    def __init__(self, values: np.ndarray):
        self.sums = np.zeros(len(values) + 1, np.uint64)
        np.cumsum(values * _power(_BASE, len(values)), out=self.sums[1:])
        self.back = _power(pow(_BASE, -1, 1 << 64), len(values) + 1)

    def hash(self, a: np.ndarray | slice, b: np.ndarray | slice) -> np.ndarray:
        return mix((self.sums[b] - self.sums[a]) * self.back[a])

    def rolling(self, n: int) -> np.ndarray:
        """Of every stretch of n values, by where it starts."""
        m = max(0, len(self.sums) - n)
        return self.hash(slice(0, m), slice(n, n + m))


#: A random value for each byte.
BYTES = np.random.default_rng(20).integers(1, 2**63, 256).astype(np.uint64) * np.uint64(2) + np.uint64(1)
_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def words(texts: Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of every word, and the first word of each text (one more entry than texts)."""
    space = _SPACE[texts.bytes]
    edge = np.zeros(len(space) + 1, bool)
    edge[texts.at] = True
    before = np.concatenate([[True], space[:-1]]) if len(space) else space
    after = np.concatenate([space[1:], [True]]) if len(space) else space
    starts = np.flatnonzero(~space & (before | edge[:-1]))
    ends = np.flatnonzero(~space & (after | edge[1:])) + 1
    return starts, ends, np.searchsorted(starts, texts.at)


def word_hashes(texts: Texts, starts: np.ndarray, ends: np.ndarray, lower: bool = False) -> np.ndarray:
    out = np.empty(len(starts), np.uint64)
    # A block of whole words at a time: a hash does not depend on where its word stands, and eight bytes for each byte of a chunk are many.
    cuts = np.unique(np.append(np.searchsorted(starts, np.arange(0, len(texts.bytes), HASH_BYTES)), len(starts)))
    for i, j in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
        a, b, at = starts[i:j], ends[i:j], starts[i]
        data = texts.bytes[at : b[-1]]
        # Lengths go in so that no word is the continuation of another in value.
        out[i:j] = Stretches(BYTES[_LOWER[data] if lower else data]).hash(a - at, b - at) + (b - a).astype(np.uint64)
    return out


def sliding_least(values: np.ndarray, n: int) -> np.ndarray:
    """The least of every n neighbouring values."""
    span = 1
    while span * 2 <= n:
        values = np.minimum(values[:-span], values[span:]) if len(values) > span else values[:0]
        span *= 2
    rest = n - span
    return (np.minimum(values[:-rest], values[rest:]) if len(values) > rest else values[:0]) if rest else values


def runs(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the stretches of true."""
    edges = np.diff(np.concatenate([[0], flags.view(np.int8), [0]]))
    return np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)


def anchors(least: np.ndarray, valid: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(value, first, last) of each run of neighbouring valid windows whose least value is the same one."""
    if not len(least):
        return least, np.zeros(0, np.int64), np.zeros(0, np.int64)
    same = np.zeros(len(least), bool)
    same[1:] = (least[1:] == least[:-1]) & valid[:-1]
    first = np.flatnonzero(valid & ~same)
    ends = np.flatnonzero(valid & ~np.concatenate([same[1:] & valid[1:], [False]]))
    return least[first], first, ends


def covered(n: int, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Which of n places lie in any of the stretches."""
    step = np.bincount(starts, minlength=n + 1).astype(np.int64) - np.bincount(ends, minlength=n + 1)
    return np.cumsum(step[:n]) > 0


def spread(first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All whole numbers from first to last of each range, and which range each is of."""
    sizes = last - first + 1
    of = np.repeat(np.arange(len(first)), sizes)
    return np.arange(len(of)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + first[of], of
