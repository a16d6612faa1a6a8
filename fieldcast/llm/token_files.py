"""Token ids as compact binary files: frequency-ranked ids in a byte-aligned code with its control bytes apart.

Ids are renumbered by how often the corpus holds them, so the commonest take one byte. A
file holds the ids of consecutive documents: first two bits for each id that say how many
bytes it has (four ids to a control byte), then those bytes, low byte first. A reader looks
all four lengths of a control byte up in one table, sums them to places and gathers the
bytes with numpy; there is no loop over ids.

A folder has `ranks` (the renumbering), `manifest` (files in the order of the documents) and
`shards` with the files:

    magic "FCT1", documents (u32), ids (u64), control bytes (u64), data bytes (u64)
    for each document its id (i64), whether it has one (u8), its number of ids (u64)
    control bytes of each document (a document begins a new one), data bytes of each document
"""

from __future__ import annotations

import re
import uuid
import zlib
from array import array
from collections.abc import Iterator
from functools import cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fieldcast.llm.rows import whole
from fieldcast.session import settle, shared_folder

TOKENIZER, END = public_tokenizers.path("word_bpe_49k.json"), 2
#: Bytes of data after which a file ends, with the document that reaches them.
SHARD_BYTES = 4 << 20
MAGIC, HEAD = b"FCT1", np.dtype([("magic", "S4"), ("documents", "<u4"), ("ids", "<u8"), ("control", "<u8"), ("data", "<u8")])
ROW = np.dtype([("id", "<i8"), ("known", "u1"), ("n", "<u8")])
MANIFEST = "name string, piece bigint, number bigint, documents bigint, ids bigint"
#: Letters of spans between white space that a worker remembers at once.
MEMORY = 8 << 20

#: Bytes of each of the four ids of a control byte.
LENGTHS = ((np.arange(256)[:, None] >> np.array([0, 2, 4, 6])) & 3).astype(np.uint8) + 1


def pack(ranks: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Control bytes, where each document's begin, data bytes, where each document's begin; `at` says where its ranks (below 2**32) begin.

    The last control byte of a document that its ids do not fill is filled with zero bits.
    """
    # Most vocabularies need two bytes at most, and half the work.
    width = 2 if len(ranks) == 0 or ranks.max() <= 0xFFFF else 4
    ranks = np.ascontiguousarray(ranks, f"<u{width}")
    extra = (ranks > 0xFF).view(np.uint8)
    if width == 4:
        extra = extra + (ranks > 0xFFFF) + (ranks > 0xFFFFFF)
    controls = np.concatenate([[0], np.cumsum(-(-np.diff(at) // 4))])
    slots = np.zeros(4 * controls[-1], np.uint8)
    held = np.ones(len(slots), bool)
    # The slots behind the ids of a document, at most three of them, hold nothing.
    for k in range(3):
        held[(4 * controls[1:] - 1 - k)[4 * np.diff(controls) - np.diff(at) > k]] = False
    slots[held] = extra
    four = slots.reshape(-1, 4)
    control = four[:, 0] | four[:, 1] << 2 | four[:, 2] << 4 | four[:, 3] << 6
    used = np.empty((len(ranks), width), bool)
    for k in range(width):
        used[:, k] = extra >= k
    data = ranks.view(np.uint8)[used.reshape(-1)]
    return control, controls, data, np.concatenate([[0], np.cumsum(extra, dtype=np.int64) + np.arange(1, len(ranks) + 1)])[at]


def unpack(control: np.ndarray, data: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The ranks of documents of these sizes, end to end."""
    first = np.cumsum(-(-sizes // 4) * 4) - -(-sizes // 4) * 4
    held = np.arange(sizes.sum()) + np.repeat(first - (np.cumsum(sizes) - sizes), sizes)
    size = LENGTHS[control].reshape(-1)[held]
    place = np.cumsum(size, dtype=np.int64) - size
    out = data[place].astype(np.uint32)
    for k in (1, 2, 3):
        longer = np.flatnonzero(size > k)
        out[longer] |= data[place[longer] + k].astype(np.uint32) << np.uint32(8 * k)
    return out


#: A word of Latin letters (those that have one lower-case letter and stay themselves when composed) with signs after it: two units of the vocabulary's splitting.
_WORD = re.compile(r"([A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u0148\u014a-\u017e]+)([!-&(-/:-@\[-`{-~]*)\Z")


class Encoder:
    """Whole texts to ids.

    White space separates ids, so each different span between it is encoded once and remembered, up to
    so many letters. A plain word goes to the library's vocabulary model at once, in lower case
    and as the characters that stand for its bytes there; anything else takes the library's whole way.
    """

    def __init__(self, path: str, end: int):
        from tokenizers import Tokenizer

        self.coder = Tokenizer.from_file(path)
        self.type = np.dtype("<u2" if self.coder.get_vocab_size() <= 1 << 16 else "<u4")
        self.end, self.known, self.units, self.letters = np.array([end], self.type).tobytes(), {}, {}, 0
        stand = [*range(33, 127), *range(161, 173), *range(174, 256)]
        self.stand = {b: chr(b) for b in stand} | {b: chr(256 + k) for k, b in enumerate(sorted(set(range(256)) - set(stand)))}

    def _bytes(self, ids: list[int]) -> bytes:
        # For a handful of ids several times as fast as numpy.
        return array(self.type.char, ids).tobytes()

    def _unit(self, unit: str) -> bytes:
        found = self.units.get(unit)
        if found is None:
            seen = unit if unit.isascii() else "".join(map(self.stand.__getitem__, unit.encode()))
            found = self.units[unit] = self._bytes([t.id for t in self.coder.model.tokenize(seen)])
        return found

    def _learn(self, spans: list[str]) -> None:
        if self.letters > MEMORY:
            self.units, self.letters = {}, 0
        whole_way = []
        for span in spans:
            plain = _WORD.match(span)
            if plain:
                word, signs = plain.groups()
                self.known[span] = self._unit(word.lower()) + (self._unit(signs) if signs else b"")
                self.letters += len(span)
            else:
                whole_way.append(span)
        for at in range(0, len(whole_way), 4096):
            part = whole_way[at : at + 4096]
            for span, found in zip(part, self.coder.encode_batch_fast(part, add_special_tokens=False)):
                self.known[span] = self._bytes(found.ids)
                self.letters += len(span)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, each with the end id, end to end; and where each begins."""
        split = pc.ascii_split_whitespace(texts.cast(pa.large_string()))
        words = split.flatten().dictionary_encode()
        different = words.dictionary.to_numpy(zero_copy_only=False).tolist()
        if self.letters > MEMORY:
            self.known = {}
        self._learn([s for s in different if s not in self.known])
        found = pa.array([*map(self.known.__getitem__, different), self.end], pa.large_binary())
        ends = np.cumsum(split.value_lengths().to_numpy(zero_copy_only=False))
        codes = np.insert(words.indices.to_numpy(zero_copy_only=False), ends, len(different))
        flat, at = _flat(found.take(pa.array(codes)))
        return flat.view(self.type), np.concatenate([[0], at[ends + np.arange(1, len(ends) + 1)] // self.type.itemsize])


@cache
def _encoder(path: str, end: int) -> Encoder:
    """One for each worker, so that what it remembers outlives a task."""
    return Encoder(path, end)


def _binary(data: np.ndarray, at: np.ndarray) -> pa.Array:
    return pa.Array.from_buffers(pa.large_binary(), len(at) - 1, [None, pa.py_buffer(np.ascontiguousarray(at, np.int64)), pa.py_buffer(np.ascontiguousarray(data))]).cast(pa.binary())


def _flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a binary column end to end, and where each value begins."""
    column = column.cast(pa.large_binary())
    at = np.frombuffer(column.buffers()[1], np.int64, len(column) + 1, column.offset * 8)
    return np.frombuffer(column.buffers()[2], np.uint8, at[-1] - at[0], at[0]), at - at[0]


def _pieces(lengths: np.ndarray, bound: int) -> Iterator[slice]:
    """Consecutive rows of about so many letters."""
    group = (np.cumsum(lengths) - lengths) // bound
    cuts = np.flatnonzero(np.diff(group)) + 1
    yield from (slice(a, b) for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(lengths)]) if b > a)


def tokens(docs: DataFrame, text: str = "text", key: str = "doc_id", tokenizer: str = TOKENIZER, end: int = END, batch_bytes: int = 8 << 20) -> DataFrame:
    """doc_id and ids of every whole text (null: empty) with the end id, in two bytes each where the vocabulary allows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _encoder(tokenizer, end)
        for batch in batches:
            for part in _pieces(pc.binary_length(batch.column(1)).to_numpy(zero_copy_only=False).astype(np.int64), batch_bytes):
                ids, at = coder.encode(batch.column(1)[part])
                yield pa.RecordBatch.from_arrays([batch.column(0)[part], _binary(ids.view(np.uint8), at * coder.type.itemsize)], ["doc_id", "ids"])

    return docs.select(F.col(key).cast("bigint").alias("doc_id"), whole(text).alias("text")).mapInArrow(run, "doc_id bigint, ids binary")


def frequencies(coded: DataFrame, kind: np.dtype) -> DataFrame:
    """How often each id occurs; a task sends one row for each different id it holds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1, np.int64)
        for batch in batches:
            if len(batch):
                count = np.bincount(_flat(batch.column(0))[0].view(kind))
                if len(count) > len(total):
                    total = np.pad(total, (0, len(count) - len(total)))
                total[: len(count)] += count
        ids = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(total[ids], pa.int64())], ["id", "n"])

    return coded.select("ids").mapInArrow(run, "id bigint, n bigint").groupBy("id").agg(F.sum("n").alias("n"))


def _system(folder: str) -> tuple[pyarrow.fs.FileSystem, str]:
    """The file system of a folder; a bare path is a shared mount."""
    if "://" in folder or folder.startswith("file:"):
        return pyarrow.fs.FileSystem.from_uri("file://" + folder.removeprefix("file:") if re.match("file:/(?!/)", folder) else folder)
    return pyarrow.fs.LocalFileSystem(), folder


def _put(folder: str, name: str, parts: list[bytes]) -> None:
    """Write a file under another name, then give it its own: a task that runs twice leaves one whole file."""
    system, base = _system(folder)
    passing = f"{base}/.{name}-{uuid.uuid4().hex}"
    with system.open_output_stream(passing) as out:
        for part in parts:
            out.write(part)
    system.move(passing, f"{base}/{name}")


def write(docs: DataFrame, folder: str | None = None, text: str = "text", key: str = "doc_id", tokenizer: str = TOKENIZER, end: int = END, shard_bytes: int = SHARD_BYTES) -> str:
    """Write the ids of all documents, in ascending order of their id, and return the folder.

    Null ids come first; rows of one id in the order of their ids' hash. Files end after
    `shard_bytes` of data, with the document that reaches them, so only a single longer document makes
    a longer file. An empty table gives a folder without files. The renumbering has at most one
    entry for each id of the vocabulary, which bounds what the driver holds and sends out.
    """
    spark = docs.sparkSession
    folder = folder or shared_folder(spark)
    kind = _encoder(tokenizer, end).type
    coded = settle(tokens(docs, text, key, tokenizer, end))
    counts = sorted(((-r.n, r.id) for r in frequencies(coded, kind).collect()))
    by_rank = np.array([i for _, i in counts], np.int64)
    spark.createDataFrame(list(enumerate(by_rank.tolist())), "rank bigint, id bigint").coalesce(1).write.parquet(f"{folder}/ranks")
    rank_of = np.zeros(int(by_rank.max(initial=-1)) + 1, np.uint32)
    rank_of[by_rank] = np.arange(len(by_rank), dtype=np.uint32)
    shards = f"{folder}/shards"
    system, base = _system(shards)
    system.create_dir(base, recursive=True)

    def compact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths = pc.binary_length(batch.column(1)).to_numpy(zero_copy_only=False).astype(np.int64)
            for part in _pieces(lengths, 8 << 20):
                ids, at = _flat(batch.column(1)[part])
                control, c, data, d = pack(rank_of[ids.view(kind)], at // kind.itemsize)
                yield pa.RecordBatch.from_arrays([batch.column(0)[part], pa.array(np.diff(at) // kind.itemsize, pa.int64()), _binary(control, c), _binary(data, d)], ["doc_id", "n", "control", "data"])

    def store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, piece, held, size = 0, None, [], 0

        def close() -> pa.RecordBatch:
            rows = np.array([(i or 0, i is not None, n) for i, n, _, _ in held], ROW)
            control, data = b"".join(x for _, _, x, _ in held), b"".join(x for _, _, _, x in held)
            ids, name = int(rows["n"].sum()), f"{piece:08d}-{number:06d}.bin"
            _put(shards, name, [np.array([(MAGIC, len(held), ids, len(control), len(data))], HEAD).tobytes(), rows.tobytes(), control, data])
            return pa.RecordBatch.from_pylist([{"name": name, "piece": piece, "number": number, "documents": len(held), "ids": ids}])

        for batch in batches:
            for doc, n, control, data, piece in zip(*(column.to_pylist() for column in batch.columns)):
                held.append((doc, n, control, data))
                size += len(control) + len(data)
                if size >= shard_bytes:
                    yield close()
                    number, held, size = number + 1, [], 0
        if held:
            yield close()

    # Rows alike in id and ids may stand in any order; a number spreads them over files.
    keys = ["doc_id", "_hash", "_number"]
    packed = coded.mapInArrow(compact, "doc_id bigint, n bigint, control binary, data binary")
    numbered = packed.select("*", F.xxhash64("control", "data").alias("_hash"), F.monotonically_increasing_id().alias("_number"))
    ordered = numbered.repartitionByRange(*keys).sortWithinPartitions(*keys).select("doc_id", "n", "control", "data", F.spark_partition_id().cast("bigint").alias("piece"))
    ordered.mapInArrow(store, MANIFEST).write.parquet(f"{folder}/manifest")
    return folder


def _starts(manifest: DataFrame) -> DataFrame:
    """Ids in all files before each, by sums over pieces and then within each."""
    sums = manifest.groupBy("piece").agg(F.sum("ids").alias("total"))
    blocks = sums.withColumn("slab", F.floor(F.col("piece") / 1024))
    slabs = blocks.groupBy("slab").agg(F.sum("total").alias("all")).select("slab", (F.sum("all").over(Window.orderBy("slab")) - F.col("all")).alias("slab_start"))
    pieces = blocks.join(slabs, "slab").select("piece", (F.col("slab_start") + F.sum("total").over(Window.partitionBy("slab").orderBy("piece")) - F.col("total")).alias("piece_start"))
    within = F.sum("ids").over(Window.partitionBy("piece").orderBy("number")) - F.col("ids")
    return manifest.join(pieces, "piece").select("name", (F.col("piece_start") + within).alias("start"))


def read(spark: SparkSession, folder: str, with_ids: bool = False) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens and ids_crc32 of every document of a folder, decoded from its files; `with_ids` adds the ids."""
    by_rank = np.array([r.id for r in spark.read.parquet(f"{folder}/ranks").orderBy("rank").collect()], "<u4")
    columns = ["doc_id", "within", "n_tokens", "ids_crc32", "ids", "name"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                raw = np.frombuffer(content.as_buffer(), np.uint8)
                magic, documents, _, controls, length = np.frombuffer(raw, HEAD, 1)[0].tolist()
                if magic != MAGIC or len(raw) != HEAD.itemsize + ROW.itemsize * documents + controls + length:
                    raise ValueError(f"{name} is not a whole file of token ids")
                rows, at = np.frombuffer(raw, ROW, documents, HEAD.itemsize), HEAD.itemsize + ROW.itemsize * documents
                size = rows["n"].astype(np.int64)
                ids = by_rank[unpack(raw[at : at + controls], raw[at + controls :], size)]
                begin = np.cumsum(size) - size
                cut = [ids[a : a + m] for a, m in zip(begin, size)]
                arrays = [pa.array(rows["id"].astype(np.int64), mask=rows["known"] == 0), pa.array(begin), pa.array(size), pa.array([zlib.crc32(x) for x in cut], pa.int64()),
                          pa.array([x.tobytes() if with_ids else None for x in cut], pa.binary()), pa.array([name] * documents, pa.string())]
                yield pa.RecordBatch.from_arrays(arrays, columns)

    files = spark.read.format("binaryFile").load(f"{folder}/shards").select(F.element_at(F.split("path", "/"), -1).alias("name"), "content")
    found = files.mapInArrow(run, "doc_id bigint, within bigint, n_tokens bigint, ids_crc32 bigint, ids binary, name string")
    out = found.join(_starts(spark.read.schema(MANIFEST).parquet(f"{folder}/manifest")), "name").select("doc_id", (F.col("start") + F.col("within")).alias("start"), "n_tokens", "ids_crc32", "ids")
    return out if with_ids else out.drop("ids")
