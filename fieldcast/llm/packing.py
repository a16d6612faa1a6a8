"""Cost-balanced packing of token streams into sequences.

Documents are dealt to groups by a hash, and a group is packed on its own. Its sequences
are as many full ones as its tokens fill; what is left over goes into sequences whose
lengths are powers of two, which need no padding. A heap holds the sequences by estimated
cost (linear plus quadratic in the length of each piece, as attention stays within a
piece). Documents, longest first, go to the cheapest sequence with room left; what does
not fit there is cut off and goes back among the documents. So a cut always fills a
sequence: there are at most as many cuts as sequences.

A group is bounded by bytes, whatever the corpus; only a single document larger than that
makes a larger group.
"""

from __future__ import annotations

import base64
import heapq
import math
import re
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldcast.llm.rows import whole

TOKENIZER, RANKS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")
LENGTH, END, GROUP_BYTES = 2048, 1, 6 << 20
#: Cost of a piece of n tokens: LINEAR * n + n * n; the first is the width of a layer's other work in tokens.
LINEAR = 4096

PIECES = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint, sequence_tokens bigint, ids binary"


@cache
def _encoders(tokenizer: str, ranks: str):
    import tiktoken
    from tokenizers import Tokenizer

    table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(ranks, "rb"))}
    quick = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={})
    return Tokenizer.from_file(tokenizer), quick


#: Texts of these characters without a mark that could be a special token are split alike by both libraries.
_PLAIN = re.compile(r"[^\x00-ɏ‐-‧]|<\|")


def encode(text: str, tokenizer: str = TOKENIZER, ranks: str = RANKS, end: int = END) -> np.ndarray:
    """Ids of a whole text, then the end id. Plain texts go through the rank file of the same vocabulary, which is faster."""
    slow, quick = _encoders(tokenizer, ranks)
    ids = slow.encode(text, add_special_tokens=False).ids if _PLAIN.search(text) else quick.encode_to_numpy(text)
    return np.append(np.asarray(ids, np.uint32), np.uint32(end))


def capacities(tokens: int, length: int = LENGTH) -> list[int]:
    """Room of the sequences for so many tokens: full ones, then powers of two."""
    full, rest = divmod(tokens, length)
    return [length] * full + [1 << k for k in reversed(range(rest.bit_length())) if rest >> k & 1]


def pack(sizes: list[int], length: int = LENGTH, linear: int = LINEAR) -> list[tuple[int, int, int, int, int]]:
    """Pieces (document, start, tokens, sequence, offset) of documents of these sizes; every token is in exactly one."""
    room = capacities(sum(sizes), length)
    cheap = [(0, k) for k in range(len(room))]
    heapq.heapify(cheap)
    used = [0] * len(room)
    open_ = [(-n, i, 0) for i, n in enumerate(sizes) if n]
    heapq.heapify(open_)
    out = []
    while open_:
        n, doc, start = heapq.heappop(open_)
        cost, k = heapq.heappop(cheap)
        take = min(-n, room[k] - used[k])
        out.append((doc, start, take, k, used[k]))
        used[k] += take
        if used[k] < room[k]:
            heapq.heappush(cheap, (cost + linear * take + take * take, k))
        if take < -n:
            heapq.heappush(open_, (n + take, doc, start + take))
    return out


def pack_documents(
    docs: DataFrame, text: str = "text", key: str = "doc_id", length: int = LENGTH, tokenizer: str = TOKENIZER, ranks: str = RANKS, end: int = END,
    linear: int = LINEAR, group_bytes: int = GROUP_BYTES, with_ids: bool = False,
) -> DataFrame:
    """One row for each piece: its document, place there, checksum, sequence and place in the sequence.

    sequence_id is unique over all groups. A null text is empty and still has its end id; a
    row with a null id is packed like any other, and repeated rows are packed once each.
    Texts of any length are cut freely. `with_ids` adds the ids (unsigned 32-bit, little
    endian). No rows give no pieces; other columns are not looked at.
    """
    slim = docs.select(F.col(key).cast("bigint").alias("doc_id"), whole(text).alias("text"))
    size = slim.agg(F.sum(F.octet_length("text") + F.lit(16))).first()[0] or 0
    groups = max(1, math.ceil(size / group_bytes))

    def run(table: pa.Table) -> pa.Table:
        first = table["group"][0].as_py() << 32
        ids = [encode(x, tokenizer, ranks, end) for column in table["text"].chunks for x in column.to_pylist()]
        names, sizes = table["doc_id"].to_pylist(), [len(x) for x in ids]
        pieces = pack(sizes, length, linear)
        room = capacities(sum(sizes), length)
        cut = [ids[doc][start : start + n] for doc, start, n, _, _ in pieces]
        columns = {
            "doc_id": [names[p[0]] for p in pieces], "start": [p[1] for p in pieces], "length": [p[2] for p in pieces], "ids_crc32": [zlib.crc32(x) for x in cut],
            "doc_tokens": [sizes[p[0]] for p in pieces], "sequence_id": [first + p[3] for p in pieces], "offset": [p[4] for p in pieces], "sequence_tokens": [room[p[3]] for p in pieces],
        }
        made = {c: pa.array(v, pa.int64()) for c, v in columns.items()}
        return pa.table(made | {"ids": pa.array([x.tobytes() if with_ids else None for x in cut], pa.binary())})

    dealt = slim.withColumn("group", F.pmod(F.xxhash64("doc_id", F.octet_length("text"), F.substring("text", 1, 64)), F.lit(groups)))
    out = dealt.groupBy("group").applyInArrow(run, PIECES)
    return out if with_ids else out.drop("ids")
