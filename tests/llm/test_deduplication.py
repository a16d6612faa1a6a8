"""Exact, near and passage deduplication against brute force."""

from __future__ import annotations

import hashlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from fieldcast.llm import block_dedup, line_join, perfect_hash, simhash, suffix_dedup
from fieldcast.llm.components import components
from tests.llm import corpus

SPACES = b" \t\n\v\f\r"


@pytest.fixture(scope="module")
def docs(spark):
    return corpus.frame(spark, corpus.texts())


@pytest.mark.parametrize("shard", [5, 1000])
def test_exact_groups(docs, shard):
    groups = defaultdict(list)
    for i, t in corpus.texts():
        groups["".join((t or "").split(" ")).translate(str.maketrans("", "", " \t\n\v\f\r"))].append((-len(t or ""), i is None, i or 0, i))
    got = perfect_hash.exact_dedup(docs, F.crc32(F.col("doc_id").cast("string")) % 2 == 0, shard_digests=shard).collect()
    want = Counter()
    for bare, rows in groups.items():
        keep = min(rows)[3]
        want.update((r[3], keep, len(rows), r[3] == keep, hashlib.sha256(bare.encode()).digest()) for r in rows)
    assert Counter((r.doc_id, r.keep_id, r.group_size, r.kept, bytes(r.digest)) for r in got) == want


def test_perfect_hash_is_minimal_and_rejects_strangers():
    digests = np.frombuffer(b"".join(hashlib.sha256(bytes([i % 256, i // 256])).digest() for i in range(3000)), np.uint64).reshape(-1, 4)
    known, strange = digests[:2000], digests[2000:]
    sizes, bits = perfect_hash.build(known)
    slots = perfect_hash.slots(known, sizes, bits)
    assert sorted(slots.tolist()) == list(range(2000))
    at = perfect_hash.slots(strange, sizes, bits)
    assert not any((known[np.argsort(slots)][s] == d).all() for s, d in zip(at, strange) if s >= 0)


def _print(text: str | None) -> int:
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(b" ".join(words[k : k + 4]), 42) for k in range(max(1, len(words) - 3))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


@pytest.mark.parametrize("dense", [3, 4096])
def test_simhash_links_what_is_close(docs, dense, monkeypatch):
    monkeypatch.setattr(simhash.links, "__defaults__", (simhash.BITS, simhash.BLOCKS, dense))
    got = Counter((r.doc_id, r.print, r.component_id) for r in simhash.near_duplicates(docs).collect())
    prints = [_print(t) for _, t in corpus.texts()]
    nodes = sorted(set(prints))
    linked = corpus.classes(nodes, [(a, b) for i, a in enumerate(nodes) for b in nodes[i + 1 :] if (a ^ b).bit_count() <= 4])
    least = defaultdict(list)
    for (i, _), p in zip(corpus.texts(), prints):
        least[linked[p]].append(i)
    signed = lambda p: p - (1 << 64) if p >> 63 else p
    want = Counter((i, signed(p), min((x for x in least[linked[p]] if x is not None), default=None)) for (i, _), p in zip(corpus.texts(), prints))
    assert got == want


def test_components_of_a_path_a_star_and_loops(spark):
    path = [(i, i + 1) for i in range(100, 140)]
    star = [(500, i) for i in range(501, 560)] + [(7, 7), (None, 3), (560, 559), (559, 560)]
    links = spark.createDataFrame(path + star, "x long, y long")
    got = {r.node: r.component for r in components(links, "x", "y").collect()}
    assert got == {**{i: 100 for i in range(100, 141)}, **{i: 500 for i in range(500, 561)}}
    assert components(links.limit(0), "x", "y").count() == 0


def _covered(n: int, starts: list[int], size: int) -> list[bool]:
    out = [False] * n
    for s in starts:
        out[s : s + size] = [True] * size
    return out


@pytest.mark.parametrize("slice_bytes", [700, 1 << 19])
def test_repeated_bytes(docs, slice_bytes):
    size, rows = 48, corpus.texts()
    data = [(t or "").encode() for _, t in rows]
    count = Counter(d[k : k + size] for d in data for k in range(len(d) - size + 1))
    want = Counter()
    for (i, _), d in zip(rows, data):
        gone = _covered(len(d), [k for k in range(len(d) - size + 1) if count[d[k : k + size]] > 1], size)
        want[(i, len(d), sum(gone), sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone)), bytes(b for b, g in zip(d, gone) if not g))] += 1
    got = suffix_dedup.repeated_spans(docs, threshold=size, digit=16, slice_bytes=slice_bytes).collect()
    assert Counter((r.doc_id, r.n_bytes, r.n_removed, len(r.starts), bytes(r.kept)) for r in got) == want
    assert all(sum(r.ends) - sum(r.starts) == r.n_removed for r in got)


def test_repeated_bytes_in_whole_characters(spark):
    shared = "漢字" * 3 + "ab" * 30
    docs = corpus.frame(spark, [(1, "é" + shared + "漢"), (2, "è" + shared + "字")])
    got = {r.doc_id: (bytes(r.kept).decode(), r.carried_0) for r in suffix_dedup.repeated_spans(docs, threshold=40, digit=16, whole_characters=True, carry=["lang"]).collect()}
    assert got == {1: ("é漢", "xx"), 2: ("è字", "xx")}


@pytest.mark.parametrize("window", [4, 20])
def test_later_passages(docs, window):
    rows = sorted(corpus.texts(), key=lambda r: (r[0] is None, r[0] or 0, r[1] or ""))
    seen: set[tuple] = set()
    want = Counter()
    for i, t in rows:
        words = (t or "").encode().split()
        starts = []
        for k in range(len(words) - window + 1):
            if (w := tuple(words[k : k + window])) in seen:
                starts.append(k)
            seen.add(w)
        gone = _covered(len(words), starts, window)
        want[(i, len(words), sum(gone), b" ".join(x for x, g in zip(words, gone) if not g).decode())] += 1
    got = block_dedup.later_passages(docs, window=window).collect()
    assert Counter((r.doc_id, r.n_words, r.n_removed, r.kept) for r in got) == want


@pytest.mark.parametrize("threshold", [1, 2])
def test_lines_within_some_edits(spark, threshold):
    lines = ["", " ", "a", "ab", "ba", "abc", "abd", "xabc", "kolmi run", "kolmi runt", "olmi runt", "kolmé run", "kolmé ren", "🙂漢 run at sea", "漢 run at sea", "🙂漢 run at see.", "mirun " * 9, "mirun " * 8 + "mirin "]
    rows = [(i, "\n".join(lines[i::5])) for i in range(5)] + [(9, "kolmi run\nkolmi run"), (None, "ab"), (11, None), (12, "")]
    seen = {x for x in lines if x.strip()}
    links = [(a, b) for a in seen for b in seen if a < b and corpus.edits(a, b) <= threshold]
    degree, where = Counter(x for pair in links for x in pair), defaultdict(list)
    for i, t in rows:
        for x in (t or "").split("\n"):
            where[x].append(i)
    got = line_join.line_classes(corpus.frame(spark, rows), threshold=threshold).collect()
    assert {r.line: (r.n_links, r.copies, r.doc_id) for r in got} == {x: (degree[x], len(where[x]), min(i for i in where[x] if i is not None)) for x in seen}
    ids = {r.line: r.line_id for r in got}
    reached = corpus.classes(sorted(ids.values()), [(ids[a], ids[b]) for a, b in links])
    assert {r.line_id: r.class_id for r in got} == reached
    first = {c: min(r.doc_id for r in got if reached[r.line_id] == c) for c in reached.values()}
    assert all(r.class_doc_id == first[r.class_id] for r in got)


def test_line_join_stays_native(docs):
    plan = line_join.line_classes(docs)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_no_rows(docs):
    none = docs.limit(0)
    for made in (
        perfect_hash.exact_dedup(none, F.lit(True)), simhash.near_duplicates(none), suffix_dedup.repeated_spans(none), block_dedup.later_passages(none), line_join.line_classes(none)
    ):
        assert made.count() == 0
