"""The pipeline's near-duplicate stage against brute-force Jaccard similarity."""

from __future__ import annotations

import random

import pytest

import corpus_pipeline
from fieldcast.llm import jaccard, simhash
from tests.llm import corpus

SF = "/root/testdata/sf0.001"
near = dict(corpus_pipeline.STAGES)["near duplicates"]


def _set(text: str | None) -> set:
    words = (text or "").encode().lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def _similar(a: set, b: set) -> bool:
    return 5 * len(a & b) >= 4 * len(a | b)


def _survivors(rows: list[tuple[int | None, str | None]]) -> list[int | None]:
    sets = [_set(t) for _, t in rows]
    root = corpus.classes(list(range(len(rows))), [(i, j) for i in range(len(rows)) for j in range(i) if _similar(sets[i], sets[j])])
    least: dict = {}
    for k, (i, _) in enumerate(rows):
        least[root[k]] = min([x for x in (least.get(root[k]), i) if x is not None], default=None)
    keep = {least[root[k]] for k, (i, _) in enumerate(rows) if i == least[root[k]]}
    return sorted((i for i, _ in rows if i in keep), key=lambda i: (i is None, i or 0))


def _made(spark, rows) -> list[int | None]:
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    return sorted((r.doc_id for r in near(spark, docs, SF).collect()), key=lambda i: (i is None, i or 0))


def planted(seed: int = 3) -> list[tuple[int, str]]:
    """Texts of 120 words and copies with one to six changed words, at and around the bound."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("kolmirunatsed") for _ in range(rng.randint(3, 9)))
    out = []
    for _ in range(40):
        base = [word() for _ in range(120)]
        out.append(" ".join(base))
        for edits in (1, 2, 3, 6):
            copy = list(base)
            for at in rng.sample(range(120), edits):
                copy[at] = word()
            out.append(" ".join(copy))
    return [(i, t) for i, t in enumerate(out)]


def test_near_copies_are_found_at_every_similarity(spark):
    rows = planted()
    assert _made(spark, rows) == _survivors(rows)


@pytest.mark.parametrize("mass", [500, jaccard.MASS])
def test_near_copies_in_parts_and_awkward_rows(spark, mass):
    rows = corpus.texts()
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id for r in jaccard.near_duplicates(docs, mass=mass).where("doc_id <=> component_id").collect()}
    assert got == set(_survivors(rows))


def test_near_copies_of_the_given_documents(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").limit(600).collect()]
    assert _made(spark, rows) == _survivors(rows)


def test_simhash_blocks_choose_candidates(spark):
    """One band of sixty values lets hardly a pair meet; near copies whose fingerprints link are found all the same."""
    rows = planted()
    sets, prints = [_set(t) for _, t in rows], [simhash.fingerprint(t.encode(), jaccard.SHINGLE, jaccard.SEED) for _, t in rows]
    pairs = [(i, j) for i in range(len(rows)) for j in range(i) if (prints[i] ^ prints[j]).bit_count() <= simhash.BITS and _similar(sets[i], sets[j])]
    assert len(pairs) > 10
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    root = {r.doc_id: r.component_id for r in jaccard.near_duplicates(docs, bands=1, values=60).collect()}
    assert all(root[i] == root[j] for i, j in pairs)
