"""The pipeline's stages, one after the other, against brute force; registered queries against their SQL."""

from __future__ import annotations

from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from fieldcast.llm import packing, queries
from tests.compare import connect, difference
from tests.llm import corpus
from tests.llm.test_deduplication import _covered

SF = "/root/testdata/sf0.001"
STAGES = dict(corpus_pipeline.STAGES)


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_queries_equal_their_sql(spark, name):
    assert difference(queries.QUERIES[name](spark, SF).toPandas(), connect(SF).execute(queries.ORACLES[name]).df()) is None


def test_every_operator_has_its_query():
    assert sorted(int(name[2:].split("_")[0]) for name in queries.QUERIES) == list(range(1, 14))


def _bare(text: str | None) -> str:
    return (text or "").translate(str.maketrans("", "", " \t\n\v\f\r"))


def _exact(rows: list[dict]) -> list[dict]:
    groups = defaultdict(list)
    for r in rows:
        groups[_bare(r["text"])].append(r)
    out = []
    for same in groups.values():
        best = min(same, key=lambda r: (-len(r["text"] or ""), r["doc_id"] is None, r["doc_id"] or 0))
        out.append(max((r for r in same if r["doc_id"] == best["doc_id"]), key=lambda r: (len(r["text"] or ""), r["text"] or "")))
    return out


def _near(rows: list[dict]) -> list[dict]:
    sets = []
    for r in rows:
        words = (r["text"] or "").encode().lower().split()
        sets.append(frozenset(tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))) if words else frozenset())
    like = lambda a, b: not a and not b or bool(a and b) and 10 * len(a & b) >= 8 * len(a | b)
    root = corpus.classes(list(range(len(rows))), [(i, j) for i in range(len(rows)) for j in range(i) if like(sets[i], sets[j])])
    first = {}
    for i, r in enumerate(rows):
        key = (r["doc_id"] is None, r["doc_id"] or 0)
        if root[i] not in first or key < first[root[i]][0]:
            first[root[i]] = (key, r["text"])
    return [r for i, r in enumerate(rows) if first[root[i]] == ((r["doc_id"] is None, r["doc_id"] or 0), r["text"])]


def _cut(rows: list[dict], size: int = 200) -> list[dict]:
    data = [(r["text"] or "").encode() for r in rows]
    count = Counter(d[k : k + size] for d in data for k in range(len(d) - size + 1))
    out = []
    for r, d in zip(rows, data):
        gone = _covered(len(d), [k for k in range(len(d) - size + 1) if count[d[k : k + size]] > 1], size)
        kept, at = [], 0
        for ch in d.decode():
            n = len(ch.encode())
            if not all(gone[at : at + n]):
                kept.append(ch)
            at += n
        out.append(r | {"text": "".join(kept)} | ({"n_chars": len(kept)} if "n_chars" in r else {}))
    return out


def _same(got, want: list[dict]) -> bool:
    key = lambda r: tuple(sorted((k, repr(v)) for k, v in r.items()))
    return Counter(key(r.asDict()) for r in got.collect()) == Counter(map(key, want))


def test_stages_on_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    made = STAGES["quality classifier"](spark, docs, SF)
    scored = queries.QUERIES["op7_additive_quality_model"](spark, SF)
    good = {r.doc_id for r in scored.where("predicted = 1").collect()}
    rows = [r.asDict() for r in docs.collect() if r.doc_id in good]
    assert made.columns == docs.columns and _same(made, rows) and len(rows) > 100
    for name, brute in (("exact dedup", _exact), ("near duplicates", _near), ("repeated passages", _cut)):
        docs = spark.createDataFrame([tuple(r.values()) for r in rows], docs.schema)
        made, rows = STAGES[name](spark, docs, SF), brute(rows)
        assert made.columns == docs.columns and _same(made, rows), name
    docs = spark.createDataFrame([tuple(r.values()) for r in rows], docs.schema)
    tokenizer = Tokenizer.from_file(packing.TOKENIZER)
    want = {r["doc_id"]: len(tokenizer.encode(r["text"] or "", add_special_tokens=False).ids) + 1 for r in rows}
    pieces = STAGES["packing"](spark, docs, SF)
    assert {r.doc_id: r.n for r in pieces.groupBy("doc_id").agg(F.sum("length").alias("n")).collect()} == want
    assert sum(r.length for r in corpus_pipeline.run(spark, SF).collect()) == sum(want.values())


def test_stages_on_awkward_rows(spark):
    docs = corpus.frame(spark, corpus.texts())
    rows = [r.asDict() for r in docs.collect()]
    assert set(STAGES["quality classifier"](spark, docs, SF).columns) == set(docs.columns)
    for name, brute in (("exact dedup", _exact), ("near duplicates", _near), ("repeated passages", _cut)):
        made = STAGES[name](spark, docs, SF)
        got = [r.asDict() for r in made.collect()]
        key = lambda r: (r["doc_id"], r["text"] or "")
        assert made.columns == docs.columns and Counter(map(key, got)) == Counter(map(key, brute(rows))), name
    assert STAGES["packing"](spark, docs, SF).count() >= len(rows)


@pytest.mark.parametrize("name", list(STAGES))
def test_stages_without_rows(spark, name):
    assert STAGES[name](spark, spark.read.parquet(f"{SF}/documents.parquet").limit(0), SF).count() == 0


def test_passages_and_copies_do_not_survive(spark):
    """One long passage in many texts, one text in many copies: what is unique stays."""
    rng = np.random.default_rng(8)
    word = lambda: "".join(rng.choice(list("kolmirunatsed"), 6))
    passage = " ".join(word() for _ in range(60))
    own = [" ".join(word() for _ in range(80)) for _ in range(30)]
    rows = [(i, f"{o} {passage} {word()}", "en", "s", 1) for i, o in enumerate(own)] + [(100 + i, own[0] + " end", "en", "s", 1) for i in range(50)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    once = STAGES["exact dedup"](spark, docs, SF)
    assert once.count() == 31
    made = STAGES["repeated passages"](spark, once, SF)
    cut = made.collect()
    assert _same(made, _cut([r.asDict() for r in once.collect()]))
    # Letters beside the passage that other texts have there too go with it.
    assert not any(passage[:200] in r.text for r in cut) and sum(o.rsplit(" ", 1)[0] in r.text for r in cut for o in own[1:]) == 29


def test_a_dropped_row_does_not_come_back(spark):
    """Ids that stand for several texts, and texts without an id."""
    rows = [(1, "alpha beta"), (2, "alpha  beta"), (2, "gamma"), (None, "gamma "), (None, "only"), (3, "delta"), (3, "alpha beta"), (4, "o  p"), (4, "op "), (4, "op")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = Counter((r.doc_id, r.text) for r in STAGES["exact dedup"](spark, docs, SF).collect())
    assert got == Counter([(2, "alpha  beta"), (None, "gamma "), (None, "only"), (3, "delta"), (4, "o  p")])
    long_ = " ".join(f"w{i}" for i in range(80))
    rows = [(5, long_), (5, long_ + " more"), (5, "else"), (6, long_ + " and"), (None, long_ + " so"), (None, "a b c d e f"), (7, None), (8, " ")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = [(r.doc_id, r.text) for r in STAGES["near duplicates"](spark, docs, SF).collect()]
    assert len(got) == 4 and sum(i == 5 for i, _ in got) == 2 and {(5, "else"), (None, "a b c d e f"), (7, None)} < set(got)
