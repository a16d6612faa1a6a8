"""Packing, encoding, scoring, quality and embeddings against brute force or the libraries they must agree with."""

from __future__ import annotations

import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import public_tokenizers
import sentencepiece
from pyspark.sql import functions as F
from sentencepiece import sentencepiece_model_pb2
from tokenizers import Tokenizer

from fieldcast.llm import additive_model, packing, projection_forest, sentence_pieces, suffix_tree
from tests.llm import corpus

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def docs(spark):
    return corpus.frame(spark, corpus.texts())


def test_packing_keeps_every_token_once(docs):
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = Counter()
    for i, t in corpus.texts():
        want[(i, np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 1], np.uint32).tobytes())] += 1
    pieces = packing.pack_documents(docs, group_bytes=20_000, with_ids=True).collect()
    assert all(zlib.crc32(p.ids) == p.ids_crc32 and len(p.ids) == 4 * p.length for p in pieces)
    sequences, parts = defaultdict(list), defaultdict(list)
    for p in pieces:
        sequences[p.sequence_id].append(p)
        parts[(p.doc_id, p.doc_tokens, p.sequence_id >> 32)].append(p)
    for members in sequences.values():
        at = 0
        for p in sorted(members, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at == members[0].sequence_tokens and (at == 2048 or at & (at - 1) == 0)
    # Documents cut into pieces, put together again; repeated rows have all their pieces twice.
    assert sum(p.length for p in pieces) == sum(len(ids) // 4 * n for (_, ids), n in want.items())
    single = {key: sorted(ps, key=lambda p: p.start) for key, ps in parts.items() if sum(p.length for p in ps) == key[1]}
    for (i, _, _), ps in single.items():
        assert (i, b"".join(bytes(p.ids) for p in ps)) in want and [p.start for p in ps] == np.cumsum([0, *(p.length for p in ps)])[:-1].tolist()
    assert len({i for i, *_ in single}) > 60
    assert len(pieces) <= len(corpus.texts()) + len(sequences)


def test_packing_takes_the_longest_first_into_the_cheapest():
    pieces = packing.pack([5, 3, 9, 1], length=8, linear=1)
    assert pieces[0][:4] == (2, 0, 8, 0)  # the longest fills the first sequence; its rest goes back among the others
    assert packing.capacities(18, 8) == [8, 8, 2]
    assert Counter(d for d, _, n, _, _ in pieces for _ in range(n)) == {0: 5, 1: 3, 2: 9, 3: 1}
    assert packing.pack([]) == []


def test_both_tokenizers_agree_on_plain_text():
    slow, quick = packing._encoders(packing.TOKENIZER, packing.RANKS)
    rng = random.Random(2)
    plain = [chr(c) for c in [*range(0x250), *range(0x2010, 0x2028)]]
    for _ in range(400):
        text = "".join(rng.choice(plain) for _ in range(60))
        assert slow.encode(text, add_special_tokens=False).ids == quick.encode_ordinary(text)
    assert packing.encode("a<|endoftext|>b").tolist() == [*slow.encode("a<|endoftext|>b", add_special_tokens=False).ids, 1]


ALPHABET = "ab ▁\n\t  é漢字🙂́　<0x0A>s/.,'\x00\r\x7f​ｆﬁ①Ａ"


def _random_texts(n: int) -> list[str]:
    rng = random.Random(4)
    return ["".join(rng.choice(ALPHABET) for _ in range(rng.randint(0, 30))) for _ in range(n)] + ["", " ", "   ", "▁", "<s>", "</s>", "<unk>", "a" * 3000, " " * 200]


def test_pieces_spans_and_decoding_equal_the_library():
    own, library = sentence_pieces.pieces(), sentencepiece.SentencePieceProcessor(model_file=sentence_pieces.MODEL)
    for text in _random_texts(600) + [t or "" for _, t in corpus.texts()]:
        ids, begins, ends = own.encode(text)
        proto = library.encode(text, return_type="proto")
        assert ids.tolist() == [p.id for p in proto.pieces] and list(zip(begins.tolist(), ends.tolist())) == [(p.begin, p.end) for p in proto.pieces]
        assert own.decode(ids.tolist()) == library.decode(ids.tolist())
    rng = random.Random(6)
    for _ in range(600):
        ids = [rng.choice([1, 2, 0, rng.randrange(3, 259), rng.randrange(32000)]) for _ in range(rng.randint(0, 12))]
        assert own.decode(ids) == library.decode(ids)


@pytest.mark.parametrize("rule,squeeze", [("nmt_nfkc", True), ("nmt_nfkc_cf", False), ("nfkc", True)])
def test_compiled_character_maps(tmp_path, rule, squeeze):
    """The same pieces behind a normaliser with a compiled map."""
    model = sentencepiece_model_pb2.ModelProto()
    model.ParseFromString(open(sentence_pieces.MODEL, "rb").read())
    spec = sentencepiece_model_pb2.ModelProto()
    spec.ParseFromString(sentencepiece.SentencePieceNormalizer(rule_name=rule).serialized_model_proto())
    model.normalizer_spec.precompiled_charsmap = spec.normalizer_spec.precompiled_charsmap
    model.normalizer_spec.remove_extra_whitespaces = squeeze
    path = tmp_path / "mapped.model"
    path.write_bytes(model.SerializeToString())
    own, library = sentence_pieces.Pieces(str(path)), sentencepiece.SentencePieceProcessor(model_file=str(path))
    for text in _random_texts(500):
        ids, begins, ends = own.encode(text)
        proto = library.encode(text, return_type="proto")
        assert ids.tolist() == [p.id for p in proto.pieces], text
        n = len(text.encode())
        assert all(0 <= a <= b <= n for a, b in zip(begins.tolist(), ends.tolist())) and (np.diff(begins) >= 0).all()
        assert own.decode(ids.tolist()) == library.decode(ids.tolist())


def test_encoded_rows(docs):
    library = sentencepiece.SentencePieceProcessor(model_file=sentence_pieces.MODEL)
    got = Counter((r.doc_id, tuple(np.frombuffer(r.ids, "<u4").tolist()), r.decoded, len(r.begins) == len(r.ends) == len(r.ids) == 4 * r.n_tokens) for r in sentence_pieces.encode(docs).collect())
    ids = lambda t: library.encode(t or "", add_bos=True, add_eos=True)
    assert got == Counter((i, tuple(ids(t)), library.decode(ids(t)), True) for i, t in corpus.texts())


def _tree(rows, held, least, gain, cut):
    """Brute force of the suffix tree of depth two."""
    low = lambda t: bytes(b + 32 if 65 <= b <= 90 else b for b in (t or "").encode()).split() + [None]
    tokens = [low(t) for _, t in rows]
    taught = [t for t, h in zip(tokens, held) if not h]
    count = Counter(w for t in taught for w in t)
    n, v = sum(count.values()), len(count)
    root = lambda x: (count[x] + 1) / (n + v + 1)
    one, two = defaultdict(Counter), defaultdict(Counter)
    for t in taught:
        for k in range(1, len(t)):
            one[t[k - 1]][t[k]] += 1
            if k > 1:
                two[t[k - 2], t[k - 1]][t[k]] += 1
    gained = lambda f, below: sum(m * (math.log((m - cut) / sum(f.values())) - math.log(below(x))) for x, m in f.items())
    first = {s for s, f in one.items() if count[s] >= least and gained(f, root) >= gain}
    mixed = lambda f, x, below: max(f[x] - cut, 0) / sum(f.values()) + cut * len(f) / sum(f.values()) * below(x)
    p1 = lambda s, x: mixed(one[s], x, root) if s in first else root(x)
    second = {s for s, f in two.items() if sum(f.values()) >= least and count[s[0]] >= least and s[1] in first and gained(f, lambda x, s=s: p1(s[1], x)) >= gain}
    out = []
    for t, h in zip(tokens, held):
        total = 0.0
        for k, x in enumerate(t):
            p = root(x) if k == 0 else p1(t[k - 1], x)
            if k > 1 and (t[k - 2], t[k - 1]) in second:
                p = mixed(two[t[k - 2], t[k - 1]], x, lambda y, k=k, t=t: p1(t[k - 1], y))
            total += math.log10(p)
        out.append((h, len(t), sum(count[x] > 0 for x in t), n, sum(math.log10(root(x)) for x in t), total))
    return out, len(first), len(second)


def test_suffix_tree_scores(docs):
    rows = corpus.texts()
    held = [i is not None and zlib.crc32(str(i).encode()) % 4 == 1 for i, _ in rows]
    want, first, second = _tree(rows, held, 5, 2.0, suffix_tree.DISCOUNT)
    assert first > 3 and second > 3
    got = suffix_tree.score(docs, F.crc32(F.col("doc_id").cast("string")) % 4 == 1, least=5, gain=2.0).collect()
    key = lambda r: (r[0] is None, r[0] or 0, r[1:3], round(r[5], 6))
    got = sorted(((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in got), key=key)
    want = sorted(((i, *w) for (i, _), w in zip(rows, want)), key=key)
    assert [g[:5] for g in got] == [w[:5] for w in want]
    np.testing.assert_allclose([g[5:] for g in got], [w[5:] for w in want], rtol=1e-5)


def test_suffix_tree_beats_the_word_model_on_texts_it_has_not_seen(spark):
    got = suffix_tree.score(spark.read.parquet(f"{SF}/documents.parquet"), F.crc32(F.col("doc_id").cast("string")) % 7 == 2)
    base, score = got.where("held_out").agg(F.sum("base_score"), F.sum("score")).first()
    assert score > base * 0.98


def test_quality_on_held_out_rows(spark, docs):
    table = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    remainder = F.crc32(F.col("doc_id").cast("string")) % 3
    messy = labels.select("doc_id", F.col("quality").cast("int").alias("quality")).union(spark.createDataFrame([(None, 1), (3, None)], "doc_id long, quality int"))
    model = additive_model.train(table, messy, remainder != 1)
    rows = additive_model.score(table, model).join(labels, "doc_id").where(remainder == 1).select("score", "quality").collect()
    assert np.mean([(r.score >= 0.5) == r.quality for r in rows]) > 0.95
    odd = additive_model.score(docs, model).collect()
    assert len(odd) == len(corpus.texts()) and all(0 <= r.score <= 1 for r in odd)
    assert len({r.score for r in odd if r.doc_id is not None and not dict(corpus.texts())[r.doc_id]}) == 1


def test_pairs_of_features_are_learnt():
    """An exclusive-or of two features: no single table can tell, a table of the pair can."""
    rng = np.random.default_rng(1)
    x = rng.random((3000, 4))
    y = ((x[:, 0] > 0.5) ^ (x[:, 2] > 0.5)).astype(float)
    alone, paired = additive_model.fit(x, y, rounds=40, pairs=0), additive_model.fit(x, y, rounds=40)
    share = lambda m: np.mean((m.score(x) >= 0.5) == y)
    assert share(alone) < 0.65 and share(paired) > 0.97 and (2, 0) in paired.pairs
    assert additive_model.fit(np.zeros((0, len(additive_model.FEATURES))), np.zeros(0)).score(np.zeros((1, len(additive_model.FEATURES))))[0] == 0.5


def _vectors() -> list[tuple[int | None, list | None]]:
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(6, 16))
    rows = [rng.normal(size=16).tolist() for _ in range(300)]
    rows += [(c + 0.12 * rng.normal(size=16)).tolist() for c in centres for _ in range(40)]
    rows += [rows[0]] * 25 + [[2 * v for v in rows[1]], [0.0] * 16, None, [float("nan")] * 16, [float("inf")] + [0.0] * 15, [1.0, None] + [0.0] * 14, [1.0, 2.0], []]
    out: list[tuple[int | None, list | None]] = [(i + 1, r) for i, r in enumerate(rows)]
    return [*out, (None, rows[2]), out[5], (None, None)]


@pytest.mark.parametrize("dense", [7, 2048])
def test_embeddings_linked_by_cosine(spark, dense):
    rows = _vectors()
    frame = spark.createDataFrame([(i, v, 0, 1) for i, v in rows], "vec_id long, embedding array<double>, leaf int, node int")
    got = projection_forest.near_duplicates(frame, leaf=40, dense=dense).collect()
    good = [k for k, (_, v) in enumerate(rows) if v is not None and len(v) == 16 and None not in v and np.isfinite(v).all() and any(v)]
    x = np.array([rows[k][1] for k in good], float)
    x /= np.linalg.norm(x, axis=1)[:, None]
    near = x @ x.T >= 0.9
    np.fill_diagonal(near, False)
    reached = corpus.classes(list(range(len(good))), list(zip(*(a.tolist() for a in np.nonzero(near)))))
    least = defaultdict(list)
    for k, r in reached.items():
        least[r].append(rows[good[k]][0])
    want = Counter((rows[k][0], 0, rows[k][0]) for k in set(range(len(rows))) - set(good))
    want.update((rows[g][0], int(near[k].sum()), min(i for i in least[reached[k]] if i is not None)) for k, g in enumerate(good))
    assert sum(n for _, n, _ in want) > 1000
    found = Counter((r.vec_id, r.n_links, r.component_id) for r in got)
    exact = sum((found & want).values())
    assert exact >= 0.98 * len(rows), (found - want, want - found)
    assert sum(r.n_links for r in got) >= 0.98 * sum(k[1] * n for k, n in want.items())
    assert sum(r.n_links for r in got) <= sum(k[1] * n for k, n in want.items())
    assert all(r.kept == (r.vec_id == r.component_id) for r in got)


def test_no_rows(docs, spark):
    none = docs.limit(0)
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>")
    model = additive_model.train(none, spark.createDataFrame([], "doc_id long, quality int"), F.lit(True))
    for made in (
        packing.pack_documents(none), sentence_pieces.encode(none), suffix_tree.score(none, F.lit(True)), additive_model.score(none, model), projection_forest.near_duplicates(empty)
    ):
        assert made.count() == 0
