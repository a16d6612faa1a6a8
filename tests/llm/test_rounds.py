"""Rounds of questions: what travels, and what comes back; and the packing of ids at every width."""

from __future__ import annotations

import numpy as np
import pytest

from fieldcast.llm import chunks as c
from fieldcast.llm import token_files


def _question(step: int):
    def ask(texts: c.Texts, said: c.Said) -> list[c.Question]:
        # From the second step on a chunk asks with what it heard before, so an answer that got lost shows.
        keys = np.unique(c.mix(texts.keys.astype(np.uint64) + np.uint64(step)))
        heard = sum(int(said.of(s, 0, np.uint32).sum()) for s in range(step))
        return [(0, keys, np.full(len(keys), 1 + heard, np.uint32))]

    return ask


def test_answers_of_earlier_steps_stay_with_their_chunks(spark):
    docs = spark.createDataFrame([(i, "word " * (i % 40)) for i in range(400)], "doc_id bigint, text string")
    chunks, bits = c.chunked(docs, chunk_bytes=4096)
    number, echo = np.dtype(np.uint32), lambda kind, keys, load, chunk: load
    said, expect = [], {}
    for step in range(3):
        asked = c.ask(chunks, said, step, _question(step), bits)
        rows = asked.select("step", "chunk", "load").collect()
        assert {r.step for r in rows} == {step}
        for r in rows:
            own = c.unpack(r.load, 4).view(np.uint32).ravel()
            assert set(own.tolist()) == {1 + sum(expect.get(r.chunk, []))}
            expect.setdefault(r.chunk, []).append(int(own.sum()))
        said.append(c.answer(asked, echo, bits, {0: number}))
    assert len(expect) > 5 and all(len(x) == 3 for x in expect.values())


@pytest.mark.parametrize("n", [0, 1, 2, 3, 1000, 70_000])
def test_order_is_the_stable_one(n):
    rng = np.random.default_rng(n)
    some = rng.integers(0, 2**64 - 1, n, np.uint64, endpoint=True)
    near = some % np.uint64(5) + np.uint64(2**63 - 2)  # differ in all bits, though not by much
    low = np.where(rng.random(n) < 0.5, some & np.uint64(7), some >> np.uint64(40) << np.uint64(40))  # some only in bits that are cut off
    for keys in (some, some >> np.uint64(24), some % np.uint64(50), near, low, np.full(n, 9, np.uint64), np.sort(some), np.sort(low)[::-1]):
        assert np.array_equal(c.order(keys), np.argsort(keys, kind="stable"))
        for got, want in zip(c.distinct(keys), np.unique(keys, return_inverse=True)):
            assert np.array_equal(got, want)
    rows = some[: n // 2 * 2].reshape(-1, 2)
    assert np.array_equal(c.unpack(c.pack(rows), 16).view(np.uint64), rows)


def test_word_hashes_do_not_depend_on_blocks(monkeypatch):
    texts = c.Texts.__new__(c.Texts)
    rng = np.random.default_rng(3)
    texts.bytes = rng.choice(np.frombuffer(b"abcABC  \n\xc3\xa9", np.uint8), 5000)
    texts.bytes[1000:1400] = 120
    texts.at, texts.ids = np.array([0, 0, 17, 3000, 5000]), None
    starts, ends, _ = c.words(texts)
    for lower in (False, True):
        monkeypatch.setattr(c, "HASH_BYTES", 1 << 20)
        whole = c.word_hashes(texts, starts, ends, lower)
        words = [bytes(texts.bytes[a:b]).lower() if lower else bytes(texts.bytes[a:b]) for a, b in zip(starts, ends)]
        assert len(set(zip(words, whole.tolist()))) == len(set(words)) == len(set(whole.tolist()))
        for size in (1, 7, 64, 1000):
            monkeypatch.setattr(c, "HASH_BYTES", size)
            assert np.array_equal(c.word_hashes(texts, starts, ends, lower), whole)
    assert not len(c.word_hashes(texts, starts[:0], ends[:0]))


@pytest.mark.parametrize("most", [1, 256, 1 << 16, (1 << 16) + 1, 1 << 24, (1 << 32) - 1])
def test_pack_gives_the_stated_bytes(most):
    rng = np.random.default_rng(most)
    sizes = np.array([0, 1, 4, 5, 0, 3, 8, 2, 0])
    at = np.concatenate([[0], np.cumsum(sizes)])
    ranks = rng.integers(0, most, at[-1]).astype(np.uint32)
    if len(ranks):
        ranks[-1] = most - 1
    control, controls, data, starts = token_files.pack(ranks, at)
    want_control, want_data = b"", b""
    for k, (a, b) in enumerate(zip(at[:-1].tolist(), at[1:].tolist())):
        assert (controls[k], starts[k]) == (len(want_control), len(want_data))
        lengths = [max(1, -(-int(r).bit_length() // 8)) for r in ranks[a:b]]
        for i in range(0, len(lengths), 4):
            want_control += bytes([sum((n - 1) << 2 * j for j, n in enumerate(lengths[i : i + 4]))])
        want_data += b"".join(int(r).to_bytes(n, "little") for r, n in zip(ranks[a:b], lengths))
    assert control.tobytes() == want_control and data.tobytes() == want_data
    assert np.array_equal(token_files.unpack(control, data, sizes), ranks)
