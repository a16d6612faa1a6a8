"""Repeated passages of words by fixed-block anchors.

1. Every text is a reference: its words are cut into non-overlapping blocks of half a window
   (a window of 20 words holds at least one whole block of 10, wherever it stands). The
   blocks are indexed by hash, and every rolling stretch of 10 words of every text probes the
   index. A stretch that meets a block and occurs twice is live.
2. Every window that could repeat has a live stretch, and windows alike have the same ones:
   each takes the one of the least hash as its anchor. Neighbouring windows share an anchor.
   A hit is extended over all of them at once: where the whole extension occurs earlier,
   all its windows do.
3. Where extensions of one anchor differ, the first of each is taken apart into its windows,
   which are matched one by one. So the ends of every repeat are exact.

The first occurrence, by (doc_id, place), stays. Probes are compared by at least 40 bits,
which may let a stretch in but never leaves one out; extensions and windows by 64.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from fieldcast.llm import chunks as c

WINDOW = 20

KEPT = "doc_id bigint, n_words bigint, n_removed bigint, starts array<bigint>, ends array<bigint>, kept string"
NONE = np.uint64(0xFFFFFFFFFFFFFFFF)

BLOCK, TWICE = 1, 2


def _met(kind: int, keys: np.ndarray, load: np.ndarray, chunk: np.ndarray) -> np.ndarray:
    """Whether a probe meets a block and occurs twice."""
    groups = c.Groups(keys)
    flags = groups.of(np.bitwise_or, load)
    return groups.back((flags & BLOCK > 0) & ((flags & TWICE > 0) | (groups.sizes > 1))).astype(np.uint8)


FIRST = np.dtype([("doc", "<i8")])
CONTEXT = np.dtype([("two", "<u8"), ("several", "u1")])


def _earliest(kind: int, keys: np.ndarray, load: np.ndarray, chunk: np.ndarray) -> np.ndarray:
    """Kind 0: whether this chunk has the first of all occurrences. Kind 1: whether an anchor has more than one extension."""
    groups = c.Groups(keys)
    if kind == 1:
        two = load["two"].copy()
        return groups.back((groups.of(np.minimum, two) != groups.of(np.maximum, two)) | groups.of(np.logical_or, load["several"].astype(bool))).astype(np.uint8)
    doc = load["doc"].copy()
    least = groups.back(groups.of(np.minimum, doc))
    holder = np.where(doc == least, chunk, np.iinfo(np.int64).max)
    return (groups.back(groups.of(np.minimum, holder)) == chunk).astype(np.uint8)


class _State:
    """What a chunk knows after each step; worked out anew each time from its texts and the answers."""

    def __init__(self, texts: c.Texts, window: int, bits: int):
        self.texts, self.window, self.block = texts, window, window // 2
        self.starts, self.ends, self.at = c.words(texts)
        self.stretch = c.Stretches(c.word_hashes(texts, self.starts, self.ends))
        n = len(self.starts)
        self.doc = np.repeat(np.arange(len(texts.ids)), np.diff(self.at))
        left = self.at[1:][self.doc] - np.arange(n)  # words from here to the end of the text
        self.probe = left >= self.block
        self.whole = left >= window
        self.hashes = np.full(n, NONE, np.uint64)
        rolled = self.stretch.rolling(self.block)
        self.hashes[: len(rolled)] = rolled
        aligned = (np.arange(n) - self.at[:-1][self.doc]) % self.block == 0
        self.keys, self.back, counts = np.unique(c.cut(self.hashes[self.probe], bits, 5), return_inverse=True, return_counts=True)
        self.flags = np.where(counts > 1, TWICE, 0).astype(np.uint8)
        self.flags[self.back[aligned[self.probe]]] |= BLOCK

    def anchor(self, said: c.Said) -> None:
        """Anchors of all windows: runs of windows that share one."""
        live = np.zeros(len(self.hashes), bool)
        live[self.probe] = said.of(0, 0, np.uint8)[self.back] > 0 if len(self.back) else False
        place = np.arange(len(live), dtype=np.uint64)
        value = np.where(live, (self.hashes & np.uint64(0xFFFFFFFF00000000)) | place, NONE)
        least = c.sliding_least(value, self.window - self.block + 1)
        value, self.first, self.last = c.anchors(least, self.whole[: len(least)] & (least != NONE))
        at = (value & np.uint64(0xFFFFFFFF)).astype(np.int64)
        self.one = self.hashes[at]
        shape = c.mix(((at - self.first) << 20 | (self.last - self.first)).astype(np.uint64))
        self.two = c.mix(self.stretch.hash(self.first, self.last + self.window) ^ (self.one * np.uint64(3)) ^ shape)
        # Texts are in order of doc_id, so the first index of a key is its first occurrence here.
        self.two_keys, self.two_at = np.unique(self.two, return_index=True)
        self.one_keys, self.one_at, self.one_back = np.unique(self.one, return_index=True, return_inverse=True)

    def docs_of(self, windows: np.ndarray) -> np.ndarray:
        load = np.zeros(len(windows), FIRST)
        load["doc"] = self.texts.keys[self.doc[windows]] if len(windows) else 0
        return load

    def contexts(self) -> np.ndarray:
        load = np.zeros(len(self.one_keys), CONTEXT)
        load["two"] = self.two[self.one_at]
        load["several"][np.unique(self.one_back[self.two != load["two"][self.one_back]])] = 1
        return load

    def apart(self, said: c.Said) -> None:
        """Runs of which every window occurs earlier, and the windows of those that are taken apart."""
        self.earlier = np.ones(len(self.two), bool)
        self.earlier[self.two_at[said.of(1, 0, np.uint8) > 0]] = False
        part = ~self.earlier & (said.of(1, 1, np.uint8)[self.one_back] > 0 if len(self.one_back) else False)
        self.places, of = c.spread(self.first[part], self.last[part])
        hashes = c.mix(self.stretch.hash(self.places, self.places + self.window) ^ (self.one[part][of] * np.uint64(5)))
        self.window_keys, self.window_at = np.unique(hashes, return_index=True)

    def removed(self, said: c.Said) -> np.ndarray:
        """Whether each word lies in a window that also starts earlier."""
        self.apart(said)
        later = np.ones(len(self.places), bool)
        later[self.window_at[said.of(2, 0, np.uint8) > 0]] = False
        starts = np.concatenate([self.first[self.earlier], self.places[later]])
        return c.covered(len(self.starts), starts, np.concatenate([self.last[self.earlier], self.places[later]]) + self.window)


def later_passages(docs: DataFrame, text: str = "text", key: str = "doc_id", window: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_removed, word spans removed, kept words joined by a space: a row for each row of `docs`.

    A word goes if a window of `window` words over it also starts earlier: in a text of a
    smaller doc_id, or before it in the same text. Windows are judged on the input.

    A null text has no words; texts shorter than a window lose nothing. A null id comes after
    all others; rows of one id come in the order of their texts, so that of repeated rows the
    first keeps its words. No rows give no rows; other columns are not looked at.
    """
    chunks, bits = c.chunked(docs, text, key)

    def first(texts: c.Texts, said: c.Said) -> list[c.Question]:
        s = _State(texts, window, bits)
        return [(0, s.keys, s.flags)]

    def second(texts: c.Texts, said: c.Said) -> list[c.Question]:
        s = _State(texts, window, bits)
        s.anchor(said)
        return [(0, s.two_keys, s.docs_of(s.first[s.two_at])), (1, s.one_keys, s.contexts())]

    def third(texts: c.Texts, said: c.Said) -> list[c.Question]:
        s = _State(texts, window, bits)
        s.anchor(said)
        s.apart(said)
        return [(0, s.window_keys, s.docs_of(s.places[s.window_at]))]

    def result(texts: c.Texts, said: c.Said) -> pa.Table:
        s = _State(texts, window, bits)
        s.anchor(said)
        gone = s.removed(said)
        rows = {name: [] for name in ("n_words", "n_removed", "starts", "ends", "kept")}
        for i, (a, b) in enumerate(zip(s.at[:-1].tolist(), s.at[1:].tolist())):
            starts, ends = c.runs(gone[a:b])
            data = texts.bytes[texts.at[i] : texts.at[i + 1]].tobytes().split()
            if len(starts):
                data = [x for x, g in zip(data, gone[a:b].tolist()) if not g]
            rows["n_words"].append(b - a), rows["n_removed"].append(int((ends - starts).sum())), rows["starts"].append(starts), rows["ends"].append(ends)
            rows["kept"].append(b" ".join(data))
        number, listed = pa.int64(), pa.list_(pa.int64())
        kinds = {"n_words": number, "n_removed": number, "starts": listed, "ends": listed, "kept": pa.binary()}
        columns = {name: pa.array(v, kinds[name]) for name, v in rows.items()}
        return pa.table({"doc_id": texts.ids} | columns | {"kept": columns["kept"].cast(pa.string())})

    flag = np.dtype(np.uint8)
    said = [c.answer(c.ask(chunks, [], 0, first, bits, 5), _met, bits, {0: flag}, 5)]
    said.append(c.answer(c.ask(chunks, said, 1, second, bits), _earliest, bits, {0: FIRST, 1: CONTEXT}))
    said.append(c.answer(c.ask(chunks, said, 2, third, bits), _earliest, bits, {0: FIRST}))
    return c.finish(chunks, said, result, KEPT)
