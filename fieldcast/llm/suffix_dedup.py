"""Repeated passages by a depth-limited radix sort of suffixes.

Every byte starts a suffix, which counts only through its first `threshold` bytes. Suffixes
are parted by one digit after the other, the most selective first, and a group of one is
done. Groups that are left after the last digit are exactly the repeated windows.

1. The first digit of a suffix is the `digit`-byte stretch of its window whose hash is
   least, with its place there: equal windows agree in it. Neighbouring suffixes share it, so
   a run of them is sorted as one entry, and entries whose stretch occurs once are done.
2. The second digit is everything that the windows of a run cover. Runs alike in it are
   repeats as a whole.
3. Runs that share the first digit but not the second are taken apart into their suffixes,
   one run for each second digit, and these are sorted by all `threshold` bytes.

A digit is compared by a 64-bit hash; the second and third hold the first as well. What the
sort orders inside a digit is that hash, not the bytes themselves: only equality matters.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from fieldcast.llm import chunks as c

THRESHOLD, DIGIT = 200, 40
#: Suffixes whose first digit is worked out at once.
SLICE = 1 << 19

SPANS = "doc_id bigint, n_bytes bigint, n_removed bigint, starts array<bigint>, ends array<bigint>, kept binary"


def _entries(texts: c.Texts, threshold: int, digit: int, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """first digit, second digit, first and last suffix of every run of suffixes that share their first digit."""
    n = len(texts.bytes)
    step = np.zeros(n + 1, np.int64)
    np.add.at(step, texts.at[:-1], 1)
    np.add.at(step, np.maximum(texts.at[:-1], texts.at[1:] - threshold + 1), -1)
    valid = np.cumsum(step[:n]) > 0
    found = []
    for a in range(0, n, size):
        b = min(n, a + size)
        if not valid[a:b].any():
            continue
        stretch = c.Stretches(c.BYTES[texts.bytes[a : b + threshold - 1]])
        hashes = stretch.rolling(digit)
        placed = (hashes & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(hashes), dtype=np.uint64)
        least = c.sliding_least(placed, threshold - digit + 1)
        value, first, last = c.anchors(least, valid[a : a + len(least)])
        at = (value & np.uint64(0xFFFFFFFF)).astype(np.int64)
        one = hashes[at]
        # The place of the digit in the windows is part of both digits' identity through first and last.
        two = c.mix(stretch.hash(first, last + threshold) ^ (one * np.uint64(3)) ^ c.mix(((at - first) << 20 | (last - first)).astype(np.uint64)))
        found.append((one, two, first + a, last + a))
    return tuple(np.concatenate(x) for x in zip(*found)) if found else (np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64))


def _windows(texts: c.Texts, one: np.ndarray, first: np.ndarray, last: np.ndarray, threshold: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The hash of each suffix of some runs through the threshold, and where it starts."""
    starts, of = c.spread(first, last)
    out = np.empty(len(starts), np.uint64)
    order = np.argsort(starts, kind="stable")
    placed = starts[order]
    edges = np.searchsorted(placed, np.arange(0, len(texts.bytes) + size, size))
    for k, (x, y) in enumerate(zip(edges[:-1], edges[1:])):
        if y > x:
            a = k * size
            stretch = c.Stretches(c.BYTES[texts.bytes[a : a + size + threshold]])
            out[order[x:y]] = stretch.hash(placed[x:y] - a, placed[x:y] - a + threshold)
    return c.mix(out ^ (one[of] * np.uint64(5))), starts


def _counted(keys: np.ndarray, *loads: np.ndarray) -> tuple[np.ndarray, ...]:
    """Sorted distinct keys, whether each occurs twice, the index of an occurrence, and for each key given its place among them."""
    distinct, at, back, counts = np.unique(keys, return_index=True, return_inverse=True, return_counts=True)
    return distinct, counts > 1, at, back


def _repeated(kind: int, keys: np.ndarray, load: np.ndarray, chunk: np.ndarray) -> np.ndarray:
    """Bit 0: the key occurs twice in all; bit 1: this chunk is the first that has it."""
    groups = c.Groups(keys)
    twice = (groups.sizes > 1) | groups.of(np.logical_or, load.astype(bool))
    return (groups.back(twice).astype(np.uint8)) | ((groups.back(groups.of(np.minimum, chunk)) == chunk).astype(np.uint8) << 1)


CONTEXT = np.dtype([("two", "<u8"), ("several", "u1")])


def _second(kind: int, keys: np.ndarray, load: np.ndarray, chunk: np.ndarray) -> np.ndarray:
    """Kind 0: as above, of second digits. Kind 1: whether a first digit has more than one second digit."""
    if kind == 0:
        return _repeated(kind, keys, load, chunk)
    groups = c.Groups(keys)
    two = load["two"].copy()
    return groups.back((groups.of(np.minimum, two) != groups.of(np.maximum, two)) | groups.of(np.logical_or, load["several"].astype(bool))).astype(np.uint8)


class _State:
    """What a chunk knows after each step; worked out anew each time from its texts and the answers."""

    def __init__(self, texts: c.Texts, threshold: int, digit: int, bits: int, size: int):
        self.texts, self.threshold, self.size = texts, threshold, size
        self.one, self.two, self.first, self.last = _entries(texts, threshold, digit, size)
        self.keys, self.twice, _, self.back = _counted(c.cut(self.one, bits, 5))

    def alive(self, said: c.Said) -> None:
        """Drop the runs whose first digit occurs once."""
        keep = (said.of(0, 0, np.uint8) & 1).astype(bool)[self.back] if len(self.back) else np.zeros(0, bool)
        self.one, self.two, self.first, self.last = self.one[keep], self.two[keep], self.first[keep], self.last[keep]
        self.two_keys, self.two_twice, self.two_at, self.two_back = _counted(self.two)
        self.one_keys, _, self.one_at, self.one_back = _counted(self.one)

    def contexts(self) -> np.ndarray:
        load = np.zeros(len(self.one_keys), CONTEXT)
        load["two"] = self.two[self.one_at]
        np.logical_or.at(load["several"].view(bool), self.one_back, self.two != load["two"][self.one_back])
        return load

    def apart(self, said: c.Said) -> None:
        """Which runs repeat as a whole, and the suffixes of those that are taken apart."""
        two, split = said.of(1, 0, np.uint8), said.of(1, 1, np.uint8)
        self.as_whole = (two & 1).astype(bool)[self.two_back]
        mine = np.zeros(len(self.two), bool)
        mine[self.two_at] = two & 2 > 0
        part = mine & split[self.one_back].astype(bool)
        windows, self.starts = _windows(self.texts, self.one[part], self.first[part], self.last[part], self.threshold, self.size)
        self.window_keys, self.window_twice, _, self.window_back = _counted(windows)


def repeated_spans(docs: DataFrame, text: str = "text", key: str = "doc_id", threshold: int = THRESHOLD, digit: int = DIGIT, whole_characters: bool = False, carry: list[str] | None = None, slice_bytes: int = SLICE) -> DataFrame:
    """doc_id, n_bytes, n_removed, starts and ends of the maximal removed spans, kept bytes: a row for each row of `docs`.

    The columns that `carry` names come along as carried_0, carried_1, ... of that row.

    A byte is removed if a stretch of `threshold` bytes over it also starts anywhere else in
    the texts, the same one included; stretches are judged on the input and may overlap.
    `whole_characters` keeps a character of which some bytes would stay, so that what is kept
    is text.

    A null text is empty and loses nothing; texts shorter than the threshold lose nothing; a
    null id is as good as any; a row that occurs twice repeats itself and loses all its
    bytes if it is long enough. No rows give no rows; other columns are not looked at.
    """
    carried = {f"carried_{i}": name for i, name in enumerate(carry or [])}
    chunks, bits = c.chunked(docs, text, key, extra={k: docs[name] for k, name in carried.items()})
    schema = ", ".join([SPANS, *(f"{k} {docs.schema[name].dataType.simpleString()}" for k, name in carried.items())])
    state = lambda texts: _State(texts, threshold, digit, bits, slice_bytes)

    def first(texts: c.Texts, said: c.Said) -> list[c.Question]:
        s = state(texts)
        return [(0, s.keys, s.twice.view(np.uint8))]

    def second(texts: c.Texts, said: c.Said) -> list[c.Question]:
        s = state(texts)
        s.alive(said)
        return [(0, s.two_keys, s.two_twice.view(np.uint8)), (1, s.one_keys, s.contexts())]

    def third(texts: c.Texts, said: c.Said) -> list[c.Question]:
        s = state(texts)
        s.alive(said)
        s.apart(said)
        return [(0, s.window_keys, s.window_twice.view(np.uint8))]

    def result(texts: c.Texts, said: c.Said) -> pa.Table:
        s = state(texts)
        s.alive(said)
        s.apart(said)
        hit = (said.of(2, 0, np.uint8) & 1).astype(bool)[s.window_back] if len(s.window_back) else np.zeros(0, bool)
        gone = c.covered(len(texts.bytes), np.concatenate([s.first[s.as_whole], s.starts[hit]]), np.concatenate([s.last[s.as_whole], s.starts[hit]]) + threshold)
        if whole_characters and len(gone):
            lead = np.flatnonzero((texts.bytes & 0xC0) != 0x80)
            gone = np.repeat(np.logical_and.reduceat(gone, lead), np.diff(np.append(lead, len(gone))))
        rows = {name: [] for name in ("n_bytes", "n_removed", "starts", "ends", "kept")}
        for a, b in zip(texts.at[:-1].tolist(), texts.at[1:].tolist()):
            starts, ends = c.runs(gone[a:b])
            rows["n_bytes"].append(b - a), rows["n_removed"].append(int((ends - starts).sum())), rows["starts"].append(starts), rows["ends"].append(ends)
            rows["kept"].append((texts.bytes[a:b][~gone[a:b]] if len(starts) else texts.bytes[a:b]).tobytes())
        whole, listed = pa.int64(), pa.list_(pa.int64())
        kinds = {"n_bytes": whole, "n_removed": whole, "starts": listed, "ends": listed, "kept": pa.binary()}
        return pa.table({"doc_id": texts.ids} | {name: pa.array(v, kinds[name]) for name, v in rows.items()} | texts.extra)

    bit = np.dtype(np.uint8)
    said = [c.answer(c.ask(chunks, [], 0, first, bits, 5), _repeated, bits, {0: bit}, 5)]
    said.append(c.answer(c.ask(chunks, said, 1, second, bits), _second, bits, {0: bit, 1: CONTEXT}))
    said.append(c.answer(c.ask(chunks, said, 2, third, bits), _repeated, bits, {0: bit}))
    return c.finish(chunks, said, result, schema)
