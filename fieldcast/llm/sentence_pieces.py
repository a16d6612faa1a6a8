"""SentencePiece encoding and decoding with the place of every piece in the original text.

Normalisation takes the longest prefix that the compiled character map knows, again and
again, and records for every character it writes which source bytes it came from. BPE then
merges the pair of the best score, leftmost first, until none is left, and every piece is
projected through that record to its span of source bytes.

Pieces never cross from a word into the space symbol before the next one (this is read off
the vocabulary, not assumed), so words are merged on their own and remembered: their ids,
how many source bytes each id takes, and the bytes they decode to. Where the character map
changes nothing, a batch of texts is cut into words by Arrow, each different word is looked
up once, and ids, spans and decoded texts are put together for the whole batch by numpy. The
memory of a worker is bounded by letters and only saves time.
"""

from __future__ import annotations

import gc
import heapq
import re
import struct
from array import array
from collections.abc import Iterator
from functools import cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldcast.llm.rows import whole

MODEL = public_tokenizers.path("piece_bpe_32k.model")
MARK = "▁"
#: Letters of words that a worker remembers at once, and bytes of texts that are encoded together.
REMEMBERED, TOGETHER = 8 << 20, 2 << 20
#: Up to so many characters the best pair is looked for in a list, beyond in a heap.
SHORT = 32
#: Stands between words while a batch is cut; a text that holds it goes its own way.
CUT = "\x01"

NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6

ENCODED = "doc_id bigint, n_tokens bigint, ids binary, begins binary, ends binary, decoded string"


class CharacterMap:
    """The compiled map: a double-array trie over UTF-8 bytes and the texts its values point at."""

    def __init__(self, blob: bytes):
        size = struct.unpack("<I", blob[:4])[0] if blob else 0
        self.units = np.frombuffer(blob[4 : 4 + size], "<u4").tolist()
        self.texts = blob[4 + size :]

    def longest(self, data: bytes, at: int) -> tuple[int, str | None]:
        """Length of the longest known prefix of data[at:] and what it becomes; 0 and None if there is none."""
        units, node, best = self.units, 0, (0, None)
        if not units:
            return best
        jump = lambda unit: (unit >> 10) << ((unit & 0x200) >> 6)
        node = jump(units[0])
        for i in range(at, len(data)):
            node ^= data[i]
            if node >= len(units) or (unit := units[node]) & 0x800000FF != data[i]:
                break
            node ^= jump(unit)
            if unit >> 8 & 1:
                start = units[node] & 0x7FFFFFFF
                best = i + 1 - at, self.texts[start : self.texts.index(b"\0", start)].decode()
        return best


class Pieces:
    """A BPE model with its normaliser."""

    def __init__(self, path: str):
        from sentencepiece import sentencepiece_model_pb2

        model = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        kinds = [p.type for p in model.pieces]
        if USER in kinds or model.trainer_spec.model_type != 2 or model.trainer_spec.treat_whitespace_as_suffix:
            raise ValueError("only BPE models with leading space symbols and without user-defined symbols are supported")
        spec = model.normalizer_spec
        self.prefix, self.squeeze, self.escape = spec.add_dummy_prefix, spec.remove_extra_whitespaces, spec.escape_whitespaces
        self.map = CharacterMap(spec.precompiled_charsmap)
        self.pieces = [p.piece for p in model.pieces]
        self.ids = {p.piece: i for i, p in enumerate(model.pieces) if p.type in (NORMAL, UNUSED)}
        self.scores = {p.piece: p.score for p in model.pieces if p.type in (NORMAL, UNUSED)}
        self.bytes = [None] * 256
        for i, p in enumerate(model.pieces):
            if p.type == BYTE:
                self.bytes[int(p.piece[3:5], 16)] = i
        self.fallback = model.trainer_spec.byte_fallback
        self.unknown, self.begin, self.end = kinds.index(UNKNOWN), self.pieces.index("<s>"), self.pieces.index("</s>")
        self.kinds = kinds
        surface = {CONTROL: lambda p: b"", UNKNOWN: lambda p: model.trainer_spec.unk_surface.encode(), BYTE: lambda p: bytes([int(p[3:5], 16)])}
        self.surfaces = [surface.get(k, lambda p: p.replace(MARK, " ").encode())(p) for k, p in zip(kinds, self.pieces)]
        pairs = {p[i : i + 2] for p in self.ids for i in range(len(p) - 1)}
        # Where no piece has the two characters side by side, no merge crosses.
        parted = not any(p[0] != MARK and p[1] == MARK for p in pairs)
        lines = not any("\n" in p for p in pairs)
        self.unit = re.compile(f"{MARK}*[^{MARK}\n]+|{MARK}+|\n" if parted and lines else f"{MARK}*[^{MARK}]+|{MARK}+" if parted else r"(?s).+")
        self.cut = f"({self.unit.pattern})" if parted else None
        self.known: dict[str, tuple[bytes, bytes]] = {}
        self.letters = 0
        self.bank = Bank(self)

    def normalise(self, text: str) -> tuple[list[str], list[int], list[int]]:
        """Characters after normalisation, and from which byte to which of the source each of them stands for."""
        data, at, out = text.encode(), 0, []
        while at < len(data):
            n, new = self.map.longest(data, at)
            if not n:
                n = 1 if data[at] < 0x80 else 2 if data[at] < 0xE0 else 3 if data[at] < 0xF0 else 4
                new = data[at : at + n].decode()
            # All that one match becomes starts where the match starts; its last character ends where the match does.
            out += [(ch, at, at if k < len(new) - 1 else at + n) for k, ch in enumerate(new)]
            at += n
        if self.squeeze:
            kept: list[tuple[str, int, int]] = []
            for ch in out:
                if ch[0] != " " or (kept and kept[-1][0] != " "):
                    kept.append(ch)
            while kept and kept[-1][0] in (" ", MARK if self.escape else " "):
                kept.pop()
            out = kept
        if self.prefix and out:
            out.insert(0, (" ", out[0][1], out[0][1]))
        space = MARK if self.escape else " "
        return [space if ch == " " else ch for ch, _, _ in out], [a for _, a, _ in out], [b for _, _, b in out]

    def merge(self, unit: str) -> list[str]:
        """The pieces of a stretch of normalised text."""
        n, scores = len(unit), self.scores
        if n <= SHORT:
            parts, get, none = list(unit), scores.get, -np.inf
            pairs = [get(a + b, none) for a, b in zip(unit, unit[1:])]
            while pairs and (best := max(pairs)) > none:
                i = pairs.index(best)
                parts[i] += parts.pop(i + 1)
                del pairs[i]
                if i < len(pairs):
                    pairs[i] = get(parts[i] + parts[i + 1], none)
                if i:
                    pairs[i - 1] = get(parts[i - 1] + parts[i], none)
            return parts
        parts, after, before = list(unit), list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(-scores[p], i, p) for i in range(n - 1) if (p := unit[i : i + 2]) in scores]
        heapq.heapify(heap)
        while heap:
            _, i, whole_ = heapq.heappop(heap)
            j = after[i] if parts[i] is not None else n
            if j >= n or parts[i] + parts[j] != whole_:
                continue
            parts[i], parts[j], after[i] = whole_, None, after[j]
            if after[i] < n:
                before[after[i]] = i
                if (p := whole_ + parts[after[i]]) in scores:
                    heapq.heappush(heap, (-scores[p], i, p))
            if before[i] >= 0 and (p := parts[before[i]] + whole_) in scores:
                heapq.heappush(heap, (-scores[p], before[i], p))
        return [p for p in parts if p is not None]

    def ids_of(self, piece: str) -> list[int]:
        if piece in self.ids:
            return [self.ids[piece]]
        return [self.bytes[b] for b in piece.encode()] if self.fallback else [self.unknown]

    def _numbers(self, unit: str) -> tuple[list[int], list[int]]:
        """Ids of a stretch and how many source bytes each takes, a space symbol standing for one byte."""
        ids, sizes = [], []
        for piece in self.merge(unit):
            some = self.ids_of(piece)
            ids += some
            sizes += [0] * (len(some) - 1) + [len(piece) if piece.isascii() else len(piece.encode()) - 2 * piece.count(MARK)]
        return ids, sizes

    def _unit(self, unit: str) -> tuple[bytes, bytes]:
        """Both as bytes, remembered."""
        ids, sizes = self._numbers(unit)
        if self.letters >= REMEMBERED:
            self.known, self.letters = {}, 0
        self.letters += len(unit)
        found = self.known[unit] = np.array(ids, np.uint32).tobytes(), np.array(sizes, np.int32).tobytes()
        return found

    def encode(self, text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of a whole text without begin and end, and the span of source bytes of each."""
        plain = not self.map.units and not self.squeeze and self.escape and MARK not in text
        if plain:
            if not text:
                return np.zeros(0, np.uint32), np.zeros(0, np.int32), np.zeros(0, np.int32)
            known = self.known
            found = [known.get(u) or self._unit(u) for u in self.unit.findall((MARK if self.prefix else "") + text.replace(" ", MARK))]
            ids, sizes = np.frombuffer(b"".join([f[0] for f in found]), np.uint32), np.frombuffer(b"".join([f[1] for f in found]), np.int32).copy()
            if self.prefix:
                sizes[0 if sizes[0] else np.flatnonzero(sizes)[0]] -= 1  # the mark in front stands for nothing
            ends = np.cumsum(sizes, dtype=np.int32)
            return ids, ends - sizes, ends
        chars, begins, ends = self.normalise(text)
        ids, a, b, at = [], [], [], 0
        for unit in self.unit.findall("".join(chars)):
            for piece in self.merge(unit):
                some, to = self.ids_of(piece), at + len(piece)
                ids += some
                a += [begins[at]] * len(some)
                b += [begins[at]] * (len(some) - 1) + [max(ends[at:to])]
                at = to
        if not self.fallback:  # neighbouring unknown pieces are one
            keep = [i for i in range(len(ids)) if ids[i] != self.unknown or i + 1 == len(ids) or ids[i + 1] != self.unknown]
            firsts = [i for i in range(len(ids)) if ids[i] != self.unknown or i == 0 or ids[i - 1] != self.unknown]
            ids, a, b = [ids[i] for i in keep], [a[i] for i in firsts], [b[i] for i in keep]
        return np.array(ids, np.uint32), np.array(a, np.int32), np.array(b, np.int32)

    def decode(self, ids: list[int]) -> str:
        """The text of some ids: control pieces are nothing, the mark in front is dropped, a byte that is no text is U+FFFD."""
        kinds, surfaces = self.kinds, self.surfaces
        strip = 0  # marks in front that are dropped: one, or where white space is squeezed one of each piece until there is text
        for i in ids if self.prefix or self.squeeze else []:
            if kinds[i] != CONTROL:
                marked = kinds[i] in (NORMAL, UNUSED) and self.pieces[i].startswith(MARK)
                strip += marked
                if not (marked and self.squeeze and self.pieces[i] == MARK):
                    break
        if not any(kinds[i] == CONTROL for i in ids[1:-1]):
            try:
                return b"".join([surfaces[i] for i in ids])[strip:].decode()
            except UnicodeDecodeError:
                pass
        # Bytes that follow each other are read together, and only those.
        runs_: list[tuple[bool, bytearray]] = []
        for i in ids:
            if not runs_ or runs_[-1][0] != (kinds[i] == BYTE) or kinds[i] == CONTROL:
                runs_.append((kinds[i] == BYTE, bytearray()))
            runs_[-1][1].extend(surfaces[i])
        return "".join(self._mend(bytes(run)) if of_bytes else run.decode() for of_bytes, run in runs_)[strip:]

    @staticmethod
    def _mend(data: bytes) -> str:
        out, at = [], 0
        while at < len(data):
            for n in (1, 2, 3, 4):
                try:
                    out.append(data[at : at + n].decode())
                    at += n
                    break
                except UnicodeDecodeError:
                    continue
            else:
                out.append("�")
                at += 1
        return "".join(out)


    def together(self, text: str) -> bool:
        """Whether a text can be encoded with others."""
        return bool(text) and self.cut is not None and not self.map.units and not self.squeeze and self.escape and MARK not in text and CUT not in text

    def encode_together(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Ids with begin and end, where each text's begin, begins and ends of their spans, decoded bytes, and where each text's begin."""
        marked = pc.replace_substring(texts.cast(pa.large_string()), " ", MARK)
        if self.prefix:
            marked = pc.binary_join_element_wise(pa.scalar(MARK, pa.large_string()), marked, pa.scalar("", pa.large_string()))
        split = pc.split_pattern(pc.replace_substring_regex(marked, self.cut, "\\1" + CUT), CUT)
        words = split.flatten().dictionary_encode()
        bank = self.bank
        unit = bank.places(words.dictionary.to_pylist())
        ends = np.cumsum(split.value_lengths().to_numpy(zero_copy_only=False)).astype(np.int64)
        firsts = np.concatenate([[0], ends[:-1]])
        codes = unit[words.indices.to_numpy(zero_copy_only=False)]
        leads = np.frombuffer(bank.marked, np.uint8)[codes[firsts]].astype(np.int64)
        codes = np.insert(codes, np.column_stack([firsts, ends]).ravel(), np.tile([bank.BEGIN, bank.END], len(ends)))
        last = ends + 2 * np.arange(1, len(ends) + 1)

        def gather(flat: np.ndarray, stops: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            begin = np.concatenate([[0], stops])[codes]
            length = stops[codes] - begin
            after = np.cumsum(length)
            return flat[np.arange(after[-1]) + np.repeat(begin - (after - length), length)], np.concatenate([[0], after[last - 1]])

        id_stops, text_stops = np.frombuffer(bank.id_stops, np.int64), np.frombuffer(bank.text_stops, np.int64)
        ids, at = gather(np.frombuffer(bank.ids, np.uint32), id_stops)
        sizes = gather(np.frombuffer(bank.sizes, np.int32), id_stops)[0].astype(np.int64)
        if self.prefix:  # the mark in front stands for nothing
            some = np.flatnonzero(sizes)
            sizes[some[np.searchsorted(some, at[:-1])]] -= 1
        total = np.cumsum(sizes)
        stop = total - np.repeat(np.concatenate([[0], total])[at[:-1]], np.diff(at))
        text, begun = gather(np.frombuffer(bank.text, np.uint8), text_stops)
        if self.prefix:  # and is nothing again
            drop = np.flatnonzero(leads)
            text = np.delete(text, begun[:-1][drop])
            begun = begun - np.concatenate([[0], np.cumsum(leads)])
        return ids, at, (stop - sizes).astype(np.int32), stop.astype(np.int32), text, begun


class Bank:
    """Words with their ids, the source bytes of each id and their decoded bytes, end to end; a word is known by its place."""

    BEGIN, END = 0, 1

    def __init__(self, model: Pieces):
        self.model = model
        self._empty()

    def _empty(self) -> None:
        self.known, self.letters = {"": 2}, 0
        self.ids, self.sizes, self.text, self.marked, self.id_stops, self.text_stops = bytearray(), bytearray(), bytearray(), bytearray(), array("q"), array("q")
        for numbers in ([self.model.begin], [self.model.end], []):
            self._add(numbers, [0] * len(numbers), b"", False)

    def _add(self, numbers: list[int], sizes: list[int], text: bytes, marked: bool) -> None:
        self.ids += array("I", numbers).tobytes()
        self.sizes += array("i", sizes).tobytes()
        self.text += text
        self.marked.append(marked)
        self.id_stops.append(len(self.ids) // 4)
        self.text_stops.append(len(self.text))

    def places(self, words: list[str]) -> np.ndarray:
        """The place of each word; those not known are merged."""
        if self.letters >= REMEMBERED:
            self._empty()
        model, known = self.model, self.known
        kinds, pieces_, surfaces = model.kinds, model.pieces, model.surfaces
        # Nothing here refers to itself, and the collector would walk the whole memory again and again.
        collecting = gc.isenabled()
        gc.disable()
        try:
            for word in words:
                if word not in known:
                    numbers, sizes = model._numbers(word)
                    known[word] = len(self.marked)
                    self._add(numbers, sizes, b"".join([surfaces[i] for i in numbers]), kinds[numbers[0]] in (NORMAL, UNUSED) and pieces_[numbers[0]][0] == MARK)
                    self.letters += len(word)
        finally:
            if collecting:
                gc.enable()
        return np.fromiter(map(known.__getitem__, words), np.int64, len(words))


@cache
def pieces(path: str = MODEL) -> Pieces:
    return Pieces(path)


def encode(docs: DataFrame, text: str = "text", key: str = "doc_id", model: str = MODEL, decoded: bool = True) -> DataFrame:
    """doc_id, n_tokens, ids, begins, ends, decoded: one row for each row of `docs`.

    ids (begin and end ids included) and the source bytes from which to which each piece
    goes are arrays of 32-bit little-endian numbers in one binary value each; begin and end
    ids stand at nothing. A character that became several byte pieces belongs to the last.

    A null text is empty: its ids are begin and end. Texts of any length are encoded whole;
    a null id is as good as any; repeated rows get a row each. No rows give no rows; other
    columns are not looked at.
    """

    names = ["doc_id", "n_tokens", "ids", "begins", "ends", "decoded"]

    def binary(values: np.ndarray, at: np.ndarray, kind: pa.DataType = pa.binary()) -> pa.Array:
        width = values.dtype.itemsize
        wide = pa.large_string() if kind == pa.string() else pa.large_binary()
        return pa.Array.from_buffers(wide, len(at) - 1, [None, pa.py_buffer(np.ascontiguousarray(at * width)), pa.py_buffer(np.ascontiguousarray(values))]).cast(kind)

    def many(own: Pieces, ids: pa.Array, texts: pa.Array) -> pa.RecordBatch:
        found, at, begins, ends, back, begun = own.encode_together(texts)
        shown = binary(back, begun, pa.string()) if decoded else pa.nulls(len(ids), pa.string())
        return pa.RecordBatch.from_arrays([ids, pa.array(np.diff(at), pa.int64()), binary(found, at), binary(begins, at), binary(ends, at), shown], names)

    def one(own: Pieces, id_: int | None, text: str) -> dict:
        ids, begins, ends = own.encode(text)
        ids = np.concatenate([[own.begin], ids, [own.end]]).astype(np.uint32)
        last = ends[-1:] if len(ends) else np.zeros(1, np.int32)
        begins, ends = (np.concatenate([np.zeros(1, np.int32), x, last]).astype(np.int32) for x in (begins, ends))
        return {"doc_id": id_, "n_tokens": len(ids), "ids": ids.tobytes(), "begins": begins.tobytes(), "ends": ends.tobytes(), "decoded": own.decode(ids.tolist()) if decoded else None}

    schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary()), ("begins", pa.binary()), ("ends", pa.binary()), ("decoded", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = pieces(model)
        for batch in batches:
            ids, texts = batch.column("doc_id"), batch.column("text")
            values = texts.to_pylist()
            joint = np.array([own.together(v) for v in values], bool)
            size = np.cumsum(np.where(joint, np.fromiter(map(len, values), np.int64, len(values)), 0)) // TOGETHER
            for group in np.unique(size[joint]):
                at = pa.array(np.flatnonzero(joint & (size == group)))
                yield many(own, ids.take(at), texts.take(at))
            alone = np.flatnonzero(~joint).tolist()
            if alone:
                yield pa.RecordBatch.from_pylist([one(own, ids[k].as_py(), values[k]) for k in alone], schema)

    return docs.select(F.col(key).cast("bigint").alias("doc_id"), whole(text).alias("text")).mapInArrow(run, ENCODED)
