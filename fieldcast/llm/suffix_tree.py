"""Scores of texts by a probabilistic suffix tree over words.

A state of the tree is a context: the last one, two, ... words. A context is a candidate if
it stands often enough in the training texts and its own suffix is a state. It becomes one
if the next words it predicts diverge from those of its suffix: the log-likelihood that it
gains over its suffix on the training texts, each occurrence discounted, must reach a
threshold. The next-word distribution of a state is discounted and the mass set free goes
to its suffix's distribution in proportion; the root is the add-one word model. A text is
scored word by word in the longest state that is a suffix of what came before.

Words and contexts are counted over all texts in rounds of questions between chunks of texts
and shards of the key space: per depth one round for how often a word follows a context, and
one for what each context gains. Gains are sums over occurrences, which chunks add up by
themselves, so a context before a third of all words is one number for each chunk.
Texts are read once: a chunk writes its distinct words and which of them each token is, and
all rounds and the scores go on from there.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldcast.llm import chunks as c
from fieldcast.session import settle

#: Words of context at most; occurrences and gain (natural log units) a state needs; discount of its counts.
DEPTH, LEAST, GAIN, DISCOUNT = 2, 64, 24.0, 0.6
#: Bytes of a key that travel beside the shard's bits.
WIDTH = 5
#: Larger chunks have fewer repeats of one word pair among them.
CHUNK_BYTES = 6 << 20

SCORES = "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double"
TOTALS = np.dtype("<i8")
#: What a context has gained, and how many different words follow it, in a chunk's share.
WORTH = np.dtype([("gain", "<f4"), ("kinds", "<f4")])

_END = c.mix(np.array([7], np.uint64))[0]


def _total(kind: int, keys: np.ndarray, load: np.ndarray, chunk: np.ndarray) -> np.ndarray:
    groups = c.Groups(keys)
    return groups.back(groups.of(np.add, load.astype(np.int64))).astype(np.uint32)


def _vocabulary(kind: int, keys: np.ndarray, load: np.ndarray, chunk: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Training occurrences of each word; the shard's tokens and distinct words as a note."""
    groups = c.Groups(keys)
    if not len(keys):
        return load, np.zeros(2, TOTALS)
    sums = groups.of(np.add, load.astype(np.int64))
    return groups.back(sums).astype(np.uint32), np.array([sums.sum(), (sums > 0).sum()], TOTALS)


def _kinds(gain: float):
    def decide(kind: int, keys: np.ndarray, load: np.ndarray, chunk: np.ndarray) -> np.ndarray:
        """How many different words follow a context; 0 where it gains too little to be a state."""
        groups = c.Groups(keys)
        if not len(keys):
            return np.zeros(0, np.uint32)
        total = {name: groups.of(np.add, load[name].astype(np.float64)) for name in ("gain", "kinds")}
        return groups.back(np.where(total["gain"] >= gain, np.rint(total["kinds"]), 0).astype(np.uint32))

    return decide


#: What a chunk writes of its texts: ids, marks (1 held out, 2 null id), tokens of each, distinct tokens, which of them each token is.
WORDS = {"ids": np.dtype(np.int64), "marks": np.dtype(np.uint8), "sizes": np.dtype(np.int64), "keys": np.dtype(np.uint64), "back": np.dtype(np.uint32)}


def _words(texts: c.Texts) -> dict[str, np.ndarray]:
    starts, ends, at = c.words(texts)
    n = len(texts.ids)
    at = at + np.arange(n + 1)  # one end token after the words of each text
    tokens = np.full(len(starts) + n, _END, np.uint64)
    word = np.ones(len(tokens), bool)
    word[at[1:] - 1] = False
    tokens[word] = c.word_hashes(texts, starts, ends, lower=True)
    keys, back = c.distinct(tokens)
    null = texts.ids.is_null().to_numpy().astype(np.uint8)
    return {"ids": texts.ids.fill_null(0).to_numpy(), "marks": texts.extra["held"].to_numpy() + 2 * null, "sizes": np.diff(at), "keys": keys, "back": back.astype(np.uint32)}


class _State:
    """What a chunk knows after each step; worked out anew each time from its words and the answers."""

    def __init__(self, words: c.Written, bits: int, least: int):
        self.bits, self.least = bits, least
        marks, sizes = words.arrays["marks"], words.arrays["sizes"]
        self.ids, self.held = pa.array(words.arrays["ids"], mask=marks >= 2), marks % 2 == 1
        self.at = np.concatenate([[0], np.cumsum(sizes)])
        self.keys, self.back = words.arrays["keys"], words.arrays["back"]
        self.tokens = self.keys[self.back]
        self.doc = np.repeat(np.arange(len(sizes)), sizes)
        self.place = np.arange(len(self.tokens)) - self.at[:-1][self.doc]
        self.train = ~self.held[self.doc]

    def counted(self, back: np.ndarray, n: int, of: np.ndarray | slice = slice(None)) -> np.ndarray:
        return np.bincount(back, self.train[of], n).astype(np.uint32)

    def root(self, said: c.Said) -> None:
        notes = said.notes(0, TOTALS).reshape(-1, 2)
        self.n, self.v = (int(x) for x in notes.sum(0))
        self.count = said.of(0, 0, np.uint32)[self.back].astype(np.float64)
        self.log = np.log((self.count + 1) / (self.n + self.v + 1))  # of each token in the state found so far
        self.base = self.log.copy()
        # The context that ends at each token and how often it stands; whether the shorter context before a token is a state.
        self.context, self.often, self.state = self.tokens, self.count, np.ones(len(self.tokens), bool)

    def candidates(self, depth: int) -> None:
        """Tokens whose `depth` words before are a candidate, and what stands before each of them."""
        index = np.flatnonzero((self.place >= depth) & self.state)
        self.of = index[self.often[index - 1] >= self.least]
        before = self.context[self.of - 1]
        self.pairs = c.mix(before * np.uint64(3) + c.mix(self.tokens[self.of] ^ np.uint64(depth)))
        self.pair_keys, self.pair_back = c.distinct(c.cut(self.pairs, self.bits, WIDTH))
        if depth > 1:
            self.context_keys, self.context_back = c.distinct(before)
        else:  # contexts are words, whose order is known
            own = self.back[self.of - 1]
            there = np.bincount(own, minlength=len(self.keys)) > 0
            self.context_keys, self.context_back = self.keys[there], (np.cumsum(there) - 1)[own]

    def followed(self, said: c.Said, depth: int) -> None:
        """How often each candidate's context is followed by its token."""
        self.follow = (said.of(2 * depth - 1, 0, np.uint32)[self.pair_back] if len(self.of) else np.zeros(0)).astype(np.float64)

    def gains(self) -> np.ndarray:
        """What each context gains on this chunk's training texts, and its share of the different words that follow."""
        some = self.train[self.of]
        out = np.zeros(len(self.context_keys), WORTH)
        seen = np.maximum(self.follow, 1)
        gain = np.log((seen - DISCOUNT) / self.often[self.of - 1]) - self.log[self.of]
        out["gain"] = np.bincount(self.context_back, np.where(some, gain, 0.0), len(out))
        out["kinds"] = np.bincount(self.context_back, np.where(some, 1 / seen, 0.0), len(out))
        return out

    def descend(self, said: c.Said, depth: int) -> None:
        """Take up the contexts of this depth that are retained, and let their tokens be predicted from there."""
        kinds = said.of(2 * depth, 0, np.uint32)[self.context_back].astype(np.float64) if len(self.context_back) else np.zeros(0)
        kept = kinds > 0
        of, follow, often = self.of[kept], self.follow[kept], self.often[self.of - 1][kept]
        share = np.maximum(follow - DISCOUNT, 0) / often + DISCOUNT * kinds[kept] / often * np.exp(self.log[of])
        self.log[of] = np.log(np.maximum(share, 1e-300))
        context, n, state = np.zeros(len(self.tokens), np.uint64), np.zeros(len(self.tokens)), np.zeros(len(self.tokens), bool)
        context[self.of] = self.pairs
        n[self.of] = self.follow
        state[of] = True
        self.context, self.often, self.state = context, n, state


def score(docs: DataFrame, held_out: Column, text: str = "text", key: str = "doc_id", depth: int = DEPTH, least: int = LEAST, gain: float = GAIN) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score: one row for each row of `docs`.

    Rows that `held_out` marks teach nothing. Tokens are words in lower case (A-Z only) and
    one end. base_score is the add-one word model's, score the tree's log10 probability.

    A null text is empty and is its end alone; a null mark teaches; a null id is as good as
    any; repeated rows teach twice. No rows give no rows; other columns are not looked at.
    """
    chunks, bits = c.chunked(docs, text, key, CHUNK_BYTES, extra={"held": F.coalesce(held_out, F.lit(False))})
    chunks = c.written(chunks, _words, WORDS)

    def state(words: c.Written, said: c.Said, levels: int, followed: bool) -> _State:
        s = _State(words, bits, least)
        if levels or followed:
            s.root(said)
        for d in range(1, levels + 1):
            s.candidates(d)
            if d < levels or followed:
                s.followed(said, d)
            if d < levels:
                s.descend(said, d)
        return s

    def tokens(words: c.Written, said: c.Said) -> list[c.Question]:
        s = state(words, said, 0, False)
        return [(0, s.keys, s.counted(s.back, len(s.keys)))]

    def pairs(d: int):
        def questions(words: c.Written, said: c.Said) -> list[c.Question]:
            s = state(words, said, d, False)
            return [(0, s.pair_keys, s.counted(s.pair_back, len(s.pair_keys), s.of))] if len(s.of) else []

        return questions

    def contexts(d: int):
        def questions(words: c.Written, said: c.Said) -> list[c.Question]:
            s = state(words, said, d, True)
            return [(0, s.context_keys, s.gains())] if len(s.of) else []

        return questions

    def result(words: c.Written, said: c.Said) -> pa.Table:
        s = state(words, said, depth, True)
        s.descend(said, depth)
        n = len(s.ids)
        per = lambda v: np.bincount(s.doc, v, n) if n else np.zeros(0)
        return pa.table({
            "doc_id": s.ids, "held_out": pa.array(s.held), "n_tokens": pa.array(np.diff(s.at)), "n_known": pa.array(per(s.count > 0).astype(np.int64)),
            "train_tokens": pa.array(np.full(n, s.n)), "base_score": pa.array(per(s.base) / np.log(10)), "score": pa.array(per(s.log) / np.log(10)),
        })

    number, read = np.dtype(np.uint32), lambda own: c.Written(own, WORDS)
    # Each round is a query of its own: only its answers stay, so the disks hold the questions of one round at a time.
    said = [settle(c.answer(c.ask(chunks, [], 0, tokens, bits, everywhere=True, read=read), _vocabulary, bits, {0: number}))]
    for d in range(1, depth + 1):
        said.append(settle(c.answer(c.ask(chunks, said, 2 * d - 1, pairs(d), bits, WIDTH, read=read), _total, bits, {0: number}, WIDTH)))
        said.append(settle(c.answer(c.ask(chunks, said, 2 * d, contexts(d), bits, read=read), _kinds(gain), bits, {0: WORTH})))
    return c.finish(chunks, said, result, SCORES, read)
