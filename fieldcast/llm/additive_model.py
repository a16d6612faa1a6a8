"""Text quality by a generalised additive model with pairwise interactions.

Each feature of a text is cut into quantile bins. Boosting goes round the features in turn:
a tree with a few leaves is fitted to the current residual over one feature's bins and its
leaf values are added, damped, to that feature's lookup table. Pairs of features then get
tables of their own the same way, on what the single features leave. A score is the sum of
one table entry for each feature and pair, put through the logistic curve.

The tables are fitted on the driver from at most `sample` labelled rows, chosen by a hash of
their ids; everything else runs inside tasks on whole texts, and the fitted tables, whose
size is set by bins and features alone, travel with them.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldcast.llm.rows import utf8

#: Labelled rows a model is fitted on at most: the bound of what the driver holds.
SAMPLE = 20_000
BINS, PAIR_BINS, PAIRS, LEAVES, ROUNDS, RATE = 48, 10, 8, 4, 250, 0.15

FEATURES = [
    "log_bytes", "log_words", "word_bytes", "letters", "digits", "upper", "spaces", "marks", "odd_marks", "high_bytes", "distinct_words",
    "common_word", "repeated_next", "log_lines", "line_bytes", "distinct_lines", "short_lines", "ended_lines", "byte_entropy", "packed", "longest_word", "marked_words",
]

_LETTER, _DIGIT, _UPPER, _SPACE, _MARK, _ODD = (np.zeros(256, bool) for _ in range(6))
_LETTER[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True
_DIGIT[48:58] = True
_UPPER[65:91] = True
_SPACE[[32, *range(9, 14)]] = True
_MARK[33:127] = True
_MARK &= ~(_LETTER | _DIGIT)
_ODD |= _MARK
_ODD[[ord(c) for c in ".,;:'\"!?-()"]] = False


def features(text: bytes) -> list[float]:
    """The figures of one whole text, in the order of FEATURES; an empty text has zeros."""
    if not text:
        return [0.0] * len(FEATURES)
    counts = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    n = len(text)
    words, lines = text.split(), text.split(b"\n")
    each: dict[bytes, int] = {}
    for word in words:
        each[word] = each.get(word, 0) + 1
    w = max(1, len(words))
    share = counts[counts > 0] / n
    sizes = [len(x) for x in lines]
    return [
        np.log1p(n), np.log1p(len(words)), sum(map(len, each)) / max(1, len(each)), counts[_LETTER].sum() / n, counts[_DIGIT].sum() / n, counts[_UPPER].sum() / n,
        counts[_SPACE].sum() / n, counts[_MARK].sum() / n, counts[_ODD].sum() / n, counts[128:].sum() / n, len(each) / w, max(each.values(), default=0) / w,
        sum(a == b for a, b in zip(words, words[1:])) / w, np.log1p(len(lines)), n / len(lines), len(set(lines)) / len(lines), sum(s < 20 for s in sizes) / len(lines),
        sum(x[-1:] in (b".", b"!", b"?") for x in lines) / len(lines), float(-(share * np.log2(share)).sum()), len(zlib.compress(text, 1)) / n,
        np.log1p(max(map(len, each), default=0)), sum(c for x, c in each.items() if not x[-1:].isalnum() and x[-1] < 128) / w,
    ]


@dataclass
class Model:
    """Bin edges and lookup tables."""

    intercept: float = 0.0
    edges: list[np.ndarray] = field(default_factory=list)
    tables: list[np.ndarray] = field(default_factory=list)
    pairs: list[tuple[int, int]] = field(default_factory=list)
    coarse: list[np.ndarray] = field(default_factory=list)
    pair_tables: list[np.ndarray] = field(default_factory=list)

    def score(self, x: np.ndarray) -> np.ndarray:
        """Scores from 0 to 1 of rows of figures: one table entry is added for each feature and pair."""
        total = np.full(len(x), self.intercept)
        for j, (edges, table) in enumerate(zip(self.edges, self.tables)):
            total += table[np.searchsorted(edges, x[:, j], "right")]
        for (i, j), table in zip(self.pairs, self.pair_tables):
            total += table[np.searchsorted(self.coarse[i], x[:, i], "right"), np.searchsorted(self.coarse[j], x[:, j], "right")]
        return 1 / (1 + np.exp(-np.clip(total, -40, 40)))


def _edges(x: np.ndarray, bins: int) -> np.ndarray:
    return np.unique(np.quantile(x, np.linspace(0, 1, bins + 1)[1:-1])) if len(x) else np.zeros(0)


def _tree(slope: np.ndarray, weight: np.ndarray, leaves: int) -> np.ndarray:
    """Values by bin of a tree with at most so many leaves: the best cut of any leaf is made again and again."""
    s, w = np.concatenate([[0], np.cumsum(slope)]), np.concatenate([[0], np.cumsum(weight)])
    value = lambda a, b: (s[b] - s[a]) ** 2 / (w[b] - w[a] + 1.0)
    parts = [(0, len(slope))]
    while len(parts) < leaves:
        best = (1e-9, None, None)
        for a, b in parts:
            if b - a > 1:
                at = np.arange(a + 1, b)
                gain = value(a, at) + value(at, b) - value(a, b)
                k = int(gain.argmax())
                best = max(best, (float(gain[k]), (a, b), int(at[k])), key=lambda g: g[0])
        if best[1] is None:
            break
        parts.remove(best[1])
        parts += [(best[1][0], best[2]), (best[2], best[1][1])]
    out = np.zeros(len(slope))
    for a, b in parts:
        out[a:b] = (s[b] - s[a]) / (w[b] - w[a] + 1.0)
    return out


def _cross(slope: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, float]:
    """Values of the best tree of one cut along each of two features, and its gain."""
    s, w = slope.cumsum(0).cumsum(1), weight.cumsum(0).cumsum(1)
    quarters = lambda t: (t, t[-1:, :] - t, t[:, -1:] - t, t[-1, -1] - t[-1:, :] - t[:, -1:] + t)
    # upper left, lower left, upper right, lower right of every crossing
    gain = sum(a**2 / (b + 1.0) for a, b in zip(quarters(s), quarters(w))) - s[-1, -1] ** 2 / (w[-1, -1] + 1.0)
    i, j = np.unravel_index(int(gain.argmax()), gain.shape)
    values = [a[i, j] / (b[i, j] + 1.0) for a, b in zip(quarters(s), quarters(w))]
    out = np.empty_like(slope)
    out[: i + 1, : j + 1], out[i + 1 :, : j + 1], out[: i + 1, j + 1 :], out[i + 1 :, j + 1 :] = values
    return out, float(gain[i, j])


def fit(x: np.ndarray, y: np.ndarray, rounds: int = ROUNDS, rate: float = RATE, bins: int = BINS, pair_bins: int = PAIR_BINS, pairs: int = PAIRS, leaves: int = LEAVES) -> Model:
    """Boost lookup tables for the chance of y = 1; no rows give a model that scores 0.5."""
    if not len(x):
        return Model(edges=[np.zeros(0)] * len(FEATURES), tables=[np.zeros(1)] * len(FEATURES))
    share = (y.sum() + 1) / (len(y) + 2)
    model = Model(float(np.log(share / (1 - share))), [_edges(c, bins) for c in x.T], coarse=[_edges(c, pair_bins) for c in x.T])
    at = [np.searchsorted(e, c, "right") for e, c in zip(model.edges, x.T)]
    model.tables = [np.zeros(len(e) + 1) for e in model.edges]
    total = np.full(len(y), model.intercept)
    for _ in range(rounds):
        for j, b in enumerate(at):
            p = 1 / (1 + np.exp(-total))
            step = rate * _tree(np.bincount(b, y - p, len(model.tables[j])), np.bincount(b, p * (1 - p), len(model.tables[j])), leaves)
            model.tables[j] += step
            total += step[b]
    wide = [np.searchsorted(e, c, "right") for e, c in zip(model.coarse, x.T)]
    shape = [len(e) + 1 for e in model.coarse]

    def crossed(i: int, j: int) -> tuple[np.ndarray, float]:
        p = 1 / (1 + np.exp(-total))
        cell = wide[i] * shape[j] + wide[j]
        grid = lambda v: np.bincount(cell, v, shape[i] * shape[j]).reshape(shape[i], shape[j])
        return _cross(grid(y - p), grid(p * (1 - p)))

    ranked = sorted(((crossed(i, j)[1], i, j) for i in range(len(shape)) for j in range(i)), reverse=True)[:pairs]
    model.pairs = [(i, j) for _, i, j in ranked]
    model.pair_tables = [np.zeros((shape[i], shape[j])) for i, j in model.pairs]
    for _ in range(rounds // 2):
        for (i, j), table in zip(model.pairs, model.pair_tables):
            step = rate * crossed(i, j)[0]
            table += step
            total += step[wide[i], wide[j]]
    return model


def _columns(text: pa.Array) -> np.ndarray:
    return np.array([features(t) for t in utf8(text)], float).reshape(-1, len(FEATURES))


def figures(text: Column) -> Column:
    """The figures of each whole text."""

    @F.arrow_udf("array<double>")
    def run(text: pa.Array) -> pa.Array:
        return pa.array([features(t) for t in utf8(text)], pa.list_(pa.float64()))

    return run(text.cast("string"))


def train(docs: DataFrame, labels: DataFrame, learn: Column, text: str = "text", key: str = "doc_id", label: str = "quality", sample: int = SAMPLE) -> Model:
    """A model from the labelled rows that `learn` (of the key) allows, at most `sample` of them by hash of the key.

    Rows without a label or key teach nothing; a key with several labels counts with their mean.
    """
    known = labels.where(F.col(key).isNotNull() & F.col(label).isNotNull()).where(learn).groupBy(F.col(key).cast("bigint").alias("_id")).agg(F.avg(label).alias("_y"))
    known = known.orderBy(F.xxhash64("_id"), "_id").limit(sample)  # the bound that allows the broadcast
    taught = docs.select(F.col(key).cast("bigint").alias("_id"), F.col(text).alias("_of")).join(F.broadcast(known), "_id")
    rows = taught.select("_id", "_y", figures(F.col("_of")).alias("x")).dropDuplicates(["_id"]).orderBy("_id").toArrow()
    x = np.array(rows["x"].to_pylist(), float).reshape(-1, len(FEATURES))
    return fit(x, rows["_y"].to_numpy().astype(float))


def scorer(model: Model) -> Callable[[Column], Column]:
    """A column function from a whole text to its score from 0 to 1."""

    @F.arrow_udf("double")
    def run(text: pa.Array) -> pa.Array:
        return pa.array(model.score(_columns(text)))

    return lambda text: run(text.cast("string"))


def score(docs: DataFrame, model: Model, text: str = "text", key: str = "doc_id") -> DataFrame:
    """doc_id, score: one row for each row of `docs`, from its whole text only.

    A null text scores as an empty one; a row with a null id gets its score; repeated rows
    score alike; no rows give no rows; other columns are not looked at.
    """
    return docs.select(F.col(key).cast("bigint").alias("doc_id"), scorer(model)(F.col(text)).alias("score"))
