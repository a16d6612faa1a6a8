"""A small corpus with every awkward case, and brute-force versions of what the operators return."""

from __future__ import annotations

import random

SCHEMA = "doc_id long, text string, lang string, chunk string, key int, digest string, `group` string, print string, line string, a string, node string"


def texts(seed: int = 5) -> list[tuple[int | None, str | None]]:
    """Own words in several scripts: copies, near copies, shared passages, periodic, empty, blank, null and long texts."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("kolmirunatsedé漢🙂") for _ in range(rng.randint(1, 8)))
    prose = lambda n: " ".join(word() for _ in range(n))
    passage, long_ = prose(60), prose(2500)
    plain = [prose(rng.randint(1, 90)) for _ in range(40)]
    out = plain + [prose(12) + "\n" + passage + "\t" + prose(9), passage, prose(30) + " " + passage, "x" * 450, "tik tok " * 70, "ab\n" * 150]
    out += [long_, long_.replace(" ", "  ", 3), long_[: len(long_) // 2] + " new " + long_[len(long_) // 2 :], "", " \t\n", None, None, "One", "one", "A b\nc", "ab c", "abc"]
    near = prose(80).split()
    out += [" ".join(near[:k] + [word()] + near[k + 1 :]) for k in range(0, 80, 9)]
    out += plain[:3]
    rows: list[tuple[int | None, str | None]] = [(i * 3, t) for i, t in enumerate(out)]
    return [*rows, rows[4], rows[4], (None, out[6]), (None, "only here " * 30)]


def frame(spark, rows):
    """The rows with extra columns whose names the operators use themselves."""
    return spark.createDataFrame([(i, t, "xx", "c", 7, "d", "g", "p", "l", "a", "n") for i, t in rows], SCHEMA).repartition(4)


def edits(a: str, b: str) -> int:
    before = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        now = [i]
        for j, y in enumerate(b, 1):
            now.append(min(before[j] + 1, now[-1] + 1, before[j - 1] + (x != y)))
        before = now
    return before[-1]


def classes(nodes: list, links: list[tuple]) -> dict:
    """The smallest node that each node reaches."""
    parent = {n: n for n in nodes}

    def root(n):
        while parent[n] != n:
            n = parent[n]
        return n

    for a, b in links:
        a, b = sorted((root(a), root(b)))
        parent[b] = a
    return {n: root(n) for n in nodes}
