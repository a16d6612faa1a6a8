"""How filters that run one after the other interact: every order of them, from one pass over the texts.

Rows are reduced to the set of filters they fail, and the table to a count for each part
and set. States of the lattice are the sets of filters already applied; an edge applies
one filter more and removes the rows that fail it and none before. Paths through the
lattice are orders: `forward` counts the orders that reach a state, `backward` those that
lead on from it, so forward * backward is the number of orders that use an edge and weighs
its removals for the Shapley total. A step of one order reads the same edge.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldcast.llm.rows import SPACE, whole

#: Bounds of the four filters on a text alone.
LEAST_WORDS, DISTINCT_PERCENT, CAPITAL_PERCENT, SIGNS = 200, 50, 2, "[#$%&*|]"
#: All orders are listed, so the number of filters is bounded.
MOST_FILTERS = 6


def text_filters(text: str) -> dict[str, Column]:
    """Failure of each filter, in the order of their letters."""
    body = whole(text)
    words = F.filter(F.split(body, SPACE + "+"), lambda w: w != "")
    capitals = F.char_length(F.regexp_replace(body, "[^A-Z]+", ""))
    return {
        "A": F.size(words) < LEAST_WORDS,
        "B": F.lit(100).cast("bigint") * F.size(F.array_distinct(words)) < F.lit(DISTINCT_PERCENT).cast("bigint") * F.size(words),
        "C": F.lit(100).cast("bigint") * capitals > F.lit(CAPITAL_PERCENT).cast("bigint") * F.char_length(body),
        "D": body.rlike(SIGNS),
    }


def path_counts(n: int) -> tuple[list[int], list[int]]:
    """For each set of n filters (as bits): the orders that reach it, and those that lead from it to the full set."""
    full = (1 << n) - 1
    forward, backward = [1] + [0] * full, [0] * full + [1]
    for state in range(1, full + 1):
        forward[state] = sum(forward[state ^ 1 << f] for f in range(n) if state >> f & 1)
    for state in reversed(range(full)):
        backward[state] = sum(backward[state | 1 << f] for f in range(n) if not state >> f & 1)
    return forward, backward


def failures(docs: DataFrame, labels: DataFrame, part: str, filters: dict[str, Column], key: str = "doc_id", text: str = "text", copies: str = "E") -> DataFrame:
    """For each part and set of failed filters (bits by letter): rows, those labelled good and those labelled toxic.

    The last filter fails a row whose whole text a row with a smaller id has too, anywhere in the
    table. A null id is no smaller than any and has none smaller; rows repeated with one id are each
    counted. Of several labels of an id, one that says so is enough. A text is known by its SHA-256.
    """
    mask = sum((F.when(failed, F.lit(1 << i)).otherwise(F.lit(0)) for i, failed in enumerate(filters.values())), F.lit(0))
    slim = docs.select(F.col(key).alias("_id"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("_part"), mask.alias("_mask"), F.unhex(F.sha2(F.encode(whole(text), "UTF-8"), 256)).alias("_text"))
    rows = slim.groupBy("_id", "_part", "_mask", "_text").agg(F.count(F.lit(1)).alias("_n"))
    known = labels.groupBy(F.col(key).alias("_id")).agg(F.bool_or(F.col("quality") == 1).alias("_good"), F.bool_or(F.col("toxic") == 1).alias("_toxic"))
    no = F.lit(False)
    marked = rows.join(known, "_id", "left").select("*", F.coalesce("_good", no).alias("good"), F.coalesce("_toxic", no).alias("toxic"))
    kinds = marked.groupBy("_text", "_part", "_mask", "good", "toxic").agg(
        F.sum("_n").alias("n"), F.min("_id").alias("first"), F.coalesce(F.min_by("_n", "_id"), F.lit(0)).alias("at_first"), F.sum(F.when(F.col("_id").isNull(), F.col("_n")).otherwise(0)).alias("unnamed")
    )
    # One text has one set of filters it fails by itself, so this window holds as many rows as the text has parts and labels.
    kinds = kinds.withColumn("smallest", F.min("first").over(Window.partitionBy("_text")))
    fresh = F.col("unnamed") + F.when(F.col("first") == F.col("smallest"), F.col("at_first")).otherwise(0)
    split = F.explode(F.array(F.struct(F.col("_mask").alias("mask"), fresh.alias("n")), F.struct((F.col("_mask") + (1 << len(filters))).alias("mask"), (F.col("n") - fresh).alias("n"))))
    spread = kinds.select(F.col("_part").alias("part"), split.alias("s"), "good", "toxic").select("part", "s.mask", "s.n", "good", "toxic")
    return spread.groupBy("part", "mask").agg(F.sum("n").alias("n"), F.sum(F.when(F.col("good"), F.col("n")).otherwise(0)).alias("good"), F.sum(F.when(F.col("toxic"), F.col("n")).otherwise(0)).alias("toxic"))


def interactions(failed: DataFrame, letters: str) -> DataFrame:
    """One row for each part, order of the filters and step, zeros included; `failed` has part, mask, n, good and toxic."""
    n = len(letters)
    if n > MOST_FILTERS:
        raise ValueError(f"{n} filters have too many orders to list")
    forward, backward = path_counts(n)
    states = range(1 << n)
    alive = lambda of, state: F.sum(F.when(F.col("mask").bitwiseAND(state) == 0, F.col(of)).otherwise(0))
    parts = failed.groupBy("part").agg(
        *[F.array(*[alive(of, s) for s in states]).alias(of) for of in ("n", "good", "toxic")],
        F.array(*[F.sum(F.when(F.col("mask") == 1 << f, F.col("n")).otherwise(0)) for f in range(n)]).alias("alone"),
    )
    lost = lambda of, state, f: F.get(of, F.lit(state)) - F.get(of, F.lit(state | 1 << f))
    shares = [sum((lost("n", s, f) * forward[s] * backward[s | 1 << f] for s in states if not s >> f & 1), F.lit(0).cast("bigint")) for f in range(n)]
    steps = [("".join(letters[f] for f in order), k + 1, order[k], sum(1 << f for f in order[:k])) for order in permutations(range(n)) for k in range(n)]
    listed = ", ".join(f"named_struct('filter_order', '{o}', 'step', {k}, 'f', {f}, 'state', {s}, 'after', {s | 1 << f}, 'alone', {1 << f})" for o, k, f, s in steps)
    out = parts.withColumn("shares", F.array(*shares)).withColumn("at", F.explode(F.expr(f"array({listed})")))
    at = lambda of, place: F.get(of, F.col(f"at.{place}"))
    edge = lambda of: at(of, "state") - at(of, "after")
    return out.select(
        "part", "at.filter_order", "at.step", at("n", "after").alias("kept"), edge("n").alias("removed"), (F.get("n", F.lit(0)) - at("n", "alone") - edge("n")).alias("redundant"),
        at("alone", "f").alias("unique_fails"), edge("good").alias("good_lost"), edge("toxic").alias("toxic_lost"), at("shares", "f").alias("shapley"),
    )


def audit(docs: DataFrame, labels: DataFrame, part: str = "source", text: str = "text", key: str = "doc_id") -> DataFrame:
    """Interactions of the four text filters and the one for copies, in each value of `part` (null: empty).

    An empty table has no parts and so no rows. A null or empty text has no words: it fails A and, if
    one with a smaller id stands anywhere, E. Other columns are not looked at.
    """
    filters = text_filters(text)
    return interactions(failures(docs, labels, part, filters, key, text), "".join(filters) + "E")
