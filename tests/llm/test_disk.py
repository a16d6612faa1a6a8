"""What rounds and joins leave on the disks, and which keys near lines share."""

from __future__ import annotations

import random
import time

from pyspark.sql import functions as F

from fieldcast.llm import line_join, suffix_tree
from fieldcast.session import FREE_SHUFFLES, settle
from tests.llm import corpus


def _shuffles(spark) -> set[str]:
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().mkString("\n")
    return {f for f in files.split("\n") if "shuffle_" in f and f.endswith(".data")}


def test_settled_rows_leave_no_shuffle_files(spark):
    before, setting = _shuffles(spark), spark.conf.get(FREE_SHUFFLES)
    rows = settle(spark.range(10_000).groupBy((F.col("id") % 1000).alias("k")).agg(F.sum("id").alias("s")))
    for _ in range(20):
        if not _shuffles(spark) - before:
            break
        time.sleep(0.2)
    assert not _shuffles(spark) - before and spark.conf.get(FREE_SHUFFLES) == setting
    assert rows.count() == 1000 and rows.agg(F.sum("s")).first()[0] == sum(range(10_000))


def test_questions_of_the_suffix_tree_are_gone_when_it_scores(spark):
    docs = corpus.frame(spark, [(i, "kolmi run at sea") for i in range(20)] + [(30, None)])
    plan = suffix_tree.score(docs, F.col("doc_id") % 4 == 1, least=2, gain=0.5)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FlatMapGroupsInArrow") <= 2  # the one that scores; adaptive plans may print it twice


def test_suffix_tree_reads_texts_once(spark):
    docs = corpus.frame(spark, [(i, f"kolmi run at sea {i}") for i in range(20)] + [(30, None), (None, "Kolmi"), (None, "kolmi run"), (30, "")])
    got = suffix_tree.score(docs, F.col("doc_id") % 4 == 1, least=2, gain=0.5)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "keys#" in plan and "texts" not in plan and "text#" not in plan  # words stand in for the texts
    rows = sorted((r.doc_id is None, r.doc_id or 0, r.held_out, r.n_tokens) for r in got.collect())
    assert rows == sorted([(False, i, i % 4 == 1, 6) for i in range(20)] + [(False, 30, False, 1)] * 2 + [(True, 0, False, 2), (True, 0, False, 3)])


def test_near_lines_share_a_key_and_keys_are_few(spark):
    rng = random.Random(7)
    pairs = []
    for n in [*range(1, 34), 63, 64, 65, 127, 128, 129, 250, 257]:
        for _ in range(8):
            a = "".join(rng.choice("abé🙂 x") for _ in range(n))
            b = list(a)
            for _ in range(2):
                k = rng.randrange(len(b) + 1)
                b[k : k + rng.choice([0, 1])] = rng.choice(["", "q", "z"])
            pairs.append((a, "".join(b)))
    frame = spark.createDataFrame(pairs, "a string, b string").where("a != '' AND b != ''")
    keys = lambda x: line_join.line_keys(F.col(x), F.char_length(x), 2)
    got = frame.select("a", "b", F.arrays_overlap(keys("a"), keys("b")).alias("met"), F.size(keys("a")).alias("n")).collect()
    assert all(r.met for r in got if corpus.edits(r.a, r.b) <= 2)
    assert max(r.n for r in got) <= 12 and max(r.n for r in got if len(r.a) == 250) <= 8


def test_texts_of_lines_are_not_shuffled_to_tell_them_apart(spark):
    docs = corpus.frame(spark, [(1, "kolmi run\nkolmi runt")])
    plan = line_join.distinct_lines(docs)._jdf.queryExecution().optimizedPlan()
    assert "line" not in [c.strip().split("#")[0] for c in plan.output().mkString(",").split(",")]
    assert "keys=[line" not in plan.toString() and "Aggregate [line_id" in plan.toString()
