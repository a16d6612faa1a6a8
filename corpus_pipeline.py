"""From raw documents to packed training sequences, stage by stage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldcast.llm import additive_model, jaccard, packing, perfect_hash, suffix_dedup
from fieldcast.llm.queries import remainder, table
from fieldcast.session import settle

#: The stages learn, score and edit with models and hashes that SQL cannot express.
ORACLE_SQL = None


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality model, taught from the labelled ones among them, does not reject.

    Every row is judged by its own text, a null one as empty; rows alike are judged alike.
    """
    model = additive_model.train(docs, table(spark, sf_dir, "labels"), remainder(3) != 1)
    return docs.withColumn("_score", additive_model.scorer(model)(F.col("text"))).where("_score >= 0.5").drop("_score")


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts.

    The longest original stays, then the smallest id, a null id last. A document is known by its id
    and its text, so other texts of an id are judged on their own. Of rows that have both
    alike, up to white space, the longest stays, then the last by text, then any.
    """
    found = perfect_hash.exact_dedup(docs, remainder(2) == 0).where("kept").groupBy("doc_id", "digest").count()
    kept = settle(found.select(F.col("doc_id").alias("_id"), F.col("digest").alias("_digest"), F.col("count").alias("_n")))
    marked = docs.withColumn("_own", perfect_hash.digest("text"))
    met = marked.join(kept.hint("shuffle_hash"), docs["doc_id"].eqNullSafe(kept["_id"]) & (F.col("_own") == F.col("_digest")))
    row = F.struct(*[docs[name] for name in docs.columns])
    fullest = met.where("_n > 1").groupBy("_id", "_digest").agg(F.max_by(row, F.struct(F.char_length("text"), "text")).alias("_row"))
    return met.where("_n = 1").select(*[docs[name] for name in docs.columns]).union(fullest.select("_row.*"))


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, whose five-word shingles have a Jaccard similarity of 0.8 or more.

    SimHash blocks, the method of op8, choose candidates, MinHash bands those that they lose; the exact similarity decides.
    The one with the smallest id stays, a null id last, and of several texts with that id one. Null
    and wordless texts are one group. Rows alike in id and text are one document and stay together.
    """
    first = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "row")).alias("_kept")
    kept = settle(jaccard.near_duplicates(docs).groupBy("component").agg(first).select(F.col("_kept.doc_id").alias("_id"), F.col("_kept.row").alias("_row")))
    mine = F.xxhash64(docs["doc_id"].cast("bigint"), docs["text"].cast("string"))
    return docs.join(kept.hint("shuffle_hash"), (mine == kept["_row"]) & docs["doc_id"].eqNullSafe(kept["_id"]), "left_semi")


def repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document without the passages of 200 bytes and more that stand anywhere else too; characters stay whole.

    n_chars is counted anew; a null text comes out empty.
    """
    others = [name for name in docs.columns if name not in ("doc_id", "text", "n_chars")]
    found = suffix_dedup.repeated_spans(docs, whole_characters=True, carry=others)
    text = F.decode("kept", "UTF-8")
    columns = {"doc_id": F.col("doc_id"), "text": text, "n_chars": F.char_length(text).cast("bigint")} | {name: F.col(f"carried_{i}") for i, name in enumerate(others)}
    return found.select(*[columns[name].alias(name) for name in docs.columns])


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents, packed into sequences."""
    return packing.pack_documents(docs)


STAGES = [("quality classifier", quality), ("exact dedup", exact), ("near duplicates", near), ("repeated passages", repeats), ("packing", pack)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = settle(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
