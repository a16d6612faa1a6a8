"""The registered queries of the operators and, where SQL can express one, its SQL twin."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldcast.llm import (
    additive_model, block_dedup, conversation_repair, filter_audit, line_join, packing, perfect_hash, projection_forest, sentence_pieces, simhash, suffix_dedup, suffix_tree, token_files, twins,
)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(name: str, sql: str | None = None):
    def register(build: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = build
        if sql:
            ORACLES[name] = sql
        return build

    return register


def remainder(of: int, key: str = "doc_id") -> Column:
    """crc32 of the id as text, modulo `of`; -1 for a null id."""
    return F.coalesce(F.crc32(F.col(key).cast("string")) % of, F.lit(-1))


def hexadecimal(column: str) -> Column:
    return F.lower(F.hex(column))


@query("op1_cost_balanced_packing")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"))


@query("op2_suffix_radix_sort")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffix_dedup.repeated_spans(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_bytes", "n_removed", F.size("starts").cast("bigint").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


@query("op3_probabilistic_suffix_tree")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_tree.score(table(spark, sf_dir, "documents"), remainder(7) == 2)


@query("op4_segment_edit_join")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = line_join.line_members(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "line_id", F.sha2("line", 256).alias("line_sha256"), "times", "copies", "first_doc_id", "n_links", "class_id", "class_doc_id")


@query("op5_sentence_pieces")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = sentence_pieces.encode(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"), F.sha2(F.concat("begins", "ends"), 256).alias("spans_sha256"))


@query("op6_fixed_block_anchors")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = block_dedup.later_passages(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


@query("op7_additive_quality_model")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = additive_model.train(docs, table(spark, sf_dir, "labels"), remainder(3) != 1)
    scored = additive_model.score(docs, model)
    return scored.select("doc_id", (remainder(3) == 1).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


@query("op8_simhash_blocks")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(hexadecimal("print"), 16, "0").alias("fingerprint"), "component_id")


@query("op9_projection_forest")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return projection_forest.near_duplicates(table(spark, sf_dir, "embeddings"))


OP10_SQL = r"""
WITH bare AS (
    SELECT doc_id, length(coalesce(text, '')) AS chars, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS body FROM documents
), ranked AS (
    SELECT doc_id, body, first_value(doc_id) OVER (PARTITION BY body ORDER BY chars DESC, doc_id) AS keep_id, count(*) OVER (PARTITION BY body) AS group_size FROM bare
)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(body) AS text_sha256 FROM ranked
"""


@query("op10_perfect_hash_dedup", OP10_SQL)
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Half the documents stand for history, the other half for a new delivery; both are in the result."""
    found = perfect_hash.exact_dedup(table(spark, sf_dir, "documents"), remainder(2) == 0)
    return found.select("doc_id", "keep_id", "group_size", "kept", hexadecimal("digest").alias("text_sha256"))


@query("op11_auction_repair", twins.CONVERSATIONS)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_repair.digests(conversation_repair.repair(conversation_repair.damage(table(spark, sf_dir, "conversations"))))


@query("op12_filter_interactions", twins.FILTERS)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op13_ranked_token_files")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = token_files.write(table(spark, sf_dir, "documents"))
    return token_files.read(spark, folder).select("doc_id", "start", "n_tokens", "ids_crc32")
