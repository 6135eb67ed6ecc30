"""The corpus queries, each over its whole table, and the SQL of those that SQL can state."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortspark.llm import (
    counting, decontaminate, extraction, neardup, neighbours, packing, perspectives, privacy, repair, search, substrings, toxicity, vectors,
)
from cohortspark.llm.oracles import CHAT_SQL, NEAR_SQL, REPAIR_SQL, SEARCH_SQL, SUBSTRING_SQL, VECTOR_SQL
from cohortspark.llm.textops import documents

WORD_TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
PSEUDONYM_KEY = "corpus-pseudonyms"  # a deployment passes its own secret to the operator

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


@query("op1_retrieval_packing")
def packing_pieces(spark: SparkSession, folder: str) -> DataFrame:
    return packing.packed(documents(spark, folder), WORD_TOKENIZER)


@query("op2_edit_aware_token_counts")
def token_counts(spark: SparkSession, folder: str) -> DataFrame:
    docs = documents(spark, folder).withColumn("edits", counting.sample_edits())
    counts = counting.edited_counts(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    return counts.select("doc_id", "n_tokens", "edited_tokens", "n_edits", "encoded_chars", F.size("leaf_tokens").alias("n_leaves"))


@query("op3_main_text")
def main_text(spark: SparkSession, folder: str) -> DataFrame:
    texts = extraction.main_texts(table(spark, folder, "pages"))
    return texts.withColumn("n_chars", F.length("text").cast("long"))


@query("op4_pseudonyms")
def pseudonyms(spark: SparkSession, folder: str) -> DataFrame:
    docs = documents(spark, folder).select("doc_id", "text")
    return privacy.pseudonymised(docs, PSEUDONYM_KEY, count_col="n_replaced")


@query("op5_embedding_near_dedup", VECTOR_SQL)
def near_vectors(spark: SparkSession, folder: str) -> DataFrame:
    return vectors.similar_vectors(table(spark, folder, "embeddings"))


@query("op6_substring_dedup", SUBSTRING_SQL)
def repeated_passages(spark: SparkSession, folder: str) -> DataFrame:
    return substrings.digest(substrings.without_repeats(documents(spark, folder)))


@query("op7_perspective_rotation", CHAT_SQL)
def chat_perspectives(spark: SparkSession, folder: str) -> DataFrame:
    return perspectives.rotated(table(spark, folder, "conversations"))


@query("op8_decontamination")
def benchmark_leaks(spark: SparkSession, folder: str) -> DataFrame:
    return decontaminate.contaminated(documents(spark, folder), table(spark, folder, "benchmark"))


@query("op9_minhash_near_dedup", NEAR_SQL)
def near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return neardup.near_duplicates(documents(spark, folder))


@query("op10_toxicity")
def toxicity_scores(spark: SparkSession, folder: str) -> DataFrame:
    return toxicity.rated(documents(spark, folder), table(spark, folder, "labels"))


@query("op11_bag_search", SEARCH_SQL)
def bag_search(spark: SparkSession, folder: str) -> DataFrame:
    return search.ranked(documents(spark, folder), table(spark, folder, "benchmark"))


@query("op12_conversation_repair", REPAIR_SQL)
def conversation_repair(spark: SparkSession, folder: str) -> DataFrame:
    talks = table(spark, folder, "conversations")
    edited, summary = repair.repaired(repair.damaged(talks))
    return repair.report(talks, summary, repair.digests(edited))


@query("op13_nearest_vectors")
def nearest_vectors(spark: SparkSession, folder: str) -> DataFrame:
    return neighbours.nearest(table(spark, folder, "embeddings"))
