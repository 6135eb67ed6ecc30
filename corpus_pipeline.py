"""Documents to packed training sequences, stage by stage.

Toxic documents go, one document of each near-duplicate group stays, documents that hold a
benchmark item go, personal data is replaced, and what is left is packed.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortspark.llm import decontaminate, neardup, packing, privacy, toxicity
from cohortspark.sources.stored import last_written, lifetime, settle

KEY = "corpus-pseudonyms"  # a deployment passes its own secret to the operator


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored below one half stay."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    name = "toxicity_score"
    while name in docs.columns:
        name += "_"
    return toxicity.scored(docs, labels, score_col=name).filter(F.col(name) < 0.5).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of smallest id of each group stays; documents without an id stay.

    Repeated rows of one id are one document, of which one row stays.
    """
    again = docs.groupBy("doc_id").count().filter("doc_id is not null and count > 1")
    if not again.isEmpty():
        docs = docs.dropDuplicates()
    gone = neardup.near_duplicates(docs).filter("not kept").select("doc_id")
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item stay, and those without an id."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    held = decontaminate.contaminated(docs, items).select("doc_id").distinct()
    return docs.join(held, "doc_id", "left_anti").select(*docs.columns)


def replace_personal(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents stay, with pseudonyms; their number of characters does not change."""
    return privacy.pseudonymised(docs, KEY)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the training sequences."""
    return packing.packed(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("toxicity", drop_toxic), ("near_dedup", drop_near_duplicates), ("decontamination", drop_contaminated),
    ("pseudonyms", replace_personal), ("packing", pack),
]
ORACLE_SQL = None  # models and tokenizers are beyond SQL: tests/llm has a brute-force version


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each stage's rows are written and read again, its own tables dropped."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        with lifetime(spark) as keep:
            docs = settle(stage(spark, docs, sf_dir), name)
            keep.append(last_written(spark))
    return docs
