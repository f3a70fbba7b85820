"""From raw documents to packed training sequences: stages that each read what the one before wrote.

Every stage takes any table with the columns of documents (more may follow, null values included) and
decides over all its rows; an empty table passes through as one. Repeated rows are judged alike.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logloom.llm import cws, mixing, packing, secrets, toxicity
from logloom.llm.common import table
from logloom.session import materialize

TOXIC = 0.3
# Executors still hold the heap that the stages before have filled, so packing remembers fewer words here.
CACHED_WORDS = 50_000


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity reaches TOXIC go; those without text stay."""
    machine = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return docs.where(toxicity.score(docs, machine) < TOXIC)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies stays."""
    return cws.keep_one(docs)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets that only one or two sources have are replaced in the text; all documents stay."""
    return secrets.redact(docs, owner=F.col("source"), repository=F.col("doc_id"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them: up to three times, or not at all."""
    return mixing.mixed_documents(docs)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token pieces of all documents with their sequence and place."""
    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"), cached_words=CACHED_WORDS)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", near_duplicates),
    ("secrets", redact_secrets),
    ("source_mix", mix_sources),
    ("best_fit_packing", best_fit_packing),
]

# Learned scores, random samples and a tokenizer: SQL can't express the stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
