"""The queries of the training-data operators, over the tables of a folder, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, chat, cws, langid, lexical, mixing, packing, rules, runs, secrets, sketch, toxicity, voronoi
from .common import fold, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(function):
    QUERIES[function.__name__] = function
    return function


@query
def op1_chat_perspectives(spark, sf_dir):
    return chat.perspective_rows(table(spark, sf_dir, "conversations"))


ORACLE["op1_chat_perspectives"] = chat.SQL


@query
def op2_toxicity(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    machine = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    scored = docs.select("doc_id", (fold("doc_id", 4) == 2).alias("held_out"), toxicity.score(docs, machine).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.3).cast("int"))


@query
def op3_voronoi_top_k(spark, sf_dir):
    return voronoi.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


ORACLE["op3_voronoi_top_k"] = voronoi.SQL


@query
def op4_source_mix(spark, sf_dir):
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


ORACLE["op4_source_mix"] = mixing.SQL


@query
def op5_fingerprints(spark, sf_dir):
    return sketch.fingerprint_digests(table(spark, sf_dir, "documents"))


@query
def op6_quality_rules(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    ensemble = rules.fit(docs, table(spark, sf_dir, "labels"))
    stated, _ = rules.with_statistics(docs.select("doc_id", "text"))
    scored = stated.select("doc_id", (fold("doc_id", 5) == 0).alias("held_out"), ensemble.score().alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.3).cast("int"))


@query
def op7_secret_owners(spark, sf_dir):
    # A source owns its documents; each document is a repository of its own.
    docs = table(spark, sf_dir, "documents")
    return secrets.span_digests(docs, owner=F.col("source"), repository=F.col("doc_id"))


@query
def op8_best_fit_packing(spark, sf_dir):
    return packing.pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


@query
def op10_near_duplicates(spark, sf_dir):
    return cws.near_duplicates(table(spark, sf_dir, "documents"))


@query
def op9_language(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    model = langid.fit(docs, langid.vocabulary(public_tokenizers.path("piece_bpe_32k.model")))
    found = docs.select("doc_id", (fold("doc_id", 4) == 2).alias("held_out"), langid.predict(docs, model).alias("found"))
    return found.select("doc_id", "held_out", "found.lang_pred", "found.score")


@query
def op11_byte_bpe(spark, sf_dir):
    return bpe.encoding_digests(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


@query
def op12_lexical_search(spark, sf_dir):
    return lexical.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


ORACLE["op12_lexical_search"] = lexical.SQL


@query
def op13_periodic_runs(spark, sf_dir):
    return runs.run_digests(runs.with_planted_runs(table(spark, sf_dir, "documents")))
