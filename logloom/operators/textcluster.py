"""Clusters of similar error messages: TF-IDF weights, K-Means, and one row per cluster.

Equal messages are folded into one row with a count before anything else, so a message that
makes up a large share of the errors costs no more than a rare one. The counts go in as
weights everywhere.
"""

from __future__ import annotations

from pyspark.ml.feature import CountVectorizerModel, ElementwiseProduct, Normalizer
from pyspark.ml.linalg import Vectors
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import tokens
from ..session import materialize
from . import kmeans

MAX_TERMS = 1000
MAX_DF = 0.95
MAX_CLUSTERS = 20
MIN_ERRORS = 2
RESTARTS = 10
MAX_ITER = 300
SEED = 42
KEYWORDS = 5


def fold_messages(messages: DataFrame) -> DataFrame:
    """Distinct messages with their number of copies and first and last time."""
    return messages.groupBy("message").agg(
        F.count("*").alias("copies"),
        F.min("timestamp").alias("first_seen"),
        F.max("timestamp").alias("last_seen"),
    )


def tokenize(folded: DataFrame, stop_words: list[str] | None = None) -> DataFrame:
    return folded.withColumn("tokens", tokens(F.col("message"), stop_words))


def term_counts(tokenized: DataFrame) -> DataFrame:
    """Per term: messages that contain it (``df``) and occurrences (``tf``), copies included."""
    occurrences = F.transform(F.col("tokens"), lambda t: F.struct(t.alias("term"), F.lit(1).alias("tf"), F.lit(0).alias("df")))
    mentions = F.transform(
        F.array_distinct("tokens"), lambda t: F.struct(t.alias("term"), F.lit(0).alias("tf"), F.lit(1).alias("df"))
    )
    return (
        tokenized.select("copies", F.explode(F.concat(occurrences, mentions)).alias("t"))
        .groupBy(F.col("t.term").alias("term"))
        .agg(
            F.sum(F.col("t.df") * F.col("copies")).alias("df"),
            F.sum(F.col("t.tf") * F.col("copies")).alias("tf"),
        )
    )


def message_total(tokenized: DataFrame) -> Column:
    return tokenized.agg(F.coalesce(F.sum("copies"), F.lit(0))).scalar()


def vocabulary(tokenized: DataFrame, max_terms: int = MAX_TERMS, max_df: float = MAX_DF) -> DataFrame:
    """The most frequent terms that are not in nearly every message, with their idf."""
    n = message_total(tokenized)
    return (
        term_counts(tokenized)
        .where(F.col("df") <= F.lit(max_df) * n)
        .orderBy(F.desc("tf"), "term")
        .limit(max_terms)
        .withColumn("idf", F.log((1 + n) / (1 + F.col("df"))) + 1)
    )


def tfidf_weights(tokenized: DataFrame, vocab: DataFrame, key: str = "message") -> DataFrame:
    """Long form ``(key, term, weight)`` with the weights of a message at length 1.

    Counts, weights and length are all made inside the row, so no message takes part in a shuffle. The
    vocabulary, bounded by max_terms, comes to the driver, as every task needs all of it.
    """
    terms = vocab.select("term", "idf").collect()
    if not terms:
        return tokenized.select(key, F.lit("").alias("term"), F.lit(0.0).alias("weight")).where(F.lit(False))
    vector = F.unwrap_udt("features")
    entries = F.explode(F.arrays_zip(vector["indices"].alias("at"), vector["values"].alias("weight")))
    found = tfidf_vectors(tokenized, terms).select(key, entries.alias("e"))
    names = F.lit([t["term"] for t in terms])
    return found.select(key, F.get(names, F.col("e.at")).alias("term"), F.col("e.weight").alias("weight"))


def tfidf_vectors(tokenized: DataFrame, vocab: list) -> DataFrame:
    """Add ``features``, the TF-IDF vector at length 1, over the rows ``(term, idf)`` of ``vocab``."""
    counted = CountVectorizerModel.from_vocabulary(
        [v["term"] for v in vocab], inputCol="tokens", outputCol="term_counts"
    ).transform(tokenized)
    weighted = ElementwiseProduct(
        scalingVec=Vectors.dense([v["idf"] for v in vocab]), inputCol="term_counts", outputCol="weighted"
    ).transform(counted)
    return Normalizer(p=2.0, inputCol="weighted", outputCol="features").transform(weighted).drop(
        "term_counts", "weighted"
    )


def choose_k(n: Column | int) -> Column:
    """Clusters for ``n`` messages: one per five, 2 to 20, and not more than messages."""
    n = n if isinstance(n, Column) else F.lit(n)
    wanted = F.least(F.lit(MAX_CLUSTERS), F.greatest(F.lit(2), F.floor(n / 5)))
    return F.greatest(F.least(wanted, n), F.lit(2)).cast("int")


def cluster_errors(vectors: DataFrame, k: int, terms: int, restarts: int = RESTARTS, seed: int = SEED) -> DataFrame:
    """Add the cluster ``label`` of each message: the best of several starts, all fitted in the same scans.

    ``terms`` is the length of the vectors. Equal messages count as often as they occur.
    """
    centers = kmeans.fit(vectors, terms, k, restarts, seed, MAX_ITER)
    return vectors.withColumn("label", kmeans.nearest(F.col("features"), centers))


def cluster_sizes(assigned: DataFrame) -> DataFrame:
    """Messages per cluster, copies included; an empty cluster has no row."""
    return assigned.groupBy("label").agg(F.sum("copies").alias("count"))


def seen_span() -> list[Column]:
    """First and last time of the messages of a cluster."""
    return [F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen")]


def center_weights(assigned: DataFrame) -> DataFrame:
    """Long form ``(label, index, weight)`` of the cluster centres: the mean of their vectors.

    At most clusters x vocabulary rows; everything else is added up before the shuffle.
    """
    vector = F.unwrap_udt("features")
    sums = (
        assigned.select("label", "copies", F.explode(F.arrays_zip(vector["indices"], vector["values"])).alias("e"))
        .groupBy("label", F.col("e.indices").alias("index"))
        .agg(F.sum(F.col("e.values") * F.col("copies")).alias("total"))
    )
    return sums.join(F.broadcast(cluster_sizes(assigned)), "label").select(
        "label", "index", (F.col("total") / F.col("count")).alias("weight")
    )


def keywords(centers: DataFrame, vocab: list, top: int = KEYWORDS) -> DataFrame:
    """The heaviest terms of each centre, joined by ``, ``."""
    terms = centers.sparkSession.createDataFrame(
        [(i, v["term"]) for i, v in enumerate(vocab)], "index INT, term STRING"
    )
    named = centers.where(F.col("weight") > 0).join(F.broadcast(terms), "index")
    by_weight = Window.partitionBy("label").orderBy(F.round("weight", 9).desc(), "term")
    best = named.withColumn("rank", F.row_number().over(by_weight)).where(F.col("rank") <= top)
    listed = best.groupBy("label").agg(F.array_sort(F.collect_list(F.struct("rank", "term"))).alias("terms"))
    joined = F.concat_ws(", ", F.transform("terms", lambda t: t["term"]))
    return listed.select("label", joined.alias("keywords"))


def center_distance(assigned: DataFrame, centers: list, terms: int) -> DataFrame:
    """Add ``distance``, the Euclidean distance of a message from the centre of its cluster.

    ``centers`` are the collected rows of ``center_weights``. A cluster of messages without any
    known term has none: its centre is at zero, as its messages are.
    """
    dense: dict[int, list[float]] = {}
    for row in centers:
        dense.setdefault(row["label"], [0.0] * terms)[row["index"]] = row["weight"]
    schema = "label INT, center ARRAY<DOUBLE>, length DOUBLE"
    table = [(label, c, sum(w * w for w in c)) for label, c in dense.items()]
    vector = F.unwrap_udt("features")
    parts = F.zip_with(
        vector["indices"], vector["values"], lambda i, v: v * v - 2 * v * F.get(F.col("center"), i)
    )
    squared = F.col("length") + F.aggregate(parts, F.lit(0.0), lambda total, x: total + x)
    # One row per cluster, so at most 20.
    joined = assigned.join(F.broadcast(assigned.sparkSession.createDataFrame(table, schema)), "label", "left")
    distance = F.coalesce(F.sqrt(F.greatest(squared, F.lit(0.0))), F.lit(0.0))
    return joined.withColumn("distance", distance).drop("center", "length")


def cluster_table(assigned: DataFrame, vocab: list) -> DataFrame:
    """One row per non-empty cluster: nearest message, size, keywords, first and last time.

    The centres, at most clusters x vocabulary numbers, come to the driver and go to every task.
    """
    found = center_weights(assigned)
    centers = found.collect()
    # Numbers first, texts only of the messages at the least distance: both are hash aggregations.
    distant = center_distance(assigned, centers, len(vocab)).withColumn("distance", F.round("distance", 9))
    rows = distant.groupBy("label").agg(F.min("distance").alias("least"), F.sum("copies").alias("count"), *seen_span())
    closest = distant.join(F.broadcast(rows.select("label", "least")), "label").where("distance = least")
    examples = closest.groupBy("label").agg(F.min("message").alias("example_message"))
    rows = rows.join(F.broadcast(examples), "label").drop("least")
    named = keywords(assigned.sparkSession.createDataFrame(centers, found.schema), vocab)
    return rows.join(F.broadcast(named), "label", "left").select(
        "label", "example_message", "count", "keywords", "first_seen", "last_seen"
    )


def prepare(messages: DataFrame, stop_words: list[str] | None = None) -> tuple[DataFrame, list, int]:
    """Folded and tokenised messages in the shared folder, their vocabulary and how many clusters to make.

    The vocabulary, at most 1,000 rows, comes to the driver, as every task needs all of it.
    """
    tokenized = materialize(tokenize(fold_messages(messages), stop_words), "messages")
    total = F.coalesce(F.sum("copies"), F.lit(0)).alias("total")
    counted = tokenized.agg(total).select("total", choose_k(F.col("total")).alias("k")).first()
    vocab = vocabulary(tokenized).collect() if counted["total"] >= MIN_ERRORS else []
    return tokenized, vocab, counted["k"]


def assign_clusters(
    messages: DataFrame, stop_words: list[str] | None = None, **options
) -> tuple[DataFrame, list] | None:
    """Labelled messages and the vocabulary; None for fewer than two messages or no usable term."""
    tokenized, vocab, k = prepare(messages, stop_words)
    if not vocab:
        return None
    vectors = materialize(tfidf_vectors(tokenized, vocab).drop("tokens"), "vectors")
    return materialize(cluster_errors(vectors, k, len(vocab), **options), "assigned"), vocab
