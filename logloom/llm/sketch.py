"""Document fingerprints: bottom-k sketches of shingle hashes.

A text's shingles are runs of five words (lower case, split at ASCII white space; a shorter text is one
shingle); its sketch is the ``SKETCH`` smallest distinct 64-bit hashes of them, in order, and their
number if there are fewer. Sketches of parts merge into that of the whole: the smallest hashes of the
union. From two sketches follow the resemblance, the containment and the numbers of distinct shingles.

Null texts count as empty; an empty or blank text has the empty sketch, which resembles only another
empty one. Equal texts have equal sketches. Only DataFrame functions are used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logloom.session import materialize

SKETCH = 128
WORDS = 5
FAN_IN = 64  # sketches merged together at a time
RANGE = 256  # rows whose neighbours are found together, more beyond MOST_RANGES times as many
MOST_RANGES = 100_000


def word_list(text: Column) -> Column:
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[\x20\x09-\x0D]+"), lambda w: w != "")


def sketch(text: Column, size: int = SKETCH, words: int = WORDS) -> Column:
    """The sketch of a text column, an array of ascending longs."""

    def of(hashes: Column) -> Column:
        places = F.sequence(F.lit(0), F.greatest(F.size(hashes) - words, F.lit(0)))
        many = F.transform(places, lambda i: F.xxhash64(*[F.get(hashes, i + j) for j in range(words)]))
        return F.when(F.size(hashes) > 0, many).otherwise(F.array().cast("array<long>"))

    # Each inner array is bound once by a lambda, so that nothing is computed twice.
    hashes = F.transform(word_list(text), lambda w: F.xxhash64(w))
    shingles = F.transform(F.array(hashes), of)[0]
    return F.slice(F.array_sort(F.array_distinct(shingles)), 1, size)


def union(a: Column, b: Column, size: int = SKETCH) -> Column:
    """The sketch of two texts' shingles together."""
    return F.slice(F.array_sort(F.array_union(a, b)), 1, size)


def resemblance(a: Column, b: Column, size: int = SKETCH) -> Column:
    """Estimated share of common shingles among all of both, 0 to 1; 1 for two empty sketches."""
    both = union(a, b, size)
    common = F.size(F.array_intersect(both, F.array_intersect(a, b)))
    return F.when(F.size(both) > 0, common / F.size(both)).otherwise(F.lit(1.0))


def distinct_count(a: Column, size: int = SKETCH) -> Column:
    """Estimated number of distinct shingles; exact for sketches that are not full."""
    # The hash of rank k lies at about k / n of the range of 64-bit numbers.
    place = (F.element_at(a, -1).cast("double") + 2.0**63) / 2.0**64
    return F.when(F.size(a) < size, F.size(a).cast("double")).otherwise((size - 1) / place)


def containment(a: Column, b: Column, size: int = SKETCH) -> Column:
    """Estimated share of a's shingles that b has, 0 to 1; 1 for an empty a."""
    common = resemblance(a, b, size) * distinct_count(union(a, b, size), size)
    return F.when(F.size(a) > 0, F.least(F.lit(1.0), common / distinct_count(a, size))).otherwise(F.lit(1.0))


def merge(parts: DataFrame, keys: list[str], column: str = "sketch", size: int = SKETCH, fan_in: int = FAN_IN) -> DataFrame:
    """One sketch per key from those of its parts, ``fan_in`` at a time, so that no group is large."""
    most = parts.groupBy(*keys).agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    merged, groups = parts.select(*keys, column), 1
    while groups * fan_in < most:
        groups *= fan_in
    while True:
        salt = F.pmod(F.xxhash64(column), F.lit(groups))
        together = F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list(column)))), 1, size)
        merged = merged.groupBy(*keys, salt.alias("_salt")).agg(together.alias(column)).drop("_salt")
        if groups == 1:
            return merged
        merged, groups = materialize(merged, "sketches"), groups // fan_in


def printed(a: Column) -> Column:
    """A sketch as text: 16 hexadecimal digits per hash."""
    return F.array_join(F.transform(a, lambda h: F.lpad(F.hex(h), 16, "0")), "")


def beside_next(docs: DataFrame) -> DataFrame:
    """``docs`` dealt out by ranges of doc_id, with columns _part, _wrap and _guest.

    In each range the rows ordered by _wrap, doc_id (nulls last) and text (nulls first) are neighbours:
    the guests at its end are the first rows of the following range, or of the whole table after the
    last. Ranges are bounded by quantiles of the ids; the rows of one id stay together.
    """
    spark = docs.sparkSession
    n = docs.count()
    parts = max(1, min(n // RANGE, MOST_RANGES))
    cuts = docs.approxQuantile("doc_id", [i / parts for i in range(1, parts)], 1 / (4 * parts)) if parts > 1 else []
    bounds = sorted({int(cut) for cut in cuts})
    edges = F.array(*[F.lit(b) for b in bounds]).cast("array<long>")
    steps = F.array(*[F.lit(1 << i) for i in reversed(range(max(1, len(bounds).bit_length())))])

    def search(low: Column, step: Column) -> Column:
        reach = low + step
        return F.when((reach <= len(bounds)) & (F.get(edges, reach - 1) <= F.col("doc_id")), reach).otherwise(low)

    # Binary search: the number of edges up to the id.
    part = F.when(F.col("doc_id").isNull(), F.lit(len(bounds))).otherwise(F.aggregate(steps, F.lit(0), search))
    own = docs.withColumn("_part", part)
    firsts = own.groupBy("_part").agg(F.min("doc_id").alias("least")).collect()  # at most MOST_RANGES rows
    used = sorted((r["_part"], r["least"]) for r in firsts)
    table = [(p, least, used[i - 1][0], i == 0) for i, (p, least) in enumerate(used)]
    table = spark.createDataFrame(table, "_part int, _least long, _before int, _wrap boolean")
    guests = own.join(F.broadcast(table), "_part").where(F.col("doc_id").eqNullSafe(F.col("_least")))
    guests = guests.select(*docs.columns, F.col("_before").alias("_part"), "_wrap", F.lit(True).alias("_guest"))
    own = own.select(*docs.columns, "_part", F.lit(False).alias("_wrap"), F.lit(False).alias("_guest"))
    return own.unionByName(guests).repartition("_part")


def edited_fingerprints(docs: DataFrame, size: int = SKETCH, words: int = WORDS) -> DataFrame:
    """Per row: doc_id, n_chars, the text's sketch, its edited text and that one's sketch, the next sketch.

    In the edited text the last half of the characters, rounded down, gives way to as many first ones
    of the next document by doc_id (or all it has); after the last document comes the first.
    """
    text = F.coalesce(F.col("text"), F.lit("")).alias("text")
    dealt = beside_next(docs.select("doc_id", text)).withColumn("sketch", sketch(F.col("text"), size, words))
    order = Window.partitionBy("_part").orderBy("_wrap", F.col("doc_id").asc_nulls_last(), F.col("text").asc_nulls_first())
    ahead = dealt.withColumn("_next", F.lead("text").over(order)).withColumn("next_sketch", F.lead("sketch").over(order))
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.col("text").substr(F.lit(1), n - half), F.col("_next").substr(F.lit(1), half))
    return (
        ahead.where("NOT _guest")
        .select("doc_id", n.cast("long").alias("n_chars"), "sketch", "next_sketch", edited.alias("edited"))
        .withColumn("edited_sketch", sketch(F.col("edited"), size, words))
    )


def fingerprint_digests(docs: DataFrame, size: int = SKETCH, words: int = WORDS) -> DataFrame:
    found = edited_fingerprints(docs, size, words)
    return found.select(
        "doc_id",
        "n_chars",
        F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        printed(F.col("sketch")).alias("fingerprint"),
        printed(F.col("edited_sketch")).alias("edited_fingerprint"),
        resemblance(F.col("sketch"), F.col("edited_sketch"), size).cast("double").alias("near_edited"),
        resemblance(F.col("sketch"), F.col("next_sketch"), size).cast("double").alias("near_next"),
        distinct_count(F.col("sketch"), size).alias("distinct_shingles"),
    )
