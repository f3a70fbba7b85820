"""Ranked lexical search through a pipeline of term owners.

The terms of the items are dealt to owners by weight: the first owner has the rarest terms, the last the
commonest; each owner's lists hold a like share of work. A bundle of items visits one owner after another,
for every block of documents apart. It carries sparse accumulators (item, document, score so far); at each
stop a cogroup brings them together with the owner's lists of the block and adds integer contributions.

After each stop the 50th best score so far of an item is a bound that no result of it can miss. An
accumulator goes if even the most that the remaining owners can give (by each term's weight and greatest
number of occurrences) leaves it below that bound, or below the 50th best of its own block. No result
is lost by it, ties included. After the last stop each block selects the best that are left with their
ids, and the best of all blocks are ranked.

A block is a bounded number of documents in the order they are read, so neither a frequent term nor a
large group of copies meets in one task. Items are taken in passes of about ``PASS_TERMS`` terms (more only
if a single item has more), which bounds what a worker holds; a pass reads the documents once.

Documents with null or empty text hold no term and are no result. Very long texts count whole. Each row is a
document; repeated rows rank one after another. Item rows of the same id (null too) are one item of all
their terms. Ties go by ascending doc_id, null last. An empty table on either side gives an empty result.
Only doc_id, text and item_id are read, so other columns may have any name.
"""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from logloom.session import materialize

from .common import chunked, ship, starts_of

BEST = 50
SHARES = (0.05, 0.2, 0.5, 1.0)  # of all list entries, up to and with each owner
BLOCK = 4_096  # documents that share accumulators
BUNDLE = 256  # items that travel together
PASS_TERMS = 1 << 18

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
# The same for bytes: letters and digits stay (A-Z as a-z), and so does every byte of other characters.
_BYTES = bytes(b if b > 127 or chr(b).isalnum() else 32 for b in range(256)).lower()


def terms_of(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "replace").translate(_BYTES).split() if text else []


def weight(documents: int, frequency: int) -> int:
    return math.floor(1000 * math.log((2 * documents + 2) / (2 * frequency + 1)))


def gains(weights: np.ndarray, tf: np.ndarray, m: np.ndarray | int) -> np.ndarray:
    return weights * ((1_000_000_000 * tf) // (1000 * tf + 20 * m))


def item_terms(items: DataFrame) -> DataFrame:
    """(item_id, term), each once."""
    terms = F.regexp_extract_all(F.translate("text", UPPER, LOWER), F.lit(TERM), F.lit(0))
    return items.select("item_id", F.explode(terms).alias("term")).distinct()


def count_terms(docs: DataFrame, numbers, block: int = BLOCK) -> DataFrame:
    """One row per block of documents: block, ids, n (terms with repeats), and its list entries.

    The entries are arrays of equal length as bytes: place of the document in the block (32 bits), number
    of the term (32 bits) and occurrences (64 bits). ``numbers`` is the broadcast vocabulary.
    """
    schema = T.StructType(
        [
            T.StructField("block", T.LongType()),
            T.StructField("ids", T.ArrayType(docs.schema["doc_id"].dataType)),
            *T.StructType.fromDDL("n array<long>, doc binary, term binary, tf binary").fields,
        ]
    )

    def count(batches):
        number_of = numbers.value.get
        serial = TaskContext.get().partitionId() << 32
        ids, sizes, found, entries = [], [], [], []

        def fold():
            """The entries of the texts read last, added up."""
            if found:
                keys, tf = np.unique(np.concatenate(found), return_counts=True)
                entries.append((keys, tf.astype(np.int64)))
                found.clear()

        def row(number):
            fold()
            keys = np.concatenate([k for k, _ in entries]) if entries else np.zeros(0, np.int64)
            tf = np.concatenate([c for _, c in entries]) if entries else np.zeros(0, np.int64)
            held = pa.concat_arrays(ids)
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([number], pa.int64()),
                    pa.ListArray.from_arrays(pa.array([0, len(held)], pa.int32()), held),
                    pa.array([sizes], pa.list_(pa.int64())),
                    pa.array([(keys >> 32).astype("<i4").tobytes()], pa.binary()),
                    pa.array([(keys & 0xFFFFFFFF).astype("<i4").tobytes()], pa.binary()),
                    pa.array([tf.astype("<i8").tobytes()], pa.binary()),
                ],
                schema.fieldNames(),
            )

        for batch in batches:
            texts = batch.column("text").to_pylist()
            for a, b in chunked([t or "" for t in texts], 1 << 20):
                for i in range(a, b):
                    words = terms_of(texts[i])
                    known = [v for v in map(number_of, words) if v is not None]
                    found.append(np.array(known, np.int64) | (len(sizes) << 32))
                    sizes.append(len(words))
                    ids.append(batch.column("doc_id").slice(i, 1))
                    if len(sizes) == block:
                        yield row(serial)
                        serial += 1
                        ids, sizes, entries = [], [], []
                fold()
        if sizes:
            yield row(serial)

    return docs.select("doc_id", "text").mapInArrow(count, schema)


def _entries(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return np.frombuffer(row["doc"], "<i4"), np.frombuffer(row["term"], "<i4"), np.frombuffer(row["tf"], "<i8")


def term_statistics(blocks: DataFrame, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Per term of the vocabulary: documents that hold it, and its most occurrences in one."""

    def count(batches):
        df, most = np.zeros(size, np.int64), np.zeros(size, np.int64)
        for batch in batches:
            for row in batch.to_pylist():
                _, term, tf = _entries(row | {"doc": b""})
                df += np.bincount(term, minlength=size)
                np.maximum.at(most, term, tf)
        held = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in (held, df[held], most[held])], ["number", "df", "most"])

    counted = blocks.select("term", "tf").mapInArrow(count, "number long, df long, most long")
    df, most = np.zeros(size, np.int64), np.zeros(size, np.int64)
    for row in counted.groupBy("number").agg(F.sum("df").alias("df"), F.max("most").alias("most")).collect():
        df[row["number"]], most[row["number"]] = row["df"], row["most"]  # at most one row per term of a pass
    return df, most


class Plan:
    """What the workers need of a pass: weights, owners, the items of each term, and bounds. Sent to them once."""

    def __init__(self, item_of: np.ndarray, term_of: np.ndarray, items: int, terms: int, documents: int, words: int, df: np.ndarray, most: np.ndarray, block: int = BLOCK, bundle: int = BUNDLE):
        self.items, self.documents, self.words, self.block, self.bundle = items, documents, words, block, bundle
        self.weights = np.array([weight(documents, f) if f else 0 for f in df.tolist()], np.int64)
        order = np.lexsort((np.arange(terms), -self.weights))
        share = np.cumsum(df[order]) / max(1, df.sum())
        self.owner = np.empty(terms, np.int64)
        self.owner[order] = np.minimum(np.searchsorted(SHARES, share - 1e-12), len(SHARES) - 1)
        by_term = np.lexsort((item_of, term_of))
        self.item_of, self.first = item_of[by_term], np.searchsorted(term_of[by_term], np.arange(terms + 1))
        # The most that the owners after each one can add to an item; 50 is the least m.
        bound = np.where(most > 0, gains(self.weights, np.maximum(most, 1), 50), 0)
        self.rest = np.zeros((len(SHARES), items), np.int64)
        for stage in range(len(SHARES)):
            later = self.owner[term_of] > stage
            np.add.at(self.rest[stage], item_of[later], bound[term_of[later]])

    def bundles(self) -> int:
        return -(-self.items // self.bundle)


def owner_lists(blocks: DataFrame, plan, stage: int) -> DataFrame:
    """The lists of one owner: per block and bundle that has any, the entries (document, term, gain)."""

    def build(batches):
        p = plan.value
        bundles = np.zeros((p.bundles(), len(p.owner)), bool)
        bundles[p.item_of // p.bundle, np.repeat(np.arange(len(p.owner)), np.diff(p.first))] = True
        for batch in batches:
            for row in batch.to_pylist():
                doc, term, tf = _entries(row)
                own = np.flatnonzero((p.owner[term] == stage) & (p.weights[term] > 0))
                doc, term, tf = doc[own], term[own], tf[own]
                n = np.array(row["n"], np.int64)
                m = 100 - 50 + (50 * n * p.documents) // p.words
                gain = gains(p.weights[term], tf, m[doc])
                for bundle in range(p.bundles()):
                    at = np.flatnonzero(bundles[bundle][term])
                    if len(at):
                        columns = [pa.array([x], t) for x, t in ((row["block"], pa.int64()), (bundle, pa.int64()))]
                        columns += [pa.array([x[at].tobytes()], pa.binary()) for x in (doc, term, gain)]
                        yield pa.RecordBatch.from_arrays(columns, ["block", "bundle", "doc", "term", "gain"])

    return blocks.select("block", "n", "doc", "term", "tf").mapInArrow(build, "block long, bundle long, doc binary, term binary, gain binary")


CARRIED = "block long, bundle long, item binary, doc binary, score binary, best binary"


def visit(carried: DataFrame, lists: DataFrame, plan, stage: int, bound) -> DataFrame:
    """The bundles' accumulators after an owner has added its contributions, without those out of reach.

    ``bound`` is the broadcast 50th best score of each item after the stop before. ``best`` holds the 50
    best scores so far of each item in the block, as rows of 64-bit numbers.
    """

    def add(bundles: pa.Table, owned: pa.Table) -> pa.Table:
        p = plan.value
        head = (bundles if bundles.num_rows else owned).select(["block", "bundle"]).slice(0, 1).to_pylist()[0]
        low = head["bundle"] * p.bundle
        high = min(p.items, low + p.bundle)
        score = np.zeros((high - low) * p.block, np.int64)
        for row in bundles.to_pylist():
            item, doc = np.frombuffer(row["item"], "<u2").astype(np.int64), np.frombuffer(row["doc"], "<u2")
            score[item * p.block + doc] = np.frombuffer(row["score"], "<i8")
        for row in owned.to_pylist():
            doc, term, gain = np.frombuffer(row["doc"], "<i4"), np.frombuffer(row["term"], "<i4"), np.frombuffer(row["gain"], "<i8")
            fan = p.first[term + 1] - p.first[term]
            part = np.cumsum(fan) >> 21  # so many additions at a time
            for a, b in zip(starts := starts_of(part), np.r_[starts[1:], len(part)]):
                f = fan[a:b]
                entry = np.repeat(np.arange(a, b), f)
                place = np.arange(len(entry)) - np.repeat(np.cumsum(f) - f, f)
                item = p.item_of[p.first[term[entry]] + place]
                here = np.flatnonzero((item >= low) & (item < high))
                np.add.at(score, (item[here] - low) * p.block + doc[entry[here]], gain[entry[here]])
        score = score.reshape(high - low, p.block)
        best = -np.partition(-score, BEST - 1, axis=1)[:, :BEST]
        least = np.maximum(best.min(axis=1), bound.value[low:high])
        item, doc = np.nonzero((score > 0) & (score + p.rest[stage, low:high, None] >= least[:, None]))
        values = [item.astype("<u2"), doc.astype("<u2"), score[item, doc].astype("<i8"), best.astype("<i8")]
        columns = [pa.array([head["block"]], pa.int64()), pa.array([head["bundle"]], pa.int64())]
        return pa.Table.from_arrays(columns + [pa.array([v.tobytes()], pa.binary()) for v in values], ["block", "bundle", "item", "doc", "score", "best"])

    by = ("block", "bundle")
    return carried.drop("best").groupBy(*by).cogroup(lists.groupBy(*by)).applyInArrow(add, CARRIED)


def bounds(carried: DataFrame, items: int, bundle: int) -> np.ndarray:
    """The 50th best score so far of each item; 0 if it has fewer."""

    def merge(batches):
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for row in batch.to_pylist():
                best = np.frombuffer(row["best"], "<i8").reshape(-1, BEST)
                both = np.concatenate([held[row["bundle"]], best], 1) if row["bundle"] in held else best
                held[row["bundle"]] = -np.sort(-both, axis=1)[:, :BEST]
        for number, best in held.items():
            item, place = np.nonzero(best)
            yield pa.RecordBatch.from_arrays([pa.array(item + number * bundle), pa.array(best[item, place])], ["item", "score"])

    rows = carried.select("bundle", "best").mapInArrow(merge, "item long, score long")
    ranked = rows.withColumn("place", F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score"))))
    out = np.zeros(items, np.int64)
    for row in ranked.where(F.col("place") == BEST).collect():  # at most one row per item of a pass
        out[row["item"]] = row["score"]
    return out


def select_best(carried: DataFrame, blocks: DataFrame, bound, bundle: int) -> DataFrame:
    """(item, doc_id, score): the best of each block that reach the item's bound, at most 50 of each item."""
    kind = blocks.schema["ids"].dataType.elementType
    schema = T.StructType([T.StructField("item", T.LongType()), T.StructField("doc_id", kind), T.StructField("score", T.LongType())])

    def select(bundles: pa.Table, block: pa.Table) -> pa.Table:
        ids = block.column("ids").combine_chunks().values if block.num_rows else pa.array([], pa.null())
        place = pc.rank(ids, sort_keys="ascending", null_placement="at_end", tiebreaker="dense").to_numpy().astype(np.int64) if len(ids) else None
        items, docs, scores = [], [], []
        for row in bundles.to_pylist():
            item = np.frombuffer(row["item"], "<u2").astype(np.int64) + row["bundle"] * bundle
            doc, score = np.frombuffer(row["doc"], "<u2").astype(np.int64), np.frombuffer(row["score"], "<i8")
            reach = np.flatnonzero(score >= bound.value[item])
            item, doc, score = item[reach], doc[reach], score[reach]
            order = np.lexsort((place[doc], -score, item)) if len(item) else np.zeros(0, np.int64)
            item, doc, score = item[order], doc[order], score[order]
            first = np.searchsorted(item, item)
            top = np.arange(len(item)) - first < BEST
            items.append(item[top]), docs.append(doc[top]), scores.append(score[top])
        none = np.zeros(0, np.int64)
        item, doc, score = (np.concatenate([none, *x]) for x in (items, docs, scores))
        return pa.Table.from_arrays([pa.array(item), ids.take(pa.array(doc)), pa.array(score)], schema.fieldNames())

    carried = carried.select("block", "bundle", "item", "doc", "score")
    return carried.groupBy("block").cogroup(blocks.select("block", "ids").groupBy("block")).applyInArrow(select, schema)


def _pass(docs: DataFrame, pairs: list, block: int, bundle: int) -> DataFrame | None:
    """Results of the items of ``pairs`` (item_id, term): item number, doc_id, score; with the ids by number."""
    spark = docs.sparkSession
    ids = list(dict.fromkeys(r["item_id"] for r in pairs))
    terms = list(dict.fromkeys(r["term"] for r in pairs))
    number, numbers = {x: i for i, x in enumerate(ids)}, {t.encode(): i for i, t in enumerate(terms)}
    item_of = np.array([number[r["item_id"]] for r in pairs], np.int64)
    term_of = np.array([numbers[r["term"].encode()] for r in pairs], np.int64)

    blocks = materialize(count_terms(docs, spark.sparkContext.broadcast(numbers), block), "blocks")
    totals = blocks.select(
        F.sum(F.size(F.filter("n", lambda n: n > 0))).alias("documents"),
        F.sum(F.aggregate("n", F.lit(0).cast("long"), lambda a, n: a + n)).alias("words"),
    ).first()
    if not totals["words"]:
        return None
    df, most = term_statistics(blocks, len(terms))
    sizes = (len(ids), len(terms), totals["documents"], totals["words"])
    plan = spark.sparkContext.broadcast(Plan(item_of, term_of, *sizes, df, most, block, bundle))
    carried, bound = spark.createDataFrame([], CARRIED), np.zeros(len(ids), np.int64)
    for stage in range(len(SHARES)):
        lists = owner_lists(blocks, plan, stage)
        carried = materialize(visit(carried, lists, plan, stage, spark.sparkContext.broadcast(bound)), "carried")
        bound = bounds(carried, len(ids), bundle)
    return select_best(carried, blocks, spark.sparkContext.broadcast(bound), bundle)


def search(docs: DataFrame, items: DataFrame, block: int = BLOCK, bundle: int = BUNDLE, pass_terms: int = PASS_TERMS) -> DataFrame:
    """item_id, rank, doc_id, score: each item's 50 documents of highest score above 0.

    A ``block`` has at least 50 documents and at most 65,536, a ``bundle`` at most 65,536 items.
    """
    spark = docs.sparkSession
    ship(spark)
    wanted = materialize(item_terms(items), "items")
    passes = -(-wanted.count() // pass_terms)
    id_field = T.StructField("item_id", items.schema["item_id"].dataType)
    found = []
    for part in range(passes):
        # About PASS_TERMS rows, however many items there are.
        pairs = wanted.where(F.pmod(F.xxhash64("item_id"), F.lit(passes)) == part).collect()
        ranked = _pass(docs, pairs, block, bundle) if pairs else None
        if ranked is not None:
            ids = list(dict.fromkeys(r["item_id"] for r in pairs))
            named = spark.createDataFrame([*enumerate(ids)], T.StructType([T.StructField("item", T.LongType()), id_field]))
            order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
            ranked = ranked.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= BEST)
            found.append(ranked.join(F.broadcast(named), "item").select("item_id", "rank", "doc_id", "score"))
    if not found:
        schema = T.StructType([id_field, T.StructField("rank", T.IntegerType()), docs.schema["doc_id"], T.StructField("score", T.LongType())])
        return spark.createDataFrame([], schema)
    return reduce(DataFrame.unionByName, found)


SQL = f"""
WITH docs AS (
    SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '{TERM}') AS terms
    FROM documents
), totals AS (
    SELECT count(*) AS n_docs, CAST(sum(len(terms)) AS BIGINT) AS n_words FROM docs WHERE len(terms) > 0
), wanted AS (
    SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '{TERM}')) AS term
    FROM benchmark
), counts AS (
    SELECT r, doc_id, n, term, count(*) AS tf
    FROM (SELECT r, doc_id, len(terms) AS n, unnest(terms) AS term FROM docs)
    WHERE term IN (SELECT term FROM wanted)
    GROUP BY ALL
), weights AS (
    SELECT term, CAST(floor(1000 * ln(CAST(2 * n_docs + 2 AS DOUBLE) / (2 * df + 1))) AS BIGINT) AS w
    FROM (SELECT term, count(*) AS df FROM counts GROUP BY term), totals
), scored AS (
    SELECT item_id, r, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (100 - 50 + ((50 * n * n_docs) // n_words))))) AS BIGINT) AS score
    FROM counts JOIN weights USING (term) JOIN wanted USING (term), totals
    GROUP BY item_id, r, doc_id
), ranked AS (
    SELECT item_id, doc_id, score,
        CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id ASC NULLS LAST, r) AS INTEGER) AS rank
    FROM scored WHERE score > 0
)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= {BEST}
"""
