"""Sources mixed to target weights by a low-discrepancy schedule of equal blocks of words.

Each source's documents are shuffled by the digest of their id and laid end to end, again and again;
the words are cut into blocks of equal size. Point i of the golden-ratio sequence falls into the range
of one source on the cumulative weights and so gives slot i to that source; the slot's rank among the
source's slots names the block. Every prefix of the schedule is thus close to the weights. Slots beyond
a source's share are left out, slots still owed after the last point are appended, and the last one
is cut, so that a source gives the words of its target, rounded.

Sources by code point, null last, weigh 1, 2, 3, repeating. Targets share all words of the corpus by
weight; none exceeds ``REPEATS`` times its source, the excess is reshared by weight. A null text has no
word; documents without a word take no part and have ``taken`` 0. Repeated rows are documents of their
own. Very long texts span many blocks. An empty table gives an empty result. Only doc_id, text and source
are read, so other columns may have any name.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logloom.session import materialize

from .common import ship

REPEATS = 3
WORD = r"[^\x20\x09-\x0D]+"
BLOCK = 1_024  # words of a block, fewer in small sources
LEAST_BLOCKS = 256  # that a source is cut into, if it has as many words
CHUNK = 4_096  # slots ranked together
GROUP = 8_192  # documents of a source ordered together
GOLDEN = 0x9E3779B97F4A7C15  # 2^64 divided by the golden ratio


@dataclass
class Share:
    source: str | None
    size: int
    target: float
    take: int  # words
    block: int  # words
    blocks: int  # of one pass over the source
    slots: int


def targets(sizes: list[int], weights: list[int], repeats: int = REPEATS) -> list[float]:
    """Words per source: by weight, at most ``repeats`` times its size, the excess reshared."""
    found, left, open_ = [0.0] * len(sizes), float(sum(sizes)), set(range(len(sizes)))
    while open_:
        total = sum(weights[i] for i in open_)
        full = {i for i in open_ if left * weights[i] / total > repeats * sizes[i]}
        if not full:
            for i in open_:
                found[i] = left * weights[i] / total
            break
        for i in full:
            found[i] = float(repeats * sizes[i])
        left -= sum(repeats * sizes[i] for i in full)
        open_ -= full
    return found


def shares(sizes: dict[str | None, int], block: int = BLOCK, repeats: int = REPEATS) -> list[Share]:
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    out = []
    wanted = targets([sizes[s] for s in names], [i % 3 + 1 for i in range(len(names))], repeats)
    for name, target in zip(names, wanted):
        size = sizes[name]
        take = min(repeats * size, int(np.floor(target + 0.5)))
        words = max(1, min(block, size // LEAST_BLOCKS))
        blocks = -(-size // words)
        slots = take // size * blocks + -(-(take % size) // words) if size else 0
        out.append(Share(name, size, target, take, words, blocks, slots))
    return out


def schedule(spark, plan: list[Share]) -> DataFrame:
    """(slot, source number, rank): which source fills a slot with which of its blocks."""
    ship(spark)
    counts = np.array([s.slots for s in plan], np.int64)
    total = int(counts.sum())
    bounds = spark.sparkContext.broadcast(np.cumsum(counts) / max(1, total))

    @F.pandas_udf("int")
    def source_at(slot: pd.Series) -> pd.Series:
        point = (slot.to_numpy().astype(np.uint64) + np.uint64(1)) * np.uint64(GOLDEN)
        found = np.searchsorted(bounds.value, point / 2.0**64, "right")
        return pd.Series(np.minimum(found, len(bounds.value) - 1).astype(np.int32))

    points = spark.range(total).select(F.col("id").alias("slot"), source_at("id").alias("s"), F.expr(f"id div {CHUNK}").alias("chunk"))
    before = points.groupBy("s", "chunk").agg(F.count("*").alias("n"))
    running = Window.partitionBy("s").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    before = before.select("s", "chunk", F.coalesce(F.sum("n").over(running), F.lit(0)).alias("before"))
    nth = F.row_number().over(Window.partitionBy("s", "chunk").orderBy("slot")) - 1
    ranked = points.join(before, ["s", "chunk"]).select("slot", "s", (F.col("before") + nth).alias("rank"))
    share = F.array(*[F.lit(int(n)) for n in counts] or [F.lit(0)])
    given = ranked.where(F.col("rank") < F.get(share, F.col("s")))
    # A source's points may fall short of its slots by a few, which come last.
    had = {r["s"]: r["n"] for r in points.groupBy("s").agg(F.count("*").alias("n")).collect()}
    owed = [(i, rank) for i, n in enumerate(counts.tolist()) for rank in range(min(had.get(i, 0), n), n)]
    late = spark.createDataFrame([(total + k, i, rank) for k, (i, rank) in enumerate(owed)], "slot long, s int, rank long")
    return given.unionByName(late)


@dataclass
class Layout:
    """Documents with their source's share (``rows``) and where they begin in it (``placed``), and the slots."""

    rows: DataFrame
    placed: DataFrame | None = None
    slots: DataFrame | None = None


def laid_out(docs: DataFrame, block: int, repeats: int, row: Column | None) -> Layout:
    spark = docs.sparkSession
    row = F.monotonically_increasing_id() if row is None else row
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    sized = docs.select("doc_id", "source", size.alias("size"), row.alias("row"))
    sized = materialize(sized.withColumn("key", F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")))), "sizes")
    per_source = sized.groupBy("source").agg(F.sum("size").alias("size"), F.count("*").alias("n")).collect()
    plan = shares({r["source"]: r["size"] for r in per_source}, block, repeats)
    if not plan:
        return Layout(sized.withColumns({"source_size": F.col("size"), "target": F.lit(0.0)}))
    table = spark.createDataFrame(
        [(i, s.source, s.size, s.target, s.take, s.block, s.blocks, s.slots) for i, s in enumerate(plan)],
        "s int, name string, source_size long, target double, take long, block long, blocks long, slots long",
    )
    known = sized.join(F.broadcast(table), F.col("source").eqNullSafe(F.col("name"))).drop("name")

    # Where each document begins in its shuffled source: sums over groups of the digest, then inside.
    groups = max(1, -(-max(r["n"] for r in per_source) // GROUP))
    known = known.withColumn("g", F.expr(f"cast(conv(substr(key, 1, 8), 16, 10) AS bigint) * {groups} div {1 << 32}"))
    order = ["key", "doc_id", "size", "row"]
    sums = known.groupBy("s", "g").agg(F.sum("size").alias("words"))
    running = Window.partitionBy("s").orderBy("g").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("s", "g", F.coalesce(F.sum("words").over(running), F.lit(0)).alias("base"))
    inside = Window.partitionBy("s", "g").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    placed = known.join(sums, ["s", "g"]).withColumn("first", F.col("base") + F.coalesce(F.sum("size").over(inside), F.lit(0)))
    return Layout(known, placed, schedule(spark, plan).join(F.broadcast(table.drop("name", "target")), "s"))


def pieces(layout: Layout) -> DataFrame:
    """(slot, source, doc_id, row, first, length): the words that fill each slot, from which documents they come.

    The ranked slots of a source are joined with its blocks; a block holds parts of the documents it cuts.
    ``first`` counts from 0 within the document.
    """
    last = F.col("rank") == F.col("slots") - 1
    number = F.col("rank") % F.col("blocks")
    rest = F.col("take") % F.col("source_size")
    cut = F.when(last & (rest > 0), rest - number * F.col("block")).otherwise(F.col("block"))
    filled = layout.slots.select("slot", "s", number.alias("number"), cut.alias("cut"))
    parts = layout.placed.where("size > 0").select(
        "row", "doc_id", "source", "s", "first", "size", "block",
        F.explode(F.expr("sequence(first div block, (first + size - 1) div block)")).alias("number"),
    )
    at = F.col("number") * F.col("block")
    begin = F.greatest("first", at)
    length = F.least(F.col("first") + F.col("size"), at + F.col("cut")) - begin
    found = parts.join(filled, ["s", "number"]).where(length > 0)
    return found.select("slot", "source", "doc_id", "row", (begin - F.col("first")).alias("first"), length.alias("length"))


def mixed_pieces(docs: DataFrame, block: int = BLOCK, repeats: int = REPEATS) -> DataFrame:
    """(slot, source, doc_id, first, length): the mix in the order of its slots (``slot``), word by word of each document."""
    layout = laid_out(docs, block, repeats, None)
    if layout.placed is None:
        return layout.rows.select(F.col("size").alias("slot"), "source", "doc_id", F.col("size").alias("first"), F.col("size").alias("length"))
    return pieces(layout).drop("row")


def mix(docs: DataFrame, block: int = BLOCK, repeats: int = REPEATS, row: Column | None = None) -> DataFrame:
    """Per row: doc_id, row, source, size, source_size, target, taken (the words of its pieces).

    ``row`` numbers the rows of ``docs``; they get new numbers if it is not given.
    """
    layout = laid_out(docs, block, repeats, row)
    if layout.placed is None:
        return layout.rows.select("doc_id", "row", "source", "size", "source_size", "target", F.col("size").alias("taken"))
    taken = pieces(layout).groupBy("row").agg(F.sum("length").alias("taken"))
    return layout.rows.join(taken, "row", "left").select(
        "doc_id", "row", "source", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken")
    )


def mixed_documents(docs: DataFrame, block: int = BLOCK, repeats: int = REPEATS) -> DataFrame:
    """The rows of ``docs``, each as often as the mix takes it: the words taken over its size, rounded.

    Only documents at the end of a source's share are taken in part; these are taken whole or not at
    all. Documents without a word are taken once.
    """
    columns = docs.columns
    held = docs.select(F.struct(*columns).alias("_doc"), "doc_id", "text", "source")
    held = materialize(held.withColumn("_number", F.monotonically_increasing_id()), "mixing")
    times = F.when(F.col("size") > 0, F.floor(F.col("taken") / F.col("size") + 0.5)).otherwise(F.lit(1)).cast("int")
    mixed = mix(held, block, repeats, F.col("_number"))
    chosen = mixed.select(F.col("row").alias("_number"), times.alias("_times")).where("_times > 0")
    repeated = held.select("_doc", "_number").join(chosen, "_number")
    return repeated.select("_doc", F.explode(F.sequence(F.lit(1), F.col("_times")))).select("_doc.*")


# The order of the slots is no part of the words taken, so SQL gets by without the schedule.
SQL = f"""
WITH sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size FROM documents),
sums AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
weighed AS (
  SELECT source, source_size, {REPEATS} * source_size AS cap,
         (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS weight FROM sums),
filling AS (
  SELECT *, coalesce(sum(cap) OVER before, 0) AS filled, sum(weight) OVER from_here AS open_weight
  FROM weighed WINDOW before AS (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
  from_here AS (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
level AS (
  SELECT level FROM (
    SELECT ((SELECT sum(source_size) FROM sums) - filled) / open_weight AS level, cap / weight AS ratio, source FROM filling)
  WHERE level <= ratio ORDER BY ratio, source NULLS LAST LIMIT 1),
aimed AS (SELECT source, source_size, least(cap, weight * level)::DOUBLE AS target FROM weighed, level),
placed AS (
  SELECT s.doc_id, s.size, a.source_size, a.target, least({REPEATS} * a.source_size, floor(a.target + 0.5))::BIGINT AS take,
         sum(s.size) OVER (PARTITION BY s.source ORDER BY md5(coalesce(s.doc_id::VARCHAR, '')), s.doc_id, s.size ROWS UNBOUNDED PRECEDING) - s.size AS first
  FROM sized s JOIN aimed a ON s.source IS NOT DISTINCT FROM a.source)
SELECT doc_id, size, source_size, target, (CASE WHEN size = 0 THEN 0 ELSE
  take // source_size * size + greatest(0, least(first + size, take % source_size) - first) END)::BIGINT AS taken
FROM placed
"""
