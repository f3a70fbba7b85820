"""Exact top-k by inner product as a Voronoi join (after Lu et al., 2012).

Vectors become integers, floor(256 x) per component. Pivots split the vectors into cells; the
summary of a cell is its size, its radius and its least distances to the pivot. For a query q and a
vector x of the cell of pivot p, q.x lies within q.p - |q| d(x, p) and q.p + |q| d(x, p). The lower
bounds over the summaries give a score that k vectors are known to reach; so a group of queries needs
from a cell only the vectors that are far enough from the pivot to reach it. These alone are sent to
the group, in blocks; every task keeps the best k per query of its blocks, and a last step the best k
of all.

Vectors that are null or hold null or non-finite components take no part; missing components of
shorter vectors count as 0. Ties go to the smaller vec_id; of repeated ids every row is a candidate
for other queries, and a query row for each. Rows of the query's own id are never its candidates. Null
ids are candidates that lose ties but no queries.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logloom.session import materialize

from .common import ship

K = 5
PIVOTS = 64  # drawn by hash
GROUP = 256  # queries solved together, of neighbouring cells
BLOCK = 1_024  # vectors sent together
EXACT = 1 << 53  # integers up to which doubles are exact


def integers(vector: Column) -> Column:
    return F.transform(vector, lambda x: F.floor(F.lit(256) * x.cast("double")).cast("long"))


def usable(vector: Column) -> Column:
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vector.isNotNull() & ~F.coalesce(bad, F.lit(False))


def matrix(vectors, width: int) -> np.ndarray:
    out = np.zeros((len(vectors), width), np.int64)
    for i, v in enumerate(vectors):
        out[i, : len(v)] = v
    return out


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a b^T of integers; through floating point where that is exact."""
    high = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * max(1, a.shape[1])
    if high < EXACT:
        return (a.astype(np.float64) @ b.T.astype(np.float64)).astype(np.int64)
    return a @ b.T


def known_scores(
    dots: np.ndarray, norms: np.ndarray, least: list[np.ndarray], radius: np.ndarray, sizes: np.ndarray, k: int, own: np.ndarray
) -> np.ndarray:
    """Per query a score that k vectors besides its own reach, from the summaries of the cells.

    ``own`` is the number of rows with the query's id: all of them may be among those that reach it.
    The vectors nearest a pivot are bounded by their own distances, the others by the radius.
    """
    bounds, counts = [], []
    for c in range(len(sizes)):
        for d in least[c]:
            bounds.append(dots[:, c] - norms * d)
            counts.append(1)
        bounds.append(dots[:, c] - norms * radius[c])
        counts.append(max(0, int(sizes[c]) - len(least[c])))
    bounds, counts = np.stack(bounds, 1), np.array(counts)
    order = np.argsort(-bounds, 1, kind="stable")
    reached = np.cumsum(counts[order], 1) >= k + own[:, None]
    first = np.where(reached.any(1), reached.argmax(1), 0)
    known = np.take_along_axis(bounds, order, 1)[np.arange(len(bounds)), first]
    return np.where(reached.any(1), known, -np.inf)


def top_k(vectors: DataFrame, is_query: Column, k: int = K, pivots: int = PIVOTS, group: int = GROUP) -> DataFrame:
    """(query_id, rank, vec_id, score): for each query row its k best candidates, all if there are fewer.

    ``vectors`` has vec_id and embedding. The pivots and, per cell, k + 3 numbers are all that the
    driver holds.
    """
    spark = vectors.sparkSession
    ship(spark)
    kept = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding", is_query.alias("query")).where(usable(F.col("embedding")))
    kept = kept.select("vec_id", F.coalesce("query", F.lit(False)).alias("query"), integers(F.col("embedding")).alias("v"))
    kept = materialize(kept.withColumn("row", F.monotonically_increasing_id()), "vectors")
    schema = "query_id long, rank int, vec_id long, score long"
    width = kept.agg(F.max(F.size("v"))).first()[0]
    if width is None:
        return spark.createDataFrame([], schema)
    drawn = kept.select("v").distinct().orderBy(F.xxhash64("v"), "v").limit(pivots).collect()
    centres = matrix([r["v"] for r in drawn], width)
    given = spark.sparkContext.broadcast(centres.astype(np.float64))

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        p = given.value
        for b in batches:
            x = matrix(b["v"], width).astype(np.float64)
            squares = (x**2).sum(1)[:, None] + (p**2).sum(1) - 2 * x @ p.T
            cell = squares.argmin(1)
            distance = np.sqrt(((x - p[cell]) ** 2).sum(1))
            yield b.assign(cell=cell.astype(np.int32), distance=distance)

    cells = materialize(kept.mapInPandas(assign, "vec_id long, query boolean, v array<long>, row long, cell int, distance double"), "cells")
    nearest = Window.partitionBy("cell", F.pmod(F.xxhash64("row"), F.lit(32))).orderBy("distance")
    near = cells.select("cell", "distance", "row").withColumn("nth", F.row_number().over(nearest)).where(F.col("nth") <= k + 1)
    near = near.withColumn("nth", F.row_number().over(Window.partitionBy("cell").orderBy("distance"))).where(F.col("nth") <= k + 1)
    least: dict[int, list[float]] = {}
    for r in near.collect():  # k + 1 per cell
        least.setdefault(r["cell"], []).append(r["distance"])
    sums = {
        r["cell"]: r
        for r in cells.groupBy("cell")
        .agg(F.count("*").alias("n"), F.max("distance").alias("radius"), F.sum(F.col("query").cast("long")).alias("queries"))
        .collect()
    }
    used = sorted(sums)
    # Queries of a cell in groups; small neighbouring cells share one.
    first_group, groups, filled = {}, 0, 0
    for c in used:
        queries = sums[c]["queries"]
        if filled and filled + queries > group:
            groups, filled = groups + 1, 0
        spread = max(1, -(-queries // group))
        first_group[c] = (groups, spread)
        groups, filled = (groups + spread, 0) if spread > 1 else (groups, filled + queries)
    summary = spark.sparkContext.broadcast(
        {
            "cells": np.array(used),
            "centres": centres[used].astype(np.float64),
            "least": [np.sort(np.array(least[c])) for c in used],
            "radius": np.array([sums[c]["radius"] for c in used]),
            "sizes": np.array([sums[c]["n"] for c in used]),
        }
    )
    table = spark.createDataFrame([(c, *first_group[c]) for c in used], "cell int, base int, spread int")
    queries = cells.where("query AND vec_id IS NOT NULL").join(F.broadcast(table), "cell")
    repeated = cells.groupBy("vec_id").agg(F.count("*").alias("own")).where("own > 1")
    queries = queries.join(repeated, "vec_id", "left").select(
        (F.col("base") + F.pmod(F.xxhash64("row"), F.col("spread")).cast("int")).alias("g"),
        "row",
        "vec_id",
        "v",
        F.coalesce("own", F.lit(1)).alias("own"),
    )

    def describe(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        """A group of queries: their vectors, and per cell how far from the pivot a vector must be."""
        s = summary.value
        rows = rows.sort_values("row")
        q = matrix(rows["v"], width)
        norms = np.sqrt((q.astype(np.float64) ** 2).sum(1))
        dots = q @ s["centres"].T
        known = known_scores(dots, norms, s["least"], s["radius"], s["sizes"], k, rows["own"].to_numpy())
        # Rounding of the bounds must not lose a vector: take a little less.
        slack = 1e-9 * (np.abs(dots) + norms[:, None] * s["radius"] + 1)
        reach = (known[:, None] - dots - slack) / np.maximum(norms, 1e-300)[:, None] - 1e-6
        reach = np.where(norms[:, None] > 0, reach, -np.inf)
        return pd.DataFrame(
            [(key[0], rows["row"].tolist(), rows["vec_id"].tolist(), q.tobytes(), reach.min(0).tolist())],
            columns=["g", "rows", "ids", "q", "reach"],
        )

    described = queries.groupBy("g").applyInPandas(describe, "g int, rows array<long>, ids array<long>, q binary, reach array<double>")
    described = materialize(described, "queries")

    # Which vectors a group needs of each cell: those at that distance or more.
    needs = described.select("g", F.posexplode("reach").alias("i", "reach"))
    needs = needs.join(F.broadcast(spark.createDataFrame([(i, c) for i, c in enumerate(used)], "i int, cell int")), "i")
    needs = needs.groupBy("cell").agg(F.collect_list(F.struct("g", "reach")).alias("needs"))

    def blocks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Vectors by the groups that need them, packed into blocks."""
        for b in batches:
            ids = b["vec_id"].astype("Int64").fillna(np.iinfo(np.int64).max).to_numpy(np.int64)
            x, distance = matrix(b["v"], width), b["distance"].to_numpy()
            by_group: dict[int, list[np.ndarray]] = {}
            for _, rows in b.groupby("cell").indices.items():
                for need in b["needs"].iloc[rows[0]]:
                    far = rows[distance[rows] >= need["reach"]]
                    if len(far):
                        by_group.setdefault(need["g"], []).append(far)
            out = []
            for g, found in by_group.items():
                found = np.concatenate(found)
                for at in range(0, len(found), BLOCK):
                    part = found[at : at + BLOCK]
                    out.append((g, ids[part].tobytes(), x[part].tobytes()))
            yield pd.DataFrame(out, columns=["g", "block_ids", "block"])

    sent = cells.select("vec_id", "v", "cell", "distance").join(F.broadcast(needs), "cell")
    sent = sent.mapInPandas(blocks, "g int, block_ids binary, block binary")

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[int, tuple] = {}
        for b in batches:
            for g, rows, own, q, block_ids, block in zip(b["g"], b["rows"], b["ids"], b["q"], b["block_ids"], b["block"]):
                own = np.asarray(own, np.int64)
                a = np.frombuffer(q, np.int64).reshape(len(own), width)
                ids = np.frombuffer(block_ids, np.int64)
                scores = products(a, np.frombuffer(block, np.int64).reshape(len(ids), width))
                wide = np.broadcast_to(ids, scores.shape)
                valid = wide != own[:, None]
                found, names = _best_valid(scores, wide, valid, k)
                if g in held:
                    found, names = np.c_[held[g][1], found], np.c_[held[g][2], names]
                    found, names = _best_valid(found, names, names != _NONE, k)
                held[g] = (np.asarray(rows), found, names, own)
        out = []
        for rows, found, names, own in held.values():
            for i in range(len(rows)):
                for score, name in zip(found[i].tolist(), names[i].tolist()):
                    if name != _NONE:
                        out.append((int(rows[i]), int(own[i]), name, score))
        yield pd.DataFrame(out, columns=["row", "query_id", "vec_id", "score"])

    local = sent.join(described.select("g", "rows", "ids", "q"), "g").mapInPandas(solve, "row long, query_id long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("row").orderBy(F.desc("score"), "vec_id")).alias("rank")
    ranked = local.select("query_id", rank, "vec_id", "score").where(F.col("rank") <= k)
    unnamed = F.col("vec_id") == int(np.iinfo(np.int64).max)
    return ranked.withColumn("vec_id", F.when(~unnamed, F.col("vec_id")))


_NONE = int(np.iinfo(np.int64).min)


def _best_valid(scores: np.ndarray, ids: np.ndarray, valid: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """``best`` among the valid entries; rows with fewer end in entries of id _NONE."""
    order = np.lexsort((ids, -scores, ~valid), 1)[:, :k]
    kept = np.take_along_axis(valid, order, 1)
    return np.take_along_axis(scores, order, 1), np.where(kept, np.take_along_axis(ids, order, 1), _NONE)


SQL = f"""
WITH ok AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2]))::BIGINT AS score
  FROM ok q JOIN ok c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM scored)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= {K}
"""
