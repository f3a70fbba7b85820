"""K-Means from several starts at once: one scan of the points for each iteration of all starts.

The points are sparse vectors with a number of copies. A pass over them compares blocks of points with the
centres of every start that still moves, by matrix products, and adds up the points of each (start, centre);
these sums, at most starts x centres x terms numbers a task, are all that is shuffled. Starts that no longer move
leave the passes. First centres are found as by k-means||: in each of few passes every start draws several points
at once, a point the likelier the further it is from those drawn before; the drawn points, weighted by the
points nearest to them, are then clustered on the driver.

Draws follow from the point and the seed alone, so they do not depend on how the rows are partitioned.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.cloudpickle import register_pickle_by_value
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialize

# The tasks get the functions of this module by value and need not have the package installed.
register_pickle_by_value(sys.modules[__name__])

STEPS = 2  # drawing passes
TOLERANCE = 1e-4  # a start has ended when no centre moves further
BLOCK = 2_048  # points compared at a time
DIRECT = 32  # tasks whose sums go to the driver as they are; those of more are added up in a shuffle first

_SUMS = "start int, label int, weight double, cost double, sums binary"
_DRAWN = "start int, place double, indices array<int>, values array<double>"


def points_of(vectors: DataFrame) -> DataFrame:
    """(hash, copies, indices, values) of the column ``features``, written out without any text."""
    vector = F.unwrap_udt("features")
    parts = [vector["indices"].alias("indices"), vector["values"].alias("values")]
    copies = F.col("copies").cast("double").alias("copies")
    return materialize(vectors.select(F.xxhash64(*parts).alias("hash"), copies, *parts), "points")


def _dense(indices: pa.Array, values: pa.Array, terms: int) -> np.ndarray:
    rows = np.zeros((len(indices), terms))
    lengths = np.diff(indices.offsets.to_numpy())
    rows[np.repeat(np.arange(len(rows)), lengths), indices.flatten().to_numpy()] = values.flatten().to_numpy()
    return rows


def _blocks(batches: Iterator[pa.RecordBatch], terms: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    for batch in batches:
        for first in range(0, batch.num_rows, BLOCK):
            part = batch.slice(first, BLOCK)
            # A slice keeps the offsets of the whole; taking its rows makes offsets of its own.
            part = part.take(pa.array(np.arange(part.num_rows)))
            yield part, _dense(part.column("indices"), part.column("values"), terms)


def _squares(rows: np.ndarray, centers: np.ndarray) -> np.ndarray:
    """Squared distances: points x starts x centres."""
    starts, k, terms = centers.shape
    flat = centers.reshape(-1, terms)
    squares = (rows * rows).sum(1)[:, None] + (flat * flat).sum(1)[None, :] - 2 * rows @ flat.T
    return np.maximum(squares, 0).reshape(len(rows), starts, k)


def _uniform(hashes: np.ndarray, start: int, step: int, seed: int) -> np.ndarray:
    x = hashes.astype(np.int64).view(np.uint64) + np.uint64((seed * 1_000_003 + start * 1_009 + step) * 0x9E3779B97F4A7C15 % (1 << 64))
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return ((x ^ (x >> np.uint64(31))) >> np.uint64(11)).astype(float) / (1 << 53) + 2.0**-54


def _draw(points: DataFrame, drawn: list[np.ndarray], many: int, step: int, seed: int, terms: int) -> list[np.ndarray]:
    """For each start ``many`` more points, drawn by their copies times their squared distance from ``drawn``.

    An exponential race: the points of the smallest -ln(u) / weight are a draw without replacement.
    """
    starts = len(drawn)
    held = points.sparkSession.sparkContext.broadcast(drawn)

    def race(batches):
        best: list[list] = [[] for _ in range(starts)]
        for part, rows in _blocks(batches, terms):
            hashes, copies = part.column("hash").to_numpy(), part.column("copies").to_numpy()
            for start, before in enumerate(held.value):
                weight = copies * (_squares(rows, before[None])[:, 0].min(1) if len(before) else 1.0)
                near = weight > 1e-12 * copies
                place = np.full(len(rows), np.inf)
                place[near] = -np.log(_uniform(hashes[near], start, step, seed)) / weight[near]
                for i in np.argsort(place, kind="stable")[:many]:
                    if np.isfinite(place[i]):
                        at = np.flatnonzero(rows[i])
                        best[start].append((start, float(place[i]), at.tolist(), rows[i, at].tolist()))
                best[start] = sorted(best[start], key=lambda b: b[1])[:many]
        yield pa.RecordBatch.from_pylist(
            [dict(zip(("start", "place", "indices", "values"), b)) for found in best for b in found],
            pa.schema([("start", pa.int32()), ("place", pa.float64()), ("indices", pa.list_(pa.int32())), ("values", pa.list_(pa.float64()))]),
        )

    found = points.mapInArrow(race, _DRAWN)
    ranked = found.groupBy("start").agg(F.slice(F.array_sort(F.collect_list(F.struct("place", "indices", "values"))), 1, many).alias("best"))
    out = list(drawn)
    for row in ranked.collect():  # at most starts x many points
        rows = np.zeros((len(row["best"]), terms))
        for at, point in zip(rows, row["best"]):
            at[point["indices"]] = point["values"]
        out[row["start"]] = np.concatenate([drawn[row["start"]], rows])
    return out


def _pass(points: DataFrame, centers: np.ndarray, tasks: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of every start: the weight and the sum of the points of each centre, and the cost of all."""
    starts, k, terms = centers.shape
    held = points.sparkSession.sparkContext.broadcast(centers)

    def add(batches):
        sums, weights, costs = np.zeros((starts * k, terms)), np.zeros((starts, k)), np.zeros(starts)
        for part, rows in _blocks(batches, terms):
            copies = part.column("copies").to_numpy()
            squares = _squares(rows, held.value)
            label = squares.argmin(2)
            costs += copies @ np.take_along_axis(squares, label[:, :, None], 2)[:, :, 0]
            member = np.zeros((len(rows), starts, k))
            np.put_along_axis(member, label[:, :, None], copies[:, None, None], 2)
            weights += member.sum(0)
            sums += member.reshape(len(rows), -1).T @ rows
        if weights.any():
            yield pa.RecordBatch.from_pylist(
                [
                    {"start": s, "label": c, "weight": weights[s, c], "cost": costs[s] if c == 0 else 0.0, "sums": sums[s * k + c].tobytes()}
                    for s in range(starts)
                    for c in range(k)
                    if weights[s, c] or c == 0
                ],
                pa.schema([("start", pa.int32()), ("label", pa.int32()), ("weight", pa.float64()), ("cost", pa.float64()), ("sums", pa.binary())]),
            )

    def total(rows: pd.DataFrame) -> pd.DataFrame:
        out = rows.iloc[:1].copy()
        out["weight"], out["cost"] = rows["weight"].sum(), rows["cost"].sum()
        out["sums"] = [np.sum([np.frombuffer(b) for b in rows["sums"]], axis=0).tobytes()]
        return out

    partial = points.mapInArrow(add, _SUMS)
    if tasks > DIRECT:
        partial = partial.groupBy("start", "label").applyInPandas(total, _SUMS)
    weights, sums, costs = np.zeros((starts, k)), np.zeros((starts, k, terms)), np.zeros(starts)
    for row in partial.collect():  # at most DIRECT x starts x centres rows of one number a term
        weights[row["start"], row["label"]] += row["weight"]
        costs[row["start"]] += row["cost"]
        sums[row["start"], row["label"]] += np.frombuffer(row["sums"])
    return weights, sums, costs


def _reduced(candidates: np.ndarray, weights: np.ndarray, k: int, rng: np.random.Generator) -> np.ndarray:
    """``k`` centres of a start's drawn points: drawn one by one like k-means++, then moved a few times."""
    held = np.flatnonzero(weights > 0)
    rows, weights = candidates[held], weights[held]
    chosen = [int(rng.choice(len(rows), p=weights / weights.sum()))]
    while len(chosen) < k:
        far = weights * _squares(rows, rows[chosen][None])[:, 0].min(1)
        if not far.sum() > 0:
            chosen += [chosen[0]] * (k - len(chosen))  # fewer different points than centres
            break
        chosen.append(int(rng.choice(len(rows), p=far / far.sum())))
    centers = rows[chosen].copy()
    for _ in range(30):
        label = _squares(rows, centers[None])[:, 0].argmin(1)
        for c in np.unique(label):
            own = label == c
            centers[c] = weights[own] @ rows[own] / weights[own].sum()
    return centers


def fit(vectors: DataFrame, terms: int, k: int, starts: int, seed: int, iterations: int) -> np.ndarray:
    """The centres (k x terms) of the start of least cost."""
    points = points_of(vectors)
    tasks = points.rdd.getNumPartitions()
    drawn = _draw(points, [np.zeros((0, terms))] * starts, 1, 0, seed, terms)
    for step in range(1, STEPS + 1):
        drawn = _draw(points, drawn, 2 * k, step, seed, terms)
    most = max(map(len, drawn))
    # Starts with fewer points are filled with points out of reach.
    candidates = np.full((starts, most, terms), 1e6)
    for own, points_drawn in zip(candidates, drawn):
        own[: len(points_drawn)] = points_drawn
    weights, _, _ = _pass(points, candidates, tasks)
    centers = np.stack([_reduced(candidates[s], weights[s], k, np.random.default_rng([seed, s])) for s in range(starts)])
    costs, moving = np.full(starts, np.inf), np.arange(starts)
    for _ in range(iterations):
        weights, sums, costs[moving] = _pass(points, centers[moving], tasks)
        moved = np.where(weights[:, :, None] > 0, sums / np.maximum(weights, 1e-300)[:, :, None], centers[moving])
        shift = np.sqrt(((moved - centers[moving]) ** 2).sum(2)).max(1)
        centers[moving] = moved
        moving = moving[shift > TOLERANCE]
        if not len(moving):
            break
    return centers[int(costs.argmin())]


def nearest(features: Column, centers: np.ndarray) -> Column:
    """The number of the nearest centre, the least of equally near ones."""
    terms = centers.shape[1]

    @F.pandas_udf("int")
    def label(batches: Iterator[pd.DataFrame]) -> Iterator[pd.Series]:
        for batch in batches:
            labels = np.zeros(len(batch), np.int32)
            for first in range(0, len(batch), BLOCK):
                part = batch.iloc[first : first + BLOCK]
                rows = np.zeros((len(part), terms))
                for at, indices, values in zip(rows, part["indices"], part["values"]):
                    at[indices] = values
                labels[first : first + BLOCK] = _squares(rows, centers[None])[:, 0].round(12).argmin(1)
            yield pd.Series(labels)

    vector = F.unwrap_udt(features)
    return label(F.struct(vector["indices"].alias("indices"), vector["values"].alias("values")))
