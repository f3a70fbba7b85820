"""Isolation Forest over window features, and the cut that flags anomalies.

Each tree is grown from at most 256 windows, drawn by hash, so the sample does not depend on
how the rows are partitioned. The trees are small and bounded (100 trees of at most 511
nodes); they are gathered on the driver and broadcast to the scoring tasks.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.cloudpickle import register_pickle_by_value
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import percentile, round_even
from ..session import materialize

# The tasks get the functions of this module by value and need not have the package installed.
register_pickle_by_value(sys.modules[__name__])

FEATURE_KEYS = ["total_count", "error_count", "error_rate", "unique_services", "warn_count"]
TREES = 100
SEED = 42
SAMPLE = 256
CONTAMINATION = 0.1
MIN_WINDOWS = 5

_NODES = "tree INT, node INT, feature INT, cut DOUBLE, child INT, value DOUBLE"


def mean_path(n: np.ndarray | float) -> np.ndarray:
    """Mean depth of an unsuccessful search in a binary search tree of ``n`` rows."""
    n = np.asarray(n, dtype=float)
    inner = 2.0 * (np.log(np.maximum(n, 2.0) - 1.0) + np.euler_gamma) - 2.0 * (n - 1.0) / np.maximum(n, 1.0)
    return np.where(n <= 1, 0.0, np.where(n == 2, 1.0, inner))


def _grow(rows: np.ndarray, rng: np.random.Generator, depth_limit: int) -> list[tuple]:
    """Nodes ``(feature, cut, child, value)``; children sit at ``child`` and ``child + 1``, leaves have -1."""
    nodes: list[tuple] = [()]
    todo = [(0, np.arange(len(rows)), 0)]
    while todo:
        at, members, depth = todo.pop()
        low, high = rows[members].min(axis=0), rows[members].max(axis=0)
        varied = np.flatnonzero(high > low)
        if depth >= depth_limit or len(varied) == 0:
            nodes[at] = (-1, 0.0, -1, depth + float(mean_path(len(members))))
            continue
        feature = int(rng.choice(varied))
        cut = float(rng.uniform(low[feature], high[feature]))
        left = rows[members, feature] <= cut
        child = len(nodes)
        nodes[at] = (feature, cut, child, 0.0)
        nodes += [(), ()]
        todo += [(child, members[left], depth + 1), (child + 1, members[~left], depth + 1)]
    return nodes


def fit_forest(features: DataFrame, n: int, trees: int = TREES, seed: int = SEED) -> DataFrame:
    """The nodes of all trees. ``n`` is the number of windows."""
    sample = min(SAMPLE, n)
    depth_limit = int(np.ceil(np.log2(max(sample, 2))))
    # About four times the sample per tree passes the filter; the tree keeps the lowest hashes.
    draw = F.filter(
        F.sequence(F.lit(0), F.lit(trees - 1)),
        lambda t: F.pmod(F.xxhash64(F.col("window_start"), t, F.lit(seed)), F.lit(n)) < 4 * sample,
    )
    drawn = features.select(
        "window_start", *[F.col(k).cast("double").alias(k) for k in FEATURE_KEYS], F.explode(draw).alias("tree")
    ).withColumn("rank_hash", F.xxhash64("window_start", "tree", F.lit(seed)))

    def grow(rows: pd.DataFrame) -> pd.DataFrame:
        tree = int(rows["tree"].iloc[0])
        kept = rows.sort_values(["rank_hash", "window_start"]).head(sample)
        nodes = _grow(kept[FEATURE_KEYS].to_numpy(float), np.random.default_rng([seed, tree]), depth_limit)
        out = pd.DataFrame(nodes, columns=["feature", "cut", "child", "value"])
        out.insert(0, "node", range(len(nodes)))
        out.insert(0, "tree", tree)
        return out

    return drawn.groupBy("tree").applyInPandas(grow, _NODES)


def score_windows(features: DataFrame, forest: DataFrame, n: int) -> DataFrame:
    """Add ``score_samples``: minus the anomaly score, in [-1, 0)."""
    nodes = forest.toPandas().sort_values(["tree", "node"])
    roots = np.flatnonzero(nodes["node"].to_numpy() == 0)
    first = np.repeat(roots, np.diff([*roots, len(nodes)]))
    child = nodes["child"].to_numpy()
    model = features.sparkSession.sparkContext.broadcast(
        (
            roots,
            nodes["feature"].to_numpy(),
            nodes["cut"].to_numpy(),
            np.where(child < 0, -1, child + first),
            nodes["value"].to_numpy(),
        )
    )
    scale = float(mean_path(min(SAMPLE, n)))

    @F.pandas_udf("double")
    def path_score(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        roots, feature, cut, child, value = model.value
        for batch in batches:
            rows = np.column_stack([s.to_numpy(float) for s in batch])
            index = np.arange(len(rows))
            depth = np.zeros(len(rows))
            for root in roots:
                at = np.full(len(rows), root)
                inner = feature[at] >= 0
                while inner.any():
                    right = rows[index, np.maximum(feature[at], 0)] > cut[at]
                    at = np.where(inner, child[at] + right, at)
                    inner = feature[at] >= 0
                depth += value[at]
            yield pd.Series(-np.power(2.0, -depth / (len(roots) * scale)))

    return features.withColumn("score_samples", path_score(*[F.col(k).cast("double") for k in FEATURE_KEYS]))


def fit_score_iforest(features: DataFrame, trees: int = TREES, seed: int = SEED) -> DataFrame:
    """Score every window; no rows if there are fewer than five windows.

    The features and the scores are written to the shared folder, as both are read several times.
    """
    features = materialize(features, "window_features")
    n = features.count()
    if n < MIN_WINDOWS:
        return features.withColumn("score_samples", F.lit(None).cast("double")).where(F.lit(False))
    forest = fit_forest(features, n, trees, seed)
    return materialize(score_windows(features, forest, n), "window_scores")


def flag_anomalies(
    scored: DataFrame, contamination: float = CONTAMINATION, column: str = "score_samples"
) -> DataFrame:
    """Rows below the ``contamination`` percentile, with ``score`` as the distance from it."""
    if scored.isEmpty():
        return scored.withColumn("score", F.col(column)).where(F.lit(False))
    cut = percentile(scored, column, contamination)
    return scored.withColumn("score", F.col(column) - F.lit(cut)).where(F.col("score") < 0)


def describe_window(total: Column, rate: Column, errors: Column, services: Column) -> Column:
    """Text such as ``Anomalous window: 100 events in window, 10.0% error rate, 10 errors, 3 services``."""
    parts = F.concat_ws(
        ", ",
        F.format_string("%d events in window", total),
        F.when(rate > 0, F.concat(F.format_number(round_even(rate * 100, 1), 1), F.lit("% error rate"))),
        F.when(errors > 0, F.format_string("%d errors", errors)),
        F.format_string("%d services", services),
    )
    return F.concat(F.lit("Anomalous window: "), parts)
