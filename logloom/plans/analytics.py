"""The analytics run: window features, anomalies, error clusters, and a record of the run."""

from __future__ import annotations

import uuid
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas
from ..operators.filters import default_range, error_messages, utc_now
from ..operators.iforest import CONTAMINATION, TREES, describe_window, fit_score_iforest, flag_anomalies
from ..operators.textcluster import RESTARTS, assign_clusters, cluster_table
from ..operators.windows import WINDOW_MINUTES, window_features
from ..session import materialize
from ..sources import tables


def anomaly_rows(
    scored: DataFrame,
    run_id: str | None = None,
    created_at: datetime | None = None,
    contamination: float = CONTAMINATION,
) -> DataFrame:
    """The flagged windows as rows of the anomaly table."""
    flagged = flag_anomalies(scored, contamination)
    return flagged.select(
        "window_start",
        "window_end",
        "score",
        (-F.col("score_samples")).alias("anomaly_score"),
        F.struct(*schemas.WINDOW_MEASURES).alias("features"),
        describe_window(
            F.col("total_count"), F.col("error_rate"), F.col("error_count"), F.col("unique_services")
        ).alias("description"),
        F.lit(run_id).cast("string").alias("pipeline_run_id"),
        F.lit(None if created_at is None else str(created_at)).cast("timestamp_ntz").alias("created_at"),
    )


def cluster_rows(
    messages: DataFrame, run_id: str | None = None, created_at: datetime | None = None, **options
) -> DataFrame | None:
    """The clusters as rows of the cluster table; None if there is nothing to cluster."""
    assigned = assign_clusters(messages, **options)
    if assigned is None:
        return None
    return cluster_table(*assigned).withColumns(
        {
            "pipeline_run_id": F.lit(run_id).cast("string"),
            "created_at": F.lit(None if created_at is None else str(created_at)).cast("timestamp_ntz"),
        }
    )


def detect(
    spark: SparkSession,
    root: str,
    features: DataFrame,
    run_id: str,
    trees: int = TREES,
    contamination: float = CONTAMINATION,
) -> int:
    """Replace the anomalies in the range of the features; too few windows leave them as they are."""
    scored = fit_score_iforest(features, trees)
    ends = scored.agg(F.min("window_start").alias("first"), F.max("window_end").alias("last")).first()
    if ends["first"] is None:
        return 0
    new = anomaly_rows(scored, run_id, utc_now(), contamination)
    new = materialize(new, "anomalies")  # not computed again should another run publish first
    tables.publish(spark, root, "anomalies", lambda old: tables.replace_anomalies(old, new, ends["first"], ends["last"]))
    return new.count()


def cluster(root: str, messages: DataFrame, run_id: str, **options) -> int:
    """Replace all clusters; too few messages or no usable term leave them as they are."""
    rows = cluster_rows(messages, run_id, utc_now(), **options)
    return 0 if rows is None else tables.replace_clusters(materialize(rows, "clusters"), root).count()


def record_run(
    spark: SparkSession,
    root: str,
    run_id: str,
    trigger: str,
    started_at: datetime,
    status: str = "running",
    anomalies: int | None = None,
    clusters: int | None = None,
    error: str | None = None,
) -> DataFrame:
    """Append a state of a run."""
    finished_at = None if status == "running" else utc_now()
    seconds = None if finished_at is None else (finished_at - started_at).total_seconds()
    row = (run_id, trigger, status, anomalies, clusters, started_at, finished_at, seconds, error)
    run = spark.createDataFrame([row], schemas.PIPELINE_RUNS)
    tables.append_rows(run, root, "pipeline_runs")
    return run


def run_analytics(
    spark: SparkSession,
    root: str,
    entries: DataFrame | None = None,
    trigger: str = "manual",
    start: datetime | None = None,
    end: datetime | None = None,
    minutes: int = WINDOW_MINUTES,
    error_levels: tuple[str, ...] = ("ERROR",),
    stop_words: list[str] | None = None,
    trees: int = TREES,
    contamination: float = CONTAMINATION,
    restarts: int = RESTARTS,
) -> DataFrame:
    """One run over a time range, the last 24 hours by default; its record comes back.

    ``trees`` and ``contamination`` go to the forest, ``error_levels``, ``stop_words`` and ``restarts``
    to the clusters. A failure is recorded, not raised.
    """
    run_id, started_at = uuid.uuid4().hex, utc_now()
    run = (spark, root, run_id, trigger, started_at)
    record_run(*run)
    try:
        start, end = default_range(start, end, started_at)
        entries = tables.entries_table(spark, root, start, end) if entries is None else entries
        anomalies = detect(spark, root, window_features(entries, start, end, minutes), run_id, trees, contamination)
        messages = error_messages(entries, start, end, error_levels)
        clusters = cluster(root, messages, run_id, stop_words=stop_words, restarts=restarts)
    except Exception as error:
        return record_run(*run, "failed", error=str(error))
    return record_run(*run, "completed", anomalies, clusters)
