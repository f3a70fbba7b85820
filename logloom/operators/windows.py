"""Time windows, timelines and histograms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .aggregates import WARN_LEVELS, count_level, error_rate, unique_services
from .filters import by_time, with_time

WINDOW_MINUTES = 2


def bucket(ts: Column, minutes: int = WINDOW_MINUTES) -> Column:
    """Tumbling window from the epoch on: start inclusive, end exclusive."""
    return F.window(ts, f"{minutes} minutes")


def window_counts() -> list[Column]:
    return [
        F.count("*").alias("total_count"),
        count_level("ERROR").alias("error_count"),
        count_level(*WARN_LEVELS).alias("warn_count"),
        count_level("INFO").alias("info_count"),
        count_level("DEBUG").alias("debug_count"),
    ]


def finish_windows(counted: DataFrame) -> DataFrame:
    return counted.select(
        F.col("window.start").cast("timestamp_ntz").alias("window_start"),
        F.col("window.end").cast("timestamp_ntz").alias("window_end"),
        "total_count",
        "error_count",
        "warn_count",
        "info_count",
        "debug_count",
        error_rate(F.col("error_count"), F.col("total_count")).alias("error_rate"),
        "unique_services",
    )


def window_features(entries: DataFrame, start=None, end=None, minutes: int = WINDOW_MINUTES) -> DataFrame:
    """Counts per window with at least one dated entry.

    The distinct services go through a shuffle on (window, service) first, so a window that
    holds a large share of the entries is counted by many tasks.
    """
    rows = with_time(by_time(entries, start, end))
    counted = rows.groupBy(bucket(F.col("timestamp"), minutes).alias("window")).agg(
        *window_counts(), unique_services().alias("unique_services")
    )
    return finish_windows(counted)


def ordered(features: DataFrame) -> DataFrame:
    """Window features in time order, for output."""
    return features.orderBy("window_start")


def log_timeline(entries: DataFrame, max_buckets: int = 20) -> DataFrame:
    """Totals, errors and warnings in equal time buckets between the first and the last entry.

    There are ``min(max_buckets, entries)`` buckets, empty ones included; the last one is closed.
    Times count in milliseconds.
    """
    dated = with_time(entries).select("level", F.unix_millis(F.col("timestamp").cast("timestamp")).alias("ms"))
    bounds = dated.agg(
        F.min("ms").alias("first"),
        F.greatest(F.max("ms") - F.min("ms"), F.lit(1)).alias("span"),
        F.least(F.count("*"), F.lit(max_buckets)).cast("int").alias("buckets"),
    ).where(F.col("buckets") > 0)
    size = F.col("span") / F.col("buckets")

    b = bounds.select(F.struct("first", size.alias("size"), "buckets")).scalar()
    position = F.floor((F.col("ms") - b["first"]) / b["size"])
    counted = dated.groupBy(F.least(position, b["buckets"] - 1).cast("int").alias("bucket")).agg(
        F.count("*").alias("total"),
        count_level("ERROR").alias("errors"),
        count_level(*WARN_LEVELS).alias("warnings"),
    )
    axis = bounds.select(
        F.explode(F.sequence(F.lit(0), F.col("buckets") - 1)).alias("bucket"),
        F.col("first"),
        size.alias("size"),
    ).select("bucket", (F.col("first") + F.col("bucket") * F.col("size")).alias("start_ms"))
    zero = {"total": 0, "errors": 0, "warnings": 0}
    return axis.join(counted, "bucket", "left").na.fill(zero).orderBy("bucket")


def score_histogram(anomalies: DataFrame, score: str = "anomaly_score", bins: int = 10) -> DataFrame:
    """Windows per score bin of equal width in 0..1, empty bins included; the last one is closed."""
    which = F.lit(None).cast("int")
    for i in reversed(range(bins)):
        upper = F.lit(1.01) if i == bins - 1 else F.lit((i + 1) / bins)
        which = F.when((F.col(score) >= F.lit(i / bins)) & (F.col(score) < upper), F.lit(i)).otherwise(which)
    counted = anomalies.groupBy(which.alias("bin")).agg(F.count("*").alias("windows"))
    all_windows = anomalies.agg(F.count("*")).scalar()
    axis = anomalies.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    width = 100 // bins
    return (
        axis.join(counted, "bin", "left")
        .na.fill({"windows": 0})
        .select(
            "bin",
            F.format_string("%d-%d%%", F.col("bin") * width, (F.col("bin") + 1) * width).alias("label"),
            "windows",
            F.when(all_windows > 0, F.round(F.col("windows") / all_windows * 100, 1))
            .otherwise(0.0)
            .alias("share_pct"),
        )
        .orderBy("bin")
    )
