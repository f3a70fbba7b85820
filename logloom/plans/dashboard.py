"""The queries behind the dashboard."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.aggregates import WARN_LEVELS, count_level, counts_by
from ..operators.paging import largest_clusters
from ..operators.windows import ordered


def headline(entries: DataFrame, files: DataFrame) -> DataFrame:
    """Entries, files, errors and warnings in one row."""
    counted = entries.agg(
        F.count("*").alias("total_entries"),
        count_level("ERROR").alias("errors"),
        count_level(*WARN_LEVELS).alias("warnings"),
    )
    return counted.withColumn("total_files", files.agg(F.count("*")).scalar())


def level_share(entries: DataFrame) -> DataFrame:
    """Levels with their share of the entries that have one, in percent."""
    levels = counts_by(entries, "level")
    everything = levels.agg(F.sum("count")).scalar()
    return levels.withColumn("share_pct", F.round(F.col("count") / everything * 100, 1)).orderBy(
        F.desc("count"), "level"
    )


def _of_anomalies(features: DataFrame, anomalies: DataFrame | None) -> DataFrame:
    """Restrict window features to the anomalous windows, if some are given."""
    if anomalies is None:
        return features
    return features.join(anomalies.select("window_start"), "window_start", "left_semi")


def rate_and_volume(features: DataFrame, anomalies: DataFrame | None = None) -> DataFrame:
    rate = (F.col("error_rate") * 100).alias("error_rate_pct")
    return ordered(_of_anomalies(features, anomalies).select("window_start", rate, "total_count"))


def log_composition(features: DataFrame, anomalies: DataFrame | None = None) -> DataFrame:
    levels = ["error_count", "warn_count", "info_count", "debug_count"]
    return ordered(_of_anomalies(features, anomalies).select("window_start", *levels))


def service_activity(features: DataFrame, anomalies: DataFrame | None = None) -> DataFrame:
    return ordered(_of_anomalies(features, anomalies).select("window_start", "unique_services", "warn_count"))


def score_band(score: Column) -> Column:
    """Band of a 0..1 score."""
    return F.when(score > 0.7, "high").when(score > 0.4, "moderate").otherwise("normal")


def score_percent(score: Column) -> Column:
    return F.floor(F.coalesce(score, F.lit(0.0)) * 100 + 0.5).cast("int")


def percent_band(percent: Column) -> Column:
    """Band of a rounded percentage, as the anomaly table shows it."""
    return F.when(percent > 70, "high").when(percent > 40, "moderate").otherwise("normal")


def anomaly_timeline(anomalies: DataFrame, score: str = "anomaly_score") -> DataFrame:
    percent = score_percent(F.col(score))
    return anomalies.select(
        "window_start",
        "window_end",
        F.col(score).alias("score"),
        score_band(F.col(score)).alias("band"),
        percent.alias("score_pct"),
        percent_band(percent).alias("table_band"),
    ).orderBy("window_start")


def _cut(text: Column, size: int) -> Column:
    return F.when(F.length(text) > size, F.concat(F.substring(text, 1, size), F.lit("..."))).otherwise(text)


def top_clusters(clusters: DataFrame, n: int = 10) -> DataFrame:
    """The largest clusters with a short title and message."""
    title = F.coalesce(F.when(F.col("keywords") != "", F.col("keywords")), F.col("label").cast("string"))
    return largest_clusters(clusters, 0, n).select(
        "label",
        "count",
        _cut(title, 30).alias("title"),
        _cut(F.col("example_message"), 80).alias("message"),
    )


def keyword_list(keywords: Column) -> Column:
    """The keywords of the joined string."""
    parts = F.split(F.coalesce(keywords, F.lit("")), ",")
    return F.transform(F.filter(parts, lambda k: k != ""), lambda k: F.trim(k))
