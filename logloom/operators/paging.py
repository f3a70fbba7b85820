"""Ordered listings, one page at a time.

Every order ends in a unique key, so a page does not change from run to run.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import value_at_rank
from .filters import by_time

DEFAULT_LIMIT = 50
MAX_LIMIT = 500
# Up to here a page is a plain top-k; further on the rows before it are counted, not carried.
SEEK_FROM = 10_000


def check_page(offset: int = 0, limit: int = DEFAULT_LIMIT) -> None:
    if offset < 0:
        raise ValueError("offset must not be negative")
    if not 1 <= limit <= MAX_LIMIT:
        raise ValueError(f"limit must be between 1 and {MAX_LIMIT}")


def page_count(total: Column, limit: int | Column) -> Column:
    """Pages needed for ``total`` rows, at least one."""
    return F.greatest(F.ceil(total / limit), F.lit(1)).cast("bigint")


def _page(df: DataFrame, order: list[Column], offset: int, limit: int) -> DataFrame:
    check_page(offset, limit)
    return df.orderBy(*order).offset(offset).limit(limit)


def newest_first(df: DataFrame, offset: int = 0, limit: int = DEFAULT_LIMIT) -> DataFrame:
    """Entries by time, latest first, undated ones last.

    The keys of the page, at most 500, are found first, from the key columns alone; then only
    the rows in the time span of the page are read in full.
    """
    check_page(offset, limit)
    keys = ["timestamp", "log_file_id", "line_number"]
    order = [F.desc_nulls_last("timestamp"), F.col("log_file_id"), F.col("line_number")]
    start, ahead = _seek(df.select(*keys), offset) if offset >= SEEK_FROM else (df.select(*keys), offset)
    page = _page(start, order, ahead, limit).collect()
    times = [r["timestamp"] for r in page if r["timestamp"] is not None]
    undated = df.where(F.col("timestamp").isNull())
    if not times:
        near = undated if page else df.where(F.lit(False))
    elif len(times) == len(page):
        near = by_time(df, min(times), max(times))
    else:
        near = by_time(df, end=max(times)).unionByName(undated)
    found = df.sparkSession.createDataFrame(
        [(r["log_file_id"], r["line_number"]) for r in page], "log_file_id BIGINT, line_number BIGINT"
    )
    rows = near.join(F.broadcast(found), ["log_file_id", "line_number"], "left_semi")
    return rows.orderBy(*order).limit(limit)


def _seek(df: DataFrame, offset: int) -> tuple[DataFrame, int]:
    """Drop rows that come before a far page: the rest starts at the page, or few rows ahead of it.

    Walks the sort keys: find the value of the key at the wanted rank by counting, keep the rows
    with that value or a later one, and go on with the next key among the rows with that value.
    """
    age = -F.unix_micros(F.col("timestamp").cast("timestamp"))
    # Undated entries come last: later than any time.
    keyed = df.withColumn("_age", F.coalesce(age, F.lit(2**63 - 1)))
    if offset >= keyed.count():
        return df.where(F.lit(False)), 0
    keep, same = F.lit(False), F.lit(True)
    for key in ("_age", "log_file_id", "line_number"):
        value, before = value_at_rank(keyed.where(same), key, offset)
        offset -= before
        keep = keep | (same & (F.col(key) > F.lit(value)))
        same = same & (F.col(key) == F.lit(value))
    return keyed.where(keep | same).drop("_age"), offset


def newest_files(files: DataFrame, offset: int = 0, limit: int = DEFAULT_LIMIT) -> DataFrame:
    return _page(files, [F.desc("uploaded_at"), F.col("id")], offset, limit)


def most_anomalous(anomalies: DataFrame, offset: int = 0, limit: int = DEFAULT_LIMIT) -> DataFrame:
    """Lowest score, the most anomalous, first."""
    return _page(anomalies, [F.col("score"), F.col("window_start")], offset, limit)


def largest_clusters(clusters: DataFrame, offset: int = 0, limit: int = DEFAULT_LIMIT) -> DataFrame:
    return _page(clusters, [F.desc("count"), F.col("label")], offset, limit)
