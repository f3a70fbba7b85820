"""Pages of the stored tables: the visible columns of the rows, and how many there are in all."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime, time
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import filters, paging
from ..operators.aggregates import total
from ..schemas import LOG_ENTRIES, project
from ..sources import tables


class Page(NamedTuple):
    items: DataFrame
    total: int
    offset: int
    limit: int


def _page(df: DataFrame, order: Callable[..., DataFrame], view: str, offset: int, limit: int) -> Page:
    paging.check_page(offset, limit)
    return Page(project(order(df, offset, limit), view), total(df).first()["total"], offset, limit)


def log_entries(
    entries: DataFrame, files: DataFrame | None = None, offset: int = 0, limit: int = paging.DEFAULT_LIMIT, **given
) -> Page:
    """Entries that pass the filters of ``query_entries``, newest first."""
    found = filters.query_entries(entries, files, **given)
    return _page(found, paging.newest_first, "log_entries", offset, limit)


def stored_entries(spark: SparkSession, root: str, offset: int = 0, limit: int = paging.DEFAULT_LIMIT) -> Page:
    """All entries of a store, newest first; only the days that the page lies in are read.

    The counts of the days, at most one row per calendar day, say how many entries come before each.
    """
    paging.check_page(offset, limit)
    days = tables.day_counts(spark, root)
    newer = Window.orderBy(F.desc_nulls_last("day")).rowsBetween(Window.unboundedPreceding, -1)
    placed = days.withColumn("before", F.coalesce(F.sum("rows").over(newer), F.lit(0)))
    hit = placed.where((F.col("before") < offset + limit) & (F.col("before") + F.col("rows") > offset))
    found = hit.orderBy("before").collect()  # no more days than the page has rows
    dates = [r["day"] for r in found if r["day"] is not None]
    items = spark.createDataFrame([], LOG_ENTRIES)
    if dates:
        start, end = datetime.combine(min(dates), time.min), datetime.combine(max(dates), time.max)
        items = filters.by_time(tables.entries_table(spark, root, start, end), start, end)
    if len(dates) < len(found):
        undated = tables.undated_entries(spark, root)
        items = items.unionByName(undated) if dates else undated
    page = paging.newest_first(items, offset - found[0]["before"] if found else 0, limit)
    every = days.agg(F.coalesce(F.sum("rows"), F.lit(0)).alias("total")).first()["total"]
    return Page(project(page, "log_entries"), every, offset, limit)


def log_files(
    files: DataFrame, status: str | None = None, offset: int = 0, limit: int = paging.DEFAULT_LIMIT
) -> Page:
    """Files, latest upload first."""
    return _page(filters.list_files(files, status), paging.newest_files, "log_files", offset, limit)


def anomalies(
    found: DataFrame, start=None, end=None, offset: int = 0, limit: int = paging.DEFAULT_LIMIT
) -> Page:
    """Anomalous windows, lowest score first."""
    return _page(filters.list_anomalies(found, start, end), paging.most_anomalous, "anomalies", offset, limit)


def error_clusters(clusters: DataFrame, offset: int = 0, limit: int = paging.DEFAULT_LIMIT) -> Page:
    """Clusters, largest first."""
    return _page(clusters, paging.largest_clusters, "error_clusters", offset, limit)
