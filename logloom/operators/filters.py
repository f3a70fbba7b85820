"""Row filters of the query surface. Every filter is optional; what is given is ANDed."""

from __future__ import annotations

import re
from datetime import datetime, timedelta, timezone

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .joins import join_files


def utc_now() -> datetime:
    return datetime.now(timezone.utc).replace(tzinfo=None)


def naive(ts: datetime | str) -> Column:
    """A time bound as a naive-UTC literal; an offset, also in a text, is applied."""
    if isinstance(ts, str):
        try:
            ts = datetime.fromisoformat(ts)
        except ValueError:  # left to the cast, which knows more forms
            pass
    if isinstance(ts, datetime) and ts.tzinfo is not None:
        ts = ts.astimezone(timezone.utc).replace(tzinfo=None)
    return F.lit(str(ts)).cast("timestamp_ntz")


def default_range(
    start: datetime | None = None, end: datetime | None = None, now: datetime | None = None
) -> tuple[datetime, datetime]:
    """A missing end is now, a missing start 24 hours before the end."""
    end = end or now or utc_now()
    return start or end - timedelta(hours=24), end


def by_time(df: DataFrame, start=None, end=None, column: str = "timestamp") -> DataFrame:
    """Both bounds inclusive. A stored ``event_date`` folder is bounded as well; far-off dates have none."""
    dated = "event_date" in df.columns
    if start is not None:
        df = df.where(F.col(column) >= naive(start))
        if dated:
            df = df.where((F.col("event_date") >= naive(start).cast("date")) | F.col("event_date").isNull())
    if end is not None:
        df = df.where(F.col(column) <= naive(end))
        if dated:
            df = df.where((F.col("event_date") <= naive(end).cast("date")) | F.col("event_date").isNull())
    return df


def with_time(df: DataFrame) -> DataFrame:
    return df.where(F.col("timestamp").isNotNull())


def by_level(df: DataFrame, level: str) -> DataFrame:
    return df.where(F.col("level") == level.upper())


def by_service(df: DataFrame, service: str) -> DataFrame:
    return df.where(F.col("service") == service)


def by_keyword(df: DataFrame, keyword: str) -> DataFrame:
    """Case-insensitive contains; ``%`` and ``_`` in the keyword stay wildcards.

    A backslash makes the next character literal; before any other one it says nothing.
    """
    pattern = re.sub(r"\\([^%_\\])|\\(.)", lambda m: m[1] or m[0], f"%{keyword}%", flags=re.DOTALL)
    return df.where(F.col("message").ilike(pattern))


def by_file(df: DataFrame, file_id: int) -> DataFrame:
    return df.where(F.col("log_file_id") == file_id)


def by_file_tags(df: DataFrame, files: DataFrame, source=None, environment=None) -> DataFrame:
    """Entries of files with the given source and environment."""
    if source is not None:
        files = files.where(F.col("source") == source)
    if environment is not None:
        files = files.where(F.col("environment") == environment)
    return join_files(df, files.select("id"))


def query_entries(
    entries: DataFrame,
    files: DataFrame | None = None,
    *,
    start=None,
    end=None,
    level: str | None = None,
    service: str | None = None,
    source: str | None = None,
    environment: str | None = None,
    keyword: str | None = None,
    file_id: int | None = None,
) -> DataFrame:
    """All given filters; the file table is joined only for source or environment."""
    df = by_time(entries, start, end)
    if level is not None:
        df = by_level(df, level)
    if service is not None:
        df = by_service(df, service)
    if keyword is not None:
        df = by_keyword(df, keyword)
    if file_id is not None:
        df = by_file(df, file_id)
    if source is not None or environment is not None:
        df = by_file_tags(df, files, source, environment)
    return df


def list_files(files: DataFrame, status: str | None = None) -> DataFrame:
    return files if status is None else files.where(F.col("status") == status)


def get_file(files: DataFrame, file_id: int) -> DataFrame:
    """The file with this id, or no row."""
    return files.where(F.col("id") == file_id).limit(1)


def list_anomalies(anomalies: DataFrame, start=None, end=None) -> DataFrame:
    """Windows that start at or after ``start`` and end at or before ``end``."""
    if start is not None:
        anomalies = anomalies.where(F.col("window_start") >= naive(start))
    if end is not None:
        anomalies = anomalies.where(F.col("window_end") <= naive(end))
    return anomalies


def error_messages(
    entries: DataFrame, start=None, end=None, error_levels: tuple[str, ...] = ("ERROR",)
) -> DataFrame:
    """Dated entries that are errors or failed to parse and have a message."""
    return (
        with_time(by_time(entries, start, end))
        .where(F.col("level").isin(*error_levels) | (F.col("parse_status") == "failed"))
        .where(F.col("message").isNotNull() & (F.col("message") != ""))
    )
