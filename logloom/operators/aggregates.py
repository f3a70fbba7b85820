"""Counts and breakdowns. All of them combine on the map side before the shuffle."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import round_even

WARN_LEVELS = ("WARN", "WARNING")


def count_level(*levels: str) -> Column:
    return F.count_if(F.col("level").isin(*levels))


def unique_services() -> Column:
    return F.count_distinct("service")


def error_rate(errors: Column, total: Column) -> Column:
    """Share of errors to 4 digits, 0 where there is nothing."""
    return F.when(total > 0, round_even(errors / total, 4)).otherwise(F.lit(0.0))


def totals(entries: DataFrame, files: DataFrame) -> DataFrame:
    """One row with the number of entries and files."""
    counted = entries.agg(F.count("*").alias("total_entries"))
    return counted.withColumn("total_files", files.agg(F.count("*")).scalar())


def counts_by(df: DataFrame, column: str) -> DataFrame:
    """Rows per non-null value."""
    return df.where(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("count"))


def level_breakdown(entries: DataFrame) -> DataFrame:
    return counts_by(entries, "level").orderBy(F.desc("count"), "level")


def top_services(entries: DataFrame, n: int = 10) -> DataFrame:
    return counts_by(entries, "service").orderBy(F.desc("count"), "service").limit(n)


def total(df: DataFrame) -> DataFrame:
    """Rows of a filtered frame, for the page count: one row with ``total``."""
    return df.agg(F.count("*").alias("total"))


def stats_summary(entries: DataFrame, files: DataFrame, n: int = 10) -> DataFrame:
    """Totals, level breakdown and top services as rows ``(section, name, count)``.

    The entries are read once, into counts per level and service; those few rows are then added
    up per level, per service and in total.
    """
    pairs = entries.groupBy("level", "service").agg(F.count("*").alias("count"))
    grouped = pairs.groupingSets([["level"], ["service"]], "level", "service").agg(
        F.sum("count").alias("count"), F.grouping("service").alias("by_level")
    )

    def section(df: DataFrame, title: str, name: Column) -> DataFrame:
        return df.select(
            F.lit(title).alias("section"), name.cast("string").alias("name"), F.coalesce("count", F.lit(0)).alias("count")
        )

    levels = grouped.where((F.col("by_level") == 1) & F.col("level").isNotNull())
    services = grouped.where((F.col("by_level") == 0) & F.col("service").isNotNull())
    services = services.orderBy(F.desc("count"), "service").limit(n)
    all_files = files.agg(F.count("*").alias("count"))
    return reduce(
        DataFrame.unionByName,
        [
            section(pairs.agg(F.sum("count").alias("count")), "total", F.lit("entries")),
            section(all_files, "total", F.lit("files")),
            section(levels, "level", F.col("level")),
            section(services, "service", F.col("service")),
        ],
    )


def file_summary(entries: DataFrame) -> DataFrame:
    """Lines per file; partly parsed lines count as parsed."""
    failed = F.col("parse_status") == "failed"
    return entries.groupBy("log_file_id").agg(
        F.count("*").alias("total_lines"),
        F.count_if(~failed).alias("parsed_lines"),
        F.count_if(failed).alias("failed_lines"),
    )
