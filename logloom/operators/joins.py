"""Joins of entries with files, stored entries and anomaly windows.

The small side is broadcast only after its rows have been counted up to a bound. Beyond it
the join shuffles, with the small side copied over a few salts, so that one file or window
holding a large share of the entries is spread over several tasks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import at_most, materialize

# Rows of a few fixed-width columns: tens of megabytes as a hash table.
BROADCAST_ROWS = 500_000
SALTS = 32


def join_small(
    large: DataFrame, small: DataFrame, keys: list[str], how: str = "inner", bound: int = BROADCAST_ROWS
) -> DataFrame:
    """Join ``large`` with ``small`` on ``keys``; inner or left_semi."""
    if at_most(small, bound):
        return large.join(F.broadcast(small), keys, how)
    # The salt follows from the row, so a task that is run again salts its rows as before.
    line = [c for c in ("log_file_id", "line_number") if c in large.columns]
    unique = line if len(line) == 2 else large.columns
    spread = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("_salt")
    salted = large.withColumn("_salt", F.pmod(F.xxhash64(*unique), F.lit(SALTS)).cast("int"))
    return salted.join(small.select("*", spread), [*keys, "_salt"], how).drop("_salt")


def join_files(entries: DataFrame, files: DataFrame, bound: int = BROADCAST_ROWS) -> DataFrame:
    """Entries whose file is in ``files``, with the other file columns added.

    ``files`` is broadcast if it has at most ``bound`` rows and a bounded size in bytes.
    """
    keyed = files.withColumnRenamed("id", "log_file_id")
    how = "left_semi" if keyed.columns == ["log_file_id"] else "inner"
    return join_small(entries, keyed, ["log_file_id"], how, bound)


def drop_orphans(entries: DataFrame, files: DataFrame, bound: int = BROADCAST_ROWS) -> DataFrame:
    """Entries of files that still exist."""
    return join_files(entries, files.select("id"), bound)


def not_stored(
    entries: DataFrame,
    existing: DataFrame,
    keys: tuple[str, ...] = ("log_file_id", "line_number"),
    bound: int = BROADCAST_ROWS,
) -> DataFrame:
    """Entries whose key is not stored yet. A key is one line, so no key is hot."""
    stored = existing.select(*keys)
    side = F.broadcast(stored) if at_most(stored, bound) else stored
    return entries.join(side, list(keys), "left_anti")


def new_entries(
    entries: DataFrame,
    existing: DataFrame,
    keys: tuple[str, ...] = ("log_file_id", "line_number"),
    bound: int = BROADCAST_ROWS,
) -> DataFrame:
    """Entries not stored yet, one per key, for input that may repeat a line."""
    return not_stored(entries, existing, keys, bound).dropDuplicates(list(keys))


def entries_in_windows(
    anomalies: DataFrame, entries: DataFrame, minutes: int = 2, bound: int = BROADCAST_ROWS
) -> DataFrame:
    """Entries with ``window_start <= timestamp < window_end``, once per window they fall into.

    Windows are laid out over the ``minutes`` buckets they touch, which makes the range join an
    equality on the bucket plus the exact bounds.
    """
    step = minutes * 60

    def bucket(ts):
        return F.floor(F.unix_seconds(ts.cast("timestamp")) / step)

    last = F.col("window_end") - F.expr("INTERVAL '0.000001' SECOND")
    windows = anomalies.where(F.col("window_start") < F.col("window_end")).select(
        "window_start",
        "window_end",
        F.explode(F.sequence(bucket(F.col("window_start")), bucket(last))).alias("_bucket"),
    )
    # Written out, as the windows may come from an aggregation that is not to run twice.
    windows = materialize(windows, "windows")
    keyed = entries.where(F.col("timestamp").isNotNull()).withColumn("_bucket", bucket(F.col("timestamp")))
    inside = (F.col("timestamp") >= F.col("window_start")) & (F.col("timestamp") < F.col("window_end"))
    return join_small(keyed, windows, ["_bucket"], "inner", bound).where(inside).drop("_bucket")
