"""Stored tables: a folder of Parquet per table.

Entries lie in a folder per day, below it one per ingest; within a file they are sorted by time. The small
table ``entry_files`` has a row per data file with its days, times, log files and levels, so that a reader
names only the files that can hold what it asks for. Files that are not in it (of a write that died
half-way) are never read. Entries that are replaced, and small files that are merged, are written as new
files; then the old ones are listed as removed and the new ones as added at once. Two runs that do this at
a time can't both succeed: the second starts over.

A table that is replaced as a whole or in part is written as a new folder and then named as its next
version; a reader takes the latest. A run whose base is no longer the latest merges again.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from datetime import date, datetime

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas
from ..operators.filters import naive, utc_now
from ..session import at_most, materialize
from . import versions

# Dates further from the ingest than this have no folder of their own: a line may claim any date.
PAST_DAYS, FUTURE_DAYS = 3_650, 1
SMALL_ROWS = 1_000_000  # data files below it are worth merging
MERGED = "merged-"  # begins the ingest of rewritten files
_ENTRY_FILES = (
    "path STRING, event_date DATE, ingest_id STRING, rows BIGINT, first_time TIMESTAMP_NTZ, last_time TIMESTAMP_NTZ, "
    "undated BIGINT, first_file BIGINT, last_file BIGINT, levels ARRAY<STRING>, removed BOOLEAN"
)


def read_or_none(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The Parquet folder, or no rows if nothing was written yet."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def append_rows(rows: DataFrame, root: str, name: str) -> None:
    rows.write.mode("append").parquet(f"{root}/{name}")


# Entries


def entry_files(spark: SparkSession, root: str) -> DataFrame:
    """The data files of the entries that count, with what they hold."""
    listed = read_or_none(spark, f"{root}/entry_files", _ENTRY_FILES)
    state = F.max_by(F.struct(*[c for c in listed.columns if c != "path"]), "removed").alias("state")
    return listed.groupBy("path").agg(state).select("path", "state.*").where("NOT removed")


def files_with(files: DataFrame, start=None, end=None, level: str | None = None, ingest_ids: list[str] | None = None) -> DataFrame:
    """The data files that can hold entries of a time range (bounds inclusive), level or ingest.

    A rewritten file may hold lines of any ingest.
    """
    if start is not None:
        files = files.where(F.col("last_time") >= naive(start))
    if end is not None:
        files = files.where(F.col("first_time") <= naive(end))
    if level is not None:
        files = files.where(F.array_contains("levels", level.upper()))
    if ingest_ids is not None:
        files = files.where(F.col("ingest_id").isin(ingest_ids) | F.col("ingest_id").startswith(MERGED))
    return files


def _of_paths(spark: SparkSession, root: str, paths: list[str]) -> DataFrame:
    base = f"{root}/log_entries"
    if not paths:
        return spark.createDataFrame([], schemas.LOG_ENTRIES)
    return spark.read.schema(schemas.LOG_ENTRIES).option("basePath", base).parquet(*[f"{base}/{p}" for p in sorted(paths)])


def entries_table(spark: SparkSession, root: str, start=None, end=None, level: str | None = None, ingest_ids: list[str] | None = None) -> DataFrame:
    """The entries of the data files that can hold what is asked for; other folders are not even listed.

    Filters still apply to the rows. The names of the files come to the driver, as those of any scan do.
    """
    files = files_with(entry_files(spark, root), start, end, level, ingest_ids)
    return _of_paths(spark, root, [r["path"] for r in files.select("path").collect()])


def undated_entries(spark: SparkSession, root: str) -> DataFrame:
    files = entry_files(spark, root).where("undated > 0")
    return _of_paths(spark, root, [r["path"] for r in files.select("path").collect()]).where(F.col("timestamp").isNull())


def day_counts(spark: SparkSession, root: str) -> DataFrame:
    """(day, rows): the stored entries of each day, undated ones with a null day; written out.

    Days with a folder are counted from the list of data files; only far-off dates are read.
    """
    files = materialize(entry_files(spark, root), "entry-files")
    counts = files.where("event_date IS NOT NULL").groupBy(F.col("event_date").alias("day")).agg(F.sum("rows").alias("rows"))
    undated = files.agg(F.sum("undated").alias("rows")).where("rows > 0").select(F.lit(None).cast("date").alias("day"), "rows")
    far = files.where("event_date IS NULL AND rows > undated").select("path")
    dated = _of_paths(spark, root, [r["path"] for r in far.collect()]).where(F.col("timestamp").isNotNull())
    dated = dated.groupBy(F.col("timestamp").cast("date").alias("day")).agg(F.count("*").alias("rows"))
    both = counts.unionByName(dated).groupBy("day").agg(F.sum("rows").alias("rows"))
    return materialize(both.unionByName(undated), "days")


def _store(entries: DataFrame, root: str) -> None:
    """Write entries with their ``ingest_id`` into the folders of their days."""
    day = F.col("timestamp").cast("date")
    near = day.between(F.date_sub("created_at", PAST_DAYS), F.date_add("created_at", FUTURE_DAYS))
    df = entries.withColumn("event_date", F.when(near, day)).select(*schemas.columns(schemas.LOG_ENTRIES))
    df = df.sortWithinPartitions("event_date", "ingest_id", "timestamp")
    df.write.mode("append").partitionBy("event_date", "ingest_id").parquet(f"{root}/log_entries")


def _stored(spark: SparkSession, root: str, ingest_id: str) -> DataFrame:
    """All that was written for an ingest, with the path of its data file."""
    base = f"{root}/log_entries"
    try:
        written = spark.read.schema(schemas.LOG_ENTRIES).option("basePath", base).parquet(f"{base}/*/ingest_id={ingest_id}")
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], f"{schemas.LOG_ENTRIES}, path STRING")
    return written.withColumn("path", F.substring_index(F.col("_metadata.file_path"), "/log_entries/", -1))


def _contents(stored: DataFrame) -> DataFrame:
    """Per data file and log file what the lines are; a row per log file and its few data files."""
    failed = F.col("parse_status") == "failed"
    return stored.groupBy("path", "event_date", "ingest_id", "log_file_id").agg(
        F.count("*").alias("total_lines"),
        F.count_if(~failed).alias("parsed_lines"),
        F.count_if(failed).alias("failed_lines"),
        F.min("timestamp").alias("first_time"),
        F.max("timestamp").alias("last_time"),
        F.count_if(F.col("timestamp").isNull()).alias("undated"),
        F.collect_set(F.when(F.length("level") <= 16, F.col("level"))).alias("levels"),
    )


def _as_files(contents: DataFrame) -> DataFrame:
    return contents.groupBy("path", "event_date", "ingest_id").agg(
        F.sum("total_lines").alias("rows"),
        F.min("first_time").alias("first_time"),
        F.max("last_time").alias("last_time"),
        F.sum("undated").alias("undated"),
        F.min("log_file_id").alias("first_file"),
        F.max("log_file_id").alias("last_file"),
        F.array_distinct(F.flatten(F.collect_set("levels"))).alias("levels"),
        F.lit(False).alias("removed"),
    ).select(*schemas.columns(_ENTRY_FILES))


def append_entries(entries: DataFrame, root: str, ingest_id: str, cluster_by_day: bool = False) -> DataFrame:
    """Append normalised entries and list their data files; the line counts per data and log file come back.

    Log files mostly run in time order, so a task meets few days and no shuffle is needed.
    ``cluster_by_day`` first gathers each day, big days over several tasks, for sources that
    mix many days.
    """
    spark = entries.sparkSession
    df = entries.withColumns({"created_at": F.lit(str(utc_now())).cast("timestamp_ntz"), "ingest_id": F.lit(ingest_id)})
    if cluster_by_day:
        df = df.withColumn("event_date", F.col("timestamp").cast("date")).hint("rebalance", "event_date")
    _store(df, root)
    contents = materialize(_contents(_stored(spark, root, ingest_id)), "contents")
    append_rows(_as_files(contents), root, "entry_files")
    return contents


def entries_of_ingests(spark: SparkSession, root: str, ingest_ids: list[str]) -> DataFrame:
    """All that the given ingests stored, and what shares rewritten files with it; other folders are not read."""
    return entries_table(spark, root, ingest_ids=ingest_ids)


def _rewrite(spark: SparkSession, root: str, chosen: Callable[[DataFrame], DataFrame], change: Callable[[DataFrame], DataFrame]) -> int:
    """Put new data files in the place of those that ``chosen`` takes from the list; returns how many went.

    ``change`` makes the new rows of the old ones. If another rewrite was faster, all is done again on
    what it has left.
    """
    while True:
        base, _ = versions.latest(spark, root, "entry_files")
        old = chosen(entry_files(spark, root)).collect()
        if not old:
            return 0
        rewrite_id = f"{MERGED}{uuid.uuid4().hex}"
        rows = change(_of_paths(spark, root, [r["path"] for r in old]))
        _store(rows.withColumn("ingest_id", F.lit(rewrite_id)), root)
        fresh = _as_files(_contents(_stored(spark, root, rewrite_id)))
        gone = spark.createDataFrame(old, _ENTRY_FILES).withColumn("removed", F.lit(True))
        both = materialize(fresh.unionByName(gone), "entry-files").coalesce(1)  # one file, seen as a whole or not at all
        if versions.claim(spark, root, "entry_files", base, rewrite_id):
            append_rows(both, root, "entry_files")
            return len(old)


def drop_entries(spark: SparkSession, root: str, log_files: DataFrame) -> int:
    """Take the lines of these log files (``id``) out of the data files that have them."""
    ids = materialize(log_files.select(F.col("id").alias("log_file_id")).distinct(), "dropped")

    def holds(files: DataFrame) -> DataFrame:
        within = ids["log_file_id"].between(files["first_file"], files["last_file"])
        ends = ids.agg(F.min("log_file_id").alias("low"), F.max("log_file_id").alias("high")).first()
        files = files.where((F.col("first_file") <= ends["high"]) & (F.col("last_file") >= ends["low"]))
        return files.join(F.broadcast(ids), within, "left_semi") if at_most(ids, 10_000) else files

    side = F.broadcast(ids) if at_most(ids, 500_000) else ids
    if ids.isEmpty():
        return 0
    return _rewrite(spark, root, holds, lambda rows: rows.join(side, "log_file_id", "left_anti"))


def compact(spark: SparkSession, root: str, before: date | datetime | None = None, least_files: int = 8) -> int:
    """Merge the small data files of days that have ``least_files`` or more of them; returns how many went.

    Each such day is gathered (a large one over several tasks) and written sorted by time. Days from
    ``before`` on are left alone, as they may still grow.
    """

    def small(files: DataFrame) -> DataFrame:
        files = files.where(F.col("rows") < SMALL_ROWS)
        if before is not None:
            files = files.where(F.col("event_date") < F.lit(str(before)[:10]).cast("date"))
        many = files.groupBy("event_date").count().where(F.col("count") >= least_files)
        return files.join(F.broadcast(many.select(F.col("event_date").alias("_day"))), F.col("event_date").eqNullSafe(F.col("_day")), "left_semi")

    return _rewrite(spark, root, small, lambda rows: rows.hint("rebalance", "event_date"))


# Files, runs, and tables that are replaced


def files_history(spark: SparkSession, root: str) -> DataFrame:
    """Every recorded state of every file."""
    return read_or_none(spark, f"{root}/log_files", schemas.LOG_FILES)


def _last_state(history: DataFrame, at: Column) -> DataFrame:
    state = F.max_by(F.struct(*history.columns), at).alias("state")
    return history.groupBy("id").agg(state).select("state.*")


def current_files(history: DataFrame) -> DataFrame:
    """The last recorded state of each file."""
    return _last_state(history, F.col("recorded_at")).drop("recorded_at")


def known_files(spark: SparkSession, root: str) -> DataFrame:
    """The last recorded state of each file, and the ingests that tried it (``attempts``); written out."""
    history = files_history(spark, root)
    state = F.max_by(F.struct(*history.columns), "recorded_at").alias("state")
    known = history.groupBy("id").agg(state, F.collect_set("ingest_id").alias("attempts"))
    return materialize(known.select("state.*", "attempts").drop("recorded_at"), "known")


def current_runs(history: DataFrame) -> DataFrame:
    """The last recorded state of each analytics run."""
    return _last_state(history, F.coalesce("finished_at", "started_at"))


def _current(spark: SparkSession, root: str, name: str) -> tuple[int, DataFrame]:
    """Number and rows of the latest version of a table."""
    number, folder = versions.latest(spark, root, name)
    schema = schemas.TABLES[name]
    return number, spark.read.schema(schema).parquet(f"{root}/{folder}") if number else spark.createDataFrame([], schema)


def publish(spark: SparkSession, root: str, name: str, change: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Write what ``change`` makes of the current rows of a table, and make it the current version.

    If another run has published meanwhile, the change is done again on its rows.
    """
    while True:
        number, rows = _current(spark, root, name)
        folder = f"{name}/{uuid.uuid4().hex}"
        df = change(rows)
        df.write.parquet(f"{root}/{folder}")
        if versions.claim(spark, root, name, number, folder):
            return spark.read.schema(df.schema).parquet(f"{root}/{folder}")


def load(spark: SparkSession, root: str, name: str) -> DataFrame:
    """The current rows of a table, with its fixed schema."""
    if name == "log_entries":
        return entries_table(spark, root)
    if name == "log_files":
        return current_files(files_history(spark, root))
    if name == "pipeline_runs":
        return current_runs(read_or_none(spark, f"{root}/{name}", schemas.PIPELINE_RUNS))
    return _current(spark, root, name)[1]


def replace_anomalies(old: DataFrame, new: DataFrame, start, end) -> DataFrame:
    """``old`` without the windows that lie within ``start..end``, plus ``new``."""
    start, end = (b if isinstance(b, Column) else naive(b) for b in (start, end))
    replaced = (F.col("window_start") >= start) & (F.col("window_end") <= end)
    return old.where(~replaced).unionByName(new)


def replace_clusters(new: DataFrame, root: str) -> DataFrame:
    """All clusters are replaced at once."""
    return publish(new.sparkSession, root, "error_clusters", lambda old: new)
