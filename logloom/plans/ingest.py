"""The batch ingest job: list, admit, register, normalise, append, summarise."""

from __future__ import annotations

import uuid
from datetime import timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas
from ..operators.aggregates import file_summary
from ..operators.filters import utc_now
from ..operators.joins import drop_orphans, join_small, not_stored
from ..operators.normalize import normalize
from ..session import materialize, remove_path, scratch_path
from ..sources import logs, tables
from .analytics import run_analytics

# Files that are named to one scan and stored by one ingest.
NAMED_PATHS = 10_000


def _time(value) -> Column:
    return F.lit(None if value is None else str(value)).cast("timestamp_ntz")


def record_state(files: DataFrame, root: str, ingest_id: str, *statuses: str, error: str | None = None) -> None:
    """Append states of the files to their history, in this order."""
    now = utc_now()
    why = F.col("_why") if "_why" in files.columns else F.lit(error).cast("string")
    # States that are recorded together are a microsecond apart.
    steps = F.array(*[F.struct(F.lit(s).alias("status"), _time(now + timedelta(microseconds=i)).alias("at")) for i, s in enumerate(statuses)])
    df = files.drop("status").withColumn("_step", F.explode(steps)).withColumns(
        {
            "status": F.col("_step.status"),
            "error": why,
            "processed_at": F.when(F.col("_step.status").isin("processed", "failed"), F.col("_step.at")),
            "ingest_id": F.lit(ingest_id),
            "recorded_at": F.col("_step.at"),
        }
    )
    absent = {c: F.lit(None).cast("bigint") for c in ("total_lines", "parsed_lines", "failed_lines") if c not in df.columns}
    tables.append_rows(df.withColumns(absent).select(*schemas.columns(schemas.LOG_FILES)), root, "log_files")


def entries_of(
    lines: DataFrame, reference_year: int | None = None, splits: DataFrame | None = None
) -> DataFrame:
    """Lines to numbered and normalised entries."""
    numbered = logs.with_line_number(lines, splits).select("log_file_id", "line_number", "raw_line")
    return normalize(numbered, reference_year=reference_year)


def earlier_ingests(known: DataFrame, files: DataFrame) -> list[str]:
    """The ingests that tried one of these files before: one per broken attempt, so a few at most."""
    tried = join_small(known.select("id", "attempts"), files.select("id"), ["id"], "left_semi")
    return [r["ingest_id"] for r in tried.select(F.explode("attempts").alias("ingest_id")).distinct().collect()]


def store_entries(entries: DataFrame, root: str, ingest_id: str, earlier: list[str]) -> DataFrame:
    """Append the entries that no earlier attempt stored; the line counts of their files come back.

    Only what this ingest and earlier attempts on the same files stored is read.
    """
    spark = entries.sparkSession
    if earlier:
        entries = not_stored(entries, tables.entries_of_ingests(spark, root, earlier))
    columns = ["log_file_id", "total_lines", "parsed_lines", "failed_lines"]
    counts = tables.append_entries(entries, root, ingest_id).select(*columns)
    if earlier:
        counts = counts.unionByName(file_summary(tables.entries_of_ingests(spark, root, earlier)).select(*columns))
    return counts.groupBy("log_file_id").agg(*[F.sum(c).alias(c) for c in columns[1:]])


def counted_files(files: DataFrame, splits: DataFrame, summary: DataFrame) -> DataFrame:
    """The files with their stored lines; raises unless each has as many as its splits. Written out."""
    counted = splits.groupBy(F.col("log_file_id").alias("id")).agg(F.sum("_lines").alias("_counted"))
    zero = {"total_lines": 0, "parsed_lines": 0, "failed_lines": 0, "_counted": 0}
    found = files.join(counted, "id", "left").join(summary.withColumnRenamed("log_file_id", "id"), "id", "left").na.fill(zero)
    found = materialize(found, "counted")
    row = found.where("_counted != total_lines").first()
    if row is not None:
        raise RuntimeError(f"{row['stored_path']}: {row['total_lines']} of {row['_counted']} lines stored")
    return found.drop("_counted")


def finish_files(files: DataFrame, root: str, ingest_id: str) -> None:
    """Record the files, with their line counts, as processed."""
    record_state(files, root, ingest_id, "processed")


def take_in(
    spark: SparkSession,
    files: DataFrame,
    lines: DataFrame,
    root: str,
    reference_year: int | None = None,
    known: DataFrame | None = None,
) -> None:
    """Store the lines of the files, recording each state of the files on the way.

    Lines of other files are left out. Before the files count as processed, their stored lines are
    compared with those the scan counted, and the lines of their earlier versions go. A failure is
    recorded with its error and raised. ``known`` is the state of the store before these files.
    """
    ingest_id, path = uuid.uuid4().hex, scratch_path(spark, "lines")
    known = tables.known_files(spark, root) if known is None else known
    earlier = earlier_ingests(known, files)
    record_state(files, root, ingest_id, "uploaded", "processing")
    try:
        placed = logs.place_lines(lines.select("log_file_id", "block_start", "raw_line"), path)
        splits = logs.count_splits(placed)
        entries = drop_orphans(entries_of(placed, reference_year, splits), files)
        counted = counted_files(files, splits, store_entries(entries, root, ingest_id, earlier))
        retire(spark, known, files, root, ingest_id)
        finish_files(counted, root, ingest_id)
    except Exception as error:
        record_state(files, root, ingest_id, "failed", error=str(error))
        raise
    finally:
        remove_path(spark, path)


def retire(spark: SparkSession, known: DataFrame, files: DataFrame, root: str, ingest_id: str) -> None:
    """Take the lines of earlier versions of the files out of the store, and record the versions as replaced."""
    now = files.select("stored_path", F.col("id").alias("_new"))
    old = join_small(known.where(F.col("status") == "processed"), now, ["stored_path"])
    old = old.where(F.col("id") != F.col("_new")).drop("_new", "attempts")
    if not old.isEmpty():
        old = materialize(old, "replaced")
        tables.drop_entries(spark, root, old)
        record_state(old, root, ingest_id, "replaced")


def unreadable(error: Exception) -> bool:
    """Whether a file could not be read, so that others may still be."""
    return "FAILED_READ_FILE" in str(error)


def take_in_paths(
    spark: SparkSession, files: DataFrame, paths: list[str], root: str, reference_year: int | None, known: DataFrame | None = None
) -> list[Exception]:
    """Ingest the files of these paths; if one can't be read, the halves are tried on their own."""
    these = files.where(F.col("stored_path").isin(paths))
    try:
        take_in(spark, these, logs.read_logs(spark, paths), root, reference_year, known)
        return []
    except Exception as error:
        if not unreadable(error):
            raise
        if len(paths) == 1:
            return [error]
    half = len(paths) // 2
    return [e for part in (paths[:half], paths[half:]) for e in take_in_paths(spark, files, part, root, reference_year)]


def record_refused(spark: SparkSession, refused: DataFrame, root: str, known: DataFrame | None = None) -> None:
    """Record refused files with the reason, each version once. ``refused`` has a column ``error``."""
    if refused.isEmpty():
        return
    known = tables.load(spark, root, "log_files") if known is None else known
    fresh = materialize(refused.join(known.where(F.col("status") == "refused").select("id"), "id", "left_anti"), "refused")
    if not fresh.isEmpty():
        record_state(logs.register_files(fresh).join(fresh.select("id", F.col("error").alias("_why")), "id"), root, uuid.uuid4().hex, "refused")


def ingest(
    spark: SparkSession,
    source: str,
    root: str,
    tags: DataFrame | None = None,
    extensions: tuple[str, ...] = logs.EXTENSIONS,
    max_mb: int | None = None,
    reference_year: int | None = None,
) -> DataFrame:
    """Ingest the admitted files under ``source`` that are not processed yet; the refused ones come back.

    A file is known by path, size and time: one that changed is read again, and its lines take the
    place of the old ones. A file that was cut off half-way is taken up again without storing a line
    twice. Files that can't be read are recorded as failed, the others are stored; the first such
    error is raised at the end. Refused files are recorded with the reason.
    """
    known = tables.known_files(spark, root)
    listed = materialize(logs.list_source_files(spark, source), "listed")
    why = logs.refusal(F.col("filename"), F.col("size_bytes"), extensions, max_mb)
    accepted, refused = listed.where(why.isNull()), listed.where(why.isNotNull())
    record_refused(spark, refused.withColumn("error", why), root, known)
    done = known.where(F.col("status") == "processed").select("id")
    pending = materialize(logs.register_files(accepted, tags).join(done, "id", "left_anti"), "pending")
    paths = [r["stored_path"] for r in pending.select("stored_path").orderBy("stored_path").collect()]
    failed = []
    for first in range(0, len(paths), NAMED_PATHS):
        failed += take_in_paths(spark, pending, paths[first : first + NAMED_PATHS], root, reference_year, known)
    if failed:
        raise failed[0]
    return refused


def ingest_and_analyse(spark: SparkSession, source: str, root: str, **options) -> DataFrame:
    """Ingest, then one analytics run over the last 24 hours; the record of the run comes back."""
    ingest(spark, source, root, **options)
    return run_analytics(spark, root, trigger="post_ingestion")
