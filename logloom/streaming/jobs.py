"""Incremental ingest, incremental window features, and the repair of windows that got late entries."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.filters import with_time
from ..operators.joins import BROADCAST_ROWS, entries_in_windows
from ..operators.windows import WINDOW_MINUTES, bucket, finish_windows, window_counts, window_features
from ..plans.ingest import record_refused, take_in
from ..session import at_most, materialize
from ..sources import logs, versions
from ..sources.tables import read_or_none


def stream_ingest(
    spark: SparkSession,
    source: str,
    root: str,
    checkpoint: str,
    tags: DataFrame | None = None,
    extensions: tuple[str, ...] = logs.EXTENSIONS,
    max_mb: int | None = None,
    reference_year: int | None = None,
    max_files: int | None = None,
    after_batch: Callable[[SparkSession], object] | None = None,
    **trigger,
) -> StreamingQuery:
    """Ingest files as they arrive; by default whatever is there now, then stop.

    A file comes whole in one batch, of ``max_files`` files at most. What is known of a file comes with
    its lines, so the folder is not listed again. A batch that is run again stores no line twice.
    Refused files are recorded with the reason. ``after_batch`` runs after each batch, an analytics run
    for example.

    The file source remembers paths: a file that grows after its batch is not read again by the
    stream. The batch job ``ingest`` on the same store notices it by size and time.
    """
    reader = spark.readStream.option("recursiveFileLookup", "true")
    if max_files is not None:
        reader = reader.option("maxFilesPerTrigger", max_files)
    lines = logs.log_lines(reader.text(source))
    why = logs.refusal(F.col("filename"), F.col("size_bytes"), extensions, max_mb)

    def store(batch: DataFrame, batch_id: int) -> None:
        session = batch.sparkSession
        about = ["filename", "stored_path", "size_bytes", "uploaded_at"]
        arrived = batch.select(F.col("log_file_id").alias("id"), *about).distinct()
        arrived = materialize(arrived.withColumn("error", why), "arrived")
        record_refused(session, arrived.where("error IS NOT NULL"), root)
        accepted = arrived.where("error IS NULL").drop("error")
        if not accepted.isEmpty():
            files = materialize(logs.register_files(accepted, tags), "files")
            take_in(session, files, batch.where(why.isNull()), root, reference_year)
        if after_batch is not None:
            after_batch(session)

    writer = lines.writeStream.foreachBatch(store).option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"availableNow": True})).start()


def stream_window_features(
    entries: DataFrame, watermark: str = "10 minutes", minutes: int = WINDOW_MINUTES
) -> DataFrame:
    """Window features of a stream of entries, each window once it is closed.

    Entries later than the watermark are dropped; ``stream_late_windows`` tells their windows. Counting per (window, service) first keeps the
    distinct services exact, lets several tasks share a busy window, and bounds the state of a
    window by its services.
    """
    dated = entries.withColumn("timestamp", F.col("timestamp").cast("timestamp")).withWatermark(
        "timestamp", watermark
    )
    per_service = dated.groupBy(bucket(F.col("timestamp"), minutes).alias("window"), "service").agg(
        *window_counts()
    )
    counts = ["total_count", "error_count", "warn_count", "info_count", "debug_count"]
    counted = per_service.groupBy(bucket(F.window_time("window"), minutes).alias("window")).agg(
        *[F.sum(c).alias(c) for c in counts], F.count("service").alias("unique_services")
    )
    return finish_windows(counted)


_LATE = "window_start TIMESTAMP_NTZ, window_end TIMESTAMP_NTZ, rows BIGINT, batch BIGINT"


def stream_late_windows(
    entries: DataFrame, root: str, checkpoint: str, watermark: str = "10 minutes", minutes: int = WINDOW_MINUTES, **trigger
) -> StreamingQuery:
    """Put aside the windows of entries that come too late for ``stream_window_features``, with their number.

    An entry is late if its window has ended when its batch begins: at the latest time of the batches before,
    less the watermark. That time is kept as a version per batch, and a batch writes a folder of its own, so a
    batch that is run again gives the same list once.
    """
    name = "late_windows"

    def put_aside(batch: DataFrame, batch_id: int) -> None:
        session = batch.sparkSession
        dated = materialize(with_time(batch).select(F.col("timestamp").cast("timestamp_ntz").alias("timestamp")), "dated")
        before = versions.content_of(session, root, name, batch_id)  # made by the batch before
        known = datetime.fromisoformat(before) if before not in ("", "none") else None
        if known is not None:
            windows = dated.groupBy(bucket(F.col("timestamp"), minutes).alias("window")).agg(F.count("*").alias("rows"))
            windows = windows.select(
                F.col("window.start").cast("timestamp_ntz").alias("window_start"),
                F.col("window.end").cast("timestamp_ntz").alias("window_end"),
                "rows",
            )
            closed = F.lit(str(known)).cast("timestamp_ntz") - F.expr(f"INTERVAL {watermark}")
            windows.where(F.col("window_end") <= closed).write.mode("overwrite").parquet(f"{root}/{name}/batch={batch_id}")
        latest = max((t for t in (known, dated.agg(F.max("timestamp")).first()[0]) if t is not None), default=None)
        versions.claim(session, root, name, batch_id, "none" if latest is None else latest.isoformat())

    writer = entries.writeStream.foreachBatch(put_aside).option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"availableNow": True})).start()


def late_windows(spark: SparkSession, root: str) -> DataFrame:
    """The windows that got late entries, with how many: window_start, window_end, rows."""
    found = read_or_none(spark, f"{root}/late_windows", _LATE)
    return found.groupBy("window_start", "window_end").agg(F.sum("rows").alias("rows"))


def repair_windows(
    features: DataFrame, late: DataFrame, entries: DataFrame, minutes: int = WINDOW_MINUTES, bound: int = BROADCAST_ROWS
) -> DataFrame:
    """``features`` with the late windows counted anew from all their ``entries``; only these are read again."""
    late = materialize(late.select("window_start", "window_end"), "late")
    inside = entries_in_windows(late, entries, minutes, bound).drop("window_start", "window_end")
    side = F.broadcast(late) if at_most(late, bound) else late
    kept = features.join(side, ["window_start", "window_end"], "left_anti").select(features.columns)
    return kept.unionByName(window_features(inside, minutes=minutes).select(features.columns))
