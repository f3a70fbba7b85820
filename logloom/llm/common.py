"""What several training-data operators share."""

from __future__ import annotations

import ctypes
import gc
import os
import tempfile
import zipfile
from collections.abc import Iterator
from pathlib import Path

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_SHIPPED: set[str] = set()
_REMEMBERED: dict = {}
TEXTS_PER_BATCH = 1_000


def ship(spark: SparkSession) -> None:
    """Sends this package's code to the Python workers, once per application.

    They then import it, so that what a worker has learned (word caches) lasts from task to task. As
    rows are whole texts, they go to the workers in smaller batches than usual.
    """
    size = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(size)) <= TEXTS_PER_BATCH:
        spark.conf.set(size, TEXTS_PER_BATCH)
    application = spark.sparkContext.applicationId
    if application not in _SHIPPED:
        package = Path(__file__).resolve().parent.parent
        path = os.path.join(tempfile.mkdtemp(prefix="code-"), f"{package.name}.zip")
        with zipfile.ZipFile(path, "w") as archive:
            for file in sorted(package.rglob("*.py")):
                archive.write(file, file.relative_to(package.parent))
        spark.sparkContext.addPyFile(path)
        _SHIPPED.add(application)


def remembered(key, make):
    """What ``make`` gave for ``key``, kept by a Python worker from task to task.

    Only the latest is kept, so that the caches of one stage don't take memory from the next.
    """
    if key not in _REMEMBERED:
        _REMEMBERED.clear()
        _REMEMBERED[key] = make()
    return _REMEMBERED[key]


def give_back() -> None:
    """Returns freed memory to the system, which glibc keeps for the process otherwise."""
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def forget() -> None:
    """Lets a worker give back what an earlier stage has made it remember; for stages that remember nothing."""
    _REMEMBERED.clear()
    gc.collect()
    give_back()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(doc_id: str, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % folds


def drawn(rows: DataFrame, group: str, per_group: int) -> DataFrame:
    """About ``per_group`` rows of each value of ``group``, drawn by the hash of doc_id; all if fewer."""
    counts = {r[group]: r["n"] for r in rows.groupBy(group).agg(F.count("*").alias("n")).collect()}
    if not counts:
        return rows
    share = F.lit(0.0)
    for value, n in counts.items():
        share = F.when(F.col(group).eqNullSafe(F.lit(value)), F.lit(min(1.0, per_group / n))).otherwise(share)
    return rows.where(F.pmod(F.xxhash64("doc_id", F.lit(20)), F.lit(1 << 30)) < share * (1 << 30))


def labelled_ids(labels: DataFrame, label: str, folds: int, held_out: int, per_class: int) -> DataFrame:
    """(doc_id, label) of the training folds, about ``per_class`` ids per label, drawn by hash.

    Ids with several labels take the largest; null ids and labels are left out.
    """
    known = labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & (fold("doc_id", folds) != held_out))
    return drawn(known.groupBy("doc_id").agg(F.max(label).cast("int").alias("label")), "label", per_class)


def chunked(texts, size: int = 1 << 18) -> Iterator[tuple[int, int]]:
    """Slices of the list that hold about ``size`` characters each, at least one text."""
    first = held = 0
    for i, text in enumerate(texts):
        held += len(text)
        if held >= size:
            yield first, i + 1
            first, held = i + 1, 0
    if first < len(texts):
        yield first, len(texts)


def starts_of(groups: np.ndarray) -> np.ndarray:
    """Where each run of equal values begins."""
    return np.flatnonzero(np.r_[True, groups[1:] != groups[:-1]]) if len(groups) else np.zeros(0, np.int64)
