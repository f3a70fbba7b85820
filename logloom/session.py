"""Session defaults and the shared folder for intermediate tables."""

from __future__ import annotations

import uuid
from functools import reduce
from operator import add

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# What the results depend on; may be set on a running session.
RUNTIME = {
    # Stored times are naive UTC, so the session must not shift them.
    "spark.sql.session.timeZone": "UTC",
    # A repeated key inside a nested JSON object: the last one counts.
    "spark.sql.variant.allowDuplicateKeys": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}
_SCRATCH: dict[str, list[str]] = {}
_INITIAL_PARTITIONS = "spark.sql.adaptive.coalescePartitions.initialPartitionNum"


def build_session(app_name: str = "logloom", master: str | None = None, **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(app_name)
    if master is not None:
        builder = builder.master(master)
    # A plan shows all filters that reach a scan; by default Spark cuts them at 100 characters.
    for key, value in {"spark.sql.maxMetadataStringLength": "2000", **RUNTIME, **conf}.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    given = spark.sparkContext.getConf()
    if not any(given.contains(key) for key in ("spark.sql.shuffle.partitions", _INITIAL_PARTITIONS)):
        # Start with three partitions per core; adaptive execution merges small ones.
        spark.conf.set(_INITIAL_PARTITIONS, max(200, 3 * spark.sparkContext.defaultParallelism))
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach, named by ``spark.checkpoint.dir``.

    Without the setting it is the checkpoint folder of the context or, if there is none, a folder in
    the warehouse.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    return (configured or f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_scratch").rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _SCRATCH.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def remove_scratch(spark: SparkSession) -> int:
    """Delete what this application wrote to the shared folder; results read from it are gone as well."""
    paths = list(_SCRATCH.get(spark.sparkContext.applicationId, []))
    for path in paths:
        remove_path(spark, path)
    return len(paths)


def remove_path(spark: SparkSession, path: str) -> None:
    """Delete one folder of ``scratch_path``, before the application ends."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
    _SCRATCH[spark.sparkContext.applicationId].remove(path)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    Cuts the lineage like a checkpoint, survives lost executors, and keeps the Parquet
    statistics and column pruning for the readers.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def at_most(df: DataFrame, rows: int, megabytes: int = 64) -> bool:
    """Whether ``df`` has no more than ``rows`` rows and ``megabytes`` of texts; reads little further."""
    texts = [F.coalesce(F.octet_length(c), F.lit(0)).cast("long") for c, kind in df.dtypes if kind in ("string", "binary")]
    size = F.sum(reduce(add, texts, F.lit(0).cast("long")))
    found = df.limit(rows + 1).agg(F.count("*").alias("n"), F.coalesce(size, F.lit(0)).alias("size")).first()
    return found["n"] <= rows and found["size"] <= megabytes << 20
