"""Raw log files: listing, admission, registration, lines and line numbers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import at_most, materialize, scratch_path

EXTENSIONS = ("log", "txt", "json")
# One row of five numbers per file split: 2,000,000 splits of 128 MB are 256 TB of text.
BROADCAST_SPLITS = 2_000_000


def file_id(path: Column, size: Column, modified: Column) -> Column:
    """A file as it is now: one that grew or was replaced is another file."""
    return F.xxhash64(path, size, modified.cast("timestamp"))


def _scanned_file_id() -> Column:
    return file_id(*[F.col(f"_metadata.file_{part}") for part in ("path", "size", "modification_time")])


def list_source_files(spark: SparkSession, path: str) -> DataFrame:
    """Name, path, size and time of the files under ``path``; no content is read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select(
        F.col("_metadata.file_name").alias("filename"),
        F.col("_metadata.file_path").alias("stored_path"),
        F.col("_metadata.file_size").alias("size_bytes"),
        F.col("_metadata.file_modification_time").cast("timestamp_ntz").alias("uploaded_at"),
        _scanned_file_id().alias("id"),
    )


def admitted(
    filename: Column, size_bytes: Column, extensions: tuple[str, ...] = EXTENSIONS, max_mb: int | None = None
) -> Column:
    """Whether a file may come in: by extension, whatever its case, and by size if there is a limit."""
    return refusal(filename, size_bytes, extensions, max_mb).isNull()


def refusal(
    filename: Column, size_bytes: Column, extensions: tuple[str, ...] = EXTENSIONS, max_mb: int | None = None
) -> Column:
    """Why a file may not come in, null if it may."""
    extension = F.when(F.contains(filename, F.lit(".")), F.lower(F.element_at(F.split(filename, r"\."), -1)))
    why = F.when(~F.coalesce(extension.isin(*extensions), F.lit(False)), F.lit("extension not accepted"))
    return why if max_mb is None else why.when(size_bytes > max_mb * 1024 * 1024, F.lit(f"larger than {max_mb} MB"))


def admit_files(
    files: DataFrame, extensions: tuple[str, ...] = EXTENSIONS, max_mb: int | None = None
) -> tuple[DataFrame, DataFrame]:
    """Admitted and refused files."""
    ok = admitted(F.col("filename"), F.col("size_bytes"), extensions, max_mb)
    return files.where(ok), files.where(~ok)


def register_files(files: DataFrame, tags: DataFrame | None = None) -> DataFrame:
    """File rows with the tags (source, environment, log_type) given for their ``stored_path``.

    Tags without a column ``stored_path`` go by ``filename``. No file may be tagged twice.
    """
    columns = ["source", "environment", "log_type"]
    if tags is None:
        tagged = files.withColumns({c: F.lit(None).cast("string") for c in columns})
    else:
        key = "stored_path" if "stored_path" in tags.columns else "filename"
        if not tags.groupBy(key).count().where("count > 1").isEmpty():
            raise ValueError(f"tags name a {key} more than once")
        tagged = files.join(tags.select(key, *columns), key, "left")
    return tagged.select(
        "id", "filename", "stored_path", *columns, F.lit("uploaded").alias("status"), "uploaded_at"
    )


def read_logs(spark: SparkSession, path: str | list[str], **options: str) -> DataFrame:
    """One row per line, blank lines kept; bytes that are not UTF-8 become U+FFFD.

    ``log_file_id`` and ``block_start`` tell where a line comes from.
    """
    return log_lines(spark.read.options(recursiveFileLookup="true", **options).text(path))


def log_lines(text: DataFrame) -> DataFrame:
    """The line columns of a text scan, batch or streaming."""
    return text.select(
        F.col("_metadata.file_path").alias("stored_path"),
        F.col("_metadata.file_name").alias("filename"),
        F.col("_metadata.file_size").alias("size_bytes"),
        F.col("_metadata.file_block_start").alias("block_start"),
        F.col("_metadata.file_modification_time").cast("timestamp_ntz").alias("uploaded_at"),
        F.make_valid_utf8(F.col("value")).alias("raw_line"),
        _scanned_file_id().alias("log_file_id"),
    )


_SPLIT = ["log_file_id", "block_start"]


def place_lines(lines: DataFrame, path: str | None = None) -> DataFrame:
    """The lines with ``_id``, which grows by one from line to line of a file split; written to ``path``.

    The files are read once, here. What follows reads the written rows, so it does not matter whether
    executors or settings change and the files would be split differently, or are replaced meanwhile.
    ``lines`` must come from a scan without a join or shuffle.
    """
    path = path or scratch_path(lines.sparkSession, "lines")
    placed = lines.withColumn("_id", F.monotonically_increasing_id())
    placed.write.parquet(path)
    return lines.sparkSession.read.schema(placed.schema).parquet(path)


def _placed(lines: DataFrame) -> DataFrame:
    return lines if "_id" in lines.columns else place_lines(lines)


def count_splits(lines: DataFrame) -> DataFrame:
    """One row per file split with its lines: the first row id, their number, and those before it. Written out."""
    counts = _placed(lines).groupBy(*_SPLIT).agg(F.min("_id").alias("_first"), F.count("*").alias("_lines"))
    earlier = Window.partitionBy("log_file_id").orderBy("block_start").rowsBetween(
        Window.unboundedPreceding, -1
    )
    return materialize(counts.withColumn("_before", F.coalesce(F.sum("_lines").over(earlier), F.lit(0))), "splits")


def with_line_number(
    lines: DataFrame, splits: DataFrame | None = None, bound: int = BROADCAST_SPLITS
) -> DataFrame:
    """Add ``line_number``, from 1 within each file, without sorting or shuffling the lines.

    Lines keep their order inside a file split, so a line's place is the number of lines in
    the earlier splits of the file plus its distance from the first line of its own split. Lines that
    don't come from ``place_lines`` are placed first. Should ``splits`` come from other lines, the job
    stops at the first line outside its split or in a split that was not counted.
    """
    lines = _placed(lines)
    splits = count_splits(lines) if splits is None else splits
    side = F.broadcast(splits) if at_most(splits, bound) else splits
    place = F.col("_id") - F.col("_first")
    counted = F.coalesce(place.between(0, F.col("_lines") - 1), F.lit(False))
    number = F.when(counted, F.col("_before") + place + 1).otherwise(
        F.raise_error(F.lit("the lines were split differently when they were counted")).cast("bigint")
    )
    joined = lines.join(side, _SPLIT, "left").withColumn("line_number", number)
    return joined.drop("_id", "_first", "_lines", "_before")
