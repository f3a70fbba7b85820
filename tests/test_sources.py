import pytest
from pyspark.sql import functions as F

from logloom.sources import logs


def write(path, name, data):
    target = path / name
    target.parent.mkdir(parents=True, exist_ok=True)
    target.write_bytes(data)
    return str(target)


@pytest.fixture()
def folder(tmp_path):
    write(tmp_path, "a.log", b"one\n\ntwo\r\nthree\rfour")
    write(tmp_path, "sub dir/b+c.TXT", b"caf\xc3\xa9 \xff\xfe bad \xc3\n")
    write(tmp_path, "c.exe", b"no\n")
    write(tmp_path, "empty.json", b"")
    write(tmp_path, "noext", b"no\n")
    return str(tmp_path)


def numbered(spark, path):
    rows = logs.with_line_number(logs.read_logs(spark, path)).collect()
    out = {}
    for r in rows:
        out.setdefault(r["filename"], []).append((r["line_number"], r["raw_line"]))
    return {k: sorted(v) for k, v in out.items()}


def test_lines_and_numbers(spark, folder):
    got = numbered(spark, folder)
    assert got["a.log"] == [(1, "one"), (2, ""), (3, "two"), (4, "three"), (5, "four")]
    assert [t for k, v in got.items() if k.startswith("b") for _, t in v] == [
        b"caf\xc3\xa9 \xff\xfe bad \xc3".decode("utf-8", "replace")
    ]
    assert "empty.json" not in got


@pytest.mark.parametrize("bound", [logs.BROADCAST_SPLITS, 0])
def test_numbers_over_many_splits(spark, tmp_path, bound):
    big = [f"line {i} " + "x" * (i % 50) for i in range(5000)]
    write(tmp_path, "big.log", "\n".join(big).encode())
    write(tmp_path, "small.log", b"only\n")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "10000")
    try:
        lines = logs.read_logs(spark, str(tmp_path))
        assert lines.select("filename", "block_start").distinct().count() > 10
        rows = logs.with_line_number(lines, bound=bound).where(F.col("filename") == "big.log").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert {r["line_number"]: r["raw_line"] for r in rows} == dict(enumerate(big, 1))


def test_listing_and_admission(spark, folder):
    listed = logs.list_source_files(spark, folder)
    accepted, refused = logs.admit_files(listed)
    # A scan skips empty files, so they are neither admitted nor refused.
    assert {r["size_bytes"] for r in accepted.collect()} == {15, 20}
    assert {r["filename"] for r in refused.collect()} == {"c.exe", "noext"}
    scanned = logs.read_logs(spark, folder).select("log_file_id", "stored_path").distinct()
    assert scanned.join(listed, [scanned.log_file_id == listed.id]).count() == scanned.count() == 4


def test_size_cap(spark):
    sizes = spark.createDataFrame([("a.log", 200 * 1024 * 1024), ("b.log", 200 * 1024 * 1024 + 1)], "filename STRING, size_bytes BIGINT")
    accepted, refused = logs.admit_files(sizes, max_mb=200)
    assert [r["filename"] for r in accepted.collect()] == ["a.log"]
    assert [r["filename"] for r in refused.collect()] == ["b.log"]
    assert logs.admit_files(sizes)[1].isEmpty()


def test_listing_reads_no_content(spark, folder):
    plan = logs.list_source_files(spark, folder)._jdf.queryExecution().toString()
    assert "ReadSchema: struct<>" in plan.split("== Physical Plan ==")[1]


def test_registration(spark, folder):
    tags = spark.createDataFrame(
        [("a.log", "app", "prod", "text")], "filename STRING, source STRING, environment STRING, log_type STRING"
    )
    rows = {r["filename"]: r for r in logs.register_files(logs.list_source_files(spark, folder), tags).collect()}
    assert (rows["a.log"]["source"], rows["a.log"]["environment"], rows["a.log"]["status"]) == ("app", "prod", "uploaded")
    assert rows["noext"]["source"] is None and len(rows) == 4


def test_lines_split_otherwise_stop_the_job(spark, tmp_path):
    write(tmp_path, "a.log", b"x\n" * 100)
    lines = logs.read_logs(spark, str(tmp_path))
    splits = logs.count_splits(lines).withColumn("_lines", F.lit(50).cast("bigint"))
    with pytest.raises(Exception, match="split differently"):
        logs.with_line_number(lines, splits).collect()


def test_a_split_that_was_not_counted_stops_the_job(spark, tmp_path):
    write(tmp_path, "a.log", b"some line\n" * 4000)
    lines = logs.read_logs(spark, str(tmp_path))
    splits = logs.count_splits(lines)
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "10000")
    try:
        with pytest.raises(Exception, match="split differently"):
            logs.with_line_number(logs.read_logs(spark, str(tmp_path)), splits).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_placed_lines_are_numbered_under_any_later_settings(spark, tmp_path):
    want = [f"line {i}" for i in range(4000)]
    write(tmp_path, "a.log", "\n".join(want).encode())
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "3000")
    try:
        placed = logs.place_lines(logs.read_logs(spark, str(tmp_path)))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert placed.select("block_start").distinct().count() > 5
    splits = logs.count_splits(placed)
    write(tmp_path, "a.log", b"replaced meanwhile\n")
    got = {r["line_number"]: r["raw_line"] for r in logs.with_line_number(placed, splits).collect()}
    assert got == dict(enumerate(want, 1))
