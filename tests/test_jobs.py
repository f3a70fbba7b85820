from datetime import datetime, timedelta
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from logloom.operators import joins
from logloom.operators.filters import query_entries
from logloom.operators.windows import window_features
from logloom.plans import analytics
from logloom.plans import ingest as jobs
from logloom.sources import logs, tables
from logloom.streaming.jobs import late_windows, repair_windows, stream_ingest, stream_late_windows, stream_window_features

# One line of each family and one that fits none.
SAMPLE = """2024-05-06T07:08:09Z WARN tide-gauge sensor drifts
2024-05-06 07:08:10,500 INFO tide-gauge sensor reset
05-06 07:08:11.250  411  412 E Buoy: no fix
192.0.2.7 - pier [06/May/2024:07:08:12 +0000] "PUT /level HTTP/2" 503 0
{"time": "2024-05-06T07:08:13Z", "severity": "error", "component": "beacon", "body": "lamp out"}
== rotated ==
"""


@pytest.fixture()
def place(tmp_path):
    source, root = tmp_path / "in", tmp_path / "store"
    source.mkdir()
    (source / "sample.txt").write_text(SAMPLE)
    (source / "tool.exe").write_text("no\n")
    return source, str(root)


def files(spark, root):
    return {r["filename"]: r for r in tables.load(spark, root, "log_files").collect()}


def entries(spark, root):
    return tables.load(spark, root, "log_entries")


def test_ingest(spark, place):
    source, root = place
    tags = spark.createDataFrame(
        [("sample.txt", "app", "prod", "mixed")], "filename STRING, source STRING, environment STRING, log_type STRING"
    )
    refused = jobs.ingest(spark, str(source), root, tags, reference_year=2024)
    assert [r["filename"] for r in refused.collect()] == ["tool.exe"]

    state = files(spark, root)["sample.txt"]
    assert (state["status"], state["source"], state["log_type"]) == ("processed", "app", "mixed")
    assert (state["total_lines"], state["parsed_lines"], state["failed_lines"]) == (6, 5, 1)
    assert state["processed_at"] is not None and state["error"] is None

    rows = entries(spark, root).orderBy("line_number").collect()
    assert [r["parser_name"] for r in rows] == ["app_v1", "app_v1", "android_v1", "access_v1", "json_v1", None]
    assert [r["parse_confidence"] for r in rows] == [0.95, 0.95, 0.9, 0.85, 0.95, 0.0]
    assert [r["raw_line"] for r in rows] == SAMPLE.splitlines()
    assert [r["line_number"] for r in rows] == [1, 2, 3, 4, 5, 6]
    assert {str(r["event_date"]) for r in rows} == {"2024-05-06", "None"}
    known = tables.load(spark, root, "log_files")
    assert query_entries(entries(spark, root), known, source="app", level="error").count() == 2


def test_ingest_again_takes_only_what_is_new(spark, place):
    source, root = place
    jobs.ingest(spark, str(source), root)
    jobs.ingest(spark, str(source), root)
    assert entries(spark, root).count() == 6
    (source / "more.log").write_text("one\ntwo\n")
    jobs.ingest(spark, str(source), root)
    assert entries(spark, root).count() == 8
    assert files(spark, root)["more.log"]["failed_lines"] == 2


def test_many_files_are_taken_in_several_ingests(spark, place, monkeypatch):
    source, root = place
    (source / "more.log").write_text("one\ntwo\n")
    monkeypatch.setattr(jobs, "NAMED_PATHS", 1)
    monkeypatch.setattr(joins, "BROADCAST_ROWS", 0)
    jobs.ingest(spark, str(source), root)
    assert entries(spark, root).count() == 8
    assert entries(spark, root).select("ingest_id").distinct().count() == 2


def test_a_changed_file_replaces_its_old_lines(spark, place):
    source, root = place
    jobs.ingest(spark, str(source), root)
    (source / "sample.txt").write_text(SAMPLE + "one more\n")
    jobs.ingest(spark, str(source), root)
    rows = entries(spark, root).orderBy("line_number").collect()
    assert [r["raw_line"] for r in rows] == [*SAMPLE.splitlines(), "one more"]
    states = tables.load(spark, root, "log_files").where("filename = 'sample.txt'").collect()
    assert sorted(r["status"] for r in states) == ["processed", "replaced"]


def test_files_of_one_name_have_their_own_tags(spark, tmp_path):
    for place in ("a", "b"):
        (tmp_path / "in" / place).mkdir(parents=True)
        (tmp_path / "in" / place / "app.log").write_text(f"from {place}\n")
    listed = logs.list_source_files(spark, str(tmp_path / "in"))
    tags = listed.select(
        "stored_path",
        F.regexp_extract("stored_path", "in/(.)/", 1).alias("source"),
        F.lit("prod").alias("environment"),
        F.lit("x").alias("log_type"),
    )
    root = str(tmp_path / "store")
    jobs.ingest(spark, str(tmp_path / "in"), root, tags)
    known = tables.load(spark, root, "log_files")
    assert query_entries(entries(spark, root), known, source="a").first()["raw_line"] == "from a"
    twice = tags.select(F.lit("app.log").alias("filename"), "source", "environment", "log_type")
    with pytest.raises(ValueError):
        logs.register_files(listed, twice)


def test_one_unreadable_file_does_not_stop_the_others(spark, place, monkeypatch):
    source, root = place
    for name in ("a.log", "bad.log", "c.log"):
        (source / name).write_text("x\n")
    real = logs.read_logs

    def read(session, paths, **options):
        fail = F.raise_error(F.lit("FAILED_READ_FILE")).cast("string")
        broken = F.when(F.col("filename") == "bad.log", fail).otherwise(F.col("raw_line"))
        return real(session, paths, **options).withColumn("raw_line", broken)

    monkeypatch.setattr(logs, "read_logs", read)
    with pytest.raises(Exception, match="FAILED_READ_FILE"):
        jobs.ingest(spark, str(source), root)
    assert {n: r["status"] for n, r in files(spark, root).items()} == {
        "sample.txt": "processed",
        "a.log": "processed",
        "bad.log": "failed",
        "c.log": "processed",
        "tool.exe": "refused",
    }
    assert entries(spark, root).count() == 8
    monkeypatch.setattr(logs, "read_logs", real)
    jobs.ingest(spark, str(source), root)
    assert entries(spark, root).count() == 9


def test_refused_files_are_recorded_once(spark, place, tmp_path):
    source, root = place
    (source / "big.log").write_text("x" * 3_000_000)
    for _ in range(2):
        jobs.ingest(spark, str(source), root, max_mb=2)
    history = tables.files_history(spark, root).where("status = 'refused'").collect()
    why = {"tool.exe": "extension not accepted", "big.log": "larger than 2 MB"}
    assert {r["filename"]: r["error"] for r in history} == why and len(history) == 2
    other = str(tmp_path / "other")
    stream_ingest(spark, str(source), other, str(tmp_path / "progress"), max_mb=2).awaitTermination()
    state = {n: r["status"] for n, r in files(spark, other).items()}
    assert state == {"sample.txt": "processed", "tool.exe": "refused", "big.log": "refused"}


def test_a_broken_ingest_is_recorded_and_taken_up_again(spark, place, monkeypatch):
    source, root = place
    real = jobs.finish_files

    def fail(*args):
        raise RuntimeError("disk gone")

    monkeypatch.setattr(jobs, "finish_files", fail)
    with pytest.raises(RuntimeError):
        jobs.ingest(spark, str(source), root)
    state = files(spark, root)["sample.txt"]
    assert (state["status"], state["error"]) == ("failed", "disk gone")
    assert entries(spark, root).count() == 6

    monkeypatch.setattr(jobs, "finish_files", real)
    jobs.ingest(spark, str(source), root)
    assert entries(spark, root).count() == 6
    assert files(spark, root)["sample.txt"]["status"] == "processed"


def test_empty_store(spark, tmp_path):
    for name in ("log_files", "log_entries", "anomalies", "error_clusters", "pipeline_runs"):
        assert tables.load(spark, str(tmp_path / "none"), name).count() == 0


def test_clustering_by_day_stores_the_same(spark, seeded, tmp_path):
    full = seeded.withColumn("parse_error", F.lit(None).cast("string"))
    tables.append_entries(full, str(tmp_path), "one", cluster_by_day=True)
    assert entries(spark, str(tmp_path)).count() == 10


def test_ingest_then_analytics(spark, place):
    source, root = place
    lines = []
    for i in range(40):
        ts = (datetime(2025, 3, 1) + timedelta(minutes=i)).isoformat()
        lines.append(f"{ts}Z {'ERROR' if i % 2 else 'INFO'} svc-{i % 3} {('disk', 'queue', 'socket')[i // 2 % 3]} request timed out")
    (source / "app.log").write_text("\n".join(lines))
    jobs.ingest(spark, str(source), root)
    row = analytics.run_analytics(spark, root, trigger="post_ingestion", end=datetime(2025, 3, 1, 12)).first()
    assert (row["status"], row["trigger"]) == ("completed", "post_ingestion")
    assert row["clusters_created"] >= 2


def test_stream_ingest_in_steps(spark, place, tmp_path):
    source, root = place
    progress = str(tmp_path / "progress")
    stream_ingest(spark, str(source), root, progress).awaitTermination()
    assert entries(spark, root).count() == 6
    (source / "later.json").write_text('{"level": "info"}\n\n')
    stream_ingest(spark, str(source), root, progress).awaitTermination()
    stored = entries(spark, root).select("log_file_id", "line_number")
    assert stored.count() == stored.distinct().count() == 8
    state = files(spark, root)
    assert set(state) == {"sample.txt", "later.json", "tool.exe"}
    assert (state["later.json"]["total_lines"], state["later.json"]["failed_lines"]) == (2, 1)

    # A lost checkpoint makes every file arrive again.
    stream_ingest(spark, str(source), root, str(tmp_path / "other")).awaitTermination()
    assert entries(spark, root).count() == 8


def test_a_broken_stream_batch_is_recorded_and_taken_up_again(spark, place, tmp_path, monkeypatch):
    source, root = place
    real = jobs.finish_files

    def fail(*args):
        raise RuntimeError("disk gone")

    monkeypatch.setattr(jobs, "finish_files", fail)
    with pytest.raises(Exception, match="disk gone"):
        stream_ingest(spark, str(source), root, str(tmp_path / "progress")).awaitTermination()
    assert files(spark, root)["sample.txt"]["status"] == "failed"
    monkeypatch.setattr(jobs, "finish_files", real)
    stream_ingest(spark, str(source), root, str(tmp_path / "progress")).awaitTermination()
    assert entries(spark, root).count() == 6
    assert files(spark, root)["sample.txt"]["status"] == "processed"


STREAM_SCHEMA = "timestamp TIMESTAMP_NTZ, level STRING, service STRING"


def feed(spark, folder: Path, batches):
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, STREAM_SCHEMA).coalesce(1).write.mode("append").parquet(str(folder))
        yield i


def test_stream_windows(spark, tmp_path):
    source, out, progress = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "progress")
    at = lambda m, s=0: datetime(2025, 1, 1, 0, m, s)
    batches = [
        [(at(0), "ERROR", "a"), (at(1, 59), "WARNING", "b"), (at(2), "INFO", None), (at(20), "DEBUG", "a")],
        # The first row is later than the watermark and gets lost, the second is not.
        [(at(0, 30), "ERROR", "late"), (at(15), "WARN", "a"), (at(40), "INFO", "z")],
        [(at(59), "INFO", "z")],
    ]
    for _ in feed(spark, source, batches):
        stream = spark.readStream.schema(STREAM_SCHEMA).parquet(str(source))
        query = stream_window_features(stream, "10 minutes").writeStream.format("parquet")
        query.option("path", out).option("checkpointLocation", progress).trigger(availableNow=True).start().awaitTermination()
    got = {r["window_start"]: r for r in spark.read.parquet(out).collect()}
    assert sorted(got) == [at(0), at(2), at(14), at(20), at(40)]
    assert got[at(0)]["total_count"] == 2 and got[at(0)]["unique_services"] == 2
    assert got[at(0)]["error_rate"] == 0.5 and got[at(0)]["warn_count"] == 1
    assert got[at(2)]["unique_services"] == 0

    # A batch run over all rows repairs what came late.
    everything = spark.read.schema(STREAM_SCHEMA).parquet(str(source))
    repaired = {r["window_start"]: r for r in window_features(everything).collect()}
    assert repaired[at(0)]["total_count"] == 3
    assert all(repaired[w]["total_count"] == got[w]["total_count"] for w in got if w != at(0))


def test_late_windows_are_put_aside_and_repaired(spark, tmp_path):
    source, root = tmp_path / "in", str(tmp_path / "store")
    at = lambda m, s=0: datetime(2025, 1, 1, 0, m, s)
    batches = [
        [(None, "INFO", "a")],
        [(at(0), "ERROR", "a"), (at(2), "INFO", None), (at(20), "DEBUG", "a")],
        [(at(0, 30), "ERROR", "late"), (at(0, 40), "INFO", "late"), (at(15), "WARN", "a"), (at(40), "INFO", "z")],
        [(at(1), "INFO", "later"), (at(2), "INFO", "later"), (at(29), "INFO", "in time")],
    ]
    for _ in feed(spark, source, batches):
        stream = spark.readStream.schema(STREAM_SCHEMA).parquet(str(source))
        stream_late_windows(stream, root, str(tmp_path / "progress")).awaitTermination()
    late = {r["window_start"]: r["rows"] for r in late_windows(spark, root).collect()}
    assert late == {at(0): 3, at(2): 1, at(28): 1}

    everything = spark.read.schema(STREAM_SCHEMA).parquet(str(source))
    streamed = window_features(everything.where("service IS NULL OR service NOT LIKE 'late%'"))
    repaired = repair_windows(streamed, late_windows(spark, root), everything)
    assert sorted(repaired.collect()) == sorted(window_features(everything).collect())
    assert late_windows(spark, str(tmp_path / "none")).count() == 0
    assert sorted(repair_windows(streamed, late_windows(spark, str(tmp_path / "none")), everything).collect()) == sorted(streamed.collect())

    # A batch that is run again lists its windows once.
    stream = spark.readStream.schema(STREAM_SCHEMA).parquet(str(source))
    stream_late_windows(stream, root, str(tmp_path / "again")).awaitTermination()
    assert {r["window_start"]: r["rows"] for r in late_windows(spark, root).collect()} == late
