import pytest
from pyspark.sql import functions as F

from logloom.plans import listings
from logloom.plans.ingest import ingest_and_analyse
from logloom.sources import tables


def test_entries(seeded, seeded_files):
    page = listings.log_entries(seeded, seeded_files, 0, 3, source="nightly")
    assert (page.total, page.offset, page.limit, page.items.count()) == (10, 0, 3, 3)
    assert "parse_error" not in page.items.columns
    last = listings.log_entries(seeded, offset=8, limit=5)
    assert [r["line_number"] for r in last.items.collect()] == [2, 1] and last.total == 10
    assert listings.log_entries(seeded.limit(0)).items.count() == 0
    with pytest.raises(ValueError):
        listings.log_entries(seeded, limit=501)


def test_files(seeded_files):
    page = listings.log_files(seeded_files, "processed")
    assert page.total == 1 and page.limit == 50 and "stored_path" not in page.items.columns
    assert listings.log_files(seeded_files, "uploaded").total == 0


def test_anomalies_and_clusters(spark, tmp_path):
    empty = tables.load(spark, str(tmp_path), "anomalies")
    assert listings.anomalies(empty).total == 0
    rows = spark.createDataFrame([(i, i % 3) for i in range(5)], "label INT, count BIGINT")
    page = listings.error_clusters(rows, limit=2)
    assert [r["label"] for r in page.items.collect()] == [2, 1] and page.total == 5
    scored = spark.range(4).select(
        (F.lit("2025-01-01").cast("timestamp_ntz") + F.make_dt_interval(mins=F.col("id").cast("int") * 2)).alias("window_start"),
        (F.lit("2025-01-01").cast("timestamp_ntz") + F.make_dt_interval(mins=F.col("id").cast("int") * 2 + 2)).alias("window_end"),
        (F.col("id") * -0.1).alias("score"),
    )
    page = listings.anomalies(scored, start="2025-01-01 00:02:00", end="2025-01-01 00:06:00")
    assert page.total == 2 and [round(r["score"], 1) for r in page.items.collect()] == [-0.2, -0.1]


def test_ingest_and_analyse(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.log").write_text("nothing to see\n")
    run = ingest_and_analyse(spark, str(tmp_path / "in"), str(tmp_path / "store")).first()
    assert (run["trigger"], run["status"], run["anomalies_detected"]) == ("post_ingestion", "completed", 0)
    assert tables.load(spark, str(tmp_path / "store"), "log_entries").count() == 1
