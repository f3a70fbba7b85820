from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from logloom.operators import aggregates, filters, joins, paging, windows
from logloom.schemas import project


@pytest.mark.parametrize(
    "given, n",
    [
        ({}, 10),
        ({"level": "error"}, 3),
        ({"service": "cart"}, 3),
        ({"service": "Cart"}, 0),
        ({"keyword": "Basket"}, 3),
        ({"keyword": "b_sket%slow"}, 1),
        ({"start": datetime(2025, 3, 2, 8, 3), "end": datetime(2025, 3, 2, 8, 5)}, 3),
        ({"start": "2025-03-02T10:03:00+02:00"}, 7),
        ({"start": datetime(2025, 3, 2, 10, 3, tzinfo=timezone(timedelta(hours=2)))}, 7),
        ({"source": "nightly", "environment": "staging"}, 10),
        ({"source": "other"}, 0),
        ({"file_id": 1, "level": "WARN"}, 2),
        ({"file_id": 2}, 0),
        ({"level": "WARNING"}, 0),
    ],
)
def test_filters(seeded, seeded_files, given, n):
    assert filters.query_entries(seeded, seeded_files, **given).count() == n


@pytest.mark.parametrize(
    "keyword, found",
    [("\\%", ["100% done"]), ("c:\\t", ["C:tmp"]), ("c:\\\\t", ["C:\\tmp"]), ("done\\", []), ("\\_", ["a_b"]), ("", 4)],
)
def test_backslash_in_a_keyword(spark, keyword, found):
    df = spark.createDataFrame([("100% done",), ("C:\\tmp",), ("C:tmp",), ("a_b",), (None,)], "message STRING")
    rows = [r[0] for r in filters.by_keyword(df, keyword).collect()]
    assert rows == found if isinstance(found, list) else len(rows) == found


def test_files_are_joined_only_when_needed(seeded, seeded_files):
    plan = filters.query_entries(seeded, seeded_files, level="error")._jdf.queryExecution().toString()
    assert "Join" not in plan


def test_time_bounds_reach_the_partitions(spark, seeded, tmp_path):
    from logloom.sources import tables

    tables.append_entries(seeded.withColumn("parse_error", F.lit(None).cast("string")), str(tmp_path), "one")
    stored = tables.entries_table(spark, str(tmp_path))
    plan = filters.by_time(stored, datetime(2025, 3, 2, 8), datetime(2025, 3, 3)).select("level")
    text = plan._jdf.queryExecution().executedPlan().toString()
    # Dates far off have no folder of their own, so the one without a date is read as well.
    partitions = text.split("PartitionFilters: [")[1].split("]")[0]
    assert ">= 2025-03-02) OR isnull(event_date" in partitions and "<= 2025-03-03) OR" in partitions
    assert "message" not in text
    assert filters.by_time(stored, datetime(2025, 3, 3)).count() == 0
    assert filters.by_time(stored, datetime(2025, 3, 2, 8, 5)).count() == 5


def test_plans_show_every_filter_of_a_scan(spark, tmp_path):
    spark.createDataFrame([(1, datetime(2025, 3, 2).date())], "n INT, event_date DATE").write.partitionBy("event_date").parquet(f"{tmp_path}/t")
    stored = spark.read.parquet(f"{tmp_path}/t")
    for day in range(1, 9):
        stored = stored.where((F.col("event_date") >= F.lit(f"2025-03-0{day}").cast("date")) | F.col("event_date").isNull())
    text = stored._jdf.queryExecution().executedPlan().toString()
    assert all(f">= 2025-03-0{day})" in text.split("PartitionFilters: [")[1].split("]")[0] for day in range(1, 9))


def test_default_range():
    now = datetime(2025, 1, 2, 3)
    assert filters.default_range(now=now) == (now - timedelta(hours=24), now)
    assert filters.default_range(end=datetime(2024, 1, 2)) == (datetime(2024, 1, 1), datetime(2024, 1, 2))
    assert filters.default_range(start=datetime(2020, 1, 1), now=now) == (datetime(2020, 1, 1), now)


def test_projection_hides_internal_columns(seeded):
    shown = project(seeded.withColumn("parse_error", F.lit("x")), "log_entries").columns
    assert "parse_error" not in shown and "raw_line" in shown


@pytest.mark.parametrize("offset, limit", [(-1, 50), (0, 0), (0, 501)])
def test_page_bounds(offset, limit):
    with pytest.raises(ValueError):
        paging.check_page(offset, limit)


def test_page_bounds_accepted():
    paging.check_page()
    paging.check_page(10**9, 500)


def test_page(seeded):
    rows = paging.newest_first(seeded, 2, 3).collect()
    assert [r["line_number"] for r in rows] == [8, 7, 6]


def test_page_count(spark):
    df = spark.createDataFrame([(0,), (50,), (51,)], "n BIGINT")
    assert [r[0] for r in df.select(paging.page_count(F.col("n"), 50)).collect()] == [1, 1, 2]


def test_far_pages_match_a_full_sort(spark, monkeypatch):
    """A third of the rows share one time, some have none."""
    monkeypatch.setattr(paging, "SEEK_FROM", 1)
    rows = spark.range(3000).select(
        (F.col("id") % 7).alias("log_file_id"),
        F.floor(F.col("id") / 7).alias("line_number"),
        F.when(F.col("id") % 3 == 0, F.lit("2024-01-05").cast("timestamp_ntz"))
        .when(F.col("id") % 11 != 0, (F.lit("2024-01-01").cast("timestamp") + F.make_dt_interval(mins=(F.col("id") * 37 % 9000).cast("int"))).cast("timestamp_ntz"))
        .alias("timestamp"),
    )
    order = [F.desc_nulls_last("timestamp"), "log_file_id", "line_number"]
    every = [tuple(r) for r in rows.orderBy(*order).collect()]
    for offset in (1, 40, 900, 1500, 2600, 2990, 3000, 5000):
        assert [tuple(r) for r in paging.newest_first(rows, offset, 20).collect()] == every[offset : offset + 20]


def test_seek_leaves_few_rows_to_sort(spark, monkeypatch):
    monkeypatch.setattr(paging, "SEEK_FROM", 1)
    rows = spark.range(1000).selectExpr("1L AS log_file_id", "id AS line_number", "TIMESTAMP_NTZ'2024-01-01' AS timestamp")
    rest, offset = paging._seek(rows, 900)
    assert offset == 0 and rest.count() == 100


@pytest.mark.parametrize("bound", [joins.BROADCAST_ROWS, 0])
def test_joins_agree_with_and_without_broadcast(spark, bound):
    """One file holds a third of the entries."""
    entries = spark.range(3000).select(
        F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 50).cast("bigint").alias("log_file_id"),
        F.col("id").alias("line_number"),
    )
    files = spark.range(0, 50, 5).select("id", F.lit("app").alias("source"))
    want = entries.where("log_file_id % 5 = 0").count()
    joined = joins.join_files(entries, files, bound)
    assert joined.count() == want and joined.columns == ["log_file_id", "line_number", "source"]
    assert joins.drop_orphans(entries, files, bound).count() == want
    plan = joins.drop_orphans(entries, files, bound)._jdf.queryExecution().optimizedPlan().toString()
    assert ("_salt" in plan) == (bound == 0)


def test_new_entries(seeded):
    stored = seeded.where("line_number <= 4")
    fresh = joins.new_entries(seeded.unionByName(seeded), stored)
    assert sorted(r["line_number"] for r in fresh.collect()) == [5, 6, 7, 8, 9, 10]
    assert joins.new_entries(seeded, seeded).count() == 0


@pytest.mark.parametrize("bound", [joins.BROADCAST_ROWS, 0])
def test_entries_in_windows_of_any_length(spark, seeded, bound):
    at = lambda m, s=0: datetime(2025, 3, 2, 8, m, s)
    spans = [(at(0), at(2)), (at(1, 30), at(7)), (at(3), at(3)), (at(9), at(30)), (at(0), at(59))]
    frame = spark.createDataFrame(spans, "window_start TIMESTAMP_NTZ, window_end TIMESTAMP_NTZ")
    got = joins.entries_in_windows(frame, seeded, bound=bound).collect()
    want = [
        (s, e, r["line_number"]) for s, e in spans for r in seeded.collect() if s <= r["timestamp"] < e
    ]
    assert sorted((r["window_start"], r["window_end"], r["line_number"]) for r in got) == sorted(want)


def test_windows_of_the_seeded_entries(seeded):
    rows = windows.window_features(seeded).orderBy("window_start").collect()
    assert [r["total_count"] for r in rows] == [2] * 5
    assert [r["error_count"] for r in rows] == [0, 1, 1, 0, 1]
    assert [r["warn_count"] for r in rows] == [0, 0, 1, 1, 0]
    assert [r["unique_services"] for r in rows] == [1, 2, 1, 1, 1]
    assert rows[0]["window_end"] - rows[0]["window_start"] == timedelta(minutes=2)
    assert sum(r["total_count"] for r in windows.window_features(seeded, datetime(2025, 3, 2, 8, 2)).collect()) == 8


def test_features_do_not_depend_on_partitions(seeded):
    want = sorted(map(tuple, windows.window_features(seeded.coalesce(1)).collect()))
    assert sorted(map(tuple, windows.window_features(seeded.repartition(7)).collect())) == want


def test_timeline(spark, seeded):
    rows = windows.log_timeline(seeded).collect()
    assert [r["bucket"] for r in rows] == list(range(10))
    assert [r["total"] for r in rows] == [1] * 10
    assert sum(r["errors"] for r in rows) == 3 and sum(r["warnings"] for r in rows) == 2
    one = windows.log_timeline(seeded.where("line_number = 1")).collect()
    assert [r["total"] for r in one] == [1]
    assert windows.log_timeline(seeded.where("line_number = 0")).count() == 0
    few = windows.log_timeline(seeded.where("line_number IN (1, 2, 10)"), 20).collect()
    assert [r["total"] for r in few] == [2, 0, 1]


def test_stats(spark, seeded, seeded_files):
    assert tuple(aggregates.totals(seeded, seeded_files).first()) == (10, 1)
    levels = [tuple(r) for r in aggregates.level_breakdown(seeded).collect()]
    assert levels == [("INFO", 4), ("ERROR", 3), ("WARN", 2), ("DEBUG", 1)]
    services = [tuple(r) for r in aggregates.top_services(seeded, 2).collect()]
    assert services == [("mailer", 4), ("cart", 3)]
    nothing = aggregates.stats_summary(seeded.limit(0), seeded_files.limit(0))
    assert {tuple(r) for r in nothing.collect()} == {("total", "entries", 0), ("total", "files", 0)}


def test_summary_counts_partial_lines_as_parsed(spark):
    df = spark.createDataFrame([(1, "parsed"), (1, "partial"), (1, "failed"), (2, "failed")], "log_file_id BIGINT, parse_status STRING")
    rows = {r["log_file_id"]: tuple(r)[1:] for r in aggregates.file_summary(df).collect()}
    assert rows == {1: (3, 2, 1), 2: (1, 0, 1)}
