"""How stored tables are laid out, skipped, rewritten and published."""

from datetime import datetime, timedelta
from urllib.parse import unquote

import pytest
from pyspark.sql import functions as F

from logloom.operators.filters import by_time, utc_now
from logloom.sources import tables, versions

TODAY = utc_now().replace(hour=0, minute=0, second=0, microsecond=0)


def day(n, hour=0):
    return TODAY - timedelta(days=n) + timedelta(hours=hour)


def rows(spark, times, file_id=1, level="INFO"):
    data = [(file_id, i + 1, t, level, "svc", "m", "m", "parsed", None, 0.9, "app_v1") for i, t in enumerate(times)]
    schema = (
        "log_file_id BIGINT, line_number BIGINT, timestamp TIMESTAMP_NTZ, level STRING, service STRING, message STRING, "
        "raw_line STRING, parse_status STRING, parse_error STRING, parse_confidence DOUBLE, parser_name STRING"
    )
    return spark.createDataFrame(data, schema).coalesce(1)


def folders(df):
    return {unquote(p).split("event_date=")[1].split("/")[0] for p in df.inputFiles()}


def keys(df):
    return sorted((r["log_file_id"], r["line_number"]) for r in df.collect())


def test_a_one_day_filter_lists_one_day(spark, tmp_path):
    root = str(tmp_path)
    for n in range(30):
        tables.append_entries(rows(spark, [day(n % 10, h) for h in range(24)], n), root, f"ingest-{n}")
    start, end = day(3, 5), day(3, 7)
    read = tables.entries_table(spark, root, start, end)
    assert folders(read) == {str(day(3).date())} and len(read.inputFiles()) == 3
    want = keys(by_time(tables.load(spark, root, "log_entries"), start, end))
    assert keys(by_time(read, start, end)) == want and len(want) == 9
    assert tables.entries_table(spark, root, level="error").inputFiles() == []
    assert len(tables.entries_of_ingests(spark, root, ["ingest-7"]).inputFiles()) == 1


def test_far_off_dates_share_one_folder(spark, tmp_path):
    root = str(tmp_path)
    claimed = [datetime(1201 + 3 * i, 1, 1) for i in range(200)] + [datetime(9999, 12, 31), None, day(2)]
    tables.append_entries(rows(spark, claimed), root, "one")
    every = tables.load(spark, root, "log_entries")
    assert folders(every) == {"__HIVE_DEFAULT_PARTITION__", str(day(2).date())}
    assert every.count() == len(claimed)
    assert by_time(every, datetime(1300, 1, 1), datetime(1400, 1, 1)).count() == 34
    assert by_time(tables.entries_table(spark, root, datetime(9000, 1, 1)), datetime(9000, 1, 1)).count() == 1


def test_files_are_sorted_by_time(spark, tmp_path):
    tables.append_entries(rows(spark, [day(1, h) for h in (9, 3, 20, 1)]), str(tmp_path), "one")
    read = tables.load(spark, str(tmp_path), "log_entries").collect()
    assert [r["timestamp"].hour for r in read] == [1, 3, 9, 20]


def test_dropped_files_leave_no_join(spark, tmp_path):
    root = str(tmp_path)
    for n in range(3):
        tables.append_entries(rows(spark, [day(1, n), day(2), None], n), root, f"i{n}")
    tables.append_entries(rows(spark, [day(1)], 7).unionByName(rows(spark, [day(1)], 8)), root, "i7")
    gone = spark.createDataFrame([(1,), (7,), (99,)], "id BIGINT")
    assert tables.drop_entries(spark, root, gone) > 0
    left = tables.load(spark, root, "log_entries")
    assert keys(left) == sorted([(n, i) for n in (0, 2) for i in (1, 2, 3)] + [(8, 1)])
    assert "Join" not in left._jdf.queryExecution().toString()
    assert tables.drop_entries(spark, root, gone) in (0, 2)  # a file may span the numbers and hold none of them
    assert keys(tables.load(spark, root, "log_entries")) == keys(left)
    assert tables.drop_entries(spark, root, gone.limit(0)) == 0


def test_compaction_keeps_every_row(spark, tmp_path):
    root = str(tmp_path)
    for n in range(9):
        tables.append_entries(rows(spark, [day(1, n), day(2, n)] + [None] * (n == 0), n), root, f"i{n}")
    before = keys(tables.load(spark, root, "log_entries"))
    assert tables.compact(spark, root, before=day(1)) == 9
    after = tables.load(spark, root, "log_entries")
    assert keys(after) == before
    counts = {str(r["event_date"]): r["count"] for r in tables.entry_files(spark, root).groupBy("event_date").count().collect()}
    assert counts[str(day(2).date())] == 1 and counts[str(day(1).date())] == 9 and counts["None"] == 1
    assert tables.compact(spark, root, before=day(1)) == 0
    # An ingest that was cut off may be taken up after its files were merged: none of its lines is lost.
    assert {(3, 1), (3, 2)} <= set(keys(tables.entries_of_ingests(spark, root, ["i3"])))


def test_a_rewrite_that_comes_second_starts_over(spark, tmp_path, monkeypatch):
    root, real, calls = str(tmp_path), versions.claim, []
    for n in range(2):
        tables.append_entries(rows(spark, [day(1, n)], n), root, f"i{n}")

    def second(session, *args):
        calls.append(args)
        if len(calls) == 1:  # another run drops file 0 just before
            tables.drop_entries(session, root, session.createDataFrame([(0,)], "id BIGINT"))
        return real(session, *args)

    monkeypatch.setattr(versions, "claim", second)
    tables.drop_entries(spark, root, spark.createDataFrame([(0,), (1,)], "id BIGINT"))
    assert len(calls) == 3 and tables.load(spark, root, "log_entries").count() == 0


def test_pages_read_the_days_they_lie_in(spark, tmp_path):
    from logloom.plans import listings

    root = str(tmp_path)
    times = [day(n, h) for n in range(5) for h in range(6)] + [None] * 7 + [datetime(1500, 1, 1), datetime(2999, 1, 1), datetime(1500, 1, 1)]
    tables.append_entries(rows(spark, times), root, "one")
    tables.append_entries(rows(spark, [day(2, 3), None], 2), root, "two")
    order = sorted(
        [(1, i + 1, t) for i, t in enumerate(times)] + [(2, 1, day(2, 3)), (2, 2, None)],
        key=lambda r: (r[2] is None, datetime.max - (r[2] or datetime.max), r[0], r[1]),
    )
    for offset, limit in ((0, 1), (0, 4), (6, 7), (20, 5), (30, 10), (len(order) - 3, 50), (len(order), 5), (5, 500)):
        page = listings.stored_entries(spark, root, offset, limit)
        got = [(r["log_file_id"], r["line_number"], r["timestamp"]) for r in page.items.collect()]
        assert got == order[offset : offset + limit] and page.total == len(order)
    # Two days back: its own folder, and at most that of the dates without one.
    read = [f for f in listings.stored_entries(spark, root, 14, 3).items.inputFiles()]
    assert {f.split("event_date=")[1].split("/")[0] for f in read} - {"__HIVE_DEFAULT_PARTITION__"} == {str(day(2).date())}
    assert listings.stored_entries(spark, str(tmp_path / "none")).total == 0


def test_versions(spark, tmp_path):
    root = str(tmp_path)
    assert versions.latest(spark, root, "t") == (0, "")
    assert versions.claim(spark, root, "t", 0, "a")
    assert not versions.claim(spark, root, "t", 0, "b")
    assert versions.latest(spark, root, "t") == (1, "a")
    for n in range(1, 105):
        assert versions.claim(spark, root, "t", n, f"v{n}")
    assert versions.latest(spark, root, "t") == (105, "v104")
    assert len([p for p in (tmp_path / "versions" / "t").iterdir() if p.name.isdigit()]) == versions.KEPT


def test_interleaved_runs_keep_both_results(spark, tmp_path, monkeypatch):
    root, real = str(tmp_path), versions.claim
    columns = tables._current(spark, root, "anomalies")[1].schema

    def window(hour):
        at = day(1, hour)
        return spark.createDataFrame([(at, at + timedelta(minutes=2), -0.5, 0.5, None, "d", f"run-{hour}", at)], columns)

    def publish(hour):
        change = lambda old: tables.replace_anomalies(old, window(hour), day(1, hour), day(1, hour + 1))
        return tables.publish(spark, root, "anomalies", change)

    publish(1)
    others = [2]

    def late(session, *args):
        if others:  # the other run has read the same base and publishes first
            publish(others.pop())
        return real(session, *args)

    monkeypatch.setattr(versions, "claim", late)
    publish(3)
    runs = {r["pipeline_run_id"] for r in tables.load(spark, root, "anomalies").collect()}
    assert runs == {"run-1", "run-2", "run-3"}


@pytest.mark.parametrize("name", ["anomalies", "error_clusters", "log_entries", "log_files", "pipeline_runs"])
def test_nothing_stored_yet(spark, tmp_path, name):
    assert tables.load(spark, str(tmp_path), name).count() == 0
    assert tables.compact(spark, str(tmp_path)) == 0
