from datetime import datetime

import pytest

from logloom.operators.normalize import PARSED_COLUMNS, normalize

T = datetime
# line -> timestamp, level, service, message, status, confidence, parser
CASES = {
    "2024-05-06T07:08:09Z INFO tide-gauge sensor up": (
        T(2024, 5, 6, 7, 8, 9), "INFO", "tide-gauge", "sensor up", "parsed", 0.95, "app_v1"),
    "2024-05-06T07:08:09.250125Z WARN harbour.2 tide late": (
        T(2024, 5, 6, 7, 8, 9, 250125), "WARN", "harbour.2", "tide late", "parsed", 0.95, "app_v1"),
    "2024-05-06T07:08:09.250125789Z WARN café x": (
        T(2024, 5, 6, 7, 8, 9, 250125), "WARN", "café", "x", "parsed", 0.95, "app_v1"),
    "2024-05-06 07:08:10,5 ERROR beacon lamp out": (
        T(2024, 5, 6, 7, 8, 10, 500000), "ERROR", "beacon", "lamp out", "parsed", 0.95, "app_v1"),
    "2024-05-06 07:08:10 INFO beacon lamp on": (
        T(2024, 5, 6, 7, 8, 10), "INFO", "beacon", "lamp on", "parsed", 0.95, "app_v1"),
    "2024-05-06\t07:08:10\tINFO\tbeacon\ttabs": (
        T(2024, 5, 6, 7, 8, 10), "INFO", "beacon", "tabs", "parsed", 0.95, "app_v1"),
    "2024-05-06  07:08:10 INFO beacon two spaces": (
        None, "INFO", "beacon", "two spaces", "partial", 0.6, "app_v1"),
    "2024-02-30T07:08:09Z INFO beacon no such day": (
        None, "INFO", "beacon", "no such day", "partial", 0.6, "app_v1"),
    "2025-01-01T00:00:00Z INFO svc a\rb": (T(2025, 1, 1), "INFO", "svc", "a\rb", "parsed", 0.95, "app_v1"),
    "2025-01-01T00:00:00Z INFO svc \x00a\x00b": (
        T(2025, 1, 1), "INFO", "svc", "\x00a\x00b", "parsed", 0.95, "app_v1"),
    "2025-01-01T00:00:00Z info svc lower case": (None, None, None, None, "failed", 0.0, None),
    "05-06 07:08:11.25  411  412 D Buoy7: fix found": (
        T(2024, 5, 6, 7, 8, 11, 250000), "DEBUG", "Buoy7", "fix found", "parsed", 0.9, "android_v1"),
    "02-29 19:40:27.4  1  2 W Big Tag : a: b": (
        T(2024, 2, 29, 19, 40, 27, 400000), "WARNING", "Big Tag", "a: b", "parsed", 0.9, "android_v1"),
    "02-30 19:40:27.4  1  2 F x: y": (None, "ERROR", "x", "y", "partial", 0.6, "android_v1"),
    "11-01 19:40:27.1234567  1  2 V x: y": (None, "DEBUG", "x", "y", "partial", 0.6, "android_v1"),
    "11-01 19:40:27.1  1  2 A  : y": (
        T(2024, 11, 1, 19, 40, 27, 100000), "ERROR", "", "y", "partial", 0.6, "android_v1"),
    "D/Buoy7(  411): fix found": (
        None, "DEBUG", "Buoy7", "fix found", "partial", 0.6, "android_v1"),
    "E/a:b(12): x(y": (None, "ERROR", "a:b", "x(y", "partial", 0.6, "android_v1"),
    '192.0.2.7 - - [06/May/2024:07:08:12 +0000] "HEAD /level HTTP/2" 204 0': (
        T(2024, 5, 6, 7, 8, 12), None, None, "HEAD /level HTTP/2 -> 204", "parsed", 0.85, "access_v1"),
    '192.0.2.7 - pier [06/May/2024:07:08:12 +0000] "PUT /level HTTP/2" 503 9 "-" "gauge 3"': (
        T(2024, 5, 6, 7, 8, 12), None, None, "PUT /level HTTP/2 -> 503", "parsed", 0.85, "access_v1"),
    '198.51.100.4 - - [09/Jun/2024:21:47:03 -0330] "POST /tide HTTP/3" 202 17': (
        T(2024, 6, 10, 1, 17, 3), None, None, "POST /tide HTTP/3 -> 202", "parsed", 0.85, "access_v1"),
    'h - - [09/Jun/2024:21:47:03 +0530] "" 200 0': (
        T(2024, 6, 9, 16, 17, 3), None, None, None, "parsed", 0.85, "access_v1"),
    'h - - [09/Jun/2024:21:47:03] "no zone" 200 0': (
        T(2024, 6, 9, 21, 47, 3), None, None, "no zone -> 200", "parsed", 0.85, "access_v1"),
    'h - - [09/Jun/2024:21:47:03 GMT] "named zone" 200 0': (
        T(2024, 6, 9, 21, 47, 3), None, None, "named zone -> 200", "parsed", 0.85, "access_v1"),
    'h - - [09/Jun/2024:21:47:03 +9900] "far zone" 200 0': (
        T(2024, 6, 5, 18, 47, 3), None, None, "far zone -> 200", "parsed", 0.85, "access_v1"),
    'h - - [09/Foo/2024:21:47:03 +0000] "bad month" 404 -': (
        None, None, None, "bad month -> 404", "partial", 0.7, "access_v1"),
    'h - - [09/Jun/2024:21:47:61 +0000] "bad second" 404 -': (
        None, None, None, "bad second -> 404", "partial", 0.7, "access_v1"),
    '{"timestamp": "2024-05-06T07:08:13Z", "level": "WARN", "service": "beacon", "message": "lamp dim"}': (
        T(2024, 5, 6, 7, 8, 13), "WARN", "beacon", "lamp dim", "parsed", 0.95, "json_v1"),
    '{"ts": "2024-05-06T07:00:00Z", "severity": "error", "app": "ferry", "msg": "engine stopped"}': (
        T(2024, 5, 6, 7), "ERROR", "ferry", "engine stopped", "parsed", 0.95, "json_v1"),
    '{"timestamp": "2024-05-06T07:00:00Z", "level": "INFO", "ship": {"service": "ferry"}, "message": "docked"}': (
        T(2024, 5, 6, 7), "INFO", "ferry", "docked", "parsed", 0.95, "json_v1"),
    '  {"level": null, "lvl": "x", "message": true, "ts": 1735647341.123}  ': (
        T(2024, 12, 31, 12, 15, 41, 123000), None, None, "True", "partial", 0.7, "json_v1"),
    '{"level": "a", "level": "b", "n": {"app": 1, "app": 2}, "text": ""}': (
        None, "B", "2", "", "partial", 0.7, "json_v1"),
    '{"s": "{\\"level\\": \\"x\\"}", "time": -1.5}': (
        T(1969, 12, 31, 23, 59, 58, 500000), None, None, None, "partial", 0.7, "json_v1"),
    '{"x": {"y": 1}, "a": {"body": "first"}, "b": {"msg": "second", "priority": 30}}': (
        None, "30", None, "first", "partial", 0.7, "json_v1"),
    '{"level": 5.0, "service": 5.5, "message": "5"}': (None, "5.0", "5.5", "5", "partial", 0.7, "json_v1"),
    '{"level": "true", "service": false, "message": 7}': (None, "TRUE", "False", "7", "partial", 0.7, "json_v1"),
    '{"mast": "main", "sails": 3}': (None, None, None, None, "partial", 0.5, "json_v1"),
    "{}": (None, None, None, None, "partial", 0.5, "json_v1"),
    '{"level": "ERROR", "message": "rope torn"}': (
        None, "ERROR", None, "rope torn", "partial", 0.7, "json_v1"),
    '{"broken json': (None, None, None, None, "failed", 0.0, None),
    '{"a": 1} junk': (None, None, None, None, "failed", 0.0, None),
    '{"a": 1}, {"b": 2}': (None, None, None, None, "failed", 0.0, None),
    "{'level': 'FATAL'}": (None, None, None, None, "failed", 0.0, None),
    "[1]": (None, None, None, None, "failed", 0.0, None),
    "== rotated ==": (None, None, None, None, "failed", 0.0, None),
    "A\x00x\x00y": (None, None, None, None, "failed", 0.0, None),
    "": (None, None, None, None, "failed", 0.0, None),
    "   ": (None, None, None, None, "failed", 0.0, None),
}

TIMES = {
    '"2025-01-02T03:04:05+05:30"': T(2025, 1, 1, 21, 34, 5),
    '"20250102T030405.5-0100"': T(2025, 1, 2, 4, 4, 5, 500000),
    '"2025-01-02T03:04:05,25"': T(2025, 1, 2, 3, 4, 5, 250000),
    '"2025-01-02"': T(2025, 1, 2),
    '"2025-01-02x03"': T(2025, 1, 2, 3),
    '"2025-01-02T03:04+01:00:30"': T(2025, 1, 2, 2, 3, 30),
    '"2025-01-02T24:00:00"': None,
    '"2025-01-02T03:04:05+24:00"': None,
    '"2025-0102"': None,
    '"2025"': None,
    '" 2025-01-02"': None,
    '"0000-01-02T03:04:05Z"': None,
    '"12 June"': None,
    "1735647341": T(2024, 12, 31, 12, 15, 41),
    "1735647341123": None,
    "1e20": None,
    "true": T(1970, 1, 1, 0, 0, 1),
    "[1]": None,
    "null": None,
}


@pytest.fixture(scope="module")
def parsed(spark):
    lines = [(i, line) for i, line in enumerate(CASES)]
    rows = normalize(spark.createDataFrame(lines, "i INT, raw_line STRING"), reference_year=2024).collect()
    return {lines[r["i"]][1]: r for r in rows}


@pytest.mark.parametrize("line", CASES)
def test_line(parsed, line):
    row = parsed[line]
    got = tuple(row[c] for c in ("timestamp", "level", "service", "message", "parse_status", "parse_confidence", "parser_name"))
    assert got == CASES[line]
    assert row["raw_line"] == line


def test_errors(parsed):
    messages = {r["parse_error"] for r in parsed.values()}
    assert messages == {None, "No parser matched", "access timestamp parse failed"}
    assert all((r["parse_error"] == "No parser matched") == (r["parse_status"] == "failed") for r in parsed.values())


def test_json_timestamps(spark):
    lines = [(t, f'{{"ts": {t}}}') for t in TIMES]
    rows = normalize(spark.createDataFrame(lines, "t STRING, raw_line STRING")).collect()
    assert {r["t"]: r["timestamp"] for r in rows} == TIMES


def test_trailing_newlines_go_and_inner_ones_stay(spark):
    df = spark.createDataFrame([("x\n\n",), ("2025-01-01T00:00:00Z INFO svc a\nb",)], "raw_line STRING")
    rows = normalize(df).collect()
    assert [r["raw_line"] for r in rows] == ["x", "2025-01-01T00:00:00Z INFO svc a\nb"]
    assert [r["parse_status"] for r in rows] == ["failed", "failed"]


def test_android_year_defaults_to_the_current_one(spark):
    df = spark.createDataFrame([("03-01 19:40:27.482  1  2 D x: y",)], "raw_line STRING")
    row = normalize(df).selectExpr("year(timestamp) = year(current_date()) AS same").first()
    assert row["same"]


def test_other_columns_are_kept_and_every_line_gives_a_row(spark):
    df = spark.createDataFrame([(i, line) for i, line in enumerate(CASES)], "k INT, line STRING")
    out = normalize(df, "line")
    assert out.columns == ["k", *PARSED_COLUMNS]
    assert out.count() == len(CASES)


def test_filters_on_parsed_columns_do_not_repeat_the_parsing(spark):
    df = spark.createDataFrame([("x",)], "raw_line STRING")
    plan = normalize(df).where("parse_status = 'failed' AND level IS NULL")._jdf.queryExecution().toString()
    optimized = plan.split("== Optimized Logical Plan ==")[1].split("== Physical Plan ==")[0]
    assert optimized.count("from_json") == 1


def test_filters_on_kept_columns_reach_the_scan_and_others_stay_above_the_parsing(spark, tmp_path):
    path = str(tmp_path / "lines")
    spark.range(10).selectExpr("id", "'garbage' AS raw_line").write.parquet(path)
    found = normalize(spark.read.parquet(path)).where("id > 5 AND level = 'loud' AND service <> 'x'")
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    above, below = plan.split("Generate inline", 1)
    assert "level" in above and "regexp_replace" not in above and "id#" not in above.split("Filter", 1)[1]
    assert "> 5" in below and "loud" in above and "loud" not in below
    assert "GreaterThan(id,5)" in found._jdf.queryExecution().executedPlan().toString()
