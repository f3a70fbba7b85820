"""Log tables derived from ``events``; the SQL runs on Spark and on DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

LOG_FILES = """
SELECT DISTINCT event_id % 8 AS id,
  concat('file-', CAST(event_id % 8 AS STRING),
         CASE event_id % 8 % 5 WHEN 0 THEN '.log' WHEN 1 THEN '.TXT' WHEN 2 THEN '.json'
                               WHEN 3 THEN '.exe' ELSE '' END) AS filename,
  CAST(event_id % 8 * 40 AS BIGINT) * 1048576 AS size_bytes,
  CASE event_id % 8 % 4 WHEN 0 THEN 'app' WHEN 1 THEN 'nginx' WHEN 2 THEN 'android' END AS source,
  CASE event_id % 8 % 3 WHEN 0 THEN 'prod' WHEN 1 THEN 'staging' ELSE 'dev' END AS environment,
  CASE WHEN event_id % 8 = 7 THEN 'failed' ELSE 'processed' END AS status,
  {make_timestamp}(2024, 2, 1, CAST(event_id % 8 AS INT), 0, 0) AS uploaded_at
FROM {events}
"""

LOG_ENTRIES = """
SELECT event_id AS id,
  event_id % 8 AS log_file_id,
  CAST(floor(event_id / 8.0) AS BIGINT) + 1 AS line_number,
  CASE WHEN event_id % 17 = 0 THEN NULL ELSE ts END AS timestamp,
  CASE WHEN event_id % 19 = 0 THEN NULL
       WHEN event_type = 'error' THEN 'ERROR' WHEN event_type = 'purchase' THEN 'WARN'
       WHEN event_type = 'signup' THEN 'WARNING' WHEN event_type = 'click' THEN 'INFO'
       ELSE 'DEBUG' END AS level,
  CASE WHEN event_id % 13 = 0 THEN NULL
       ELSE concat('svc-', CAST(user_id % 12 AS STRING)) END AS service,
  CASE WHEN event_id % 29 = 0 THEN NULL WHEN event_id % 31 = 0 THEN ''
       ELSE concat(CASE event_id % 5 WHEN 0 THEN 'Connection timeout' WHEN 1 THEN 'Payment refused'
                     WHEN 2 THEN 'Queue overflow' WHEN 3 THEN 'Access denied'
                     ELSE 'Checksum corrupt' END,
                   ' for user ', CAST(user_id AS STRING),
                   ' code ', regexp_extract(props, '[0-9]+', 0)) END AS message,
  CASE WHEN event_id % 29 = 0 THEN 'failed' WHEN event_id % 17 = 0 THEN 'partial'
       ELSE 'parsed' END AS parse_status
FROM {events}
"""

RAW_LOGS = """
SELECT event_id, event_id % 8 AS log_file_id,
  CAST(floor(event_id / 8.0) AS BIGINT) + 1 AS line_number,
  CASE event_id % 6
    WHEN 0 THEN concat(replace(CAST(ts AS STRING), ' ', 'T'), 'Z ', upper(event_type),
                       ' svc-', CAST(user_id % 12 AS STRING), ' request by user ', CAST(user_id AS STRING))
    WHEN 1 THEN concat(replace(CAST(ts AS STRING), '.', ','), ' ', upper(event_type),
                       ' svc-', CAST(user_id % 12 AS STRING), ' request by user ', CAST(user_id AS STRING))
    WHEN 2 THEN concat(substr(CAST(ts AS STRING), 6), '  2618  2640 ',
                       CASE event_type WHEN 'error' THEN 'E' WHEN 'purchase' THEN 'W' WHEN 'click' THEN 'I'
                            WHEN 'signup' THEN 'F' ELSE 'V' END,
                       ' Tag', CAST(user_id % 12 AS STRING), ': request by user ', CAST(user_id AS STRING))
    WHEN 3 THEN concat('10.0.0.', CAST(user_id % 256 AS STRING), ' - - [', substr(CAST(ts AS STRING), 9, 2),
                       '/Jan/', substr(CAST(ts AS STRING), 1, 4), ':', substr(CAST(ts AS STRING), 12, 8),
                       ' -0500] "GET /item/', CAST(user_id AS STRING), ' HTTP/1.1" ',
                       CASE event_type WHEN 'error' THEN '500' ELSE '200' END, ' 123')
    WHEN 4 THEN concat('{{"ts": "', replace(CAST(ts AS STRING), ' ', 'T'), 'Z", "severity": "', event_type,
                       '", "ctx": {{"app": "svc-', CAST(user_id % 12 AS STRING),
                       '"}}, "msg": "request by user ', CAST(user_id AS STRING), '"}}')
    ELSE concat('garbage ', CAST(event_id AS STRING)) END AS raw_line
FROM {events}
"""

# Android brief lines, one per event.
BRIEF_LOGS = """
SELECT event_id,
  concat(CASE event_type WHEN 'error' THEN 'A' WHEN 'purchase' THEN 'W' WHEN 'click' THEN 'I'
              WHEN 'signup' THEN 'E' ELSE 'D' END,
         '/Tag', CAST(user_id % 12 AS STRING), '( ', CAST(user_id AS STRING), '): request (', props, ')') AS raw_line
FROM {events}
"""

# JSON lines that differ in aliases, in a null under the first alias, and in nesting.
ALIAS_LOGS = """
SELECT event_id,
  CASE event_id % 5
    WHEN 0 THEN concat('{{"lvl": "', event_type, '", "text": "t', CAST(user_id AS STRING), '", "source": "a", "app": "b"}}')
    WHEN 1 THEN concat('{{"priority": "x", "level": "', event_type, '", "log": "l', CAST(user_id AS STRING), '"}}')
    WHEN 2 THEN concat('{{"level": null, "severity": "', event_type, '", "message": ', CAST(user_id AS STRING), '}}')
    WHEN 3 THEN concat('{{"a": {{"body": "first ', event_type, '"}}, "b": {{"msg": "second", "program": "p"}}, "n": ',
                       CAST(user_id AS STRING), '}}')
    ELSE concat('{{"level": "old", "level": "', event_type, '", "ctx": "',
                replace('{{~"msg~": ~"no~"}}', '~', chr(92)), '"}}') END AS raw_line
FROM {events}
"""

# JSON lines with one timestamp each, in different notations.
TIME_LOGS = """
SELECT event_id,
  concat('{{"ts": ',
    CASE event_id % 6
      WHEN 0 THEN concat('"', replace(CAST(ts AS STRING), ' ', 'T'), 'Z"')
      WHEN 1 THEN concat('"', CAST(ts AS STRING), '"')
      WHEN 2 THEN concat('"', substr(CAST(ts AS STRING), 1, 19), '+0530"')
      WHEN 3 THEN concat('"', replace(substr(CAST(ts AS STRING), 1, 10), '-', ''), 'T',
                         replace(substr(CAST(ts AS STRING), 12, 8), ':', ''), '-01:00"')
      WHEN 4 THEN CAST(1700000000 + event_id AS STRING)
      ELSE concat('"at ', CAST(event_id AS STRING), '"') END,
    '}}') AS raw_line
FROM {events}
"""

# JSON lines with one to four of the four fields, or none.
FIELD_LOGS = """
SELECT event_id,
  concat('{{"id": ', CAST(event_id AS STRING),
    CASE WHEN event_id % 2 = 0 THEN ', "ts": "2024-01-01T00:00:00Z"' ELSE '' END,
    CASE WHEN event_id % 3 = 0 THEN concat(', "level": "', event_type, '"') ELSE '' END,
    CASE WHEN event_id % 5 = 0 THEN concat(', "service": "svc-', CAST(user_id AS STRING), '"') ELSE '' END,
    CASE WHEN event_id % 7 = 0 THEN ', "msg": "m"' ELSE '' END, '}}') AS raw_line
FROM {events}
"""


def duckdb_view(sql: str) -> str:
    return sql.format(events="events", make_timestamp="make_timestamp")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet")


def view(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    return spark_view(spark, sql, events(spark, sf_dir))


def spark_view(spark: SparkSession, sql: str, source: DataFrame) -> DataFrame:
    source.createOrReplaceTempView("source_events")
    return spark.sql(sql.format(events="source_events", make_timestamp="make_timestamp_ntz"))
