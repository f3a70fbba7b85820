"""The same results in SQL, over the views ``events``, ``documents`` and ``conversations``."""

from __future__ import annotations

from . import views

START, END = "TIMESTAMP '2024-01-10 00:00:00'", "TIMESTAMP '2024-01-20 12:00:00'"
TOKEN = r"[\p{L}\p{N}_]{2,}"

_VIEWS = {
    "log_files": views.LOG_FILES,
    "log_entries": views.LOG_ENTRIES,
    "raw_logs": views.RAW_LOGS,
    "brief_logs": views.BRIEF_LOGS,
    "alias_logs": views.ALIAS_LOGS,
    "time_logs": views.TIME_LOGS,
    "field_logs": views.FIELD_LOGS,
}


def _features(minutes: int, where: str) -> str:
    size = minutes * 60_000_000
    start = f"make_timestamp(epoch_us(timestamp) // {size} * {size})"
    return f"""
SELECT {start} AS window_start, {start} + INTERVAL {minutes} MINUTE AS window_end,
  count(*) AS total_count,
  count(*) FILTER (WHERE level = 'ERROR') AS error_count,
  count(*) FILTER (WHERE level IN ('WARN', 'WARNING')) AS warn_count,
  count(*) FILTER (WHERE level = 'INFO') AS info_count,
  count(*) FILTER (WHERE level = 'DEBUG') AS debug_count,
  CAST(printf('%.4f', count(*) FILTER (WHERE level = 'ERROR') / count(*)) AS DOUBLE) AS error_rate,
  count(DISTINCT service) AS unique_services
FROM log_entries WHERE timestamp IS NOT NULL AND {where} GROUP BY 1, 2"""


_IN_RANGE = f"timestamp >= {START} AND timestamp <= {END}"
_DERIVED = {
    "hourly": ("log_entries", _features(60, _IN_RANGE)),
    "errors": (
        "log_entries",
        """
SELECT message, timestamp FROM log_entries
WHERE timestamp IS NOT NULL AND (level = 'ERROR' OR parse_status = 'failed')
  AND message IS NOT NULL AND message <> ''""",
    ),
    "folded": (
        "errors",
        """
SELECT message, count(*) AS copies, min(timestamp) AS first_seen, max(timestamp) AS last_seen
FROM errors GROUP BY 1""",
    ),
    # "for" is the only stop word in these messages.
    "occurrences": (
        "folded",
        f"""
SELECT message, copies, term FROM (
  SELECT message, copies, unnest(regexp_extract_all(lower(message), '{TOKEN}')) AS term FROM folded)
WHERE term <> 'for'""",
    ),
    "terms": (
        "occurrences",
        """
SELECT term, CAST(sum(copies) AS BIGINT) AS df, CAST(sum(copies * n) AS BIGINT) AS tf
FROM (SELECT message, copies, term, count(*) AS n FROM occurrences GROUP BY ALL) GROUP BY 1""",
    ),
    "vocab": (
        "terms",
        """
SELECT term, ln((1 + n) / (1 + df)) + 1 AS idf FROM terms, (SELECT count(*) AS n FROM errors)
WHERE df <= 0.95 * n ORDER BY tf DESC, term LIMIT 1000""",
    ),
    "weights": (
        "vocab",
        """
SELECT message, term, raw / sqrt(sum(raw * raw) OVER (PARTITION BY message)) AS weight FROM (
  SELECT message, term, count(*) * any_value(idf) AS raw FROM occurrences JOIN vocab USING (term) GROUP BY 1, 2)""",
    ),
    "labelled": ("weights", "SELECT *, CAST(length(message) % 4 AS INT) AS label FROM folded"),
    "centers": (
        "labelled",
        """
SELECT label, term, sum(weight * copies) / any_value(size) AS weight
FROM weights JOIN labelled USING (message)
JOIN (SELECT label, sum(copies) AS size FROM labelled GROUP BY 1) USING (label) GROUP BY 1, 2""",
    ),
    "clusters": (
        "centers",
        """
SELECT l.label, arg_min(l.message, struct_pack(d := round(d.distance, 9), m := l.message))
    AS example_message,
  CAST(sum(l.copies) AS BIGINT) AS count, any_value(k.keywords) AS keywords,
  min(l.first_seen) AS first_seen, max(l.last_seen) AS last_seen
FROM labelled l
JOIN (SELECT message, sqrt(greatest(0, any_value(x2) + any_value(c2) - 2 * sum(w.weight * c.weight))) AS distance
      FROM (SELECT *, sum(weight * weight) OVER (PARTITION BY message) AS x2 FROM weights) w
      JOIN labelled l USING (message)
      JOIN (SELECT *, sum(weight * weight) OVER (PARTITION BY label) AS c2 FROM centers) c USING (label, term)
      GROUP BY 1) d USING (message)
LEFT JOIN (SELECT label, string_agg(term, ', ' ORDER BY place) AS keywords FROM (
      SELECT label, term, row_number() OVER (PARTITION BY label ORDER BY round(weight, 9) DESC, term) AS place
      FROM centers WHERE weight > 0) WHERE place <= 5 GROUP BY 1) k USING (label)
GROUP BY 1""",
    ),
}


_MEASURES = ("total_count", "error_count", "error_rate", "unique_services", "warn_count")
_DERIVED |= {
    "nodes": (
        "hourly",
        f"""
SELECT tree, node, CASE WHEN node < 7 THEN place ELSE -1 END AS feature,
  low[place + 1] + part * (high[place + 1] - low[place + 1]) AS cut, 2 * node + 1 AS child, 3 + node % 4 * 0.75::DOUBLE AS value
FROM (SELECT id // 15 AS tree, id % 15 AS node, (id // 15 + id % 15) % 5 AS place,
        ((id // 15 * 7 + id % 15 * 3) % 10 + 0.5::DOUBLE) / 10 AS part FROM (SELECT unnest(range(150)) AS id)),
  (SELECT [{", ".join(f"min({m})::DOUBLE" for m in _MEASURES)}] AS low, [{", ".join(f"max({m})::DOUBLE" for m in _MEASURES)}] AS high
   FROM hourly)""",
    ),
    "steps": (
        "nodes",
        f"""
SELECT window_start, tree, 0::BIGINT AS node FROM hourly, (SELECT DISTINCT tree FROM nodes)
UNION ALL
SELECT s.window_start, s.tree, n.child + CASE WHEN [{", ".join(f"h.{m}::DOUBLE" for m in _MEASURES)}][n.feature + 1] > n.cut THEN 1 ELSE 0 END
FROM steps s JOIN nodes n USING (tree, node) JOIN hourly h ON h.window_start = s.window_start WHERE n.feature >= 0""",
    ),
    "forest": (
        "steps",
        """
SELECT window_start, round(-power(2, -sum(value) / (10 * any_value(scale))), 9) AS score_samples
FROM steps JOIN nodes USING (tree, node),
  (SELECT 2 * (ln(least(256, count(*)) - 1) + 0.5772156649015329) - 2 * (least(256, count(*)) - 1) / least(256, count(*)) AS scale FROM hourly)
WHERE feature < 0 GROUP BY 1""",
    ),
}


def _recursive(names: list[str], select: str) -> str:
    return _with(names, select).replace("WITH ", "WITH RECURSIVE ", 1)


def _with(names: list[str], select: str) -> str:
    """``select`` under the views it needs, in the order they build on each other."""
    order: list[str] = []

    def need(name: str) -> None:
        if name in order:
            return
        if name in _DERIVED:
            need(_DERIVED[name][0])
        order.append(name)

    for name in names:
        need(name)
    parts = [
        f"{n} AS ({views.duckdb_view(_VIEWS[n]) if n in _VIEWS else _DERIVED[n][1]})" for n in order
    ]
    return f"WITH {', '.join(parts)} {select}"


# The level of a line follows from the event type; what the formats keep of the time does, too.
_EXPECTED = """
SELECT r.event_id, r.log_file_id, r.line_number,
  CASE r.event_id % 6 WHEN 3 THEN date_trunc('second', ts) + INTERVAL 5 HOUR WHEN 5 THEN NULL ELSE ts END AS timestamp,
  CASE WHEN r.event_id % 6 IN (0, 1, 4) THEN upper(event_type)
       WHEN r.event_id % 6 = 2 THEN CASE event_type WHEN 'error' THEN 'ERROR' WHEN 'purchase' THEN 'WARNING'
            WHEN 'click' THEN 'INFO' WHEN 'signup' THEN 'ERROR' ELSE 'DEBUG' END END AS level,
  CASE WHEN r.event_id % 6 IN (0, 1, 4) THEN 'svc-' || (user_id % 12)
       WHEN r.event_id % 6 = 2 THEN 'Tag' || (user_id % 12) END AS service,
  CASE WHEN r.event_id % 6 IN (0, 1, 2, 4) THEN 'request by user ' || user_id
       WHEN r.event_id % 6 = 3 THEN 'GET /item/' || user_id || ' HTTP/1.1 -> ' ||
            CASE event_type WHEN 'error' THEN '500' ELSE '200' END END AS message,
  r.raw_line,
  CASE WHEN r.event_id % 6 = 5 THEN 'failed' ELSE 'parsed' END AS parse_status,
  CASE WHEN r.event_id % 6 = 5 THEN 'No parser matched' END AS parse_error,
  CAST(CASE r.event_id % 6 WHEN 2 THEN 0.9 WHEN 3 THEN 0.85 WHEN 5 THEN 0.0 ELSE 0.95 END AS DOUBLE) AS parse_confidence,
  CASE r.event_id % 6 WHEN 0 THEN 'app_v1' WHEN 1 THEN 'app_v1' WHEN 2 THEN 'android_v1' WHEN 3 THEN 'access_v1'
       WHEN 4 THEN 'json_v1' END AS parser_name
FROM raw_logs r JOIN events USING (event_id)
"""
_VIEWS_EXPECTED = _with(["raw_logs"], _EXPECTED)


def _parsed_by(name: str) -> str:
    return (
        "SELECT event_id, timestamp, level, service, message, parse_status, parse_confidence "
        f"FROM ({_VIEWS_EXPECTED}) WHERE parser_name = '{name}'"
    )


_STORED = f"""
SELECT event_id // 5000 AS chunk, event_id % 5000 + 1 AS line_number, timestamp, level, service, message, raw_line,
  parse_status, parser_name, 'processed' AS file_status,
  count(*) OVER (PARTITION BY event_id // 5000) AS total_lines,
  count(*) FILTER (WHERE parse_status = 'failed') OVER (PARTITION BY event_id // 5000) AS failed_lines
FROM ({_VIEWS_EXPECTED})
"""

# The first file is replaced by its lines of even events.
_CHANGED = f"""
SELECT event_id // 5000 AS chunk, row_number() OVER (PARTITION BY event_id // 5000 ORDER BY event_id) AS line_number,
  timestamp, level, service, message, raw_line, parse_status, parser_name, 'processed' AS file_status,
  count(*) OVER (PARTITION BY event_id // 5000) AS total_lines,
  count(*) FILTER (WHERE parse_status = 'failed') OVER (PARTITION BY event_id // 5000) AS failed_lines
FROM ({_VIEWS_EXPECTED}) WHERE event_id >= 5000 OR event_id % 2 = 0
"""

_FILE_COLUMNS = "id, filename, source, environment, status, uploaded_at"
_ENTRY_COLUMNS = "log_file_id, line_number, timestamp, level, service, message, parse_status"
_FILTERED = (
    f"FROM log_entries JOIN (SELECT id AS file_id, environment FROM log_files) ON log_file_id = file_id WHERE {_IN_RANGE} "
    "AND level = 'ERROR' AND environment = 'prod' AND message ILIKE '%USER%'"
)
_SCORED = "SELECT window_start, window_end, -error_rate AS score, error_rate AS anomaly_score FROM hourly"


def _entries(where: str) -> str:
    return _with(["log_entries"], f"SELECT * FROM log_entries WHERE {where}")


def _corpus(key: str, table: str) -> str:
    """Occurrences ``(key, term)`` of a text table, without stop words."""
    return f"SELECT {key} AS key, unnest(regexp_extract_all(lower(text), '{TOKEN}')) AS term FROM {table}"


ORACLE: dict[str, str] = {
    "scan_raw": _with(["raw_logs"], "SELECT event_id // 5000 AS chunk, raw_line FROM raw_logs"),
    "refused_files": _with(
        ["raw_logs"],
        """
SELECT DISTINCT origin, event_id // 5000 AS chunk, 'refused' AS status, 'larger than 0 MB' AS error
FROM raw_logs, (VALUES ('batch'), ('stream')) o(origin)""",
    ),
    "line_numbers": _with(
        ["raw_logs"], "SELECT event_id // 5000 AS chunk, event_id % 5000 + 1 AS line_number, raw_line FROM raw_logs"
    ),
    "line_numbers_resplit": _with(
        ["raw_logs"], "SELECT event_id // 5000 AS chunk, event_id % 5000 + 1 AS line_number, raw_line FROM raw_logs"
    ),
    "admit_files": _with(
        ["log_files"],
        r"""SELECT id, filename, size_bytes,
  regexp_matches(lower(filename), '\.(log|txt|json)$') AND size_bytes <= 200 * 1048576 AS admitted FROM log_files""",
    ),
    "log_files": _with(
        ["log_files"],
        """SELECT id, filename, source, CASE WHEN source IS NOT NULL THEN environment END AS environment,
  CASE WHEN source IS NOT NULL THEN 'text' END AS log_type, 'uploaded' AS status, uploaded_at FROM log_files""",
    ),
    "idempotent_new_rows": _with(
        ["log_entries"],
        """SELECT log_file_id, line_number, message FROM log_entries e WHERE NOT EXISTS (
  SELECT 1 FROM log_entries s WHERE s.level = 'ERROR'
    AND s.log_file_id = e.log_file_id AND s.line_number = e.line_number)""",
    ),
    "file_summary": _with(
        ["log_entries"],
        """SELECT log_file_id, count(*) AS total_lines, count(*) FILTER (WHERE parse_status <> 'failed') AS parsed_lines,
  count(*) FILTER (WHERE parse_status = 'failed') AS failed_lines FROM log_entries GROUP BY 1""",
    ),
    "replace_range": _with(
        ["hourly"],
        f"""SELECT window_start, window_end, total_count, 'old' AS origin FROM ({_features(60, 'true')})
WHERE NOT (window_start >= {START} AND window_end <= {END})
UNION ALL SELECT window_start, window_end, total_count, 'new' FROM hourly""",
    ),
    "replaced_clusters": _with(["clusters"], "SELECT * FROM clusters"),
    "analytics_totals": _with(
        ["errors"],
        f"""SELECT 'completed' AS status, true AS anomalies_agree, true AS clusters_agree, 0::BIGINT AS outside,
  count(*) AS messages, min(timestamp) AS first_seen FROM errors WHERE {_IN_RANGE}""",
    ),
    "run_record": _with(
        ["log_entries"],
        """SELECT 'manual' AS trigger, 'failed' AS status, count(*) AS anomalies_detected,
  CAST(3000 AS BIGINT) AS error_length, true AS finished FROM log_entries WHERE level = 'ERROR'""",
    ),
    "ingest_batch": _STORED,
    "stream_ingest": _STORED,
    "ingest_changed_file": _CHANGED,
    "lossy_lines": "SELECT event_type || chr(65533) || ' é ' || chr(65533) || ' ' || event_id AS raw_line FROM events",
    "normalize_all": _VIEWS_EXPECTED,
    "normalize_json": _parsed_by("json_v1"),
    "normalize_app": _parsed_by("app_v1"),
    "normalize_android": _parsed_by("android_v1"),
    "normalize_access": _parsed_by("access_v1"),
    "failed_lines": f"""SELECT event_id, raw_line, parse_error, parse_confidence, parser_name
FROM ({_VIEWS_EXPECTED}) WHERE parse_status = 'failed'""",
    "normalize_android_brief": """
SELECT event_id, CAST(NULL AS TIMESTAMP) AS timestamp,
  CASE event_type WHEN 'error' THEN 'ERROR' WHEN 'purchase' THEN 'WARNING' WHEN 'click' THEN 'INFO'
       WHEN 'signup' THEN 'ERROR' ELSE 'DEBUG' END AS level,
  'Tag' || (user_id % 12) AS service, 'request (' || props || ')' AS message,
  'partial' AS parse_status, CAST(0.6 AS DOUBLE) AS parse_confidence, 'android_v1' AS parser_name FROM events""",
    "json_alias": """
SELECT event_id,
  CASE event_id % 5 WHEN 0 THEN upper(event_type) WHEN 1 THEN upper(event_type) WHEN 4 THEN upper(event_type) END AS level,
  CASE event_id % 5 WHEN 0 THEN 'a' WHEN 3 THEN 'p' END AS service,
  CASE event_id % 5 WHEN 0 THEN 't' || user_id WHEN 1 THEN 'l' || user_id WHEN 2 THEN CAST(user_id AS VARCHAR)
       WHEN 3 THEN 'first ' || event_type END AS message FROM events""",
    "json_ts": """
SELECT event_id, CASE event_id % 6 WHEN 0 THEN ts WHEN 1 THEN ts
    WHEN 2 THEN date_trunc('second', ts) - INTERVAL 330 MINUTE
    WHEN 3 THEN date_trunc('second', ts) + INTERVAL 1 HOUR
    WHEN 4 THEN make_timestamp((1700000000 + event_id) * 1000000) END AS timestamp,
  CAST(CASE WHEN event_id % 6 = 5 THEN 0.5 ELSE 0.7 END AS DOUBLE) AS parse_confidence FROM events""",
    "json_confidence": """
SELECT event_id, CASE WHEN found = 4 THEN 'parsed' ELSE 'partial' END AS parse_status,
  CAST(CASE found WHEN 4 THEN 0.95 WHEN 0 THEN 0.5 ELSE 0.7 END AS DOUBLE) AS parse_confidence
FROM (SELECT event_id, CAST(event_id % 2 = 0 AS INT) + CAST(event_id % 3 = 0 AS INT) + CAST(event_id % 5 = 0 AS INT)
        + CAST(event_id % 7 = 0 AS INT) AS found FROM events)""",
    "filter_time": _entries(_IN_RANGE),
    "filter_default_range": _entries(f"timestamp >= {END} - INTERVAL 24 HOUR AND timestamp <= {END}"),
    "filter_level": _entries("level = 'WARN'"),
    "filter_service": _entries("service = 'svc-7'"),
    "filter_source_env": _with(
        ["log_entries", "log_files"],
        """SELECT e.* FROM log_entries e JOIN log_files f ON e.log_file_id = f.id
WHERE f.source = 'app' AND f.environment = 'staging'""",
    ),
    "filter_keyword": _entries("message ILIKE '%TIME_ut for%code 1%'"),
    "filter_file": _entries("log_file_id = 3"),
    "entries_page": _with(
        ["log_entries", "log_files"],
        f"""SELECT log_file_id, line_number, timestamp, level, service, message, parse_status {_FILTERED}
ORDER BY timestamp DESC NULLS LAST, log_file_id, line_number LIMIT 20 OFFSET 10""",
    ),
    "entries_far_page": _with(
        ["log_entries"],
        f"""SELECT {_ENTRY_COLUMNS} FROM (
  SELECT *, row_number() OVER (ORDER BY timestamp DESC NULLS LAST, log_file_id, line_number) - 1 AS place,
    count(*) OVER () AS n FROM log_entries)
WHERE place >= n - n // 20 AND place < n - n // 20 + 100""",
    ),
    "stored_far_page": _with(
        ["log_entries"],
        f"""SELECT {_ENTRY_COLUMNS} FROM (
  SELECT *, row_number() OVER (ORDER BY timestamp DESC NULLS LAST, log_file_id, line_number) - 1 AS place,
    count(*) OVER () AS n FROM log_entries)
WHERE place >= n - n // 20 AND place < n - n // 20 + 100""",
    ),
    "entries_total": _with(["log_entries", "log_files"], f"SELECT count(*) AS total {_FILTERED}"),
    "page_count": _with(
        ["log_entries"],
        """SELECT service, CAST(greatest(ceil(count(*) / 50), 1) AS BIGINT) AS pages
FROM log_entries WHERE service IS NOT NULL GROUP BY 1""",
    ),
    "files_page": _with(
        ["log_files"],
        f"""SELECT {_FILE_COLUMNS} FROM log_files WHERE status = 'processed'
ORDER BY uploaded_at DESC, id LIMIT 4 OFFSET 1""",
    ),
    "file_by_id": _with(["log_files"], f"SELECT {_FILE_COLUMNS} FROM log_files WHERE id = 5"),
    "anomalies_page": _with(
        ["hourly"],
        f"""{_SCORED} WHERE window_start >= TIMESTAMP '2024-01-12 00:00:00' AND window_end <= TIMESTAMP '2024-01-18 00:00:00'
ORDER BY score, window_start LIMIT 25 OFFSET 5""",
    ),
    "clusters_page": _with(["clusters"], "SELECT * FROM clusters ORDER BY count DESC, label LIMIT 2 OFFSET 1"),
    "error_messages": _entries(
        f"{_IN_RANGE} AND (level = 'ERROR' OR parse_status = 'failed') AND message IS NOT NULL AND message <> ''"
    ),
    "anomaly_drilldown": _with(
        ["hourly"],
        """SELECT window_start, id, timestamp, level, service FROM hourly
JOIN log_entries ON timestamp >= window_start AND timestamp < window_end WHERE error_rate >= 0.25""",
    ),
    "cascade_semi": _with(
        ["log_entries", "log_files"],
        """SELECT id, log_file_id, line_number FROM log_entries
WHERE log_file_id IN (SELECT id FROM log_files WHERE status = 'processed')""",
    ),
    "stats_totals": _with(
        ["log_entries", "log_files"],
        """SELECT (SELECT count(*) FROM log_entries) AS total_entries, (SELECT count(*) FROM log_files) AS total_files""",
    ),
    "level_breakdown": _with(
        ["log_entries"], "SELECT level, count(*) AS count FROM log_entries WHERE level IS NOT NULL GROUP BY 1"
    ),
    "top_services": _with(
        ["log_entries"],
        """SELECT service, count(*) AS count FROM log_entries WHERE service IS NOT NULL
GROUP BY 1 ORDER BY count DESC, service LIMIT 10""",
    ),
    "stats_summary": _with(
        ["log_entries", "log_files"],
        """SELECT 'total' AS section, 'entries' AS name, count(*) AS count FROM log_entries
UNION ALL SELECT 'total', 'files', count(*) FROM log_files
UNION ALL SELECT 'level', level, count(*) FROM log_entries WHERE level IS NOT NULL GROUP BY 2
UNION ALL SELECT * FROM (SELECT 'service', service, count(*) AS n FROM log_entries WHERE service IS NOT NULL
  GROUP BY 2 ORDER BY n DESC, service LIMIT 10)""",
    ),
    "window_features": _with(["log_entries"], _features(2, _IN_RANGE)),
    "window_features_hourly": _with(["hourly"], "SELECT * FROM hourly"),
    "log_timeline": _with(
        ["log_entries"],
        """, dated AS (SELECT level, epoch_ms(timestamp) AS ms FROM log_entries WHERE timestamp IS NOT NULL),
bounds AS (SELECT min(ms) AS first, greatest(max(ms) - min(ms), 1) / least(count(*), 20) AS size,
  least(count(*), 20) AS buckets FROM dated),
counted AS (SELECT CAST(least(floor((ms - first) / size), buckets - 1) AS INT) AS bucket, count(*) AS total,
  count(*) FILTER (WHERE level = 'ERROR') AS errors,
  count(*) FILTER (WHERE level IN ('WARN', 'WARNING')) AS warnings FROM dated, bounds GROUP BY 1)
SELECT CAST(i AS INT) AS bucket, first + i * size AS start_ms, coalesce(total, 0) AS total,
  coalesce(errors, 0) AS errors, coalesce(warnings, 0) AS warnings
FROM (SELECT unnest(range(buckets)) AS i, first, size FROM bounds) LEFT JOIN counted ON i = bucket""",
    ),
    "score_histogram": _with(
        ["hourly"],
        """, edges AS (SELECT i AS bin, i / 10 AS low, CASE WHEN i = 9 THEN 1.01 ELSE (i + 1) / 10 END AS high
  FROM range(10) r(i))
SELECT CAST(bin AS INT) AS bin, printf('%d-%d%%', bin * 10, bin * 10 + 10) AS label, count(window_start) AS windows,
  round(count(window_start) / (SELECT count(*) FROM hourly) * 100, 1) AS share_pct
FROM edges LEFT JOIN hourly ON error_rate >= low AND error_rate < high GROUP BY 1, 2""",
    ),
    "forest_scores": _recursive(["forest"], "SELECT * FROM forest"),
    "forest_anomalies": _recursive(
        ["forest"],
        """SELECT window_start, window_end, round(score_samples - cut, 8) AS score, round(-score_samples, 8) AS anomaly_score,
  total_count, error_rate
FROM forest JOIN hourly USING (window_start), (SELECT quantile_cont(score_samples, 0.1) AS cut FROM forest)
WHERE score_samples < cut""",
    ),
    "cluster_nearest": _with(
        ["weights"],
        "SELECT message, copies, true AS nearest FROM folded",
    ),
    "anomaly_cut": """
SELECT event_id, round(value - cut, 6) AS score FROM events, (SELECT quantile_cont(value, 0.1) AS cut FROM events)
WHERE value < cut""",
    "anomaly_description": _with(
        ["hourly"],
        """SELECT window_start, 'Anomalous window: ' || concat_ws(', ', total_count || ' events in window',
  CASE WHEN error_rate > 0 THEN printf('%.1f%% error rate', error_rate * 100) END,
  CASE WHEN error_count > 0 THEN error_count || ' errors' END, unique_services || ' services') AS description
FROM hourly""",
    ),
    "term_df": _with(["terms"], "SELECT * FROM terms"),
    "term_df_documents": f"""
SELECT term, count(*) AS df, CAST(sum(n) AS BIGINT) AS tf
FROM (SELECT key, term, count(*) AS n FROM ({_corpus('doc_id', 'documents')}) GROUP BY 1, 2) GROUP BY 1""",
    "tfidf_weights": _with(["weights"], "SELECT message, term, round(weight, 9) AS weight FROM weights"),
    "tfidf_conversations": f"""
WITH occurrences AS ({_corpus("conv_id || '-' || turn", 'conversations')}),
counted AS (SELECT key, term, count(*) AS n FROM occurrences GROUP BY 1, 2),
terms AS (SELECT term, count(*) AS df, sum(n) AS tf FROM counted GROUP BY 1),
vocab AS (SELECT term, ln((1 + n) / (1 + df)) + 1 AS idf FROM terms, (SELECT count(*) AS n FROM conversations)
  WHERE df <= 0.95 * n ORDER BY tf DESC, term LIMIT 1000)
SELECT key, term, round(n * idf / sqrt(sum(n * idf * n * idf) OVER (PARTITION BY key)), 9) AS weight
FROM counted JOIN vocab USING (term)""",
    "cluster_k": _with(
        ["log_entries"],
        """SELECT service, count(*) AS count, CAST(greatest(least(20, greatest(2, count(*) // 5), count(*)), 2) AS INT) AS k
FROM log_entries WHERE timestamp IS NOT NULL AND (level = 'ERROR' OR parse_status = 'failed')
  AND message IS NOT NULL AND message <> '' AND service IS NOT NULL GROUP BY 1""",
    ),
    "cluster_table": _with(["clusters"], "SELECT * FROM clusters"),
    "cluster_keywords": _with(
        ["clusters"],
        """SELECT label, CAST(generate_subscripts(string_split(keywords, ', '), 1) - 1 AS INT) AS place,
  unnest(string_split(keywords, ', ')) AS keyword FROM clusters""",
    ),
    "headline": _with(
        ["log_entries", "log_files"],
        """SELECT count(*) AS total_entries, count(*) FILTER (WHERE level = 'ERROR') AS errors,
  count(*) FILTER (WHERE level IN ('WARN', 'WARNING')) AS warnings, (SELECT count(*) FROM log_files) AS total_files
FROM log_entries""",
    ),
    "level_share": _with(
        ["log_entries"],
        """SELECT level, count(*) AS count, round(count(*) / sum(count(*)) OVER () * 100, 1) AS share_pct
FROM log_entries WHERE level IS NOT NULL GROUP BY 1""",
    ),
    "anomaly_timeline": _with(
        ["hourly"],
        """SELECT window_start, window_end, error_rate AS score,
  CASE WHEN error_rate > 0.7 THEN 'high' WHEN error_rate > 0.4 THEN 'moderate' ELSE 'normal' END AS band,
  CAST(floor(error_rate * 100 + 0.5) AS INT) AS score_pct,
  CASE WHEN floor(error_rate * 100 + 0.5) > 70 THEN 'high' WHEN floor(error_rate * 100 + 0.5) > 40 THEN 'moderate'
       ELSE 'normal' END AS table_band FROM hourly""",
    ),
    "anomaly_rate_volume": _with(
        ["hourly"], "SELECT window_start, error_rate * 100 AS error_rate_pct, total_count FROM hourly"
    ),
    "log_composition": _with(
        ["hourly"],
        "SELECT window_start, error_count, warn_count, info_count, debug_count FROM hourly WHERE error_rate > 0.3",
    ),
    "service_activity": _with(["hourly"], "SELECT window_start, unique_services, warn_count FROM hourly"),
    "top_clusters": _with(
        ["clusters"],
        """SELECT label, count, CASE WHEN length(keywords) > 30 THEN substr(keywords, 1, 30) || '...' ELSE keywords END AS title,
  CASE WHEN length(example_message) > 80 THEN substr(example_message, 1, 80) || '...' ELSE example_message END AS message
FROM clusters ORDER BY count DESC, label LIMIT 10""",
    ),
    # A window is out once the watermark, ten minutes behind the last entry, has passed its end.
    "stream_window_features": _with(
        ["log_entries"],
        f"""SELECT * FROM ({_features(60, 'true')})
WHERE window_end <= (SELECT max(timestamp) - INTERVAL 10 MINUTE FROM log_entries)""",
    ),
    "stream_late_windows": _with(
        ["log_entries"],
        f"""SELECT * FROM ({_features(60, 'true')}) WHERE window_start IN (
  SELECT make_timestamp(epoch_us(timestamp) // 3600000000 * 3600000000) AS start FROM log_entries
  WHERE id % 50 = 0 AND timestamp IS NOT NULL
    AND start + INTERVAL 1 HOUR <= (SELECT max(timestamp) - INTERVAL 10 MINUTE FROM log_entries WHERE id % 50 <> 0))
UNION ALL
SELECT * FROM ({_features(60, 'id % 50 <> 0')}) WHERE window_start NOT IN (
  SELECT make_timestamp(epoch_us(timestamp) // 3600000000 * 3600000000) AS start FROM log_entries
  WHERE id % 50 = 0 AND timestamp IS NOT NULL
    AND start + INTERVAL 1 HOUR <= (SELECT max(timestamp) - INTERVAL 10 MINUTE FROM log_entries WHERE id % 50 <> 0))""",
    ),
}
