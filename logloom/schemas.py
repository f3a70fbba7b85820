"""Table schemas and the column lists shown to readers."""

from __future__ import annotations

from pyspark.sql import DataFrame

LOG_FILES = (
    "id BIGINT, filename STRING, stored_path STRING, source STRING, environment STRING, "
    "log_type STRING, status STRING, total_lines BIGINT, parsed_lines BIGINT, failed_lines BIGINT, "
    "error STRING, uploaded_at TIMESTAMP_NTZ, processed_at TIMESTAMP_NTZ, ingest_id STRING, "
    "recorded_at TIMESTAMP_NTZ"
)
LOG_ENTRIES = (
    "log_file_id BIGINT, line_number BIGINT, timestamp TIMESTAMP_NTZ, level STRING, service STRING, "
    "message STRING, raw_line STRING, parse_status STRING, parse_error STRING, "
    "parse_confidence DOUBLE, parser_name STRING, created_at TIMESTAMP_NTZ, ingest_id STRING, event_date DATE"
)
WINDOW_MEASURES = [
    "total_count",
    "error_count",
    "warn_count",
    "info_count",
    "debug_count",
    "error_rate",
    "unique_services",
]
FEATURES_STRUCT = (
    "STRUCT<total_count: BIGINT, error_count: BIGINT, warn_count: BIGINT, info_count: BIGINT, "
    "debug_count: BIGINT, error_rate: DOUBLE, unique_services: BIGINT>"
)
ANOMALIES = (
    "window_start TIMESTAMP_NTZ, window_end TIMESTAMP_NTZ, score DOUBLE, anomaly_score DOUBLE, "
    f"features {FEATURES_STRUCT}, description STRING, pipeline_run_id STRING, created_at TIMESTAMP_NTZ"
)
ERROR_CLUSTERS = (
    "label INT, example_message STRING, count BIGINT, keywords STRING, first_seen TIMESTAMP_NTZ, "
    "last_seen TIMESTAMP_NTZ, pipeline_run_id STRING, created_at TIMESTAMP_NTZ"
)
PIPELINE_RUNS = (
    "id STRING, trigger STRING, status STRING, anomalies_detected BIGINT, clusters_created BIGINT, "
    "started_at TIMESTAMP_NTZ, finished_at TIMESTAMP_NTZ, duration_seconds DOUBLE, error STRING"
)
TABLES = {
    "log_files": LOG_FILES,
    "log_entries": LOG_ENTRIES,
    "anomalies": ANOMALIES,
    "error_clusters": ERROR_CLUSTERS,
    "pipeline_runs": PIPELINE_RUNS,
}



def columns(schema: str) -> list[str]:
    """Column names of a schema without nested commas."""
    return [field.split(" ")[0] for field in schema.split(", ")]


# What a reader of each table gets to see: stored_path and parse_error stay internal.
VIEWS = {
    "log_files": [
        "id", "filename", "source", "environment", "log_type", "status", "total_lines",
        "parsed_lines", "failed_lines", "error", "uploaded_at", "processed_at",
    ],
    "log_entries": [
        "log_file_id", "line_number", "timestamp", "level", "service", "message", "raw_line",
        "parse_status", "parse_confidence", "parser_name", "created_at",
    ],
    "anomalies": [
        "window_start", "window_end", "score", "anomaly_score", "features", "description",
        "pipeline_run_id", "created_at",
    ],
    "error_clusters": [
        "label", "example_message", "count", "keywords", "first_seen", "last_seen",
        "pipeline_run_id", "created_at",
    ],
    "pipeline_runs": [
        "id", "trigger", "status", "anomalies_detected", "clusters_created", "started_at",
        "finished_at", "duration_seconds", "error",
    ],
}


def project(df: DataFrame, view: str) -> DataFrame:
    """The visible columns of a table, in order; columns the frame lacks are left out."""
    present = set(df.columns)
    return df.select(*[c for c in VIEWS[view] if c in present])
