import sys
from datetime import datetime, timedelta
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from logloom.session import build_session  # noqa: E402

ENTRY_SCHEMA = (
    "log_file_id BIGINT, line_number BIGINT, timestamp TIMESTAMP_NTZ, level STRING, service STRING, "
    "message STRING, raw_line STRING, parse_status STRING, parse_confidence DOUBLE, parser_name STRING"
)


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = build_session(
        "tests",
        "local[4]",
        **{
            "spark.sql.shuffle.partitions": "4",
            "spark.ui.enabled": "false",
            "spark.driver.memory": "4g",
            "spark.checkpoint.dir": str(tmp_path_factory.mktemp("shared")),
        },
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def seeded(spark):
    """Ten entries one minute apart, over three services and four levels, of one file."""
    rows = [
        ("DEBUG", "search", "index warmed up"),
        ("INFO", "search", "query served"),
        ("ERROR", "search", "shard lost"),
        ("INFO", "cart", "basket opened"),
        ("WARN", "cart", "basket grows slowly"),
        ("ERROR", "cart", "basket not written, quota used up"),
        ("INFO", "mailer", "letter queued"),
        ("WARN", "mailer", "letter delayed"),
        ("ERROR", "mailer", "relay not reached"),
        ("INFO", "mailer", "queue drained"),
    ]
    start = datetime(2025, 3, 2, 8)
    data = [
        (1, i + 1, start + timedelta(minutes=i), level, service, message, message, "parsed", 0.95, "app_v1")
        for i, (level, service, message) in enumerate(rows)
    ]
    return spark.createDataFrame(data, ENTRY_SCHEMA)


@pytest.fixture(scope="session")
def seeded_files(spark):
    schema = "id BIGINT, filename STRING, source STRING, environment STRING, status STRING, uploaded_at TIMESTAMP_NTZ"
    return spark.createDataFrame(
        [(1, "shop.log", "nightly", "staging", "processed", datetime(2025, 3, 2))], schema
    )
