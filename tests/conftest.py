import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from chatloom.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = build_session(
        "tests",
        master="local[4]",
        spark__sql__shuffle__partitions="4",
        spark__ui__enabled="false",
        spark__ui__showConsoleProgress="false",
        spark__driver__memory="6g",
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def chat(spark):
    """Rows of (msg_id, seconds, channel, username, message) as a raw chat table."""

    def build(rows):
        rows = [(row[0], float(row[1]), *row[2:]) for row in rows]
        frame = spark.createDataFrame(rows, "msg_id bigint, s double, channel string, username string, message string")
        return frame.selectExpr(
            "msg_id", "timestamp_micros(cast(s * 1000000 as bigint)) as published_datetime", "channel", "username",
            "concat('#', channel) as channel_2", "message",
        )

    return build
