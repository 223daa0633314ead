import datetime as dt
import sys
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from depthframe.schema import KEY, LEVELS, RAW_COLUMNS  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.default.parallelism", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "4g")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    return session


SNAPSHOT_SCHEMA = (
    "ticker string, trade_date string, session_id string, timestamp timestamp_ntz, row_index bigint, "
    + ", ".join(f"`{c}` double" for c in RAW_COLUMNS)
)


def at(text, day="2026-01-05"):
    return dt.datetime.fromisoformat(f"{day} {text}")


def book_values(bid, ask, size=100.0):
    out = {"last": 10.0, "volume": 1000.0, "amount": 10000.0}
    for i in range(1, LEVELS + 1):
        out[f"ASKp{i}"] = None if ask is None else ask + 0.01 * (i - 1)
        out[f"ASKs{i}"] = None if ask is None else size
        out[f"BIDp{i}"] = None if bid is None else bid - 0.01 * (i - 1)
        out[f"BIDs{i}"] = None if bid is None else size
    return out


@pytest.fixture(scope="session")
def snapshots(spark):
    """Build session snapshots from (time, session, bid, ask) in file order."""

    def make(rows, ticker="A", day="2026-01-05"):
        data = []
        for i, (time, session, bid, ask) in enumerate(rows):
            v = book_values(bid, ask)
            data.append((ticker, day, session, at(time, day), i, *[v[c] for c in RAW_COLUMNS]))
        return spark.createDataFrame(data, SNAPSHOT_SCHEMA)

    return make


def by_time(df, *columns):
    rows = df.orderBy(*KEY, "timestamp").select(*columns).collect()
    return [r[0] if len(columns) == 1 else tuple(r) for r in rows]
