import random

import pytest
from conftest import at, by_time
from pyspark.sql import functions as F

from depthframe.functions import book
from depthframe.operators.features import add_features
from depthframe.operators.quality import daily_quality
from depthframe.operators.sessions import WHOLE, Slicing, choose_slicing
from depthframe.operators.timeline import clean_sessions, duplicate_counts
from depthframe.schema import CLEAN_COLUMNS, DERIVED_FEATURES, RAW_COLUMNS

FEED = [
    ("09:30:00", "AM", 9.99, 10.01),
    ("09:30:00", "AM", 10.00, 10.02),
    ("09:30:09", "AM", None, None),
    ("13:00:00", "PM", 10.09, None),
]


@pytest.mark.parametrize("slicing", [WHOLE, Slicing(3), Slicing(1)])
def test_grid_and_bounded_fill(snapshots, slicing):
    line = clean_sessions(snapshots(FEED), slicing=slicing)
    assert line.columns[: len(CLEAN_COLUMNS)] == CLEAN_COLUMNS
    am = line.filter("session_id = 'AM'")
    assert by_time(am, "BIDp1") == [10.0, 10.0, 10.0, None]
    assert by_time(am, "is_ffilled") == [False, True, True, False]
    assert by_time(am, "book_valid") == [True, True, True, False]
    assert by_time(am, "row_no") == [0, 1, 2, 3]
    assert by_time(am, "snapshot_gap_seconds") == [0.0, None, None, 9.0]
    assert by_time(am, "staleness_seconds") == [0.0, 3.0, 6.0, 9.0]
    pm = line.filter("session_id = 'PM'")
    assert by_time(pm, "mid_price", "book_valid") == [(10.09, True)]
    report = daily_quality(line).first()
    assert (report["row_count"], report["duplicate_count"]) == (5, 1)
    assert (report["max_gap"], report["one_side_missing_count"]) == (9.0, 1)


def test_off_grid_rows_stay_and_staleness_truncates(snapshots):
    feed = [("09:30:00", "AM", 10.0, 10.02), ("09:30:06.900", "AM", None, None)]
    line = clean_sessions(snapshots(feed))
    assert by_time(line, "timestamp") == [
        at("09:30:00"), at("09:30:03"), at("09:30:06"), at("09:30:06.900")
    ]
    # 6.9 s counts as 6 whole seconds and is still filled.
    assert by_time(line, "is_ffilled") == [False, True, True, True]
    assert by_time(line, "seconds")[-1] == "09:30:06.9"


def test_duplicates(snapshots):
    got = {r["session_id"]: r["duplicate_count"] for r in duplicate_counts(snapshots(FEED)).collect()}
    assert got == {"AM": 1, "PM": 0}


@pytest.mark.parametrize(
    ("bid", "ask", "mid", "valid"),
    [
        (9.9, 10.1, 10.0, True),
        (10.0, 10.0, 10.0, True),
        (10.1, 10.0, None, False),
        (None, 10.0, 10.0, True),
        (9.0, None, 9.0, True),
        (None, None, None, False),
        (0.0, 10.0, 10.0, True),
    ],
)
def test_mid_and_validity(snapshots, bid, ask, mid, valid):
    row = snapshots([("09:30:00", "AM", bid, ask)])
    if bid == 0.0:
        row = row.withColumns({f"BIDp{i}": F.lit(0.0) for i in range(1, 6)})
    got = row.select(book.mid_price(), book.book_valid()).first()
    assert got[0] == (pytest.approx(mid) if mid is not None else None)
    assert got[1] is valid


def test_level_order_and_negative_size(snapshots):
    row = snapshots([("09:30:00", "AM", 9.9, 10.1)])
    bad = row.withColumn("ASKp3", F.lit(9.0))
    assert bad.select(book.level_order_violation()).first()[0] is True
    assert bad.select(book.book_valid()).first()[0] is False
    negative = row.withColumn("BIDs2", F.lit(-1.0))
    assert negative.select(book.book_valid()).first()[0] is False


def test_derived_features(snapshots):
    row = snapshots([("09:30:00", "AM", 9.99, 10.01)])
    row = row.withColumns(
        {f"ASKs{i}": F.lit(10.0 * i) for i in range(1, 6)}
        | {f"BIDs{i}": F.lit(20.0 * i) for i in range(1, 6)}
    )
    row = row.withColumns({"mid_price": book.mid_price(), "book_valid": book.book_valid()})
    got = add_features(row, DERIVED_FEATURES).first().asDict()
    want = {
        "spread": 0.02, "relative_spread": 0.002, "mid_price": 10.0, "microprice": 10.00333333,
        "l1_imbalance": 1 / 3, "l5_imbalance": 1 / 3, "depth_imbalance": 1 / 3, "bid_depth": 300.0,
        "ask_depth": 150.0, "price_slope": 0.01, "volume_slope": 30.0,
    }
    for name, value in want.items():
        assert got[name] == pytest.approx(value, rel=1e-6), name
    assert got["feature_valid"] is True


def test_features_off_finite_and_checked(snapshots):
    row = snapshots([("09:30:00", "AM", 9.99, 10.01)])
    row = row.withColumns({"mid_price": book.mid_price(), "book_valid": book.book_valid()})
    assert add_features(row).columns == [*row.columns, "feature_valid"]
    endless = row.withColumn("volume", F.lit(float("inf")))
    assert add_features(endless).first()["feature_valid"] is False
    for names in (["spread", "spread"], ["nothing"]):
        with pytest.raises(ValueError):
            add_features(row, names)
    with pytest.raises(ValueError, match="missing"):
        add_features(row.drop("ASKp1"))


def random_feed(seed, n=400):
    rng = random.Random(seed)
    rows, t = [], 34200.0
    for _ in range(n):
        t += rng.choice([0.0, 0.0, 0.5, 1.0, 3.0, 3.25, 11.0, 40.0])
        clock = f"{int(t // 3600):02d}:{int(t % 3600 // 60):02d}:{t % 60:09.6f}"
        kind = rng.random()
        mid = 10 + rng.random()
        bid = None if kind < 0.25 else mid - 0.01
        ask = None if kind < 0.15 or kind > 0.9 else mid + 0.01
        rows.append((clock, "AM", bid, ask))
    return rows


def test_slices_do_not_change_the_timeline(snapshots):
    feed = snapshots(random_feed(3)).cache()
    columns = ["timestamp", "row_no", "n_copies", "snapshot_gap_seconds", "staleness_seconds", "is_ffilled", "mid_price", *RAW_COLUMNS]
    whole = by_time(clean_sessions(feed), *columns)
    assert len(whole) > 400
    for seconds in (1, 60, 600):
        assert by_time(clean_sessions(feed, slicing=Slicing(seconds)), *columns) == whole


def test_choose_slicing_bounds_the_fullest_slice(snapshots):
    feed = snapshots([(f"09:{i // 60:02d}:{i % 60:02d}", "AM", 9.9, 10.0) for i in range(240)])
    assert choose_slicing(feed) == WHOLE
    assert choose_slicing(feed, max_rows=100) == Slicing(60)
    assert choose_slicing(feed, max_rows=20) == Slicing(10)
    assert choose_slicing(feed, max_rows=1) == Slicing(1)
