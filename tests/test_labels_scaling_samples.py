import datetime as dt
import math
import random

import numpy as np
import pytest
from conftest import at, by_time
from pyspark.sql import functions as F

from depthframe.operators import samples
from depthframe.operators.labels import add_labels
from depthframe.operators.normalize import TrailingScaler, causal_zscore, scaler_from_settings
from depthframe.operators.sessions import WHOLE, Slicing
from depthframe.schema import KEY

MIDS = "ticker string, trade_date string, session_id string, timestamp timestamp_ntz, mid_price double, book_valid boolean"


def mids(spark, rows):
    start = at("09:30:00")
    data = [("A", "2026-01-05", "AM", start + dt.timedelta(seconds=s), m, ok) for s, m, ok in rows]
    return spark.createDataFrame(data, MIDS)


@pytest.mark.parametrize("slicing", [WHOLE, Slicing(10), Slicing(1)])
def test_label_returns_and_tolerance(spark, slicing):
    frame = mids(spark, [(0, 40.0, True), (57, 41.0, True), (118, 38.5, True)])
    got = add_labels(frame, slicing=slicing)
    assert by_time(got, "future_mid") == [41.0, 38.5, None]
    assert by_time(got, "target_valid") == [True, True, False]
    assert by_time(got, "Target_60s_log")[:2] == pytest.approx([math.log(41 / 40), math.log(38.5 / 41)])
    assert by_time(got, "Target_60s_simple")[:2] == pytest.approx([1 / 40, -2.5 / 41])
    strict = add_labels(frame, tolerance_seconds=1, slicing=slicing)
    assert by_time(strict, "future_mid") == [None, 38.5, None]


def test_label_tie_takes_the_later_and_rerun_is_safe(spark):
    frame = mids(spark, [(0, 100.0, True), (59, 1.0, True), (61, 2.0, True)])
    once = add_labels(frame)
    assert by_time(once, "future_mid")[0] == 2.0
    assert add_labels(once).columns == once.columns


@pytest.mark.parametrize(("slicing", "tolerance"), [(WHOLE, 4), (Slicing(7), 4), (Slicing(1), 90)])
def test_labels_against_brute_force(spark, slicing, tolerance):
    rng = random.Random(5)
    times = sorted(rng.sample(range(0, 900), 150))
    rows = [(t, None if rng.random() < 0.1 else 100 + rng.random(), rng.random() > 0.2) for t in times]
    got = by_time(add_labels(mids(spark, rows), horizon_seconds=30, tolerance_seconds=tolerance, slicing=slicing), "future_mid", "target_valid")
    good = [(t, m) for t, m, ok in rows if ok and m is not None]
    for (t, m, ok), (mid, valid) in zip(rows, got, strict=True):
        near = [(abs(c - t - 30), -c, v) for c, v in good if abs(c - t - 30) <= tolerance]
        want = min(near)[2] if near else None
        assert mid == want
        assert valid == (ok and m is not None and want is not None)


SERIES = "ticker string, trade_date string, session_id string, timestamp timestamp_ntz, x double, feature_valid boolean"


def series(spark, values, valid=None):
    start = at("09:30:00")
    data = [
        ("A", "2026-01-05", "AM", start + dt.timedelta(seconds=i), v, True if valid is None else valid[i])
        for i, v in enumerate(values)
    ]
    return spark.createDataFrame(data, SERIES)


def exact_scores(values, valid, window):
    want = []
    for i, v in enumerate(values):
        past = np.array(values[max(0, i - window) : i], dtype="longdouble")
        if i < window or not all(valid[i - window : i]) or not valid[i]:
            want.append(None)
            continue
        std = np.sqrt(np.mean((past - past.mean()) ** 2))
        want.append(float((v - past.mean()) / (std if std > 0 else 1)))
    return want


@pytest.mark.parametrize("window", [2, 5, 31])
def test_zscore_equals_exact_moments_after_large_values(spark, window):
    rng = np.random.default_rng(window)
    values = (10 + rng.normal(size=140) * 1e-3).tolist()
    for i in (3, 17, 60, 61):
        values[i] = 1e9
    values[80:120] = [7.25] * 40
    valid = (rng.random(140) > 0.02).tolist()
    want = exact_scores(values, valid, window)
    results = []
    for chunk in (1, 40, 1000):
        got = by_time(causal_zscore(series(spark, values, valid), ["x"], window, chunk_rows=chunk), "normalized__x")
        assert [g is None for g in got] == [w is None for w in want]
        pairs = [(g, w) for g, w in zip(got, want) if g is not None]
        assert [g for g, _ in pairs] == pytest.approx([w for _, w in pairs], rel=1e-6, abs=1e-9)
        results.append(got)
    assert results[0] == results[1] == results[2]


def test_zscore_uses_the_past_only_and_marks_rows(spark):
    values = [4.0, 8.0, 6.0, 9.0, 9.5]
    changed = [*values[:-1], 1e12]
    one, two = (causal_zscore(series(spark, v), ["x"], 3) for v in (values, changed))
    assert by_time(one, "normalized__x")[:4] == by_time(two, "normalized__x")[:4]
    gap = causal_zscore(series(spark, values, [True, False, True, True, True]), ["x"], 3)
    assert by_time(gap, "normalization_valid") == [False] * 5
    infinite = causal_zscore(series(spark, [*values[:4], float("inf")]), ["x"], 3)
    assert by_time(infinite, "normalization_valid") == [False, False, False, True, False]


def test_scaler_settings_are_strict():
    scaler = TrailingScaler(["a", "b"], 7)
    assert scaler_from_settings(scaler.settings()).settings() == scaler.settings()
    some = scaler.settings()
    for bad in ({**some, "extra": 1}, {k: some[k] for k in ("kind", "window")}, {**some, "kind": "?"}):
        with pytest.raises(ValueError):
            scaler_from_settings(bad)
    for args in (([], 5), (["a", "a"], 5), (["a"], 1)):
        with pytest.raises(ValueError):
            TrailingScaler(*args)


ROWS = "ticker string, trade_date string, session_id string, timestamp timestamp_ntz, row_no bigint, row_valid boolean, target_valid boolean, y double, future_mid double, features array<float>"


def flagged(spark, valid, session="AM", day="2026-01-05"):
    start = at("09:30:00" if session == "AM" else "13:00:00", day)
    data = [
        ("A", day, session, start + dt.timedelta(seconds=i), i, v, True, 0.1, 1.0, [float(i), float(-i)])
        for i, v in enumerate(valid)
    ]
    return spark.createDataFrame(data, ROWS)


@pytest.mark.parametrize("slicing", [WHOLE, Slicing(2)])
def test_anchor_needs_a_run_of_valid_rows(spark, slicing):
    frame = flagged(spark, [True, True, False, True, True, True])
    frame = frame.withColumn("target_valid", F.col("row_no") != 4)
    got = samples.mark_anchors(frame, history=2, target_column="y", slicing=slicing)
    assert by_time(got, "is_anchor") == [False, True, False, False, False, True]


def test_global_index_and_windows_stay_in_session(spark):
    frame = flagged(spark, [True] * 5).unionByName(flagged(spark, [True] * 4, "PM"))
    frame = frame.unionByName(flagged(spark, [True] * 3, "AM", "2026-01-06"))
    marked = samples.mark_anchors(frame, history=3, target_column="y")
    rows = samples.add_global_index(marked, samples.session_offsets(frame))
    assert by_time(rows, "global_index") == list(range(12))
    for size in (1000, 4):
        got = samples.window_samples(rows, 3, size)
        windows = [r["window"] for r in got.orderBy(*KEY, "row_no").collect()]
        assert [[int(f[0]) for f in w] for w in windows] == [
            [0, 1, 2], [1, 2, 3], [2, 3, 4], [0, 1, 2], [1, 2, 3], [0, 1, 2]
        ]
    flat = samples.last_frame(samples.flatten_window(got)).orderBy(*KEY, "row_no").first()
    assert flat["flat"] == [0.0, 0.0, 1.0, -1.0, 2.0, -2.0]
    assert flat["anchor_features"] == [2.0, -2.0]
