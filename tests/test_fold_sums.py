"""Sums shared by folds: blocks of dates, merged moments, Gram matrices of sliding windows."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from depthframe.operators import baselines as bl
from depthframe.operators import foldsums, toeplitz
from depthframe.operators.iterative import DirectionLogit, IterativeCandidate

DAYS = [f"2026-01-{d:02d}" for d in range(5, 13)]
PLAN = [("A", f, d) for f, (lo, hi) in {1: (0, 4), 2: (2, 6), 3: (4, 8)}.items() for d in DAYS[lo:hi]] + [("B", 1, DAYS[0]), ("B", 1, DAYS[7])]
SCHEMA = (
    "ticker string, trade_date string, session_id string, timestamp timestamp_ntz, row_no bigint, session_start_index bigint,"
    " global_index bigint, features array<float>, target float, is_anchor boolean, mid_t float, future_mid float, bid1 float, ask1 float"
)


def feed(spark, history, width, seed=1, per_session=23):
    """Sessions with broken runs of samples: (rows, DataFrame)."""
    rng = np.random.default_rng(seed)
    out, start = [], {"A": 0, "B": 0}
    for ticker in "AB":
        for day in DAYS:
            for session, hour in (("AM", 9), ("PM", 13)):
                x = rng.normal(size=(per_session, width)).astype("float32")
                y = rng.normal(size=per_session).astype("float32")
                broken = set(rng.integers(0, per_session, 3).tolist()) if session == "AM" else set()
                for i in range(per_session):
                    sample = i >= history - 1 and not broken & set(range(i - history + 1, i + 1))
                    at = dt.datetime.fromisoformat(f"{day} {hour:02d}:00:00") + dt.timedelta(seconds=i)
                    values = [None if i in broken else float(v) for v in x[i]]
                    out.append((ticker, day, session, at, i, start[ticker], start[ticker] + i, values, float(y[i]), sample, 1.0, 1.0, 1.0, 1.0))
                start[ticker] += per_session
    return out, spark.createDataFrame(out, SCHEMA).repartition(5)


def samples_of(rows, history):
    """{(ticker, day): (windows, targets)} one by one."""
    out = {}
    by = {(r[0], r[1], r[2], r[4]): r for r in rows}
    for r in rows:
        if r[9]:
            w = [v for k in range(history) for v in by[(r[0], r[1], r[2], r[4] - history + 1 + k)][7]]
            out.setdefault((r[0], r[1]), []).append((w, r[8]))
    return out


def plan_frame(spark):
    return spark.createDataFrame(PLAN, "ticker string, fold_index bigint, trade_date string")


def test_blocks_hold_dates_of_the_same_folds(spark):
    got = {(r["ticker"], r["trade_date"]): (r["block"], tuple(r["folds"])) for r in foldsums.date_blocks(plan_frame(spark)).collect()}
    for ticker, day in {(t, d) for t, _, d in PLAN}:
        folds = tuple(sorted(f for t, f, d in PLAN if (t, d) == (ticker, day)))
        same = min(d for (t, d) in got if t == ticker and got[(t, d)][1] == folds)
        assert got[(ticker, day)] == (same, folds)


@pytest.mark.parametrize(("history", "chunk", "together"), [(5, 65536, 8), (5, 8, 2), (1, 65536, 8), (2, 8, 1)])
def test_ridge_of_overlapping_folds_equals_the_direct_gram(spark, monkeypatch, history, chunk, together):
    monkeypatch.setattr(bl, "CHUNK_ROWS", chunk)
    monkeypatch.setattr(bl, "LAGS_TOGETHER", together)
    width, alpha = 2, 1.5
    rows, df = feed(spark, history, width)
    got = bl.RidgeBaseline(width, history, alpha).fit(df, plan_frame(spark)).coefficients.collect()
    assert {(r["ticker"], r["fold_index"]) for r in got} == {(t, f) for t, f, _ in PLAN}
    per_day = samples_of(rows, history)
    for r in got:
        chosen = [s for t, f, d in PLAN if (t, f) == (r["ticker"], r["fold_index"]) for s in per_day[(t, d)]]
        x, y = np.array([w for w, _ in chosen]), np.array([t for _, t in chosen])
        c = x - x.mean(axis=0)
        want = np.linalg.solve(c.T @ c + alpha * np.eye(c.shape[1]), c.T @ (y - y.mean()))
        assert r["train_count"] == len(y)
        assert r["weights"] == pytest.approx(want.tolist(), abs=1e-9)
        assert r["intercept"] == pytest.approx(y.mean() - x.mean(axis=0) @ want, abs=1e-9)


def test_window_sums_and_gram():
    rng = np.random.default_rng(0)
    for history, width, lost in [(1, 3, [4]), (2, 2, [9, 10]), (5, 3, [20, 21, 30, 45]), (6, 2, range(6, 60, 7))]:
        x, y = rng.normal(size=(60, width)), rng.normal(size=60)
        at = np.array([i for i in range(history - 1, 60) if i not in lost])
        w = np.stack([x[i - history + 1 : i + 1].ravel() for i in at])
        s = toeplitz.window_sums(x, y, at, history)
        assert (s.count, s.target) == (len(at), pytest.approx(y[at].sum()))
        assert np.allclose(toeplitz.gram(s.lags, s.last.T @ s.last - s.first.T @ s.first), w.T @ w)
        assert np.allclose(s.cross.ravel(), y[at] @ w) and np.allclose(s.total.ravel(), w.sum(0))


def test_many_end_rows_are_compressed():
    rows = np.random.default_rng(2).normal(size=(500, 6))
    small = toeplitz.compressed(rows)
    assert small.shape == (6, 6) and np.allclose(small.T @ small, rows.T @ rows)
    assert toeplitz.compressed(rows[:4]) is not None and len(toeplitz.compressed(rows[:4])) == 4


def test_moments_of_dates_merge_exactly(spark):
    rng = np.random.default_rng(5)
    x = 1e6 + rng.normal(size=200) * 1e-3  # far from zero
    y = rng.normal(size=200)
    rows = [("A", DAYS[i % 4], float(a), float(b)) for i, (a, b) in enumerate(zip(x, y))]
    df = spark.createDataFrame(rows, "ticker string, trade_date string, x double, y double")
    sums = foldsums.date_sums(df, plan_frame(spark), *foldsums.pair_moments(F.col("x"), F.col("y")))
    got = {r["fold_index"]: r for r in foldsums.merged_moments(sums, foldsums.FIT_KEY).filter("ticker = 'A'").collect()}
    for fold, days in ((1, range(4)), (2, (2, 3))):
        at = np.array([i for i in range(200) if i % 4 in days])
        a, b = x[at] - 1e6, y[at]
        assert got[fold]["n"] == len(at)
        assert got[fold]["sxx"] == pytest.approx(((a - a.mean()) ** 2).sum(), rel=1e-6)
        assert got[fold]["sxy"] == pytest.approx(((a - a.mean()) * (b - b.mean())).sum(), rel=1e-6)


def test_rows_are_read_once_and_not_repeated_per_fold(spark):
    _, df = feed(spark, 2, 2)
    in_blocks, folds = foldsums.in_blocks(df, plan_frame(spark))
    dates = len({(t, d) for t, _, d in PLAN})
    assert in_blocks.count() == dates * 46
    assert folds.count() == 7  # one row per block and fold: A has blocks of folds 1, 12, 23 and 3


def test_empty_training_data_is_an_error(spark):
    _, df = feed(spark, 2, 2)
    test = df.withColumn("fold_index", F.lit(7).cast("bigint"))
    names = ["BIDs1", "ASKs1"]
    for model in (bl.ZeroBaseline(), bl.ImbalanceBaseline(names), bl.RidgeBaseline(2, 2), bl.GroupedCandidate(bl.OneFeature(0))):
        with pytest.raises(RuntimeError):
            model.predict(test)
        for rows in (df, df.filter("not is_anchor")):
            with pytest.raises(Exception, match="no training samples"):
                model.fit(rows, plan_frame(spark)).predict(test).collect()


def plain_logit(x, rise, alpha):
    """Newton's method until nothing moves."""
    x = np.column_stack([x, np.ones(len(x))])
    w, penalty = np.zeros(x.shape[1]), np.diag([alpha] * (x.shape[1] - 1) + [0.0])
    for _ in range(100):
        p = 1 / (1 + np.exp(-(x @ w)))
        w = w - np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + penalty, x.T @ (p - rise) + penalty @ w)
    return w


def test_logit_of_all_folds_equals_a_plain_loop(spark):
    rows, df = feed(spark, 2, 2, seed=6)
    model = IterativeCandidate(DirectionLogit([1, 0], alpha=0.5))
    fitted = {(r["ticker"], r["fold_index"]): r for r in model.fit(df, plan_frame(spark)).weights.collect()}
    assert set(fitted) == {(t, f) for t, f, _ in PLAN}
    per_day = samples_of(rows, 2)
    for key, r in fitted.items():
        chosen = [s for t, f, d in PLAN if (t, f) == key for s in per_day[(t, d)]]
        newest = np.array([w[2:] for w, _ in chosen])
        want = plain_logit(newest[:, [1, 0]], np.array([t > 0 for _, t in chosen]), 0.5)
        assert r["weights"] == pytest.approx(want.tolist(), abs=1e-6)
        assert 2 <= r["rounds"] <= 20
    test = df.withColumn("fold_index", F.lit(1).cast("bigint"))
    got = model.predict(test).filter("ticker = 'B'").collect()
    w = np.array(fitted[("B", 1)]["weights"])
    by_time = {(r[1], r[2], r[3]): r[7] for r in rows if r[0] == "B"}
    assert got
    for r in got[:20]:
        x = by_time[(r["trade_date"], r["session_id"], r["timestamp"])]
        assert r["prediction"] == pytest.approx(np.tanh((w @ [x[1], x[0], 1.0]) / 2))


def test_logit_without_a_plan_and_without_a_solution(spark):
    _, df = feed(spark, 2, 2)
    one = df.filter("ticker = 'A'").withColumn("fold_index", F.lit(4).cast("bigint"))
    fitted = IterativeCandidate(DirectionLogit([0])).fit(one).weights.collect()
    assert [(r["ticker"], r["fold_index"]) for r in fitted] == [("A", 4)]
    with pytest.raises(ValueError, match="no solution after 1 rounds"):
        IterativeCandidate(DirectionLogit([0]), max_rounds=1).fit(one)
    with pytest.raises(ValueError, match="alpha"):
        DirectionLogit([0], alpha=0.0)
