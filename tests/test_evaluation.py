import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from depthframe.functions import metrics as m
from depthframe.operators import bootstrap as bs
from depthframe.operators.bootstrap import bootstrap_intervals
from depthframe.operators.ranks import average_ranks, equal_count_bins, rank_correlation, running_total
from depthframe.plans import evaluate as ev
from depthframe.schema import METRICS

SCHEMA = "ticker string, model_name string, fold_index bigint, trade_date string, session_id string, anchor_timestamp timestamp_ntz, prediction double, target double"
FORCED = {"rows_per_part": 7}


def frame(spark, preds, targets, days=None, sessions=None):
    start = dt.datetime(2025, 1, 1, 9, 30)
    rows = [
        ("A", "m", 1, (days or ["2025-01-01"] * len(preds))[i], (sessions or ["am"] * len(preds))[i],
         start + dt.timedelta(minutes=i), p, t)
        for i, (p, t) in enumerate(zip(preds, targets, strict=True))
    ]
    return spark.createDataFrame(rows, SCHEMA)


def one(df):
    return df.first().asDict()


def plain_metrics(p, t):
    """The metrics from their definitions, over finite pairs."""
    ok = np.isfinite(p) & np.isfinite(t)
    p, t = p[ok], t[ok]

    def ratio(hit, of):
        return np.mean(hit[of]) if of.any() else None

    def correlation(a, b):
        return np.corrcoef(a, b)[0, 1] if len(set(a)) > 1 and len(set(b)) > 1 else None

    def rank(v):
        return np.array([(v < x).sum() + ((v == x).sum() + 1) / 2 for x in v])

    return {
        "mae": np.mean(np.abs(p - t)),
        "rmse": np.sqrt(np.mean((p - t) ** 2)),
        "ts_ic": correlation(p, t),
        "rank_ic": correlation(rank(p), rank(t)),
        "direction_accuracy": ratio(np.sign(p) == np.sign(t), t != 0),
        "up_precision": ratio(t > 0, p > 0),
        "up_recall": ratio(p > 0, t > 0),
        "down_precision": ratio(t < 0, p < 0),
        "down_recall": ratio(p < 0, t < 0),
    }


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_metrics_equal_their_definitions(spark, seed):
    rng = np.random.default_rng(seed)
    p, t = np.round(rng.normal(size=(2, 37)), 1)
    p[[4, 9]], t[[9, 20]] = np.nan, [np.inf, np.nan]
    t[[1, 2]] = 0.0
    got = one(ev.evaluate(frame(spark, p.tolist(), t.tolist())))
    assert got["sample_count"] == 37
    for name, want in plain_metrics(p, t).items():
        assert got[name] == pytest.approx(want), name


def test_constant_side_has_no_correlation(spark):
    got = one(ev.evaluate(frame(spark, [0.7, 0.7, 0.7], [0.1, 0.3, -0.2])))
    assert got["ts_ic"] is None and got["rank_ic"] is None
    with pytest.raises(ValueError):
        m.precision("sideways")


def test_metric_names_are_checked(spark):
    for names in (["mae", "mae"], ["nothing"]):
        with pytest.raises(ValueError):
            ev.evaluate(frame(spark, [1.0], [1.0]), names=names)


def test_daily_summary_equals_its_definition(spark):
    values = [0.31, -0.12, None, 0.05, 0.27]
    rows = [("A", "m", 1, f"2025-01-0{i + 1}", v) for i, v in enumerate(values)]
    daily = spark.createDataFrame(rows, "ticker string, model_name string, fold_index bigint, trade_date string, ts_ic double")
    got = one(ev.daily_summary(daily))
    known = np.array([v for v in values if v is not None])
    assert got["icir"] == pytest.approx(known.mean() / known.std())
    assert got["positive_ic_day_ratio"] == pytest.approx(0.75)


@pytest.mark.parametrize("limits", [{}, FORCED])
def test_bins_equal_sorted_parts(spark, limits):
    rng = np.random.default_rng(6)
    p, t = np.round(rng.normal(size=(2, 23)), 1)
    rows = ev.prediction_bins(frame(spark, p.tolist(), t.tolist()), 4, **limits).orderBy("bin_index").collect()
    parts = np.array_split(np.argsort(p, kind="stable"), 4)
    assert [r["sample_count"] for r in rows] == [len(x) for x in parts]
    assert [r["mean_prediction"] for r in rows] == pytest.approx([p[x].mean() for x in parts])
    assert [r["mean_realized_return"] for r in rows] == pytest.approx([t[x].mean() for x in parts])
    assert [(r["lower_quantile"], r["upper_quantile"]) for r in rows] == [(i / 4, (i + 1) / 4) for i in range(4)]


def test_too_few_samples_for_bins(spark):
    with pytest.raises(Exception, match="fewer valid samples"):
        ev.prediction_bins(frame(spark, [1.0], [1.0]), 2).collect()


def test_losses(spark):
    got = one(ev.losses(frame(spark, [0.0, 0.0], [0.5, 3.0]), delta=1.0))
    assert got["mse"] == pytest.approx((0.25 + 9) / 2)
    assert got["huber"] == pytest.approx((0.125 + 2.5) / 2)
    with pytest.raises(ValueError):
        m.regression_loss("other")


@pytest.mark.parametrize("limits", [{}, FORCED])
def test_ranks_and_positions_with_a_hot_value(spark, limits):
    rng = np.random.default_rng(0)
    values = np.round(rng.normal(size=300), 1)
    values[:100] = 0.5  # a third of all rows share one value
    other = rng.normal(size=300)
    df = spark.createDataFrame(
        [("g", float(a), float(b), i) for i, (a, b) in enumerate(zip(values, other))],
        "g string, a double, b double, i bigint",
    ).repartition(5)
    ranks = {r["a"]: r["rank"] for r in average_ranks(df, ["g"], "a", **limits).collect()}
    for v in np.unique(values):
        below, same = (values < v).sum(), (values == v).sum()
        assert ranks[v] == below + (same + 1) / 2
    got = rank_correlation(df, ["g"], "a", "b", **limits).first()["rank_ic"]
    ra = np.array([ranks[v] for v in values])
    rb = other.argsort().argsort() + 1
    assert got == pytest.approx(np.corrcoef(ra, rb)[0, 1])
    bins = equal_count_bins(df, ["g"], ["a", "i"], 7, **limits)
    order = sorted(range(300), key=lambda i: (values[i], i))
    want = {i: k + 1 for k, part in enumerate(np.array_split(order, 7)) for i in part}
    assert {r["i"]: r["bin_index"] for r in bins.collect()} == want
    before = running_total(df, ["g"], ["i"], F.lit(2), "s", **limits)
    assert all(r["s"] == 2 * r["i"] for r in before.collect())


def naive_draws(p, t, groups, fold_seed, draws, block, numbers):
    """Row-level bootstrap with the same starts."""
    out = []
    for d in range(draws):
        chosen = []
        for key, index in groups.items():
            n = len(index)
            size = min(block, n)
            picked = []
            for b in range(-(-n // size)):
                lo = bs.block_start(fold_seed, d, numbers[key], b, n - size + 1)
                picked += index[lo : lo + size]
            chosen += picked[:n]
        out.append((p[chosen], t[chosen]))
    return out


@pytest.mark.parametrize("limit", [200_000, 8])
def test_bootstrap_against_rows(spark, limit, monkeypatch):
    monkeypatch.setattr(bs, "CHUNK_ROWS", 5)
    monkeypatch.setattr(bs, "MAX_DRAWN_ROWS", limit * 25)
    monkeypatch.setattr(bs.group_draws, "MAX_GROUP_ROWS", 16_000_000 if limit > 8 else 39)
    rng = np.random.default_rng(2)
    n = 40
    t = rng.normal(size=n)
    p = 0.5 * t + rng.normal(size=n)
    days = ["2025-01-01"] * 22 + ["2025-01-02"] * 18
    sessions = ["am"] * 15 + ["pm"] * 7 + ["am"] * 18
    df = frame(spark, p.tolist(), t.tolist(), days, sessions).repartition(3)
    got = {
        r["metric"]: (r["estimate"], r["lower"], r["upper"])
        for r in bootstrap_intervals(df, draws=25, block=4, seed=7, max_session_rows=limit).collect()
    }
    assert set(got) == set(METRICS)
    groups, numbers = {}, {}
    for i, key in enumerate(zip(days, sessions)):
        groups.setdefault(key, []).append(i)
    for key in groups:
        one_row = spark.range(1).select(bs.session_number(F.lit("A"), F.lit(key[0]), F.lit(key[1])))
        numbers[key] = one_row.first()[0]
    draws = naive_draws(p, t, groups, 7 + 1, 25, 4, numbers)

    def rank(v):
        return np.array([(v < x).sum() + ((v == x).sum() + 1) / 2 for x in v])

    checks = {
        "mae": lambda a, b: np.mean(np.abs(a - b)),
        "ts_ic": lambda a, b: np.corrcoef(a, b)[0, 1],
        "rank_ic": lambda a, b: np.corrcoef(rank(a), rank(b))[0, 1],
        "up_precision": lambda a, b: np.mean(b[a > 0] > 0),
    }
    for name, fn in checks.items():
        want = np.quantile([fn(a, b) for a, b in draws], [0.025, 0.975])
        assert got[name][0] == pytest.approx(fn(p, t)), name
        assert got[name][1:] == pytest.approx(tuple(want)), name


@pytest.mark.parametrize("cells", [20_000_000, 100])
def test_opaque_metrics_and_rank_draws_in_batches(spark, monkeypatch, cells):
    def opaque(p, t):
        return np.median(np.abs(p - t)) if len(p) > 3 else None

    monkeypatch.setattr(bs.group_draws, "TASK_CELLS", cells)  # few draws a task
    rng = np.random.default_rng(12)
    n = 41
    t = np.round(rng.normal(size=n), 1)
    p = np.round(0.4 * t + rng.normal(size=n), 1)  # ties
    p[7], t[30] = np.nan, np.inf
    days = ["2025-01-01"] * 20 + ["2025-01-02"] * 21
    sessions = ["am"] * 11 + ["pm"] * 9 + ["am"] * 21
    df = frame(spark, p.tolist(), t.tolist(), days, sessions).repartition(4)
    got = {
        r["metric"]: r
        for r in bootstrap_intervals(df, names=["rank_ic"], draws=9, block=5, seed=3, opaque={"median_error": opaque}).collect()
    }
    groups, numbers = {}, {}
    for i, key in enumerate(zip(days, sessions)):
        groups.setdefault(key, []).append(i)
    for key in groups:
        numbers[key] = spark.range(1).select(bs.session_number(F.lit("A"), F.lit(key[0]), F.lit(key[1]))).first()[0]

    def rank(v):
        return np.array([(v < x).sum() + ((v == x).sum() + 1) / 2 for x in v])

    def spearman(a, b):
        return np.corrcoef(rank(a), rank(b))[0, 1]

    draws = naive_draws(p, t, groups, 3 + 1, 9, 5, numbers)
    for name, fn in (("rank_ic", spearman), ("median_error", opaque)):
        values = []
        for a, b in [(p, t), *draws]:
            ok = np.isfinite(a) & np.isfinite(b)
            values.append(fn(a[ok], b[ok]))
        assert got[name]["estimate"] == pytest.approx(values[0])
        assert (got[name]["lower"], got[name]["upper"]) == pytest.approx(tuple(np.quantile(values[1:], [0.025, 0.975])))
    daily = ev.custom_python_metric(df, opaque, "m", [*ev.CANDIDATE, "trade_date"]).collect()
    assert len(daily) == 2 and all(r["m"] is not None for r in daily)
    few = ev.custom_python_metric(df.limit(2), opaque, "m").collect()
    assert [r["m"] for r in few] in ([None], [])
    with pytest.raises(ValueError, match="names of their own"):
        bootstrap_intervals(df, opaque={"mae": opaque})
    monkeypatch.setattr(bs.group_draws, "MAX_GROUP_ROWS", 10)
    with pytest.raises(ValueError, match="exceeds"):
        ev.custom_python_metric(df, opaque, "m")


def test_rank_correlation_of_large_groups_next_to_small_ones(spark):
    rng = np.random.default_rng(3)
    rows, want = [], {}
    for g, n in (("big", 400), ("flat", 50), ("small", 6), ("one", 1)):
        a, b = np.round(rng.normal(size=n), 1), rng.normal(size=n)
        b[: n // 2] = 0.25  # half of all rows share one value
        if g == "flat":
            a[:] = 1.0
        rows += [(g, float(x), float(y)) for x, y in zip(a, b)]
        if g in ("big", "small"):
            ra, rb = (np.array([(v < x).sum() + ((v == x).sum() + 1) / 2 for x in v]) for v in (a, b))
            want[g] = np.corrcoef(ra, rb)[0, 1]
    df = spark.createDataFrame(rows, "g string, a double, b double").repartition(6)
    for part in (1_000_000, 20):
        got = {r["g"]: r["rank_ic"] for r in rank_correlation(df, ["g"], "a", "b", rows_per_part=part).collect()}
        assert set(got) == {"big", "flat", "small", "one"}
        assert got["flat"] is None and got["one"] is None
        for g, value in want.items():
            assert got[g] == pytest.approx(value)


def test_bins_where_all_predictions_are_equal(spark):
    n = 60
    days = [f"2025-01-{1 + i // 12:02d}" for i in range(n)]
    df = frame(spark, [0.0] * n, list(map(float, range(n))), days).repartition(5)
    for limits in ({}, FORCED):
        rows = ev.prediction_bins(df, 7, **limits).orderBy("bin_index").collect()
        parts = np.array_split(np.arange(n), 7)
        assert [r["mean_realized_return"] for r in rows] == pytest.approx([x.mean() for x in parts])


def test_least_of_blocks():
    rng = np.random.default_rng(8)
    x = rng.normal(size=50)
    lo = rng.integers(0, 50, 200)
    hi = np.minimum(lo + rng.integers(1, 20, 200), 50)
    draw = rng.integers(0, 9, 200)
    got = bs.least_by_draw(x, draw, lo, hi, 10)
    want = [min((x[a:b].min() for a, b, d in zip(lo, hi, draw) if d == k), default=np.inf) for k in range(10)]
    assert got.tolist() == want


def test_nearly_constant_draws_count(spark):
    p = (1e6 + np.arange(12) * 1e-3).tolist()  # far from zero, but no draw is constant
    t = [float((7 * i) % 5) for i in range(12)]
    got = bootstrap_intervals(frame(spark, p, t), names=["ts_ic"], draws=30, block=6, seed=3).first()
    assert got["lower"] is not None and got["lower"] < got["upper"]
    flat = bootstrap_intervals(frame(spark, [1e6] * 12, t), names=["ts_ic"], draws=30, block=6, seed=3).first()
    assert flat["lower"] is None and flat["estimate"] is None


def test_bootstrap_repeats_and_checks_arguments(spark):
    rng = np.random.default_rng(9)
    p, t = rng.normal(size=(2, 14))
    days = ["2025-01-01"] * 6 + ["2025-01-02"] * 8
    df = frame(spark, p.tolist(), t.tolist(), days, ["am"] * 3 + ["pm"] * 3 + ["am"] * 8)
    spread = {"spread": lambda a, b: F.max(a) - F.min(b)}
    first = bootstrap_intervals(df, names=["mae"], draws=20, block=2, seed=7, custom=spread).collect()
    again = bootstrap_intervals(df.repartition(3), names=["mae"], draws=20, block=2, seed=7, custom=spread).collect()
    by, other = ({r["metric"]: r for r in rows} for rows in (first, again))
    assert set(by) == {"mae", "spread"}
    for name, row in by.items():
        assert [other[name][c] for c in ("estimate", "lower", "upper")] == pytest.approx([row["estimate"], row["lower"], row["upper"]])
    assert by["mae"]["estimate"] == pytest.approx(np.abs(p - t).mean())
    assert by["spread"]["estimate"] == pytest.approx(p.max() - t.min())
    assert by["spread"]["upper"] <= p.max() - t.min() + 1e-12
    for bad in ({"confidence": 1.0}, {"draws": 0}, {"block": 0}, {"custom": {"mae": spread["spread"]}}):
        with pytest.raises(ValueError):
            bootstrap_intervals(df, **bad)
