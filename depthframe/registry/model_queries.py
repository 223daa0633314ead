"""Registered queries: baselines, walk-forward runs and validation."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from depthframe.operators import quality, samples, validation
from depthframe.operators.baselines import (
    GroupedCandidate,
    ImbalanceBaseline,
    OneFeature,
    RidgeBaseline,
    ZeroBaseline,
    score_windows,
)
from depthframe.operators.iterative import DirectionLogit, IterativeCandidate
from depthframe.operators.sessions import choose_slicing
from depthframe.plans import splits, walkforward
from depthframe.plans import evaluate as ev
from depthframe.registry import inputs
from depthframe.registry.dataset_queries import r, text
from depthframe.schema import KEY


def _plan(spark, sf) -> DataFrame:
    dates = splits.trade_dates(inputs.snapshots(spark, sf))
    return splits.walk_forward_folds(dates, **inputs.FOLDS)


def _imbalance():
    return ImbalanceBaseline(inputs.SAMPLE_FEATURES)


def _ridge():
    return RidgeBaseline(len(inputs.SAMPLE_FEATURES), inputs.HISTORY, alpha=inputs.WIDE_ALPHA)


def _predict(spark, sf, candidate) -> DataFrame:
    rows = inputs.stored_rows(spark, sf)
    # A published dataset stores its plan; here it would be derived from the feed at every use.
    plan = _plan(spark, sf).checkpoint()
    return walkforward.candidate_predictions(rows, plan, candidate, dataset_version="events")


def _shown(predictions: DataFrame) -> DataFrame:
    return predictions.select(
        "model_name", "fold_index", *KEY, text("anchor_timestamp"),
        r("target", 7).alias("target"), r("prediction", 7).alias("prediction"),
        r("spread", 5).alias("spread"),
    )


def zero_baseline(spark, sf):
    return _shown(_predict(spark, sf, ZeroBaseline()))


def imbalance_ols(spark, sf):
    return _shown(_predict(spark, sf, _imbalance()))


def imbalance_coefficients(spark, sf):
    train = splits.dates_for(_plan(spark, sf), "train")
    fitted = _imbalance().fit(inputs.dataset_rows(spark, sf), train).coefficients
    return fitted.select(
        "ticker", "fold_index", "train_count", r("slope", 8).alias("slope"), r("intercept", 8).alias("intercept")
    )


def ridge_baseline(spark, sf):
    return _shown(_predict(spark, sf, _ridge()))


def grouped_candidate(spark, sf):
    """A plugged-in model, fitted for all instruments and folds in one plan."""
    model = OneFeature(inputs.SAMPLE_FEATURES.index("ASKs1"))
    return _shown(_predict(spark, sf, GroupedCandidate(model)))


def _logit() -> IterativeCandidate:
    return IterativeCandidate(DirectionLogit([inputs.SAMPLE_FEATURES.index("ASKs1")], alpha=inputs.LOGIT_ALPHA))


def logit_candidate(spark, sf):
    """A model fitted in rounds for all instruments and folds together."""
    return _shown(_predict(spark, sf, _logit()))


def logit_optimality(spark, sf):
    """Its weights, and the gradient that they leave, added up apart from the fit: zero at a minimum."""
    rows, plan = inputs.stored_rows(spark, sf), _plan(spark, sf)
    fitted = _logit().fit(rows, splits.dates_for(plan, "train")).weights
    w = fitted.select("ticker", "fold_index", F.col("weights")[0].alias("slope"), F.col("weights")[1].alias("intercept"))
    samples_ = walkforward.split_rows(rows, plan, "train").filter("is_anchor").join(w, ["ticker", "fold_index"])
    position = inputs.SAMPLE_FEATURES.index("ASKs1")
    x = F.col("features")[position].cast("double")
    rest = 1 / (1 + F.exp(-(F.col("slope") * x + F.col("intercept")))) - (F.col("target") > 0).cast("double")
    grouped = samples_.groupBy("ticker", "fold_index", "slope", "intercept").agg(
        F.count(F.lit(1)).alias("train_count"), F.sum(rest * x).alias("gx"), F.sum(rest).alias("g1")
    )
    return grouped.select(
        "ticker", "fold_index", "train_count", r("slope", 7).alias("slope"), r("intercept", 7).alias("intercept"),
        F.round(F.abs(F.col("gx") + inputs.LOGIT_ALPHA * F.col("slope")), 4).alias("slope_gradient"),
        F.round(F.abs("g1"), 4).alias("intercept_gradient"),
    )


def ridge_coefficients(spark, sf):
    """Ridge on windows of two features, over runs of samples with breaks."""
    rows = inputs.dataset_rows(spark, sf, inputs.RIDGE_FEATURES)
    width, history = len(inputs.RIDGE_FEATURES), inputs.RIDGE_HISTORY
    train = splits.dates_for(_plan(spark, sf), "train")
    fitted = RidgeBaseline(width, history, alpha=inputs.RIDGE_ALPHA).fit(rows, train).coefficients
    weights = [r(F.col("weights")[i], 8).alias(f"weight_{i}") for i in range(width * history)]
    return fitted.select("ticker", "fold_index", "train_count", *weights, r("intercept", 8).alias("intercept"))


def batch_scoring(spark, sf):
    """A trained model over all windows: here the mean of the newest feature vector."""
    def newest_mean(window: np.ndarray) -> np.ndarray:
        return window[:, -1, :].mean(axis=1)

    scored = score_windows(inputs.dataset_rows(spark, sf), newest_mean, inputs.HISTORY, ["ticker"])
    return scored.select(*KEY, text("timestamp"), r("prediction", 5).alias("prediction"))


def stored_scoring(spark, sf):
    """The mean over all values of a window, from stored rows that are not exchanged again."""
    def window_mean(window: np.ndarray) -> np.ndarray:
        return window.mean(axis=(1, 2))

    scored = score_windows(inputs.bucketed_rows(spark, sf), window_mean, inputs.HISTORY, ["ticker"])
    return scored.select(*KEY, text("timestamp"), r("prediction", 5).alias("prediction"))


def walk_forward_summary(spark, sf):
    """Two candidates over every fold, evaluated and summarised per candidate."""
    rows, plan = inputs.stored_rows(spark, sf), _plan(spark, sf)
    tables = [
        walkforward.candidate_predictions(rows, plan, c, dataset_version="events")
        for c in (ZeroBaseline(), _imbalance())
    ]
    overall = ev.evaluate(walkforward.union_candidates(tables), names=["mae", "rmse", "direction_accuracy"])
    out = ev.fold_summary(overall)
    return out.withColumns(
        {c: r(F.col(c), 6) for c in out.columns if c.endswith(("_mean", "_std"))}
    )


def dataset_checks(spark, sf):
    """All dataset rules over the derived dataset; every count is zero."""
    rows, plan = inputs.stored_rows(spark, sf), _plan(spark, sf)
    days = quality.daily_quality(inputs.timeline(spark, sf))
    folds = splits.fold_index(samples.anchors(rows), plan)
    return validation.report(
        [
            validation.row_checks(rows, len(inputs.SAMPLE_FEATURES)),
            validation.quality_checks(days, rows),
            validation.fold_checks(folds, rows, inputs.HISTORY, choose_slicing(rows)),
        ]
    )


def _when(condition: str, changed, name: str):
    return F.when(F.expr(condition), changed).otherwise(F.col(name)).alias(name)


def broken_rows(spark, sf):
    """Row rules on rows with short features, moved positions, a lost row and a moved start."""
    rows = inputs.stored_rows(spark, sf).filter("NOT (ticker = 'T1' AND row_no = 5)")
    changed = {
        "features": _when("global_index % 101 = 7", F.slice("features", 1, 3), "features"),
        "global_index": _when("global_index % 103 = 9", F.col("global_index") + 1, "global_index"),
        "session_start_index": _when("ticker = 'T0' AND row_no = 3", F.col("session_start_index") + 1, "session_start_index"),
    }
    rows = rows.select(*[changed.get(c, F.col(c)) for c in rows.columns])
    return validation.row_checks(rows, len(inputs.SAMPLE_FEATURES))


def broken_quality(spark, sf):
    """Quality rules on a report with a different fault on each weekday-like residue of the day."""
    rows = inputs.stored_rows(spark, sf)
    days = quality.daily_quality(inputs.timeline(spark, sf)).withColumn("d", F.expr("int(right(trade_date, 2)) % 7"))
    days = days.filter("d <> 6").withColumn("copy", F.explode(F.expr("sequence(1, IF(d = 5, 2, 1))")))
    changed = {
        "missing_ratio": F.when(F.col("d") == 1, 1.5).when(F.col("d") != 0, F.col("missing_ratio")).alias("missing_ratio"),
        "max_gap": _when("d = 2", F.lit(-1.0), "max_gap"),
        "duplicate_count": _when("d = 3", F.lit(-1).cast("bigint"), "duplicate_count"),
        "row_count": _when("d = 4", F.lit(0).cast("bigint"), "row_count"),
    }
    days = days.select(*[changed.get(c, F.col(c)) for c in days.columns if c not in ("d", "copy")])
    return validation.quality_checks(days, rows)


def broken_folds(spark, sf):
    """Fold rules on an index with nulls, negative and far positions, copies and a lost split."""
    rows = inputs.stored_rows(spark, sf)
    folds = splits.fold_index(samples.anchors(rows), _plan(spark, sf)).withColumn("g", F.col("global_anchor_index") % 11)
    folds = folds.filter("NOT (fold_index = 2 AND split = 'test')")
    folds = folds.withColumn("copy", F.explode(F.expr("sequence(1, IF(g = 4, 2, 1))")))
    far = F.lit(10**6).cast("bigint")
    changed = {
        "anchor_timestamp": F.when(F.col("g") != 1, F.col("anchor_timestamp")).alias("anchor_timestamp"),
        "anchor_index": _when("g = 2", F.lit(-1).cast("bigint"), "anchor_index"),
        "global_anchor_index": _when("g = 3", F.col("global_anchor_index") + far, "global_anchor_index"),
        "session_start_index": _when("g = 3", F.col("session_start_index") + far, "session_start_index"),
    }
    folds = folds.select(*[changed.get(c, F.col(c)) for c in folds.columns if c not in ("g", "copy")])
    return validation.fold_checks(folds, rows, inputs.HISTORY, choose_slicing(rows))


def broken_windows(spark, sf):
    """Window rules on samples that lost a step, a feature, a number or the target."""
    windows = samples.window_samples(inputs.dataset_rows(spark, sf), inputs.HISTORY).withColumn("g", F.col("global_index") % 13)
    nan = F.transform("window", lambda row: F.transform(row, lambda x: F.lit(float("nan")).cast("float")))
    window = (
        F.when(F.col("g") == 1, F.slice("window", 1, inputs.HISTORY - 1))
        .when(F.col("g") == 2, F.transform("window", lambda row: F.slice(row, 1, 2)))
        .when(F.col("g") == 3, nan)
        .otherwise(F.col("window"))
    )
    target = F.when(F.col("g") != 4, F.col("target"))
    broken = windows.withColumns({"window": window, "target": target}).drop("g")
    return validation.window_checks(broken, inputs.HISTORY, len(inputs.SAMPLE_FEATURES))


def anchor_violations(spark, sf):
    """The fold rules on an index whose anchors all point one row too far."""
    rows = inputs.stored_rows(spark, sf)
    shifted = {c: F.col(c) + 1 for c in ("global_anchor_index", "anchor_index")}
    folds = splits.fold_index(samples.anchors(rows), _plan(spark, sf)).withColumns(shifted)
    wanted = ["anchor window and target valid", "anchor describes its row"]
    return validation.fold_checks(folds, rows, inputs.HISTORY, choose_slicing(rows)).filter(F.col("rule").isin(wanted))


def segment_violations(spark, sf):
    """The raw feed repeats timestamps inside a session."""
    return validation.segment_checks(inputs.snapshots(spark, sf))


def date_violations(spark, sf):
    """Trade dates in the compact spelling of file names are not ISO dates."""
    compact = F.when(F.col("ticker") == "T1", F.regexp_replace("trade_date", "-", ""))
    snaps = inputs.snapshots(spark, sf)
    dates = snaps.withColumn("trade_date", F.coalesce(compact, F.col("trade_date")))
    return splits.date_violations(splits.trade_dates(dates))


def window_violations(spark, sf):
    rows = inputs.dataset_rows(spark, sf)
    return validation.window_checks(
        samples.window_samples(rows, inputs.HISTORY), inputs.HISTORY, len(inputs.SAMPLE_FEATURES)
    )


def prediction_violations(spark, sf):
    """The contract on event predictions: the second half-day carries the wrong date."""
    p = inputs.predictions(spark, sf)
    late = F.hour("anchor_timestamp") >= 12
    wrong = F.when(late, F.date_format(F.date_add("anchor_timestamp", 1), "yyyy-MM-dd"))
    p = p.withColumns(
        {
            "model_version": F.lit("v1"),
            "dataset_version": F.lit("events"),
            "split": F.lit("test"),
            "trade_date": F.coalesce(wrong, F.col("trade_date")),
            **{c: F.lit(1.0) for c in ("mid_t", "future_mid", "bid1", "ask1", "spread")},
        }
    )
    return validation.prediction_checks(p)


def candidate_identity(spark, sf):
    """Identity rules with one of the two models and one of the two folds expected."""
    p = inputs.predictions(spark, sf).withColumns(
        {"dataset_version": F.lit("events"), "split": F.lit("test")}
    )
    return validation.identity_checks(p, dataset_version="events", models=["linear"], folds=[1])


QUERIES = {
    "zero_baseline": zero_baseline,
    "imbalance_ols": imbalance_ols,
    "imbalance_coefficients": imbalance_coefficients,
    "ridge_baseline": ridge_baseline,
    "grouped_candidate": grouped_candidate,
    "logit_candidate": logit_candidate,
    "logit_optimality": logit_optimality,
    "ridge_coefficients": ridge_coefficients,
    "batch_scoring": batch_scoring,
    "stored_scoring": stored_scoring,
    "walk_forward_summary": walk_forward_summary,
    "dataset_checks": dataset_checks,
    "broken_rows": broken_rows,
    "broken_quality": broken_quality,
    "broken_folds": broken_folds,
    "broken_windows": broken_windows,
    "anchor_violations": anchor_violations,
    "segment_violations": segment_violations,
    "date_violations": date_violations,
    "window_violations": window_violations,
    "prediction_violations": prediction_violations,
    "candidate_identity": candidate_identity,
}
