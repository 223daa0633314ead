"""Evaluation of predictions: overall, daily, summary, bins, bootstrap intervals."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from depthframe.functions import metrics as m
from depthframe.operators.draws import PythonMetric, python_metric
from depthframe.operators.ranked import RankedMetric, ranked_metric
from depthframe.operators.ranks import equal_count_bins, rank_correlation
from depthframe.schema import METRICS

CANDIDATE = ["ticker", "model_name", "fold_index"]
SAMPLE = ["trade_date", "session_id", "anchor_timestamp"]


def finite_pairs(predictions: DataFrame) -> DataFrame:
    return predictions.filter(m.finite_pair())


def evaluate(
    predictions: DataFrame, group: list[str] | None = None, names: list[str] | None = None
) -> DataFrame:
    """``sample_count`` (all rows) and the chosen metrics (finite pairs) per group."""
    group = list(group or CANDIDATE)
    names = m.check_metrics(names or METRICS)
    clean = predictions.withColumns(
        {c: F.when(m.finite_pair(), F.col(c)) for c in (m.P, m.T)}
    )
    out = clean.groupBy(*group).agg(
        F.count(F.lit(1)).alias("sample_count"),
        *[m.AGGREGATES[n]().alias(n) for n in names if n != "rank_ic"],
    )
    if "rank_ic" in names:
        ranks = rank_correlation(finite_pairs(predictions), group, m.P, m.T)
        out = out.join(ranks, group, "left")
    return out.select(*group, "sample_count", *names)


def custom_metric(
    predictions: DataFrame,
    metric: Callable[[Column, Column], Column],
    name: str,
    group: list[str] | None = None,
) -> DataFrame:
    """A user metric given as an aggregate over (prediction, target) columns."""
    rows = finite_pairs(predictions)
    return rows.groupBy(*(group or CANDIDATE)).agg(metric(F.col(m.P), F.col(m.T)).alias(name))


def custom_python_metric(
    predictions: DataFrame, metric: PythonMetric, name: str, group: list[str] | None = None
) -> DataFrame:
    """A user metric as an opaque Python function over a group's (prediction, target) vectors.

    A group is one task, so ``group`` should bound it: an instrument's fold, or its day. The vectors
    hold the finite pairs by prediction, then target. NaN and None are null.
    """
    return python_metric(predictions, metric, name, list(group or CANDIDATE))


def custom_ranked_metric(
    predictions: DataFrame, metric: RankedMetric, name: str, group: list[str] | None = None
) -> DataFrame:
    """A user metric as Python functions of sorted scores; no task holds a group, whatever its size."""
    return ranked_metric(predictions, metric, name, list(group or CANDIDATE))


def daily_metrics(
    predictions: DataFrame, names: list[str] | None = None, group: list[str] | None = None
) -> DataFrame:
    return evaluate(predictions, [*(group or CANDIDATE), "trade_date"], names)


def daily_summary(
    daily: DataFrame, names: list[str] | None = None, group: list[str] | None = None
) -> DataFrame:
    """Mean and population deviation of each daily metric, ICIR and share of positive days."""
    names = [n for n in names or METRICS if n in daily.columns]
    ic = F.col("ts_ic")
    spread = F.stddev_pop(ic)
    return daily.groupBy(*(group or CANDIDATE)).agg(
        *[F.avg(n).alias(f"{n}_mean") for n in names],
        *[F.stddev_pop(n).alias(f"{n}_std") for n in names],
        F.when(F.count(ic) >= 2, F.try_divide(F.avg(ic), spread)).alias("icir"),
        F.avg((ic > 0).cast("double")).alias("positive_ic_day_ratio"),
    )


def prediction_bins(
    predictions: DataFrame,
    n_bins: int = 10,
    group: list[str] | None = None,
    sample_order: list[str] | None = None,
    **limits,
) -> DataFrame:
    """Samples in prediction order (ties in sample order) cut into equal-count bins."""
    group = list(group or CANDIDATE)
    order = [m.P, *(sample_order or SAMPLE)]
    rows = finite_pairs(predictions).select(*group, *order, m.T)
    binned = equal_count_bins(rows, group, order, n_bins, **limits)
    return (
        binned.groupBy(*group, "bin_index")
        .agg(
            F.count(F.lit(1)).alias("sample_count"),
            F.avg(m.P).alias("mean_prediction"),
            F.avg(m.T).alias("mean_realized_return"),
        )
        .withColumn("lower_quantile", (F.col("bin_index") - 1) / F.lit(float(n_bins)))
        .withColumn("upper_quantile", F.col("bin_index") / F.lit(float(n_bins)))
    )


def fold_summary(overall: DataFrame, names: list[str] | None = None) -> DataFrame:
    """Per candidate over its folds: fold and sample counts, metric mean and deviation."""
    names = [n for n in names or METRICS if n in overall.columns]
    return overall.groupBy("ticker", "model_name").agg(
        F.count(F.lit(1)).alias("fold_count"),
        F.sum("sample_count").alias("sample_count"),
        *[F.avg(n).alias(f"{n}_mean") for n in names],
        *[F.stddev_pop(n).alias(f"{n}_std") for n in names],
    )


def losses(predictions: DataFrame, delta: float = 1.0, group: list[str] | None = None) -> DataFrame:
    return finite_pairs(predictions).groupBy(*(group or CANDIDATE)).agg(
        m.regression_loss("mse").alias("mse"),
        m.regression_loss("mae").alias("mae"),
        m.regression_loss("huber", delta).alias("huber"),
    )
