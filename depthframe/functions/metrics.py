"""Metric aggregates over ``prediction`` and ``target`` columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from depthframe.functions.book import is_finite
from depthframe.schema import METRICS

P, T = "prediction", "target"


def finite_pair() -> Column:
    return is_finite(F.col(P)) & is_finite(F.col(T))


def _share(hit: Column, of: Column) -> Column:
    """Share of ``hit`` among rows where ``of`` holds; null if there are none."""
    return F.avg(F.when(of, hit.cast("double")))


def mae() -> Column:
    return F.avg(F.abs(F.col(P) - F.col(T)))


def rmse() -> Column:
    error = F.col(P) - F.col(T)
    return F.sqrt(F.avg(error * error))


def pearson(x: Column, y: Column) -> Column:
    """Correlation; null below two rows or if a side is constant (``corr`` would throw)."""
    varies = (F.min(x) < F.max(x)) & (F.min(y) < F.max(y))
    return F.when(
        varies, F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))
    )


def ts_ic() -> Column:
    return pearson(F.col(P), F.col(T))


def direction_accuracy() -> Column:
    return _share(F.sign(F.col(P)) == F.sign(F.col(T)), F.col(T) != 0)


def _side(direction: str) -> tuple[Column, Column]:
    if direction not in ("up", "down"):
        raise ValueError("direction must be 'up' or 'down'")
    return (F.col(P) > 0, F.col(T) > 0) if direction == "up" else (F.col(P) < 0, F.col(T) < 0)


def precision(direction: str) -> Column:
    predicted, actual = _side(direction)
    return _share(actual, predicted)


def recall(direction: str) -> Column:
    predicted, actual = _side(direction)
    return _share(predicted, actual)


# Every metric that one aggregation can compute; rank_ic needs ranks first.
AGGREGATES: dict[str, Callable[[], Column]] = {
    "mae": mae,
    "rmse": rmse,
    "ts_ic": ts_ic,
    "direction_accuracy": direction_accuracy,
    "up_precision": lambda: precision("up"),
    "up_recall": lambda: recall("up"),
    "down_precision": lambda: precision("down"),
    "down_recall": lambda: recall("down"),
}


def check_metrics(names: list[str]) -> list[str]:
    unknown = sorted(set(names) - set(METRICS))
    if unknown:
        raise ValueError(f"unknown metrics: {unknown}")
    if len(set(names)) != len(names):
        raise ValueError("metrics must be unique")
    return list(names)


def regression_loss(name: str = "huber", delta: float = 1.0) -> Column:
    """Sample mean of the squared, absolute or Huber loss."""
    error = F.abs(F.col(P) - F.col(T))
    if name == "mse":
        return F.avg(error * error)
    if name == "mae":
        return F.avg(error)
    if name == "huber":
        if delta <= 0:
            raise ValueError("delta must be > 0")
        inner, outer = 0.5 * error * error, delta * (error - 0.5 * delta)
        return F.avg(F.when(error <= delta, inner).otherwise(outer))
    raise ValueError("loss must be 'mse', 'mae' or 'huber'")
