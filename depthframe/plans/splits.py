"""Chronological splits and walk-forward folds over trade dates."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from depthframe.schema import SPLITS


def trade_dates(df: DataFrame) -> DataFrame:
    """Distinct trade dates per instrument with their zero-based position ``r``."""
    order = Window.partitionBy("ticker").orderBy("trade_date")
    dates = df.select("ticker", "trade_date").distinct()
    return dates.withColumn("r", (F.row_number().over(order) - 1).cast("bigint"))


def _with_count(dates: DataFrame) -> DataFrame:
    return dates.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("ticker")))


def chronological_split(
    dates: DataFrame, *, train_ratio: float = 0.6, validation_ratio: float = 0.2
) -> DataFrame:
    """Whole dates by ratio, both sizes truncated; the test split takes the rest."""
    if not (0 < train_ratio < 1 and 0 < validation_ratio < 1 and train_ratio + validation_ratio < 1):
        raise ValueError("split ratios must be positive and leave room for a test split")
    counted = _with_count(dates)
    train = F.floor(F.col("n") * F.lit(train_ratio))
    validation = F.floor(F.col("n") * F.lit(validation_ratio))
    split = (
        F.when(F.col("r") < train, "train")
        .when(F.col("r") < train + validation, "validation")
        .otherwise("test")
    )
    return counted.select("ticker", "trade_date", split.alias("split"))


def _checked_range(name: str, bounds) -> tuple[str, str]:
    if bounds is None:
        raise ValueError("all three date ranges must be given together")
    for value in bounds:
        if date.fromisoformat(value).isoformat() != value:
            raise ValueError(f"{name} dates must be YYYY-MM-DD")
    if bounds[0] > bounds[1]:
        raise ValueError(f"{name} range start must be <= end")
    return tuple(bounds)


def explicit_split(dates: DataFrame, *, train, validation, test) -> DataFrame:
    """Inclusive date ranges. Dates in no or several ranges show up in ``coverage``."""
    spec = {n: _checked_range(n, b) for n, b in zip(SPLITS, (train, validation, test))}
    hits = F.array_compact(
        F.array(*[F.when(F.col("trade_date").between(*b), F.lit(n)) for n, b in spec.items()])
    )
    return (
        dates.withColumn("_hits", hits)
        .withColumn("coverage", F.size("_hits"))
        .select("ticker", "trade_date", F.explode_outer("_hits").alias("split"), "coverage")
    )


def walk_forward_folds(
    dates: DataFrame, *, train_days: int, validation_days: int, test_days: int, step_days: int
) -> DataFrame:
    """Fixed-size sliding folds as ``(ticker, fold_index, split, trade_date)``.

    The folds that cover date ``r`` follow from its position alone, so each date lists its
    own folds: no join with a fold table. An incomplete last fold is dropped.
    """
    if min(train_days, validation_days, test_days, step_days) <= 0:
        raise ValueError("fold day counts must be > 0")
    length = train_days + validation_days + test_days
    df = _with_count(dates).filter(F.col("n") >= length)
    last = F.expr(f"(n - {length}) DIV {step_days}")
    lo = F.greatest(F.lit(0), F.expr(f"(r - {length} + {step_days}) DIV {step_days}"))
    hi = F.least(last, F.expr(f"r DIV {step_days}"))
    df = df.withColumn("_f", F.explode(F.when(lo <= hi, F.sequence(lo, hi))))
    offset = F.col("r") - F.col("_f") * step_days
    split = (
        F.when(offset < train_days, "train")
        .when(offset < train_days + validation_days, "validation")
        .otherwise("test")
    )
    return df.select(
        "ticker", (F.col("_f") + 1).alias("fold_index"), split.alias("split"), "trade_date"
    )


def short_instruments(dates: DataFrame, needed: int) -> DataFrame:
    """``(ticker, dates, needed)`` of instruments with fewer dates than one fold takes."""
    per_ticker = dates.groupBy("ticker").agg(F.count(F.lit(1)).alias("dates"))
    return per_ticker.filter(F.col("dates") < needed).withColumn("needed", F.lit(needed).cast("bigint"))


def empty_splits(split: DataFrame) -> DataFrame:
    """``(ticker, split)`` without any date. Works on the result of either kind of split."""
    have = split.groupBy("ticker").agg(F.collect_set("split").alias("have"))
    every = F.array(*[F.lit(s) for s in SPLITS])
    return have.select("ticker", F.explode(F.array_except(every, "have")).alias("split"))


def uncovered_dates(split: DataFrame) -> DataFrame:
    """``(ticker, trade_date, coverage)`` of dates that explicit ranges hold never or several times."""
    return split.filter("coverage <> 1").select("ticker", "trade_date", "coverage").distinct()


def missing_folds(plan: DataFrame, start_fold: int, num_folds: int | None = None) -> DataFrame:
    """``(ticker, fold_index)`` of requested folds that an instrument does not have.

    Without a number, every fold from the first on that any instrument has is requested.
    """
    have = plan.select("ticker", "fold_index").distinct()
    last = plan.agg(F.max("fold_index")).first()[0] if num_folds is None else start_fold + num_folds - 1
    asked = F.sequence(F.lit(start_fold).cast("bigint"), F.lit(max(start_fold, last or 0)).cast("bigint"))
    wanted = have.select("ticker").distinct().withColumn("fold_index", F.explode(asked))
    return wanted.join(have, ["ticker", "fold_index"], "left_anti")


def single_fold(split: DataFrame) -> DataFrame:
    """Use one chronological split as fold 1 of a plan."""
    return split.select("ticker", F.lit(1).cast("bigint").alias("fold_index"), "split", "trade_date")


def dates_for(plan: DataFrame, split: str) -> DataFrame:
    if split not in SPLITS:
        raise ValueError(f"split must be one of {SPLITS}")
    return plan.filter(F.col("split") == split)


def date_violations(dates: DataFrame) -> DataFrame:
    """Dates that are not ISO or repeat. Positions make them ascending by construction."""
    per_date = dates.groupBy("ticker", "trade_date").agg(F.count(F.lit(1)).alias("n"))
    iso = F.col("trade_date").try_cast("date").cast("string") == F.col("trade_date")
    rule = F.when(~F.coalesce(iso, F.lit(False)), "not an ISO date").when(F.col("n") > 1, "repeated date")
    return per_date.select("ticker", "trade_date", rule.alias("rule")).filter("rule is not null")


def fold_bounds(plan: DataFrame) -> DataFrame:
    """First and last date of each split of each fold, side by side."""
    def edge(fn, split):
        return fn(F.when(F.col("split") == split, F.col("trade_date")))

    return plan.groupBy("ticker", "fold_index").agg(
        *[edge(F.min, s).alias(f"{s}_first") for s in SPLITS],
        *[edge(F.max, s).alias(f"{s}_last") for s in SPLITS],
        F.count(F.lit(1)).alias("days"),
    )


def splits_in_order() -> Column:
    """On the columns of :func:`fold_bounds`: no split is empty and each ends before the next begins."""
    ordered = (F.col("train_last") < F.col("validation_first")) & (
        F.col("validation_last") < F.col("test_first")
    )
    return F.coalesce(ordered, F.lit(False))


def fold_violations(plan: DataFrame) -> DataFrame:
    """Folds with an empty split or splits that are not strictly one after another."""
    return fold_bounds(plan).filter(~splits_in_order())


def fold_index(anchors: DataFrame, plan: DataFrame) -> DataFrame:
    """Anchors of every fold and split, in one job. Overlapping folds repeat an anchor."""
    out = anchors.join(plan, ["ticker", "trade_date"])
    return out.select(
        "ticker",
        "fold_index",
        "split",
        "global_anchor_index",
        "session_start_index",
        "anchor_index",
        "trade_date",
        "session_id",
        "anchor_timestamp",
    )


def select_folds(df: DataFrame, start_fold: int = 1, num_folds: int | None = None) -> DataFrame:
    """Rows of ``num_folds`` consecutive folds from ``start_fold`` on, which every instrument must have.

    Reports the first few (instrument, fold) that are missing as an error.
    """
    if start_fold < 1 or (num_folds is not None and num_folds < 1):
        raise ValueError("folds count from 1 and at least one is needed")
    lost = missing_folds(df, start_fold, num_folds).limit(5).collect()
    if lost:
        raise ValueError(f"folds not available: {[(r['ticker'], r['fold_index']) for r in lost]}")
    chosen = F.col("fold_index") >= start_fold
    if num_folds is not None:
        chosen = chosen & (F.col("fold_index") < start_fold + num_folds)
    return df.filter(chosen)
