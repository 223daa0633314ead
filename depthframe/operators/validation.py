"""Checks on datasets and predictions.

Every check returns ``(rule, violations)`` rows, counted with aggregates. ``report`` keeps
the passes too; ``raise_if_broken`` stops on the first broken rule.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from depthframe.functions.book import is_finite
from depthframe.operators.samples import mark_anchors
from depthframe.operators.sessions import WHOLE, Slicing
from depthframe.plans.splits import splits_in_order
from depthframe.schema import (
    DAY,
    FOLD_INDEX_SCHEMA,
    KEY,
    PREDICTION_SCHEMA,
    QUALITY_SCHEMA,
    ROWS_SCHEMA,
    SPLITS,
)


def _counts(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """One pass: how many rows break each rule (null counts as broken)."""
    broken = [
        F.count(F.when(~F.coalesce(ok, F.lit(False)), 1)).alias(name) for name, ok in rules.items()
    ]
    return df.agg(*broken).unpivot([], list(rules), "rule", "violations")


def _level(df: DataFrame, keys: list[str], rules: dict[str, Column], below: list[str] = (), *more: Column) -> DataFrame:
    """Rows of ``df`` that break each rule, per ``keys``, and the sums of the counts ``below``.

    Rules on groups of rows are rules on the level that grouped them, so a table is read once.
    """
    broken = [F.count(F.when(~F.coalesce(ok, F.lit(False)), 1)).alias(name) for name, ok in rules.items()]
    sums = [F.coalesce(F.sum(F.col(f"`{name}`")), F.lit(0)).alias(name) for name in below]
    return df.groupBy(*keys).agg(*broken, *sums, *more)


def _rules(totals: DataFrame, names: list[str]) -> DataFrame:
    return totals.unpivot([], [F.col(f"`{n}`") for n in names], "rule", "violations")


def _empty(counted: str) -> Column:
    """1 if the level below counted no row at all."""
    return F.when(F.coalesce(F.sum(counted), F.lit(0)) == 0, 1).otherwise(0).cast("bigint")


def report(tables: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, tables)


def raise_if_broken(checks: DataFrame, what: str) -> None:
    broken = checks.filter("violations > 0").collect()  # one row per rule
    if broken:
        raise ValueError(f"{what}: " + "; ".join(f"{r['rule']} ({r['violations']})" for r in broken))


def check_schema(df: DataFrame, schema, what: str) -> None:
    """Exact column names and types, in any order (partition columns move to the end)."""
    want = {f.name: f.dataType.simpleString() for f in schema}
    have = {f.name: f.dataType.simpleString() for f in df.schema}
    if want != have:
        raise ValueError(f"{what} schema differs: {sorted(set(want.items()) ^ set(have.items()))}")


def segment_checks(df: DataFrame) -> DataFrame:
    """User input for one session: keys and time must be present and unique."""
    present = {"keys and timestamp present": F.concat_ws("", *KEY).isNotNull() & F.col("timestamp").isNotNull()}
    times = _level(df, [*KEY, "timestamp"], present, [], F.count(F.lit(1)).alias("n"))
    unique = {"timestamps unique within a session": F.col("n") == 1}
    return _rules(_level(times, [], unique, list(present)), [*present, *unique])


def row_checks(rows: DataFrame, feature_count: int) -> DataFrame:
    """Array width, and global positions covering 0..n-1 exactly once per instrument.

    One scan: rows are counted per session, sessions per instrument, instruments in all.
    """
    c = F.col
    row_rules = {
        "feature width": F.size("features") == feature_count,
        "global index is session start plus position": c("global_index") == c("session_start_index") + c("row_no"),
    }
    session_rules = {
        "session positions cover every row once": (c("lo") == 0) & (c("hi") == c("n") - 1) & (c("d") == c("n")),
        "one start per session": c("start") == c("start_hi"),
    }
    instrument_rules = {"sessions cover every global row once": c("joined")}
    sessions = _level(
        rows, KEY, row_rules, [],
        F.count(F.lit(1)).alias("n"),
        F.count_distinct("row_no").alias("d"),
        F.min("row_no").alias("lo"),
        F.max("row_no").alias("hi"),
        F.min("session_start_index").alias("start"),
        F.max("session_start_index").alias("start_hi"),
    )
    # One row per session: each must start where those before it end.
    earlier = Window.partitionBy("ticker").orderBy("start", *KEY[1:]).rowsBetween(Window.unboundedPreceding, -1)
    joined = F.coalesce(c("start") == F.coalesce(F.sum("n").over(earlier), F.lit(0)), F.lit(False))
    instruments = _level(
        sessions.withColumn("joined", joined), ["ticker"], session_rules, list(row_rules), F.min("joined").alias("joined")
    )
    below = [*row_rules, *session_rules]
    return _rules(_level(instruments, [], instrument_rules, below), [*below, *instrument_rules])


def quality_checks(quality: DataFrame, rows: DataFrame) -> DataFrame:
    """Complete, unique, in range, and describing the same days and rows as the dataset.

    One scan of either table: days of both meet in one full join, whose rows are counted per day.
    """
    c = F.col
    counts = [
        "duplicate_count", "crossed_book_count", "one_side_missing_count", "invalid_level_order_count",
    ]
    rules = {
        "quality without nulls": reduce(lambda a, b: a & b, [c(f.name).isNotNull() for f in QUALITY_SCHEMA]),
        "row count positive": c("row_count") > 0,
        "ratios within 0 and 1": c("missing_ratio").between(0, 1) & c("stale_snapshot_ratio").between(0, 1),
        "gaps ordered and not negative": (c("max_gap") >= 0) & (c("p95_gap") >= 0) & (c("p95_gap") <= c("max_gap")),
        "counts not negative": F.least(*counts) >= 0,
    }
    # A day without a quality row breaks the match only.
    rules = {name: c("_stored").isNull() | F.coalesce(ok, F.lit(False)) for name, ok in rules.items()}
    rules["quality rows match the dataset"] = c("row_count") == c("rows_found")
    per_day = rows.groupBy(*DAY).agg(F.count(F.lit(1)).alias("rows_found"))
    both = quality.withColumn("_stored", F.lit(1)).join(per_day, DAY, "full")
    days = _level(both, DAY, rules, [], F.count("_stored").alias("n"))
    one = {"one quality row per day": c("n") <= 1}
    totals = _level(days, [], one, list(rules), _empty("n").alias("quality not empty"))
    return _rules(totals, ["quality not empty", *rules, *one])


def fold_checks(
    folds: DataFrame, rows: DataFrame, history: int, slicing: Slicing = WHOLE
) -> DataFrame:
    """Fold index against the stored rows it points to.

    One scan of either table: entries meet their rows in one join and are counted per anchor, split,
    fold and in all. Positions of the rows are taken as checked by :func:`row_checks`.
    """
    c = F.col
    # Anchors are derived again from the stored validity flags.
    again = rows.withColumn("_target", F.when(c("target_valid"), c("target")))
    anchors = mark_anchors(again, history=history, target_column="_target", slicing=slicing)
    anchors = anchors.select(
        "ticker",
        c("global_index").alias("global_anchor_index"),
        c("trade_date").alias("row_date"),
        c("session_id").alias("row_session"),
        c("timestamp").alias("row_time"),
        c("is_anchor").alias("row_is_anchor"),
    )
    found = folds.join(anchors, ["ticker", "global_anchor_index"], "left")
    entry_rules = {
        "fold index without nulls": reduce(lambda a, b: a & b, [c(f.name).isNotNull() for f in FOLD_INDEX_SCHEMA]),
        "fold positions not negative": F.least("global_anchor_index", "session_start_index", "anchor_index") >= 0,
        "anchor inside the dataset": c("row_is_anchor").isNotNull() | (c("global_anchor_index") < 0),
        "global minus start is local": c("global_anchor_index") - c("session_start_index") == c("anchor_index"),
        "anchor leaves room for its window": c("anchor_index") >= history - 1,
        "anchor window and target valid": c("row_is_anchor"),
        "anchor describes its row": (c("trade_date") == c("row_date"))
        & (c("session_id") == c("row_session"))
        & (c("anchor_timestamp") == c("row_time")),
    }
    fold = ["ticker", "fold_index"]
    at = _level(
        found, [*fold, "split", "global_anchor_index"], entry_rules, [],
        F.count(F.lit(1)).alias("n"), F.min("trade_date").alias("first"), F.max("trade_date").alias("last"),
    )
    unique = {"anchor unique in its split": c("n") == 1}
    below = [*entry_rules, *unique]
    splits = _level(
        at, [*fold, "split"], unique, list(entry_rules),
        F.min("first").alias("first"), F.max("last").alias("last"), F.sum("n").alias("n"),
    )
    edges = [
        F.max(F.when(c("split") == split, c(edge))).alias(f"{split}_{edge}") for split in SPLITS for edge in ("first", "last")
    ]
    per_fold = _level(splits, fold, {}, below, F.collect_set("split").alias("splits"), F.sum("n").alias("n"), *edges)
    fold_rules = {
        "fold has train, validation and test": F.array_sort("splits") == F.array(*[F.lit(s) for s in sorted(SPLITS)]),
        "splits strictly one after another": splits_in_order(),
    }
    totals = _level(per_fold, [], fold_rules, below, _empty("n").alias("fold index not empty"))
    return _rules(totals, ["fold index not empty", *below, *fold_rules])


def prediction_checks(predictions: DataFrame) -> DataFrame:
    """Contract of a stored prediction table, in one scan."""
    c = F.col
    numbers = ["mid_t", "future_mid", "bid1", "ask1", "spread", "prediction", "target"]
    texts = ["model_name", "model_version", "dataset_version", "split", *KEY]
    sample = ["model_name", "fold_index", *KEY, "anchor_timestamp"]
    rules = {
        "numbers finite": reduce(lambda a, b: a & b, [is_finite(c(n)) for n in numbers]),
        "names not empty": reduce(lambda a, b: a & b, [F.trim(c(t)) != "" for t in texts]),
        "fold index positive": c("fold_index") > 0,
        "timestamp falls on its trade date": F.date_format("anchor_timestamp", "yyyy-MM-dd") == c("trade_date"),
    }
    samples = _level(predictions, sample, rules, [], F.count(F.lit(1)).alias("n"))
    unique = {"sample unique per model and fold": c("n") == 1}
    totals = _level(samples, [], unique, list(rules), _empty("n").alias("predictions not empty"))
    return _rules(totals, ["predictions not empty", *rules, *unique])


def identity_checks(
    predictions: DataFrame, *, dataset_version: str, models: list[str], folds: list[int]
) -> DataFrame:
    """Predictions belong to the requested dataset, models, folds and the test split."""
    c = F.col
    return _counts(
        predictions,
        {
            "dataset version": c("dataset_version") == dataset_version,
            "known model": c("model_name").isin(models),
            "known fold": c("fold_index").isin(folds),
            "test split": c("split") == "test",
        },
    )


def window_checks(samples: DataFrame, history: int, feature_count: int) -> DataFrame:
    """Model input: ``[T, F]`` windows of finite numbers with a finite target."""
    finite = F.forall("window", lambda row: F.forall(row, lambda x: is_finite(x)))
    widths = F.forall("window", lambda row: F.size(row) == feature_count)
    return _counts(
        samples,
        {
            "window length": F.size("window") == history,
            "window width": widths,
            "window finite": finite,
            "target finite": is_finite(F.col("target")),
        },
    )


SCHEMAS = {
    "rows": ROWS_SCHEMA,
    "quality": QUALITY_SCHEMA,
    "folds": FOLD_INDEX_SCHEMA,
    "predictions": PREDICTION_SCHEMA,
}
