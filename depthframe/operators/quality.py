"""Daily data-quality report over the cleaned timeline."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from depthframe.functions import book
from depthframe.schema import DAY, QUALITY_SCHEMA


def _count_if(flag: Column) -> Column:
    return F.count(F.when(flag, 1))


def _share(flag: Column) -> Column:
    return F.avg(flag.cast("double"))


def daily_quality(timeline: DataFrame, days: DataFrame | None = None) -> DataFrame:
    """One row per instrument and trade date.

    Gaps are whole seconds within a day, so the exact percentile keeps at most 86,400
    distinct values per group. ``days`` (ticker, trade_date, duplicate_count) adds zero
    rows for days whose files hold no snapshot inside any session.
    """
    gap = F.when(F.col("snapshot_gap_seconds") > 0, F.col("snapshot_gap_seconds"))
    report = timeline.groupBy(*DAY).agg(
        F.count(F.lit(1)).alias("row_count"),
        _share(book.whole_book_missing()).alias("missing_ratio"),
        F.coalesce(F.sum(F.col("n_copies") - 1), F.lit(0)).alias("duplicate_count"),
        _count_if(book.crossed()).alias("crossed_book_count"),
        _count_if(book.bid_side_valid() != book.ask_side_valid()).alias("one_side_missing_count"),
        F.coalesce(F.max(gap), F.lit(0.0)).alias("max_gap"),
        F.coalesce(F.percentile(gap, F.lit(0.95)), F.lit(0.0)).alias("p95_gap"),
        _share(F.col("is_ffilled")).alias("stale_snapshot_ratio"),
        _count_if(book.level_order_violation()).alias("invalid_level_order_count"),
    )
    if days is not None:
        known = [f for f in QUALITY_SCHEMA if f.name not in DAY]
        report = days.select(*DAY).distinct().join(report, DAY, "left")
        report = report.withColumns(
            {f.name: F.coalesce(F.col(f.name), F.lit(0).cast(f.dataType)) for f in known}
        )
    return report.select(*[F.col(f.name).cast(f.dataType) for f in QUALITY_SCHEMA])
