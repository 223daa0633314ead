"""Ordered work inside one session, with an exact way to split very large sessions.

Normally a session is a few thousand rows and one window partition per session is
right. When a single session may hold a large share of the data, ``Slicing(seconds)``
cuts every session into fixed time slices: windows then run per slice, and what a slice
needs from earlier ones comes from a table with one row per slice. After de-duplication
a slice holds at most one row per microsecond, and a session has at most
``86400 / seconds`` slices, so both levels are bounded whatever the skew.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from depthframe.schema import KEY

SLICE = "slice"
# Slice widths in seconds that ``choose_slicing`` tries, widest first.
SLICE_WIDTHS = [None, 3600, 600, 60, 10]


def epoch_second(ts: Column) -> Column:
    """Whole seconds since 1970 of a zone-free timestamp, independent of the session zone."""
    day = F.unix_date(F.to_date(ts)).cast("bigint")
    return day * 86400 + F.hour(ts) * 3600 + F.minute(ts) * 60 + F.second(ts)


@dataclass(frozen=True)
class Slicing:
    """``seconds=None`` keeps each session whole."""

    seconds: int | None = None

    def __post_init__(self) -> None:
        if self.seconds is not None and self.seconds <= 0:
            raise ValueError("slice seconds must be > 0")

    @property
    def keys(self) -> list[str]:
        return KEY if self.seconds is None else [*KEY, SLICE]

    def of(self, ts: Column) -> Column:
        if self.seconds is None:
            return F.lit(0).cast("bigint")
        return F.floor(epoch_second(ts) / F.lit(self.seconds)).cast("bigint")

    def add(self, df: DataFrame, ts: str = "timestamp") -> DataFrame:
        return df if self.seconds is None else df.withColumn(SLICE, self.of(F.col(ts)))

    def drop(self, df: DataFrame) -> DataFrame:
        return df.drop(SLICE)


WHOLE = Slicing()


def choose_slicing(snapshots: DataFrame, max_rows: int = 4_000_000) -> Slicing:
    """Widest slice whose fullest (session, slice) group stays within ``max_rows``.

    Sessions stay whole if the whole input or the fullest session fits, which one or two
    counts settle. Only key and time columns are read, and counts are combined before the
    exchange. One second is the floor: it can hold at most a million distinct microsecond
    timestamps.
    """
    if snapshots.count() <= max_rows:
        return WHOLE
    for width in SLICE_WIDTHS:
        slicing = Slicing(width)
        groups = slicing.add(snapshots.select(*KEY, "timestamp")).groupBy(*slicing.keys).count()
        if (groups.agg(F.max("count")).first()[0] or 0) <= max_rows:
            return slicing
    return Slicing(1)


def before_slice(df: DataFrame, summaries: dict, slicing: Slicing) -> DataFrame:
    """Attach, per slice, values accumulated over the earlier slices of its session.

    ``summaries`` maps an output name to ``(aggregate, how)`` with ``how`` one of
    ``last`` (latest non-null), ``first`` (earliest, current slice included) or ``sum``.
    """
    earlier = Window.partitionBy(*KEY).orderBy(SLICE).rowsBetween(Window.unboundedPreceding, -1)
    so_far = Window.partitionBy(*KEY).orderBy(SLICE).rowsBetween(Window.unboundedPreceding, 0)
    how_to = {
        "last": lambda c: F.last(c, ignorenulls=True).over(earlier),
        "first": lambda c: F.first(c, ignorenulls=True).over(so_far),
        "sum": lambda c: F.coalesce(F.sum(c).over(earlier), F.lit(0)),
    }
    per_slice = df.groupBy(*slicing.keys).agg(*[a.alias(n) for n, (a, _) in summaries.items()])
    carried = per_slice.select(
        *slicing.keys, *[how_to[how](F.col(n)).alias(n) for n, (_, how) in summaries.items()]
    )
    return df.join(carried, slicing.keys, "left")


def running_sum(
    df: DataFrame, value: Column, out: str, slicing: Slicing = WHOLE, order: str = "timestamp"
) -> DataFrame:
    """Inclusive running sum of ``value`` along the session."""
    w = Window.partitionBy(*slicing.keys).orderBy(order)
    local = F.sum(value).over(w.rowsBetween(Window.unboundedPreceding, 0))
    if slicing.seconds is None:
        return df.withColumn(out, local)
    df = before_slice(df, {"_before": (F.sum(value), "sum")}, slicing)
    return df.withColumn(out, local + F.col("_before")).drop("_before")


def running_max(
    df: DataFrame, value: Column, out: str, slicing: Slicing = WHOLE, order: list[str] | None = None
) -> DataFrame:
    """Inclusive running maximum of a value that only grows along the session."""
    w = Window.partitionBy(*slicing.keys).orderBy(*(order or ["timestamp"]))
    local = F.max(value).over(w.rowsBetween(Window.unboundedPreceding, 0))
    if slicing.seconds is None:
        return df.withColumn(out, local)
    df = before_slice(df, {"_before": (F.max(value), "last")}, slicing)
    return df.withColumn(out, F.coalesce(local, F.col("_before"))).drop("_before")


def row_number(df: DataFrame, out: str = "row_no", slicing: Slicing = WHOLE) -> DataFrame:
    """Zero-based position of each row in its session."""
    df = slicing.add(df)
    df = running_sum(df, F.lit(1).cast("bigint"), out, slicing)
    return slicing.drop(df.withColumn(out, F.col(out) - 1))
