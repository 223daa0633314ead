"""Session timeline: de-duplicated snapshots on a regular grid with bounded forward fill."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from depthframe.functions import book
from depthframe.operators.sessions import WHOLE, Slicing, before_slice, running_sum
from depthframe.schema import (
    BOOK_COLUMNS,
    CLEAN_COLUMNS,
    KEY,
    RAW_COLUMNS,
    TRADE_COLUMNS,
    require,
)


def latest_books(snapshots: DataFrame) -> DataFrame:
    """Last row in file order per session timestamp, its values packed in ``book``.

    An aggregate rather than a window, so that copies of one hot timestamp are combined
    before the exchange. ``n_copies`` is how many source rows shared the timestamp.
    """
    require(snapshots, [*KEY, "timestamp", "row_index", *RAW_COLUMNS], "snapshots")
    newest = F.max_by(F.struct(*RAW_COLUMNS), "row_index").alias("book")
    return snapshots.groupBy(*KEY, "timestamp").agg(newest, F.count(F.lit(1)).alias("n_copies"))


def deduplicate(snapshots: DataFrame) -> DataFrame:
    """The same rows with their columns spread out again."""
    return latest_books(snapshots).select(*KEY, "timestamp", "book.*", "n_copies")


def duplicate_counts(snapshots: DataFrame) -> DataFrame:
    """Rows beyond the first for each timestamp, per session."""
    per_timestamp = snapshots.groupBy(*KEY, "timestamp").agg(F.count(F.lit(1)).alias("n"))
    return per_timestamp.groupBy(*KEY).agg(
        F.sum("n").alias("row_count"), F.sum(F.col("n") - 1).alias("duplicate_count")
    )


def complete_timeline(
    observed: DataFrame,
    *,
    interval_seconds: int,
    max_ffill_gap_seconds: int,
    slicing: Slicing = WHOLE,
) -> DataFrame:
    """Fill the grid between the first and last observation, then clean each row.

    Every observed row knows its predecessor, so it can emit the grid points that lie
    strictly between the two itself, together with the book they inherit: one exchange on
    the session and one sort do the grid union, the exact join and the backward match.
    ``observed`` is the output of ``latest_books``: books stay packed until the last step.
    Adds ``row_no`` (position in the session) and keeps ``n_copies`` (null on grid rows).
    """
    if interval_seconds <= 0 or max_ffill_gap_seconds < 0:
        raise ValueError("interval must be > 0 and max gap >= 0")
    # ``_book`` is null where all levels are; what an empty book keeps is in ``_rest``.
    levels = ", ".join(f"book.{c}" for c in BOOK_COLUMNS)
    rest = ", ".join(f"book.{c}" for c in TRADE_COLUMNS)
    rows = slicing.add(observed).selectExpr(
        *slicing.keys,
        "timestamp",
        "n_copies",
        f"IF(coalesce({levels}) IS NULL, NULL, book) AS _book",
        f"IF(coalesce({levels}) IS NULL, NULL, timestamp) AS _book_ts",
        f"IF(coalesce({levels}) IS NULL, struct({rest}), NULL) AS _rest",
    )
    past = (
        Window.partitionBy(*slicing.keys)
        .orderBy("timestamp")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    seen = past.rowsBetween(Window.unboundedPreceding, 0)
    prev_ts = F.last("timestamp").over(past)
    first_ts = F.first("timestamp").over(seen)
    prev_book = F.last("_book", ignorenulls=True).over(past)
    prev_book_ts = F.last("_book_ts", ignorenulls=True).over(past)
    if slicing.seconds is not None:
        rows = before_slice(
            rows,
            {
                "_c_ts": (F.max("timestamp"), "last"),
                "_c_first": (F.min("timestamp"), "first"),
                "_c_book": (F.max_by("_book", "_book_ts"), "last"),
                "_c_book_ts": (F.max("_book_ts"), "last"),
            },
            slicing,
        )
        prev_ts = F.coalesce(prev_ts, F.col("_c_ts"))
        first_ts = F.col("_c_first")
        prev_book = F.coalesce(prev_book, F.col("_c_book"))
        prev_book_ts = F.coalesce(prev_book_ts, F.col("_c_book_ts"))
    rows = rows.withColumns(
        {
            "_prev_ts": prev_ts,
            "_first_ts": first_ts,
            "_prev_book": prev_book,
            "_prev_book_ts": prev_book_ts,
        }
    )

    # Grid points first + j * interval strictly between the predecessor and this row.
    step = interval_seconds * 1_000_000
    rows = rows.withColumn(
        "_lo", F.expr(f"timestampdiff(MICROSECOND, _first_ts, _prev_ts) DIV {step} + 1")
    ).withColumn(
        "_hi", F.expr(f"(timestampdiff(MICROSECOND, _first_ts, timestamp) - 1) DIV {step}")
    )
    rows = rows.withColumn(
        "_points",
        F.when(F.col("_hi") >= F.col("_lo"), F.col("_hi") - F.col("_lo") + 1).otherwise(F.lit(0)),
    )
    rows = running_sum(rows, F.col("_points") + 1, "_end", slicing)
    steps = F.when(F.col("_points") > 0, F.sequence("_lo", "_hi")).otherwise(
        F.array().cast("array<bigint>")
    )
    rows = rows.withColumn("_j", F.explode(F.concat(steps, F.array(F.lit(None).cast("bigint")))))

    # _j is null on observed rows; _fill marks rows that can only take an earlier book.
    rows = rows.selectExpr(
        *KEY,
        f"IF(_j IS NULL, timestamp, _first_ts + _j * INTERVAL '{interval_seconds}' SECOND) AS timestamp",
        "_end - 1 - IF(_j IS NULL, 0, _hi - _j + 1) AS row_no",
        "IF(_j IS NULL, n_copies, NULL) AS n_copies",
        "IF(_j IS NULL, double(coalesce(timestampdiff(SECOND, _prev_ts, timestamp), 0)), NULL)"
        " AS snapshot_gap_seconds",
        "_j IS NOT NULL OR _book IS NULL AS _fill",
        "IF(_j IS NOT NULL OR _book IS NULL, _prev_book, _book) AS _source",
        "IF(_j IS NOT NULL OR _book IS NULL, _prev_book_ts, _book_ts) AS _source_ts",
        "IF(_j IS NULL, _rest, NULL) AS _rest",
    )
    rows = rows.withColumn(
        "staleness_seconds", F.expr("double(timestampdiff(SECOND, _source_ts, timestamp))")
    ).withColumn(
        "is_ffilled",
        F.expr(f"coalesce(_fill AND staleness_seconds <= {max_ffill_gap_seconds}, false)"),
    )
    use = "is_ffilled OR NOT _fill"
    rows = rows.selectExpr(
        *[c for c in rows.columns if c not in ("_source", "_source_ts", "_fill", "_rest")],
        *[f"IF({use}, _source.{c}, NULL) AS {c}" for c in BOOK_COLUMNS],
        *[f"IF({use}, _source.{c}, _rest.{c}) AS {c}" for c in TRADE_COLUMNS],
    )
    rows = rows.withColumns(
        {
            "mid_price": book.mid_price(),
            "book_valid": book.book_valid(),
            "seconds": book.time_of_day(F.col("timestamp")),
        }
    )
    return rows.select(*CLEAN_COLUMNS, "row_no", "n_copies")


def clean_sessions(
    snapshots: DataFrame,
    *,
    interval_seconds: int = 3,
    max_ffill_gap_seconds: int = 6,
    slicing: Slicing = WHOLE,
) -> DataFrame:
    """Raw session snapshots to the completed, cleaned timeline."""
    return complete_timeline(
        latest_books(snapshots),
        interval_seconds=interval_seconds,
        max_ffill_gap_seconds=max_ffill_gap_seconds,
        slicing=slicing,
    )
