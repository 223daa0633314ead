"""Sample anchors, global row positions and history windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from depthframe.functions.book import is_finite
from depthframe.operators.features import all_finite
from depthframe.operators.sessions import WHOLE, Slicing, running_max
from depthframe.schema import KEY

CHUNK_ROWS = 65_536
#: Rows of whole sessions that a task takes together; a stored dataset keeps their number as ``PART``.
ROWS_PER_PART = 500_000
PART = "storage_part"


def _true(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(False))


def add_row_valid(df: DataFrame, outputs: list[str]) -> DataFrame:
    """Book, features and normalised values all usable."""
    valid = _true("book_valid") & _true("feature_valid") & _true("normalization_valid")
    return df.withColumn("row_valid", valid & all_finite(outputs))


def mark_anchors(
    df: DataFrame, *, history: int, target_column: str, slicing: Slicing = WHOLE
) -> DataFrame:
    """Flag rows that end ``history`` consecutive valid rows and have a usable target.

    The run length is the distance to the last invalid row: one running maximum instead
    of a frame of ``history`` rows.
    """
    df = slicing.add(df)
    bad_at = F.when(~F.col("row_valid"), F.col("row_no"))
    df = running_max(df, bad_at, "_bad", slicing, ["row_no"])
    run = F.col("row_no") - F.coalesce(F.col("_bad"), F.lit(-1))
    target = _true("target_valid") & is_finite(F.col(target_column)) & is_finite(F.col("future_mid"))
    return slicing.drop(df.withColumn("is_anchor", (run >= history) & target).drop("_bad"))


def session_offsets(timeline: DataFrame) -> DataFrame:
    """First global row position of each session, counted per instrument in time order.

    Works on one row per session, so no instrument is ever sorted row by row.
    """
    sessions = timeline.groupBy(*KEY).agg(
        F.count(F.lit(1)).alias("session_rows"), F.min("timestamp").alias("_first")
    )
    earlier = (
        Window.partitionBy("ticker")
        .orderBy("trade_date", "_first")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    start = F.coalesce(F.sum("session_rows").over(earlier), F.lit(0))
    return sessions.withColumn("session_start_index", start).drop("_first")


def add_global_index(df: DataFrame, offsets: DataFrame) -> DataFrame:
    out = df.join(offsets.select(*KEY, "session_start_index"), KEY)
    return out.withColumn("global_index", F.col("session_start_index") + F.col("row_no"))


def scaling_input(df: DataFrame, features: list[str], target_column: str) -> DataFrame:
    """Only what scaling and ``storage_rows`` need: the rows cross into Python and back."""
    needed = [
        *KEY, "timestamp", "row_no", "book_valid", "feature_valid", "mid_price", "future_mid",
        "target_valid", target_column, "BIDp1", "ASKp1",
    ]
    return df.select(*dict.fromkeys([*needed, *features]))


def storage_rows(df: DataFrame, outputs: list[str], target_column: str) -> DataFrame:
    """Dense single-precision row table: what a published dataset stores."""
    return df.select(
        *KEY,
        "timestamp",
        "global_index",
        "session_start_index",
        "row_no",
        F.expr("array(" + ", ".join(f"float(`{c}`)" for c in outputs) + ")").alias("features"),
        F.col(target_column).cast("float").alias("target"),
        "row_valid",
        _true("target_valid").alias("target_valid"),
        F.col("mid_price").cast("float").alias("mid_t"),
        F.col("future_mid").cast("float").alias("future_mid"),
        F.col("BIDp1").cast("float").alias("bid1"),
        F.col("ASKp1").cast("float").alias("ask1"),
        "is_anchor",
    )


def anchors(rows: DataFrame) -> DataFrame:
    """Fold-index columns of every anchor."""
    return rows.filter("is_anchor").select(
        "ticker",
        F.col("global_index").alias("global_anchor_index"),
        "session_start_index",
        F.col("row_no").alias("anchor_index"),
        "trade_date",
        "session_id",
        F.col("timestamp").alias("anchor_timestamp"),
    )


def sample_meta(rows: DataFrame) -> DataFrame:
    """Per-anchor context; the spread is taken between the stored single-precision quotes."""
    return rows.filter("is_anchor").select(
        *KEY,
        F.col("timestamp").alias("anchor_timestamp"),
        F.col("mid_t").cast("double").alias("mid_t"),
        F.col("future_mid").cast("double").alias("future_mid"),
        F.col("bid1").cast("double").alias("bid1"),
        F.col("ask1").cast("double").alias("ask1"),
        (F.col("ask1").cast("double") - F.col("bid1").cast("double")).alias("spread"),
        F.col("target").cast("double").alias("target"),
    )


def chunked(rows: DataFrame, context: int, size: int = CHUNK_ROWS) -> DataFrame:
    """Cut sessions into ``size``-row chunks, each with the ``context`` rows before it.

    Adds ``chunk`` and ``is_context``. An ordinary session is a single chunk and nothing is
    copied; a very large one becomes many bounded groups.
    """
    size = max(size, context, 1)
    own = F.expr(f"row_no DIV {size}")
    spill = F.col("row_no") % size >= size - context
    chunk = F.when(spill, F.array(own, own + 1)).otherwise(F.array(own))
    out = rows.withColumn("chunk", F.explode(chunk)).withColumn("is_context", F.col("chunk") != own)
    return out


def with_part(rows: DataFrame) -> DataFrame:
    """Number of the row's part, a bounded run of whole sessions; kept where a stored dataset brings it."""
    return rows if PART in rows.columns else rows.withColumn(PART, F.expr(f"session_start_index DIV {ROWS_PER_PART}"))


def window_samples(
    rows: DataFrame, history: int, size: int = CHUNK_ROWS, keys: list[str] | None = None
) -> DataFrame:
    """``window`` = the ``history`` feature vectors ending at (and including) each anchor.

    ``keys`` names further columns that separate copies of a session, such as its fold.
    """
    # A session lies in one part: naming it lets rows of a stored dataset stay where they are.
    part = [PART] if PART in rows.columns else []
    frame = (
        Window.partitionBy(*KEY, *part, *(keys or []), "chunk")
        .orderBy("row_no")
        .rowsBetween(-(history - 1), 0)
    )
    out = chunked(rows, history - 1, size).withColumn(
        "window", F.collect_list("features").over(frame)
    )
    return out.filter(F.col("is_anchor") & ~F.col("is_context")).drop("chunk", "is_context")


def flatten_window(samples: DataFrame) -> DataFrame:
    """``[T, F]`` to one vector of ``T * F`` values, oldest row first."""
    return samples.withColumn("flat", F.flatten("window"))


def last_frame(samples: DataFrame) -> DataFrame:
    """The anchor row's own feature vector."""
    return samples.withColumn("anchor_features", F.element_at("window", -1))
