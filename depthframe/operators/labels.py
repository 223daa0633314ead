"""Forward-return labels from the nearest valid book near t + horizon."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from depthframe.functions.book import is_finite
from depthframe.operators.sessions import WHOLE, Slicing
from depthframe.schema import KEY, label_column, require


def _valid_mid() -> Column:
    return (
        F.coalesce(F.col("book_valid"), F.lit(False))
        & is_finite(F.col("mid_price"))
        & (F.col("mid_price") > 0)
    )


def _from_other_slices(found: DataFrame, parts: DataFrame) -> DataFrame:
    """Complete ``_before`` and ``_after`` from the nearest slices that hold an answer."""
    answered = F.when(~F.col("_q"), F.col("_at"))
    per_slice = parts.groupBy(*KEY, "_slice").agg(
        F.min_by("_answer", answered).alias("_first"), F.max_by("_answer", answered).alias("_last")
    )
    order = Window.partitionBy(*KEY).orderBy("_slice")
    earlier = order.rowsBetween(Window.unboundedPreceding, -1)
    later = order.rowsBetween(1, Window.unboundedFollowing)
    carried = per_slice.select(
        *KEY, "_slice",
        F.last("_last", ignorenulls=True).over(earlier).alias("_earlier"),
        F.first("_first", ignorenulls=True).over(later).alias("_later"),
    )
    return (
        found.join(carried, [*KEY, "_slice"])
        .withColumns({"_before": F.coalesce("_before", "_earlier"), "_after": F.coalesce("_after", "_later")})
        .drop("_earlier", "_later")
    )


def add_labels(
    timeline: DataFrame,
    *,
    horizon_seconds: int = 60,
    tolerance_seconds: int = 3,
    slicing: Slicing = WHOLE,
) -> DataFrame:
    """Append ``future_timestamp, future_mid``, both returns and ``target_valid``.

    Each row plays two parts: a question at t + horizon and, if its mid is valid, an
    answer at t. Both are put on one axis per session; one ordered window gives each
    question the last answer at or before it and the first after it; the nearer wins, the
    later on a tie. Splitting a row into its parts keeps the session partitioning, so no join
    and no extra exchange is needed, and the wide row travels packed with its question only.
    In sliced mode a slice gets the last answer before it and the first after it from one
    summary row per slice, so nothing is copied however wide the tolerance is.
    """
    require(timeline, [*KEY, "timestamp", "mid_price", "book_valid"], "label input")
    if horizon_seconds <= 0 or tolerance_seconds < 0:
        raise ValueError("horizon must be > 0 and tolerance >= 0")
    log_name, simple_name = label_column(horizon_seconds), label_column(horizon_seconds, "simple")
    outputs = ["future_timestamp", "future_mid", log_name, simple_name, "target_valid"]
    base = timeline.drop(*outputs)
    payload = [c for c in base.columns if c not in KEY]
    tol = F.expr(f"INTERVAL '{tolerance_seconds}' SECOND")
    ts = F.col("timestamp")
    asked_at = ts + F.expr(f"INTERVAL '{horizon_seconds}' SECOND")

    # (axis time, slice, is_question)
    question = F.array(F.struct(asked_at.alias("at"), slicing.of(asked_at).alias("s"), F.lit(True).alias("q")))
    kind = "array<struct<at:timestamp_ntz,s:bigint,q:boolean>>"
    answer = F.array(F.struct(ts.alias("at"), slicing.of(ts).alias("s"), F.lit(False).alias("q")))
    answers = F.when(_valid_mid(), answer).otherwise(F.array().cast(kind))
    parts = base.withColumn("_p", F.explode(F.concat(question, answers)))
    is_question = F.col("_p.q")
    parts = parts.select(
        *KEY,
        F.col("_p.at").alias("_at"),
        F.col("_p.s").alias("_slice"),
        is_question.alias("_q"),
        F.when(
            ~is_question,
            F.struct(F.col("timestamp").alias("ts"), F.col("mid_price").alias("mid")),
        ).alias("_answer"),
        F.when(is_question, F.struct(*payload)).alias("_row"),
    )
    keys = KEY if slicing.seconds is None else [*KEY, "_slice"]
    # Answers sort before the question of the same instant, so they count as "before".
    order = f"PARTITION BY {', '.join(keys)} ORDER BY _at, _q"
    found = (
        parts.withColumns(
            {
                "_before": F.expr(f"last(_answer, true) OVER ({order} ROWS UNBOUNDED PRECEDING)"),
                "_after": F.expr(f"lead(_answer, 1) IGNORE NULLS OVER ({order})"),
            }
        )
        .filter("_q")
        .select(*KEY, "_slice", "_at", "_before", "_after", "_row.*")
    )
    if slicing.seconds is not None:
        found = _from_other_slices(found, parts)
    before, after, at = F.col("_before"), F.col("_after"), F.col("_at")
    nearest = F.when(before.isNull(), after).when(after.isNull(), before).otherwise(
        F.when(after["ts"] - at <= at - before["ts"], after).otherwise(before)
    )
    found = found.withColumn("_hit", nearest)
    hit = F.col("_hit")
    found = found.withColumn(
        "_hit", F.when(hit["ts"].between(at - tol, at + tol), hit)
    )
    valid = _valid_mid() & hit.isNotNull()
    ratio = hit["mid"] / F.col("mid_price")
    return found.withColumns(
        {
            "future_timestamp": hit["ts"],
            "future_mid": hit["mid"],
            log_name: F.when(valid, F.log(ratio)),
            simple_name: F.when(valid, ratio - 1.0),
            "target_valid": valid,
        }
    ).select(*base.columns, *outputs)
