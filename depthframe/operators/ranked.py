"""Python metrics of sorted scores, for groups and draws of any size.

A ``RankedMetric`` is two Python functions: a score per row, and the share of the value that falls on the
first k of n rows in rising order of the score. Quantiles, trimmed means and tail means have this
form. Spark orders the rows by ranges of scores, so no task needs a whole group: it needs only
how many drawn rows lie in the ranges below. A draw is a weight per row; equal scores of a chunk are one.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from depthframe.functions.metrics import P, T, finite_pair
from depthframe.operators.chunks import (
    Blocks,
    arrow_fields,
    drawn_weights,
    head,
    in_order,
    part_numbers,
    stream_groups,
    vectors,
    with_batches,
)
from depthframe.operators.ranks import BEFORE, cut_points, ensure_checkpoint_dir, running_total

#: Rows of a group that one task orders.
RANK_ROWS = 250_000


@dataclass(frozen=True)
class RankedMetric:
    """The sum of score * (share(k + 1, n) - share(k, n)) over the rows k = 0 .. n - 1 by rising score."""

    #: (predictions, targets) of some rows, finite pairs only, to their scores.
    score: Callable[[np.ndarray, np.ndarray], np.ndarray]
    #: Rises from 0 at k = 0 to 1 at k = n; k and n are arrays or numbers.
    share: Callable[[np.ndarray, np.ndarray], np.ndarray]


def _scored(rows: DataFrame, metric: RankedMetric) -> DataFrame:
    def score(p: pd.Series, t: pd.Series) -> pd.Series:
        out, ok = np.full(len(p), np.nan), np.isfinite(p.to_numpy(float)) & np.isfinite(t.to_numpy(float))
        if ok.any():
            out[ok] = metric.score(p.to_numpy(float)[ok], t.to_numpy(float)[ok])
        return pd.Series(out)

    made = F.pandas_udf(score, "double")
    return rows.withColumn("_score", made(F.col(P).cast("double"), F.col(T).cast("double")))


def _part_of_value(metric: RankedMetric, score: np.ndarray, before: np.ndarray, times: np.ndarray, n) -> np.ndarray:
    """What rows add to the value that stand ``times`` times behind ``before`` others."""
    gain = metric.share(before + times, n) - metric.share(before, n)
    return np.where(gain != 0, score * gain, 0.0)


def _number(value: Column) -> Column:
    return F.when(~F.isnan(value) & (F.abs(value) != float("inf")), value)


def ranked_metric(predictions: DataFrame, metric: RankedMetric, name: str, group: list[str]) -> DataFrame:
    """The metric of each group, from counts of its scores."""
    rows = _scored(predictions.filter(finite_pair()).select(*group, P, T), metric)
    counts = rows.groupBy(*group, "_score").agg(F.count(F.lit(1)).alias("_n"))
    placed = running_total(counts, group, ["_score"], F.col("_n"), "_before", whole="_all")

    def added(score: pd.Series, before: pd.Series, times: pd.Series, n: pd.Series) -> pd.Series:
        return pd.Series(_part_of_value(metric, *(x.to_numpy() for x in (score, before, times, n))))

    value = F.pandas_udf(added, "double")("_score", "_before", "_n", "_all")
    return placed.groupBy(*group).agg(F.sum(value).alias(name)).withColumn(name, _number(F.col(name)))


def _packed(score: np.ndarray, weights: np.ndarray) -> dict:
    """Rising distinct scores with the sum of their weights, one line a draw, in as few bytes as they need."""
    order = np.argsort(score, kind="stable")
    score = score[order]
    new = np.append(True, score[1:] != score[:-1])
    starts = np.flatnonzero(new)
    times = np.add.reduceat(weights[:, order], starts, axis=1, dtype=np.int64)
    size = next(b for b in (1, 2, 4) if times.max() < 256**b)
    return {
        "_scores": score[starts].tobytes(), "_times": times.astype(f"u{size}").tobytes(), "_bytes": size,
        "_sums": times.sum(axis=1).tolist(),
    }


def _unpacked(block: dict, draws: int) -> tuple[np.ndarray, np.ndarray]:
    times = np.frombuffer(block["_times"], f"u{block['_bytes']}").reshape(draws, -1)
    return np.frombuffer(block["_scores"], float), times


def ranked_draws(
    rows: DataFrame,
    chunked: Callable[[DataFrame], DataFrame],
    metric: RankedMetric,
    *,
    draws: int,
    per_task: int,
    group: list[str],
    session: list[str],
    sample_order: list[str],
    blocks: Blocks,
) -> DataFrame:
    """``(group, draw, value)``; draws without a valid row are left out.

    ``rows`` hold ``_seed`` and ``_session``; ``chunked`` cuts them by ``session_chunks``.
    """
    scored = _scored(rows.filter(finite_pair()), metric)
    cuts = cut_points(scored, group, {"_score": F.col("_score")}, RANK_ROWS).by_group()
    chunks = with_batches(chunked(rows), draws, per_task)

    def packed(batches):
        table = in_order(pa.Table.from_batches(batches), sample_order)
        first, keys = table["_first"][0].as_py(), {g: table[g][0].as_py() for g in group}
        p, t = vectors(table)
        ok = np.isfinite(p) & np.isfinite(t)
        if not ok.any():
            return
        weights = drawn_weights(table, range(first, min(draws, first + per_task)), blocks)[:, ok]
        score = np.asarray(metric.score(p[ok], t[ok]), float)
        part = part_numbers(score, np.array(cuts.get(tuple(keys.values()), {"_score": []})["_score"], float))
        for value in np.unique(part):
            here = part == value
            row = keys | {"_part": int(value), "_first": first} | _packed(score[here], weights[:, here])
            yield pa.RecordBatch.from_pylist([row], made)

    text = f"{head(rows, group)}, _part int, _first int, _scores binary, _times binary, _bytes int, _sums array<bigint>"
    made = pa.schema([*arrow_fields(rows, group), ("_part", pa.int32()), ("_first", pa.int32()), ("_scores", pa.binary()),
                      ("_times", pa.binary()), ("_bytes", pa.int32()), ("_sums", pa.list_(pa.int64()))])
    ensure_checkpoint_dir(rows.sparkSession)
    stored = stream_groups(chunks, [*session, "_chunk", "_first"], packed, text).checkpoint()

    # How many rows of each draw lie in the parts before, and in all.
    at = [*group, "_part", "_first"]
    sums = stored.select(*at, F.posexplode("_sums").alias("_line", "_n")).groupBy(*at, "_line").agg(F.sum("_n").alias("_n"))
    same = Window.partitionBy(*group, "_first", "_line")
    before = F.coalesce(F.sum("_n").over(same.orderBy("_part").rowsBetween(*BEFORE)), F.lit(0))
    shifts = sums.withColumns({"_before": before, "_all": F.sum("_n").over(same)})
    # New names keep the two sides of the grouping apart: both derive from the same rows.
    other = [f"_of_{c}" for c in at]
    shifts = shifts.select(*[F.col(c).alias(o) for c, o in zip(at, other)], "_line", "_before", "_all")

    def valued(left: pa.Table, right: pa.Table) -> pa.Table:
        right = right.sort_by("_line")
        before, every = right["_before"].to_numpy(), right["_all"].to_numpy()
        got = [_unpacked(b, len(right)) for b in left.select(["_scores", "_times", "_bytes"]).to_pylist()]
        score = np.concatenate([s for s, _ in got])
        order = np.argsort(score, kind="stable")
        score, first, out = score[order], left["_first"][0].as_py(), []
        for line in range(len(right)):
            times = np.concatenate([w[line] for _, w in got])[order].astype(np.int64)
            ahead = before[line] + np.cumsum(times) - times
            out.append(_part_of_value(metric, score, ahead, times, every[line]).sum() if every[line] else 0.0)
        data = {g: pa.repeat(left[g][0], len(out)) for g in group}
        data |= {"draw": pa.array(np.arange(first, first + len(out))), "_n": pa.array(every), "_v": pa.array(out, pa.float64())}
        return pa.table(data)

    pairs = stored.groupBy(*at).cogroup(shifts.groupBy(*other))
    parts = pairs.applyInArrow(valued, f"{head(rows, group)}, draw bigint, _n bigint, _v double")
    return parts.filter("_n > 0").groupBy(*group, "draw").agg(_number(F.sum("_v")).alias("value"))
