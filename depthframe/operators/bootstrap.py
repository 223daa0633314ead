"""Moving-block bootstrap intervals.

Blocks never cross a session. Block starts are an integer hash of (seed, resample,
session, block), so they do not depend on partitioning and SQL can repeat them. Every
metric but the rank correlation is a function of sums, and a block's sum is the difference of
two prefix sums: a resample costs one lookup per block and not per row. Other metrics weigh the rows of
chunks of sessions (``operators.chunks``). Only opaque Python metrics take a group in one task (``operators.draws``).
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from depthframe.functions.metrics import P, T, check_metrics, finite_pair
from depthframe.operators import draws as group_draws
from depthframe.operators.draws import (
    PythonMetric,
    drawn_values,
    metric_by_weights,
    python_metric,
)
from depthframe.operators.chunks import (
    chunk_blocks,
    drawn_weights,
    head,
    in_order,
    session_chunks,
    stream_groups,
    vectors,
    with_batches,
)
from depthframe.operators.rank_draws import rank_draws
from depthframe.operators.ranked import RankedMetric, ranked_draws, ranked_metric
from depthframe.plans.evaluate import CANDIDATE, SAMPLE, custom_metric, evaluate
from depthframe.schema import METRICS

Metric = Callable[[Column, Column], Column]

# The hash. All products stay below 2**63.
PRIME = 2147483647
SEED_STEP, DRAW_STEP, BLOCK_STEP = 1000003, 7919, 104729
MULTIPLIER, ADDEND, SQUARE_ADDEND = 48271, 11, 12345

MAX_SESSION_ROWS = 200_000
MAX_DRAWN_ROWS = 5_000_000
CHUNK_ROWS = 100_000
LISTED_ROWS = 10_000
MAX_BLOCKS = 200_000
SUMS = [
    "n", "abs_error", "sq_error", "p", "t", "pp", "tt", "pt", "nonzero", "hit",
    "pred_up", "real_up", "both_up", "pred_down", "real_down", "both_down",
]
# Smallest and largest value of each side, so that a constant one is known exactly.
LOWEST, HIGHEST = ["p_min", "t_min"], ["p_max", "t_max"]
CARRIED = [*SUMS, *LOWEST, *HIGHEST]


def session_number(ticker: Column, trade_date: Column, session_id: Column) -> Column:
    """28-bit number of a session, equal on every run and engine."""
    digest = F.md5(F.concat_ws("|", ticker, trade_date, session_id))
    return F.conv(F.substring(digest, 1, 7), 16, 10).cast("bigint")


def block_start(seed, draw, session, block, choices):
    """Hash to a start in ``[0, choices)``; works on NumPy arrays and Spark columns."""
    x = (seed * SEED_STEP + draw * DRAW_STEP + block * BLOCK_STEP + session) % PRIME
    x = (x * MULTIPLIER + ADDEND) % PRIME
    x = (x * x + SQUARE_ADDEND) % PRIME
    x = (x * x + ADDEND) % PRIME
    return x % choices


def row_terms(p: np.ndarray, t: np.ndarray, p0: float, t0: float) -> np.ndarray:
    """Per-row contributions in the order of ``SUMS``; invalid pairs contribute nothing."""
    ok = np.isfinite(p) & np.isfinite(t)
    p, t = np.where(ok, p, 0.0), np.where(ok, t, 0.0)
    e, cp, ct = p - t, p - p0, t - t0
    up, down, rup, rdown = p > 0, p < 0, t > 0, t < 0
    cols = [
        np.ones_like(p), np.abs(e), e * e, cp, ct, cp * cp, ct * ct, cp * ct, t != 0,
        (np.sign(p) == np.sign(t)) & (t != 0), up, rup, up & rup, down, rdown, down & rdown,
    ]
    return np.stack([np.where(ok, c, 0.0) for c in cols], axis=1)


def sums_by_draw(terms: np.ndarray, draw: np.ndarray, lo: np.ndarray, hi: np.ndarray, draws: int):
    """Sum the rows of each block ``[lo, hi)`` into its resample."""
    prefix = np.vstack([np.zeros(terms.shape[1]), np.cumsum(terms, axis=0)])
    block = prefix[hi] - prefix[lo]
    return np.stack([np.bincount(draw, block[:, j], draws) for j in range(terms.shape[1])], axis=1)


def least_by_draw(x: np.ndarray, draw: np.ndarray, lo: np.ndarray, hi: np.ndarray, draws: int) -> np.ndarray:
    """Smallest ``x`` in any block ``[lo, hi)`` of each resample; infinite without a block."""
    level = np.frexp((hi - lo).astype("float64"))[1] - 1
    found, table, span = np.empty(len(lo)), x, 1
    for k in range(int(level.max(initial=-1)) + 1):
        at = level == k
        found[at] = np.minimum(table[lo[at]], table[hi[at] - span])
        table, span = np.minimum(table[:-span], table[span:]) if len(table) > span else table, 2 * span
    out = np.full(draws, np.inf)
    np.minimum.at(out, draw, found)
    return out


def carried_by_draw(p, t, p0: float, t0: float, draw, lo, hi, draws: int) -> np.ndarray:
    """All ``CARRIED`` columns of each resample."""
    ok = np.isfinite(p) & np.isfinite(t)
    sides = [np.where(ok, x, np.inf) for x in (p, t)] + [np.where(ok, -x, np.inf) for x in (p, t)]
    least = [least_by_draw(x, draw, lo, hi, draws) for x in sides]
    sums = sums_by_draw(row_terms(p, t, p0, t0), draw, lo, hi, draws)
    return np.column_stack([sums, least[0], least[1], -least[2], -least[3]])


def _emit(names: list[str], table: pa.Table, sums: np.ndarray) -> pa.Table:
    used = np.flatnonzero(sums[:, 0] > 0)
    data = {g: pa.repeat(table[g][0], len(used)) for g in names}
    data["draw"] = pa.array(used.astype("int64"))
    data |= {s: pa.array(sums[used, j]) for j, s in enumerate(CARRIED)}
    return pa.table(data)


def resample_sums(
    predictions: DataFrame,
    *,
    draws: int,
    block: int,
    seed: int,
    group: list[str],
    sample_order: list[str],
    max_session_rows: int = MAX_SESSION_ROWS,
) -> DataFrame:
    """One row per (group, draw) with the summed ``SUMS`` of that resample."""
    rows = _numbered(predictions, seed, group)
    session = [*group, "trade_date", "session_id"]
    schema = ", ".join([head(rows, group), "draw bigint", *[f"{s} double" for s in CARRIED]])

    def blocks(seed: int, draw: int, session: int, size: int):
        return session_blocks(seed, draw, session, size, block)

    def summed(table: pa.Table) -> pa.Table:
        table = in_order(table, sample_order)
        centre = [table[c][0].as_py() for c in ("_p0", "_t0")]
        p, t = vectors(table)
        step, sums = max(1, MAX_BLOCKS * block // len(p)), []
        for first in range(0, draws, step):
            numbers = range(first, min(draws, first + step))
            found = [chunk_blocks(table, d, blocks) for d in numbers]
            draw = np.repeat(np.arange(len(numbers)), [len(lo) for lo, _ in found])
            lo, hi = (np.concatenate(x) for x in zip(*found))
            sums.append(carried_by_draw(p, t, *centre, draw, lo, hi, len(numbers)))
        return _emit(group, table, np.concatenate(sums))

    rows = rows.select(*dict.fromkeys([*session, *sample_order]), P, T, "_seed", "_session", "_p0", "_t0")
    chunks = session_chunks(rows, session, sample_order, max_session_rows)
    partial = chunks.groupBy(*session, "_chunk").applyInArrow(summed, schema)
    how = {**dict.fromkeys(SUMS, F.sum), **dict.fromkeys(LOWEST, F.min), **dict.fromkeys(HIGHEST, F.max)}
    return partial.groupBy(*group, "draw").agg(*[how[c](c).alias(c) for c in CARRIED])


def _numbered(predictions: DataFrame, seed: int, group: list[str]) -> DataFrame:
    """Add the fold's seed, the session number and a centre for the moment sums.

    The centre is the middle of the group's range: exact for a constant column.
    """
    ok = finite_pair()
    centre = predictions.groupBy(*group).agg(
        *[
            ((F.min(F.when(ok, F.col(c))) + F.max(F.when(ok, F.col(c)))) / 2.0).alias(n)
            for c, n in ((P, "_p0"), (T, "_t0"))
        ]
    )
    centre = centre.withColumns({c: F.coalesce(F.col(c), F.lit(0.0)) for c in ("_p0", "_t0")})
    # One row a group. A join by the group would sort whole groups in a task.
    return seeded(predictions.join(F.broadcast(centre), group), seed)


def _estimates() -> dict[str, Column]:
    c = F.col
    n = c("n")

    def share(a: str, b: str) -> Column:
        return F.when(c(b) > 0, c(a) / c(b))

    vp = c("pp") - c("p") * c("p") / n
    vt = c("tt") - c("t") * c("t") / n
    cov = c("pt") - c("p") * c("t") / n
    varies = (c("p_min") < c("p_max")) & (c("t_min") < c("t_max"))
    return {
        "mae": c("abs_error") / n,
        "rmse": F.sqrt(c("sq_error") / n),
        "ts_ic": F.when(varies & (vp > 0) & (vt > 0), cov / (F.sqrt(vp) * F.sqrt(vt))),
        "direction_accuracy": share("hit", "nonzero"),
        "up_precision": share("both_up", "pred_up"),
        "up_recall": share("both_up", "real_up"),
        "down_precision": share("both_down", "pred_down"),
        "down_recall": share("both_down", "real_down"),
    }


def session_blocks(seed: int, draw: int, session: int, size: int, block: int):
    """Blocks [lo, hi) that a draw takes from a session of ``size`` rows; the last one is cut to fit."""
    length = min(block, size)
    b = np.arange(-(-size // length), dtype="int64")
    lo = block_start(seed, draw, int(session), b, size - length + 1)
    return lo, lo + np.minimum(length, size - b * length)


def resampled_values(
    predictions: DataFrame, statistics: dict, *, draws: int, block: int, seed: int, group: list[str],
    sample_order: list[str],
) -> DataFrame:
    """``(group, draw, metric, value)`` of statistics that need the drawn rows themselves."""
    fold = F.col("fold_index") if "fold_index" in predictions.columns else F.lit(0)
    number = session_number(F.col("ticker"), F.col("trade_date"), F.col("session_id"))
    rows = predictions.withColumns({"_seed": (fold + seed).cast("bigint"), "_session": number})

    def blocks(seed: int, draw: int, session: int, size: int):
        return session_blocks(seed, draw, session, size, block)

    return drawn_values(
        rows, statistics, draws=draws, group=group, session=[*group, "trade_date", "session_id"],
        sample_order=sample_order, blocks=blocks,
    )


def seeded(predictions: DataFrame, seed: int) -> DataFrame:
    """Add the fold's seed and the session number."""
    fold = F.col("fold_index") if "fold_index" in predictions.columns else F.lit(0)
    number = session_number(F.col("ticker"), F.col("trade_date"), F.col("session_id"))
    return predictions.withColumns({"_seed": (fold + seed).cast("bigint"), "_session": number})


def resampled_ranked(
    predictions: DataFrame, metric: RankedMetric, name: str, *, draws: int, block: int, seed: int, group: list[str],
    sample_order: list[str],
) -> DataFrame:
    """``(group, draw, metric, value)`` of a metric of sorted scores."""
    where, chunked, how = _in_chunks(predictions, draws, block, seed, group, sample_order)
    values = ranked_draws(where, chunked, metric, **how)
    return values.select(*group, "draw", F.lit(name).alias("metric"), "value")


def resampled_ranks(
    predictions: DataFrame, *, draws: int, block: int, seed: int, group: list[str], sample_order: list[str]
) -> DataFrame:
    """``(group, draw, metric, value)`` of the rank correlation."""
    where, chunked, how = _in_chunks(predictions, draws, block, seed, group, sample_order)
    values = rank_draws(where, chunked, **how)
    return values.select(*group, "draw", F.lit("rank_ic").alias("metric"), "value")


def _in_chunks(predictions, draws, block, seed, group, sample_order):
    """The rows with their seeds, how to cut them, and what tasks need to list draws."""
    session = [*group, "trade_date", "session_id"]
    rows = seeded(predictions, seed).select(*dict.fromkeys([*session, *sample_order]), P, T, "_seed", "_session")

    def blocks(seed: int, draw: int, session: int, size: int):
        return session_blocks(seed, draw, session, size, block)

    how = {"draws": draws, "per_task": max(1, MAX_DRAWN_ROWS // CHUNK_ROWS), "group": group, "session": session}
    how |= {"sample_order": sample_order, "blocks": blocks}
    return rows, lambda r: session_chunks(r, session, sample_order, CHUNK_ROWS), how


def resampled_metrics(
    predictions: DataFrame, metrics: dict[str, Metric], *, draws: int, block: int, seed: int, group: list[str],
    sample_order: list[str],
) -> DataFrame:
    """User metrics, given as aggregates over (prediction, target) columns, of every resample.

    A task lists by row the draws that take it; Spark multiplies the rows just before it aggregates them.
    """
    session = [*group, "trade_date", "session_id"]
    rows = seeded(predictions, seed).select(*dict.fromkeys([*session, *sample_order]), P, T, "_seed", "_session")
    per_task = max(1, MAX_DRAWN_ROWS // CHUNK_ROWS)
    chunks = with_batches(session_chunks(rows, session, sample_order, CHUNK_ROWS), draws, per_task)

    def blocks(seed: int, draw: int, session: int, size: int):
        return session_blocks(seed, draw, session, size, block)

    def listed(batches):
        table = in_order(pa.Table.from_batches(batches), sample_order)
        first = table["_first"][0].as_py()
        numbers = np.arange(first, min(draws, first + per_task), dtype=np.int32)
        p, t = vectors(table)
        ok = np.isfinite(p) & np.isfinite(t)
        p, t, times = p[ok], t[ok], drawn_weights(table, numbers, blocks)[:, ok]
        for at in range(0, len(p), LISTED_ROWS):
            part = times[:, at : at + LISTED_ROWS].T
            ends = np.cumsum(part.sum(axis=1), dtype=np.int32)
            taken = np.repeat(np.tile(numbers, len(part)), part.ravel())
            lists = pa.ListArray.from_arrays(np.append(np.int32(0), ends), taken)
            columns = [pa.repeat(table[g][0], len(part)) for g in group]
            columns += [pa.array(x[at : at + LISTED_ROWS]) for x in (p, t)] + [lists]
            yield pa.RecordBatch.from_arrays(columns, names=[*group, P, T, "_draws"])

    schema = f"{head(rows, group)}, {P} double, {T} double, _draws array<int>"
    taken = stream_groups(chunks, [*session, "_chunk", "_first"], listed, schema)
    copies = taken.select(*group, P, T, F.explode("_draws").alias("draw"))
    copies = copies.withColumn("draw", F.col("draw").cast("bigint"))
    return copies.groupBy(*group, "draw").agg(*[f(F.col(P), F.col(T)).alias(n) for n, f in metrics.items()])


def bootstrap_intervals(
    predictions: DataFrame,
    *,
    names: list[str] | None = None,
    draws: int = 1000,
    block: int = 20,
    confidence: float = 0.95,
    seed: int = 42,
    group: list[str] | None = None,
    sample_order: list[str] | None = None,
    max_session_rows: int = MAX_SESSION_ROWS,
    custom: dict[str, Metric] | None = None,
    opaque: dict[str, PythonMetric] | None = None,
    ranked: dict[str, RankedMetric] | None = None,
) -> DataFrame:
    """``(group, metric, estimate, lower, upper, confidence_level)`` in long form.

    ``custom`` adds user metrics by name, as in ``plans.evaluate.custom_metric``, and ``opaque``
    Python functions of whole vectors, as in ``plans.evaluate.custom_python_metric``; ``ranked`` adds
    Python metrics of sorted scores, whose groups may be of any size. With any of them and an empty
    ``names`` only those are reported.
    """
    if not 0 < confidence < 1:
        raise ValueError("confidence must be between 0 and 1")
    if draws <= 0 or block <= 0:
        raise ValueError("draws and block must be > 0")
    custom, opaque, ranked = custom or {}, opaque or {}, ranked or {}
    own = [*custom, *opaque, *ranked]
    names = [] if own and names == [] else check_metrics(names or METRICS)
    taken = {n for n in own if n in METRICS or own.count(n) > 1}
    if taken:
        raise ValueError(f"custom metrics need names of their own, not {sorted(taken)}")
    group = list(group or CANDIDATE)
    order = list(sample_order or SAMPLE)
    drawing = {"draws": draws, "block": block, "seed": seed, "group": group, "sample_order": order}
    plain = [n for n in names if n != "rank_ic"]
    formulas = _estimates()
    estimates = None
    if plain:
        sums = resample_sums(
            predictions, draws=draws, block=block, seed=seed, group=group, sample_order=order,
            max_session_rows=max_session_rows,
        )
        estimates = sums.select(*group, "draw", *[formulas[n].alias(n) for n in plain])
        estimates = estimates.unpivot([*group, "draw"], plain, "metric", "value")
    whole = {n: metric_by_weights(f) for n, f in opaque.items()}
    if "rank_ic" in names:
        own = resampled_ranks(predictions, **drawing)
        estimates = own if estimates is None else estimates.unionByName(own)
    if whole:
        own = resampled_values(predictions, whole, **drawing)
        estimates = own if estimates is None else estimates.unionByName(own)
    if custom:
        own = resampled_metrics(predictions, custom, **drawing)
        own = own.unpivot([*group, "draw"], list(custom), "metric", "value")
        estimates = own if estimates is None else estimates.unionByName(own)
    for name, metric in ranked.items():
        own = resampled_ranked(predictions, metric, name, **drawing)
        estimates = own if estimates is None else estimates.unionByName(own)
    alpha = (1 - confidence) / 2
    # One value per draw, so the exact percentile holds at most ``draws`` values.
    bounds = estimates.groupBy(*group, "metric").agg(
        F.percentile("value", F.array(F.lit(alpha), F.lit(1 - alpha))).alias("b")
    )
    point = evaluate(predictions, group, names).unpivot(group, names, "metric", "estimate") if names else None
    extra = [custom_metric(predictions, f, n, group).unpivot(group, [n], "metric", "estimate") for n, f in custom.items()]
    extra += [python_metric(predictions, f, n, group).unpivot(group, [n], "metric", "estimate") for n, f in opaque.items()]
    extra += [ranked_metric(predictions, f, n, group).unpivot(group, [n], "metric", "estimate") for n, f in ranked.items()]
    for own in extra:
        point = own if point is None else point.unionByName(own)
    return point.join(bounds, [*group, "metric"], "left").select(
        *group, "metric", "estimate",
        F.col("b")[0].alias("lower"), F.col("b")[1].alias("upper"),
        F.lit(confidence).alias("confidence_level"),
    )
