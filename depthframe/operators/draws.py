"""Opaque Python metrics over whole vectors, and their bootstrap draws.

A task holds one group (a model's predictions of one instrument and fold) and a batch of draws. It sorts
and ranks the values once; a draw is then a weight per row, from the starts of its blocks, and
passes over the sorted values. Nothing of size draws x rows is stored or shuffled: a group's rows
are sent once per batch, and batches are as large as ``TASK_CELLS`` rows x draws.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from depthframe.functions.metrics import P, T, finite_pair

TASK_CELLS = 20_000_000
#: A group of this many rows takes about 1 GB in its task. Larger ones are an error here.
MAX_GROUP_ROWS = 16_000_000

#: Maps (prediction, target) vectors, finite pairs only, to a number; None or NaN if undefined.
PythonMetric = Callable[[np.ndarray, np.ndarray], float | None]
#: Gets a group's finite pairs once and returns a function of one draw's row weights.
ByWeights = Callable[[np.ndarray, np.ndarray], Callable[[np.ndarray], float | None]]


def metric_by_weights(metric: PythonMetric) -> ByWeights:
    """An opaque metric of the drawn rows, each as often as it was drawn."""

    def prepared(p: np.ndarray, t: np.ndarray) -> Callable[[np.ndarray], float | None]:
        return lambda weights: metric(np.repeat(p, weights), np.repeat(t, weights))

    return prepared


def _number(value) -> float | None:
    return None if value is None or not np.isfinite(value) else float(value)


def group_sizes(predictions: DataFrame, group: list[str]) -> int:
    """Rows of the largest group."""
    return predictions.groupBy(*group).count().agg(F.max("count")).first()[0] or 0


def _check(largest: int) -> None:
    if largest > MAX_GROUP_ROWS:
        raise ValueError(
            f"a group of {largest} rows exceeds {MAX_GROUP_ROWS}: use a metric of columns, or group by day"
        )


def python_metric(predictions: DataFrame, metric: PythonMetric, name: str, group: list[str]) -> DataFrame:
    """One value of an opaque metric per group; each group is one task and must fit into it."""
    rows = predictions.filter(finite_pair()).select(*group, F.col(P).cast("double"), F.col(T).cast("double"))
    _check(group_sizes(rows, group))

    def value(table: pa.Table) -> pa.Table:
        order = table.sort_by([(P, "ascending"), (T, "ascending")])
        got = _number(metric(order[P].to_numpy(), order[T].to_numpy()))
        data = {g: table[g].slice(0, 1) for g in group}
        return pa.table({**data, name: pa.array([got], pa.float64())})

    head = ", ".join(f"{g} {rows.schema[g].dataType.simpleString()}" for g in group)
    return rows.groupBy(*group).applyInArrow(value, f"{head}, {name} double")


def drawn_values(
    rows: DataFrame,
    statistics: dict[str, ByWeights],
    *,
    draws: int,
    group: list[str],
    session: list[str],
    sample_order: list[str],
    blocks: Callable,
) -> DataFrame:
    """``(group, draw, metric, value)`` of every statistic and draw.

    ``rows`` hold ``_seed`` and ``_session``; ``blocks(seed, draw, session, size)`` gives the
    blocks [lo, hi) that a draw takes from a session. Draws without a valid row are left out.
    """
    order = [c for c in sample_order if c not in session]
    rows = rows.select(*dict.fromkeys([*session, *order]), "_seed", "_session", F.col(P).cast("double"), F.col(T).cast("double"))
    largest = group_sizes(rows, group)
    _check(largest)
    per_task = max(1, min(draws, TASK_CELLS // max(1, largest)))
    batches = F.sequence(F.lit(0), F.lit(-(-draws // per_task) - 1))
    rows = rows.withColumn("_batch", F.explode(batches))
    cut = [c for c in session if c not in group]

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([(c, "ascending") for c in [*cut, *order]])
        p, t = (table[c].fill_null(float("nan")).to_numpy() for c in (P, T))
        valid = np.isfinite(p) & np.isfinite(t)
        numbers = [table[c].combine_chunks() for c in cut]
        new = np.zeros(len(p), bool)
        new[:1] = True
        for column in numbers:
            codes = column.dictionary_encode(null_encoding="encode").indices.to_numpy()
            new[1:] |= codes[1:] != codes[:-1]
        starts = np.flatnonzero(new)
        ends = np.append(starts[1:], len(p))
        seed, session_no = table["_seed"][0].as_py(), table["_session"].to_numpy()
        made = {name: make(p[valid], t[valid]) for name, make in statistics.items()}
        first = table["_batch"][0].as_py() * per_task
        out: dict[str, list] = {"draw": [], "metric": [], "value": []}
        for draw in range(first, min(draws, first + per_task)):
            edges = np.zeros(len(p) + 1, np.int64)
            for at, end in zip(starts, ends):
                lo, hi = blocks(seed, draw, session_no[at], end - at)
                np.add.at(edges, at + lo, 1)
                np.add.at(edges, at + hi, -1)
            weights = np.cumsum(edges)[:-1][valid]
            if weights.any():
                for name, value in made.items():
                    out["draw"].append(draw)
                    out["metric"].append(name)
                    out["value"].append(_number(value(weights)))
        m = len(out["draw"])
        data = {g: pa.repeat(table[g][0], m) for g in group}
        kinds = {"draw": pa.int64(), "metric": pa.string(), "value": pa.float64()}
        return pa.table(data | {c: pa.array(v, kinds[c]) for c, v in out.items()})

    head = ", ".join(f"{g} {rows.schema[g].dataType.simpleString()}" for g in group)
    schema = f"{head}, draw bigint, metric string, value double"
    return rows.groupBy(*group, "_batch").applyInArrow(run, schema)
