"""Causal z-scores: each row is scaled by the N rows strictly before it."""

from __future__ import annotations

from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from depthframe.operators.sessions import WHOLE, Slicing, row_number
from depthframe.schema import KEY, require

PREFIX = "normalized__"
#: Rows of one session scaled together; rounded up to whole runs of the window.
CHUNK_ROWS = 65_536


class Standardizer(Protocol):
    """What a build needs of a scaler: its result columns, its work, and its settings as plain values.

    ``apply`` adds ``outputs`` and ``normalization_valid`` to rows that have ``row_no``.
    """

    outputs: list[str]

    def apply(self, rows: DataFrame) -> DataFrame: ...

    def settings(self) -> dict: ...


class TrailingScaler:
    """Z-score over the ``window`` rows before each row, for every feature in ``features``."""

    kind = "trailing z-score"
    #: Raised whenever the numbers change, so that stored datasets tell how theirs were made.
    version = 1

    def __init__(self, features: list[str], window: int = 180) -> None:
        repeated = {f for f in features if features.count(f) > 1}
        if not features or repeated:
            raise ValueError(f"a scaler needs distinct features, got {features}")
        if window < 2:
            raise ValueError(f"no deviation over {window} rows")
        self.features, self.window = list(features), window
        self.outputs = [PREFIX + f for f in features]

    def apply(self, rows: DataFrame) -> DataFrame:
        return causal_zscore(rows, self.features, self.window)

    def settings(self) -> dict:
        return {"kind": self.kind, "version": self.version, "features": self.features, "window": self.window}


def scaler_from_settings(settings: dict) -> TrailingScaler:
    """The scaler that ``settings()`` described; missing or foreign keys are errors."""
    odd = set(settings) ^ {"kind", "version", "features", "window"}
    if odd:
        raise ValueError(f"scaler settings missing or unknown: {sorted(odd)}")
    known = TrailingScaler.kind, TrailingScaler.version
    if (settings["kind"], settings["version"]) != known:
        raise ValueError(f"no scaler of kind {settings['kind']!r} in version {settings['version']!r}")
    features, window = settings["features"], settings["window"]
    if not isinstance(features, list) or not all(isinstance(f, str) for f in features):
        raise ValueError(f"features are not a list of names: {features!r}")
    if type(window) is not int:
        raise ValueError(f"the window is no whole number: {window!r}")
    return TrailingScaler(features, window)


def _running_moments(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Mean and sum of squared deviations of the first 0, 1, ... values of each run.

    ``x`` is (runs, width, features); the update adds one value at a time to a running mean, so
    nothing is lost to a large value that is not in the prefix.
    """
    runs, width, features = x.shape
    mean, square = np.zeros((2, runs, width + 1, features))
    for i in range(width):
        step = x[:, i] - mean[:, i]
        mean[:, i + 1] = mean[:, i] + step / (i + 1)
        square[:, i + 1] = square[:, i] + step * (x[:, i] - mean[:, i + 1])
    return mean, square


def trailing_moments(x: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Mean and population deviation of the ``window`` rows before each row of ``x`` (rows, features).

    Rows are cut in runs of ``window``. A window is the end of one run and the start of the next, so
    it is the merger of a backward and a forward running moment: values outside the window never
    take part. The first ``window`` rows have no result.
    """
    rows, features = x.shape
    runs = -(-rows // window)
    padded = np.zeros((runs * window, features))
    padded[:rows] = x
    cut = padded.reshape(runs, window, features)
    head_mean, head_square = _running_moments(cut)
    tail_mean, tail_square = (m[:, ::-1] for m in _running_moments(cut[:, ::-1]))
    at = np.arange(window, rows)
    run, heads = at // window, at % window
    m1, s1 = tail_mean[run - 1, heads], tail_square[run - 1, heads]
    m2, s2 = head_mean[run, heads], head_square[run, heads]
    share = (heads / window)[:, None]
    gap = m2 - m1
    mean, std = np.full((2, rows, features), np.nan)
    mean[window:] = m1 + gap * share
    std[window:] = np.sqrt((s1 + s2) / window + gap * gap * share * (1 - share))
    return mean, std


def causal_zscore(
    df: DataFrame, features: list[str], window: int, slicing: Slicing = WHOLE, chunk_rows: int | None = None
) -> DataFrame:
    """Append ``normalized__<f>`` and ``normalization_valid``.

    A bounded SQL frame re-aggregates all N rows for every row and column, and a constant-time
    rewrite needs nine window columns per feature; both were slower when measured (see README).
    So sessions are cut into chunks of rows, each with the ``window`` rows before it, and one
    vectorised pass scales a chunk. Chunks end at multiples of the window, so the numbers do
    not depend on their size. ``slicing`` only matters for rows that have no ``row_no`` yet.
    """
    require(df, [*KEY, "timestamp", "feature_valid", *features], "standardization input")
    if window < 2:
        raise ValueError(f"no deviation over {window} rows")
    outputs = [PREFIX + f for f in features]
    rows = df.drop(*outputs, "normalization_valid")
    keep = rows.columns
    if "row_no" not in keep:
        rows = row_number(rows, "row_no", slicing)
    size = -(-max(chunk_rows or CHUNK_ROWS, window) // window) * window
    chunk = F.expr(f"row_no DIV {size}")
    spill = F.col("row_no") % size >= size - window
    rows = rows.withColumn(
        "_chunk",
        F.explode(F.when(spill, F.array(chunk, chunk + 1)).otherwise(F.array(chunk))),
    ).withColumn("_context", F.col("_chunk") != chunk)
    schema = T.StructType(
        [rows.schema[c] for c in keep]
        + [T.StructField(o, T.DoubleType()) for o in outputs]
        + [T.StructField("normalization_valid", T.BooleanType())]
    )

    def scale(table: pa.Table) -> pa.Table:
        table = table.sort_by("row_no")
        x = np.column_stack(
            [table[f].cast(pa.float64()).to_numpy().astype("float64") for f in features]
        )
        usable = table["feature_valid"].fill_null(False).to_numpy()
        good = usable[:, None] & np.isfinite(x)
        missing = np.zeros((len(x) + 1, len(features)), np.int64)
        missing[1:] = np.cumsum(~good, axis=0)
        with np.errstate(all="ignore"):
            mean, std = trailing_moments(np.where(good, x, 0.0), window)
            z = (x - mean) / np.where(std > 0, std, 1.0)
        good &= np.isfinite(mean) & np.isfinite(std)
        good[window:] &= missing[window:-1] == missing[: -window - 1]
        good[:window] = False
        out = table.select(keep)
        for i, name in enumerate(outputs):
            out = out.append_column(name, pa.array(z[:, i], mask=~good[:, i]))
        out = out.append_column("normalization_valid", pa.array((good & np.isfinite(z)).all(axis=1)))
        own = ~table["_context"].to_numpy()
        return out.filter(pa.array(own))

    return rows.groupBy(*KEY, "_chunk").applyInArrow(scale, schema).select(
        *keep, *outputs, "normalization_valid"
    )
