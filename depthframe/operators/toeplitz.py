"""Sums over sliding windows that share their rows.

The Gram matrix of flattened windows of T rows with F values has a block for every pair of window
positions (i, j). For a run of samples one row apart, block (i + 1, j + 1) adds up the same products
as block (i, j), moved by one row: it differs by one product at each end of the run. So a part needs
its T lagged products (T x F x F values) and, for each run, the rows at both ends. That is
T x F**2 work a sample instead of T**2 x F**2, and the matrix itself appears only where it is
solved.

End rows only matter through their product with themselves, so more of them than the matrix has
rows are replaced by the triangular factor of a QR decomposition, which has the same product.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class WindowSums:
    """Sums over the samples of one part; ``first`` and ``last`` are the end rows of its runs."""

    count: int
    target: float
    lags: np.ndarray  # [T, F, F]: sum of row(s) x row(s + lag), s being a window's first row
    cross: np.ndarray  # [T, F]: sum of target x row(s + lag)
    total: np.ndarray  # [T, F]: sum of row(s + lag)
    first: np.ndarray  # [runs, (T - 1) * F]: the rows before the newest of a run's first window
    last: np.ndarray  # [runs, (T - 1) * F]: the rows after the oldest of a run's last window


def compressed(rows: np.ndarray) -> np.ndarray:
    """At most as many rows as columns with the same product ``rows.T @ rows``."""
    if len(rows) <= rows.shape[1]:
        return rows
    return np.linalg.qr(rows, mode="r")


def window_sums(features: np.ndarray, target: np.ndarray, at: np.ndarray, history: int) -> WindowSums:
    """Sums over the windows that end at ``at`` (ascending) and reach ``history`` rows back."""
    width = features.shape[1]
    start, y = at - (history - 1), target[at]
    oldest = features[start]
    lags = np.empty((history, width, width))
    cross, total = np.empty((history, width)), np.empty((history, width))
    for lag in range(history):
        later = features[start + lag]
        lags[lag], cross[lag], total[lag] = oldest.T @ later, y @ later, later.sum(axis=0)
    opens = np.flatnonzero(np.diff(at, prepend=-2) != 1)
    closes = np.append(opens[1:], len(at)) - 1
    steps = np.arange(history - 1)
    first = features[start[opens][:, None] + steps].reshape(len(opens), -1)
    last = features[start[closes][:, None] + 1 + steps].reshape(len(opens), -1)
    return WindowSums(len(at), float(y.sum()), lags, cross, total, compressed(first), compressed(last))


def gram(lags: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The Gram matrix [T * F, T * F] from the lagged products and the product of the end rows.

    ``ends`` is ``last.T @ last - first.T @ first``.
    """
    history, width = lags.shape[0], lags.shape[1]
    out = np.empty((history, width, history, width))
    ends = ends.reshape(history - 1, width, history - 1, width)
    for lag in range(history):
        i = np.arange(history - lag)
        blocks = np.empty((history - lag, width, width))
        blocks[0] = lags[lag]
        blocks[1:] = ends[i[:-1], :, i[:-1] + lag, :]
        np.cumsum(blocks, axis=0, out=blocks)
        out[i, :, i + lag, :] = blocks
        out[i + lag, :, i, :] = blocks.transpose(0, 2, 1)
    return out.reshape(history * width, history * width)
