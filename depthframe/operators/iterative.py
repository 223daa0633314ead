"""Models that are fitted in rounds, for all instruments and folds at once.

A round adds up what the model needs (gradients, second derivatives) over the training samples and
takes one step per instrument and fold. Weights are a small table, stored after every round; folds
that have converged leave the rounds. Rows go through a round once per block of dates, whatever
number of folds trains on the block: the task gets the weights of all of them.
"""

from __future__ import annotations

from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from depthframe.operators.baselines import BATCH, NEEDED, GroupedCandidate, _parts, _windows
from depthframe.operators.foldsums import BLOCK_KEY, FIT_KEY, in_blocks
from depthframe.operators.ranks import ensure_checkpoint_dir


class IterativeModel(Protocol):
    """A model whose fit is a sequence of steps from sums over samples."""

    name: str
    history: int

    def start(self) -> np.ndarray: ...

    def sums(self, weights: np.ndarray, windows: np.ndarray, target: np.ndarray) -> np.ndarray: ...

    def step(self, weights: np.ndarray, sums: np.ndarray) -> tuple[np.ndarray, bool]: ...

    def predict(self, weights: np.ndarray, windows: np.ndarray) -> np.ndarray: ...


class DirectionLogit:
    """Logistic regression of a rise on features of the newest row, by Newton's method.

    The intercept is the last weight and is not penalised. Predicts P(rise) - P(no rise).
    """

    name, history = "direction-logit", 1

    def __init__(self, positions: list[int], alpha: float = 1.0, tolerance: float = 1e-10) -> None:
        if alpha <= 0:
            raise ValueError("alpha must be > 0, so that separable samples have a solution")
        self.positions, self.alpha, self.tolerance = list(positions), float(alpha), tolerance

    def _design(self, windows: np.ndarray) -> np.ndarray:
        return np.column_stack([windows[:, -1, self.positions], np.ones(len(windows))])

    def _penalty(self) -> np.ndarray:
        return np.append(np.full(len(self.positions), self.alpha), 0.0)

    def start(self) -> np.ndarray:
        return np.zeros(len(self.positions) + 1)

    def sums(self, weights: np.ndarray, windows: np.ndarray, target: np.ndarray) -> np.ndarray:
        x = self._design(windows)
        rise = 0.5 * (1 + np.tanh(x @ weights / 2))
        gradient = x.T @ (rise - (target > 0))
        curvature = (x * (rise * (1 - rise))[:, None]).T @ x
        return np.concatenate([[len(x)], gradient, curvature.ravel()])

    def step(self, weights: np.ndarray, sums: np.ndarray) -> tuple[np.ndarray, bool]:
        k = len(weights)
        gradient = sums[1 : k + 1] + self._penalty() * weights
        if np.abs(gradient).max() <= self.tolerance * max(1.0, sums[0]):
            return weights, True
        curvature = sums[k + 1 :].reshape(k, k) + np.diag(self._penalty())
        move = np.linalg.lstsq(curvature, gradient, rcond=None)[0]
        # A far step overshoots where the curve is flat.
        return weights - move * min(1.0, 5.0 / max(np.abs(move).max(), 1e-300)), False

    def predict(self, weights: np.ndarray, windows: np.ndarray) -> np.ndarray:
        return np.tanh(self._design(windows) @ weights / 2)


class IterativeCandidate(GroupedCandidate):
    """Fits an :class:`IterativeModel` for every instrument and fold together.

    Folds that need more than ``max_rounds`` are an error. ``weights`` also tells the rounds taken.
    """

    def __init__(self, model: IterativeModel, max_rounds: int = 50) -> None:
        super().__init__(model)
        self.max_rounds = max_rounds

    def fit(self, rows: DataFrame, plan: DataFrame | None = None) -> IterativeCandidate:
        model, ticker = self.model, rows.schema["ticker"].dataType.simpleString()
        ensure_checkpoint_dir(rows.sparkSession)
        rows, folds = in_blocks(rows.select(*NEEDED, *(["fold_index"] if plan is None else [])), plan)
        parts, group = _parts(rows, model.history, BLOCK_KEY, [*NEEDED, "block"])
        if folds is None:
            blocks = rows.select(*BLOCK_KEY).distinct()
            folds = blocks.withColumn("fold_index", F.col("block").cast("bigint"))
        folds = folds.checkpoint()
        begin = F.array(*[F.lit(float(w)) for w in model.start()])
        weights = folds.select(*FIT_KEY).distinct().select(
            *FIT_KEY, begin.alias("weights"), F.lit(False).alias("done"), F.lit(0).alias("rounds")
        )
        of = [f"_{c}" for c in group]
        sums_schema = f"ticker {ticker}, fold_index bigint, weights array<double>, rounds int, sums array<double>"
        step_schema = f"ticker {ticker}, fold_index bigint, weights array<double>, done boolean, rounds int"

        def add(table: pa.Table, fitted: pa.Table) -> pa.Table:
            table, at, read = _windows(table, model.history) if len(table) else (table, [], None)
            if not len(at):
                fitted = fitted.slice(0, 0)
            target = table["target"].cast(pa.float64()).to_numpy()
            out = []
            for row in fitted["weights"].to_pylist():
                w = np.array(row)
                out.append(sum(model.sums(w, read(b), target[b]) for b in np.split(at, range(BATCH, len(at), BATCH))))
            vector = pa.list_(pa.float64())
            return pa.table(
                {
                    "ticker": fitted["_ticker"],
                    "fold_index": fitted["fold_index"],
                    "weights": fitted["weights"].cast(vector),
                    "rounds": fitted["rounds"],
                    "sums": pa.array(out, vector),
                }
            )

        def step(table: pa.Table) -> pa.Table:
            total = np.sum([np.array(x) for x in table["sums"].to_pylist()], axis=0)
            now, done = model.step(np.array(table["weights"][0].as_py()), total)
            head = table.select(FIT_KEY).slice(0, 1)
            return pa.table(
                {c: head[c] for c in FIT_KEY}
                | {
                    "weights": pa.array([now], pa.list_(pa.float64())),
                    "done": pa.array([bool(done)]),
                    "rounds": pa.array([table["rounds"][0].as_py() + 1], pa.int32()),
                }
            )

        places = parts.select(*group).distinct().checkpoint()
        finished = None
        for _ in range(self.max_rounds):
            sent = places.join(weights.join(folds, FIT_KEY), BLOCK_KEY).select(
                *[F.col(c).alias(o) for c, o in zip(group, of)], "fold_index", "weights", "rounds"
            )
            sums = parts.groupBy(*group).cogroup(sent.groupBy(*of)).applyInArrow(add, sums_schema)
            stepped = sums.groupBy(*FIT_KEY).applyInArrow(step, step_schema).checkpoint()
            some = stepped.filter("done")
            finished = some if finished is None else finished.unionByName(some)
            weights = stepped.filter("not done")
            if weights.isEmpty():
                break
        else:
            open_ = [tuple(r) for r in weights.select(*FIT_KEY).limit(5).collect()]
            raise ValueError(f"no solution after {self.max_rounds} rounds: {open_}")
        self.weights = finished.select(*FIT_KEY, "weights", "rounds")
        return self
