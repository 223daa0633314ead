"""Walk-forward runs: folds x candidates to predictions, evaluation and summary."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from depthframe.operators.bootstrap import bootstrap_intervals
from depthframe.operators.validation import identity_checks, prediction_checks, raise_if_broken, report
from depthframe.plans import evaluate as ev
from depthframe.plans.splits import dates_for, select_folds
from depthframe.schema import METRICS, PREDICTION_SCHEMA
from depthframe.sources.package import read_predictions, write_predictions


def split_rows(rows: DataFrame, plan: DataFrame, split: str) -> DataFrame:
    """Stored rows of one split, once per fold that uses their date."""
    wanted = dates_for(plan, split).select("ticker", "trade_date", "fold_index")
    return rows.join(wanted, ["ticker", "trade_date"])


def candidate_predictions(
    rows: DataFrame,
    plan: DataFrame,
    candidate,
    *,
    dataset_version: str = "unpublished",
    model_version: str = "v1",
) -> DataFrame:
    """Fit on every train split, predict every test split: all folds in one plan."""
    candidate.fit(rows, dates_for(plan, "train"))
    scored = candidate.predict(split_rows(rows, plan, "test"))
    columns = {
        "model_name": F.lit(candidate.name),
        "model_version": F.lit(model_version),
        "dataset_version": F.lit(dataset_version),
        "split": F.lit("test"),
        "anchor_timestamp": F.col("timestamp"),
        "spread": F.col("ask1").cast("double") - F.col("bid1").cast("double"),
    }
    return scored.withColumns(columns).select(
        *[F.col(f.name).cast(f.dataType) for f in PREDICTION_SCHEMA]
    )


def union_candidates(tables: list[DataFrame]) -> DataFrame:
    out = tables[0]
    for table in tables[1:]:
        out = out.unionByName(table)
    return out


@dataclass(frozen=True)
class WalkForwardReport:
    predictions: DataFrame
    overall: DataFrame
    daily: DataFrame
    daily_summary: DataFrame
    intervals: DataFrame
    bins: DataFrame
    summary: DataFrame


def build_report(
    predictions: DataFrame,
    *,
    names: list[str] | None = None,
    n_bins: int = 10,
    draws: int = 1000,
    block: int = 20,
    confidence: float = 0.95,
    seed: int = 42,
) -> WalkForwardReport:
    """Evaluate stored predictions. The bootstrap seed of a fold is ``seed + fold_index``."""
    names = names or METRICS
    overall = ev.evaluate(predictions, names=names)
    daily = ev.daily_metrics(predictions, names if "ts_ic" in names else [*names, "ts_ic"])
    return WalkForwardReport(
        predictions=predictions,
        overall=overall,
        daily=daily,
        daily_summary=ev.daily_summary(daily, names),
        intervals=bootstrap_intervals(
            predictions, names=names, draws=draws, block=block, confidence=confidence, seed=seed
        ),
        bins=ev.prediction_bins(predictions, n_bins),
        summary=ev.fold_summary(overall, names),
    )


def run_walk_forward(
    rows: DataFrame,
    plan: DataFrame,
    candidates: list,
    output: str,
    *,
    dataset_version: str,
    start_fold: int = 1,
    num_folds: int | None = None,
    **evaluation,
) -> WalkForwardReport:
    """Run all candidates over the chosen folds and evaluate what was written.

    Predictions go to ``output`` first: evaluation reads the stored table several times
    and must not fit the models again.
    """
    names = [c.name for c in candidates]
    if not names or any(not n.strip() for n in names) or len(set(names)) != len(names):
        raise ValueError("candidate names must be non-empty and unique")
    chosen = select_folds(plan, start_fold, num_folds)
    tables = [
        candidate_predictions(rows, chosen, c, dataset_version=dataset_version) for c in candidates
    ]
    write_predictions(union_candidates(tables), output)
    predictions = read_predictions(rows.sparkSession, output)
    folds = [r[0] for r in chosen.select("fold_index").distinct().collect()]
    identity = identity_checks(
        predictions, dataset_version=dataset_version, models=names, folds=folds
    )
    raise_if_broken(report([prediction_checks(predictions), identity]), "predictions")
    return build_report(predictions, **evaluation)
