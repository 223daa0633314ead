"""Raw files to a published, content-addressed dataset."""

from __future__ import annotations

from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from depthframe.functions.book import select_features
from depthframe.operators.features import add_features
from depthframe.operators.labels import add_labels
from depthframe.operators.normalize import Standardizer, TrailingScaler
from depthframe.operators.quality import daily_quality
from depthframe.operators.samples import (
    add_global_index,
    add_row_valid,
    anchors,
    mark_anchors,
    scaling_input,
    session_offsets,
    storage_rows,
)
from depthframe.operators.sessions import choose_slicing
from depthframe.operators.timeline import clean_sessions
from depthframe.plans import splits
from depthframe.schema import DEFAULT_SESSIONS, label_column
from depthframe.sources import package as pkg
from depthframe.sources import raw


@dataclass(frozen=True)
class BuildConfig:
    sessions: dict = field(default_factory=lambda: dict(DEFAULT_SESSIONS))
    column_mapping: dict = field(default_factory=dict)
    index_column: str | None = None
    interval_seconds: int = 3
    max_ffill_gap_seconds: int = 6
    derived_features: tuple = ()
    horizon_seconds: int = 60
    tolerance_seconds: int = 3
    target_kind: str = "log"
    normalize_window: int = 180
    history: int = 180
    walk_forward: dict | None = field(
        default_factory=lambda: {"train_days": 60, "validation_days": 20, "test_days": 20, "step_days": 20}
    )
    split_ratios: dict = field(default_factory=lambda: {"train_ratio": 0.6, "validation_ratio": 0.2})
    # (first, last) dates of train, validation and test; used instead of ratios if given.
    split_ranges: dict | None = None

    @property
    def features(self) -> list[str]:
        return select_features(list(self.derived_features))

    @property
    def target_column(self) -> str:
        return label_column(self.horizon_seconds, self.target_kind)


def plan_hash(plan: DataFrame) -> str:
    """Order-free hash of a fold plan, combined on the executors."""
    one = raw.file_fingerprints(plan.withColumn("file", F.lit("plan")), ["ticker", "fold_index", "split", "trade_date"])
    return raw.source_fingerprint(one).first()["source_hash"]


def compile_rows(
    timeline: DataFrame, config: BuildConfig, slicing, scaler: Standardizer | None = None
) -> DataFrame:
    """Cleaned timeline to stored rows: features, label, scaling, validity, anchors."""
    features = config.features
    labelled = add_labels(
        add_features(timeline, list(config.derived_features)),
        horizon_seconds=config.horizon_seconds,
        tolerance_seconds=config.tolerance_seconds,
        slicing=slicing,
    )
    scaler = scaler or TrailingScaler(features, config.normalize_window)
    outputs = scaler.outputs
    scaled = add_row_valid(scaler.apply(scaling_input(labelled, features, config.target_column)), outputs)
    marked = mark_anchors(
        scaled, history=config.history, target_column=config.target_column, slicing=slicing
    )
    indexed = add_global_index(marked, session_offsets(timeline))
    return storage_rows(indexed, outputs, config.target_column)


def make_plan(dates: DataFrame, config: BuildConfig) -> DataFrame:
    """The fold plan; raises if an instrument would lack a fold or a split, or a date its split."""
    stop = raw.raise_on_violations
    if config.walk_forward is not None:
        days = config.walk_forward
        needed = days["train_days"] + days["validation_days"] + days["test_days"]
        stop(splits.short_instruments(dates, needed), "too few dates for one fold")
        return splits.walk_forward_folds(dates, **days)
    if config.split_ranges is not None:
        split = splits.explicit_split(dates, **config.split_ranges)
        stop(splits.uncovered_dates(split), "dates not in exactly one range")
    else:
        split = splits.chronological_split(dates, **config.split_ratios)
    stop(splits.empty_splits(split), "splits without dates")
    return splits.single_fold(split.select("ticker", "trade_date", "split"))


def build_dataset(
    spark: SparkSession,
    raw_dir: str,
    tickers: list[str],
    output_root: str,
    config: BuildConfig,
    scaler: Standardizer | None = None,
) -> pkg.Package:
    """Build and publish one dataset; the same inputs return the published one.

    Raw files are read once, into a staged table of typed rows; rules, fingerprint, dates, quality
    and timeline all come from there.
    """
    per_ticker = {t: raw.discover_sources(spark, raw_dir, t) for t in sorted(set(tickers))}
    if not per_ticker:
        raise ValueError("at least one ticker is required")
    paths = sorted({p for found in per_ticker.values() for p in found})
    ticker = tickers[0] if len(per_ticker) == 1 else None
    options = {"column_mapping": config.column_mapping, "index_column": config.index_column}
    files, staged = pkg.Files(spark, output_root), pkg.staging_path(output_root)
    raw_path, clean_path, plan_path = f"{staged}/_raw", f"{staged}/_clean", f"{staged}/plan"
    try:
        raw.read_snapshots(spark, paths, ticker=ticker, **options).write.parquet(raw_path)
        prepared = spark.read.parquet(raw_path)
        raw.raise_on_violations(raw.source_violations(prepared, config.sessions), "raw files")
        snaps = raw.assign_sessions(prepared, config.sessions)
        make_plan(splits.trade_dates(snaps), config).write.parquet(plan_path)
        plan = spark.read.parquet(plan_path)
        contents = [c for c in prepared.columns if c not in ("file", "file_date", "stated_date")]
        scaler = scaler or TrailingScaler(config.features, config.normalize_window)
        record = pkg.Record(
            source=raw.source_fingerprint(raw.file_fingerprints(prepared, contents)).first()["source_hash"],
            plan=plan_hash(plan),
            settings={"build": asdict(config), "scaler": scaler.settings()},
            tickers=list(per_ticker),
            features=config.features,
            target=config.target_column,
            history=config.history,
        )
        final = f"{output_root}/{record.version}"
        if files.exists(f"{final}/{pkg.MARKER}"):
            return pkg.audited_package(spark, final)

        slicing = choose_slicing(snaps)
        # The cleaned timeline feeds three tables, so it is written once in the staging folder.
        clean_sessions(
            snaps,
            interval_seconds=config.interval_seconds,
            max_ffill_gap_seconds=config.max_ffill_gap_seconds,
            slicing=slicing,
        ).write.parquet(clean_path)
        timeline = spark.read.parquet(clean_path)
        daily_quality(timeline, prepared).write.parquet(f"{staged}/quality")
        pkg.write_rows(compile_rows(timeline, config, slicing, scaler), staged, pkg.bucket_count(timeline))
        rows = pkg.Package(spark, staged, record, staged).rows()
        pkg.write_folds(splits.fold_index(anchors(rows), plan), f"{staged}/folds")
        files.delete(clean_path)
        files.delete(raw_path)
        return pkg.publish(spark, staged, output_root, record)
    finally:
        files.delete(staged)
