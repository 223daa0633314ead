"""Order-book and prediction inputs derived from the ``events`` table.

The given tables hold no order book, so each event becomes one snapshot. The constants are
fixed test parameters: which events are faulty and how long sessions, grid and windows are.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from depthframe.operators.features import add_features
from depthframe.operators.labels import add_labels
from depthframe.operators.normalize import TrailingScaler
from depthframe.operators.ranks import ensure_checkpoint_dir
from depthframe.operators.samples import (
    add_global_index,
    add_row_valid,
    mark_anchors,
    scaling_input,
    session_offsets,
    storage_rows,
)
from depthframe.operators.sessions import choose_slicing
from depthframe.operators.timeline import clean_sessions
from depthframe.sources import package
from depthframe.schema import LEVELS, label_column
from depthframe.sources.raw import assign_sessions, prepare_snapshots

SESSIONS = {"AM": ("00:00:00", "12:00:00"), "PM": ("12:00:00", "24:00:00")}
BROKEN_SESSIONS = {"AM": ("06:00:00", "12:00:00")}
INTERVAL = 1800
MAX_GAP = 3600
HORIZON = 3600
TOLERANCE = 1800
HISTORY = 4
WINDOW = 4
SPIKE_WINDOW = 12
FOLDS = {"train_days": 10, "validation_days": 4, "test_days": 4, "step_days": 4}
TARGET = label_column(HORIZON)
# Features normalised in the sample queries: the ten size columns and four derived ones.
SAMPLE_FEATURES = [f"{side}s{i}" for i in range(1, LEVELS + 1) for side in ("ASK", "BID")]
RIDGE_FEATURES = ["ASKs1", "BIDs1"]
RIDGE_HISTORY, RIDGE_ALPHA, WIDE_ALPHA = 3, 5.0, 1.0
LOGIT_ALPHA = 2.0
DERIVED = ["spread", "microprice", "l1_imbalance", "volume_slope"]


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet")


def raw_book(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event as one raw snapshot, with five kinds of injected fault."""
    columns = {}
    for i in range(1, LEVELS + 1):
        ask, bid = f"m + 0.01D * {i}", f"m - 0.01D * {i}"
        if i == 1:
            bid = f"if(fault = 13, m + 0.03D, {bid})"
        if i == 2:
            ask = f"if(fault = 17, m + 0.005D, {ask})"
        ask_size = f"double(100 + (event_id * {i + 2}) % 37)"
        bid_size = f"if(fault = 19, -1D, double(100 + (event_id * {i + 5}) % 41))"
        columns[f"ASKp{i}"] = f"if(fault <> 7, {ask}, NULL)"
        columns[f"ASKs{i}"] = f"if(fault <> 7, {ask_size}, NULL)"
        columns[f"BIDp{i}"] = f"if(fault NOT IN (7, 11), {bid}, NULL)"
        columns[f"BIDs{i}"] = f"if(fault NOT IN (7, 11), {bid_size}, NULL)"
    return (
        events(spark, sf_dir)
        .selectExpr(
            "event_id", "ts", "value", "event_id % 50 AS fault",
            "100D + (event_id % 97) * 0.01D + value / 1000D AS m",
        )
        .selectExpr(
            "if(event_id % 2 = 0, 'T0', 'T1') AS ticker",
            "CAST(date_trunc('minute', ts) AS timestamp_ntz) AS raw_time",
            "'events.parquet' AS file",
            "event_id AS row_index",
            *[f"{e} AS {c}" for c, e in columns.items()],
            "m AS last",
            "value * 10D AS volume",
            "value * m AS amount",
        )
    )


def broken_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The feed as one file a day, with faults by day of the month."""
    feed = raw_book(spark, sf_dir).withColumn("d", F.dayofmonth("raw_time"))
    feed = feed.filter("NOT (d = 5 AND hour(raw_time) >= 6)")
    shown = "CASE d WHEN 3 THEN 2 WHEN 7 THEN 8 WHEN 8 THEN 7 ELSE d END"
    stem = f"concat(date_format(raw_time, 'yyyyMM'), lpad(string({shown}), 2, '0'), IF(d = 10 AND row_index % 3 = 0, 'b', ''))"
    changed = {
        "file": F.expr(f"concat('raw/', ticker, '/', {stem}, '.parquet')"),
        "trade_date": F.expr(
            "CASE WHEN d = 14 THEN IF(row_index % 4 < 2, date_format(raw_time, 'yyyyMMdd'), date_format(date_add(raw_time, 1), 'yyyy-MM-dd')) END"
        ),
        "row_index": F.expr("IF(d = 12, -row_index, row_index)"),
        "raw_time": F.expr("IF(row_index % 997 = 5, NULL, raw_time)"),
    }
    return feed.withColumns(changed).drop("d")


def prepared(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prepare_snapshots(
        raw_book(spark, sf_dir), ticker=F.col("ticker"), column_mapping={"raw_time": "timestamp"}
    )


def snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assign_sessions(prepared(spark, sf_dir), SESSIONS)


def timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    snaps = snapshots(spark, sf_dir)
    return clean_sessions(
        snaps,
        interval_seconds=INTERVAL,
        max_ffill_gap_seconds=MAX_GAP,
        slicing=choose_slicing(snaps),
    )


def featured(spark: SparkSession, sf_dir: str) -> DataFrame:
    return add_features(timeline(spark, sf_dir), DERIVED)


def dataset_rows(spark: SparkSession, sf_dir: str, features: list[str] | None = None) -> DataFrame:
    """Stored rows: features, label, validity, anchors and positions."""
    snaps = snapshots(spark, sf_dir)
    slicing = choose_slicing(snaps)
    base = clean_sessions(
        snaps, interval_seconds=INTERVAL, max_ffill_gap_seconds=MAX_GAP, slicing=slicing
    )
    offsets = session_offsets(base)
    labelled = add_labels(
        add_features(base, DERIVED),
        horizon_seconds=HORIZON,
        tolerance_seconds=TOLERANCE,
        slicing=slicing,
    )
    scaler = TrailingScaler(features or SAMPLE_FEATURES, WINDOW)
    outputs = scaler.outputs
    scaled = add_row_valid(scaler.apply(scaling_input(labelled, scaler.features, TARGET)), outputs)
    marked = mark_anchors(scaled, history=HISTORY, target_column=TARGET, slicing=slicing)
    return storage_rows(add_global_index(marked, offsets), outputs, TARGET)


def stored_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``dataset_rows`` written once, as a published dataset would be, for plans that read it twice."""
    ensure_checkpoint_dir(spark)
    return dataset_rows(spark, sf_dir).checkpoint()


def bucketed_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``dataset_rows`` stored in the layout of a published dataset and read back."""
    ensure_checkpoint_dir(spark)
    data = f"{spark.sparkContext.getCheckpointDir()}/{uuid.uuid4().hex}"
    package.write_rows(dataset_rows(spark, sf_dir), data, package.bucket_count(timeline(spark, sf_dir)))
    return package.read_rows(spark, data)


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One prediction per event: two models over two folds, with tied and missing values."""
    e = events(spark, sf_dir)
    target = F.col("value") / 1000.0 - 0.05
    noise = ((F.col("event_id") * 7919) % 101 - 50) * F.lit(0.001)
    trade_date = F.date_format("ts", "yyyy-MM-dd")
    base = e.select(
        F.lit("T0").alias("ticker"),
        F.when(F.dayofmonth("ts") <= 15, 1).otherwise(2).cast("bigint").alias("fold_index"),
        trade_date.alias("trade_date"),
        F.when(F.hour("ts") < 12, "AM").otherwise("PM").alias("session_id"),
        F.col("ts").alias("anchor_timestamp"),
        "event_id",
        F.when(F.col("event_id") % 211 != 0, target).alias("target"),
        F.explode(
            F.array(
                F.struct(F.lit("linear").alias("m"), (target * 0.3 + noise).alias("p")),
                F.struct(F.lit("coarse").alias("m"), (F.round(target * 20.0 + noise) / 20.0).alias("p")),
            )
        ).alias("x"),
    )
    return base.select(
        "ticker", F.col("x.m").alias("model_name"), "fold_index", "trade_date", "session_id",
        "anchor_timestamp", "event_id", "target", F.col("x.p").alias("prediction"),
    )
