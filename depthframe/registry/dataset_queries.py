"""Registered queries: cleaning, features, labels, scaling, samples and folds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from depthframe.functions import book
from depthframe.operators import quality, samples, timeline
from depthframe.operators.features import add_features
from depthframe.operators.labels import add_labels
from depthframe.operators.normalize import causal_zscore
from depthframe.operators.sessions import choose_slicing
from depthframe.plans import splits
from depthframe.registry import inputs
from depthframe.schema import DERIVED_FEATURES, KEY, RAW_COLUMNS, label_column
from depthframe.sources import raw
from depthframe.sources.raw import prepare_snapshots


def r(x: Column | str, digits: int = 6) -> Column:
    """Rounded for comparison; adding 0.0 removes a negative zero."""
    return F.round(x, digits) + F.lit(0.0)


def rounded(names: list[str], digits: int = 6) -> list[Column]:
    # ``amount`` has seven decimals by construction, so rounding to six would meet ties.
    places = {n: 7 if n == "amount" else digits for n in names}
    return [F.expr(f"round({n}, {places[n]}) + 0D").alias(n) for n in names]


def text(name: str) -> Column:
    return F.col(name).cast("string").alias(name)


def session_snapshots(spark, sf):
    return inputs.snapshots(spark, sf).select(
        *KEY, text("timestamp"), book.time_of_day(F.col("timestamp")).alias("seconds"), "row_index",
        *rounded(["ASKp1", "BIDs3", "amount"]),
    )


def duplicate_counts(spark, sf):
    return timeline.duplicate_counts(inputs.snapshots(spark, sf))


def deduplicated_snapshots(spark, sf):
    return timeline.deduplicate(inputs.snapshots(spark, sf)).select(
        *KEY, text("timestamp"), "n_copies", *rounded(RAW_COLUMNS)
    )


def source_violations(spark, sf):
    """The feed keeps a month in one file, so the one-date rule reports it."""
    return raw.source_violations(inputs.prepared(spark, sf), inputs.SESSIONS)


def parsed_timestamps(spark, sf):
    """Every event's time in one of ten spellings, or as an integer of one of two units."""
    spelled = """CASE event_id % 10 WHEN 0 THEN date_format(t, 'yyyy-MM-dd HH:mm:ss') WHEN 1 THEN date_format(t, "yyyy-MM-dd'T'HH:mm:ss'Z'")
        WHEN 2 THEN date_format(t, "yyyy-MM-dd'T'HH:mm:ss.SSS'+08:00'") WHEN 3 THEN date_format(t, "yyyyMMdd'T'HHmmss")
        WHEN 4 THEN date_format(t, "yyyyMMdd'T'HH:mm") WHEN 5 THEN date_format(t, 'HH:mm:ss') WHEN 6 THEN date_format(t, 'HHmmss')
        WHEN 7 THEN date_format(t, 'yyyyMMdd') WHEN 8 THEN concat('at ', date_format(t, 'HH:mm')) END"""
    rows = inputs.events(spark, sf).withColumn("t", F.date_trunc("second", "ts").cast("timestamp_ntz"))
    rows = rows.withColumn("timestamp", F.expr(spelled))
    day = F.col("t").cast("date")
    rows = rows.withColumn("from_text", raw.parse_timestamp(rows, day))
    unit = F.expr("timestampdiff(SECOND, timestamp_ntz'1970-01-01', t) * IF(event_id % 3 = 0, 1L, 1000000000L)")
    rows = rows.withColumn("timestamp", unit)
    rows = rows.withColumn("from_integer", raw.parse_timestamp(rows, day))
    return rows.select("event_id", text("from_text"), text("from_integer"))


def lenient_numbers(spark, sf):
    """Values as text of several kinds: numbers, blanks, words, NaN and infinities."""
    kinds = """CASE event_id % 7 WHEN 0 THEN string(cast(value AS decimal(18, 4))) WHEN 1 THEN concat(' ', event_id, ' ')
        WHEN 2 THEN concat(event_id, 'e-1') WHEN 3 THEN 'NaN' WHEN 4 THEN IF(event_id % 2 = 0, 'Infinity', '-Infinity')
        WHEN 5 THEN concat(event_id, ' lots') ELSE '' END"""
    rows = inputs.events(spark, sf).withColumn("x", F.expr(kinds)).select("event_id", raw.lenient_double("x"))
    infinite = F.abs("x") == float("inf")
    return rows.select(
        "event_id", F.col("x").isNull().alias("missing"), F.coalesce(infinite, F.lit(False)).alias("infinite"),
        r(F.when(~infinite, F.col("x"))).alias("x"),
    )


def date_rules(spark, sf):
    """Trade dates in column spellings that count and spellings that do not."""
    spelled = """CASE event_id % 6 WHEN 0 THEN date_format(ts, 'yyyy-MM-dd') WHEN 1 THEN date_format(ts, ' yyyyMMdd ')
        WHEN 2 THEN date_format(ts, 'yyyy/MM/dd') WHEN 3 THEN date_format(ts, 'yyyyMM') WHEN 4 THEN '2025-02-30' END"""
    return inputs.events(spark, sf).select("event_id", raw.parse_date(F.expr(spelled)).cast("string").alias("trade_date"))


def broken_sources(spark, sf):
    """Every input rule on a feed of one file a day that breaks each of them somewhere."""
    prepared = prepare_snapshots(
        inputs.broken_files(spark, sf), ticker=F.col("ticker"), column_mapping={"raw_time": "timestamp"}
    )
    return raw.source_violations(prepared, inputs.BROKEN_SESSIONS)


def source_fingerprint(spark, sf):
    """Contents of the feed, one file a day: integers, microseconds, scaled values and text."""
    rows = inputs.events(spark, sf).select(
        F.date_format("ts", "yyyy-MM-dd").alias("file"), "event_id",
        F.expr("timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01', ts)").alias("us"), "user_id",
        "event_type", F.round(F.col("value") * 1e6).cast("bigint").alias("millionths"), "props",
    )
    return raw.source_fingerprint(raw.file_fingerprints(rows, [c for c in rows.columns if c != "file"]))


def mid_price_validity(spark, sf):
    return inputs.snapshots(spark, sf).select(
        *KEY, "row_index",
        r(book.mid_price()).alias("mid_price"),
        book.book_valid().alias("book_valid"),
        book.bid_side_valid().alias("bid_side_valid"),
        book.ask_side_valid().alias("ask_side_valid"),
        book.crossed().alias("crossed"),
        book.negative_price().alias("negative_price"),
        book.negative_size().alias("negative_size"),
    )


def level_order_violations(spark, sf):
    flag = book.level_order_violation()
    return inputs.snapshots(spark, sf).groupBy("ticker", "trade_date").agg(
        F.count(F.when(flag, 1)).alias("level_order_violations"),
        F.count(F.when(book.whole_book_missing(), 1)).alias("empty_books"),
        F.count(F.when(book.has_any_book_value(), 1)).alias("books"),
    )


def session_grid_ffill(spark, sf):
    return inputs.timeline(spark, sf).select(
        *KEY, text("timestamp"), "seconds", "row_no", "is_ffilled", "book_valid",
        *rounded([*RAW_COLUMNS, "mid_price", "staleness_seconds"]),
    )


def snapshot_gaps(spark, sf):
    return inputs.timeline(spark, sf).select(
        *KEY, text("timestamp"), "snapshot_gap_seconds", "n_copies"
    )


def _report(df: DataFrame) -> DataFrame:
    doubles = [f.name for f in df.schema if f.dataType.simpleString() == "double"]
    return df.withColumns({n: r(F.col(n)) for n in doubles})


def daily_quality(spark, sf):
    return _report(quality.daily_quality(inputs.timeline(spark, sf)))


def daily_quality_all_days(spark, sf):
    """A two-minute session: most days hold no snapshot in it and report zeros."""
    every = inputs.prepared(spark, sf)
    snaps = raw.assign_sessions(every, {"OPEN": ("09:30:00", "09:32:00")})
    line = timeline.clean_sessions(
        snaps, interval_seconds=60, max_ffill_gap_seconds=60, slicing=choose_slicing(snaps)
    )
    return _report(quality.daily_quality(line, every))


def derived_features(spark, sf):
    rows = add_features(inputs.timeline(spark, sf), DERIVED_FEATURES)
    return rows.select(*KEY, text("timestamp"), *rounded(DERIVED_FEATURES))


def feature_validity(spark, sf):
    rows = inputs.featured(spark, sf)
    return rows.groupBy(*KEY).agg(
        F.count(F.lit(1)).alias("row_count"),
        F.count(F.when(F.col("book_valid"), 1)).alias("book_valid_rows"),
        F.count(F.when(F.col("feature_valid"), 1)).alias("feature_valid_rows"),
    )


def asof_nearest_labels(spark, sf):
    snaps = inputs.snapshots(spark, sf)
    slicing = choose_slicing(snaps)
    line = timeline.clean_sessions(
        snaps, interval_seconds=inputs.INTERVAL, max_ffill_gap_seconds=inputs.MAX_GAP, slicing=slicing
    )
    labelled = add_labels(
        line, horizon_seconds=inputs.HORIZON, tolerance_seconds=inputs.TOLERANCE, slicing=slicing
    )
    return labelled.select(
        *KEY, text("timestamp"), text("future_timestamp"), "target_valid", *rounded(["future_mid"]),
        r(label_column(inputs.HORIZON), 8).alias("log_return"),
        r(label_column(inputs.HORIZON, "simple"), 8).alias("simple_return"),
    )


def causal_zscore_query(spark, sf):
    features = inputs.SAMPLE_FEATURES
    rows = inputs.featured(spark, sf).select(*KEY, "timestamp", "row_no", "feature_valid", *features)
    return causal_zscore(rows, features, inputs.WINDOW).select(
        *KEY, text("timestamp"), "normalization_valid",
        *[r(f"normalized__{f}").alias(f"z_{f}") for f in features],
    )


def causal_zscore_spikes(spark, sf):
    """Traded volume with one print in 97 a hundred million times too large."""
    spiky = F.when(F.col("row_index") % 97 == 5, F.col("volume") * 1e8).otherwise(F.col("volume"))
    snaps = inputs.snapshots(spark, sf).withColumn("x", spiky)
    order = Window.partitionBy(*KEY).orderBy("row_index")
    rows = snaps.select(
        *KEY, "timestamp", "x", (F.row_number().over(order) - 1).alias("row_no"),
        "row_index", F.lit(True).alias("feature_valid"),
    )
    scaled = causal_zscore(rows, ["x"], inputs.SPIKE_WINDOW, chunk_rows=64)
    return scaled.select(*KEY, "row_index", "normalization_valid", r("normalized__x", 5).alias("z"))


def anchors(spark, sf):
    return samples.anchors(inputs.dataset_rows(spark, sf)).select(
        *KEY, "global_anchor_index", "session_start_index", "anchor_index", text("anchor_timestamp")
    )


def global_row_index(spark, sf):
    return inputs.dataset_rows(spark, sf).select(
        *KEY, text("timestamp"), "global_index", "session_start_index", "row_no", "row_valid", "target_valid"
    )


def window_samples(spark, sf):
    out = samples.window_samples(inputs.dataset_rows(spark, sf), inputs.HISTORY)
    out = samples.last_frame(samples.flatten_window(out))
    as_double = F.transform("flat", lambda x: x.cast("double"))
    return out.select(
        *KEY, "global_index",
        F.size("window").cast("bigint").alias("steps"),
        F.size("flat").cast("bigint").alias("width"),
        r(F.element_at("flat", 1).cast("double"), 5).alias("oldest_first"),
        r(F.element_at("anchor_features", 1).cast("double"), 5).alias("newest_first"),
        r(F.aggregate(as_double, F.lit(0.0), lambda a, x: a + x), 3).alias("total"),
    )


def sample_meta(spark, sf):
    meta = samples.sample_meta(inputs.dataset_rows(spark, sf))
    return meta.select(
        *KEY, text("anchor_timestamp"), *rounded(["mid_t", "future_mid", "bid1", "ask1", "spread"], 5),
        r("target", 7).alias("target"),
    )


def _dates(spark, sf):
    return splits.trade_dates(inputs.snapshots(spark, sf))


def chronological_split(spark, sf):
    return splits.chronological_split(_dates(spark, sf), train_ratio=0.6, validation_ratio=0.2)


def explicit_split(spark, sf):
    return splits.explicit_split(
        _dates(spark, sf),
        train=("2024-01-01", "2024-01-18"),
        validation=("2024-01-18", "2024-01-23"),
        test=("2024-01-25", "2024-01-31"),
    )


def _uneven_dates(spark, sf):
    """Three instruments of the feed with all, ten and two of its dates."""
    snaps = inputs.snapshots(spark, sf).withColumn("ticker", F.concat(F.lit("U"), F.col("row_index") % 3))
    day = F.dayofmonth("timestamp")
    keep = (F.col("row_index") % 3 == 0) | ((F.col("row_index") % 3 == 1) & (day <= 10)) | (day <= 2)
    return splits.trade_dates(snaps.filter(keep))


def short_instruments(spark, sf):
    return splits.short_instruments(_uneven_dates(spark, sf), 18)


def missing_folds(spark, sf):
    """Folds 2 and 3 of small folds: the second instrument has some, the third none."""
    small = {"train_days": 4, "validation_days": 2, "test_days": 2, "step_days": 2}
    plan = splits.walk_forward_folds(_uneven_dates(spark, sf), **small)
    return splits.missing_folds(plan, 2, 2)


def split_violations(spark, sf):
    """Splits without dates by ratio, and dates that explicit ranges hold never or twice."""
    dates = _uneven_dates(spark, sf)
    ratio = splits.empty_splits(splits.chronological_split(dates)).withColumn("trade_date", F.lit(""))
    ranges = splits.uncovered_dates(explicit_split(spark, sf)).withColumn("split", F.lit(""))
    return ratio.unionByName(ranges.drop("coverage"))


def walk_forward_folds(spark, sf):
    return splits.walk_forward_folds(_dates(spark, sf), **inputs.FOLDS)


def fold_invariants(spark, sf):
    return splits.fold_bounds(walk_forward_folds(spark, sf))


def selected_folds(spark, sf):
    return splits.select_folds(walk_forward_folds(spark, sf), 2, 2)


def fold_index(spark, sf):
    rows = inputs.dataset_rows(spark, sf)
    plan = walk_forward_folds(spark, sf)
    out = splits.fold_index(samples.anchors(rows), plan)
    return out.withColumn("anchor_timestamp", F.col("anchor_timestamp").cast("string"))


QUERIES = {
    "session_snapshots": session_snapshots,
    "duplicate_counts": duplicate_counts,
    "deduplicated_snapshots": deduplicated_snapshots,
    "source_violations": source_violations,
    "parsed_timestamps": parsed_timestamps,
    "lenient_numbers": lenient_numbers,
    "date_rules": date_rules,
    "broken_sources": broken_sources,
    "source_fingerprint": source_fingerprint,
    "mid_price_validity": mid_price_validity,
    "level_order_violations": level_order_violations,
    "session_grid_ffill": session_grid_ffill,
    "snapshot_gaps": snapshot_gaps,
    "daily_quality": daily_quality,
    "daily_quality_all_days": daily_quality_all_days,
    "derived_features": derived_features,
    "feature_validity": feature_validity,
    "asof_nearest_labels": asof_nearest_labels,
    "causal_zscore": causal_zscore_query,
    "causal_zscore_spikes": causal_zscore_spikes,
    "anchors": anchors,
    "global_row_index": global_row_index,
    "window_samples": window_samples,
    "sample_meta": sample_meta,
    "chronological_split": chronological_split,
    "explicit_split": explicit_split,
    "short_instruments": short_instruments,
    "missing_folds": missing_folds,
    "split_violations": split_violations,
    "walk_forward_folds": walk_forward_folds,
    "fold_invariants": fold_invariants,
    "selected_folds": selected_folds,
    "fold_index": fold_index,
}
