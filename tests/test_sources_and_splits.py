import datetime as dt

import numpy as np
import pandas as pd
import pytest
from conftest import at, book_values
from pyspark.sql import functions as F

from depthframe.plans import splits
from depthframe.schema import RAW_COLUMNS
from depthframe.sources import raw


def pandas_book(times, column="timestamp", day="2026-01-05"):
    frame = pd.DataFrame([book_values(9.9, 10.1) for _ in times])[RAW_COLUMNS]
    frame.insert(0, column, [at(t, day) if isinstance(t, str) else t for t in times])
    return frame


def save(frame, path, index=False):
    path.parent.mkdir(parents=True, exist_ok=True)
    frame.to_parquet(path, index=index, coerce_timestamps="us")


def test_discovery_prefers_the_ticker_folder(spark, tmp_path):
    for name in ("20260106", "20260105"):
        save(pandas_book(["09:30:00"]), tmp_path / "A" / f"{name}.parquet")
    save(pandas_book(["09:30:00"]), tmp_path / "20260101.parquet")
    found = [p.rsplit("/", 1)[1] for p in raw.discover_sources(spark, str(tmp_path), "A")]
    assert found == ["20260105.parquet", "20260106.parquet"]
    assert len(raw.discover_sources(spark, str(tmp_path), "B")) == 1
    with pytest.raises(FileNotFoundError):
        raw.discover_sources(spark, str(tmp_path / "none"), "B")


def test_fingerprints_follow_contents_only(spark):
    columns = ["n", "x", "t"]

    def prints(rows):
        df = spark.createDataFrame(rows, "file string, n bigint, x double, t string")
        files = raw.file_fingerprints(df, columns)
        return {r["file"]: r["print"] for r in files.collect()}, raw.source_fingerprint(files).first()

    rows = [("a", 1, 0.5, "u"), ("a", 2, None, ""), ("a", 2, None, ""), ("b", 1, 0.5, None)]
    files, source = prints(rows)
    assert source["file_count"] == 2 and len(set(files.values())) == 2
    assert prints(rows[::-1]) == (files, source)
    renamed = [(("z" if f == "a" else f), *rest) for f, *rest in rows]
    assert prints(renamed)[1] == source
    for changed in (rows[:2] + rows[3:], [*rows[:3], ("b", 1, 0.5, "")], [("a", 1, 0.25, "u"), *rows[1:]]):
        assert prints(changed)[1]["source_hash"] != source["source_hash"]


def test_session_clocks_are_checked(spark):
    good = {"AM": ("09:30:00", "11:30:00"), "PM": ("11:30:00", "24:00:00")}
    assert raw.session_problems(good) == []
    for bad in ({}, {"A": ("9:30:00", "10:00:00")}, {"A": ("11:00:00", "10:00:00")}, {"A": ("10:00:00", "25:00:00")},
                {"A": ("09:00:00", "10:00:01"), "B": ("10:00:00", "11:00:00")}):
        assert raw.session_problems(bad)
        with pytest.raises(ValueError):
            raw.session_of(F.col("t"), bad)


def plan_rows(spark, per_ticker):
    rows = [(t, f"2026-01-{d:02d}") for t, n in per_ticker.items() for d in range(1, n + 1)]
    return splits.trade_dates(spark.createDataFrame(rows, "ticker string, trade_date string"))


def test_nothing_is_dropped_silently(spark):
    days = {"train_days": 3, "validation_days": 1, "test_days": 1, "step_days": 1}
    uneven = plan_rows(spark, {"A": 10, "B": 6, "C": 3})
    assert [tuple(r) for r in splits.short_instruments(uneven, 5).collect()] == [("C", 3, 5)]
    plan = splits.walk_forward_folds(uneven, **days)
    lost = {tuple(r) for r in splits.missing_folds(plan, 2, 3).collect()}
    assert lost == {("B", 3), ("B", 4)}
    assert {tuple(r) for r in splits.missing_folds(plan, 1).collect()} == {("B", f) for f in (3, 4, 5, 6)}
    with pytest.raises(ValueError, match="not available"):
        splits.select_folds(plan, 2, 3)
    assert splits.select_folds(plan, 1, 2).select("ticker").distinct().count() == 2
    two = splits.chronological_split(plan_rows(spark, {"A": 2}))
    assert ("A", "validation") in {tuple(r) for r in splits.empty_splits(two).collect()}


def test_mapping_and_datetime_index(spark, tmp_path):
    mapped = tmp_path / "A" / "20260105.parquet"
    save(pandas_book(["09:30:00", "09:30:03"], "raw_time"), mapped)
    got = raw.read_snapshots(spark, str(mapped), column_mapping={"raw_time": "timestamp", "absent": "last"})
    assert [r["timestamp"] for r in got.orderBy("row_index").collect()] == [at("09:30:00"), at("09:30:03")]
    assert got.first()["ticker"] == "A" and got.first()["trade_date"] == "2026-01-05"

    indexed = tmp_path / "B" / "20260105.parquet"
    save(pandas_book(["09:30:00"], "event_time").set_index("event_time"), indexed, index=True)
    assert raw.read_snapshots(spark, str(indexed)).first()["timestamp"] == at("09:30:00")

    frame = spark.read.parquet(str(mapped))
    with pytest.raises(ValueError, match="several"):
        raw.apply_column_mapping(frame, {"raw_time": "timestamp", "volume": "timestamp"})
    with pytest.raises(ValueError, match="both"):
        raw.apply_column_mapping(frame, {"raw_time": "last"})
    with pytest.raises(ValueError, match="index"):
        raw.restore_time_index(frame.withColumn("timestamp", F.col("raw_time")), "raw_time")
    with pytest.raises(ValueError, match="missing required"):
        raw.prepare_snapshots(frame.drop("ASKp1", "raw_time").withColumns({"file": F.lit("x"), "row_index": F.lit(0)}))


def test_nanosecond_files(spark, tmp_path):
    path = tmp_path / "A" / "20260105.parquet"
    path.parent.mkdir()
    pandas_book(["09:30:00.250"]).astype({"timestamp": "datetime64[ns]"}).to_parquet(path, index=False)
    spark.conf.set("spark.sql.legacy.parquet.nanosAsLong", "true")
    try:
        assert raw.read_snapshots(spark, str(path)).first()["timestamp"] == at("09:30:00.250")
    finally:
        spark.conf.unset("spark.sql.legacy.parquet.nanosAsLong")


def test_timestamp_text(spark):
    texts = [
        "2026-01-05 09:30:00", "2026-01-05T09:30:00.5Z", "2026-01-05T09:30:00+08:00", "09:30:01",
        "09:30", "20260105T09:30:00", "2026-01-05", "", "noon", None,
    ]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, timestamp string")
    day = F.lit("2026-01-05").cast("date")
    got = [r[0] for r in df.withColumn("t", raw.parse_timestamp(df, day)).orderBy("i").select("t").collect()]
    assert got == [
        at("09:30:00"), at("09:30:00.500"), at("09:30:00"), at("09:30:01"), at("09:30:00"),
        at("09:30:00"), at("00:00:00"), None, None, None,
    ]


def test_compact_times_and_integers(spark):
    texts = ["20260105T093000", "20260105T0930", "20260105 093000.25", "093001", "0930", "2026-01-05T093000Z", "20260105", "99", "1767605400"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, timestamp string")
    day = F.lit("2026-01-05").cast("date")
    got = [r[0] for r in df.withColumn("t", raw.parse_timestamp(df, day)).orderBy("i").select("t").collect()]
    half = at("09:30:00")
    assert got == [half, half, at("09:30:00.250"), at("09:30:01"), half, half, at("00:00:00"), None, None]
    seconds = 1767605400  # 2026-01-05 09:30
    numbers = [seconds * 10**9, seconds, seconds * 1000, seconds * 10**6, -1, None]
    df = spark.createDataFrame([(i, n) for i, n in enumerate(numbers)], "i int, timestamp bigint")
    got = [r[0] for r in df.withColumn("t", raw.parse_timestamp(df, day)).orderBy("i").select("t").collect()]
    assert got == [half, None, None, None, None, None]


def test_trade_date_rules(spark, tmp_path):
    root = tmp_path / "A"
    clocks = pandas_book(["09:30:00", "09:30:03", "09:30:06"])
    clocks["timestamp"] = ["09:30:00", "09:30:03", "09:30:06"]
    save(clocks.assign(trade_date=[None, "2026-01-07", None]), root / "20260105.parquet")  # the column dates the clocks
    save(clocks.assign(trade_date=["x", None, ""]), root / "20260106.parquet")  # no usable value: the name does
    save(clocks.assign(trade_date=["2026-01-08", "20260109", "2026-01-08"]), root / "20260108.parquet")
    full = clocks.assign(timestamp=[f"2026-01-10 {t}" for t in clocks["timestamp"]], trade_date=[None] * 3)
    save(full.astype({"trade_date": "string"}), root / "latest.parquet")
    prepared = raw.read_snapshots(spark, str(root))
    days = {(r["file"].rsplit("/")[-1], r["trade_date"]) for r in prepared.collect()}
    assert days == {
        ("20260105.parquet", "2026-01-07"), ("20260106.parquet", "2026-01-06"), ("20260108.parquet", "2026-01-08"),
        ("20260108.parquet", "2026-01-09"), ("latest.parquet", "2026-01-10"),
    }
    got = {(r["rule"], r["subject"].rsplit("/")[-1]) for r in raw.source_violations(prepared).collect()}
    assert ("several trade_date values in one file", "20260108.parquet") in got
    assert ("no trade date in column or file name", "latest.parquet") in got
    assert not [s for rule, s in got if rule.startswith(("several trade_date", "no trade")) and s not in ("20260108.parquet", "latest.parquet")]


def test_every_input_rule_fires_in_the_query(spark):
    from depthframe.registry import dataset_queries

    rules = {r["rule"] for r in dataset_queries.broken_sources(spark, "/root/testdata/sf0.01").collect()}
    assert len(rules) == 8


def test_sessions_are_half_open(spark):
    times = ["09:29:59.999999", "09:30:00", "11:29:59.999999", "11:30:00", "13:00:00", "14:56:59", "14:57:00"]
    df = spark.createDataFrame([(at(t),) for t in times], "t timestamp_ntz")
    got = [r[0] for r in df.select(raw.session_of(F.col("t"))).collect()]
    assert got == [None, "AM", "AM", None, "PM", "PM", None]


def test_lenient_values(spark):
    df = spark.createDataFrame([("1.5",), ("x",), ("NaN",), ("Infinity",)], "v string")
    assert [r[0] for r in df.select(raw.lenient_double("v")).collect()] == [1.5, None, None, float("inf")]


def test_source_rules(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(raw, "ORDER_BLOCK_ROWS", 2)
    root = tmp_path / "A"
    save(pandas_book(["09:30:00", "09:30:03", "09:30:01", "09:30:06", "09:30:05"]), root / "20260105.parquet")
    save(pandas_book(["09:30:00"]), root / "20260106.parquet")  # the same date again
    two = pandas_book(["09:30:00", "09:31:00"], day="2026-01-08")
    two.loc[1, "timestamp"] = at("09:30:00", "2026-01-09")
    save(two, root / "20260108.parquet")
    save(pandas_book(["03:00:00"], day="2026-01-07"), root / "20260109.parquet")
    prepared = raw.read_snapshots(spark, str(root))
    got = {r["rule"]: r["violations"] for r in raw.source_violations(prepared).collect()}
    assert got == {
        "timestamps not in order": 2, "several files for one trade date": 2,
        "several trade dates in one file": 2, "no configured session in file": 1,
        "files not in date order": 1,
    }
    with pytest.raises(ValueError, match="raw files"):
        raw.raise_on_violations(raw.source_violations(prepared), "raw files")


def dates(spark, n, ticker="A"):
    start = dt.date(2026, 1, 1)
    rows = [(ticker, (start + dt.timedelta(days=i)).isoformat()) for i in range(n)]
    return splits.trade_dates(spark.createDataFrame(rows, "ticker string, trade_date string").repartition(3))


def sizes(plan):
    return {r["split"]: r["count"] for r in plan.groupBy("split").count().collect()}


def test_ratio_split(spark):
    assert sizes(splits.chronological_split(dates(spark, 10))) == {"train": 6, "validation": 2, "test": 2}
    with pytest.raises(ValueError):
        splits.chronological_split(dates(spark, 10), train_ratio=0.9, validation_ratio=0.2)


def test_explicit_split(spark):
    ranges = {"train": ("2026-01-01", "2026-01-03"), "validation": ("2026-01-04", "2026-01-04"), "test": ("2026-01-05", "2026-01-05")}
    got = splits.explicit_split(dates(spark, 5), **ranges)
    assert sizes(got) == {"train": 3, "validation": 1, "test": 1}
    assert got.filter("coverage <> 1").count() == 0
    wide = {**ranges, "validation": ("2026-01-03", "2026-01-04")}
    assert splits.explicit_split(dates(spark, 6), **wide).filter("coverage <> 1").count() == 3
    for bad in ({**ranges, "test": None}, {**ranges, "test": ("2026-01-06", "2026-01-05")}, {**ranges, "test": ("20260105", "20260106")}):
        with pytest.raises(ValueError):
            splits.explicit_split(dates(spark, 5), **bad)


@pytest.mark.parametrize(("n", "step"), [(12, 2), (13, 2), (10, 1), (9, 1), (30, 7)])
def test_walk_forward(spark, n, step):
    plan = splits.walk_forward_folds(dates(spark, n), train_days=6, validation_days=2, test_days=2, step_days=step)
    got = {}
    for r in plan.collect():
        got.setdefault((r["fold_index"], r["split"]), []).append(int(r["trade_date"][-2:]) - 1)
    want, start, index = {}, 0, 1
    while start + 10 <= n:
        for name, a, b in (("train", 0, 6), ("validation", 6, 8), ("test", 8, 10)):
            want[(index, name)] = list(range(start + a, start + b))
        start, index = start + step, index + 1
    assert {k: sorted(v) for k, v in got.items()} == want
    assert splits.fold_violations(plan).count() == 0


def test_fold_selection_and_rules(spark):
    plan = splits.walk_forward_folds(dates(spark, 14), train_days=6, validation_days=2, test_days=2, step_days=2)
    assert {r[0] for r in splits.select_folds(plan, 2).select("fold_index").collect()} == {2, 3}
    for bad in ((4, None), (3, 2)):
        with pytest.raises(ValueError):
            splits.select_folds(plan, *bad)
    swapped = plan.replace({"test": "train", "train": "test"}, subset="split")
    assert splits.fold_violations(swapped).count() == 3
    assert splits.fold_violations(plan.filter("split <> 'validation'")).count() == 3
    odd = spark.createDataFrame([("A", "2026-1-5"), ("A", "2026-01-06"), ("A", "2026-01-06")], "ticker string, trade_date string")
    assert {r["rule"] for r in splits.date_violations(odd).collect()} == {"not an ISO date", "repeated date"}


def test_random_values_survive_numpy_nan(spark):
    frame = spark.createDataFrame([(float(np.nan),), (1.0,)], "v double")
    assert [r[0] for r in frame.select(raw.lenient_double("v")).collect()] == [None, 1.0]
