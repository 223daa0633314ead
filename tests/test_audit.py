"""Audit rules on hand-made tables: each damage breaks its rule, and a table is read once."""

import datetime as dt

import pytest

from depthframe.operators import validation
from depthframe.schema import FOLD_INDEX_SCHEMA, PREDICTION_SCHEMA, QUALITY_SCHEMA, ROWS_SCHEMA

DATES = ["2026-01-05", "2026-01-06", "2026-01-07"]
SPLIT = dict(zip(DATES, ["train", "validation", "test"]))
PER_SESSION, HISTORY = 4, 2


def moment(date, i):
    return dt.datetime.fromisoformat(f"{date} 09:30:0{i}")


def row_table():
    out = []
    for d, date in enumerate(DATES):
        for i in range(PER_SESSION):
            start = d * PER_SESSION
            out.append(
                dict(
                    ticker="A", trade_date=date, session_id="am", timestamp=moment(date, i), global_index=start + i,
                    session_start_index=start, row_no=i, features=[1.0, 2.0], target=0.5, row_valid=True,
                    target_valid=True, mid_t=10.0, future_mid=10.1, bid1=9.9, ask1=10.1, is_anchor=i >= HISTORY - 1,
                )
            )
    return out


def quality_table():
    return [
        dict(
            ticker="A", trade_date=date, row_count=PER_SESSION, missing_ratio=0.0, duplicate_count=0,
            crossed_book_count=0, one_side_missing_count=0, max_gap=1.0, p95_gap=1.0, stale_snapshot_ratio=0.0,
            invalid_level_order_count=0,
        )
        for date in DATES
    ]


def fold_table():
    return [
        dict(
            ticker="A", fold_index=1, split=SPLIT[r["trade_date"]], global_anchor_index=r["global_index"],
            session_start_index=r["session_start_index"], anchor_index=r["row_no"], trade_date=r["trade_date"],
            session_id="am", anchor_timestamp=r["timestamp"],
        )
        for r in row_table()
        if r["is_anchor"]
    ]


def prediction_table():
    return [
        dict(
            model_name="m", model_version="1", dataset_version="v", fold_index=1, split="test", ticker="A",
            trade_date=DATES[2], session_id="am", anchor_timestamp=moment(DATES[2], i), mid_t=10.0, future_mid=10.1,
            target=0.1, prediction=0.2, bid1=9.9, ask1=10.1, spread=0.2,
        )
        for i in range(3)
    ]


TABLES = {
    "rows": (row_table, ROWS_SCHEMA),
    "quality": (quality_table, QUALITY_SCHEMA),
    "folds": (fold_table, FOLD_INDEX_SCHEMA),
    "predictions": (prediction_table, PREDICTION_SCHEMA),
}


def frames(spark, **changed):
    out = {}
    for name, (make, schema) in TABLES.items():
        rows = changed.get(name, make())
        out[name] = spark.createDataFrame([tuple(r[f.name] for f in schema) for r in rows], schema)
    return out


def checks(t, name):
    if name == "rows":
        return validation.row_checks(t["rows"], 2)
    if name == "quality":
        return validation.quality_checks(t["quality"], t["rows"])
    if name == "folds":
        return validation.fold_checks(t["folds"], t["rows"], HISTORY)
    return validation.prediction_checks(t["predictions"])


def broken(spark, name, **changed):
    return {r["rule"]: r["violations"] for r in checks(frames(spark, **changed), name).collect() if r["violations"]}


def with_change(rows, at, **values):
    return [{**r, **values} if i == at else r for i, r in enumerate(rows)]


def test_good_tables_pass(spark):
    for name in TABLES:
        assert broken(spark, name) == {}


@pytest.mark.parametrize(
    "name, change, want",
    [
        ("rows", dict(features=[1.0]), {"feature width": 1}),
        ("rows", dict(global_index=99), {"global index is session start plus position": 1}),
        ("rows", dict(row_no=3, global_index=3), {"session positions cover every row once": 1}),
        ("quality", dict(missing_ratio=1.5), {"ratios within 0 and 1": 1}),
        ("quality", dict(p95_gap=2.0), {"gaps ordered and not negative": 1}),
        ("quality", dict(duplicate_count=None), {"quality without nulls": 1}),
        ("quality", dict(duplicate_count=-1), {"counts not negative": 1}),
        ("quality", dict(row_count=5), {"quality rows match the dataset": 1}),
        ("quality", dict(trade_date=DATES[1]), {"one quality row per day": 1, "quality rows match the dataset": 1}),
        ("folds", dict(session_id="pm"), {"anchor describes its row": 1}),
        ("folds", dict(session_id=None), {"anchor describes its row": 1, "fold index without nulls": 1}),
        ("folds", dict(anchor_index=7), {"global minus start is local": 1}),
        ("folds", dict(fold_index=2), {"fold has train, validation and test": 1, "splits strictly one after another": 1}),
        ("predictions", dict(prediction=float("nan")), {"numbers finite": 1}),
        ("predictions", dict(model_version=" "), {"names not empty": 1}),
        ("predictions", dict(fold_index=0), {"fold index positive": 1}),
        ("predictions", dict(anchor_timestamp=moment(DATES[0], 0)), {"timestamp falls on its trade date": 1}),
    ],
)
def test_one_damage_breaks_its_rule(spark, name, change, want):
    assert broken(spark, name, **{name: with_change(TABLES[name][0](), 0, **change)}) == want


def test_damage_of_whole_groups(spark):
    rows, folds = row_table(), fold_table()
    moved = [{**r, "session_start_index": 5, "global_index": 5 + r["row_no"]} if r["trade_date"] == DATES[1] else r for r in rows]
    assert broken(spark, "rows", rows=moved) == {"sessions cover every global row once": 1}
    assert broken(spark, "rows", rows=with_change(rows, 0, session_start_index=-1, global_index=-1))["one start per session"] == 1
    assert broken(spark, "folds", folds=folds + folds[:2]) == {"anchor unique in its split": 2}
    outside = dict(global_anchor_index=400, anchor_index=400)
    assert broken(spark, "folds", folds=with_change(folds, 0, **outside)) == {
        "anchor inside the dataset": 1, "anchor window and target valid": 1, "anchor describes its row": 1,
    }
    swapped = [{**f, "split": "test" if f["split"] == "train" else "train" if f["split"] == "test" else f["split"]} for f in folds]
    assert broken(spark, "folds", folds=swapped) == {"splits strictly one after another": 1}
    assert broken(spark, "folds", rows=with_change(rows, 1, target_valid=False)) == {"anchor window and target valid": 1}
    assert broken(spark, "predictions", predictions=prediction_table() * 2) == {"sample unique per model and fold": 3}


def test_empty_tables(spark):
    assert broken(spark, "rows", rows=[]) == {}
    assert broken(spark, "quality", quality=[], rows=[]) == {"quality not empty": 1}
    assert broken(spark, "quality", quality=[]) == {"quality not empty": 1, "quality rows match the dataset": 3}
    assert broken(spark, "folds", folds=[]) == {"fold index not empty": 1}
    assert broken(spark, "predictions", predictions=[]) == {"predictions not empty": 1}


def test_a_table_is_read_once(spark, tmp_path):
    for name, df in frames(spark).items():
        df.write.parquet(str(tmp_path / name))
    stored = {n: spark.read.schema(s).parquet(str(tmp_path / n)) for n, (_, s) in TABLES.items()}
    scans = {n: checks(stored, n)._jdf.queryExecution().sparkPlan().toString().count("FileScan parquet") for n in TABLES}
    assert scans == {"rows": 1, "quality": 2, "folds": 2, "predictions": 1}
