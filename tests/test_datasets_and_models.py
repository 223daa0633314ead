import datetime as dt
import json

import numpy as np
import pandas as pd
import pytest
from conftest import at
from pyspark.sql import functions as F

from depthframe.operators import baselines as bl
from depthframe.operators import validation
from depthframe.plans.build import BuildConfig, build_dataset
from depthframe.plans.walkforward import candidate_predictions, run_walk_forward, split_rows
from depthframe.schema import PREDICTION_SCHEMA, RAW_COLUMNS
from depthframe.sources import package as pkg

CONFIG = BuildConfig(
    interval_seconds=3, horizon_seconds=6, tolerance_seconds=0, history=2, normalize_window=2,
    walk_forward={"train_days": 2, "validation_days": 1, "test_days": 1, "step_days": 1},
)


def raw_day(root, day, steps=12, ticker="A", seed=0):
    rng = np.random.default_rng(seed + day)
    rows = []
    for step in range(steps):
        mid = 10 + 0.01 * day + 0.001 * step + 0.0005 * rng.normal()
        row = {"timestamp": at("09:30:00", f"2026-01-{day:02d}") + dt.timedelta(seconds=3 * step)}
        for i in range(1, 6):
            row[f"ASKp{i}"], row[f"BIDp{i}"] = mid + 0.01 * i, mid - 0.01 * i
            row[f"ASKs{i}"], row[f"BIDs{i}"] = 100.0 + step + rng.integers(9), 100.0 + step + rng.integers(9)
        row |= {"last": mid, "volume": 1000.0 + step, "amount": 10000.0 + step}
        rows.append(row)
    path = root / ticker / f"2026-01-{day:02d}.parquet"
    path.parent.mkdir(parents=True, exist_ok=True)
    pd.DataFrame(rows)[["timestamp", *RAW_COLUMNS]].to_parquet(path, index=False, coerce_timestamps="us")


@pytest.fixture(scope="module")
def built(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("raw")
    for day in range(1, 6):
        raw_day(root, day, 40)
        raw_day(root, day, 40, "B", seed=50)
    out = tmp_path_factory.mktemp("out")
    return root, out, build_dataset(spark, str(root), ["A", "B"], str(out), CONFIG)


def test_build_is_published_once(spark, built):
    root, out, package = built
    again = build_dataset(spark, str(root), ["B", "A"], str(out), CONFIG)
    assert again.root == package.root
    assert [p.name for p in out.iterdir() if not p.name.startswith(".")] == [package.record.version]
    assert {r[0] for r in package.plan().select("fold_index").distinct().collect()} == {1, 2}
    wider = BuildConfig(**{**CONFIG.__dict__, "history": 3})
    other = build_dataset(spark, str(root), ["A", "B"], str(out), wider)
    assert other.record.version != package.record.version


def test_open_and_read(spark, built):
    package = pkg.audited_package(spark, built[2].root)
    assert package.rows().count() == 5 * 40 * 2
    assert package.quality().count() == 10
    assert package.fold(1, "test").count() > 0
    with pytest.raises(ValueError):
        package.fold(9, "test")
    with pytest.raises(ValueError):
        pkg.find_package(spark, str(built[1]))
    features = package.rows().filter("is_anchor").first()["features"]
    assert len(features) == 23


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_windows_over_a_stored_dataset_need_no_exchange(spark, built):
    from depthframe.operators.samples import window_samples

    def mean_score(windows):
        return windows.mean(axis=(1, 2))

    package = built[2]
    rows, history = package.rows(), package.record.history
    scored = bl.score_windows(rows, mean_score, history, ["ticker"])
    windows = window_samples(rows, history)
    assert "Exchange" not in plan_of(scored) and "Exchange" not in plan_of(windows)
    assert "rows_" not in " ".join(t.name for t in spark.catalog.listTables())
    loose = rows.drop("storage_part")
    assert "Exchange" in plan_of(bl.score_windows(loose, mean_score, history, ["ticker"]))
    want = sorted(map(str, bl.score_windows(loose, mean_score, history, ["ticker"]).collect()))
    assert sorted(map(str, scored.collect())) == want and len(want) == rows.filter("is_anchor").count()
    folder = built[1] / package.record.version
    assert list(folder.glob("data-*/rows/part-*.parquet")) and not list(folder.glob("data-*/rows/trade_date=*"))


def test_models_fit_from_a_stored_dataset_without_moving_its_rows(spark, built):
    package = built[2]
    rows, plan = package.rows(), package.plan()
    ridge = bl.RidgeBaseline(len(package.record.features), package.record.history)
    got = candidate_predictions(rows, plan, ridge)
    other = bl.RidgeBaseline(len(package.record.features), package.record.history)
    want = candidate_predictions(rows.drop("storage_part"), plan, other)
    key = ["ticker", "fold_index", "anchor_timestamp"]
    pairs = got.select(*key, "prediction").join(want.select(*key, F.col("prediction").alias("want")), key, "full")
    assert pairs.count() > 0
    assert pairs.filter("prediction IS NULL OR want IS NULL OR abs(prediction - want) > 1e-12").count() == 0


def test_a_session_above_a_bucket_is_stored_by_date(spark, built, tmp_path, monkeypatch):
    root, _, whole = built
    monkeypatch.setattr(pkg, "BUCKET_ROWS", 39)
    package = build_dataset(spark, str(root), ["A", "B"], str(tmp_path / "it's"), CONFIG)
    assert sorted(p.name for p in tmp_path.glob("it's/*/data-*/rows/trade_date=*"))[0] == "trade_date=2026-01-01"
    columns = [c for c in whole.rows().columns if c != "storage_part"]
    both = package.rows().select(columns), whole.rows().select(columns)
    assert both[0].exceptAll(both[1]).count() == both[1].exceptAll(both[0]).count() == 0
    assert pkg.audited_package(spark, package.root).rows().count() == 400
    monkeypatch.setattr(pkg, "BUCKET_ROWS", 60)
    again = build_dataset(spark, str(root), ["A", "B"], str(tmp_path / "it's too"), CONFIG)
    assert "storage_part" in again.rows().columns and again.rows().count() == 400


def test_record_names_the_folder_and_is_strict(built):
    record = built[2].record
    assert built[2].root.endswith(record.version)
    assert pkg.Record.from_json(record.to_json()).version == record.version
    value = json.loads(record.to_json())
    assert value["settings"]["scaler"]["window"] == 2
    assert pkg.Record(**{**value, "history": 5}).version != record.version
    bad = [
        {**value, "colour": 1}, {k: v for k, v in value.items() if k != "plan"}, {**value, "tickers": ["A", " "]},
        {**value, "history": 0}, {**value, "features": ["x", "x"]}, {**value, "format": 1}, {**value, "source": ""},
    ]
    for one in bad:
        with pytest.raises(ValueError):
            pkg.Record.from_json(json.dumps(one))


def test_build_reads_raw_files_once_and_stops_on_short_instruments(spark, tmp_path, monkeypatch):
    from depthframe.sources import raw

    for day in range(1, 6):
        raw_day(tmp_path / "raw", day, 20)
    for day in (2, 3):
        raw_day(tmp_path / "raw", day, 20, "B")
    reads = []
    real = raw.read_snapshots
    monkeypatch.setattr(raw, "read_snapshots", lambda *a, **k: reads.append(1) or real(*a, **k))
    with pytest.raises(ValueError, match="too few dates"):
        build_dataset(spark, str(tmp_path / "raw"), ["A", "B"], str(tmp_path / "out"), CONFIG)
    assert len(reads) == 1
    ranges = {"train": ("2026-01-01", "2026-01-02"), "validation": ("2026-01-03", "2026-01-03"), "test": ("2026-01-05", "2026-01-09")}
    some = {**CONFIG.__dict__, "walk_forward": None, "split_ranges": ranges}
    with pytest.raises(ValueError, match="exactly one range"):
        build_dataset(spark, str(tmp_path / "raw"), ["A"], str(tmp_path / "out"), BuildConfig(**some))
    some["split_ranges"] = {**ranges, "test": ("2026-01-04", "2026-01-09")}
    package = build_dataset(spark, str(tmp_path / "raw"), ["A"], str(tmp_path / "out"), BuildConfig(**some))
    assert package.plan().count() == 5
    some["split_ranges"], some["split_ratios"] = None, {"train_ratio": 0.1, "validation_ratio": 0.3}
    with pytest.raises(ValueError, match="splits without dates"):
        build_dataset(spark, str(tmp_path / "raw"), ["A"], str(tmp_path / "out"), BuildConfig(**some))
    assert [p.name for p in (tmp_path / "out").iterdir() if not p.name.startswith(".")] == [package.record.version]


def broken_rules(checks):
    return {r["rule"] for r in checks.filter("violations > 0").collect()}


def test_corruption_is_found(built):
    package = built[2]
    rows, quality, folds = package.rows(), package.quality(), package.folds()
    assert broken_rules(package.checks()) == set()
    width = validation.row_checks(rows.withColumn("features", F.slice("features", 1, 3)), 23)
    assert broken_rules(width) == {"feature width"}
    gone = validation.row_checks(rows.filter("global_index <> 17"), 23)
    assert "session positions cover every row once" in broken_rules(gone)
    doubled = validation.quality_checks(quality.unionByName(quality.limit(1)), rows)
    assert "one quality row per day" in broken_rules(doubled)
    wrong = validation.quality_checks(quality.withColumn("missing_ratio", F.lit(1.5)), rows)
    assert broken_rules(wrong) == {"ratios within 0 and 1"}
    assert "quality rows match the dataset" in broken_rules(
        validation.quality_checks(quality.filter("trade_date <> '2026-01-03'"), rows)
    )
    moved = folds.withColumn("global_anchor_index", F.col("global_anchor_index") + 10**6)
    assert {"anchor inside the dataset", "global minus start is local"} <= broken_rules(
        validation.fold_checks(moved, rows, 2)
    )
    damaged = rows.withColumn("row_valid", F.col("row_valid") & (F.col("row_no") != 20))
    assert broken_rules(validation.fold_checks(folds, damaged, 2)) == {"anchor window and target valid"}
    assert "fold has train, validation and test" in broken_rules(
        validation.fold_checks(folds.filter("split <> 'test'"), rows, 2)
    )
    assert "anchor unique in its split" in broken_rules(
        validation.fold_checks(folds.unionByName(folds.limit(1)), rows, 2)
    )
    late = folds.withColumn("anchor_timestamp", F.expr("anchor_timestamp + INTERVAL '1' SECOND"))
    assert broken_rules(validation.fold_checks(late, rows, 2)) == {"anchor describes its row"}
    with pytest.raises(ValueError, match="feature width"):
        validation.raise_if_broken(width, "rows")
    with pytest.raises(ValueError, match="schema"):
        validation.check_schema(rows.withColumn("target", F.lit(1)), validation.SCHEMAS["rows"], "rows")


def test_segment_checks(built):
    rows = built[2].rows()
    assert broken_rules(validation.segment_checks(rows)) == set()
    twice = rows.withColumn("timestamp", F.date_trunc("day", "timestamp").cast("timestamp_ntz"))
    assert broken_rules(validation.segment_checks(twice)) == {"timestamps unique within a session"}


def test_level_sizes_need_both_sides():
    names = ["last", "ASKs3", "BIDs1", "BIDs3", "ASKs1", "volume"]
    assert bl.level_sizes(names) == [(2, 4), (3, 1)]
    for bad in ([], ["BIDs2", "ASKs2", "BIDs2"], ["volume"], ["BIDs1", "ASKs1", "ASKs4"]):
        with pytest.raises(ValueError):
            bl.level_sizes(bad)


def synthetic(spark, n, features, target, history=1, fold=1):
    """One session of samples with given features and targets."""
    start = dt.datetime(2026, 1, 5, 9, 30)
    rows = [
        ("A", fold, "2026-01-05", "AM", start + dt.timedelta(seconds=i), i, 0, i, [float(v) for v in features[i]],
         float(target[i]), i >= history - 1, 1.0, 1.0, 1.0, 1.0)
        for i in range(n)
    ]
    schema = (
        "ticker string, fold_index bigint, trade_date string, session_id string, timestamp timestamp_ntz, row_no bigint,"
        " session_start_index bigint, global_index bigint, features array<float>, target float, is_anchor boolean,"
        " mid_t float, future_mid float, bid1 float, ask1 float"
    )
    return spark.createDataFrame(rows, schema)


def test_imbalance_fit_is_exact(spark):
    rng = np.random.default_rng(3)
    sizes = rng.uniform(1, 9, size=(40, 2)).astype("float32")
    y = 2 * (sizes[:, 0] - sizes[:, 1]) / sizes.sum(axis=1) + 0.5
    rows = synthetic(spark, 40, sizes, y)
    model = bl.ImbalanceBaseline(["BIDs1", "ASKs1"])
    with pytest.raises(RuntimeError):
        model.predict(rows)
    got = model.fit(rows).coefficients.first()
    assert (got["slope"], got["intercept"]) == (pytest.approx(2, abs=1e-5), pytest.approx(0.5, abs=1e-5))
    flat = synthetic(spark, 10, np.ones((10, 2)), np.arange(10))
    got = bl.ImbalanceBaseline(["BIDs1", "ASKs1"]).fit(flat).coefficients.first()
    assert (got["slope"], got["intercept"]) == (0.0, 4.5)
    with pytest.raises(Exception, match="no training samples"):
        model.fit(rows.withColumn("fold_index", F.lit(2).cast("bigint"))).predict(rows).collect()
    zero = synthetic(spark, 2, np.array([[1, -1], [0, 0]]), [0, 0])
    got = bl.add_imbalance(zero, ["BIDs1", "ASKs1"]).collect()
    assert [r["imbalance"] for r in got] == [0.0, 0.0]


@pytest.mark.parametrize(("alpha", "chunk"), [(0.0, 65536), (2.5, 65536), (2.5, 16)])
def test_ridge_against_closed_form(spark, monkeypatch, alpha, chunk):
    monkeypatch.setattr(bl, "CHUNK_ROWS", chunk)
    monkeypatch.setattr(bl, "LAGS_TOGETHER", 2)
    rng = np.random.default_rng(4)
    n, history, width = 90, 3, 2
    x = rng.normal(size=(n, width)).astype("float32").astype("float64")
    windows = np.stack([x[i - history + 1 : i + 1].ravel() for i in range(history - 1, n)])
    y = np.zeros(n)
    y[history - 1 :] = windows @ rng.normal(size=history * width) + 0.3 + 0.1 * rng.normal(size=len(windows))
    y = y.astype("float32").astype("float64")
    rows = synthetic(spark, n, x, y, history)
    model = bl.RidgeBaseline(width, history, alpha)
    with pytest.raises(RuntimeError):
        model.predict(rows)
    model.fit(rows)
    t = y[history - 1 :]
    c = windows - windows.mean(axis=0)
    want = np.linalg.solve(c.T @ c + alpha * np.eye(history * width), c.T @ (t - t.mean()))
    got = model.coefficients.first()
    assert got["weights"] == pytest.approx(want.tolist(), abs=1e-6)
    assert got["train_count"] == len(t)
    predicted = [r["prediction"] for r in model.predict(rows).orderBy("timestamp").collect()]
    assert predicted == pytest.approx((windows @ want + got["intercept"]).tolist(), abs=1e-6)


def test_scoring_checks_its_model(spark):
    rows = synthetic(spark, 6, np.arange(12).reshape(6, 2), np.zeros(6), history=2)
    got = bl.score_windows(rows, lambda w: w.sum(axis=(1, 2)), 2).orderBy("timestamp").collect()
    assert [r["prediction"] for r in got] == [6.0, 14.0, 22.0, 30.0, 38.0]
    for bad in (lambda w: np.zeros((len(w), 2)), lambda w: np.full(len(w), np.nan)):
        with pytest.raises(Exception, match="prediction"):
            bl.score_windows(rows, bad, 2).collect()


def test_grouped_candidate_equals_a_plain_fit(spark, built):
    package = built[2]
    plan = package.plan()
    got = candidate_predictions(package.rows(), plan, bl.GroupedCandidate(bl.OneFeature(3)))
    got = {(r["ticker"], r["fold_index"], r["anchor_timestamp"]): r["prediction"] for r in got.collect()}
    want = {}
    train, test = (
        split_rows(package.rows(), plan, s).filter("is_anchor").select("ticker", "fold_index", "timestamp", "features", "target").toPandas()
        for s in ("train", "test")
    )
    for key, rows in train.groupby(["ticker", "fold_index"]):
        x = np.array([f[3] for f in rows["features"]], dtype=float)
        slope, intercept = np.polyfit(x, rows["target"].astype(float), 1)
        for r in test[(test["ticker"] == key[0]) & (test["fold_index"] == key[1])].itertuples():
            want[(*key, r.timestamp.to_pydatetime())] = slope * float(r.features[3]) + intercept
    assert want and got.keys() == want.keys()
    assert [got[k] for k in want] == pytest.approx(list(want.values()), rel=1e-6, abs=1e-12)
    with pytest.raises(RuntimeError):
        bl.GroupedCandidate(bl.OneFeature(0)).predict(package.rows())


def test_walk_forward_run(spark, built, tmp_path):
    package = built[2]
    names = package.record.features
    candidates = [
        bl.ZeroBaseline(), bl.ImbalanceBaseline(names), bl.RidgeBaseline(len(names), 2),
        bl.TrainedModel("last", lambda w: w[:, -1, 0] * 1e-4, 2),
    ]
    out = str(tmp_path / "predictions")
    version = package.record.version
    run = run_walk_forward(
        package.rows(), package.plan(), candidates, out, dataset_version=version,
        n_bins=3, draws=5, block=4,
    )
    assert {f.name for f in run.predictions.schema} == {f.name for f in PREDICTION_SCHEMA}
    assert run.predictions.count() == 4 * package.folds().filter("split = 'test'").count()
    summary = {(r["ticker"], r["model_name"]): r for r in run.summary.collect()}
    assert len(summary) == 8
    assert {r["fold_count"] for r in summary.values()} == {2}
    assert summary[("A", "zero")]["ts_ic_mean"] is None
    assert summary[("A", "ridge")]["mae_mean"] > 0
    assert run.bins.count() == 4 * 2 * 2 * 3
    assert run.intervals.filter("metric = 'mae' AND lower <= estimate AND estimate <= upper").count() > 0
    assert run.daily_summary.count() == 16
    identity = validation.identity_checks(run.predictions, dataset_version="other", models=["zero"], folds=[1])
    assert broken_rules(identity) == {"dataset version", "known model", "known fold"}
    twice = validation.prediction_checks(run.predictions.unionByName(run.predictions.limit(1)))
    assert broken_rules(twice) == {"sample unique per model and fold"}
    with pytest.raises(ValueError, match="unique"):
        run_walk_forward(package.rows(), package.plan(), [bl.ZeroBaseline()] * 2, out, dataset_version=version)


def test_run_log_merges_sections(spark, tmp_path):
    root = str(tmp_path / "runs")
    pkg.log_run(spark, root, "e1", "data", {"rows": 3})
    pkg.log_run(spark, root, "e1", "result", {"mae": 0.5})
    pkg.log_run(spark, root, "e1", "data", {"rows": 4})
    got = {(r["header"], r["key"]): r["value"] for r in pkg.read_runs(spark, root).collect()}
    assert got == {("data", "rows"): "4", ("result", "mae"): "0.5"}
    for bad in ("", "..", "a/b"):
        with pytest.raises(ValueError):
            pkg.log_run(spark, root, bad, "data", {})


def test_two_builders_publish_one_dataset(spark, tmp_path, monkeypatch):
    """A second build of the same inputs finishes while the first is about to publish."""
    for day in range(1, 6):
        raw_day(tmp_path / "raw", day, 40)
    out, plain, inner = tmp_path / "out", pkg.publish, []

    def late(spark, staged, output_root, record):
        monkeypatch.setattr(pkg, "publish", plain)
        inner.append(build_dataset(spark, str(tmp_path / "raw"), ["A"], str(out), CONFIG))
        return plain(spark, staged, output_root, record)

    monkeypatch.setattr(pkg, "publish", late)
    first = build_dataset(spark, str(tmp_path / "raw"), ["A"], str(out), CONFIG)
    assert first.root == inner[0].root and first.data == inner[0].data
    assert [p.name for p in out.iterdir()] == [first.record.version]
    folders = [p.name for p in (out / first.record.version).iterdir() if p.is_dir()]
    assert folders == [first.data.rsplit("/", 1)[-1]]
    assert pkg.audited_package(spark, first.root).rows().count() == 5 * 40


def test_an_unfinished_marker_is_waited_for(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(pkg, "PATIENCE", 1)
    (tmp_path / pkg.MARKER).write_text("")
    with pytest.raises(ValueError, match="names no folder"):
        pkg.find_package(spark, str(tmp_path))


def test_readers_see_the_old_or_the_new_table(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "t")
    with pytest.raises(ValueError, match="no table"):
        pkg.current_table(spark, path)
    read = lambda: sorted(r[0] for r in spark.read.parquet(pkg.current_table(spark, path)).collect())
    pkg.replace_table(spark.range(3), path)
    opened = spark.read.parquet(pkg.current_table(spark, path))
    plain, seen = pkg.Files.replace_text, []

    def between(files, p, text):
        seen.append(read())  # the new version is written, the pointer still names the old one
        plain(files, p, text)
        seen.append(read())

    monkeypatch.setattr(pkg.Files, "replace_text", between)
    pkg.replace_table(spark.range(5), path)
    assert seen == [[0, 1, 2], [0, 1, 2, 3, 4]]
    assert opened.count() == 3  # the version before is still there
    pkg.replace_table(spark.range(6), path)
    assert read() == list(range(6))
    assert len([p for p in (tmp_path / "t").iterdir() if p.is_dir()]) <= 2


def test_saved_models_predict_the_same(spark, built, tmp_path):
    package = built[2]
    rows, plan, names = package.rows(), package.plan(), package.record.features
    for model in (bl.ZeroBaseline(), bl.ImbalanceBaseline(names), bl.RidgeBaseline(len(names), 2, 3.0)):
        path = str(tmp_path / model.name)
        with pytest.raises(RuntimeError):
            pkg.save_model(model, path)
        want = candidate_predictions(rows, plan, model).orderBy("ticker", "fold_index", "anchor_timestamp").collect()
        pkg.save_model(model, path)
        loaded = pkg.load_model(spark, path)
        got = loaded.predict(split_rows(rows, plan, "test")).orderBy("ticker", "fold_index", "timestamp").collect()
        assert [r["prediction"] for r in got] == pytest.approx([r["prediction"] for r in want])
    path = str(tmp_path / "zero")
    pkg.Files(spark, path).replace_text(f"{path}/model.json", '{"name": "other", "settings": {}}')
    with pytest.raises(ValueError, match="unknown"):
        pkg.load_model(spark, str(tmp_path / "zero"))
