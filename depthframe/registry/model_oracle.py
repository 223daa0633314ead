"""SQL for the baseline and validation queries."""

from __future__ import annotations

from depthframe.registry import inputs
from depthframe.registry.evaluation_oracle import PREDS
from depthframe.registry.oracle import DATES, K, LINE, PLAN, ROWS, SNAP, r

_N = len(inputs.SAMPLE_FEATURES)


def _sum(side: str) -> str:
    return " + ".join(f"z_{f}::FLOAT::DOUBLE" for f in inputs.SAMPLE_FEATURES if f.startswith(side))


FOLDED = f"""{ROWS}, {DATES[len(SNAP) + 1:]}, {PLAN},
sample AS (
  SELECT s.*, p.fold_index, p.split, log_return::FLOAT::DOUBLE AS y,
         {_sum("BID")} AS bid, {_sum("ASK")} AS ask
  FROM stored s JOIN plan p ON s.ticker = p.ticker AND s.trade_date = p.trade_date WHERE is_anchor),
xy AS (SELECT *, CASE WHEN abs(bid + ask) > 1.1920929e-07 THEN (bid - ask) / (bid + ask) ELSE 0 END AS x FROM sample),
fit AS (
  SELECT ticker, fold_index, count(*) AS train_count, coalesce(regr_slope(y, x), 0) AS slope,
         coalesce(regr_intercept(y, x), avg(y)) AS intercept
  FROM xy WHERE split = 'train' GROUP BY ticker, fold_index)"""


def _predictions(model: str, value: str) -> str:
    return f"""WITH {FOLDED}
SELECT '{model}' AS model_name, q.fold_index, q.ticker, q.trade_date, q.session_id,
  CAST(q.ts AS VARCHAR) AS anchor_timestamp, {r("y", 7)} AS target, {r(value, 7)} AS prediction,
  {r("ASKp1::FLOAT::DOUBLE - BIDp1::FLOAT::DOUBLE", 5)} AS spread
FROM xy q JOIN fit f ON q.ticker = f.ticker AND q.fold_index = f.fold_index WHERE q.split = 'test'"""


def _ridge(features: list[str], history: int, alpha: float) -> str:
    """Ridge weights per fold, by elimination on the centred normal equations.

    The matrix is a table of cells (i, j, v) with the right-hand side as its last column; every
    step clears one column in all other rows.
    """
    size = len(features) * history
    row = ", ".join(f"s.z_{f}::FLOAT::DOUBLE" for f in features)
    steps = "".join(
        f"""
m{k + 1} AS MATERIALIZED (
  SELECT r.ticker, r.fold_index, r.i, r.j, CASE WHEN r.i = {k} THEN r.v / p.v ELSE r.v - c.v * e.v / p.v END AS v
  FROM m{k} r
  JOIN m{k} p ON p.ticker = r.ticker AND p.fold_index = r.fold_index AND p.i = {k} AND p.j = {k}
  JOIN m{k} e ON e.ticker = r.ticker AND e.fold_index = r.fold_index AND e.i = {k} AND e.j = r.j
  JOIN m{k} c ON c.ticker = r.ticker AND c.fold_index = r.fold_index AND c.i = r.i AND c.j = {k}
  WHERE r.j > {k}),"""
        for k in range(size)
    )
    return f"""WITH {FOLDED},
win AS MATERIALIZED (
  SELECT q.ticker, q.fold_index, q.split, q.trade_date, q.session_id, q.ts, q.y, q.ASKp1, q.BIDp1, q.global_index,
         flatten(list([{row}] ORDER BY s.row_no)) AS w
  FROM xy q JOIN stored s ON s.ticker = q.ticker AND s.trade_date = q.trade_date AND s.session_id = q.session_id
    AND s.row_no BETWEEN q.row_no - {history - 1} AND q.row_no
  GROUP BY ALL),
long AS MATERIALIZED (
  SELECT ticker, fold_index, global_index, y, unnest(range({size})) AS j, unnest(w) AS x FROM win WHERE split = 'train'),
means AS (SELECT ticker, fold_index, j, count(*) AS n, avg(x) AS mx, avg(y) AS my FROM long GROUP BY ALL),
mid AS MATERIALIZED (
  SELECT l.ticker, l.fold_index, l.global_index, l.j, l.x - m.mx AS x, l.y - m.my AS y
  FROM long l JOIN means m ON l.ticker = m.ticker AND l.fold_index = m.fold_index AND l.j = m.j),
m0 AS MATERIALIZED (
  SELECT a.ticker, a.fold_index, a.j AS i, b.j AS j, sum(a.x * b.x) + CASE WHEN a.j = b.j THEN {alpha}::DOUBLE ELSE 0 END AS v
  FROM mid a JOIN mid b ON a.ticker = b.ticker AND a.fold_index = b.fold_index AND a.global_index = b.global_index
  GROUP BY a.ticker, a.fold_index, a.j, b.j
  UNION ALL SELECT ticker, fold_index, j, {size}, sum(x * y) FROM mid GROUP BY ALL),{steps}
weights AS (
  SELECT m.ticker, m.fold_index, n, list(v ORDER BY i) AS weights, my - sum(v * mx) AS intercept
  FROM m{size} m JOIN means a ON m.ticker = a.ticker AND m.fold_index = a.fold_index AND m.i = a.j
  GROUP BY m.ticker, m.fold_index, n, my)"""


_SMALL = len(inputs.RIDGE_FEATURES) * inputs.RIDGE_HISTORY
_RIDGE = f"""{_ridge(inputs.RIDGE_FEATURES, inputs.RIDGE_HISTORY, inputs.RIDGE_ALPHA)}
SELECT ticker, fold_index, n AS train_count, {", ".join(f"{r(f'weights[{i + 1}]', 8)} AS weight_{i}" for i in range(_SMALL))},
  {r("intercept", 8)} AS intercept FROM weights"""
_RIDGE_BASELINE = f"""{_ridge(inputs.SAMPLE_FEATURES, inputs.HISTORY, inputs.WIDE_ALPHA)}
SELECT 'ridge' AS model_name, q.fold_index, q.ticker, q.trade_date, q.session_id, CAST(q.ts AS VARCHAR) AS anchor_timestamp,
  {r("y", 7)} AS target, {r("list_dot_product(q.w, f.weights) + f.intercept", 7)} AS prediction,
  {r("ASKp1::FLOAT::DOUBLE - BIDp1::FLOAT::DOUBLE", 5)} AS spread
FROM win q JOIN weights f ON q.ticker = f.ticker AND q.fold_index = f.fold_index WHERE q.split = 'test'"""

def _logit(rounds: int) -> str:
    """Newton's method on one feature and an intercept, a fixed number of rounds."""
    steps = "".join(
        f""",
sum{k} AS MATERIALIZED (
  SELECT ticker, fold_index, any_value(a) AS a, any_value(b) AS b, count(*) AS n,
         sum((p - up) * x) + {inputs.LOGIT_ALPHA}::DOUBLE * any_value(a) AS ga, sum(p - up) AS gb,
         sum(p * (1 - p) * x * x) + {inputs.LOGIT_ALPHA}::DOUBLE AS aa, sum(p * (1 - p) * x) AS ab, sum(p * (1 - p)) AS bb
  FROM (SELECT t.*, w.a, w.b, 1 / (1 + exp(-(w.a * x + w.b))) AS p
        FROM tr t JOIN w{k} w ON t.ticker = w.ticker AND t.fold_index = w.fold_index)
  GROUP BY ticker, fold_index),
w{k + 1} AS MATERIALIZED (
  SELECT ticker, fold_index, n, ga, gb, a - (bb * ga - ab * gb) / (aa * bb - ab * ab) AS a,
         b - (aa * gb - ab * ga) / (aa * bb - ab * ab) AS b FROM sum{k})"""
        for k in range(rounds)
    )
    return f"""WITH {FOLDED},
tr AS MATERIALIZED (
  SELECT ticker, fold_index, z_ASKs1::FLOAT::DOUBLE AS x, (y > 0)::INT AS up FROM xy WHERE split = 'train'),
w0 AS (SELECT DISTINCT ticker, fold_index, 0.0::DOUBLE AS a, 0.0::DOUBLE AS b FROM tr){steps}"""


_ROUNDS = 12
_LAST = " + ".join(f"z_{f}::FLOAT::DOUBLE" for f in inputs.SAMPLE_FEATURES)

_ALL_RULES = [
    "feature width", "global index is session start plus position",
    "session positions cover every row once", "one start per session",
    "sessions cover every global row once", "quality not empty", "quality without nulls",
    "row count positive", "ratios within 0 and 1", "gaps ordered and not negative",
    "counts not negative", "one quality row per day", "quality rows match the dataset",
    "fold index not empty", "fold index without nulls", "fold positions not negative",
    "anchor inside the dataset", "global minus start is local", "anchor leaves room for its window",
    "anchor window and target valid", "anchor describes its row", "anchor unique in its split",
    "fold has train, validation and test", "splits strictly one after another",
]


def _rules(counts: dict[str, str], source: str) -> str:
    return " UNION ALL ".join(
        f"SELECT '{rule}' AS rule, ({expr})::BIGINT AS violations{source}" for rule, expr in counts.items()
    )


_PREDICTION_RULES = {
    "predictions not empty": "CASE WHEN count(*) = 0 THEN 1 ELSE 0 END",
    "numbers finite": "count(CASE WHEN p IS NULL OR t IS NULL THEN 1 END)",
    "names not empty": "0 * count(*)",
    "fold index positive": "count(CASE WHEN fold_index <= 0 THEN 1 END)",
    "timestamp falls on its trade date": "count(CASE WHEN hour(ts) >= 12 THEN 1 END)",
    "sample unique per model and fold": "count(*) - count(DISTINCT (model_name, fold_index, ts))",
}

# Faults by residue, counted from the feed: the rules themselves do not appear here.
_BROKEN_ROWS = {
    "feature width": "SELECT count(*) FROM b WHERE global_index % 101 = 7",
    "global index is session start plus position": "SELECT count(*) FROM b WHERE"
    " (global_index % 103 = 9) <> (ticker = 'T0' AND row_no = 3)",
    "session positions cover every row once": "SELECT count(*) FROM s WHERE ticker = 'T1' AND n > 6",
    "one start per session": "SELECT count(*) FROM s WHERE ticker = 'T0' AND n > 3",
    "sessions cover every global row once": "SELECT count(DISTINCT ticker) FROM s WHERE ticker = 'T1' AND n > 5",
}
_BROKEN_QUALITY = {
    "quality not empty": "SELECT 0 * count(*) FROM d",
    "quality without nulls": "SELECT count(*) FROM d WHERE k = 0",
    "row count positive": "SELECT count(*) FROM d WHERE k = 4",
    "ratios within 0 and 1": "SELECT count(*) FROM d WHERE k IN (0, 1)",
    "gaps ordered and not negative": "SELECT count(*) FROM d WHERE k = 2",
    "counts not negative": "SELECT count(*) FROM d WHERE k = 3",
    "one quality row per day": "SELECT count(*) FROM d WHERE k = 5",
    "quality rows match the dataset": "SELECT count(*) FROM d WHERE k IN (4, 6)",
}
_BROKEN_FOLDS = {
    "fold index not empty": "SELECT 0 * count(*) FROM f",
    "fold index without nulls": "SELECT count(*) FROM f WHERE g = 1",
    "fold positions not negative": "SELECT count(*) FROM f WHERE g = 2",
    "anchor inside the dataset": "SELECT count(*) FROM f WHERE g = 3",
    "global minus start is local": "SELECT count(*) FROM f WHERE g = 2",
    "anchor leaves room for its window": "SELECT count(*) FROM f WHERE g = 2",
    "anchor window and target valid": "SELECT count(*) FROM f WHERE g = 3",
    "anchor describes its row": "SELECT count(*) FROM f WHERE g IN (1, 3)",
    "anchor unique in its split": "SELECT count(*) FROM f WHERE g = 4",
    "fold has train, validation and test": "SELECT count(DISTINCT ticker) FROM f WHERE fold_index = 2",
    "splits strictly one after another": "SELECT count(DISTINCT ticker) FROM f WHERE fold_index = 2",
}
_BROKEN_WINDOWS = {
    "window length": "SELECT count(*) FROM w WHERE g = 1",
    "window width": "SELECT count(*) FROM w WHERE g = 2",
    "window finite": "SELECT count(*) FROM w WHERE g = 3",
    "target finite": "SELECT count(*) FROM w WHERE g = 4",
}

SQL = {
    "broken_rows": f"""WITH {ROWS}, b AS (SELECT * FROM stored WHERE NOT (ticker = 'T1' AND row_no = 5)),
s AS (SELECT {K}, count(*) AS n FROM stored GROUP BY {K}) {_rules(_BROKEN_ROWS, "")}""",
    "broken_quality": f"""WITH {LINE}, d AS (
  SELECT DISTINCT ticker, trade_date, right(trade_date, 2)::INT % 7 AS k FROM line) {_rules(_BROKEN_QUALITY, "")}""",
    "broken_folds": f"""WITH {FOLDED}, f AS (
  SELECT *, global_index % 11 AS g FROM xy WHERE NOT (fold_index = 2 AND split = 'test')) {_rules(_BROKEN_FOLDS, "")}""",
    "broken_windows": f"""WITH {ROWS}, w AS (SELECT global_index % 13 AS g FROM stored WHERE is_anchor)
{_rules(_BROKEN_WINDOWS, "")}""",
    "zero_baseline": _predictions("zero", "0.0::DOUBLE"),
    "imbalance_ols": _predictions("imbalance", "f.slope * q.x + f.intercept"),
    "grouped_candidate": f"""WITH {FOLDED},
one AS (SELECT ticker, fold_index, regr_slope(y, z_ASKs1::FLOAT::DOUBLE) AS slope,
               regr_intercept(y, z_ASKs1::FLOAT::DOUBLE) AS intercept FROM xy WHERE split = 'train' GROUP BY ticker, fold_index)
SELECT 'one-feature' AS model_name, q.fold_index, q.ticker, q.trade_date, q.session_id,
  CAST(q.ts AS VARCHAR) AS anchor_timestamp, {r("y", 7)} AS target,
  {r("o.slope * q.z_ASKs1::FLOAT::DOUBLE + o.intercept", 7)} AS prediction,
  {r("ASKp1::FLOAT::DOUBLE - BIDp1::FLOAT::DOUBLE", 5)} AS spread
FROM xy q JOIN one o ON q.ticker = o.ticker AND q.fold_index = o.fold_index WHERE q.split = 'test'""",
    "logit_candidate": f"""{_logit(_ROUNDS)}
SELECT 'direction-logit' AS model_name, q.fold_index, q.ticker, q.trade_date, q.session_id,
  CAST(q.ts AS VARCHAR) AS anchor_timestamp, {r("y", 7)} AS target,
  {r("2 / (1 + exp(-(w.a * q.z_ASKs1::FLOAT::DOUBLE + w.b))) - 1", 7)} AS prediction,
  {r("ASKp1::FLOAT::DOUBLE - BIDp1::FLOAT::DOUBLE", 5)} AS spread
FROM xy q JOIN w{_ROUNDS} w ON q.ticker = w.ticker AND q.fold_index = w.fold_index WHERE q.split = 'test'""",
    "logit_optimality": f"""{_logit(_ROUNDS)}
SELECT ticker, fold_index, n AS train_count, {r("a", 7)} AS slope, {r("b", 7)} AS intercept,
  round(abs(ga), 4) AS slope_gradient, round(abs(gb), 4) AS intercept_gradient FROM w{_ROUNDS}""",
    "imbalance_coefficients": f"WITH {FOLDED} SELECT ticker, fold_index, train_count, {r('slope', 8)} AS slope,"
    f" {r('intercept', 8)} AS intercept FROM fit",
    "ridge_coefficients": _RIDGE,
    "ridge_baseline": _RIDGE_BASELINE,
    "segment_violations": f"WITH {SNAP} SELECT 'keys and timestamp present' AS rule, 0 * count(*) AS violations FROM snap"
    f" UNION ALL SELECT 'timestamps unique within a session', count(*) FROM"
    f" (SELECT {K}, ts FROM snap GROUP BY {K}, ts HAVING count(*) > 1)",
    "date_violations": f"WITH {SNAP} SELECT ticker, strftime(strptime(trade_date, '%Y-%m-%d'), '%Y%m%d') AS trade_date,"
    " 'not an ISO date' AS rule FROM (SELECT DISTINCT ticker, trade_date FROM snap WHERE ticker = 'T1')",
    "batch_scoring": f"WITH {ROWS} SELECT {K}, CAST(ts AS VARCHAR) AS timestamp,"
    f" {r(f'({_LAST}) / {_N}', 5)} AS prediction FROM stored WHERE is_anchor",
    "stored_scoring": f"""WITH {ROWS},
win AS (SELECT *, sum({_LAST}) OVER (PARTITION BY {K} ORDER BY ts
        ROWS BETWEEN {inputs.HISTORY - 1} PRECEDING AND CURRENT ROW) AS total FROM stored)
SELECT {K}, CAST(ts AS VARCHAR) AS timestamp, {r(f'total / {_N * inputs.HISTORY}', 5)} AS prediction
FROM win WHERE is_anchor""",
    "walk_forward_summary": f"""WITH {FOLDED},
p AS (SELECT q.*, f.slope * q.x + f.intercept AS fitted FROM xy q
      JOIN fit f ON q.ticker = f.ticker AND q.fold_index = f.fold_index WHERE q.split = 'test'),
both_models AS (SELECT ticker, fold_index, y, 'zero' AS model_name, 0.0::DOUBLE AS yhat FROM p
         UNION ALL SELECT ticker, fold_index, y, 'imbalance', fitted FROM p),
m AS (SELECT ticker, model_name, fold_index, count(*) AS n, avg(abs(yhat - y)) AS mae,
             sqrt(avg((yhat - y) * (yhat - y))) AS rmse,
             avg(CASE WHEN y <> 0 THEN (sign(yhat) = sign(y))::INT::DOUBLE END) AS direction_accuracy
      FROM both_models GROUP BY ticker, model_name, fold_index)
SELECT ticker, model_name, count(*) AS fold_count, sum(n)::BIGINT AS sample_count,
  {", ".join(f"{r(f'avg({c})')} AS {c}_mean, {r(f'stddev_pop({c})')} AS {c}_std" for c in ("mae", "rmse", "direction_accuracy"))}
FROM m GROUP BY ticker, model_name""",
    "dataset_checks": _rules({rule: "0" for rule in _ALL_RULES}, ""),
    "anchor_violations": f"""WITH {FOLDED},
moved AS (SELECT q.ticker, q.session_id, q.trade_date, n.is_anchor AS next_anchor
          FROM xy q LEFT JOIN stored n ON q.ticker = n.ticker AND q.global_index + 1 = n.global_index)
SELECT 'anchor window and target valid' AS rule, count(CASE WHEN next_anchor IS NOT TRUE THEN 1 END) AS violations
FROM moved UNION ALL SELECT 'anchor describes its row', count(*) FROM moved""",
    "window_violations": _rules(
        {n: "0" for n in ("window length", "window width", "window finite", "target finite")}, ""
    ),
    "prediction_violations": f"WITH {PREDS} {_rules(_PREDICTION_RULES, ' FROM preds')}",
    "candidate_identity": f"WITH {PREDS} "
    + _rules(
        {
            "dataset version": "0 * count(*)",
            "known model": "count(CASE WHEN model_name <> 'linear' THEN 1 END)",
            "known fold": "count(CASE WHEN fold_index <> 1 THEN 1 END)",
            "test split": "0 * count(*)",
        },
        " FROM preds",
    ),
}
