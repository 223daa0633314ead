"""SQL for the evaluation queries; the bootstrap is expanded row by row."""

from __future__ import annotations

from depthframe.operators import bootstrap as b
from depthframe.registry.evaluation_queries import BLOCK, DIRECTION, DRAWS, SEED
from depthframe.registry.oracle import r, rounded
from depthframe.schema import METRICS

G = "ticker, model_name, fold_index"

PREDS = """
raw AS (
  SELECT *, value / 1000.0::DOUBLE - 0.05::DOUBLE AS y,
         ((event_id * 7919) % 101 - 50) * 0.001::DOUBLE AS noise FROM events),
preds AS (
  SELECT 'T0' AS ticker, model_name, CASE WHEN day(ts) <= 15 THEN 1 ELSE 2 END::BIGINT AS fold_index,
         strftime(ts, '%Y-%m-%d') AS trade_date, CASE WHEN hour(ts) < 12 THEN 'AM' ELSE 'PM' END AS session_id,
         ts, event_id, CASE WHEN event_id % 211 <> 0 THEN y END AS t,
         CASE WHEN model_name = 'linear' THEN y * 0.3::DOUBLE + noise
              ELSE round(y * 20.0::DOUBLE + noise) / 20.0::DOUBLE END AS p
  FROM raw, (VALUES ('linear'), ('coarse')) AS names(model_name)),
ok AS (SELECT * FROM preds WHERE p IS NOT NULL AND t IS NOT NULL)"""

ONE = {
    "mae": "avg(abs(p - t))",
    "rmse": "sqrt(avg((p - t) * (p - t)))",
    "ts_ic": "CASE WHEN min(p) < max(p) AND min(t) < max(t) THEN corr(p, t) END",
    "direction_accuracy": "avg(CASE WHEN t <> 0 THEN (sign(p) = sign(t))::INT::DOUBLE END)",
    "up_precision": "avg(CASE WHEN p > 0 THEN (t > 0)::INT::DOUBLE END)",
    "up_recall": "avg(CASE WHEN t > 0 THEN (p > 0)::INT::DOUBLE END)",
    "down_precision": "avg(CASE WHEN p < 0 THEN (t < 0)::INT::DOUBLE END)",
    "down_recall": "avg(CASE WHEN t < 0 THEN (p < 0)::INT::DOUBLE END)",
    "rank_ic": "CASE WHEN min(rp) < max(rp) AND min(rt) < max(rt) THEN corr(rp, rt) END",
}


def _ranked(source: str, group: str) -> str:
    def rank(c):
        return (
            f"rank() OVER (PARTITION BY {group} ORDER BY {c})"
            f" + (count(*) OVER (PARTITION BY {group}, {c}) - 1) / 2.0::DOUBLE"
        )

    return f"SELECT *, {rank('p')} AS rp, {rank('t')} AS rt FROM {source}"


def _evaluated(group: str, names) -> str:
    """Metrics per group; the sample count also counts rows without a usable pair."""
    cols = ", ".join(f"{ONE[n]} AS {n}" for n in names)
    keys = group.split(", ")
    on = " AND ".join(f"c.{k} = e.{k}" for k in keys)
    return f"""
counts AS (SELECT {group}, count(*) AS sample_count FROM preds GROUP BY {group}),
ranked AS ({_ranked("ok", group)}),
metrics AS (SELECT {group}, {cols} FROM ranked GROUP BY {group}),
result AS (SELECT c.*, {", ".join("e." + n for n in names)} FROM counts c LEFT JOIN metrics e ON {on})"""


def _overall(names) -> str:
    return f"WITH {PREDS}, {_evaluated(G, names)} SELECT {G}, sample_count, {rounded(names)} FROM result"


DAY = f"{G}, trade_date"
_SUMMARY = ", ".join(
    f"{r(f'avg({n})')} AS {n}_mean, {r(f'stddev_pop({n})')} AS {n}_std" for n in METRICS
)


def _resampled() -> str:
    """All rows of all draws, by position."""
    x0 = f"(({SEED} + fold_index) * {b.SEED_STEP} + draw * {b.DRAW_STEP} + blk * {b.BLOCK_STEP} + num) % {b.PRIME}"
    return f"""
placed AS (
  SELECT *, row_number() OVER (PARTITION BY {DAY}, session_id ORDER BY ts, event_id) - 1 AS pos FROM preds),
sizes AS (
  SELECT {DAY}, session_id, count(*) AS n, least({BLOCK}, count(*)) AS len,
         ('0x' || substr(md5(ticker || '|' || trade_date || '|' || session_id), 1, 7))::BIGINT AS num
  FROM preds GROUP BY {DAY}, session_id),
blocks AS (
  SELECT s.*, draw, blk FROM sizes s, range({DRAWS}) d(draw), LATERAL (SELECT unnest(range((n + len - 1) // len)) AS blk)),
h0 AS (SELECT *, {x0} AS x FROM blocks),
h1 AS (SELECT * EXCLUDE x, (x * {b.MULTIPLIER} + {b.ADDEND}) % {b.PRIME} AS x FROM h0),
h2 AS (SELECT * EXCLUDE x, (x * x + {b.SQUARE_ADDEND}) % {b.PRIME} AS x FROM h1),
h3 AS (SELECT * EXCLUDE x, ((x * x + {b.ADDEND}) % {b.PRIME}) % (n - len + 1) AS lo FROM h2),
picks AS (
  SELECT {DAY}, session_id, draw, unnest(range(lo, lo + least(len, n - blk * len))) AS pos FROM h3),
drawn AS (
  SELECT k.draw, a.* FROM picks k JOIN placed a ON k.ticker = a.ticker AND k.model_name = a.model_name
    AND k.fold_index = a.fold_index AND k.trade_date = a.trade_date AND k.session_id = a.session_id AND k.pos = a.pos
  WHERE a.p IS NOT NULL AND a.t IS NOT NULL)"""


def _bootstrap(names) -> str:
    est = ", ".join(f"{ONE[n]} AS {n}" for n in names)
    listed = ", ".join(names)
    return f"""WITH {PREDS}, {_resampled()},
drawn_ranked AS ({_ranked("drawn", G + ", draw")}),
est AS (SELECT {G}, draw, {est} FROM drawn_ranked GROUP BY {G}, draw),
long AS (SELECT {G}, metric, value FROM (UNPIVOT est ON {listed} INTO NAME metric VALUE value)),
bounds AS (SELECT {G}, metric, quantile_cont(value, 0.025) AS lower, quantile_cont(value, 0.975) AS upper
           FROM long GROUP BY {G}, metric),
{_evaluated(G, names)},
point AS (UNPIVOT (SELECT {G}, {listed} FROM result) ON {listed} INTO NAME metric VALUE estimate)
SELECT p.ticker, p.model_name, p.fold_index, p.metric, {r("estimate")} AS estimate, {r("lower")} AS lower,
       {r("upper")} AS upper, 0.95::DOUBLE AS confidence_level
FROM point p LEFT JOIN bounds b ON p.ticker = b.ticker AND p.model_name = b.model_name
  AND p.fold_index = b.fold_index AND p.metric = b.metric"""


def _tail(source: str, group: str) -> str:
    """Mean of the largest tenth of the errors, at least of one."""
    return f"""SELECT {group}, avg(e) AS value FROM (
  SELECT {group}, abs(p - t) AS e, row_number() OVER (PARTITION BY {group} ORDER BY abs(p - t) DESC) AS k,
         count(*) OVER (PARTITION BY {group}) AS n FROM {source})
WHERE k <= greatest(1, n // 10) GROUP BY {group}"""


def _own_interval(name: str, drawn: str, point: str) -> str:
    """Interval of a metric from SQL that gives ``value`` per draw and per group."""
    return f"""WITH {PREDS}, {_resampled()}, est AS ({drawn}),
bounds AS (SELECT {G}, quantile_cont(value, 0.025) AS lower, quantile_cont(value, 0.975) AS upper FROM est GROUP BY {G}),
point AS ({point})
SELECT p.ticker, p.model_name, p.fold_index, '{name}' AS metric, {r("p.value")} AS estimate, {r("lower")} AS lower,
       {r("upper")} AS upper, 0.95::DOUBLE AS confidence_level
FROM point p JOIN bounds b ON p.ticker = b.ticker AND p.model_name = b.model_name AND p.fold_index = b.fold_index"""


_PLAIN = [n for n in METRICS if n != "rank_ic"]

SQL = {
    "overall_metrics": _overall(["mae", "rmse", "ts_ic"]),
    "rank_ic": _overall(["rank_ic"]),
    "direction_metrics": _overall(DIRECTION),
    "daily_metrics": f"WITH {PREDS}, {_evaluated(DAY, METRICS)} SELECT {DAY}, sample_count, {rounded(METRICS)} FROM result",
    "daily_summary": f"WITH {PREDS}, {_evaluated(DAY, METRICS)} SELECT {G}, {_SUMMARY},"
    f" {r('CASE WHEN count(ts_ic) >= 2 AND stddev_pop(ts_ic) > 0 THEN avg(ts_ic) / stddev_pop(ts_ic) END')} AS icir,"
    f" {r('avg((ts_ic > 0)::INT::DOUBLE)')} AS positive_ic_day_ratio FROM result GROUP BY {G}",
    "prediction_bins": f"""WITH {PREDS},
binned AS (SELECT *, ntile(10) OVER (PARTITION BY {G} ORDER BY p, ts, event_id) AS bin_index FROM ok)
SELECT {G}, bin_index, count(*) AS sample_count, {r("avg(p)")} AS mean_prediction,
  {r("avg(t)")} AS mean_realized_return, {r("(bin_index - 1) / 10.0::DOUBLE")} AS lower_quantile,
  {r("bin_index / 10.0::DOUBLE")} AS upper_quantile FROM binned GROUP BY {G}, bin_index""",
    "regression_losses": f"WITH {PREDS} SELECT {G}, {r('avg((p - t) * (p - t))')} AS mse, {r('avg(abs(p - t))')} AS mae,"
    f" {r('avg(CASE WHEN abs(p - t) <= 0.05::DOUBLE THEN 0.5 * (p - t) * (p - t) ELSE 0.05::DOUBLE * (abs(p - t) - 0.025::DOUBLE) END)')}"
    f" AS huber FROM ok GROUP BY {G}",
    "custom_metric": f"WITH {PREDS} SELECT {G}, {r('avg(p - t)')} AS bias FROM ok GROUP BY {G}",
    "custom_python_metric": f"WITH {PREDS} SELECT {G}, {r('value')} AS tail_error FROM ({_tail('ok', G)})",
    "daily_python_metric": f"WITH {PREDS} SELECT {DAY}, {r('value')} AS tail_error FROM ({_tail('ok', DAY)})",
    "bootstrap_python_metric": _own_interval("tail_error", _tail("drawn", f"{G}, draw"), _tail("ok", G)),
    "fold_summary": f"WITH {PREDS}, {_evaluated(G, METRICS)} SELECT ticker, model_name, count(*) AS fold_count,"
    f" sum(sample_count)::BIGINT AS sample_count, {_SUMMARY} FROM result GROUP BY ticker, model_name",
    "bootstrap_ci": _bootstrap(_PLAIN),
    "bootstrap_rank_ic": _bootstrap(["rank_ic"]),
    "bootstrap_custom_metric": f"""WITH {PREDS}, {_resampled()},
est AS (SELECT {G}, draw, max(abs(p - t)) AS value FROM drawn GROUP BY {G}, draw),
bounds AS (SELECT {G}, quantile_cont(value, 0.025) AS lower, quantile_cont(value, 0.975) AS upper FROM est GROUP BY {G}),
point AS (SELECT {G}, max(abs(p - t)) AS estimate FROM ok GROUP BY {G})
SELECT p.ticker, p.model_name, p.fold_index, 'largest_error' AS metric, {r("estimate")} AS estimate, {r("lower")} AS lower,
       {r("upper")} AS upper, 0.95::DOUBLE AS confidence_level
FROM point p JOIN bounds b ON p.ticker = b.ticker AND p.model_name = b.model_name AND p.fold_index = b.fold_index""",
}
