"""ANSI SQL for the registered queries, written from the rules and not from the Spark plans."""

from __future__ import annotations

from depthframe.registry import inputs
from depthframe.schema import BOOK_COLUMNS, DERIVED_FEATURES, LEVELS, RAW_COLUMNS

K = "ticker, trade_date, session_id"
LV = range(1, LEVELS + 1)
PAIRS = range(1, LEVELS)


def r(expr: str, digits: int = 6) -> str:
    return f"round({expr}, {digits}) + 0.0"


def rounded(names, digits: int = 6) -> str:
    # ``amount`` has seven decimals by construction, so rounding to six would meet ties.
    return ", ".join(f"{r(n, 7 if n == 'amount' else digits)} AS {n}" for n in names)


def num(x) -> str:
    return f"CAST({x} AS DOUBLE)"


def _book_columns() -> str:
    out = []
    for i in LV:
        step = f"{num('0.01')} * {i}"
        ask, bid = f"m + {step}", f"m - {step}"
        if i == 1:
            bid = f"CASE WHEN f = 13 THEN m + {num('0.03')} ELSE {bid} END"
        if i == 2:
            ask = f"CASE WHEN f = 17 THEN m + {num('0.005')} ELSE {ask} END"
        asz = f"CAST(100 + (event_id * {i + 2}) % 37 AS DOUBLE)"
        bsz = f"CASE WHEN f = 19 THEN {num('-1')} ELSE CAST(100 + (event_id * {i + 5}) % 41 AS DOUBLE) END"
        out += [
            f"CASE WHEN f <> 7 THEN {ask} END AS ASKp{i}",
            f"CASE WHEN f <> 7 THEN {asz} END AS ASKs{i}",
            f"CASE WHEN f NOT IN (7, 11) THEN {bid} END AS BIDp{i}",
            f"CASE WHEN f NOT IN (7, 11) THEN {bsz} END AS BIDs{i}",
        ]
    return ", ".join(out)


SNAP = f"""
base AS (
  SELECT event_id, ts, value, event_id % 50 AS f,
         {num(100)} + (event_id % 97) * {num('0.01')} + value / {num(1000)} AS m
  FROM events),
every AS (
  SELECT CASE WHEN event_id % 2 = 0 THEN 'T0' ELSE 'T1' END AS ticker,
         strftime(ts, '%Y-%m-%d') AS trade_date, date_trunc('minute', ts) AS ts, event_id AS row_index,
         {_book_columns()},
         m AS "last", value * {num(10)} AS volume, value * m AS amount
  FROM base),
snap AS (
  SELECT *, CASE WHEN hour(ts) < 12 THEN 'AM' ELSE 'PM' END AS session_id FROM every)"""

ANY = "coalesce(" + ", ".join(BOOK_COLUMNS) + ") IS NOT NULL"
BID_OK = "coalesce(BIDp1 > 0, false)"
ASK_OK = "coalesce(ASKp1 > 0, false)"
CROSSED = "coalesce(BIDp1 > 0 AND ASKp1 > 0 AND BIDp1 > ASKp1, false)"
LEVEL = "(" + " OR ".join(
    f"coalesce(BIDp{i} > 0 AND BIDp{i + 1} > 0 AND BIDp{i} < BIDp{i + 1}, false)"
    f" OR coalesce(ASKp{i} > 0 AND ASKp{i + 1} > 0 AND ASKp{i} > ASKp{i + 1}, false)"
    for i in PAIRS
) + ")"
NEG_PRICE = "(" + " OR ".join(f"coalesce({c} < 0, false)" for c in BOOK_COLUMNS if c[3] == "p") + ")"
NEG_SIZE = "(" + " OR ".join(f"coalesce({c} < 0, false)" for c in BOOK_COLUMNS if c[3] == "s") + ")"
MID = (
    f"CASE WHEN {BID_OK} AND {ASK_OK} AND NOT {CROSSED} THEN (BIDp1 + ASKp1) / 2"
    f" WHEN {BID_OK} AND NOT {ASK_OK} THEN BIDp1 WHEN {ASK_OK} AND NOT {BID_OK} THEN ASKp1 END"
)
VALID = f"(({BID_OK} OR {ASK_OK}) AND NOT {CROSSED} AND NOT {LEVEL} AND NOT {NEG_SIZE} AND NOT {NEG_PRICE})"


def _timeline(source: str, interval: int, max_gap: int) -> str:
    eq = " AND ".join(f"t.{c} = {{0}}.{c}" for c in K.split(", "))
    filled = ", ".join(
        f"CASE WHEN fill THEN p_{c} ELSE {c} END AS {c}" for c in RAW_COLUMNS
    )
    return f"""
obs AS (
  SELECT * FROM (
    SELECT *, count(*) OVER (PARTITION BY {K}, ts) AS n_copies,
           row_number() OVER (PARTITION BY {K}, ts ORDER BY row_index DESC) AS rn
    FROM {source}) WHERE rn = 1),
gaps AS (
  SELECT *, CAST(coalesce(trunc(epoch_us(ts - lag(ts) OVER (PARTITION BY {K} ORDER BY ts)) / 1000000), 0) AS DOUBLE)
         AS snapshot_gap_seconds FROM obs),
axis AS (
  SELECT {K}, ts FROM obs UNION
  SELECT {K}, unnest(generate_series(min(ts), max(ts), INTERVAL {interval} SECOND)) AS ts FROM obs GROUP BY {K}),
src AS (SELECT {K}, ts, {", ".join(f"{c} AS p_{c}" for c in RAW_COLUMNS)} FROM obs WHERE {ANY}),
joined AS (
  SELECT t.ticker, t.trade_date, t.session_id, t.ts, {", ".join(f"o.{c}" for c in RAW_COLUMNS)},
         o.n_copies, o.snapshot_gap_seconds, {", ".join(f"s.p_{c}" for c in RAW_COLUMNS)},
         CAST(trunc(epoch_us(t.ts - s.ts) / 1000000) AS DOUBLE) AS staleness_seconds
  FROM axis t
  LEFT JOIN gaps o ON {eq.format("o")} AND t.ts = o.ts
  ASOF LEFT JOIN src s ON {eq.format("s")} AND t.ts >= s.ts),
flagged AS (
  SELECT *, NOT ({ANY}) AND coalesce(staleness_seconds <= {max_gap}, false) AS fill FROM joined),
filled AS (
  SELECT {K}, ts, n_copies, snapshot_gap_seconds, staleness_seconds, fill AS is_ffilled, {filled} FROM flagged),
line AS (
  SELECT *, {MID} AS mid_price, {VALID} AS book_valid,
         row_number() OVER (PARTITION BY {K} ORDER BY ts) - 1 AS row_no FROM filled)"""


LINE = SNAP + "," + _timeline("snap", inputs.INTERVAL, inputs.MAX_GAP)


def _ratio(n: str, d: str) -> str:
    return f"CASE WHEN ({d}) <> 0 THEN ({n}) / ({d}) END"


def _derived() -> dict[str, str]:
    bid = "(" + " + ".join(f"coalesce(BIDs{i}, 0)" for i in LV) + ")"
    ask = "(" + " + ".join(f"coalesce(ASKs{i}, 0)" for i in LV) + ")"
    slope = " + ".join(f"coalesce({num(i - 3)} * (BIDs{i} + ASKs{i}), 0)" for i in LV)
    balance = _ratio(f"{bid} - {ask}", f"{bid} + {ask}")
    return {
        "spread": "ASKp1 - BIDp1",
        "relative_spread": _ratio("ASKp1 - BIDp1", "(ASKp1 + BIDp1) / 2"),
        "mid_price": "mid_price",
        "microprice": _ratio("ASKp1 * BIDs1 + BIDp1 * ASKs1", "BIDs1 + ASKs1"),
        "l1_imbalance": _ratio("BIDs1 - ASKs1", "BIDs1 + ASKs1"),
        "l5_imbalance": balance,
        "bid_depth": bid,
        "ask_depth": ask,
        "depth_imbalance": balance,
        "price_slope": "((ASKp5 - ASKp1) + (BIDp1 - BIDp5)) / 8",
        "volume_slope": f"({slope}) / 10",
    }


D = _derived()
FEATURE_VALID = "(book_valid AND " + " AND ".join(
    [f"{c} IS NOT NULL" for c in RAW_COLUMNS] + [f"({D[n]}) IS NOT NULL" for n in inputs.DERIVED]
) + ")"

LABELS = f"""
cand AS (SELECT {K}, ts, mid_price AS mid FROM line WHERE book_valid AND mid_price > 0),
asked AS (SELECT *, ts + INTERVAL {inputs.HORIZON} SECOND AS due FROM line),
sides AS (
  SELECT t.*, b.ts AS b_ts, b.mid AS b_mid, a.ts AS a_ts, a.mid AS a_mid FROM asked t
  ASOF LEFT JOIN cand b ON t.ticker = b.ticker AND t.trade_date = b.trade_date
    AND t.session_id = b.session_id AND t.due >= b.ts
  ASOF LEFT JOIN cand a ON t.ticker = a.ticker AND t.trade_date = a.trade_date
    AND t.session_id = a.session_id AND t.due <= a.ts),
picked AS (
  SELECT *, CASE WHEN b_ts IS NULL OR (a_ts IS NOT NULL AND a_ts - due <= due - b_ts) THEN a_ts ELSE b_ts END AS h_ts,
         CASE WHEN b_ts IS NULL OR (a_ts IS NOT NULL AND a_ts - due <= due - b_ts) THEN a_mid ELSE b_mid END AS h_mid
  FROM sides),
labelled AS (
  SELECT * EXCLUDE (h_ts, h_mid), CASE WHEN near THEN h_ts END AS future_timestamp,
         CASE WHEN near THEN h_mid END AS future_mid,
         coalesce(book_valid AND mid_price > 0 AND near, false) AS target_valid
  FROM (SELECT *, h_ts BETWEEN due - INTERVAL {inputs.TOLERANCE} SECOND
                      AND due + INTERVAL {inputs.TOLERANCE} SECOND AS near FROM picked)),
returns AS (
  SELECT *, CASE WHEN target_valid THEN ln(future_mid / mid_price) END AS log_return,
         CASE WHEN target_valid THEN future_mid / mid_price - 1 END AS simple_return FROM labelled)"""

N = inputs.WINDOW
F_NAMES = inputs.SAMPLE_FEATURES


def _zscore(source: str) -> str:
    w = f"OVER (PARTITION BY {K} ORDER BY ts ROWS BETWEEN {N} PRECEDING AND 1 PRECEDING)"
    stats = ", ".join(
        f"avg(CASE WHEN feature_valid THEN {f} END) {w} AS mu_{f},"
        f" stddev_pop(CASE WHEN feature_valid THEN {f} END) {w} AS sd_{f}"
        for f in F_NAMES
    )
    z = ", ".join(
        f"CASE WHEN feature_valid AND n_past = {N} THEN"
        f" ({f} - mu_{f}) / CASE WHEN sd_{f} > 0 THEN sd_{f} ELSE 1 END END AS z_{f}"
        for f in F_NAMES
    )
    return f"""
usable AS (SELECT *, {FEATURE_VALID} AS feature_valid FROM {source}),
past AS (SELECT *, count(CASE WHEN feature_valid THEN 1 END) {w} AS n_past, {stats} FROM usable),
scaled AS (SELECT *, feature_valid AND n_past = {N} AS normalization_valid, {z} FROM past)"""


UNEVEN = """uneven AS (
  SELECT DISTINCT 'U' || (event_id % 3)::VARCHAR AS ticker, strftime(ts, '%Y-%m-%d') AS trade_date FROM events
  WHERE event_id % 3 = 0 OR (event_id % 3 = 1 AND day(ts) <= 10) OR day(ts) <= 2)"""

T = inputs.HISTORY
ROWS = (
    LINE + "," + LABELS + "," + _zscore("returns") + f""",
sess AS (SELECT {K}, count(*) AS n, min(ts) AS first_ts FROM line GROUP BY {K}),
offs AS (
  SELECT {K}, coalesce(sum(n) OVER (PARTITION BY ticker ORDER BY trade_date, first_ts
         ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS session_start_index FROM sess),
stored AS (
  SELECT s.*, o.session_start_index, o.session_start_index + s.row_no AS global_index,
         book_valid AND feature_valid AND normalization_valid AS row_valid,
         sum(CASE WHEN book_valid AND feature_valid AND normalization_valid THEN 1 ELSE 0 END)
           OVER (PARTITION BY s.ticker, s.trade_date, s.session_id ORDER BY ts
                 ROWS BETWEEN {T - 1} PRECEDING AND CURRENT ROW) = {T} AND target_valid AS is_anchor
  FROM scaled s JOIN offs o ON s.ticker = o.ticker AND s.trade_date = o.trade_date AND s.session_id = o.session_id)"""
)

DATES = SNAP + """,
dates AS (
  SELECT ticker, trade_date, row_number() OVER (PARTITION BY ticker ORDER BY trade_date) - 1 AS r,
         count(*) OVER (PARTITION BY ticker) AS n
  FROM (SELECT DISTINCT ticker, trade_date FROM snap))"""

_LEN = inputs.FOLDS["train_days"] + inputs.FOLDS["validation_days"] + inputs.FOLDS["test_days"]
PLAN = f"""
starts AS (SELECT ticker, n, unnest(generate_series(0, n - {_LEN}, {inputs.FOLDS["step_days"]})) AS s
           FROM (SELECT DISTINCT ticker, n FROM dates)),
plan AS (
  SELECT d.ticker, s // {inputs.FOLDS["step_days"]} + 1 AS fold_index,
         CASE WHEN r < s + {inputs.FOLDS["train_days"]} THEN 'train'
              WHEN r < s + {inputs.FOLDS["train_days"] + inputs.FOLDS["validation_days"]} THEN 'validation'
              ELSE 'test' END AS split, trade_date
  FROM dates d JOIN starts f ON d.ticker = f.ticker AND r >= s AND r < s + {_LEN})"""

TS = "CAST(ts AS VARCHAR) AS timestamp"


def _quality(line: str) -> str:
    gap = "CASE WHEN snapshot_gap_seconds > 0 THEN snapshot_gap_seconds END"
    return f"""
SELECT ticker, trade_date, count(*) AS row_count,
  {r(f"avg(CASE WHEN {ANY} THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END)")} AS missing_ratio,
  coalesce(sum(n_copies - 1), 0)::BIGINT AS duplicate_count,
  count(CASE WHEN {CROSSED} THEN 1 END) AS crossed_book_count,
  count(CASE WHEN {BID_OK} <> {ASK_OK} THEN 1 END) AS one_side_missing_count,
  {r(f"coalesce(max({gap}), 0)")} AS max_gap,
  {r(f"coalesce(quantile_cont({gap}, 0.95), 0)")} AS p95_gap,
  {r("avg(CASE WHEN is_ffilled THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END)")} AS stale_snapshot_ratio,
  count(CASE WHEN {LEVEL} THEN 1 END) AS invalid_level_order_count
FROM {line} GROUP BY ticker, trade_date"""


_QUALITY_NUMBERS = [
    "row_count", "missing_ratio", "duplicate_count", "crossed_book_count", "one_side_missing_count",
    "max_gap", "p95_gap", "stale_snapshot_ratio", "invalid_level_order_count",
]
_FLAT = ", ".join(f"CAST(z_{f} AS FLOAT)" for f in F_NAMES)

DATASET_SQL = {
    "session_snapshots": f"WITH {SNAP} SELECT {K}, {TS}, strftime(ts, '%H:%M:%S') AS seconds, row_index,"
    f" {rounded(['ASKp1', 'BIDs3', 'amount'])} FROM snap",
    "duplicate_counts": f"WITH {SNAP} SELECT {K}, count(*) AS row_count,"
    f" count(*) - count(DISTINCT ts) AS duplicate_count FROM snap GROUP BY {K}",
    "deduplicated_snapshots": f"WITH {LINE} SELECT {K}, {TS}, n_copies, {rounded(RAW_COLUMNS)} FROM obs",
    "source_violations": f"WITH {SNAP} SELECT 'several trade dates in one file' AS rule, ticker,"
    " 'events.parquet' AS subject, count(DISTINCT trade_date) AS violations FROM every GROUP BY ticker"
    " HAVING count(DISTINCT trade_date) > 1 UNION ALL"
    " SELECT DISTINCT 'no trade date in column or file name', ticker, 'events.parquet', 1 FROM every",
    "parsed_timestamps": """WITH e AS (SELECT *, date_trunc('second', ts) AS t FROM events)
SELECT event_id, CAST(CASE WHEN event_id % 10 IN (8, 9) THEN NULL WHEN event_id % 10 = 7 THEN date_trunc('day', t)
    WHEN event_id % 10 = 4 THEN date_trunc('minute', t) ELSE t END AS VARCHAR) AS from_text,
  CAST(CASE WHEN event_id % 3 <> 0 THEN t END AS VARCHAR) AS from_integer FROM e""",
    "lenient_numbers": f"""WITH e AS (SELECT event_id, event_id % 7 AS k, value FROM events)
SELECT event_id, k IN (3, 5, 6) AS missing, k = 4 AS infinite,
  {r("CASE k WHEN 0 THEN CAST(CAST(value AS DECIMAL(18, 4)) AS DOUBLE) WHEN 1 THEN event_id::DOUBLE WHEN 2 THEN event_id::DOUBLE / 10 END")} AS x FROM e""",
    "date_rules": "SELECT event_id, CASE WHEN event_id % 6 < 2 THEN strftime(ts, '%Y-%m-%d') END AS trade_date FROM events",
    "broken_sources": f"""WITH {SNAP},
feed AS (
  SELECT ticker, day(ts) AS d, CASE WHEN row_index % 997 <> 5 THEN ts END AS t, row_index,
         strftime(ts, '%Y%m') || lpad((CASE day(ts) WHEN 3 THEN 2 WHEN 7 THEN 8 WHEN 8 THEN 7 ELSE day(ts) END)::VARCHAR, 2, '0')
           || CASE WHEN day(ts) = 10 AND row_index % 3 = 0 THEN 'b' ELSE '' END AS stem,
         CASE WHEN day(ts) = 14 THEN row_index % 4 < 2 END AS half
  FROM every WHERE NOT (day(ts) = 5 AND hour(ts) >= 6)),
per_file AS (
  SELECT ticker, 'raw/' || ticker || '/' || stem || '.parquet' AS file, count(*) - count(t) AS unparsed,
         count(DISTINCT t::DATE) AS dates, min(t::DATE) AS date, count(DISTINCT half) AS stated, length(any_value(stem)) = 8 AS named,
         count(CASE WHEN hour(t) >= 6 AND hour(t) < 12 THEN 1 END) AS inside FROM feed GROUP BY ticker, stem),
numbered AS (
  SELECT *, lag(date) OVER (PARTITION BY ticker ORDER BY file) AS before, count(*) OVER (PARTITION BY ticker, date) AS files,
         row_number() OVER (PARTITION BY ticker, date ORDER BY file) AS k FROM per_file),
steps AS (
  SELECT ticker, strftime(t, '%Y-%m-%d') AS date, t, lag(t) OVER (PARTITION BY ticker, t::DATE ORDER BY CASE WHEN d = 12 THEN -row_index ELSE row_index END) AS p
  FROM feed WHERE hour(t) >= 6 AND hour(t) < 12)
SELECT 'unparseable timestamp' AS rule, ticker, file AS subject, unparsed AS violations FROM numbered WHERE unparsed > 0
UNION ALL SELECT 'several trade dates in one file', ticker, file, dates FROM numbered WHERE dates > 1
UNION ALL SELECT 'several trade_date values in one file', ticker, file, stated FROM numbered WHERE stated > 1
UNION ALL SELECT 'no trade date in column or file name', ticker, file, 1 FROM numbered WHERE NOT named
UNION ALL SELECT 'no configured session in file', ticker, file, 1 FROM numbered WHERE inside = 0
UNION ALL SELECT 'files not in date order', ticker, file, 1 FROM numbered WHERE before > date
UNION ALL SELECT 'several files for one trade date', ticker, strftime(date, '%Y-%m-%d'), files FROM numbered WHERE files > 1 AND k = 1
UNION ALL SELECT 'timestamps not in order', ticker, date || ' AM', count(*) FROM steps WHERE p > t GROUP BY ticker, date""",
    "mid_price_validity": f"WITH {SNAP} SELECT {K}, row_index, {r(MID)} AS mid_price, {VALID} AS book_valid,"
    f" {BID_OK} AS bid_side_valid, {ASK_OK} AS ask_side_valid, {CROSSED} AS crossed,"
    f" {NEG_PRICE} AS negative_price, {NEG_SIZE} AS negative_size FROM snap",
    "level_order_violations": f"WITH {SNAP} SELECT ticker, trade_date,"
    f" count(CASE WHEN {LEVEL} THEN 1 END) AS level_order_violations,"
    f" count(CASE WHEN NOT ({ANY}) THEN 1 END) AS empty_books, count(CASE WHEN {ANY} THEN 1 END) AS books"
    " FROM snap GROUP BY ticker, trade_date",
    "session_grid_ffill": f"WITH {LINE} SELECT {K}, {TS}, strftime(ts, '%H:%M:%S') AS seconds, row_no,"
    f" is_ffilled, book_valid, {rounded([*RAW_COLUMNS, 'mid_price', 'staleness_seconds'])} FROM line",
    "snapshot_gaps": f"WITH {LINE} SELECT {K}, {TS}, snapshot_gap_seconds, n_copies FROM line",
    "daily_quality": f"WITH {LINE} {_quality('line')}",
    "daily_quality_all_days": f"""WITH {SNAP},
opening AS (SELECT *, 'OPEN' AS session_id FROM every WHERE ts::TIME >= TIME '09:30:00' AND ts::TIME < TIME '09:32:00'),
{_timeline("opening", 60, 60)}, q AS ({_quality("line")}),
days AS (SELECT DISTINCT ticker, trade_date FROM every)
SELECT d.ticker, d.trade_date, {", ".join(f"coalesce({c}, 0) AS {c}" for c in _QUALITY_NUMBERS)}
FROM days d LEFT JOIN q ON d.ticker = q.ticker AND d.trade_date = q.trade_date""",
    "derived_features": f"WITH {LINE} SELECT {K}, {TS}, "
    + ", ".join(f"{r(D[n])} AS {n}" for n in DERIVED_FEATURES) + " FROM line",
    "feature_validity": f"WITH {LINE} SELECT {K}, count(*) AS row_count,"
    f" count(CASE WHEN book_valid THEN 1 END) AS book_valid_rows,"
    f" count(CASE WHEN {FEATURE_VALID} THEN 1 END) AS feature_valid_rows FROM line GROUP BY {K}",
    "asof_nearest_labels": f"WITH {LINE}, {LABELS} SELECT {K}, {TS},"
    f" CAST(future_timestamp AS VARCHAR) AS future_timestamp, target_valid, {rounded(['future_mid'])},"
    f" {r('log_return', 8)} AS log_return, {r('simple_return', 8)} AS simple_return FROM returns",
    "source_fingerprint": """WITH t AS (
  SELECT strftime(ts, '%Y-%m-%d') AS file, concat_ws('|', coalesce('=' || event_id::VARCHAR, '-'), coalesce('=' || epoch_us(ts)::VARCHAR, '-'), coalesce('=' || user_id::VARCHAR, '-'), coalesce('=' || event_type, '-'), coalesce('=' || CAST(round(value * 1e6) AS BIGINT)::VARCHAR, '-'), coalesce('=' || props, '-')) AS t FROM events),
f AS (SELECT md5(concat_ws('|', count(*)::VARCHAR, sum(CAST('0x' || substr(md5(t), 1, 15) AS HUGEINT))::VARCHAR, sum(CAST('0x' || substr(md5(t), 16, 15) AS HUGEINT))::VARCHAR)) AS p FROM t GROUP BY file)
SELECT count(*) AS file_count, md5(concat_ws('|', count(*)::VARCHAR, sum(CAST('0x' || substr(md5(p), 1, 15) AS HUGEINT))::VARCHAR, sum(CAST('0x' || substr(md5(p), 16, 15) AS HUGEINT))::VARCHAR)) AS source_hash FROM f""",
    "short_instruments": f"WITH {UNEVEN} SELECT ticker, count(*) AS dates, 18::BIGINT AS needed FROM uneven GROUP BY ticker HAVING count(*) < 18",
    "missing_folds": f"""WITH {UNEVEN}, n AS (SELECT ticker, count(*) AS n FROM uneven GROUP BY ticker)
SELECT ticker, fold_index FROM n, (SELECT unnest([2, 3])::BIGINT AS fold_index) WHERE n >= 8 AND 8 + (fold_index - 1) * 2 > n""",
    "split_violations": f"""WITH {UNEVEN}, n AS (SELECT ticker, count(*) AS n FROM uneven GROUP BY ticker),
sizes AS (SELECT ticker, floor(n * 0.6) AS a, floor(n * 0.2) AS b, n - floor(n * 0.6) - floor(n * 0.2) AS c FROM n),
{SNAP.strip()}, d AS (SELECT DISTINCT ticker, trade_date FROM snap)
SELECT ticker, 'train' AS split, '' AS trade_date FROM sizes WHERE a = 0 UNION ALL
SELECT ticker, 'validation', '' FROM sizes WHERE b = 0 UNION ALL SELECT ticker, 'test', '' FROM sizes WHERE c = 0 UNION ALL
SELECT ticker, '', trade_date FROM d WHERE trade_date IN ('2024-01-18', '2024-01-24') OR trade_date > '2024-01-31'""",
    "causal_zscore_spikes": f"""WITH {SNAP},
x AS (SELECT {K}, row_index, CASE WHEN row_index % 97 = 5 THEN volume * {num('1e8')} ELSE volume END AS x FROM snap),
w AS (SELECT *, list(x) OVER (PARTITION BY {K} ORDER BY row_index
        ROWS BETWEEN {inputs.SPIKE_WINDOW} PRECEDING AND 1 PRECEDING) AS past FROM x),
m AS (SELECT *, coalesce(len(past), 0) = {inputs.SPIKE_WINDOW} AS normalization_valid, list_avg(past) AS mu FROM w),
s AS (SELECT *, sqrt(list_avg(list_transform(past, lambda v: (v - mu) * (v - mu)))) AS sd FROM m)
SELECT {K}, row_index, normalization_valid,
       CASE WHEN normalization_valid THEN {r('(x - mu) / CASE WHEN sd > 0 THEN sd ELSE 1 END', 5)} END AS z FROM s""",
    "causal_zscore": f"WITH {LINE}, {_zscore('line')} SELECT {K}, {TS}, normalization_valid,"
    f" {rounded([f'z_{f}' for f in F_NAMES])} FROM scaled",
    "anchors": f"WITH {ROWS} SELECT {K}, global_index AS global_anchor_index, session_start_index,"
    " row_no AS anchor_index, CAST(ts AS VARCHAR) AS anchor_timestamp FROM stored WHERE is_anchor",
    "global_row_index": f"WITH {ROWS} SELECT {K}, {TS}, global_index, session_start_index, row_no, row_valid,"
    " target_valid FROM stored",
    "window_samples": f"""WITH {ROWS},
vec AS (SELECT *, [{_FLAT}] AS v FROM stored),
win AS (SELECT *, flatten(list(v) OVER (PARTITION BY {K} ORDER BY ts
        ROWS BETWEEN {T - 1} PRECEDING AND CURRENT ROW)) AS flat FROM vec)
SELECT {K}, global_index, len(flat) // {len(F_NAMES)} AS steps, len(flat) AS width,
  {r("flat[1]::DOUBLE", 5)} AS oldest_first, {r("v[1]::DOUBLE", 5)} AS newest_first,
  {r("list_sum(list_transform(flat, lambda x: x::DOUBLE))", 3)} AS total
FROM win WHERE is_anchor""",
    "sample_meta": f"WITH {ROWS} SELECT {K}, CAST(ts AS VARCHAR) AS anchor_timestamp,"
    f" {r('mid_price::FLOAT::DOUBLE', 5)} AS mid_t, {r('future_mid::FLOAT::DOUBLE', 5)} AS future_mid,"
    f" {r('BIDp1::FLOAT::DOUBLE', 5)} AS bid1, {r('ASKp1::FLOAT::DOUBLE', 5)} AS ask1,"
    f" {r('ASKp1::FLOAT::DOUBLE - BIDp1::FLOAT::DOUBLE', 5)} AS spread,"
    f" {r('log_return::FLOAT::DOUBLE', 7)} AS target FROM stored WHERE is_anchor",
    "chronological_split": f"WITH {DATES} SELECT ticker, trade_date,"
    " CASE WHEN r < floor(n * 0.6::DOUBLE) THEN 'train'"
    " WHEN r < floor(n * 0.6::DOUBLE) + floor(n * 0.2::DOUBLE) THEN 'validation' ELSE 'test' END AS split FROM dates",
    "explicit_split": f"""WITH {DATES},
spans(split, a, b) AS (VALUES ('train', '2024-01-01', '2024-01-18'), ('validation', '2024-01-18', '2024-01-23'),
                       ('test', '2024-01-25', '2024-01-31'))
SELECT ticker, trade_date, split, count(split) OVER (PARTITION BY ticker, trade_date)::INTEGER AS coverage
FROM dates LEFT JOIN spans ON trade_date BETWEEN a AND b""",
    "walk_forward_folds": f"WITH {DATES}, {PLAN} SELECT ticker, fold_index, split, trade_date FROM plan",
    "fold_invariants": f"WITH {DATES}, {PLAN} SELECT ticker, fold_index, "
    + ", ".join(
        f"{fn}(CASE WHEN split = '{s}' THEN trade_date END) AS {s}_{tag}"
        for fn, tag in (("min", "first"), ("max", "last"))
        for s in ("train", "validation", "test")
    )
    + ", count(*) AS days FROM plan GROUP BY ticker, fold_index",
    "selected_folds": f"WITH {DATES}, {PLAN} SELECT ticker, fold_index, split, trade_date FROM plan"
    " WHERE fold_index IN (2, 3)",
    "fold_index": f"WITH {ROWS}, {DATES[len(SNAP) + 1:]}, {PLAN} SELECT s.ticker, fold_index, split,"
    " global_index AS global_anchor_index, session_start_index, row_no AS anchor_index, s.trade_date,"
    " session_id, CAST(ts AS VARCHAR) AS anchor_timestamp"
    " FROM stored s JOIN plan p ON s.ticker = p.ticker AND s.trade_date = p.trade_date WHERE is_anchor",
}
