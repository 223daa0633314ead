"""Column contracts shared by every stage."""

from __future__ import annotations

from pyspark.sql import types as T

LEVELS = 5

# Canonical snapshot columns, level by level, then the trade scalars.
BOOK_COLUMNS = [
    f"{side}{kind}{level}"
    for level in range(1, LEVELS + 1)
    for side, kind in (("ASK", "p"), ("ASK", "s"), ("BID", "p"), ("BID", "s"))
]
TRADE_COLUMNS = ["last", "volume", "amount"]
RAW_COLUMNS = BOOK_COLUMNS + TRADE_COLUMNS
PRICE_COLUMNS = [c for c in BOOK_COLUMNS if c[3] == "p"]
SIZE_COLUMNS = [c for c in BOOK_COLUMNS if c[3] == "s"]

# One trading session of one instrument: nothing windowed or matched ever leaves it.
KEY = ["ticker", "trade_date", "session_id"]
DAY = ["ticker", "trade_date"]

# Fixed values from here to the last schema: session clocks, column names and types, metric names.
# Half-open [start, end) clocks. "24:00:00" means "until midnight".
DEFAULT_SESSIONS = {"AM": ("09:30:00", "11:30:00"), "PM": ("13:00:00", "14:57:00")}

CLEAN_COLUMNS = [
    "trade_date",
    "session_id",
    "timestamp",
    "seconds",
    "ticker",
    *RAW_COLUMNS,
    "mid_price",
    "snapshot_gap_seconds",
    "staleness_seconds",
    "is_ffilled",
    "book_valid",
]

DERIVED_FEATURES = [
    "spread",
    "relative_spread",
    "mid_price",
    "microprice",
    "l1_imbalance",
    "l5_imbalance",
    "bid_depth",
    "ask_depth",
    "depth_imbalance",
    "price_slope",
    "volume_slope",
]

SPLITS = ["train", "validation", "test"]

METRICS = [
    "mae",
    "rmse",
    "ts_ic",
    "rank_ic",
    "direction_accuracy",
    "up_precision",
    "up_recall",
    "down_precision",
    "down_recall",
]


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(n, t) for n, t in fields.items()])


ROWS_SCHEMA = _struct(
    ticker=T.StringType(),
    trade_date=T.StringType(),
    session_id=T.StringType(),
    timestamp=T.TimestampNTZType(),
    global_index=T.LongType(),
    session_start_index=T.LongType(),
    row_no=T.LongType(),
    features=T.ArrayType(T.FloatType()),
    target=T.FloatType(),
    row_valid=T.BooleanType(),
    target_valid=T.BooleanType(),
    mid_t=T.FloatType(),
    future_mid=T.FloatType(),
    bid1=T.FloatType(),
    ask1=T.FloatType(),
    is_anchor=T.BooleanType(),
)

QUALITY_SCHEMA = _struct(
    ticker=T.StringType(),
    trade_date=T.StringType(),
    row_count=T.LongType(),
    missing_ratio=T.DoubleType(),
    duplicate_count=T.LongType(),
    crossed_book_count=T.LongType(),
    one_side_missing_count=T.LongType(),
    max_gap=T.DoubleType(),
    p95_gap=T.DoubleType(),
    stale_snapshot_ratio=T.DoubleType(),
    invalid_level_order_count=T.LongType(),
)

FOLD_INDEX_SCHEMA = _struct(
    ticker=T.StringType(),
    fold_index=T.LongType(),
    split=T.StringType(),
    global_anchor_index=T.LongType(),
    session_start_index=T.LongType(),
    anchor_index=T.LongType(),
    trade_date=T.StringType(),
    session_id=T.StringType(),
    anchor_timestamp=T.TimestampNTZType(),
)

PLAN_SCHEMA = _struct(
    ticker=T.StringType(), fold_index=T.LongType(), split=T.StringType(), trade_date=T.StringType()
)

PREDICTION_SCHEMA = _struct(
    model_name=T.StringType(),
    model_version=T.StringType(),
    dataset_version=T.StringType(),
    fold_index=T.LongType(),
    split=T.StringType(),
    ticker=T.StringType(),
    trade_date=T.StringType(),
    session_id=T.StringType(),
    anchor_timestamp=T.TimestampNTZType(),
    mid_t=T.DoubleType(),
    future_mid=T.DoubleType(),
    target=T.DoubleType(),
    prediction=T.DoubleType(),
    bid1=T.DoubleType(),
    ask1=T.DoubleType(),
    spread=T.DoubleType(),
)


def label_column(horizon_seconds: int, kind: str = "log") -> str:
    if kind not in ("log", "simple"):
        raise ValueError("kind must be 'log' or 'simple'")
    return f"Target_{horizon_seconds}s_{kind}"


def require(df, names, what: str) -> None:
    missing = sorted(set(names) - set(df.columns))
    if missing:
        raise ValueError(f"{what} is missing columns: {missing}")
