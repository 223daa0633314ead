"""Column expressions over one book row: validity rules, mid price, derived features."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from depthframe.schema import (
    BOOK_COLUMNS,
    DERIVED_FEATURES,
    LEVELS,
    PRICE_COLUMNS,
    RAW_COLUMNS,
    SIZE_COLUMNS,
)


def is_finite(x: Column) -> Column:
    """Never null: false for null, NaN (which sorts above infinity) and both infinities."""
    return F.coalesce(F.abs(x) < F.lit(float("inf")), F.lit(False))


# Wide rules are written as SQL text: one parsed expression instead of hundreds of column
# objects keeps building a plan fast.
_ALL_LEVELS = ", ".join(BOOK_COLUMNS)
_BID, _ASK = "coalesce(BIDp1 > 0, false)", "coalesce(ASKp1 > 0, false)"
_CROSSED = f"({_BID} AND {_ASK} AND BIDp1 > ASKp1)"


def has_any_book_value() -> Column:
    return F.expr(f"coalesce({_ALL_LEVELS}) IS NOT NULL")


def whole_book_missing() -> Column:
    return F.expr(f"coalesce({_ALL_LEVELS}) IS NULL")


def bid_side_valid() -> Column:
    return F.expr(_BID)


def ask_side_valid() -> Column:
    return F.expr(_ASK)


def crossed() -> Column:
    return F.expr(_CROSSED)


def _out_of_order(near: str, far: str, wrong: str) -> str:
    return f"coalesce({near} > 0 AND {far} > 0 AND {near} {wrong} {far}, false)"


_LEVEL_ORDER = " OR ".join(
    _out_of_order(f"{side}p{i}", f"{side}p{i + 1}", wrong)
    for i in range(1, LEVELS)
    for side, wrong in (("BID", "<"), ("ASK", ">"))
)


def level_order_violation() -> Column:
    """Bids must not rise and asks must not fall away from the touch."""
    return F.expr(_LEVEL_ORDER)


def _any_negative(columns: list[str]) -> str:
    return f"coalesce(least({', '.join(columns)}) < 0, false)"


def negative_price() -> Column:
    return F.expr(_any_negative(PRICE_COLUMNS))


def negative_size() -> Column:
    return F.expr(_any_negative(SIZE_COLUMNS))


def mid_price() -> Column:
    return F.expr(
        f"CASE WHEN {_BID} AND {_ASK} AND NOT {_CROSSED} THEN (BIDp1 + ASKp1) / 2.0D"
        f" WHEN {_BID} AND NOT {_ASK} THEN BIDp1 WHEN {_ASK} AND NOT {_BID} THEN ASKp1 END"
    )


def book_valid() -> Column:
    return F.expr(
        f"({_BID} OR {_ASK}) AND NOT {_CROSSED} AND NOT ({_LEVEL_ORDER})"
        f" AND NOT {_any_negative(SIZE_COLUMNS)} AND NOT {_any_negative(PRICE_COLUMNS)}"
    )


def time_of_day(ts: Column) -> Column:
    """``HH:mm:ss`` with any fraction, taken from the zone-free timestamp itself."""
    return F.substring(ts.cast("string"), 12, 15)


def finite_sql(x: str) -> str:
    """Text form of ``is_finite``."""
    return f"coalesce(abs({x}) < double('infinity'), false)"


def _finite_or_null(x: str) -> str:
    return f"CASE WHEN {finite_sql(x)} THEN {x} END"


def _safe_ratio(num: str, den: str) -> str:
    return f"CASE WHEN {finite_sql(num)} AND {finite_sql(den)} AND {den} <> 0 THEN {num} / {den} END"


def _null_as_zero_sum(terms: list[str]) -> str:
    return "(" + " + ".join(f"coalesce({t}, 0D)" for t in terms) + ")"


def derived_features() -> dict[str, Column]:
    """Name -> expression for the eleven optional features."""
    levels = range(1, LEVELS + 1)
    bid_depth = _null_as_zero_sum([f"BIDs{i}" for i in levels])
    ask_depth = _null_as_zero_sum([f"ASKs{i}" for i in levels])
    touch_size, spread = "(BIDs1 + ASKs1)", "(ASKp1 - BIDp1)"
    depth_balance = _safe_ratio(f"({bid_depth} - {ask_depth})", f"({bid_depth} + {ask_depth})")
    # Depth regressed on level 1..5: the centred levels have squared sum 10.
    slope = _null_as_zero_sum([f"{i - 3}D * (BIDs{i} + ASKs{i})" for i in levels])
    text = {
        "spread": _finite_or_null(spread),
        "relative_spread": _safe_ratio(spread, "((ASKp1 + BIDp1) / 2D)"),
        "mid_price": _finite_or_null("mid_price"),
        "microprice": _safe_ratio("(ASKp1 * BIDs1 + BIDp1 * ASKs1)", touch_size),
        "l1_imbalance": _safe_ratio("(BIDs1 - ASKs1)", touch_size),
        "l5_imbalance": depth_balance,
        "bid_depth": _finite_or_null(bid_depth),
        "ask_depth": _finite_or_null(ask_depth),
        "depth_imbalance": depth_balance,
        "price_slope": _finite_or_null("(((ASKp5 - ASKp1) + (BIDp1 - BIDp5)) / 8D)"),
        "volume_slope": _finite_or_null(f"({slope} / 10D)"),
    }
    return {name: F.expr(t) for name, t in text.items()}


def select_features(derived: list[str] | None = None) -> list[str]:
    """Raw columns first, then the requested derived ones in the given order."""
    derived = list(derived or [])
    unknown = sorted(set(derived) - set(DERIVED_FEATURES))
    if unknown:
        raise ValueError(f"unknown derived features: {unknown}")
    if len(set(derived)) != len(derived):
        raise ValueError("derived features must be unique")
    return RAW_COLUMNS + derived
