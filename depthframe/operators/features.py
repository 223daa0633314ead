"""Derived book features and the feature validity flag."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from depthframe.functions import book
from depthframe.schema import KEY, RAW_COLUMNS, require


def all_finite(names: list[str]) -> Column:
    return F.expr(" AND ".join(book.finite_sql(f"`{c}`") for c in names))


def add_features(timeline: DataFrame, derived: list[str] | None = None) -> DataFrame:
    """Append the requested derived features and ``feature_valid``.

    ``mid_price`` is only normalised (non-finite to null), never recomputed.
    """
    require(timeline, [*KEY, "mid_price", "book_valid", *RAW_COLUMNS], "feature input")
    columns = book.select_features(derived)
    formulas = book.derived_features()
    out = timeline.withColumns({name: formulas[name] for name in derived or []})
    valid = F.coalesce(F.col("book_valid"), F.lit(False)) & all_finite(columns)
    return out.withColumn("feature_valid", valid)
