"""Sums over the dates of many folds without repeating a row per fold.

Walk-forward folds overlap, so most dates belong to several of them. Dates that belong to the same
folds form a block. Rows are added up once per block; a fold is the sum of its blocks. What is
repeated per fold is one sum per block and not the rows behind it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

FIT_KEY = ["ticker", "fold_index"]
BLOCK_KEY = ["ticker", "block"]


def date_blocks(plan: DataFrame) -> DataFrame:
    """``(ticker, trade_date, block, folds)``: a block is named after the first of its dates."""
    # Everything below is per ticker: one exchange of the plan serves both groupings.
    dates = (
        plan.select("ticker", "trade_date", "fold_index").repartition("ticker")
        .groupBy("ticker", "trade_date")
        .agg(F.sort_array(F.collect_set("fold_index")).alias("folds"))
    )
    same = Window.partitionBy("ticker", "folds")
    return dates.withColumn("block", F.min("trade_date").over(same))


def in_blocks(rows: DataFrame, plan: DataFrame | None) -> tuple[DataFrame, DataFrame | None]:
    """Rows of the plan's dates with their ``block``, and the folds of each block.

    Without a plan the rows carry ``fold_index`` themselves and every fold is a block of its own.
    """
    if plan is None:
        return rows.withColumn("block", F.col("fold_index").cast("string")), None
    blocks = date_blocks(plan)
    rows = rows.drop("fold_index") if "fold_index" in rows.columns else rows
    folds = blocks.select(*BLOCK_KEY, F.explode("folds").alias("fold_index")).distinct()
    return rows.join(blocks.select("ticker", "trade_date", "block"), ["ticker", "trade_date"]), folds


def per_fold(sums: DataFrame, folds: DataFrame | None) -> DataFrame:
    """Block sums once for every fold that contains the block."""
    if folds is None:
        return sums.withColumn("fold_index", F.col("block").cast("bigint")).drop("block")
    return sums.join(folds, BLOCK_KEY).drop("block")


def date_sums(rows: DataFrame, plan: DataFrame | None, *sums: Column) -> DataFrame:
    """Aggregates per date, repeated for every fold that trains on the date.

    Rows are combined to one per date where they are read; only those meet the plan.
    """
    if plan is None:
        return rows.groupBy(*FIT_KEY, "trade_date").agg(*sums)
    per_date = rows.groupBy("ticker", "trade_date").agg(*sums)
    return per_date.join(plan.select("ticker", "trade_date", "fold_index"), ["ticker", "trade_date"])


def pair_moments(x: Column, y: Column) -> list[Column]:
    """Count, means, centred sums of squares and products, and the range of x."""
    return [
        F.count(F.lit(1)).alias("n"),
        F.avg(x).alias("mx"),
        F.avg(y).alias("my"),
        F.coalesce(F.regr_sxx(y, x), F.lit(0.0)).alias("sxx"),
        F.coalesce(F.regr_sxy(y, x), F.lit(0.0)).alias("sxy"),
        F.min(x).alias("x_min"),
        F.max(x).alias("x_max"),
    ]


def merged_moments(dates: DataFrame, keys: list[str]) -> DataFrame:
    """:func:`pair_moments` of the union of the dates of each key, from those of the dates.

    Centred sums are merged pair by pair, so a mean far from zero costs no digits.
    """
    names = ["n", "mx", "my", "sxx", "sxy"]
    parts = F.array_sort(F.collect_list(F.struct("trade_date", *names)))
    zero = F.struct(
        F.lit(0).cast("bigint").alias("n"), *[F.lit(0.0).alias(c) for c in names[1:]]
    )

    def merge(a: Column, b: Column) -> Column:
        n = a["n"] + b["n"]
        dx, dy = b["mx"] - a["mx"], b["my"] - a["my"]
        share, both = b["n"] / n, a["n"] * (b["n"] / n)
        return F.struct(
            n.alias("n"), (a["mx"] + dx * share).alias("mx"), (a["my"] + dy * share).alias("my"),
            (a["sxx"] + b["sxx"] + dx * dx * both).alias("sxx"), (a["sxy"] + b["sxy"] + dx * dy * both).alias("sxy"),
        )

    grouped = dates.groupBy(*keys).agg(
        parts.alias("_parts"), F.min("x_min").alias("x_min"), F.max("x_max").alias("x_max")
    )
    total = grouped.withColumn("_sum", F.aggregate("_parts", zero, merge))
    return total.select(*keys, "_sum.*", "x_min", "x_max")
