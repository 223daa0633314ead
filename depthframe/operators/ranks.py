"""Global order statistics inside a group: positions, tied ranks, equal-count bins.

A group here (one model and fold) can hold most of the data. One narrow pass counts the groups; those
with more than ``rows_per_part`` rows get cut points, of which at most two numbers per
``rows_per_part`` rows come to the driver. Rows are then ordered inside (group, part) and shifted
by the totals of the parts before them. A part is a function of the values alone, so it does not
matter how often it is computed. A value that fills a whole part by itself is a part of its own:
all its rows share one rank, and where rows must be told apart they are split by the next order
column.
"""

from __future__ import annotations

import tempfile
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

ROWS_PER_PART = 1_000_000
#: Cut points are quantiles of this grid, so a group has at most as many parts.
GRID = 1024
SALTS = 64

def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the cluster's shared ``spark.checkpoint.dir``; a local session may make its own."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is not None:
        return
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured is None:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        configured = tempfile.mkdtemp(prefix="spark-")
    sc.setCheckpointDir(configured)


BEFORE = (Window.unboundedPreceding, -1)


def as_number(df: DataFrame, column: str) -> Column | None:
    """A number that never falls while the column rises; none for other types."""
    kind = df.schema[column].dataType
    if isinstance(kind, NumericType):
        return F.col(column).cast("double")
    if kind.typeName() in ("timestamp", "timestamp_ntz", "date"):
        return F.unix_micros(F.col(column).cast("timestamp")).cast("double")
    return None


@dataclass
class Cuts:
    """Cut points of the groups that have any, as a small table; ``None`` if there is no such group."""

    table: DataFrame | None
    group: list[str]

    def add(self, df: DataFrame, value: Column, name: str, out: str) -> DataFrame:
        """Add the part of each row: even for a range of values, odd for a single frequent value."""
        keys = [f"_c_{g}" for g in self.group]
        named = self.table.select(*[F.col(g).alias(k) for g, k in zip(self.group, keys)], F.col(name).alias("_cuts"))
        same = [F.col(g).eqNullSafe(F.col(k)) for g, k in zip(self.group, keys)]
        joined = df.withColumn("_v", value).join(F.broadcast(named), same, "left")
        below = F.size(F.filter("_cuts", lambda c: c < F.col("_v")))
        equal = F.size(F.filter("_cuts", lambda c: c == F.col("_v")))
        code = F.when(F.col("_cuts").isNull(), 0).otherwise(2 * below + F.when(equal >= 2, 1).otherwise(0))
        return joined.withColumn(out, code).drop("_v", "_cuts", *keys)

    def by_group(self) -> dict[tuple, dict[str, list[float]]]:
        """The cut points by group, for tasks that look them up themselves."""
        rows = self.table.collect() if self.table is not None else []
        names = [c for c in self.table.columns if c not in self.group] if rows else []
        return {tuple(r[g] for g in self.group): {n: r[n] for n in names} for r in rows}


def cut_points(df: DataFrame, group: list[str], values: dict[str, Column], rows_per_part: int) -> Cuts:
    """Cut points of each value for every group of more than ``rows_per_part`` rows.

    Counting the groups reads their columns only. Where a group is large, a second pass sketches
    the quantiles of all groups.
    """
    if not values:
        return Cuts(None, group)
    largest = df.groupBy(*group).count().agg(F.max("count")).first()[0] or 0
    if largest <= rows_per_part:
        return Cuts(None, group)
    grid = F.array(*[F.lit(i / GRID) for i in range(1, GRID)])
    counted = df.groupBy(*group).agg(
        F.count(F.lit(1)).alias("_n"), *[F.percentile_approx(v, grid, 10_000).alias(n) for n, v in values.items()]
    )
    parts = F.least(F.ceil(F.col("_n") / rows_per_part), F.lit(GRID)).cast("int")
    steps = F.sequence(F.lit(1), parts - 1)
    chosen = [_picked(name, steps, parts).alias(name) for name in values]
    found = counted.filter(F.col("_n") > rows_per_part).select(*group, *chosen)
    return Cuts(df.sparkSession.createDataFrame(found.collect(), found.schema), group)


def _picked(name: str, steps: Column, parts: Column) -> Column:
    return F.transform(steps, lambda i: F.element_at(F.col(name), F.floor(i * GRID / parts).cast("int")))


def running_total(
    df: DataFrame,
    group: list[str],
    order: list[str],
    amount: Column,
    out: str,
    rows_per_part: int = ROWS_PER_PART,
    whole: str | None = None,
) -> DataFrame:
    """Sum of ``amount`` over the rows strictly before each row of its group.

    ``whole`` names a column for the group's total. ``order`` must be unique within a group. Rows are cut by its first column and, where one value of
    it is frequent, by the day or text of the second.
    """
    order = [c for c in order if c not in group] or order
    first = as_number(df, order[0])
    cuts = cut_points(df, group, {"_first": first} if first is not None else {}, rows_per_part)
    if first is not None and cuts.table is None:
        w = Window.partitionBy(*group).orderBy(*order).rowsBetween(*BEFORE)
        more = {whole: F.sum(amount).over(Window.partitionBy(*group))} if whole else {}
        return df.withColumns({out: F.coalesce(F.sum(amount).over(w), F.lit(0)), **more})
    if first is None:  # texts, such as dates: every value is a part
        rows = df.withColumns({"_part": F.lit(0), "_sub": F.col(order[0]).cast("string")})
    else:
        rows = cuts.add(df, first, "_first", "_part")
        rows = rows.withColumn("_sub", F.when(F.col("_part") % 2 == 1, _coarse(df, order[1:])))
    parts = [*group, "_part", "_sub"]
    inside = Window.partitionBy(*parts).orderBy(*order).rowsBetween(*BEFORE)
    local = rows.withColumn("_local", F.coalesce(F.sum(amount).over(inside), F.lit(0)))
    totals = rows.groupBy(*parts).agg(F.sum(amount).alias("_total"))
    earlier = Window.partitionBy(*group).orderBy("_part", "_sub").rowsBetween(*BEFORE)
    every = [F.sum("_total").over(Window.partitionBy(*group)).alias(whole)] if whole else []
    before = F.coalesce(F.sum("_total").over(earlier), F.lit(0)).alias("_shift")
    shift = totals.select(*[F.col(c).alias(f"_s{c}") for c in parts], before, *every)
    same = [F.col(c).eqNullSafe(F.col(f"_s{c}")) for c in parts]
    return (
        local.join(shift, same)
        .withColumn(out, F.col("_local") + F.col("_shift"))
        .drop("_part", "_sub", "_local", "_shift", *[f"_s{c}" for c in parts])
    )


def _coarse(df: DataFrame, order: list[str]) -> Column:
    """A text that rises with the first of these columns and has few values: a day, or a text itself."""
    if not order:
        return F.lit(None).cast("string")
    kind = df.schema[order[0]].dataType
    if kind.typeName() in ("timestamp", "timestamp_ntz", "date"):
        return F.date_format(order[0], "yyyy-MM-dd")
    if kind.typeName() == "string":
        return F.col(order[0])
    return F.lit(None).cast("string")


def average_ranks(
    df: DataFrame, group: list[str], value: str, weight: Column | None = None, **limits
) -> DataFrame:
    """One row per distinct value: its 1-based rank with ties averaged, centred on zero.

    ``weight`` counts a row several times. Works on counts per value, so ties of any size
    collapse before the exchange.
    """
    counts = df.groupBy(*group, value).agg(
        F.sum(weight if weight is not None else F.lit(1).cast("bigint")).alias("_n")
    )
    ranked = running_total(counts, group, [value], F.col("_n"), "_before", **limits)
    size = counts.groupBy(*group).agg(F.sum("_n").alias("_size"))
    rank = F.col("_before") + (F.col("_n") + 1) / 2.0
    return ranked.join(size, group).select(
        *group, value, rank.alias("rank"), (rank - (F.col("_size") + 1) / 2.0).alias("centred")
    )


def _local_rank(df: DataFrame, group: list[str], value: str, part: str | None, out: str) -> DataFrame:
    """Tied rank inside the part, or inside the group if it is not cut.

    Zero for the rows of a single frequent value, which are spread over tasks.
    """
    keys, alone = list(group), F.lit(False)
    if part is not None:
        alone = F.col(part) % 2 == 1
        spread = F.pmod(F.xxhash64(*df.columns), F.lit(SALTS))
        df = df.withColumn("_salt", F.when(alone, spread).otherwise(0))
        keys += [part, "_salt"]
    ties = F.count(F.lit(1)).over(Window.partitionBy(*keys, value))
    rank = F.rank().over(Window.partitionBy(*keys).orderBy(value)) + (ties - 1) / 2.0
    return df.withColumn(out, F.when(alone, 0.0).otherwise(rank)).drop("_salt")


def _correlation(n: Column, x: Column, y: Column, xx: Column, yy: Column, xy: Column) -> Column:
    spread = F.sqrt(xx - x * x / n) * F.sqrt(yy - y * y / n)
    return F.try_divide(xy - x * y / n, spread)


def rank_correlation(
    df: DataFrame, group: list[str], x: str, y: str, weight: Column | None = None, rows_per_part: int = ROWS_PER_PART
) -> DataFrame:
    """Spearman correlation per group, null if a side is constant or below two rows.

    Every row gets its rank inside its part of x, then inside its part of y. The sums of each
    (part of x, part of y) are enough to add what the parts before contribute, so rows never meet a
    table of ranks.
    """
    if weight is not None:
        return _weighted_rank_correlation(df, group, x, y, weight, rows_per_part)
    rows = df.select(*group, F.col(x).cast("double").alias("_x"), F.col(y).cast("double").alias("_y"))
    cuts = cut_points(rows, group, {"_x": F.col("_x"), "_y": F.col("_y")}, rows_per_part)
    for value, part, out in (("_x", "_px", "_rx"), ("_y", "_py", "_ry")):
        if cuts.table is not None:
            rows = cuts.add(rows, F.col(value), value, part)
        rows = _local_rank(rows, group, value, None if cuts.table is None else part, out)
    a, b = F.col("_rx"), F.col("_ry")
    cell = [*group, *([] if cuts.table is None else ["_px", "_py"])]
    cells = rows.groupBy(*cell).agg(
        F.count(F.lit(1)).alias("_n"), F.sum(a).alias("_sx"), F.sum(b).alias("_sy"), F.sum(a * a).alias("_sxx"),
        F.sum(b * b).alias("_syy"), F.sum(a * b).alias("_sxy"), F.min("_x").alias("_x0"), F.max("_x").alias("_x1"),
        F.min("_y").alias("_y0"), F.max("_y").alias("_y1"),
    )
    if cuts.table is not None:
        for part, out in (("_px", "_ox"), ("_py", "_oy")):
            cells = cells.join(_offsets(cells, group, part, out), [*group, part])
        n, ox, oy = F.col("_n"), F.col("_ox"), F.col("_oy")
        cells = cells.withColumns(
            {
                "_sxy": F.col("_sxy") + oy * F.col("_sx") + ox * F.col("_sy") + n * ox * oy,
                "_sxx": F.col("_sxx") + 2 * ox * F.col("_sx") + n * ox * ox,
                "_syy": F.col("_syy") + 2 * oy * F.col("_sy") + n * oy * oy,
                "_sx": F.col("_sx") + n * ox,
                "_sy": F.col("_sy") + n * oy,
            }
        )
        sums = [F.sum(c).alias(c) for c in ("_n", "_sx", "_sy", "_sxx", "_syy", "_sxy")]
        edges = [F.min(c).alias(c) for c in ("_x0", "_y0")] + [F.max(c).alias(c) for c in ("_x1", "_y1")]
        cells = cells.groupBy(*group).agg(*sums, *edges)
    varies = (F.col("_x0") < F.col("_x1")) & (F.col("_y0") < F.col("_y1"))
    value = _correlation(*[F.col(c) for c in ("_n", "_sx", "_sy", "_sxx", "_syy", "_sxy")])
    return cells.select(*group, F.when(varies, value).alias("rank_ic"))


def _offsets(cells: DataFrame, group: list[str], part: str, out: str) -> DataFrame:
    """What to add to the local ranks of each part, centred on the group's middle rank."""
    totals = cells.groupBy(*group, part).agg(F.sum("_n").alias("_t"))
    before = F.coalesce(F.sum("_t").over(Window.partitionBy(*group).orderBy(part).rowsBetween(*BEFORE)), F.lit(0))
    every = F.sum("_t").over(Window.partitionBy(*group))
    own = F.when(F.col(part) % 2 == 1, (F.col("_t") + 1) / 2.0).otherwise(0.0)
    return totals.select(*group, part, (before + own - (every + 1) / 2.0).alias(out))


def _weighted_rank_correlation(df, group, x, y, weight, rows_per_part) -> DataFrame:
    pairs = df.groupBy(*group, x, y).agg(F.sum(weight).alias("_w"))
    w = F.col("_w")
    rx = average_ranks(pairs, group, x, w, rows_per_part=rows_per_part).select(*group, x, F.col("centred").alias("_rx"))
    ry = average_ranks(pairs, group, y, w, rows_per_part=rows_per_part).select(*group, y, F.col("centred").alias("_ry"))
    joined = pairs.join(rx, [*group, x]).join(ry, [*group, y])
    a, b = F.col("_rx"), F.col("_ry")
    spread = F.sqrt(F.sum(w * a * a)) * F.sqrt(F.sum(w * b * b))
    return joined.groupBy(*group).agg(F.try_divide(F.sum(w * a * b), spread).alias("rank_ic"))


def equal_count_bins(
    df: DataFrame, group: list[str], order: list[str], n_bins: int, **limits
) -> DataFrame:
    """Add ``bin_index`` 1..n: sizes differ by at most one and the first bins are larger."""
    if n_bins < 2:
        raise ValueError("n_bins must be >= 2")
    placed = running_total(df, group, order, F.lit(1).cast("bigint"), "_pos", whole="_size", **limits)
    small, extra = F.expr(f"_size DIV {n_bins}"), F.col("_size") % n_bins
    large_rows = extra * (small + 1)
    placed = placed.withColumns({"_small": small, "_extra": extra, "_large": large_rows})
    index = F.when(
        F.col("_size") < n_bins,
        F.raise_error(F.lit("fewer valid samples than bins")).cast("bigint"),
    ).otherwise(
        F.when(F.col("_pos") < F.col("_large"), F.expr("_pos DIV (_small + 1)")).otherwise(
            F.col("_extra") + F.expr("(_pos - _large) DIV greatest(_small, 1)")
        )
        + 1
    )
    return placed.withColumn("bin_index", index).drop("_pos", "_size", "_small", "_extra", "_large")
