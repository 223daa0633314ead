"""Raw daily snapshot files to typed, session-assigned snapshots."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from depthframe.functions.book import time_of_day
from depthframe.schema import DEFAULT_SESSIONS, KEY, RAW_COLUMNS

INDEX_COLUMN = "__index_level_0__"  # name pandas gives an unnamed index
#: Seconds since 1970 of the years 1990 and 2100, between which integer times must lie.
NANOSECOND_YEARS = (631_152_000, 4_102_444_800)
ORDER_BLOCK_ROWS = 1_000_000


def discover_sources(spark: SparkSession, raw_dir: str, ticker: str) -> list[str]:
    """``<raw>/<ticker>/*.parquet`` if that folder exists, else ``<raw>/*.parquet``, by name."""
    jvm = spark._jvm
    conf = spark._jsc.hadoopConfiguration()
    own = jvm.org.apache.hadoop.fs.Path(f"{raw_dir}/{ticker}")
    fs = own.getFileSystem(conf)
    root = f"{raw_dir}/{ticker}" if fs.exists(own) and fs.getFileStatus(own).isDirectory() else raw_dir
    found = fs.globStatus(jvm.org.apache.hadoop.fs.Path(f"{root}/*.parquet"))
    paths = [s.getPath() for s in found or []]
    if not paths:
        raise FileNotFoundError(f"no raw parquet files in {root}")
    return [p.toString() for p in sorted(paths, key=lambda p: p.getName())]


def row_text(columns: list[str]) -> Column:
    """Canonical text of a row: values in column order, nulls told apart from empty text."""
    return F.concat_ws("|", *[F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("-")) for c in columns])


def _summed(text: Column, part: int) -> Column:
    """Sum over rows of 60 bits of each row's MD5; ``part`` 0 or 1 picks the bits."""
    bits = F.substring(F.md5(F.encode(text, "UTF-8")), 1 + 15 * part, 15)
    return F.sum(F.conv(bits, 16, 10).cast("decimal(38,0)"))


def file_fingerprints(rows: DataFrame, columns: list[str]) -> DataFrame:
    """``(file, rows, print)`` of the row contents of each file, whatever the order of rows.

    Sums are combined before the exchange, so neither the size of a file nor the number of rows
    matters. Pass a row number among ``columns`` if the order of rows counts.
    """
    sums = rows.groupBy("file").agg(
        F.count(F.lit(1)).alias("rows"),
        *[_summed(row_text(columns), i).cast("string").alias(f"s{i}") for i in (0, 1)],
    )
    return sums.select("file", "rows", F.md5(F.concat_ws("|", F.col("rows").cast("string"), "s0", "s1")).alias("print"))


def source_fingerprint(fingerprints: DataFrame) -> DataFrame:
    """One hash over all files' fingerprints, independent of file names and order."""
    sums = fingerprints.agg(
        F.count(F.lit(1)).alias("file_count"),
        *[_summed(F.col("print"), i).cast("string").alias(f"s{i}") for i in (0, 1)],
    )
    text = F.concat_ws("|", F.col("file_count").cast("string"), "s0", "s1")
    return sums.select("file_count", F.md5(text).alias("source_hash"))


def apply_column_mapping(df: DataFrame, mapping: dict[str, str] | None) -> DataFrame:
    """Rename source columns to canonical ones; absent sources are ignored."""
    used: dict[str, str] = {}
    for source, target in (mapping or {}).items():
        if source not in df.columns:
            continue
        if target in used.values():
            raise ValueError(f"several columns map to {target!r}")
        if source != target and target in df.columns:
            raise ValueError(f"both {source!r} and {target!r} exist")
        used[source] = target
    return df.withColumnsRenamed(used)


def restore_time_index(df: DataFrame, index_column: str | None = None) -> DataFrame:
    """Turn a pandas DatetimeIndex column back into ``timestamp``."""
    times = [
        f.name
        for f in df.schema.fields
        if isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType)) and f.name not in RAW_COLUMNS
    ]
    if index_column is None and INDEX_COLUMN in df.columns:
        index_column = INDEX_COLUMN
    if index_column is not None:
        if "timestamp" in df.columns:
            raise ValueError("timestamp exists both as an index and as a column")
        return df.withColumnRenamed(index_column, "timestamp")
    if "timestamp" not in df.columns and len(times) == 1:
        return df.withColumnRenamed(times[0], "timestamp")
    return df


def lenient_double(name: str) -> Column:
    """Non-castable text and NaN become null; infinities stay and fail the finite checks."""
    return F.expr(f"nanvl(try_cast(`{name}` AS double), CAST(NULL AS double))").alias(name)


def parse_date(text: Column) -> Column:
    """``yyyy-MM-dd`` or ``yyyyMMdd``, as text or number; anything else is null."""
    text = F.trim(text.cast("string"))
    dashed = F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}$"), text.try_cast("date"))
    compact = F.regexp_replace(text, r"^(\d{4})(\d{2})(\d{2})$", "$1-$2-$3")
    return F.coalesce(dashed, F.when(text.rlike(r"^\d{8}$"), compact.try_cast("date")))


def parse_timestamp(df: DataFrame, fallback_date: Column) -> Column:
    """Timestamp, time of day on ``fallback_date``, or ISO text with any zone suffix dropped.

    Text may be dashed or compact (``20260105T093000``), clocks too (``093000``). Integers are
    nanoseconds since 1970 (pandas files read with ``nanosAsLong``) between 1990 and 2100; seconds,
    milliseconds or other counts would fall into 1970 and are null instead.
    """
    kind = df.schema["timestamp"].dataType
    ts = F.col("timestamp")
    if isinstance(kind, T.IntegralType):
        low, high = (n * 1_000_000_000 for n in NANOSECOND_YEARS)
        return F.expr(
            f"IF(timestamp >= {low}L AND timestamp < {high}L, timestamp_ntz'1970-01-01 00:00:00'"
            " + (bigint(timestamp) DIV 1000) * INTERVAL '0.000001' SECOND, NULL)"
        )
    if not isinstance(kind, T.StringType):
        return ts.cast("timestamp_ntz")
    text = F.trim(ts)
    clock = F.regexp_replace(text, r"^(\d{2})(\d{2})(\d{2}(\.\d+)?)?$", "$1:$2:$3")
    clock = F.regexp_replace(F.regexp_replace(clock, ":$", ""), r"^(\d{2})$", "$1:00")
    is_clock = clock.rlike(r"^\d{2}:\d{2}(:\d{2}(\.\d+)?)?$")
    on_day = F.concat(fallback_date.cast("string"), F.lit(" "), clock)
    bare = F.regexp_replace(text, r"(Z|(?<=[0-9])[+-]\d{2}:?\d{2}(:\d{2})?)$", "")
    bare = F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}$"), text).otherwise(bare)
    bare = F.regexp_replace(bare, r"^(\d{4})(\d{2})(\d{2})(?=$|[T ])", "$1-$2-$3")
    bare = F.regexp_replace(bare, r"(?<=^.{10}[T ])(\d{2})(\d{2})(\d{2}(\.\d+)?)?$", "$1:$2:$3")
    bare = F.regexp_replace(bare, r":$", "")
    full = F.when(bare.rlike(r"^\d{4}-\d{2}-\d{2}"), bare.try_cast("timestamp_ntz"))
    return F.when(is_clock, on_day.try_cast("timestamp_ntz")).otherwise(full)


def session_problems(sessions: dict[str, tuple[str, str]]) -> list[str]:
    """What is wrong with session clocks: spelling, empty spans, overlaps."""
    found, spans = [], []
    for name, (start, end) in sessions.items():
        if not all(re.fullmatch(r"([01]\d|2[0-4]):[0-5]\d:[0-5]\d(\.\d{1,6})?", b) for b in (start, end)):
            found.append(f"{name}: {start} to {end} are not HH:MM:SS clocks")
        elif max(start, end) > "24:00:00" or start >= end:
            found.append(f"{name}: {start} to {end} is no span of a day")
        else:
            spans.append((start, end, name))
    spans.sort()
    found += [f"{b[2]} starts before {a[2]} ends" for a, b in zip(spans, spans[1:]) if b[0] < a[1]]
    return found if sessions else ["no session"]


def session_of(ts: Column, sessions: dict[str, tuple[str, str]] | None = None) -> Column:
    """Name of the half-open session holding ``ts``; null outside all of them."""
    clock = time_of_day(ts)
    out = F.lit(None).cast("string")
    sessions = DEFAULT_SESSIONS if sessions is None else sessions
    if session_problems(sessions):
        raise ValueError("; ".join(session_problems(sessions)))
    for name, (start, end) in reversed(list(sessions.items())):
        # The clock text has no trailing fraction zeros, so bounds must not either.
        start, end = (b.rstrip("0").rstrip(".") if "." in b else b for b in (start, end))
        out = F.when((clock >= start) & (clock < end), F.lit(name)).otherwise(out)
    return out


def prepare_snapshots(
    raw: DataFrame,
    *,
    ticker: str | Column | None = None,
    column_mapping: dict[str, str] | None = None,
    index_column: str | None = None,
) -> DataFrame:
    """Typed rows of every file, sessions not yet assigned.

    ``raw`` must carry ``file`` and ``row_index`` (file order). The trade date is the date
    of the timestamp. Bare clocks are dated by the file's ``trade_date`` column or else by its name;
    ``stated_date`` and ``file_date`` keep both, and :func:`source_violations` reports files whose
    column holds several dates and files with neither.
    """
    df = restore_time_index(apply_column_mapping(raw, column_mapping), index_column)
    missing = sorted({*RAW_COLUMNS, "timestamp"} - set(df.columns))
    if missing:
        raise ValueError(f"missing required columns after mapping: {missing}")
    stem = F.regexp_extract("file", r"([^/]+)\.parquet$", 1)
    stated = F.lit(None).cast("date")
    if "trade_date" in df.columns:
        kind = df.schema["trade_date"].dataType
        dated = isinstance(kind, (T.DateType, T.TimestampType, T.TimestampNTZType))
        stated = F.col("trade_date").cast("date") if dated else parse_date(F.col("trade_date"))
    df = df.withColumns({"_stated": stated, "_file_date": parse_date(stem)})
    hint = F.coalesce("_stated", "_file_date")
    if "trade_date" in df.columns and isinstance(df.schema["timestamp"].dataType, T.StringType):
        # A row without a date of its own takes the one its file states elsewhere.
        per_file = df.groupBy(F.col("file").alias("_of")).agg(F.min("_stated").alias("_whole"))
        df = df.join(per_file, F.col("file") == F.col("_of"))
        hint = F.coalesce("_stated", "_whole", "_file_date")
    if ticker is None:
        ticker = F.regexp_extract("file", r"([^/]+)/[^/]+$", 1)
        if "ticker" in df.columns:
            ticker = F.coalesce(F.col("ticker").cast("string"), ticker)
    elif isinstance(ticker, str):
        ticker = F.lit(ticker)
    return df.withColumn("timestamp", parse_timestamp(df, hint)).select(
        ticker.alias("ticker"),
        F.date_format("timestamp", "yyyy-MM-dd").alias("trade_date"),
        "timestamp",
        "file",
        "row_index",
        F.col("_stated").alias("stated_date"),
        F.col("_file_date").alias("file_date"),
        *[lenient_double(c) for c in RAW_COLUMNS],
    )


def read_snapshots(spark: SparkSession, paths: list[str] | str, **options) -> DataFrame:
    """Scan raw parquet files with their file order kept."""
    raw = spark.read.parquet(*([paths] if isinstance(paths, str) else paths))
    raw = raw.select(
        "*",
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.row_index").alias("row_index"),
    )
    return prepare_snapshots(raw, **options)


def assign_sessions(
    prepared: DataFrame, sessions: dict[str, tuple[str, str]] | None = None
) -> DataFrame:
    """Add ``session_id`` and drop rows outside every session."""
    return prepared.withColumn("session_id", session_of(F.col("timestamp"), sessions)).filter(
        F.col("session_id").isNotNull()
    )


def order_violations(snapshots: DataFrame) -> DataFrame:
    """Rows whose timestamp is earlier than the row before it in file order, per session.

    Checked inside blocks of file order, then across block edges on one row per block, so
    one large file is spread over many tasks.
    """
    keys = [*KEY, "_part"]
    rows = snapshots.select(
        *KEY, "timestamp", "row_index", F.expr(f"row_index DIV {ORDER_BLOCK_ROWS}").alias("_part")
    )
    before = F.lag("timestamp").over(Window.partitionBy(*keys).orderBy("row_index"))
    parts = (
        rows.withColumn("_prev", before)
        .groupBy(*keys)
        .agg(
            F.count(F.when(F.col("_prev") > F.col("timestamp"), 1)).alias("n"),
            F.min_by("timestamp", "row_index").alias("_first"),
            F.max_by("timestamp", "row_index").alias("_last"),
        )
    )
    edge = F.lag("_last").over(Window.partitionBy(*KEY).orderBy("_part")) > F.col("_first")
    return (
        parts.withColumn("_edge", F.coalesce(edge, F.lit(False)).cast("bigint"))
        .groupBy(*KEY)
        .agg(F.sum(F.col("n") + F.col("_edge")).alias("order_violations"))
    )


def source_violations(
    prepared: DataFrame, sessions: dict[str, tuple[str, str]] | None = None
) -> DataFrame:
    """Broken input rules as ``(rule, ticker, subject, violations)``; empty means pass."""
    inside = session_of(F.col("timestamp"), sessions).isNotNull()
    by_name = Window.partitionBy("ticker").orderBy("file")
    same_date = Window.partitionBy("ticker", "trade_date")
    per_file = (
        prepared.groupBy("ticker", "file")
        .agg(
            F.count(F.when(F.col("timestamp").isNull(), 1)).alias("unparsed"),
            F.count_distinct("trade_date").alias("dates"),
            F.count_distinct("stated_date").alias("stated"),
            F.count("file_date").alias("named"),
            F.min("trade_date").alias("trade_date"),
            F.count(F.when(inside, 1)).alias("inside"),
        )
        .withColumns(
            {
                "prev_date": F.lag("trade_date").over(by_name),
                "files": F.count(F.lit(1)).over(same_date),
                "first_of_date": F.row_number().over(same_date.orderBy("file")) == 1,
            }
        )
    )

    def rule(name: str, subject: str, broken: str, n: str = "1") -> Column:
        return F.expr(
            f"named_struct('rule', '{name}', 'subject', {subject},"
            f" 'violations', IF({broken}, bigint({n}), 0L))"
        )

    # All file rules from one aggregate, one output row per broken rule.
    rules = F.array(
        rule("unparseable timestamp", "file", "unparsed > 0", "unparsed"),
        rule("several trade dates in one file", "file", "dates > 1", "dates"),
        rule("several trade_date values in one file", "file", "stated > 1", "stated"),
        rule("no trade date in column or file name", "file", "stated = 0 AND named = 0"),
        rule("no configured session in file", "file", "inside = 0"),
        rule("files not in date order", "file", "coalesce(prev_date > trade_date, false)"),
        rule("several files for one trade date", "trade_date", "files > 1 AND first_of_date", "files"),
    )
    files = per_file.select("ticker", F.explode(rules).alias("r")).select("ticker", "r.*")
    order = order_violations(assign_sessions(prepared, sessions)).select(
        "ticker",
        F.lit("timestamps not in order").alias("rule"),
        F.concat_ws(" ", "trade_date", "session_id").alias("subject"),
        F.col("order_violations").alias("violations"),
    )
    out = files.unionByName(order).filter("violations > 0")
    return out.select("rule", "ticker", "subject", "violations")


def raise_on_violations(violations: DataFrame, what: str) -> None:
    """Stop if the (small) violation table has rows; only the first few are fetched."""
    rows = violations.limit(5).collect()
    if rows:
        raise ValueError(f"{what}: " + "; ".join(str(r.asDict()) for r in rows))
