"""Published datasets, prediction tables and run results on any Hadoop file system.

Tables become visible through one small file. A dataset folder ``<root>/<version>`` holds the tables
of every writer in a ``data-*`` folder of its own; the marker names the one that counts. The marker is
created without overwriting, so of several writers exactly one wins and the others return what it
published. Tables that change are kept as versions beside a pointer file, which is replaced in one
step: a reader gets the old table or the new one.
"""

from __future__ import annotations

import hashlib
import json
import re
import time
import uuid
from dataclasses import asdict, dataclass

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from depthframe.operators import baselines, validation
from depthframe.operators.samples import PART, with_part
from depthframe.operators.sessions import choose_slicing
from depthframe.schema import (
    FOLD_INDEX_SCHEMA,
    KEY,
    PLAN_SCHEMA,
    PREDICTION_SCHEMA,
    QUALITY_SCHEMA,
    ROWS_SCHEMA,
)

FORMAT = 3
MARKER = "_SUCCESS"
POINTER = "_CURRENT"
#: Seconds to wait for another writer that has created a marker and not yet filled it.
PATIENCE = 30
RECORD = "record.json"
LAYOUT = "layout.json"
#: Rows of a bucket if there are more buckets than cores, and the most buckets that Spark allows by default.
BUCKET_ROWS, MAX_BUCKETS = 4_000_000, 100_000


def digest(value) -> str:
    """SHA-256 of plain values, whatever the order of keys in mappings."""
    return hashlib.sha256(json.dumps(value, sort_keys=True, allow_nan=False).encode()).hexdigest()


@dataclass(frozen=True)
class Record:
    """What a published dataset is made of. ``version``, derived from all of it, names its folder.

    ``source`` and ``plan`` are fingerprints of the raw rows and of the fold plan; ``settings``
    holds every build and scaling setting as plain values, so a reader can rebuild the dataset.
    """

    source: str
    plan: str
    settings: dict
    tickers: list[str]
    features: list[str]
    target: str
    history: int
    format: int = FORMAT

    @property
    def version(self) -> str:
        return digest(asdict(self))

    def problems(self) -> list[str]:
        found = []
        if self.format != FORMAT:
            found.append(f"format {self.format} is not {FORMAT}")
        for name in ("tickers", "features"):
            values = getattr(self, name)
            if not values or len(set(values)) < len(values) or not all(str(v).strip() for v in values):
                found.append(f"{name} must be distinct and not blank")
        if not (self.source and self.plan and self.target):
            found.append("source, plan and target must be known")
        if self.history < 1:
            found.append("a sample needs at least one row")
        return found

    def to_json(self) -> str:
        return json.dumps(asdict(self), sort_keys=True)

    @classmethod
    def from_json(cls, text: str) -> Record:
        try:
            record = cls(**json.loads(text))
        except TypeError as odd:
            raise ValueError(f"not a dataset record: {odd}") from odd
        if record.problems():
            raise ValueError("; ".join(record.problems()))
        return record


@dataclass(frozen=True)
class Package:
    """A dataset; its tables lie in ``data``, a folder below ``root`` or ``root`` itself."""

    spark: SparkSession
    root: str
    record: Record
    data: str

    def rows(self) -> DataFrame:
        """All rows; in buckets with their part, so that windows over them need no exchange."""
        return read_rows(self.spark, self.data)

    def quality(self) -> DataFrame:
        return self.spark.read.schema(QUALITY_SCHEMA).parquet(f"{self.data}/quality")

    def folds(self) -> DataFrame:
        return self.spark.read.schema(FOLD_INDEX_SCHEMA).parquet(f"{self.data}/folds")

    def plan(self) -> DataFrame:
        """The stored fold plan, with dates that have no anchor too."""
        return self.spark.read.schema(PLAN_SCHEMA).parquet(f"{self.data}/plan")

    def fold(self, fold_index: int, split: str) -> DataFrame:
        """One partition of the fold index; empty is an error."""
        out = self.folds().filter((F.col("fold_index") == fold_index) & (F.col("split") == split))
        if out.isEmpty():
            raise ValueError(f"no anchors in fold {fold_index} {split}")
        return out

    def checks(self) -> DataFrame:
        rows, folds = self.rows().drop(PART), self.folds()
        slicing = choose_slicing(rows)
        return validation.report(
            [
                validation.row_checks(rows, len(self.record.features)),
                validation.quality_checks(self.quality(), rows),
                validation.fold_checks(folds, rows, self.record.history, slicing),
            ]
        )


class Files:
    """The few file-system calls publishing needs, through Hadoop so that any store works."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self._jvm, self._gateway = spark._jvm, spark.sparkContext._gateway
        conf = spark._jsc.hadoopConfiguration()
        self._fs = self.path(root).getFileSystem(conf)
        self._context = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(
            self._fs.makeQualified(self.path(root)).toUri(), conf
        )

    def path(self, p: str):
        return self._jvm.org.apache.hadoop.fs.Path(p)

    def full(self, p: str) -> str:
        """With scheme and all folders: a table's relative location would start at the warehouse."""
        return self._fs.makeQualified(self.path(p)).toString()

    def exists(self, p: str) -> bool:
        return self._fs.exists(self.path(p))

    def rename(self, old: str, new: str) -> None:
        if not self._fs.rename(self.path(old), self.path(new)):
            raise OSError(f"cannot rename {old} to {new}")

    def delete(self, p: str) -> None:
        self._fs.delete(self.path(p), True)

    def make_folder(self, p: str) -> None:
        self._fs.mkdirs(self.path(p))

    def folders(self, p: str) -> list[tuple[str, int]]:
        """(name, time of change) of the folders in ``p``."""
        found = self._fs.listStatus(self.path(p))
        return [(f.getPath().getName(), f.getModificationTime()) for f in found if f.isDirectory()]

    def claim_text(self, p: str, text: str) -> bool:
        """Create a file if there is none; of several writers one gets true."""
        try:
            out = self._fs.create(self.path(p), False)
        except Py4JJavaError as failed:
            if self.exists(p):
                return False
            raise OSError(f"cannot create {p}") from failed
        out.write(bytearray(text.encode()))
        out.close()
        return True

    def replace_text(self, p: str, text: str) -> None:
        """Replace a small file in one step: written beside it and renamed over it."""
        folder, name = p.rsplit("/", 1)
        fresh = f"{folder}/.{name}-{uuid.uuid4().hex}"
        self.write_text(fresh, text)
        how = self._gateway.new_array(self._jvm.org.apache.hadoop.fs.Options.Rename, 1)
        how[0] = self._jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
        self._context.rename(self._fs.makeQualified(self.path(fresh)), self._fs.makeQualified(self.path(p)), how)

    def write_text(self, p: str, text: str) -> None:
        out = self._fs.create(self.path(p), True)
        out.write(bytearray(text.encode()))
        out.close()

    def read_text(self, p: str) -> str:
        stream = self._fs.open(self.path(p))
        text = self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        stream.close()
        return text


def staging_path(root: str) -> str:
    return f"{root}/.staging-{uuid.uuid4().hex}"


def bucket_count(timeline: DataFrame) -> int:
    """Buckets for the rows of a stored timeline; 0 if one session is more than a bucket should hold.

    Counted per session from the keys alone, combined before the exchange.
    """
    sizes = timeline.groupBy(*KEY).agg(F.count(F.lit(1)).alias("n"))
    total, largest = sizes.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.max("n"), F.lit(0))).first()
    if largest > BUCKET_ROWS:
        return 0
    cores = timeline.sparkSession.sparkContext.defaultParallelism
    return min(MAX_BUCKETS, max(-(-total // BUCKET_ROWS), cores))


def write_rows(rows: DataFrame, data: str, buckets: int) -> None:
    """The table ``rows`` below ``data``, and a small file that names its layout.

    With ``buckets``, rows lie by instrument and part (a bounded run of whole sessions), one file
    a bucket, sorted by time within: whatever groups by instrument and part reads it without an
    exchange, and row groups hold few dates. Without, for sessions too large for one task, there is a
    folder per trade date; rebalancing splits a heavy date over files and merges light ones.
    """
    spark, path = rows.sparkSession, Files(rows.sparkSession, data).full(f"{data}/rows")
    order = ["ticker", "trade_date", "session_id", "row_no"]
    if buckets:
        name = f"rows_{uuid.uuid4().hex}"
        placed = with_part(rows).repartition(buckets, "ticker", PART)
        writer = placed.write.format("parquet").bucketBy(buckets, "ticker", PART).sortBy(*order)
        try:
            writer.option("path", path).saveAsTable(name)
        finally:
            spark.sql(f"DROP TABLE IF EXISTS {name}")  # an external table: its files stay
    else:
        rows.hint("rebalance", "trade_date").sortWithinPartitions("trade_date", *order).write.partitionBy(
            "trade_date"
        ).parquet(path)
    Files(spark, data).write_text(f"{data}/{LAYOUT}", json.dumps({"buckets": buckets}))


def _buckets(spark: SparkSession, data: str) -> int:
    """Buckets of the stored rows; 0 for folders by date, as are all tables without a layout file."""
    files = Files(spark, data)
    return json.loads(files.read_text(f"{data}/{LAYOUT}"))["buckets"] if files.exists(f"{data}/{LAYOUT}") else 0


def read_rows(spark: SparkSession, data: str) -> DataFrame:
    """Rows that :func:`write_rows` stored. A path says nothing of buckets, so a name stands for it while it is opened."""
    buckets = _buckets(spark, data)
    if not buckets:
        return spark.read.schema(ROWS_SCHEMA).parquet(f"{data}/rows")
    name = f"rows_{uuid.uuid4().hex}"
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in ROWS_SCHEMA)
    place = Files(spark, data).full(f"{data}/rows").replace("\\", "\\\\").replace("'", "\\'")
    spark.sql(
        f"CREATE TABLE {name} ({columns}, {PART} bigint) USING parquet"
        f" CLUSTERED BY (ticker, {PART}) INTO {buckets} BUCKETS LOCATION '{place}'"
    )
    try:
        return spark.table(name)
    finally:
        spark.sql(f"DROP TABLE {name}")


def write_folds(folds: DataFrame, path: str) -> None:
    """All folds and splits in one job."""
    folds.hint("rebalance", "fold_index", "split").write.partitionBy("fold_index", "split").parquet(path)


def publish(spark: SparkSession, staged: str, output_root: str, record: Record) -> Package:
    """Check the staged tables, then make them visible; a dataset published meanwhile is returned instead.

    The tables move to a folder that only this writer uses. Creating the marker, which names that
    folder, publishes them. The writer that finds a marker deletes its tables and audits and returns
    those of the winner.
    """
    if record.problems():
        raise ValueError("; ".join(record.problems()))
    files, final = Files(spark, output_root), f"{output_root}/{record.version}"
    files.write_text(f"{staged}/{RECORD}", record.to_json())
    package = Package(spark, final, record, staged)
    for name, table in (("rows", package.rows().drop(PART)), ("quality", package.quality()), ("folds", package.folds())):
        validation.check_schema(table, validation.SCHEMAS[name], name)
    validation.raise_if_broken(package.checks(), "dataset")
    files.make_folder(final)
    name = f"data-{uuid.uuid4().hex}"
    files.rename(staged, f"{final}/{name}")
    if files.claim_text(f"{final}/{MARKER}", name):
        return Package(spark, final, record, f"{final}/{name}")
    files.delete(f"{final}/{name}")
    return audited_package(spark, final)


def _published_folder(files: Files, root: str) -> str:
    """The folder that the marker names."""
    if not files.exists(f"{root}/{MARKER}"):
        raise ValueError(f"not a published dataset: {root}")
    for left in range(PATIENCE, -1, -1):
        name = files.read_text(f"{root}/{MARKER}")
        if name:
            return f"{root}/{name}"
        if files.exists(f"{root}/{RECORD}"):
            return root  # tables beside the marker, as written before
        time.sleep(1 if left else 0)
    raise ValueError(f"the marker of {root} names no folder: its writer stopped; delete the marker")


def find_package(spark: SparkSession, root: str) -> Package:
    """A published dataset by its marker and record; its tables are not read."""
    files, root = Files(spark, root), root.rstrip("/")
    data = _published_folder(files, root)
    record = Record.from_json(files.read_text(f"{data}/{RECORD}"))
    if root.rsplit("/", 1)[-1] != record.version:
        raise ValueError(f"{root} does not hold version {record.version}")
    return Package(spark, root, record, data)


def audited_package(spark: SparkSession, root: str) -> Package:
    """A published dataset whose stored column types and rows were checked again."""
    package = find_package(spark, root)
    added = [PART] if _buckets(spark, package.data) else ["trade_date"]
    partitioned = {"rows": added, "folds": ["fold_index", "split"], "quality": []}
    for name, folder_columns in partitioned.items():
        # The declared schema would hide a drift, so the files' own is read.
        stored = spark.read.parquet(f"{package.data}/{name}").drop(*folder_columns)
        validation.check_schema(stored, [f for f in validation.SCHEMAS[name] if f.name not in folder_columns], name)
    validation.raise_if_broken(package.checks(), "dataset")
    return package


def replace_table(df: DataFrame, path: str, *partitions: str) -> None:
    """Write a new version of a table, then point to it in one step.

    The version before stays for readers that have opened it; older ones are deleted.
    """
    files, name = Files(df.sparkSession, path), f"data-{uuid.uuid4().hex}"
    before = files.read_text(f"{path}/{POINTER}") if files.exists(f"{path}/{POINTER}") else None
    writer = df.write
    (writer.partitionBy(*partitions) if partitions else writer).parquet(f"{path}/{name}")
    files.replace_text(f"{path}/{POINTER}", name)
    # Versions newer than the one before may belong to writers that have not pointed to them yet.
    times = dict(files.folders(path))
    for other, changed in times.items():
        if other not in (name, before) and changed < times.get(before, 0):
            files.delete(f"{path}/{other}")


def current_table(spark: SparkSession, path: str) -> str:
    """The folder of the version that counts."""
    files = Files(spark, path)
    if not files.exists(f"{path}/{POINTER}"):
        raise ValueError(f"no table at {path}")
    return f"{path}/{files.read_text(f'{path}/{POINTER}')}"


def write_predictions(predictions: DataFrame, path: str) -> None:
    validation.check_schema(predictions, PREDICTION_SCHEMA, "predictions")
    replace_table(
        predictions.hint("rebalance", "model_name", "fold_index"), path, "model_name", "fold_index"
    )


def read_predictions(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(PREDICTION_SCHEMA).parquet(current_table(spark, path))


def _component(value: str, name: str) -> str:
    if not re.fullmatch(r"[^/\\\x00]+", value or "") or value.strip() in ("", ".", ".."):
        raise ValueError(f"{name} must be one non-empty path component")
    return value


def log_run(spark: SparkSession, root: str, experiment_id: str, header: str, contents: dict) -> None:
    """Record one section of a run; writing a section again replaces only that section, in one step."""
    section = f"{root}/experiment_id={_component(experiment_id, 'experiment_id')}/header={_component(header, 'header')}"
    lines = [json.dumps({"key": k, "value": json.dumps(v, sort_keys=True)}) for k, v in contents.items()]
    files = Files(spark, root)
    files.make_folder(section)
    files.replace_text(f"{section}/section.json", "\n".join(lines))


def read_runs(spark: SparkSession, root: str) -> DataFrame:
    schema = "key string, value string, experiment_id string, header string"
    return spark.read.schema(schema).json(root)


def save_model(candidate, path: str) -> None:
    """Store a fitted baseline: its settings and, per instrument and fold, its parameters."""
    table = candidate.coefficients
    if table is None:
        raise RuntimeError("fit before saving")
    replace_table(table, f"{path}/parameters")
    Files(table.sparkSession, path).replace_text(
        f"{path}/model.json", json.dumps({"name": candidate.name, "settings": candidate.settings()}, sort_keys=True)
    )


def load_model(spark: SparkSession, path: str):
    """A baseline as :func:`save_model` stored it, ready to predict."""
    known = {c.name: c for c in (baselines.ZeroBaseline, baselines.ImbalanceBaseline, baselines.RidgeBaseline)}
    stored = json.loads(Files(spark, path).read_text(f"{path}/model.json"))
    if stored["name"] not in known:
        raise ValueError(f"unknown model {stored['name']!r}")
    candidate = known[stored["name"]](**stored["settings"])
    candidate.coefficients = spark.read.parquet(current_table(spark, f"{path}/parameters"))
    return candidate
