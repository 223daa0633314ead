"""Sessions in chunks of rows, and how often every draw of the bootstrap takes each row.

A draw is a list of blocks that an integer hash gives from (seed, draw, session, block). So each chunk lists the
blocks of its session by itself and keeps what lies in its own rows: nothing but the rows is sent,
and a block across two chunks counts in both with its part.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from depthframe.functions.metrics import P, T
from depthframe.operators.ranks import BEFORE, as_number, cut_points, running_total

#: Blocks [lo, hi) that a draw takes from a session: (seed, draw, session number, rows).
Blocks = Callable[[int, int, int, int], tuple[np.ndarray, np.ndarray]]


def head(rows: DataFrame, columns: list[str]) -> str:
    """The columns as a schema text."""
    return ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in columns)


def session_chunks(rows: DataFrame, session: list[str], sample_order: list[str], chunk_rows: int) -> DataFrame:
    """Add ``_chunk``, ``_start`` and ``_size``: sessions of more than ``chunk_rows`` rows are cut by time.

    ``_start`` is the position of a chunk's first row in its session. Rows are put in order by the
    task that gets the chunk. Whole sessions need neither number, so theirs are null.
    """
    order = [c for c in sample_order if c not in session]
    first = as_number(rows, order[0])
    if first is None:  # no number to cut by
        placed = running_total(rows, session, sample_order, F.lit(1).cast("bigint"), "_pos", whole="_size")
        placed = placed.withColumn("_chunk", F.expr(f"_pos DIV {chunk_rows}"))
        return placed.withColumn("_start", F.col("_chunk") * chunk_rows).drop("_pos")
    cuts = cut_points(rows, session, {"_at": first}, chunk_rows)
    if cuts.table is None:
        none = F.lit(None).cast("bigint")
        return rows.withColumns({"_chunk": F.lit(0), "_start": none, "_size": none})
    placed = cuts.add(rows, first, "_at", "_chunk")
    counts = placed.groupBy(*session, "_chunk").agg(F.count(F.lit(1)).alias("_n"))
    same = Window.partitionBy(*session)
    before = F.sum("_n").over(same.orderBy("_chunk").rowsBetween(*BEFORE))
    starts = counts.withColumns({"_start": F.coalesce(before, F.lit(0)), "_size": F.sum("_n").over(same)})
    keys = [*session, "_chunk"]
    starts = starts.select(*[F.col(k).alias(f"_s{k}") for k in keys], "_start", "_size")
    joined = placed.join(starts, [F.col(k).eqNullSafe(F.col(f"_s{k}")) for k in keys])
    return joined.drop(*[f"_s{k}" for k in keys])


def with_batches(chunks: DataFrame, draws: int, per_task: int) -> DataFrame:
    """Every chunk once per batch of ``per_task`` draws, by the batch's first draw ``_first``."""
    firsts = F.array(*[F.lit(d) for d in range(0, draws, per_task)])
    return chunks.withColumn("_first", F.explode(firsts))


def in_order(table: pa.Table, sample_order: list[str]) -> pa.Table:
    return table.sort_by([(c, "ascending") for c in sample_order])


def vectors(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    def get(name):
        return table[name].cast(pa.float64()).fill_null(float("nan")).to_numpy()

    return get(P), get(T)


def chunk_blocks(table: pa.Table, draw: int, blocks: Blocks) -> tuple[np.ndarray, np.ndarray]:
    """The draw's blocks within an ordered chunk, by row of the chunk."""
    n, first, size = len(table), table["_start"][0].as_py(), table["_size"][0].as_py()
    if first is None:
        first, size = 0, n
    lo, hi = blocks(table["_seed"][0].as_py(), draw, table["_session"][0].as_py(), size)
    lo, hi = np.maximum(lo - first, 0), np.minimum(hi - first, n)
    return lo[lo < hi], hi[lo < hi]


def drawn_weights(table: pa.Table, draws: range, blocks: Blocks) -> np.ndarray:
    """How often each draw takes each row of an ordered chunk: one line per draw."""
    n = len(table)
    out = np.empty((len(draws), n), np.int32)
    for line, draw in zip(out, draws):
        lo, hi = chunk_blocks(table, draw, blocks)
        edges = np.bincount(lo, minlength=n + 1) - np.bincount(hi, minlength=n + 1)
        np.cumsum(edges[:-1], out=line)
    return out


def stream_groups(rows: DataFrame, keys: list[str], task: Callable, schema: str) -> DataFrame:
    """``task`` gets a group's record batches and yields those of its result one by one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from task(batches)

    return rows.groupBy(*keys).applyInArrow(run, schema)


def arrow_fields(rows: DataFrame, columns: list[str]) -> list[tuple[str, pa.DataType]]:
    kinds = {"bigint": pa.int64(), "int": pa.int32(), "double": pa.float64()}
    return [(c, kinds.get(rows.schema[c].dataType.simpleString(), pa.string())) for c in columns]


def part_numbers(values: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    """The parts that ``Cuts.add`` gives: even for a range of values, odd for a single frequent value."""
    below = np.searchsorted(cuts, values, "left")
    return 2 * below + (np.searchsorted(cuts, values, "right") - below >= 2)
