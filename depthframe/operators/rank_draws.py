"""Rank correlation of every draw, with sessions and groups of any size.

As in ``ranks.rank_correlation``, a row gets its rank inside its part of x, then inside its part of y, and
sums per (part of x, part of y) are enough to add what the parts before contribute; here a
row has one weight and one rank per draw. Rows travel packed: a chunk, then a part of x, sends
each part one block. Ranks are doubled and centred on their part, so they are whole numbers.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from depthframe.functions.metrics import P, T, finite_pair
from depthframe.operators import ranked
from depthframe.operators.chunks import (
    Blocks,
    arrow_fields,
    drawn_weights,
    head,
    in_order,
    part_numbers,
    stream_groups,
    vectors,
    with_batches,
)
from depthframe.operators.ranks import SALTS, cut_points

#: Rows of a block.
BLOCK_ROWS = 20_000
SUMS = ["_n", "_a", "_b", "_aa", "_bb", "_ab"]


def _pieces(parts: np.ndarray):
    """(part, rows) of each block."""
    for value in np.unique(parts):
        here = np.flatnonzero(parts == value)
        for at in range(0, len(here), BLOCK_ROWS):
            yield int(value), here[at : at + BLOCK_ROWS]


def _salt(part: int, by: int) -> int:
    """The rows of a single frequent value share one rank, so they may lie in many tasks."""
    return 1 + by % SALTS if part % 2 else 0


def _bytes_of(times: np.ndarray) -> int:
    return next(b for b in (1, 2, 4) if times.max(initial=0) < 256**b)


def local_ranks(values: np.ndarray, times: np.ndarray, alone: bool) -> np.ndarray:
    """Twice the tied rank of each row among those of its task, centred, one line per draw."""
    out = np.zeros(times.shape, np.int32)
    if not alone:
        code = np.unique(values, return_inverse=True)[1]
        for line, w in zip(out, times):
            tie = np.bincount(code, w)
            line[:] = (2 * np.cumsum(tie) - tie - tie.sum())[code]
    return out


def rank_draws(
    rows: DataFrame,
    chunked: Callable[[DataFrame], DataFrame],
    *,
    draws: int,
    per_task: int,
    group: list[str],
    session: list[str],
    sample_order: list[str],
    blocks: Blocks,
) -> DataFrame:
    """``(group, draw, value)``; null if a side is constant. Draws without a valid row are left out.

    ``rows`` hold ``_seed`` and ``_session``; ``chunked`` cuts them by ``session_chunks``.
    """
    pairs = rows.filter(finite_pair()).select(*group, F.col(P).cast("double").alias("_x"), F.col(T).cast("double").alias("_y"))
    cuts = cut_points(pairs, group, {"_x": F.col("_x"), "_y": F.col("_y")}, ranked.RANK_ROWS).by_group()
    chunks = with_batches(chunked(rows), draws, per_task)
    names, fields = head(rows, group), arrow_fields(rows, group)

    def lines(first: int) -> range:
        return range(first, min(draws, first + per_task))

    def by_x(batches):
        table = in_order(pa.Table.from_batches(batches), sample_order)
        first, keys = table["_first"][0].as_py(), {g: table[g][0].as_py() for g in group}
        x, y = vectors(table)
        ok = np.isfinite(x) & np.isfinite(y)
        if not ok.any():
            return
        x, y, times = x[ok], y[ok], drawn_weights(table, lines(first), blocks)[:, ok]
        cut = cuts.get(tuple(keys.values()), {"_x": [], "_y": []})
        px, py = (part_numbers(v, np.array(cut[c], float)) for v, c in ((x, "_x"), (y, "_y")))
        by, size = table["_session"][0].as_py() + table["_chunk"][0].as_py(), _bytes_of(times)
        for part, here in _pieces(px):
            row = {"_px": part, "_salt": _salt(part, by), "_first": first, "_x": x[here].tobytes(), "_y": y[here].tobytes(),
                   "_py": py[here].astype(np.int32).tobytes(), "_times": times[:, here].astype(f"u{size}").tobytes(), "_bytes": size}
            yield pa.RecordBatch.from_pylist([keys | row], sent_x)

    def by_y(batches):
        rows = [r for b in batches for r in b.to_pylist()]
        keys, first, px = {g: rows[0][g] for g in group}, rows[0]["_first"], rows[0]["_px"]
        x, y = (np.concatenate([np.frombuffer(r[c], float) for r in rows]) for c in ("_x", "_y"))
        py = np.concatenate([np.frombuffer(r["_py"], np.int32) for r in rows])
        times = unpacked(rows, first)
        ranks, size = local_ranks(x, times, px % 2 == 1), _bytes_of(times)
        for part, here in _pieces(py):
            row = {"_px": px, "_py": part, "_salt": _salt(part, px + rows[0]["_salt"]), "_first": first, "_y": y[here].tobytes(),
                   "_times": times[:, here].astype(f"u{size}").tobytes(), "_bytes": size, "_ranks": ranks[:, here].tobytes()}
            yield pa.RecordBatch.from_pylist([keys | row], sent_y)

    def unpacked(rows: list[dict], first: int) -> np.ndarray:
        return np.concatenate([np.frombuffer(r["_times"], f"u{r['_bytes']}").reshape(len(lines(first)), -1) for r in rows], axis=1)

    def summed(batches):
        rows = [r for b in batches for r in b.to_pylist()]
        first, py = rows[0]["_first"], rows[0]["_py"]
        y, times = np.concatenate([np.frombuffer(r["_y"], float) for r in rows]), unpacked(rows, first)
        own = local_ranks(y, times, py % 2 == 1)
        ends = np.cumsum([len(r["_y"]) // 8 for r in rows])
        starts, out = np.append(0, ends[:-1]), []
        for k in range(len(times)):
            w, b = times[k].astype(float), own[k].astype(float)
            a = np.concatenate([np.frombuffer(r["_ranks"], np.int32).reshape(len(times), -1)[k] for r in rows]).astype(float)
            out.append([np.add.reduceat(v, starts) for v in (w, w * a, w * b, w * a * a, w * b * b, w * a * b)])
        sums, m = np.array(out), len(times) * len(rows)  # draws x sums x blocks
        data = [pa.array([rows[0][g]] * m, kind) for g, kind in fields]
        data += [pa.array(np.tile([r["_px"] for r in rows], len(times)), pa.int32()), pa.array([py] * m, pa.int32())]
        data += [pa.array(np.repeat(np.array(lines(first)), len(rows)), pa.int64())]
        data += [pa.array(sums[:, j].ravel()) for j in range(len(SUMS))]
        yield pa.RecordBatch.from_arrays(data, names=[*group, "_px", "_py", "draw", *SUMS])

    byte, whole = pa.binary(), pa.int32()
    sent_x = pa.schema([*fields, ("_px", whole), ("_salt", whole), ("_first", whole), ("_x", byte), ("_y", byte), ("_py", byte),
                        ("_times", byte), ("_bytes", whole)])
    sent_y = pa.schema([*fields, ("_px", whole), ("_py", whole), ("_salt", whole), ("_first", whole), ("_y", byte),
                        ("_times", byte), ("_bytes", whole), ("_ranks", byte)])
    in_x = stream_groups(
        chunks, [*session, "_chunk", "_first"], by_x,
        f"{names}, _px int, _salt int, _first int, _x binary, _y binary, _py binary, _times binary, _bytes int",
    )
    in_y = stream_groups(
        in_x, [*group, "_px", "_salt", "_first"], by_y,
        f"{names}, _px int, _py int, _salt int, _first int, _y binary, _times binary, _bytes int, _ranks binary",
    )
    cells = stream_groups(
        in_y, [*group, "_py", "_salt", "_first"], summed,
        f"{names}, _px int, _py int, draw bigint, {', '.join(f'{s} double' for s in SUMS)}",
    )
    return _correlations(cells, group)


def _correlations(cells: DataFrame, group: list[str]) -> DataFrame:
    cells = cells.groupBy(*group, "draw", "_px", "_py").agg(*[F.sum(s).alias(s) for s in SUMS])
    c, same = F.col, Window.partitionBy(*group, "draw")

    def shift(part: str):
        """What to add to the ranks of a part: twice the rows before, and its own and the group's middle."""
        rising = same.orderBy(part)
        before = F.coalesce(F.sum("_n").over(rising.rangeBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
        return 2 * before + F.sum("_n").over(rising.rangeBetween(0, 0)) - F.sum("_n").over(same)

    cells = cells.withColumns({"_ox": shift("_px"), "_oy": shift("_py")})
    n, ox, oy = c("_n"), c("_ox"), c("_oy")
    ab = F.sum(c("_ab") + oy * c("_a") + ox * c("_b") + n * ox * oy)
    aa, bb = F.sum(c("_aa") + 2 * ox * c("_a") + n * ox * ox), F.sum(c("_bb") + 2 * oy * c("_b") + n * oy * oy)
    out = cells.groupBy(*group, "draw").agg(F.sum("_n").alias("_all"), ab.alias("_sab"), aa.alias("_saa"), bb.alias("_sbb"))
    varies = (c("_saa") > 0) & (c("_sbb") > 0)
    value = F.when(varies, c("_sab") / (F.sqrt(c("_saa")) * F.sqrt(c("_sbb"))))
    return out.filter("_all > 0").select(*group, "draw", value.alias("value"))
