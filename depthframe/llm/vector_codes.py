"""Product-quantisation codes of vectors, with LAESA pivots in the search for the nearest entry.

A vector of integers ``floor(1024 * x)`` is cut into four parts; each part position has a codebook
of up to 256 entries, trained by rounds of assignment and averaging. Distances from every part to a
few fixed pivots are computed once and stored with the part. In a round the distances from the
entries to the pivots are known too, and ``|d(part, pivot) - d(entry, pivot)|`` cannot exceed
``d(part, entry)``. Entries are taken by rising lower bound and evaluated exactly, in integers,
until the next bound exceeds the best distance found.

The vectors are one stored table which every round reads; a task returns sums of at most 256
entries a part, which Spark adds up. The driver sees only the codebooks (256 vectors in all).
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from depthframe.llm.common import stored, table, with_groups

PARTS, ENTRIES, ROUNDS, PIVOTS = 4, 256, 4, 8
SCALE = 1024
#: Integer components are held within +-2**24 (|x| < 16384), so that squared distances fit in 64 bits.
LARGEST = 1 << 24
#: Entries evaluated at a time, and bytes of differences held at a time.
STEP, HELD = 8, 1 << 24
#: Relative error allowed for in bounds; single precision has 2**-24 an operation.
SLACK = 2.0**-21


def integers(vector: Column) -> Column:
    """Components times 1024, rounded down."""
    scaled = F.transform(vector, lambda x: F.floor(x.cast("double") * SCALE))
    return F.transform(
        scaled, lambda x: F.greatest(F.least(x, F.lit(LARGEST)), F.lit(-LARGEST)).cast("int")
    )


def sound(vector: Column) -> Column:
    """The vector is there and all its components are finite numbers."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) == float("inf")))
    return vector.isNotNull() & ~bad


def _square(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    gap = a[:, None, :] - b[None, :, :]
    return np.einsum("aew,aew->ae", gap, gap)


def pivots_of(entries: np.ndarray, number: int) -> np.ndarray:
    """Pivots among the entries: the first one, then always the one farthest from those chosen."""
    chosen, away = [0], _square(entries, entries[:1])[:, 0]
    while len(chosen) < min(number, len(entries)):
        chosen.append(int(away.argmax()))
        away = np.minimum(away, _square(entries, entries[chosen[-1:]])[:, 0])
    return entries[chosen]


def pivot_distances(parts: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    rows = max(1, HELD // (8 * pivots.size))
    cuts = [np.sqrt(_square(parts[i : i + rows], pivots)) for i in range(0, len(parts), rows)]
    return np.concatenate(cuts).astype(np.float32) if cuts else np.zeros((0, len(pivots)), np.float32)


def nearest(parts: np.ndarray, to_pivots: np.ndarray, entries: np.ndarray, pivots: np.ndarray):
    """(index, squared distance, evaluations) of each part's nearest entry; ties go to the lower index."""
    from_entries = pivot_distances(entries, pivots)
    index, best, evaluated = np.zeros(len(parts), np.int64), np.zeros(len(parts), np.int64), 0
    rows = max(1, min(HELD // (4 * len(entries)), HELD // (8 * STEP * max(1, parts.shape[1]))))
    for at in range(0, len(parts), rows):
        x, far = parts[at : at + rows], to_pivots[at : at + rows]
        low = np.zeros((len(x), len(entries)), np.float32)
        for p in range(len(pivots)):
            np.maximum(low, np.abs(far[:, p, None] - from_entries[None, :, p]), out=low)
        low -= np.float32(SLACK) * (far.max(1)[:, None] + from_entries.max())
        np.maximum(low, 0, out=low)
        order = np.argsort(low, axis=1)
        low = np.take_along_axis(low, order, 1)
        i_best = np.full(len(x), len(entries), np.int64)
        d_best = np.full(len(x), np.iinfo(np.int64).max, np.int64)
        open_ = np.arange(len(x))
        for k in range(0, len(entries), STEP):
            names = order[open_, k : k + STEP]
            gap = x[open_, None, :] - entries[names]
            d = np.einsum("nkw,nkw->nk", gap, gap)
            evaluated += d.size
            least = d.min(1)
            name = np.where(d == least[:, None], names, len(entries)).min(1)
            now, held = d_best[open_], i_best[open_]
            better = (least < now) | ((least == now) & (name < held))
            i_best[open_] = np.where(better, name, held)
            d_best[open_] = np.minimum(least, now)
            if k + STEP < len(entries):
                bound = low[open_, k + STEP].astype(np.float64) ** 2
                open_ = open_[bound <= d_best[open_]]
            if not len(open_):
                break
        index[at : at + rows], best[at : at + rows] = i_best, d_best
    return index, best, evaluated


def _cut(column: pa.Array, width: int) -> np.ndarray:
    """[part, row, component] of a batch's vectors."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    return flat.reshape(len(column), PARTS, width).transpose(1, 0, 2)


def _far(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), PARTS, -1).transpose(1, 0, 2)


def with_pivot_distances(rows: DataFrame, pivots: list[np.ndarray], width: int) -> DataFrame:
    def run(batches):
        for batch in batches:
            far = [pivot_distances(x, p) for x, p in zip(_cut(batch["v"], width), pivots)]
            flat = np.concatenate(far, axis=1).ravel()
            size = PARTS * len(pivots[0])
            offsets = np.arange(batch.num_rows + 1, dtype=np.int32) * size
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))],
                [*batch.schema.names, "far"],
            )

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema)
    return rows.mapInArrow(run, f"{kinds}, far array<float>")


def entry_sums(rows: DataFrame, books: list[np.ndarray], pivots: list[np.ndarray]) -> DataFrame:
    """(part, entry, pos, total) over the parts assigned to each entry; position 0 holds their count."""
    width = books[0].shape[1]

    def run(batches):
        sums = np.zeros((PARTS, len(books[0]), width + 1), np.int64)
        for batch in batches:
            for part, (x, far) in enumerate(zip(_cut(batch["v"], width), _far(batch["far"]))):
                index = nearest(x, far, books[part], pivots[part])[0]
                np.add.at(sums[part, :, 1:], index, x)
                sums[part, :, 0] += np.bincount(index, minlength=len(books[part]))
        part, entry = np.nonzero(sums[:, :, 0])
        rows = pa.array(list(sums[part, entry]), pa.list_(pa.int64()))
        yield pa.RecordBatch.from_arrays(
            [pa.array(part, pa.int32()), pa.array(entry, pa.int32()), rows], ["part", "entry", "s"]
        )

    some = rows.select("v", "far").mapInArrow(run, "part int, entry int, s array<bigint>")
    cells = some.select("part", "entry", F.posexplode("s").alias("pos", "x"))
    return cells.groupBy("part", "entry", "pos").agg(F.sum("x").alias("total"))


def replaced(books: list[np.ndarray], sums: list) -> list[np.ndarray]:
    """The codebooks with every used entry replaced by the mean of its parts, rounded down."""
    total = np.zeros((PARTS, len(books[0]), books[0].shape[1] + 1), np.int64)
    for r in sums:
        total[r["part"], r["entry"], r["pos"]] = r["total"]
    used = total[:, :, 0] > 0
    return [
        np.where(used[p, :, None], total[p, :, 1:] // np.maximum(total[p, :, :1], 1), books[p]) for p in range(PARTS)
    ]


def assigned(rows: DataFrame, books: list[np.ndarray], pivots: list[np.ndarray]) -> DataFrame:
    """id, label, ``code`` and ``error`` of every row."""
    width = books[0].shape[1]

    def run(batches):
        for batch in batches:
            codes = np.zeros((batch.num_rows, PARTS), np.uint8)
            error = np.zeros(batch.num_rows, np.int64)
            for part, (x, far) in enumerate(zip(_cut(batch["v"], width), _far(batch["far"]))):
                index, away, _ = nearest(x, far, books[part], pivots[part])
                codes[:, part] = index
                error += away
            code = pa.array([row.tobytes().hex() for row in codes], pa.string())
            yield pa.RecordBatch.from_arrays(
                [batch["id"], batch["label"], code, pa.array(error)], ["id", "label", "code", "error"]
            )

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema if f.name in ("id", "label"))
    return rows.mapInArrow(run, f"{kinds}, code string, error bigint")


def books_hash(books: list[np.ndarray]) -> str:
    text = ",".join(str(int(x)) for book in books for x in book.ravel())
    return hashlib.sha256(text.encode()).hexdigest()


def vector_codes(
    vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label",
    rounds: int = ROUNDS, pivots: int = PIVOTS,
) -> DataFrame:
    """One row per sound vector: id, ``code``, ``error``, ``label_error``, ``codebooks_sha256``.

    Vectors that are null or hold a null, NaN or infinite component are left out; an empty vector
    counts as zeros. If lengths differ, or are no multiple of four, vectors are filled up with
    zeros to the next multiple of the longest, which adds nothing to a distance. Components are
    held within +-16384. The first codebooks are the rows with the smallest ids (null ids last,
    equal ids by their components); fewer rows make smaller codebooks. Repeated rows count each.
    Null labels are one label. Other columns are ignored; an empty table gives an empty result.
    """
    rows = vectors.select(
        vectors[id_col].alias("id"), vectors[label_col].alias("label"), vectors[vector_col].alias("x")
    ).filter(sound(F.col("x")))
    rows = rows.select("id", "label", integers(F.col("x")).alias("v"))
    longest = rows.agg(F.max(F.size("v"))).first()[0]
    width = max(1, -(-(longest or 0) // PARTS))
    rows = rows.withColumn("v", F.concat("v", F.array_repeat(F.lit(0), F.lit(PARTS * width) - F.size("v"))))
    start = rows.orderBy(F.col("id").asc_nulls_last(), "v").limit(ENTRIES).select("v").collect()
    whole = np.array([r["v"] for r in start], np.int64).reshape(len(start), PARTS, width)
    books = [whole[:, p] for p in range(PARTS)]
    if len(start):
        fixed = [pivots_of(b, pivots) for b in books]
        rows = stored(with_pivot_distances(rows, fixed, width))
        for _ in range(rounds):
            books = replaced(books, entry_sums(rows, books, fixed).collect())
        done = stored(assigned(rows, books, fixed))
    else:
        done = stored(rows.select("id", "label", F.lit("").alias("code"), F.lit(0).cast("bigint").alias("error")))
    totals = stored(
        done.groupBy("label").agg(F.sum("error").alias("label_error"), F.count(F.lit(1)).alias("size"))
    )
    joined = with_groups(done, totals, "label", "size", done.count())
    return joined.select(
        F.col("id").alias(id_col), "code", "error", "label_error", F.lit(books_hash(books)).alias("codebooks_sha256")
    )


def op11_vector_codes(spark, sf_dir: str) -> DataFrame:
    return vector_codes(table(spark, sf_dir, "embeddings"))


def _round_sql(r: int) -> str:
    return f"""
near{r} AS MATERIALIZED (
    SELECT n, part, arg_min(entry, d * {ENTRIES} + entry) AS entry, min(d) AS d
    FROM (SELECT x.n, x.part, b.entry, sum((x.v - b.v) * (x.v - b.v)) AS d
          FROM parts x JOIN book{r} b ON x.part = b.part AND x.pos = b.pos GROUP BY ALL)
    GROUP BY n, part
),
book{r + 1} AS MATERIALIZED (
    SELECT b.part, b.entry, b.pos, coalesce(m.v, b.v) AS v
    FROM book{r} b LEFT JOIN (
        SELECT x.part, a.entry, x.pos, CAST(sum(x.v) AS BIGINT) AS s, count(*) AS c,
               (CAST(sum(x.v) AS BIGINT) - ((CAST(sum(x.v) AS BIGINT) % count(*)) + count(*)) % count(*)) // count(*) AS v
        FROM parts x JOIN near{r} a ON x.n = a.n AND x.part = a.part GROUP BY ALL
    ) m ON b.part = m.part AND b.entry = m.entry AND b.pos = m.pos
),"""


SQL = f"""
WITH kept AS MATERIALIZED (
    SELECT row_number() OVER (ORDER BY vec_id) - 1 AS n, vec_id, label,
           list_transform(embedding, lambda x: CAST(floor(CAST(x AS DOUBLE) * {SCALE}) AS BIGINT)) AS v
    FROM embeddings
    WHERE embedding IS NOT NULL
      AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
),
parts AS MATERIALIZED (
    SELECT n, (p * {PARTS}) // len(v) AS part, p % (len(v) // {PARTS}) AS pos, v[p + 1] AS v
    FROM (SELECT n, v, unnest(range(len(v))) AS p FROM kept)
),
book0 AS (SELECT part, n AS entry, pos, v FROM parts WHERE n < {ENTRIES}),{"".join(_round_sql(r) for r in range(ROUNDS + 1))}
coded AS (
    SELECT vec_id, label, string_agg(lower(printf('%02x', a.entry)), '' ORDER BY part) AS code,
           CAST(sum(d) AS BIGINT) AS error
    FROM near{ROUNDS} a JOIN kept k ON k.n = a.n GROUP BY k.n, vec_id, label
),
hashed AS (SELECT sha256(string_agg(CAST(v AS VARCHAR), ',' ORDER BY part, entry, pos)) AS h FROM book{ROUNDS})
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
       h AS codebooks_sha256
FROM coded, hashed
"""
