"""Best-fit packing with conflicts: no bin holds two pieces of one source or one duplicate cluster.

Long documents are cut into pieces of ``capacity``; full pieces need no search and fill a bin
alone. Every document leaves at most one shorter piece. Texts are measured once, into a stored
table that numbers its rows. Short pieces are dealt by a hash of that number to shards of about
``SHARD_ROWS``, so that no id, source or cluster, however often repeated, fills a shard, and packed
there, longest first: bins are kept ordered by residual and
carry one bitmap of sources and one of clusters, and the search goes from the tightest bin that
is large enough to the next until both bitmaps agree. Shards keep the work of one task bounded
whatever the size of a source or cluster; each shard leaves a few open bins, no piece is lost.
"""

from __future__ import annotations

from bisect import bisect_left, insort

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from depthframe.llm.common import normal_text, stored, table

CAPACITY = 2048
SHARD_ROWS = 4096


def best_fit(sizes: list[int], sources: list[int], clusters: list[int], capacity: int) -> list[int]:
    """Bin of each piece, in the given order. Negative sources and clusters conflict with nothing.

    A piece equal to the one before starts where that one's search ended: all bins passed by then
    still conflict, and so does the bin that took it.
    """
    last, passed = None, (0, 0)
    open_bins: list[tuple[int, int]] = []
    source_map: list[int] = []
    cluster_map: list[int] = []
    out = []
    for size, source, cluster in zip(sizes, sources, clusters):
        own_source = 1 << source if source >= 0 else 0
        own_cluster = 1 << cluster if cluster >= 0 else 0
        same = (size, source, cluster) == last and (own_source or own_cluster)
        at = bisect_left(open_bins, passed if same else (size, -1))
        while at < len(open_bins):
            b = open_bins[at][1]
            if not (source_map[b] & own_source or cluster_map[b] & own_cluster):
                break
            at += 1
        if at < len(open_bins):
            residual, b = passed = open_bins.pop(at)
        else:
            residual, b = capacity, len(source_map)
            passed = (capacity, b)
            source_map.append(0)
            cluster_map.append(0)
        source_map[b] |= own_source
        cluster_map[b] |= own_cluster
        if residual > size:
            insort(open_bins, (residual - size, b))
        last = size, source, cluster
        out.append(b)
    return out


def _codes(values: pa.ChunkedArray) -> list[int]:
    indices = values.combine_chunks().dictionary_encode().indices
    return indices.fill_null(-1).to_pylist()


def word_count(text: Column) -> Column:
    clean = F.trim(normal_text(text))
    return F.when(clean == "", 0).otherwise(F.length(clean) - F.length(F.replace(clean, F.lit(" "))) + 1)


def text_cluster(text: Column) -> Column:
    """Exact copies (after white space) share this value; texts without words have none."""
    clean = normal_text(text)
    return F.when(F.trim(clean) != "", F.xxhash64(clean))


def pack(
    docs: DataFrame,
    size: Column,
    source: Column,
    cluster: Column,
    capacity: int = CAPACITY,
    id_col: str = "doc_id",
) -> DataFrame:
    """One row per piece: id, ``piece``, ``start``, ``length``, ``bin``.

    ``size`` counts units (null and negative count as 0), ``source`` and ``cluster`` may be null,
    which conflicts with nothing. A document of size 0 gives one row of length 0 without bin.
    Bins of short pieces are named by shard, those of full pieces by document and row, so repeated
    rows get bins of their own. Order within a shard: length descending, id, cluster, source.
    """
    rows = docs.select(
        F.col(f"`{id_col}`").alias("id"),
        F.greatest(F.coalesce(size.cast("bigint"), F.lit(0)), F.lit(0)).alias("size"),
        source.cast("string").alias("source"),
        cluster.cast("string").alias("cluster"),
        F.monotonically_increasing_id().alias("rid"),
    )
    rows = stored(rows)
    shards = max(1, -(-rows.count() // SHARD_ROWS))
    pieces = F.expr(f"sequence(0L, greatest(0L, (size - 1) DIV {capacity}))")
    cut = rows.withColumn("piece", F.explode(pieces)).select(
        "id", "piece", (F.col("piece") * capacity).alias("start"),
        F.least(F.col("size") - F.col("piece") * capacity, F.lit(capacity)).alias("length"),
        "source", "cluster", "rid", F.pmod(F.xxhash64("rid"), F.lit(shards)).alias("shard"),
    )
    names = ["id", "piece", "start", "length"]
    own = F.format_string("d%s-%s-%s", F.col("id"), F.col("piece"), F.col("rid"))
    alone = cut.filter((F.col("length") == 0) | (F.col("length") == capacity)).select(
        *names, F.when(F.col("length") > 0, own).alias("bin")
    )
    short = cut.filter((F.col("length") > 0) & (F.col("length") < capacity)).drop("rid")

    def run(rows: pa.Table) -> pa.Table:
        order = [("length", "descending"), *((c, "ascending") for c in ("id", "cluster", "source"))]
        rows = rows.sort_by(order)
        bins = best_fit(
            rows["length"].to_pylist(), _codes(rows["source"]), _codes(rows["cluster"]), capacity
        )
        shard = rows["shard"][0].as_py()
        return rows.select(names).append_column("bin", pa.array([f"s{shard}-{b}" for b in bins]))

    kind = short.schema["id"].dataType.simpleString()
    packed = short.groupBy("shard").applyInArrow(
        run, f"id {kind}, piece bigint, start bigint, length bigint, bin string"
    )
    return alone.unionByName(packed).withColumnRenamed("id", id_col)


def pack_documents(docs: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """:func:`pack` for a table with doc_id, text and source: words, sources and exact copies."""
    text = F.col("`text`")
    return pack(docs, word_count(text), F.col("`source`"), text_cluster(text), capacity)


def op7_best_fit_packing(spark, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"))
