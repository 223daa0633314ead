"""Exact de-duplication by two passes over a counting Bloom filter. DataFrame functions only.

Pass 1 sets ``PROBES`` bits for every row's fingerprint and keeps the bits that more than one
row set. Pass 2 tests each row: if one of its bits was set once only, its text is unique and the
row passes straight through. Only the rest, a superset of the true repeats, is shuffled and
grouped by fingerprint, which settles it exactly. The answer of a group with very many copies is
broadcast to its rows.

The filter is cut into blocks of 512 bits so that one lookup answers a row, and has 16 to 32 bits
a row up to ``bloom.MAX_BLOCKS`` (16 MB of bits), which bounds the broadcast. Beyond about eight million
rows the filter is fuller: more rows are shuffled, the result is the same.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from depthframe.llm import bloom
from depthframe.llm.common import normal_text, stored, table, whole, with_groups

def fingerprint(text: Column) -> Column:
    """SHA-256 of the normalised text, 32 bytes."""
    return F.unhex(F.sha2(F.encode(normal_text(text), "UTF-8"), 256))


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, ``keep_id``, ``group_size``, ``kept``, ``text_sha256``.

    Null texts count as empty. In a group the row with the smallest id stays, null ids last; of
    rows repeated with that same id exactly one is ``kept``. Other columns are ignored; an empty
    table gives an empty result.
    """
    prints = stored(
        docs.select(
            F.col(f"`{id_col}`").alias("id"),
            fingerprint(F.col(f"`{text_col}`")).alias("sha"),
            F.monotonically_increasing_id().alias("rid"),
        )
    )
    blocks = bloom.block_count(prints.count())
    marked = bloom.mark(prints, "sha", bloom.filter_words(prints, "sha", blocks, 2), blocks)
    rank = F.struct(F.col("id").isNull().alias("last"), F.col("id"), F.col("rid"))
    straight = marked.filter("not maybe").select(
        "id", F.col("id").alias("keep_id"), F.lit(1).cast("bigint").alias("group_size"),
        F.lit(True).alias("kept"), "sha",
    )
    some = stored(marked.filter("maybe").select("id", "sha", "rid"))
    groups = stored(
        some.groupBy("sha").agg(F.min(rank).alias("first"), F.count(F.lit(1)).alias("group_size"))
    )
    settled = with_groups(some, groups, "sha", "group_size", prints.count()).select(
        "id", F.col("first.id").alias("keep_id"), "group_size",
        (F.col("first.rid") == F.col("rid")).alias("kept"), "sha",
    )
    return straight.unionByName(settled).select(
        F.col("id").alias(id_col), "keep_id", "group_size", "kept",
        F.lower(F.hex("sha")).alias("text_sha256"),
    )


def unique_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that :func:`exact_duplicates` keeps, with all their columns.

    Rows that the filter clears never leave their task. A possible repeat meets only its own
    (fingerprint, id), so a large group of copies is not gathered anywhere; the group itself is
    reduced to its smallest id before it is shuffled.
    """
    rows = docs.select(
        whole(docs), F.col(f"`{id_col}`").alias("id"), fingerprint(F.col(f"`{text_col}`")).alias("sha")
    )
    prints = stored(rows.select("id", "sha"))
    blocks = bloom.block_count(prints.count())
    repeats = stored(bloom.filter_words(prints, "sha", blocks, 2))
    marked = bloom.mark(rows, "sha", repeats, blocks)
    rank = F.struct(F.col("id").isNull().alias("last"), F.col("id"))
    winners = (
        bloom.mark(prints, "sha", repeats, blocks)
        .filter("maybe")
        .groupBy("sha")
        .agg(F.min(rank).alias("first"))
        .select("sha", F.col("first.id").alias("first_id"))
    )
    some = marked.filter("maybe").join(
        winners.withColumnRenamed("sha", "w_sha"),
        (F.col("sha") == F.col("w_sha")) & F.col("id").eqNullSafe(F.col("first_id")),
        "left_semi",
    )
    once = some.groupBy("sha", "id").agg(F.first("row").alias("row")).select("row")
    return marked.filter("not maybe").select("row").unionByName(once).select("row.*")


def op10_exact_dedup(spark, sf_dir: str) -> DataFrame:
    return exact_duplicates(table(spark, sf_dir, "documents"))


SQL = """
WITH t AS (
    SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]+', ' ', 'g')) AS text_sha256
    FROM documents
)
SELECT doc_id, min(doc_id) OVER (PARTITION BY text_sha256) AS keep_id,
       count(*) OVER (PARTITION BY text_sha256) AS group_size,
       doc_id = min(doc_id) OVER (PARTITION BY text_sha256) AS kept, text_sha256
FROM t
"""
