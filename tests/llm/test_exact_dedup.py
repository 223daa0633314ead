import hashlib
import re

from pyspark.sql import functions as F

from depthframe.llm import bloom
from depthframe.llm import exact_dedup as ed

ROWS = [
    (5, "a  b\tc"), (3, "a b c"), (9, "a b c "), (4, None), (2, ""), (8, "unique"), (None, "a b c"), (None, "only null id"),
    (3, "a b c"), (7, "long " * 30_000), (6, "long\n" * 30_000), (11, " "), (12, "\n\t"),
]


def normal(text):
    return re.sub(r"[\x20\x09-\x0D]+", " ", text or "")


def test_decisions_equal_grouping(spark):
    df = spark.createDataFrame(ROWS, "doc_id bigint, text string").withColumn("sha", F.lit("clash"))
    got = ed.exact_duplicates(df).collect()
    assert len(got) == len(ROWS)
    groups = {}
    for i, t in ROWS:
        groups.setdefault(hashlib.sha256(normal(t).encode()).hexdigest(), []).append(i)
    for r in got:
        members = groups[r["text_sha256"]]
        ids = [i for i in members if i is not None]
        assert r["group_size"] == len(members) and r["keep_id"] == (min(ids) if ids else None)
        assert not r["kept"] or r["doc_id"] == r["keep_id"]
    for sha in groups:
        assert sum(r["kept"] for r in got if r["text_sha256"] == sha) == 1


def test_unique_rows_keep_all_columns(spark):
    df = spark.createDataFrame(ROWS, "doc_id bigint, text string")
    df = df.withColumns({"block": F.lit(1), "row": F.lit("x"), "id": F.lit(2), "maybe": F.lit(True)})
    kept = ed.unique_rows(df)
    assert kept.columns == df.columns
    got = sorted(((r["doc_id"] or 0), normal(r["text"])[:9]) for r in kept.collect())
    want = {}
    for i, t in ROWS:
        key = normal(t)
        best = want.get(key)
        want[key] = i if best is None else (best if i is None else min(best, i))
    assert got == sorted(((i or 0), k[:9]) for k, i in want.items())


def test_many_copies_and_a_full_filter(spark, monkeypatch):
    monkeypatch.setattr(bloom, "MAX_BLOCKS", 1)  # far too few bits: everything is shuffled, nothing is lost
    df = spark.range(3000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "copy").otherwise(F.concat(F.lit("t"), "id")).alias("text"))
    got = ed.exact_duplicates(df)
    assert got.filter("kept").count() == 2001
    assert got.filter("group_size = 1000 AND keep_id = 0").count() == 1000


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id bigint, text string")
    assert ed.exact_duplicates(df).count() == 0 and ed.unique_rows(df).count() == 0
