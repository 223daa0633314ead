"""Small helpers shared by the operators: tables, stored intermediates, plain names."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of the word contracts: the space and tab to carriage return.
BLANKS = "[\\x20\\x09-\\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """A fresh folder below the cluster's checkpoint folder; a temporary one only on a local master."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if named is None and not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="spark-"))
    return f"{sc._jsc.sc().getCheckpointDir().get()}/{uuid.uuid4().hex}"


def stored(df: DataFrame) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back, which cuts the lineage."""
    spark, path = df.sparkSession, shared_dir(df.sparkSession)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def normal_text(text: Column) -> Column:
    """Null as empty, every run of white space as one space."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), BLANKS, " ")


def whole(df: DataFrame) -> Column:
    """All columns of a row as one value, so that helper columns cannot clash with them."""
    return F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row")


#: A group is hot if it holds more than this share of all rows; there cannot be more hot groups than its inverse.
HOT_SHARE = 1 / 4096


def with_groups(rows: DataFrame, groups: DataFrame, key: str, size: str, total: int) -> DataFrame:
    """``rows`` with the columns of their group; null keys form a group. Both inputs are stored tables.

    ``groups`` has one row per ``key`` and its number of rows as ``size``. The hot groups, at most
    ``1 / HOT_SHARE`` of them, are broadcast, so that their rows stay where they are; all other
    rows meet their group in a shuffle in which no group is large.
    """
    hot = groups.filter(F.col(size) > total * HOT_SHARE)
    named = F.broadcast(hot.withColumnRenamed(key, "hot_key"))
    same = F.col(key).eqNullSafe(F.col("hot_key"))
    there = rows.join(named, same).drop("hot_key")
    cold = groups.filter(F.col(size) <= total * HOT_SHARE).withColumnRenamed(key, "cold_key")
    rest = rows.join(named.select("hot_key"), same, "left_anti")
    rest = rest.join(cold, F.col(key).eqNullSafe(F.col("cold_key"))).drop("cold_key")
    return there.unionByName(rest)
