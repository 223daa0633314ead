"""What each of five quality filters removes, in every order of the filters.

A document fails A (few words), B (repeated words), C (capitals), D (symbols) or E (its text equals
that of a document with a smaller id). A to D are read off the text. E is an existential self-join:
a left-semi join on hash, exact text and smaller id. The ids it marks are united with the other
failures, and the audit works on counts of bit combinations: in a given order, a document is
removed by the first filter of the order which it fails.

Only texts whose hash may occur twice are shuffled (a Bloom filter of repeated hashes lets the
others pass). Right rows of the join are one per text, combined before they are shuffled; the rows
of a text with very many copies are dealt over several tasks.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from depthframe.llm import bloom
from depthframe.llm.common import BLANKS, HOT_SHARE, stored, table

FILTERS = "ABCDE"
ORDERS = ["".join(p) for p in permutations(FILTERS)]
#: Rows of one text that stay together at least.
TOGETHER = 64


def bit(letter: str) -> int:
    return 1 << FILTERS.index(letter)


def failures_by_text(text: Column) -> Column:
    """Bits of the filters A to D that a text fails."""
    words = F.array_remove(F.split(text, BLANKS), "")
    number, different = F.size(words), F.size(F.array_distinct(words))
    capitals = F.length(text) - F.length(F.regexp_replace(text, "[A-Z]", ""))
    fails = {
        "A": number < 200,
        "B": 100 * different.cast("bigint") < 50 * number.cast("bigint"),
        "C": 100 * capitals.cast("bigint") > 2 * F.length(text).cast("bigint"),
        "D": text.rlike("[#$%&*|]"),
    }
    bits = [F.when(failed, bit(letter)).otherwise(0) for letter, failed in fails.items()]
    return sum(bits[1:], bits[0])


def later_copies(rows: DataFrame, prints: DataFrame) -> DataFrame:
    """id, sha and part of the ``rows`` whose text some row with a smaller id has. ``prints`` is the stored sha column."""
    total = prints.count()
    blocks = bloom.block_count(total)
    often = stored(bloom.filter_words(prints, "sha", blocks, 2))
    few = max(TOGETHER, int(total * HOT_SHARE))
    large = (
        bloom.mark(prints, "sha", often, blocks).filter("maybe").groupBy("sha").count()
        .filter(F.col("count") > few)
        .select(F.col("sha").alias("large_sha"), F.ceil(F.col("count") / few).cast("int").alias("deals"))
    )
    some = bloom.mark(rows, "sha", often, blocks).filter("maybe and id is not null").drop("maybe")
    some = some.join(F.broadcast(large), F.col("sha") == F.col("large_sha"), "left")
    some = some.withColumn("deals", F.coalesce("deals", F.lit(1))).drop("large_sha")
    first = some.groupBy("sha", "text", "deals").agg(F.min("id").alias("first_id"))
    first = first.select(
        F.col("sha").alias("f_sha"), F.col("text").alias("f_text"), "first_id",
        F.explode(F.sequence(F.lit(0), F.col("deals") - 1)).alias("f_deal"),
    )
    each = some.withColumn("deal", F.pmod(F.xxhash64("id"), F.col("deals")).cast("int"))
    same = (F.col("sha") == F.col("f_sha")) & (F.col("deal") == F.col("f_deal")) & (F.col("text") == F.col("f_text"))
    return each.join(first, same & (F.col("id") > F.col("first_id")), "left_semi").select("id", "sha", "part")


def failing_documents(docs: DataFrame, id_col: str, text_col: str, part_col: str) -> tuple[DataFrame, DataFrame]:
    """(failures, sizes): (id, part, bits, n) of all failing documents, and (part, n) of all."""
    rows = docs.select(
        docs[id_col].alias("id"), F.coalesce(docs[part_col].cast("string"), F.lit("")).alias("part"),
        F.coalesce(docs[text_col], F.lit("")).alias("text"),
    )
    rows = rows.withColumn("sha", F.unhex(F.sha2(F.encode("text", "UTF-8"), 256)))
    flat = stored(rows.select("id", "part", "sha", failures_by_text(F.col("text")).alias("bits")))
    one, none = F.lit(1).cast("bigint"), F.lit(0).cast("bigint")
    by_text = flat.filter("bits <> 0").select("id", "sha", "part", "bits", one.alias("by_text"), none.alias("copy"))
    copies = later_copies(rows, flat.select("sha")).select(
        "id", "sha", "part", F.lit(bit("E")).alias("bits"), none.alias("by_text"), one.alias("copy")
    )
    failures = by_text.unionByName(copies).groupBy("id", "sha", "part").agg(
        F.bit_or("bits").alias("bits"), F.greatest(F.sum("by_text"), F.sum("copy")).alias("n")
    )
    sizes = flat.groupBy("part").agg(F.count(F.lit(1)).alias("n"))
    return failures, sizes


def filter_audit(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source"
) -> DataFrame:
    """One row per part, filter order and step with the counts of that step.

    Null texts are empty and fail A; documents with a null id are never copies, nor is anything a
    copy of them. A row is a copy if its text stands in a row with a strictly smaller id, so rows
    repeated under one id are no copies of each other; they count each. Null parts are the part ''.
    A label counts if any row of ``labels`` with that id says 1. Other columns are ignored. An
    empty table gives no rows.
    """
    failures, sizes = failing_documents(docs, id_col, text_col, part_col)
    marks = labels.filter(f"`{id_col}` IS NOT NULL AND (quality = 1 OR toxic = 1)").groupBy(
        F.col(f"`{id_col}`").alias("l_id")
    ).agg(
        F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("good"),
        F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("toxic"),
    )
    unknown = failures.filter("id IS NULL").select("part", "bits", "n", F.lit(False).alias("good"), F.lit(False).alias("toxic"))
    known = failures.filter("id IS NOT NULL").join(marks, F.col("id") == F.col("l_id"), "left").select(
        "part", "bits", "n", F.coalesce("good", F.lit(False)).alias("good"), F.coalesce("toxic", F.lit(False)).alias("toxic")
    )
    combinations = known.unionByName(unknown).groupBy("part", "bits", "good", "toxic").agg(F.sum("n").alias("n"))
    whole = sizes.select("part", F.lit(0).alias("bits"), "n", F.lit(False).alias("good"), F.lit(False).alias("toxic"))
    steps = combinations.unionByName(whole).select(
        "*", F.explode(F.array(*map(F.lit, ORDERS))).alias("filter_order")
    )
    fails = {x: F.col("bits").bitwiseAND(F.lit(bit(x))) != 0 for x in FILTERS}
    first = F.least(*[F.when(fails[x], F.instr("filter_order", x)).otherwise(len(FILTERS) + 1) for x in FILTERS])
    steps = steps.withColumn("first", first).select(
        "*", F.explode(F.sequence(F.lit(1), F.lit(len(FILTERS)))).alias("step")
    )
    own = F.element_at(
        F.create_map(*[x for f in FILTERS for x in (F.lit(f), F.lit(bit(f)))]),
        F.substring("filter_order", F.col("step"), F.lit(1)),
    )
    steps = steps.withColumn("own", own)
    hit, gone = F.col("bits").bitwiseAND(F.col("own")) != 0, F.col("first") == F.col("step")

    def count(condition: Column, value: Column = F.col("n")) -> Column:
        return F.sum(F.when(condition, value).otherwise(0)).cast("bigint")

    everything = F.col("bits") == 0
    gone_by_now = ~everything & (F.col("first") <= F.col("step"))
    share = F.col("n") * F.expr(f"{len(ORDERS)} div bit_count(bits)")
    return steps.groupBy("part", "filter_order", "step").agg(
        (count(everything) - count(gone_by_now)).alias("kept"),
        count(gone).alias("removed"),
        count(hit & (F.col("first") < F.col("step"))).alias("redundant"),
        count(F.col("bits") == F.col("own")).alias("unique_fails"),
        count(gone & F.col("good")).alias("good_lost"),
        count(gone & F.col("toxic")).alias("toxic_lost"),
        count(hit, share).alias("shapley"),
    )


def op12_filter_audit(spark, sf_dir: str) -> DataFrame:
    return filter_audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


SQL = """
WITH docs AS (
    SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text,
           regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS words
    FROM documents
),
marks AS (SELECT doc_id, max(quality) FILTER (quality = 1) AS good, max(toxic) FILTER (toxic = 1) AS toxic FROM labels GROUP BY 1),
failing AS (
    SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
           concat(CASE WHEN len(words) < 200 THEN 'A' END,
                  CASE WHEN 100 * len(list_distinct(words)) < 50 * len(words) THEN 'B' END,
                  CASE WHEN 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 2 * length(text) THEN 'C' END,
                  CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 'D' END,
                  CASE WHEN d.doc_id > min(d.doc_id) OVER (PARTITION BY text) THEN 'E' END) AS fails
    FROM docs d LEFT JOIN marks m ON m.doc_id = d.doc_id
),
cells AS (SELECT part, fails, good, toxic, count(*) AS n FROM failing GROUP BY ALL),
letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
orders AS (
    SELECT a.x || b.x || c.x || d.x || e.x AS filter_order
    FROM letters a, letters b, letters c, letters d, letters e
    WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5
),
steps AS (SELECT filter_order, step, filter_order[step] AS own, filter_order[1:step - 1] AS earlier
          FROM orders, (SELECT unnest(range(1, 6)) AS step)),
counted AS (
    SELECT part, filter_order, CAST(step AS INTEGER) AS step, own,
           sum(CASE WHEN NOT regexp_matches(fails, '[' || earlier || own || ']') THEN n ELSE 0 END) AS kept,
           sum(CASE WHEN contains(fails, own) AND translate(fails, earlier, '') = fails THEN n ELSE 0 END) AS removed,
           sum(CASE WHEN contains(fails, own) AND translate(fails, earlier, '') <> fails THEN n ELSE 0 END) AS redundant,
           sum(CASE WHEN fails = own THEN n ELSE 0 END) AS unique_fails,
           sum(CASE WHEN contains(fails, own) AND translate(fails, earlier, '') = fails THEN n * good ELSE 0 END) AS good_lost,
           sum(CASE WHEN contains(fails, own) AND translate(fails, earlier, '') = fails THEN n * toxic ELSE 0 END) AS toxic_lost
    FROM cells, steps GROUP BY ALL
)
SELECT part, filter_order, step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed,
       CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails,
       CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost,
       CAST(sum(removed) OVER (PARTITION BY part, own) AS BIGINT) AS shapley
FROM counted
"""
