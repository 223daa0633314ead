"""Preference pairs: one shared prompt and two masked completions. DataFrame functions only.

Both conversations of a pair are gathered turn by turn, the longest common prefix of turns is
rendered once, and the turns behind it are rendered for each side with the character spans that
a trainer should learn from (the assistant's contents).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from depthframe.llm.common import table

#: The template of one turn.
OPEN, HEAD, CLOSE = "<|", "|>\n", "\n<|end|>\n"
ANSWERS = "assistant"


def _turn(x: Column) -> Column:
    return F.concat(F.lit(OPEN), x["role"], F.lit(HEAD), x["text"], F.lit(CLOSE))


def render(turns: Column) -> Column:
    return F.array_join(F.transform(turns, _turn), "")


def answer_spans(turns: Column) -> Column:
    """(start, length) of every assistant content in the rendered turns, zero-based."""
    zero = F.struct(
        F.lit(0).cast("bigint").alias("at"),
        F.array().cast("array<struct<start:bigint,length:bigint>>").alias("spans"),
    )

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + F.length(F.concat(F.lit(OPEN), x["role"], F.lit(HEAD)))
        size = F.length(x["text"]).cast("bigint")
        span = F.array(F.struct(start.alias("start"), size.alias("length")))
        return F.struct(
            (acc["at"] + F.length(_turn(x))).alias("at"),
            F.when(x["role"] == ANSWERS, F.concat(acc["spans"], span)).otherwise(acc["spans"]).alias("spans"),
        )

    return F.aggregate(turns, zero, step, lambda a: a["spans"])


def preference_pairs(chosen: DataFrame, rejected: DataFrame, key: str = "conv_id") -> DataFrame:
    """One row per key of either input (columns: key, turn, role, text).

    Returns key, ``n_common`` (turns of the prompt), ``prompt``, and for each side the completion
    and its spans. Turns are ordered by turn, role and text, null turns last; equal rows count as
    two turns. A null role reads ``unknown``, a null text is empty; a side without turns has an
    empty completion. Turns are equal if role and text are. Rows with a null key are one pair.
    A conversation is gathered in one row, because its rendering is one value; nothing larger is.
    """

    def side(df: DataFrame, n: int) -> DataFrame:
        text = F.coalesce(F.col("`text`"), F.lit(""))
        return df.select(
            F.col(f"`{key}`").alias("key"),
            F.struct(
                F.lit(n).alias("side"), F.col("`turn`").isNull().alias("last"), F.col("`turn`").alias("turn"),
                F.coalesce(F.col("`role`"), F.lit("unknown")).alias("role"), text.alias("text"),
            ).alias("x"),
        )

    rows = side(chosen, 0).unionByName(side(rejected, 1))
    both = rows.groupBy("key").agg(F.sort_array(F.collect_list("x")).alias("x"))
    both = both.select(
        "key", F.filter("x", lambda x: x["side"] == 0).alias("c"), F.filter("x", lambda x: x["side"] == 1).alias("r")
    )
    same = F.zip_with(
        "c", "r", lambda a, b: F.coalesce((a["role"] == b["role"]) & (a["text"] == b["text"]), F.lit(False))
    )
    differs = F.array_position(same, False).cast("int")
    n = F.when(differs == 0, F.size("c")).otherwise(differs - 1)
    cut = both.withColumn("n", n).select(
        "key", "n", F.expr("slice(c, 1, n)").alias("p"),
        F.expr("slice(c, n + 1, size(c))").alias("c"), F.expr("slice(r, n + 1, size(r))").alias("r"),
    )
    return cut.select(
        F.col("key").alias(key), F.col("n").cast("bigint").alias("n_common"), render(F.col("p")).alias("prompt"),
        render(F.col("c")).alias("chosen"), answer_spans(F.col("c")).alias("chosen_spans"),
        render(F.col("r")).alias("rejected"), answer_spans(F.col("r")).alias("rejected_spans"),
    )


def stale_answers(conversations: DataFrame) -> DataFrame:
    """The rejected side of the registered query: each conversation with its last answer replaced.

    The last assistant turn gets the text of the assistant turn before it, or no text if there is
    none. Conversations without an assistant turn are unchanged.
    """
    answers = conversations.filter(F.col("role") == ANSWERS)
    last = answers.groupBy("conv_id").agg(
        F.slice(F.sort_array(F.collect_list(F.struct("turn", "text")), False), 1, 2).alias("two")
    )
    last = last.select(
        F.col("conv_id").alias("c"), F.expr("two[0].turn").alias("t"),
        F.expr("coalesce(get(two, 1).text, '')").alias("said"),
    )
    joined = conversations.join(
        last, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("turn") == F.col("t")) & (F.col("role") == ANSWERS), "left"
    )
    return joined.select(
        "conv_id", "turn", "role", F.when(F.col("t").isNotNull(), F.col("said")).otherwise(F.col("text")).alias("text")
    )


def op8_preference_format(spark, sf_dir: str) -> DataFrame:
    """Pairs from ``conversations``: as given against :func:`stale_answers`; lengths and hashes."""
    turns = table(spark, sf_dir, "conversations")
    pairs = preference_pairs(turns, stale_answers(turns))

    def digest(c: str) -> Column:
        return F.sha2(F.encode(F.col(c), "UTF-8"), 256).alias(f"{c}_sha256")

    def spans(c: str) -> Column:
        one = F.transform(c, lambda s: F.concat(s["start"].cast("string"), F.lit("+"), s["length"].cast("string")))
        return F.array_join(one, ",").alias(c)

    return pairs.select(
        "conv_id", "n_common", digest("prompt"), digest("chosen"), digest("rejected"),
        spans("chosen_spans"), spans("rejected_spans"),
    )


_RENDERED = f"'{OPEN}' || role || '{HEAD}' || text || '{CLOSE}'".replace("\n", "' || chr(10) || '")
_HEAD = f"length('{OPEN}' || role || '{HEAD}')".replace("\n", "' || chr(10) || '")


def _side_sql(name: str) -> str:
    return f"""
{name}_o AS (
    SELECT conv_id, pos, role, text, {_RENDERED} AS piece,
           coalesce(sum(length({_RENDERED})) OVER (
               PARTITION BY conv_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
    FROM {name} JOIN n USING (conv_id) WHERE pos > n_common),
{name}_d AS (
    SELECT conv_id, string_agg(piece, '' ORDER BY pos) AS whole,
           string_agg(CASE WHEN role = '{ANSWERS}' THEN CAST(before + {_HEAD} AS BIGINT) || '+' || length(text) END,
                      ',' ORDER BY pos) AS spans
    FROM {name}_o GROUP BY conv_id)"""


SQL = f"""
WITH t AS (SELECT conv_id, turn, coalesce(role, 'unknown') AS role, coalesce(text, '') AS text FROM conversations),
a AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS k FROM t WHERE role = '{ANSWERS}'),
l AS (SELECT x.conv_id, x.turn, coalesce(y.text, '') AS said
      FROM a x LEFT JOIN a y ON x.conv_id = y.conv_id AND y.k = 2 WHERE x.k = 1),
c AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS pos FROM t),
r AS (SELECT c.conv_id, c.turn, c.role, c.pos,
             CASE WHEN l.turn IS NOT NULL AND c.role = '{ANSWERS}' THEN l.said ELSE c.text END AS text
      FROM c LEFT JOIN l ON c.conv_id = l.conv_id AND c.turn = l.turn),
n AS (SELECT c.conv_id, coalesce(min(CASE WHEN c.text <> r.text THEN c.pos END) - 1, count(*)) AS n_common
      FROM c JOIN r ON c.conv_id = r.conv_id AND c.pos = r.pos GROUP BY c.conv_id),
p AS (SELECT conv_id, string_agg({_RENDERED}, '' ORDER BY pos) AS whole
      FROM c JOIN n USING (conv_id) WHERE pos <= n_common GROUP BY conv_id),
{_side_sql("c")},
{_side_sql("r")}
SELECT n.conv_id, n_common, sha256(coalesce(p.whole, '')) AS prompt_sha256,
       sha256(coalesce(c_d.whole, '')) AS chosen_sha256, sha256(coalesce(r_d.whole, '')) AS rejected_sha256,
       coalesce(c_d.spans, '') AS chosen_spans, coalesce(r_d.spans, '') AS rejected_spans
FROM n LEFT JOIN p USING (conv_id) LEFT JOIN c_d USING (conv_id) LEFT JOIN r_d USING (conv_id)
"""
