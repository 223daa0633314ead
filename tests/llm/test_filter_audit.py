import re
from itertools import permutations

from pyspark.sql import functions as F

from depthframe.llm import filter_audit as fa

SCHEMA = "doc_id bigint, text string, source string"


def plain(docs, labels):
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, t in labels if t == 1 and i is not None}
    texts = {}
    for i, t, _ in docs:
        if i is not None:
            texts.setdefault(t or "", []).append(i)
    rows = []
    for i, t, s in docs:
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = set()
        if len(w) < 200:
            fails.add("A")
        if 100 * len(set(w)) < 50 * len(w):
            fails.add("B")
        if 100 * len(re.findall("[A-Z]", t)) > 2 * len(t):
            fails.add("C")
        if re.search("[#$%&*|]", t):
            fails.add("D")
        if i is not None and min(texts[t]) < i:
            fails.add("E")
        rows.append((s or "", fails, i in good, i in toxic))
    out = {}
    for part in {r[0] for r in rows}:
        own = [r for r in rows if r[0] == part]
        shapley = dict.fromkeys("ABCDE", 0)
        for order in permutations("ABCDE"):
            left = own
            for step, letter in enumerate(order, 1):
                gone = [r for r in left if letter in r[1]]
                left = [r for r in left if letter not in r[1]]
                shapley[letter] += len(gone)
                redundant = sum(letter in r[1] for r in own) - len(gone)
                out[part, "".join(order), step] = [
                    len(left), len(gone), redundant, sum(r[1] == {letter} for r in own),
                    sum(r[2] for r in gone), sum(r[3] for r in gone),
                ]
        for (p, order, step), values in out.items():
            if p == part:
                values.append(shapley[order[step - 1]])
    return out


def long_text(seed, words=220, word="w"):
    return " ".join(f"{word}{(seed * 7 + k * k) % 997}" for k in range(words))


DOCS = [
    *[(i, long_text(i % 9), f"s{i % 3}") for i in range(40)],
    (40, None, None), (41, "", ""), (42, "Short ONE", "s0"), (43, "a\tb  a " * 200, "s1"), (44, "a\tb  a " * 200, "s1"),
    (45, long_text(1) + " #", "s2"), (46, "LOUD " * 300, None), (47, long_text(3).upper(), "s1"),
    (48, "é ü " * 120, "s2"), (None, long_text(2), "s0"), (None, None, None), (3, long_text(3), "s0"), (3, "twice", "s1"), (3, "twice", "s1"),
    (50, "x " * 400_000, "s0"), (49, "x " * 400_000, "s2"), (51, "one word " * 250, "s0"),
]
LABELS = [(1, 1, 0), (12, 1, 1), (12, 0, 0), (46, None, 1), (43, 1, None), (None, 1, 1), (44, 1, 1), (999, 1, 1)]


def rows_of(df):
    names = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    return {(r["part"], r["filter_order"], r["step"]): [r[n] for n in names] for r in df.collect()}


def audit(spark, docs, labels):
    extra = {"sha": F.lit("x"), "bits": F.lit(7), "n": F.lit(3), "part": F.lit("p"), "good": F.lit(True), "toxic": F.lit(9)}
    d = spark.createDataFrame(docs, SCHEMA).withColumns(extra)
    return fa.filter_audit(d, spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").withColumn("n", F.lit(1)))


def test_equals_the_definition(spark):
    assert rows_of(audit(spark, DOCS, LABELS)) == plain(DOCS, LABELS)


def test_a_hot_text_is_dealt_over_tasks(spark, monkeypatch):
    monkeypatch.setattr(fa, "TOGETHER", 5)
    docs = [(i, "same" if i % 3 else f"t{i}", "hot") for i in range(300)]
    assert rows_of(audit(spark, docs, [])) == plain(docs, [])


def test_equal_hashes_of_different_texts_are_no_copies(spark):
    rows = spark.createDataFrame([(1, "a", "p"), (2, "b", "p"), (3, "a", "p"), (4, "b", "p")], "id bigint, text string, part string")
    rows = rows.withColumn("sha", F.lit(b"same"))
    copies = fa.later_copies(rows, rows.select("sha"))
    assert sorted(r["id"] for r in copies.collect()) == [3, 4]


def test_empty_tables(spark):
    assert audit(spark, [], LABELS).count() == 0
    got = audit(spark, [(1, "a", "s")], [])
    assert got.count() == 600 and got.agg(F.sum("removed")).first()[0] == 120
