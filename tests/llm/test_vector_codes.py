import hashlib
import math
import random

import numpy as np
from pyspark.sql import functions as F

from depthframe.llm import vector_codes as vc

SCHEMA = "vec_id bigint, embedding array<float>, label int"


def plain(rows, entries=vc.ENTRIES, rounds=vc.ROUNDS):
    """The contract in plain Python integers: {row number: (code, error)} and the codebooks."""
    kept = [
        (i, v_id, [math.floor(1024 * float(np.float32(x))) for x in v], label)
        for i, (v_id, v, label) in enumerate(rows)
        if v is not None and all(x is not None and math.isfinite(x) for x in v)
    ]
    kept.sort(key=lambda r: (r[1] is None, r[1] or 0, r[2]))
    w = len(kept[0][2]) // 4
    parts = [[r[2][p * w : p * w + w] for r in kept] for p in range(4)]
    books = [list(x[:entries]) for x in parts]

    def assign(x, book):
        d = [sum((a - b) ** 2 for a, b in zip(x, e)) for e in book]
        return d.index(min(d)), min(d)

    for _ in range(rounds):
        for p in range(4):
            groups = {}
            for x in parts[p]:
                groups.setdefault(assign(x, books[p])[0], []).append(x)
            for k, xs in groups.items():
                books[p][k] = [sum(c) // len(xs) for c in zip(*xs)]
    out = {}
    for n, (i, *_rest) in enumerate(kept):
        hits = [assign(parts[p][n], books[p]) for p in range(4)]
        out[i] = ("".join(f"{k:02x}" for k, _ in hits), sum(d for _, d in hits))
    text = ",".join(str(c) for book in books for e in book for c in e)
    return out, hashlib.sha256(text.encode()).hexdigest()


def check(spark, rows):
    want, books = plain(rows)
    df = spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], SCHEMA + ", nr int").repartition(3)
    got = vc.vector_codes(df.drop("nr").withColumns({"v": F.lit(1), "far": F.lit("x"), "size": F.lit(2)})).collect()
    by_label = {}
    for i, (_, e) in want.items():
        by_label[rows[i][2]] = by_label.get(rows[i][2], 0) + e
    key = lambda r: tuple((x is None, x or 0) for x in r)
    expected = sorted([(rows[i][0], c, e, by_label[rows[i][2]]) for i, (c, e) in want.items()], key=key)
    assert sorted([tuple(r)[:4] for r in got], key=key) == expected
    assert {r["codebooks_sha256"] for r in got} == {books}


def test_equals_the_contract_with_ties_repeats_and_broken_rows(spark):
    rng = random.Random(3)
    rows = [(i, [rng.gauss(0, 0.02) for _ in range(8)], rng.choice([0, 1, None])) for i in range(400)]
    rows += [(i, list(rows[7][1]), 2) for i in range(400, 460)] + [rows[3], rows[3]]  # copies, repeated rows
    rows += [(500 + i, [rng.randint(-2, 2) / 1024 for _ in range(8)], 1) for i in range(80)]  # many ties
    rows += [(900, None, 1), (901, [None] * 8, 1), (902, [float("nan")] + [0.0] * 7, 1), (903, [float("inf")] * 8, 0), (None, [0.5] * 8, None)]
    check(spark, rows)


def test_fewer_rows_than_entries(spark):
    check(spark, [(3, [0.1, -0.2, 0.3, 0.4], None), (1, [0.1, -0.2, 0.3, 0.4], 5), (2, [9.0, 9.0, -9.0, 0.0], 5)])


def test_odd_lengths_empty_vectors_and_tables(spark):
    rows = [(1, [0.5, 0.25, 0.1, 0.2, 1.0], 1), (2, [], 1), (3, [0.5], None)]
    got = vc.vector_codes(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted((r["vec_id"], r["error"]) for r in got) == [(1, 0), (2, 0), (3, 0)]
    assert vc.vector_codes(spark.createDataFrame([], SCHEMA)).count() == 0
    assert vc.vector_codes(spark.createDataFrame([(1, None, 1)], SCHEMA)).count() == 0


def test_large_components_do_not_overflow(spark):
    got = vc.vector_codes(spark.createDataFrame([(1, [3e38] * 8, 1), (2, [-3e38] * 8, 1)], SCHEMA)).collect()
    assert [r["error"] for r in got] == [0, 0]


def test_bounds_prune_and_lose_nothing():
    rng = np.random.default_rng(1)
    centres = rng.integers(-400, 400, (40, 16))
    x = centres[rng.integers(0, 40, 3000)] + rng.integers(-20, 20, (3000, 16))
    entries = x[:256]
    pivots = vc.pivots_of(entries, vc.PIVOTS)
    index, best, evaluated = vc.nearest(x, vc.pivot_distances(x, pivots), entries, pivots)
    every = ((x[:, None] - entries[None]) ** 2).sum(2)
    assert (best == every.min(1)).all() and (index == every.argmin(1)).all()
    assert evaluated < 0.3 * every.size


def test_hot_groups_meet_by_broadcast_and_others_by_shuffle(spark, monkeypatch):
    from depthframe.llm import common

    monkeypatch.setattr(common, "HOT_SHARE", 0.2)
    rows = common.stored(spark.range(1000).selectExpr("id", "if(id < 500, null, id % 100) AS k"))
    groups = common.stored(rows.groupBy("k").agg(F.count("*").alias("size")))
    got = common.with_groups(rows, groups, "k", "size", 1000)
    assert got.count() == 1000 and got.filter("(k IS NULL) = (size = 500)").count() == 1000
