import random

from pyspark.sql import functions as F

from depthframe.llm import packing


def slow_best_fit(sizes, sources, clusters, capacity):
    bins, out = [], []
    for s, a, c in zip(sizes, sources, clusters):
        fits = [
            (b["left"], i)
            for i, b in enumerate(bins)
            if b["left"] >= s and (a < 0 or a not in b["a"]) and (c < 0 or c not in b["c"])
        ]
        if not fits:
            bins.append({"left": capacity, "a": set(), "c": set()})
        at = min(fits)[1] if fits else len(bins) - 1
        bins[at]["left"] -= s
        bins[at]["a"].add(a)
        bins[at]["c"].add(c)
        out.append(at)
    return out


def test_best_fit_equals_brute_force():
    rng = random.Random(1)
    for _ in range(60):
        n = rng.randrange(0, 120)
        sizes = sorted((rng.randrange(1, 50) for _ in range(n)), reverse=True)
        sources = [rng.randrange(-1, 5) for _ in range(n)]
        clusters = [rng.randrange(-1, 9) for _ in range(n)]
        assert packing.best_fit(sizes, sources, clusters, 60) == slow_best_fit(sizes, sources, clusters, 60)


def test_equal_pieces_need_no_walk_over_their_bins():
    n = 20_000
    for source, cluster in ((-1, 3), (2, -1), (1, 1)):
        assert packing.best_fit([3] * n, [source] * n, [cluster] * n, 10) == list(range(n))
    assert packing.best_fit([3] * 6, [-1] * 6, [-1] * 6, 10) == [0, 0, 0, 1, 1, 1]
    # Runs of equal pieces between others.
    rng = random.Random(3)
    for _ in range(60):
        runs = [(rng.randrange(1, 30), rng.randrange(-1, 3), rng.randrange(-1, 3), rng.randrange(1, 9)) for _ in range(25)]
        pieces = [r[:3] for r in sorted(runs, reverse=True) for _ in range(r[3])]
        assert packing.best_fit(*zip(*pieces), 40) == slow_best_fit(*zip(*pieces), 40)


def test_repeated_rows_are_spread_over_shards(spark, monkeypatch):
    monkeypatch.setattr(packing, "SHARD_ROWS", 50)
    rows = [(None, "one text", "s")] * 400 + [(5, "other text", "s")] * 200
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string").repartition(3)
    got = packing.pack_documents(df, 64).collect()
    assert len(got) == len({r["bin"] for r in got}) == 600
    shards = [r["bin"].split("-")[0] for r in got]
    assert len(set(shards)) == 12 and max(shards.count(s) for s in set(shards)) < 100


def test_rows_are_whole_and_bins_hold_the_rules(spark, monkeypatch):
    monkeypatch.setattr(packing, "SHARD_ROWS", 40)
    rng = random.Random(2)
    words = ["a", "b", "c"]
    rows = [(i, " ".join(rng.choice(words) for _ in range(rng.randrange(0, 90))), f"s{rng.randrange(4)}") for i in range(150)]
    rows += [(i + 200, "same text of seven words right here", "hot") for i in range(30)]
    rows += [(7, "x y", None), (7, "x y", None), (None, None, "s1"), (900, "z " * 500, "s2"), (901, " \n ", "s2")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string").withColumn("shard", F.lit("clash"))
    got = packing.pack_documents(df, 64).collect()
    assert sum(r["length"] for r in got) == sum(len((t or "").split()) for _, t, _ in rows)
    by_id = {i: (t, s) for i, t, s in rows}
    bins = {}
    for r in got:
        assert (r["bin"] is None) == (r["length"] == 0)
        if r["bin"]:
            bins.setdefault(r["bin"], []).append(r)
    for members in bins.values():
        assert sum(m["length"] for m in members) <= 64
        sources = [by_id[m["doc_id"]][1] for m in members if by_id[m["doc_id"]][1]]
        texts = [by_id[m["doc_id"]][0] for m in members]
        assert len(set(sources)) == len(sources) and len(set(texts)) == len(texts)
    assert len([r for r in got if r["doc_id"] == 900]) == 8
    assert packing.pack_documents(df.limit(0), 64).count() == 0
