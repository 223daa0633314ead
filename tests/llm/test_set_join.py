import random
import re

from pyspark.sql import functions as F

from depthframe.llm import set_join as sj


def shingles(text):
    lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    ws = re.findall(r"[^\x20\x09-\x0D]+", lower)
    if len(ws) < 5:
        return {tuple(ws)} if ws else set()
    return {tuple(ws[i : i + 5]) for i in range(len(ws) - 4)}


def brute(rows):
    sets = [shingles(t) for _, t in rows]
    group = list(range(len(rows)))

    def find(i):
        while group[i] != i:
            i = group[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and 100 * both >= 80 * len(sets[i] | sets[j]):
                group[find(i)] = find(j)
    out = []
    for i, (doc, _) in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if find(j) == find(i) and rows[j][0] is not None]
        out.append((doc, len(sets[i]), min(ids) if sets[i] and ids else doc))
    return sorted(out, key=repr)


def edited(rng, words, n):
    words = list(words)
    for _ in range(n):
        at = rng.randrange(len(words))
        words[at] = f"e{rng.randrange(10**6)}"
    return words


def corpus(seed):
    rng = random.Random(seed)
    rows, doc = [], 0
    passage = [f"p{i}" for i in range(40)]
    for size in (1, 2, 4, 5, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15, 16, 20, 40, 90, 200):
        for _ in range(3):
            base = [f"w{rng.randrange(10**6)}" for _ in range(size)]
            for k in range(rng.randrange(1, 6)):
                words = edited(rng, base, rng.randrange(0, 1 + size // 12)) if k else base
                if rng.random() < 0.3:
                    words = words[: max(1, len(words) - rng.randrange(3))]
                rows.append((doc, " ".join(words)))
                doc += 1
    for _ in range(25):
        rows.append((doc, " ".join(passage + [f"q{rng.randrange(10**6)}" for _ in range(rng.randrange(3, 30))])))
        doc += 1
    rows += [(doc, None), (doc + 1, ""), (doc + 2, " \n\t"), (None, "null id here with some words"), (3, rows[3][1])]
    rows += [(doc + 9, "Null ID here WITH some words"), (doc + 3, "É é"), (doc + 4, "é É"), (doc + 5, "x " * 3000)]
    rng.shuffle(rows)
    return rows


def result(df):
    rows = sj.jaccard_components(df).select("doc_id", "n_shingles", "component_id").collect()
    return sorted([tuple(r) for r in rows], key=repr)


def test_components_equal_brute_force(spark, monkeypatch):
    rows = corpus(1)
    df = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("key", F.lit("clash"))
    assert result(df) == brute(rows)
    monkeypatch.setattr(sj, "SHARD_POSTINGS", 50)
    monkeypatch.setattr(sj, "FLUSH_POSTINGS", 30)
    assert result(df) == brute(rows)


def test_every_light_boundary_gives_the_same(spark, monkeypatch):
    rows = corpus(2)
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    for light in (0, 6, 12):
        monkeypatch.setattr(sj, "light_boundary", lambda mean, x=light: x)
        assert result(df) == brute(rows)


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id bigint, text string")
    assert result(df) == []
    assert sj.one_of_each(df).count() == 0


def test_one_of_each_keeps_the_smallest_of_a_group(spark):
    rows = corpus(3)
    df = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("row", F.lit(1))
    kept = sj.one_of_each(df)
    assert kept.columns == df.columns
    stays = {d for d, _, c in brute(rows) if d == c}
    assert {r["doc_id"] for r in kept.collect()} == stays


def test_boundary_grows_with_the_lists():
    assert sj.light_boundary(1.0) <= sj.light_boundary(5.0) <= sj.light_boundary(1000.0) <= sj.LIGHT_AT_MOST


def test_bitmaps_bound_the_difference():
    import numpy as np

    rng = np.random.default_rng(3)
    for a, b, both in ((5, 9, 4), (700, 900, 600), (3000, 40, 40), (20000, 19000, 18500)):
        x = np.unique(rng.integers(0, 2**63, a).astype(np.uint64))
        y = np.unique(np.r_[x[: min(both, len(x))], rng.integers(0, 2**63, b - both).astype(np.uint64)])
        maps = [sj.parity_bitmaps(s, np.array([0, len(s)]))[0] for s in (x, y)]
        assert sj.least_difference(*maps) <= len(np.setxor1d(x, y))
        assert sj.least_difference(maps[0], maps[0]) == 0


def test_plausible_pairs_hold_every_link_between_components():
    import numpy as np

    rng = np.random.default_rng(5)
    sets = []
    for size in (10, 60, 64, 66, 120, 130, 500, 520, 1020, 1030):
        base = np.unique(rng.integers(0, 2**63, size).astype(np.uint64))
        for cut in (0, 1, size // 12, size // 6):
            sets.append(np.r_[base[cut:], rng.integers(0, 2**63, rng.integers(0, 4)).astype(np.uint64)])
    offsets = np.r_[0, np.cumsum([len(x) for x in sets])]
    bits = sj.parity_bitmaps(np.concatenate(sets), offsets)
    key, size = np.arange(len(sets)), np.diff(offsets)
    root = rng.integers(0, 20, len(sets))
    a, b = sj.plausible_pairs(key, size, root, bits)
    got = set(zip(a.tolist(), b.tolist()))
    links = {(i, j) for i in key for j in key if i < j and root[i] != root[j] and sj.linked(np.sort(sets[i]), np.sort(sets[j]))}
    assert links and links <= got and len(got) < 3 * len(links)
    near = list(zip(*(x.tolist() for x in sj.plausible_pairs(key, size, root, bits, True))))
    roots = {tuple(sorted((root[i], root[j]))) for i, j in got}
    assert set(near) <= got and len(near) == len(roots)


def test_forest():
    from depthframe.llm.components import forest

    assert forest([(5, 3), (3, 9), (7, 8), (9, 1), (2, 2)]) == {3: 1, 5: 1, 9: 1, 8: 7}
    assert forest((i, i + 1) for i in range(5000))[5000] == 0


def test_rounds_equal_one_task(spark):
    import random

    from depthframe.llm.components import components, forest

    rng = random.Random(4)
    pairs = [(i, i + 1) for i in range(0, 150) if i % 50 != 49]
    pairs += [(rng.randrange(200, 260), rng.randrange(200, 260)) for _ in range(30)] + [(500, i) for i in range(400, 440)]
    want = forest(pairs)
    df = spark.createDataFrame(pairs, "a bigint, b bigint").repartition(4)
    for local in (0, 10**6):
        got = {r["node"]: r["root"] for r in components(df, local).collect()}
        assert {n: r for n, r in got.items() if n != r} == want
        assert {r for r in got.values()} == {n for n, r in got.items() if n == r}
    assert components(df.limit(0)).count() == 0
