import random
from collections import Counter

import numpy as np
import pyarrow as pa

from depthframe.llm import decontaminate as dc


def make(rng, n):
    return " ".join(f"c{rng.randrange(9)}" if rng.random() < 0.4 else f"w{rng.randrange(3000)}" for _ in range(n))


def items(rng):
    out = [(i, make(rng, rng.randrange(20, 40)) + ". " + make(rng, rng.randrange(3, 20)) + ".") for i in range(60)]
    return [*out, (60, make(rng, 150) + ". " + make(rng, 9)), (61, None), (62, "..."), (63, "two words"), (64, out[0][1])]


def plain_scores(index, words, got):
    """Every passage against every part, from the definition of BM25."""
    n = len(index.parts)
    spread = Counter(t for p in index.parts for t in set(p.words.tolist()))
    mean = np.mean([len(p.words) for p in index.parts])
    out = {}
    for text in range(len(got)):
        own = got.hashes[got.offsets[text] : got.offsets[text + 1]].tolist()
        starts = range(0, max(1, len(own) - dc.HALF), dc.HALF)
        for s in starts:
            held = set(own[s : s + 2 * dc.HALF])
            for i, part in enumerate(index.parts):
                count = Counter(part.words.tolist())
                long = dc.K1 * (1 - dc.B + dc.B * len(part.words) / mean)
                weight = {t: np.log(1 + (n - spread[t] + 0.5) / (spread[t] + 0.5)) * c * (dc.K1 + 1) / (c + long) for t, c in count.items()}
                score = sum(x for t, x in weight.items() if t in held) / sum(weight.values())
                if abs(score - dc.THRESHOLD) > 1e-4 and score > dc.THRESHOLD:
                    out[text, s, i] = score
    return out


def test_retrieval_misses_nothing_above_the_threshold():
    rng = random.Random(4)
    bench = items(rng)
    index = dc.Index(bench)
    texts = []
    for k in range(40):
        body = make(rng, rng.randrange(0, 300)).split(" ")
        if k % 2:
            at = rng.randrange(len(body) + 1)
            body[at:at] = bench[rng.randrange(60)][1].split(" ")
        texts.append(" ".join(body))
    got = dc.w.split_words(pa.array([*texts, None, "", "w1"]), dc.w.NOT_WORD, dc.w.LOWER)
    found = {(t, low - int(got.offsets[t]), part): score for t, low, _, part, score in index.retrieve(got)}
    want = plain_scores(index, None, got)
    assert want and set(want) <= set(found)
    assert all(abs(found[k] - v) < 1e-4 for k, v in want.items())
    assert all(v >= dc.THRESHOLD - 1e-4 for v in found.values())


def test_verbatim_edited_and_clean(spark):
    rng = random.Random(5)
    bench = items(rng)
    rows, leaked = [], set()
    for k in range(60):
        body = make(rng, 200).split(" ")
        item, text = bench[k % 61]
        words = text.split(" ")
        if k % 3 == 0:
            body[70:70] = [x.upper() for x in words]
            leaked.add((k, item))
        elif k % 3 == 1:
            words[len(words) // 4] = "edited"
            body[11:11] = words
            leaked.add((k, item))
        else:
            rng.shuffle(words)
            body[50:50] = words
        rows.append((k, " ".join(body)))
    rows += [(900, None), (901, ""), (None, "x"), (3, rows[3][1]), (902, bench[60][1]), (903, "q " * 60_000 + bench[5][1])]
    leaked |= {(902, 60), (903, 5)}
    leaked |= {(d, 64) for d, i in leaked if i == 0}
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").selectExpr("*", "1 AS item_id", "'x' AS score")
    benchmark = spark.createDataFrame([*bench, (None, rows[2][1])], "item_id bigint, text string")
    pairs = dc.find_leaks(docs, benchmark)
    got = pairs.select("doc_id", "item_id").collect()
    assert {tuple(r) for r in got} - {(d, 63) for d in range(1000)} == leaked
    assert len([r for r in got if r["doc_id"] == 3]) == 2 * len({i for d, i in leaked if d == 3})
    kept = dc.drop_leaks(docs, benchmark)
    assert kept.columns == docs.columns
    assert {r["doc_id"] for r in kept.collect()} == {d for d, _ in rows} - {d for d, _ in leaked}
    assert dc.find_leaks(docs.limit(0), benchmark).count() == 0
    assert dc.find_leaks(docs, benchmark.limit(0)).count() == 0 and dc.drop_leaks(docs, benchmark.limit(0)).count() == len(rows)


def test_groups_of_items_give_the_same_pairs(spark, monkeypatch):
    rng = random.Random(6)
    bench = items(rng)[:60]
    docs = spark.createDataFrame([(i, make(rng, 30) + " " + bench[i][1]) for i in range(60)], "doc_id bigint, text string")
    benchmark = spark.createDataFrame(bench, "item_id bigint, text string")
    monkeypatch.setattr(dc, "GROUP", 7)
    got = {tuple(r) for r in dc.find_leaks(docs, benchmark).select("doc_id", "item_id").collect()}
    assert got == {(i, i) for i in range(60)}


def test_scores_do_not_depend_on_groups_or_file_order(spark, monkeypatch):
    rng = random.Random(7)
    bench = [x for x in items(rng)[:61] if x[0] != 7]
    rows = []
    for i, text in bench:
        words = text.split(" ")
        words[len(words) // 4] = "edited"
        rows.append((i, make(rng, 30) + " " + " ".join(words)))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    whole = dc.Index(bench)
    want = {(rows[t][0], item): score for t, item, _, score, *_ in whole.leaks(pa.array([t for _, t in rows]))}
    assert len(want) >= 55
    rng.shuffle(bench)
    benchmark = spark.createDataFrame(bench, "item_id bigint, text string").repartition(5)
    monkeypatch.setattr(dc, "GROUP", 7)
    got = {(r["doc_id"], r["item_id"]): r["score"] for r in dc.find_leaks(docs, benchmark).collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - v) < 1e-5 for k, v in want.items())
    ids = [p.item for index in dc.item_groups(benchmark) for p in index.parts]
    assert ids == sorted(ids)


def test_long_items_stay_small_and_may_lie_in_several_groups(spark, monkeypatch):
    long = [(i, " ".join(f"l{i}x{k}" for k in range(4000)) + ".") for i in range(8)]
    index = dc.Index(long)
    postings = sum(len(p.words) for p in index.parts)
    assert sum(x.nbytes for x in vars(index).values() if isinstance(x, np.ndarray)) < 100 * postings
    monkeypatch.setattr(dc, "GROUP", 100)
    benchmark = spark.createDataFrame(long, "item_id bigint, text string")
    assert max(len(g.parts) for g in dc.item_groups(benchmark)) == 100
    docs = spark.createDataFrame([(i, long[i][1]) for i in (1, 5)] + [(9, "l1x1 l5x2")], "doc_id bigint, text string")
    got = dc.find_leaks(docs, benchmark).collect()
    assert sorted((r["doc_id"], r["item_id"]) for r in got) == [(1, 1), (5, 5)]
    assert [r["doc_id"] for r in dc.drop_leaks(docs, benchmark).collect()] == [9]
