import random
import re

import numpy as np
import pyarrow as pa
import pytest

from depthframe.llm import toxicity as tox


def corpus(n, seed):
    rng = random.Random(seed)
    plain = [f"word{i}" for i in range(400)]
    bad = ["grubnik", "slorpish", "vexar"]
    texts, toxic = [], []
    for i in range(n):
        words = [rng.choice(plain) for _ in range(rng.randrange(1, 60))]
        mark = i % 4 == 0
        if mark:
            for _ in range(rng.randrange(1, 5)):
                words.insert(rng.randrange(len(words) + 1), rng.choice(bad) + rng.choice(["", "en", "s"]))
        texts.append(" ".join(words))
        toxic.append(float(mark))
    return pa.array(texts), np.array(toxic)


def test_held_out_accuracy_and_order_of_grades():
    model = tox.train(*corpus(1500, 1))
    assert (np.diff(model.thresholds) > 0).all()
    text, toxic = corpus(1200, 2)
    above = model.above(model.latent(text))
    assert (np.diff(above, axis=1) <= 0).all()
    assert ((above[:, 0] >= tox.REJECT) == toxic.astype(bool)).mean() > 0.99
    severity = above.sum(1)
    assert severity[toxic == 1].min() > severity[toxic == 0].max()
    mild, severe = model.above(model.latent(pa.array(["a grubnik b", "grubnik slorpish vexar slorpishen"]))).sum(1)
    assert mild < severe


def test_gradient_of_the_ordinal_likelihood():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(400, 3))
    z = x @ np.array([1.5, -2.0, 0.0])
    y = (z + rng.logistic(size=400) > -1).astype(int) + (z + rng.logistic(size=400) > 1)
    weights, thresholds = tox.fit_ordinal(x, y, 3, steps=800)
    assert thresholds[0] < thresholds[1] and weights[0] > 0.5 and weights[1] < -0.8 and abs(weights[2]) < 0.4


def test_rows_and_defined_results(spark):
    text, toxic = corpus(600, 3)
    docs = spark.createDataFrame([(i, t.as_py(), "x") for i, t in enumerate(text)], "doc_id bigint, text string, l_id string")
    labels = spark.createDataFrame(
        [(i, int(t)) for i, t in enumerate(toxic)] + [(1, None), (None, 1), (5, 0), (10**6, 1)], "doc_id bigint, toxic int"
    )
    model = tox.fit(docs, labels)
    odd = spark.createDataFrame([(1, None, "e"), (2, "", "e"), (2, "vexar " * 40_000, "e"), (None, "word1", "e")], "doc_id bigint, text string, severity string")
    got = tox.grade(odd, model).collect()
    assert sorted((r["toxic"], r["grade"] > 0) for r in got) == [(False, False)] * 3 + [(True, True)]
    kept = tox.clean_documents(odd, model)
    assert kept.columns == odd.columns and kept.count() == 3
    assert tox.grade(odd.limit(0), model).count() == 0
    none = tox.fit(docs.limit(0), labels)
    assert {r["grade"] for r in tox.grade(odd, none).collect()} == {0}


@pytest.mark.parametrize("toxic", [np.zeros(5), np.ones(5)])
def test_one_class_only(toxic):
    model = tox.train(pa.array(["a b", "b", "c", "", None]), toxic)
    assert (model.above(model.latent(pa.array(["a b"]))) < 0.5).all()


@pytest.mark.parametrize("n", [400, 4400])
def test_probabilities_do_not_depend_on_the_number_of_labels(spark, n):
    rng = random.Random(n)
    plain, bad = [f"word{i}" for i in range(400)], ["grubnik", "slorpish", "vexar"]
    rows = []
    for i in range(10 * n):
        words = [rng.choice(plain) for _ in range(8)]
        false = n // 2 <= i < n  # half of the toxic labels are false, 5% of the clean texts
        rows.append((i, " ".join(words if i >= n or false else [*words, rng.choice(bad), rng.choice(bad)]), int(i < n)))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, toxic int")
    model = tox.fit(docs.drop("toxic"), docs.drop("text"))
    clean, foul = model.above(model.latent(pa.array(["word1 word2", "word1 grubnik vexar"])))[:, 0]
    assert 0.03 < clean < 0.08 and foul >= tox.REJECT
    assert not tox.grade(docs.filter(f"doc_id >= {n // 2}"), model).filter("toxic").count()


def plain_features(text):
    """Words and their leading 4, 5 and 6 bytes, one text at a time."""
    out = set()
    for word in re.findall(rb"[0-9A-Za-z\x80-\xff]+", (text or "").encode()):
        word = bytes(c + 32 if 65 <= c <= 90 else c for c in word)
        out |= {(0, word), *((n, word[:n]) for n in tox.STEMS)}
    return out


def test_grades_of_a_small_table_equal_a_plain_version(spark):
    """The table has 11 toxic labels: few texts, so the test for telling features must fit their number."""
    sf = "/root/testdata/sf0.001"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    model = tox.fit(docs, labels)
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    known = {key: i for i, key in enumerate(model.keys.tolist())}
    weight = {}
    for n, word in set().union(*map(plain_features, texts.values())):
        got = tox.w.split_words(pa.array([word.decode("latin-1")]) if word.isascii() else pa.array([""]), tox.w.NOT_WORD, tox.w.LOWER, tox.STEMS)
        if len(got.hashes):
            key = int(got.hashes[0] if n == 0 else got.stems[n][0] + tox.w.U64(n))
            if key in known:
                weight[n, word] = model.weights[known[key]]
    graded = {r["doc_id"]: r for r in tox.grade(docs, model).collect()}
    for doc, text in texts.items():
        latent = sum(weight.get(f, 0.0) for f in plain_features(text))
        above = [1 / (1 + np.exp(t - latent)) for t in model.thresholds]
        edge = [1.0, *above, 0.0]
        assert graded[doc]["severity"] == pytest.approx(sum(above))
        assert graded[doc]["grade"] == int(np.argmax([edge[k] - edge[k + 1] for k in range(3)]))
        assert graded[doc]["toxic"] == (above[0] >= tox.REJECT)
    bad = {r["doc_id"] for r in labels.filter("toxic = 1").collect()}
    caught = {doc for doc, r in graded.items() if r["toxic"]}
    assert len(caught & bad) >= 5 and len(caught) < 0.2 * len(texts)


def test_least_texts_is_the_exact_test():
    from math import comb

    for toxic, clean, tested in [(11, 76, 40_000), (51, 348, 90_000), (2000, 2000, 10**6), (3, 500, 10)]:
        least = tox.least_texts(toxic, clean, tested)
        chance = lambda k: comb(toxic, k) / comb(toxic + clean, k) * tested
        assert chance(least) <= 1 < chance(least - 1)
    assert tox.least_texts(2, 1, 10**6) == float("inf")
