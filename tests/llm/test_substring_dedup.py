import hashlib
import random
import re

from pyspark.sql import functions as F

from depthframe.llm import substring_dedup as sd


def brute(rows):
    texts = [(doc, re.findall(r"[^\x20\x09-\x0D]+", text or "")) for doc, text in rows]
    first = {}
    for doc, ws in texts:
        for i in range(len(ws) - sd.WINDOW + 1):
            key = tuple(ws[i : i + sd.WINDOW])
            order = sd.LAST if doc is None else doc
            first[key] = min(first.get(key, order), order)
    out = []
    for doc, ws in texts:
        gone = set()
        for i in range(len(ws) - sd.WINDOW + 1):
            if first[tuple(ws[i : i + sd.WINDOW])] < (sd.LAST if doc is None else doc):
                gone.update(range(i, i + sd.WINDOW))
        kept = " ".join(x for i, x in enumerate(ws) if i not in gone)
        out.append((doc, len(ws), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=repr)


def corpus(seed):
    rng = random.Random(seed)
    new = lambda n: [f"w{rng.randrange(10**7)}" for _ in range(n)]
    passages = [new(n) for n in (49, 50, 51, 70, 130)]
    rows = []
    for doc in range(90):
        words = new(rng.randrange(0, 60))
        for _ in range(rng.randrange(0, 4)):
            words += rng.choice(passages) + new(rng.randrange(0, 9))
        rows.append([doc, words])
    for doc in range(90, 110):
        words = list(rng.choice(rows)[1])
        for _ in range(rng.randrange(0, 3)):
            if words:
                words[rng.randrange(len(words))] = "edit"
        rows.append([doc, words])
    rows = [(d, " ".join(x)) for d, x in rows]
    rows += [(200, "a " * 400), (201, "a " * 99), (199, "a\n" * 49), (202, None), (203, ""), (204, " \t\n")]
    rows += [(None, rows[5][1]), (None, " ".join(passages[4])), (5, rows[5][1]), (5, " ".join(passages[4]))]
    rows += [(205, "É" * 70_000 + " x")]
    rng.shuffle(rows)
    return rows


def result(df):
    got = sd.remove_repeats(df).select("doc_id", "n_words", "n_removed", F.sha2(F.encode("kept", "UTF-8"), 256))
    return sorted([tuple(r) for r in got.collect()], key=repr)


def test_equals_brute_force(spark):
    rows = corpus(1)
    df = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("order", F.lit("clash"))
    assert result(df) == brute(rows)


def test_many_shards_small_flushes_and_hot_grams(spark, monkeypatch):
    rows = corpus(2)
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    monkeypatch.setattr(sd, "SHARD_GRAMS", 60)
    monkeypatch.setattr(sd, "SHARD_WORDS", 500)
    monkeypatch.setattr(sd, "FLUSH_WORDS", 100)
    assert result(df) == brute(rows)
    monkeypatch.setattr(sd, "HOT", 4)
    assert result(df) == brute(rows)


def test_empty_table(spark):
    assert result(spark.createDataFrame([], "doc_id bigint, text string")) == []
