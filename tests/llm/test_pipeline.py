import re

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as cp
from depthframe.llm import decontaminate, packing, toxicity

SF = "/root/testdata/sf0.001"


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def test_pipeline_equals_a_plain_version(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = toxicity.fit(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    rows = sorted((r["doc_id"], r["text"]) for r in docs.collect())
    import pyarrow as pa

    reject = model.above(model.latent(pa.array([t for _, t in rows])))[:, 0] >= toxicity.REJECT
    assert 0 < reject.sum() < 20
    rows = [r for r, bad in zip(rows, reject) if not bad]
    seen, kept = set(), []
    for doc, text in rows:
        key = re.sub(r"[\x20\x09-\x0D]+", " ", text or "")
        if key not in seen:
            seen.add(key)
            kept.append((doc, text))
    sets = []
    for _, text in kept:
        ws = words(text)
        sets.append({tuple(ws[i : i + 5]) for i in range(max(1, len(ws) - 4))} if ws else set())
    group = list(range(len(kept)))

    def find(i):
        while group[i] != i:
            i = group[i]
        return i

    for i in range(len(kept)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and 100 * both >= 80 * len(sets[i] | sets[j]):
                a, b = sorted((find(i), find(j)))
                group[b] = a
    kept = [kept[i] for i in range(len(kept)) if find(i) == i]
    index = decontaminate.Index([(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()])
    bad = {x[0] for x in index.leaks(pa.array([t for _, t in kept]))}
    kept = {doc: len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, (doc, t) in enumerate(kept) if i not in bad}
    out = cp.run(spark, SF).collect()
    total = {}
    for r in out:
        total[r["doc_id"]] = total.get(r["doc_id"], 0) + r["length"]
    assert total == kept
    sizes = {}
    for r in out:
        if r["bin"]:
            sizes[r["bin"]] = sizes.get(r["bin"], 0) + r["length"]
    assert max(sizes.values()) <= packing.CAPACITY


@pytest.mark.parametrize("rows", [[], [(None, None, None, None, None), (1, "", "en", None, 0), (1, "a b", "en", "s", 3)]])
def test_stages_take_odd_tables(spark, rows, tmp_path):
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint"
    docs = spark.createDataFrame(rows, schema).withColumns({"row": F.lit(1), "key": F.lit("k"), "id": F.lit(2)})
    for name, columns in (("labels", "doc_id bigint, quality int, toxic int"), ("benchmark", "item_id bigint, text string")):
        spark.createDataFrame([], columns).write.parquet(str(tmp_path / f"{name}.parquet"))
    names = docs.columns
    for i, (_, stage) in enumerate(cp.STAGES):
        docs = stage(spark, docs, str(tmp_path))
        assert i == len(cp.STAGES) - 1 or docs.columns == names
    assert docs.count() == len({r[1] or "" for r in rows})
