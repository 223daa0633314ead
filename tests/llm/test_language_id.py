import random

import numpy as np
import pyarrow as pa

from depthframe.llm import language_id as li

SYLLABLES = {"aa": ["kor", "mun", "tel", "osk"], "bb": ["lía", "ñer", "ciu", "bre"], "cc": ["schu", "ünd", "tzk", "ger"]}


def text(lang, n, rng):
    return " ".join("".join(rng.choice(SYLLABLES[lang]) for _ in range(rng.randrange(1, 4))) for _ in range(n))


def test_gradients_equal_differences():
    rng = np.random.default_rng(0)
    net = li.Network.fresh(["a", "b"])
    for part in net.parts():
        part[...] = rng.normal(0, 0.4, part.shape)
    net = li.Network(net.labels, *[p.astype(np.float64) for p in net.parts()])
    x, y = rng.integers(0, 256, (3, 6)).astype(np.uint8), np.array([0, 1, 1])
    _, grads = li.gradients(net, x, y)
    for part, grad in zip(net.parts(), grads):
        flat, slope = part.reshape(-1), grad.reshape(-1)
        for i in np.argsort(-np.abs(slope))[:5]:
            old = flat[i]
            flat[i] = old + 1e-3
            up = li.gradients(net, x, y)[0]
            flat[i] = old - 1e-3
            down = li.gradients(net, x, y)[0]
            flat[i] = old
            assert abs((up - down) / 2e-3 - slope[i]) < 2e-3 + 0.02 * abs(slope[i])


def trained():
    rng = random.Random(1)
    rows = [(i, text(lang, 30, rng), lang) for i in range(120) for lang in SYLLABLES]
    x = np.array([w for _, t, _ in rows for w in li.windows_of(t)])
    labels = sorted(SYLLABLES)
    y = np.array([labels.index(lang) for _, t, lang in rows for _ in li.windows_of(t)])
    return li.train(x, y, labels)


def test_held_out_accuracy_and_segments():
    net, rng = trained(), random.Random(2)
    rows = [(lang, text(lang, rng.randrange(5, 400), rng)) for _ in range(40) for lang in SYLLABLES]
    raw, at = li.w.text_bytes(pa.array([t for _, t in rows]))
    total, letters = li.Scorer(net).probabilities(raw, at)
    labels = [net.labels[i] for i in total.argmax(1)]
    assert np.mean([a == b for a, (b, _) in zip(labels, rows)]) > 0.97
    assert letters.tolist() == [int(li.LETTER[np.frombuffer(t.encode(), np.uint8)].sum()) for _, t in rows]
    assert np.allclose(total.sum(1), letters, rtol=1e-4)
    one = np.array([li.Scorer(net).probabilities(*li.w.text_bytes(pa.array([t])))[0][0] for _, t in rows[:9]])
    assert np.allclose(one, total[:9], rtol=1e-4)


def test_rows_and_defined_results(spark):
    rng = random.Random(3)
    rows = [(i, text(lang, 20, rng), lang) for i in range(60) for lang in SYLLABLES]
    rows += [(999, None, "aa"), (None, "kor mun", "aa"), (998, text("bb", 10, rng), None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    net = li.fit(docs)
    assert net.labels == sorted(SYLLABLES)
    odd = [(1, None), (2, ""), (3, "12 3.4 — 、!"), (4, "語"), (5, text("cc", 30_000, rng)), (5, text("cc", 40, rng)), (None, text("aa", 40, rng))]
    df = spark.createDataFrame([(*r, "x") for r in odd], "doc_id bigint, text string, score string")
    got = [(r["doc_id"], r["lang_pred"], r["score"]) for r in li.identify(df, net).collect()]
    by = {i: [x for x in got if x[0] == i] for i in (1, 2, 3, 4, 5, None)}
    assert all(by[i] == [(i, "und", 0.0)] for i in (1, 2, 3))
    assert by[4][0][1] in net.labels and {x[1] for x in by[5]} == {"cc"} and by[None][0][1] == "aa"
    assert all(0 <= x[2] <= 1 for x in got)
    assert li.identify(df.limit(0), net).count() == 0
    assert li.fit(docs.limit(0)) is None
    assert {r["lang_pred"] for r in li.identify(df, None).collect()} == {"und"}


def test_held_out_rule(spark):
    import zlib

    df = spark.range(300).withColumnRenamed("id", "doc_id")
    got = {r[0] for r in df.filter(li.held_out(df["doc_id"])).collect()}
    assert got == {i for i in range(300) if zlib.crc32(str(i).encode()) % 5 == 0}


def test_windows_cover_whole_texts():
    for n in (1, 63, 64, 65, 128, 1000):
        raw = bytes(33 + i % 90 for i in range(n))
        got = li.windows_of(raw.decode())
        assert {len(x) for x in got} == {li.LENGTH}
        seen = set()
        for i, x in enumerate(got):
            start = min(i * li.LENGTH, max(n - li.LENGTH, 0))
            assert x.tobytes().rstrip(b" ") == raw[start : start + li.LENGTH]
            seen.update(range(start, min(start + li.LENGTH, n)))
        assert seen == set(range(n))


def plain_probabilities(net, raw):
    """One uncut pass in either direction, byte by byte, in double precision."""
    sides = []
    for d in (0, 1):
        h, states = np.zeros(li.UNITS), []
        for byte in raw if d == 0 else raw[::-1]:
            z = net.table[d][byte].astype(float) + h @ net.recurrent[d]
            z = z / (1 + abs(z))
            gate = (1 + z[: li.UNITS]) / 2
            h = gate * h + (1 - gate) * z[li.UNITS :]
            states.append(h)
        sides.append(states if d == 0 else states[::-1])
    total, letters = np.zeros(len(net.labels)), 0
    for byte, left, right in zip(raw, *sides):
        if byte >= 128 or chr(byte).isalpha():
            p = np.exp(np.r_[left, right] @ net.out + net.bias)
            total, letters = total + p / p.sum(), letters + 1
    return total / max(letters, 1)


def test_scores_equal_an_uncut_pass(spark):
    net, rng = trained(), random.Random(5)
    texts = [text(lang, n, rng) + tail for lang in SYLLABLES for n in (1, 40, 400) for tail in ("", " 12.", " kor ciu tzk")]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in li.identify(df, net).collect()}
    for i, t in enumerate(texts):
        want = plain_probabilities(net, t.encode())
        assert abs(got[i][1] - want.max()) < 1e-3
        assert got[i][0] == net.labels[int(want.argmax())]


def test_sample_of_training_texts(spark):
    rng = random.Random(6)
    rows = [(i, None if i % 2 else " 12 ", "aa") for i in range(3000)]
    rows += [(i, text("aa", 12, rng), "aa") for i in range(5000, 5020)]
    rows += [(i, text("bb", 12, rng), "bb") for i in range(6000, 6400)]
    rows += [(7000, text("cc", 5000, rng), "cc"), (7001, text("cc", 9000, rng), "cc")]
    rows += [rows[-3]] * 300  # one row often
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    got = {}
    for r in li.training_windows(docs, 150, 1 << 14).collect():
        got.setdefault(r["lang"], []).append(bytes(r["window"]))
    size = lambda t: len(li.windows_of(t))
    assert len(got["aa"]) == sum(size(t) for i, t, _ in rows if 5000 <= i < 5020)
    assert sum(map(len, got["bb"])) <= (1 << 14) + 150 * li.LENGTH and len(got["bb"]) > 50
    # All texts of this language are above the limit: the shortest is taken, and taken whole.
    assert len(got["cc"]) == size(next(t for i, t, _ in rows if i == 7000))
    assert li.fit(docs.filter("lang = 'aa'")).labels == ["aa"]
    assert li.training_windows(docs.filter("doc_id < 3000")).count() == 0
