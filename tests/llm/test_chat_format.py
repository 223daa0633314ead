from depthframe.llm import chat_format as cf

SCHEMA = "conv_id bigint, turn bigint, role string, text string"


def shown(role, text):
    return f"<|{role or 'unknown'}|>\n{text or ''}\n<|end|>\n"


def check(row, chosen, rejected):
    order = lambda ts: sorted(ts, key=lambda t: (t[0] is None, t[0] or 0, t[1] or "unknown", t[2] or ""))
    c, r = order(chosen), order(rejected)
    n = 0
    while n < min(len(c), len(r)) and (c[n][1] or "unknown", c[n][2] or "") == (r[n][1] or "unknown", r[n][2] or ""):
        n += 1
    assert row["n_common"] == n
    assert row["prompt"] == "".join(shown(*t[1:]) for t in c[:n])
    for name, rest in (("chosen", c[n:]), ("rejected", r[n:])):
        assert row[name] == "".join(shown(*t[1:]) for t in rest)
        learned = [row[name][s["start"] : s["start"] + s["length"]] for s in row[f"{name}_spans"]]
        assert learned == [t[2] or "" for t in rest if t[1] == "assistant"]


def test_pairs_equal_a_plain_version(spark):
    both = {
        1: ([(0, "user", "hi"), (1, "assistant", "é a")], [(0, "user", "hi"), (1, "assistant", "b")]),
        2: ([(1, "assistant", "x"), (0, "system", "s")], [(0, "system", "s"), (1, "assistant", "x")]),
        3: ([(0, "user", "only chosen")], []),
        4: ([], [(0, None, None), (None, "assistant", "late")]),
        5: ([(0, "user", None), (0, "user", None), (1, "assistant", "z" * 50_000)], [(0, "user", ""), (2, "assistant", "q")]),
        6: ([(0, "user", "a"), (1, "assistant", "b"), (2, "user", "c")], [(0, "user", "a"), (1, "assistant", "b")]),
        None: ([(0, "user", "n")], [(0, "user", "m")]),
    }
    chosen = spark.createDataFrame([(k, *t) for k, (c, _) in both.items() for t in c], SCHEMA)
    rejected = spark.createDataFrame([(k, *t) for k, (_, r) in both.items() for t in r], SCHEMA)
    rejected = rejected.withColumn("x", rejected["turn"]).withColumn("key", rejected["role"])
    got = cf.preference_pairs(chosen, rejected).collect()
    assert len(got) == len(both)
    for row in got:
        check(row, *both[row["conv_id"]])


def test_stale_answers(spark):
    rows = [(1, 0, "user", "q"), (1, 1, "assistant", "one"), (1, 2, "user", "r"), (1, 3, "assistant", "two"),
            (2, 0, "user", "q"), (2, 1, "assistant", "solo"), (3, 0, "user", "none")]
    got = {(r["conv_id"], r["turn"]): r["text"] for r in cf.stale_answers(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got[1, 3] == "one" and got[1, 1] == "one" and got[2, 1] == "" and got[3, 0] == "none" and len(got) == 7


def test_empty_table(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert cf.preference_pairs(empty, empty).count() == 0
