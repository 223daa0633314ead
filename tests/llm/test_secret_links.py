import hashlib
import random
import re

from depthframe.llm import secret_links as sl

KEY = "AKIA" + "Q7" * 8
RANDOM = "wJalrXUtnFEMI7MDENGbPxRfiCYEXAMPLEKEY"
HEX = "0a1b2c3d4e5f60718293a4b5"

#: The patterns of the contract, letters in either case written out by a plain loop below.
BASE = {
    "assign": (r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 2, 6),
    "access": (r"AKIA[A-Z0-9]+", 0, 20),
    "hex": (r"[0-9a-f]+", 0, 24),
}


def plain_base(text):
    out = []
    for kind, (pattern, group, least) in BASE.items():
        flags = re.IGNORECASE | re.ASCII if kind == "assign" else 0
        for m in re.finditer(pattern, text, flags):
            if m.end(group) - m.start(group) >= least:
                out.append((m.start(), sl.KINDS.index(kind), m.end()))
    return sorted(out)


def plain(text):
    """All pairs of parts within every scope, one by one."""
    text = text or ""
    base = [(s, e, sl.KINDS[k]) for s, k, e in plain_base(text)]
    parts = base + sl.weak_spans(text, base)
    ends = [m.end() for m in sl.SCOPE_END.finditer(text)]
    scope = lambda p: sum(p[0] >= e for e in ends)

    def near(p, kinds):
        return any(
            q is not p and q[2] in kinds and scope(p) == scope(q) and q[0] <= p[1] + sl.REACH and q[1] >= p[0] - sl.REACH
            for q in parts
        )

    ids, secrets = ("access", "identifier"), ("assign", "hex", "secret")
    said = [
        p for p in parts
        if p[2] in sl.BASE
        or (p[2] == "identifier" and near(p, secrets))
        or (p[2] == "secret" and near(p, ids))
        or (p[2] == "endpoint" and near(p, ids) and near(p, secrets))
    ]
    return sorted((s, sl.KINDS.index(k), e) for s, e, k in said)


CASES = [
    None, "", "plain words only", f"key {KEY} then {RANDOM}", f"{RANDOM} alone", f"{KEY}\n\n{RANDOM} far",
    f"user = bob\npassword: abc\nhttps://db.example.org/x", "user = bob and nothing else", "https://example.org/only",
    f"TOKEN='{RANDOM}' passwd = short token=abc", f"user: al {'x ' * 200} {RANDOM}", f"{HEX} {HEX.upper()} {HEX}{HEX}",
    "ſecret=abcdefgh toKen=abcdefgh", f"é😀 api_key=abcdef {KEY}", "secret=a secret=bcdefgh", f"login=me {RANDOM} db.example.org:5432",
    f"AKIAABCDEFGHIJKLMN token: {RANDOM}", f"password=secret=abcdef", "user=aaa " * 3000 + RANDOM, f"https://h/?token=abcdef9&user_id=77",
]


def test_base_and_links_equal_a_plain_version():
    rng = random.Random(4)
    pieces = [
        "user=bob", "client_id: 77x", KEY, RANDOM, "password = hunter22", "token=ab", HEX, "https://a.b/c?d", "h.example.org:99", "\n\n",
        "\n", "word " * 20, "é" * 30, "\n \n",
    ]
    texts = CASES + [" ".join(rng.choice(pieces) for _ in range(rng.randrange(1, 25))) for _ in range(200)]
    got = sl.batch_spans(texts)
    for text, spans in zip(texts, got):
        assert spans == plain(text), text
        assert [x for x in spans if x[1] < 3] == plain_base(text or ""), text


def test_weak_parts_need_company():
    kinds = lambda text: [sl.KINDS[k] for _, k, _ in sl.batch_spans([text])[0]]
    assert kinds(f"{RANDOM} alone") == [] and kinds("user = bob") == [] and kinds("https://example.org/only") == []
    assert kinds(f"user = bob {RANDOM}") == ["identifier", "secret"]
    assert kinds(f"user = bob\n\n{RANDOM}") == []
    assert kinds(f"user = bob {'x ' * 200}{RANDOM}") == []
    assert kinds("user = bob\npassword: abc\nhttps://db.example.org/x") == ["identifier", "secret", "endpoint"]


def test_rows_and_digest(spark, tmp_path):
    rows = [(i, t, "x") for i, t in enumerate(CASES)] + [(None, CASES[3], "y"), (3, CASES[3], "z"), (77, "token=abcdef " * 50_000, "w")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, found string")
    df.write.parquet(f"{tmp_path}/documents.parquet")
    got = sl.op13_secret_links(spark, str(tmp_path)).collect()
    assert len(got) == len(rows)

    def written(spans):
        return ",".join(f"{sl.KINDS[k]}:{s}:{e}" for s, k, e in spans)

    want = []
    for i, t, _ in rows:
        base = plain_base(t or "")
        n = [sum(k == j for _, k, _ in base) for j in range(3)]
        spans = written(sl.batch_spans([t])[0])
        want.append((i, *n, hashlib.sha256(written(base).encode()).hexdigest(), spans))
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))
    assert sl.secret_spans(df.limit(0)).count() == 0
