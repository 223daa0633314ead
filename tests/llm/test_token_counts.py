import random

import pytest
from tokenizers import Tokenizer, models

from depthframe.llm import token_counts as tc


@pytest.fixture(scope="module")
def counter():
    return tc.UnitCounts.from_file(tc.VOCABULARY)


def reference(counter, text):
    """The same vocabulary in a public unigram tokenizer, over the whole text at once."""
    pieces = [(p, counter.automaton.get(p)[1]) for p in counter.automaton]
    vocab = [("<unk>", -1e9), *[(f"<0x{i:02X}>", -1e9) for i in range(256)], *pieces]
    tokenizer = Tokenizer(models.Unigram(vocab, unk_id=0, byte_fallback=True))
    return tokenizer, text


def test_counts_equal_a_unigram_tokenizer(counter):
    tokenizer, _ = reference(counter, "")
    rng = random.Random(5)
    parts = ["the", "ation", " ", "  ", "é", "ñ", "\n", "中文", "😀", "Zz", "q", ".", "1", "\t", "▁", "xxxxxxxxxx", "ing"]
    for _ in range(300):
        text = "".join(rng.choice(parts) for _ in range(rng.randrange(0, 40)))
        marked = tc.MARK + text.replace(" ", tc.MARK) if text else ""
        assert counter.text(text) == len(tokenizer.encode(marked).ids), repr(text)


def test_long_and_empty_texts(counter):
    assert counter.text(None) == counter.text("") == 0
    assert counter.text("a" * 200_000) > 0


def test_ties_go_to_the_piece_that_starts_first():
    own = tc.UnitCounts({"a": -1.0, "b": -1.0, "ab": -2.0, "c": -1.0, "bc": -2.0, tc.MARK: 0.0}, False)
    assert own.segment("ab") == 1
    assert own.segment("abc") == 2  # a + bc: of the pieces that end the text, bc starts before c
    assert own.segment("zz") == 1 and own.segment("zaz") == 3


def test_rows(spark):
    rows = [(1, "the end", "x"), (1, "the end", "y"), (None, None, None), (4, "", "z")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, n_tokens string")
    got = tc.count_tokens(df).collect()
    assert sorted([(r[0] or 0, r[1]) for r in got])[0] == (0, 0) and len(got) == 4
    assert tc.count_tokens(df.limit(0)).count() == 0
