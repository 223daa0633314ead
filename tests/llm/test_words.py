import re

import numpy as np
import pyarrow as pa

from depthframe.llm import words as w

TEXTS = ["", None, "a b  c", " lead and trail ", "été\tx\ny\x0bz\x00q", "w" * 9000 + " " + "w" * 9001, "one", "one", "\n"]


def test_words_match_a_regular_expression():
    got = w.split_words(pa.array(TEXTS))
    table = {}
    for i, text in enumerate(TEXTS):
        expected = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        low, high = got.offsets[i], got.offsets[i + 1]
        assert high - low == len(expected)
        for word, h in zip(expected, got.hashes[low:high].tolist()):
            assert table.setdefault(word, h) == h
    assert len(set(table.values())) == len(table)


def test_slices_keep_all_rows_and_offsets():
    batch = pa.RecordBatch.from_arrays([pa.array(TEXTS), pa.array(range(len(TEXTS)))], ["t", "i"])
    parts = list(w.slices(iter([batch, batch.slice(2)]), "t", 10))
    assert [i for p in parts for i in p["i"].to_pylist()] == [*range(9), *range(2, 9)]
    whole = w.split_words(batch["t"]).hashes.tolist()
    assert [h for p in parts[: len(parts)] for h in w.split_words(p["t"]).hashes.tolist()][: len(whole)] == whole


def test_lower_case_and_stems():
    got = w.split_words(pa.array(["Abcdef ABCDEX, abc"]), w.NOT_WORD, w.LOWER, (5,))
    stem = got.stems[5]
    assert len(got.hashes) == 3 and stem[0] == stem[1] != stem[2]


def test_grams_are_equal_only_for_equal_runs():
    got = w.split_words(pa.array(["a b c d e f", "x b c d e y", "a b", "b c d e"]))
    for k in (1, 2, 3, 4, 5, 7, 16):
        grams, valid = w.gram_hashes(got.hashes, k), w.gram_valid(got.offsets, k)
        assert len(grams) == len(valid)
        expected = sum(max(0, n - k + 1) for n in np.diff(got.offsets))
        assert valid.sum() == expected
        runs = {}
        for i in range(len(grams)):
            assert runs.setdefault(tuple(got.hashes[i : i + k]), grams[i]) == grams[i]
        assert len(set(runs.values())) == len(runs)
