import random

import numpy as np

from depthframe.llm import fm_index as fm


def test_rank_and_search_against_counting():
    rng = np.random.default_rng(1)
    for size, top in ((1, 1), (70, 3), (300, 40), (513, 1)):
        values = rng.integers(0, top + 1, size)
        tree = fm.WaveletMatrix(values, top)
        symbols = rng.integers(0, top + 1, 50)
        at = rng.integers(0, size + 1, 50)
        got = tree.rank(symbols, at, tree.starts(symbols))
        assert got.tolist() == [int((values[:p] == c).sum()) for c, p in zip(symbols, at)]


def brute(texts, owners, width):
    out = []
    for text, own in zip(texts, owners):
        for j in range(len(text) - width + 1):
            window = text[j : j + width]
            out.append(any(
                o < own and any(other[i : i + width] == window for i in range(len(other) - width + 1))
                for other, o in zip(texts, owners)
            ))
    return out


def test_matched_windows_equal_brute_force():
    rng = random.Random(7)
    for _ in range(120):
        width, top = rng.randrange(2, 8), rng.randrange(1, 6)
        texts = []
        for _ in range(rng.randrange(1, 9)):
            text = [rng.randrange(1, top + 1) for _ in range(rng.randrange(0, 30))]
            if texts and rng.random() < 0.6:
                other = rng.choice(texts)
                a = rng.randrange(0, len(other) + 1)
                text = text[: rng.randrange(0, 6)] + other[a : a + rng.randrange(0, 25)] + text[:4]
            texts.append(text)
        owners = [rng.randrange(0, 6) for _ in texts]
        symbols = np.array([c for t in texts for c in [*t, 0]], np.int64)
        length = np.array([len(t) for t in texts])
        start = np.cumsum(length + 1) - length - 1
        owner = np.repeat(owners, length + 1)
        index = fm.FMIndex(symbols, owner, width)
        got = fm.matched_windows(index, symbols, start, length, np.array(owners), width)
        assert got.tolist() == brute(texts, owners, width)
