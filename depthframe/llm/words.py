"""Words and word hashes of many texts at once, with numpy over Arrow buffers.

Hashing is multilinear: a word's hash is the sum of (value of byte) x (value of position) over its
bytes, modulo 2**64, then mixed. All values come from one fixed generator, so every task agrees.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

U64 = np.uint64
_SPAN = 4096


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def _values(seed: int, n: int) -> np.ndarray:
    steps = np.arange(1, n + 1, dtype=U64) * U64(0x9E3779B97F4A7C15)
    return mix(steps + U64(seed)) | U64(1)


BYTE_VALUE = _values(11, 256)
POSITION_VALUE = _values(12, _SPAN)
STEP = U64(0x2545F4914F6CDD1D)

#: Tables of 256: which bytes separate words, and what a byte counts as.
BLANK = np.zeros(256, bool)
BLANK[[0x20, *range(0x09, 0x0E)]] = True
SAME = np.arange(256, dtype=np.uint8)
LOWER = SAME.copy()
LOWER[ord("A") : ord("Z") + 1] += 32
#: All but ASCII letters, digits and bytes of other characters separate words.
NOT_WORD = np.ones(256, bool)
NOT_WORD[128:] = False
for _lo, _hi in ("09", "AZ", "az"):
    NOT_WORD[ord(_lo) : ord(_hi) + 1] = False


@dataclass
class Words:
    """Words of several texts: ``offsets[i]:offsets[i + 1]`` are those of text ``i``."""

    hashes: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    offsets: np.ndarray
    stems: dict[int, np.ndarray]

    def __len__(self) -> int:
        return len(self.offsets) - 1


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column and the offset of each text; null texts are empty."""
    column = column.cast(pa.large_string()).fill_null("")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def split_words(
    column: pa.Array, separators: np.ndarray = BLANK, counts_as: np.ndarray = SAME, stems: tuple[int, ...] = ()
) -> Words:
    """Words of each text; ``stems`` asks for hashes of that many leading bytes as well."""
    raw, at = text_bytes(column)
    inside = ~separators[raw]
    before, after = np.zeros(len(raw), bool), np.zeros(len(raw), bool)
    before[1:], after[:-1] = inside[:-1], inside[1:]
    edge = at[1:-1]
    before[edge[edge < len(raw)]] = False
    after[edge[edge > 0] - 1] = False
    starts = np.flatnonzero(inside & ~before)
    ends = np.flatnonzero(inside & ~after) + 1
    offsets = np.searchsorted(starts, at)
    if not len(starts):
        none = np.zeros(0, U64)
        return Words(none, starts, ends, offsets, {n: none for n in stems})
    lengths = ends - starts
    first = np.cumsum(lengths) - lengths
    place = np.arange(first[-1] + lengths[-1]) - np.repeat(first, lengths)
    value = BYTE_VALUE[counts_as[raw[inside]]] * POSITION_VALUE[place % _SPAN]
    if lengths.max() > _SPAN:
        far = _values(13, int(lengths.max()) // _SPAN + 1)
        far[0] = 1
        value *= far[place // _SPAN]
    size = lengths.astype(U64) * STEP
    heads = {}
    for n in stems:
        heads[n] = mix(np.add.reduceat(np.where(place < n, value, U64(0)), first) + U64(n))
    return Words(mix(np.add.reduceat(value, first) + size), starts, ends, offsets, heads)


def gram_hashes(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hash of every ``k`` consecutive values, by doubling; crosses text borders, see :func:`gram_valid`."""
    if len(hashes) < k:
        return np.zeros(0, U64)
    power, span, wide = STEP, 1, hashes
    out, have = None, 0
    n = len(hashes) - k + 1
    while True:
        if k & span:
            part = wide[have : have + n]
            out, have = part.copy() if out is None else out * power + part, have + span
        if 2 * span > k:
            return mix(out + U64(k))
        wide = wide[:-span] * power + wide[span:]
        power, span = U64(int(power) ** 2 % 2**64), 2 * span


def gram_valid(offsets: np.ndarray, k: int) -> np.ndarray:
    """Which of the grams of :func:`gram_hashes` lie inside one text."""
    total = int(offsets[-1])
    good = np.ones(max(0, total - k + 1), bool)
    for j in range(1, k):
        late = offsets[1:] - j
        late = late[(late >= 0) & (late < len(good))]
        good[late] = False
    return good


def slices(batches: Iterator[pa.RecordBatch], text: str, size: int = 1 << 22) -> Iterator[pa.RecordBatch]:
    """Cut batches into runs of rows of about ``size`` bytes of text; a longer text goes alone."""
    for batch in batches:
        ends = text_bytes(batch[text])[1]
        low = 0
        while low < batch.num_rows:
            high = int(np.searchsorted(ends, ends[low] + size, "right")) - 1
            high = min(max(high, low + 1), batch.num_rows)
            yield batch.slice(low, high - low)
            low = high
