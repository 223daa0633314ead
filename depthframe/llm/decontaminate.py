"""Benchmark decontamination: BM25 over an index of test items, block-max pruning, then verification.

The test items are the indexed side, the training passages are the queries. A document is cut
into overlapping passages of two half passages each (``HALF`` words), so that every run of ``HALF``
words lies in one of them; items longer than that are indexed in about equal parts. BM25 weights
are divided by the part's score against itself, so that one threshold serves all items.

For every passage the distinct index terms are looked up and their largest weights in each block
of ``BLOCK`` parts are summed. Only (passage, block) pairs whose bound reaches the threshold
are scored exactly; no passage above the threshold can be missed.
Retrieved pairs are verified by the share of five-word shingles of the item's question and answer
(its last sentence) that the passage holds.

BM25 statistics are those of the whole benchmark, counted by Spark, so a score does not depend on the
group an item is in. Documents stay in their tasks: no shuffle, one pass. Items are cut into parts by
Spark and indexed ``GROUP`` parts at a time, as sparse postings. The driver builds and sends one
group after another, a task holds one at a time; an item may lie in several groups.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from depthframe.llm import words as w
from depthframe.llm.common import stored, table

HALF, BLOCK, SHINGLE = 64, 8, 5
#: Parts in a group: at most ``HALF`` times as many postings.
GROUP = 4096
K1, B = 1.2, 0.75
THRESHOLD = 0.6
#: Block maxima and sums at hand at a time.
STEP = 1 << 22
#: Room for rounding in the sums of single-precision bounds.
SLACK = 1e-4
OVERLAP = 0.5


def grams(hashes: np.ndarray) -> np.ndarray:
    """Distinct five-word shingles; of fewer words the whole sequence; of none nothing."""
    return np.unique(w.gram_hashes(hashes, min(SHINGLE, len(hashes)))) if len(hashes) else hashes


@dataclass
class Part:
    item: int
    words: np.ndarray
    question: np.ndarray
    answer: np.ndarray


def item_parts(item: int, text: str | None) -> list[Part]:
    """An item's question and answer words, cut into parts of at most ``HALF`` words."""
    sentences = [s for s in re.split(r"[.!?\n]+", text or "") if len(w.split_words(pa.array([s]), w.NOT_WORD).hashes)]
    hashed = w.split_words(pa.array(sentences, pa.string()), w.NOT_WORD, w.LOWER)
    n = len(hashed.hashes)
    if not n:
        return []
    border = int(hashed.offsets[-2]) if len(sentences) > 1 else (n + 1) // 2
    cuts = np.linspace(0, n, -(-n // HALF) + 1).astype(int)
    out = []
    for low, high in zip(cuts[:-1], cuts[1:]):
        at = min(max(border, low), high)
        out.append(Part(item, hashed.hashes[low:high], grams(hashed.hashes[low:at]), grams(hashed.hashes[at:high])))
    return out


@dataclass
class Totals:
    """Of the whole benchmark: parts, their words, and the parts that hold a term."""

    parts: int
    words: int
    spread: dict[int, int]


class Index:
    """Postings: BM25 weights of the parts by term, and their maxima by block of parts.

    Those of term ``i`` are ``first[i]:first[i + 1]``, its maxima ``block_first[i]:block_first[i + 1]``.
    """

    def __init__(self, items: list[tuple[int, str | None]]):
        parts = [p for item, text in items for p in item_parts(item, text)]
        spread = Counter(t for p in parts for t in set(p.words.tolist()))
        self._fill(parts, Totals(len(parts), sum(len(p.words) for p in parts), spread))

    @classmethod
    def of(cls, parts: list[Part], totals: Totals) -> Index:
        """Index over some parts of a benchmark; ``totals`` covers their terms at least."""
        out = cls.__new__(cls)
        out._fill(parts, totals)
        return out

    def _fill(self, parts: list[Part], totals: Totals) -> None:
        self.parts = parts
        mean = totals.words / max(1, totals.parts)
        terms, weights = [np.zeros(0, w.U64)], [np.zeros(0)]
        for part in parts:
            term, count = np.unique(part.words, return_counts=True)
            spread = np.array([totals.spread[t] for t in term.tolist()])
            long = K1 * (1 - B + B * len(part.words) / mean)
            weight = np.log(1 + (totals.parts - spread + 0.5) / (spread + 0.5)) * count * (K1 + 1) / (count + long)
            terms.append(term)
            weights.append(weight / weight.sum())
        at = np.repeat(np.arange(len(parts)), [len(t) for t in terms[1:]])
        term, weight = np.concatenate(terms), np.concatenate(weights).astype(np.float32)
        order = np.lexsort((at, term))
        self.part, self.weight = at[order].astype(np.int32), weight[order]
        self.terms, first, size = np.unique(term[order], return_index=True, return_counts=True)
        self.first = np.r_[first, len(order)]
        self.blocks = -(-len(parts) // BLOCK)
        key = np.repeat(np.arange(len(self.terms)), size) * self.blocks + self.part // BLOCK
        key, start = np.unique(key, return_index=True)
        self.block = (key % max(1, self.blocks)).astype(np.int32)
        self.most = np.maximum.reduceat(self.weight, start) if len(start) else self.weight
        self.block_first = np.searchsorted(key, np.arange(len(self.terms) + 1) * self.blocks)
        self.present = np.zeros(1 << 16, bool)
        self.present[(self.terms >> w.U64(48)).astype(int)] = True

    def lookup(self, hashes: np.ndarray) -> np.ndarray:
        """Number of each word's term; one past the last for words outside the index."""
        out = np.full(len(hashes), len(self.terms))
        maybe = np.flatnonzero(self.present[(hashes >> w.U64(48)).astype(np.int64)])
        h = hashes[maybe]
        at = np.minimum(np.searchsorted(self.terms, h), max(0, len(self.terms) - 1))
        hit = self.terms[at] == h if len(self.terms) else np.zeros(len(h), bool)
        out[maybe[hit]] = at[hit]
        return out

    def retrieve(self, got: w.Words) -> list[tuple[int, int, int, int, float]]:
        """(text, first word, last word, part, score) of every passage and part at the threshold."""
        if not self.parts or not len(got.hashes):
            return []
        sizes = np.diff(got.offsets)
        halves = -(-sizes // HALF)
        text = np.repeat(np.arange(len(sizes)), halves)
        first = np.cumsum(halves) - halves
        nth = np.arange(len(text)) - first[text]
        low = got.offsets[:-1][text] + nth * HALF
        starts = (nth < halves[text] - 1) | (halves[text] == 1)  # others lie in the passage before
        term = self.lookup(got.hashes)
        inside = np.flatnonzero(term < len(self.terms))
        half, term = np.searchsorted(low, inside, "right") - 1, term[inside]
        own, before = starts[half], nth[half] > 0
        size = len(self.terms)
        pair = np.concatenate([half[own] * size + term[own], (half[before] - 1) * size + term[before]])
        pair = np.unique(pair)
        passage, term = pair // size, pair % size
        full, edges = np.unique(passage, return_index=True)
        edges = np.r_[edges, len(passage)]
        cost = np.r_[0, np.cumsum(self.block_first[term + 1] - self.block_first[term])][edges]
        wide = max(1, STEP // self.blocks)
        out, a = [], 0
        while a < len(full):
            b = max(a + 1, min(int(np.searchsorted(cost, cost[a] + STEP, "right")) - 1, a + wide))
            terms = term[edges[a] : edges[b]]
            low_block, high_block = self.block_first[terms], self.block_first[terms + 1]
            at = ranges(low_block, high_block)
            near = np.repeat(np.repeat(np.arange(b - a), np.diff(edges[a : b + 1])), high_block - low_block)
            bound = np.bincount(near * self.blocks + self.block[at], self.most[at], (b - a) * self.blocks)
            open_blocks = bound.reshape(b - a, self.blocks) >= THRESHOLD - SLACK
            for i in np.flatnonzero(open_blocks.any(1)):
                p, terms = full[a + i], term[edges[a + i] : edges[a + i + 1]]
                at = ranges(self.first[terms], self.first[terms + 1])
                at = at[open_blocks[i][self.part[at] // BLOCK]]
                score = np.bincount(self.part[at], self.weight[at])
                for j in np.flatnonzero(score >= THRESHOLD):
                    end = min(int(low[p]) + 2 * HALF, int(got.offsets[text[p] + 1]))
                    out.append((int(text[p]), int(low[p]), end, int(j), float(score[j])))
            a = b
        return out

    def leaks(self, column: pa.Array) -> list[tuple[int, int, int, float, float, float]]:
        return leaks([self], column)


def leaks(indexes: Iterable[Index], column: pa.Array) -> list[tuple[int, int, int, float, float, float]]:
    """(text, item, passage, score, question share, answer share), the best passage of each pair."""
    got = w.split_words(column, w.NOT_WORD, w.LOWER)
    best: dict[tuple[int, int], tuple] = {}
    for index in indexes:
        for text, low, high, at, score in index.retrieve(got):
            part, held = index.parts[at], got.hashes[low:high]
            question, answer = share(part.question, held), share(part.answer, held)
            if question >= OVERLAP and answer >= OVERLAP:
                nth = int(low - got.offsets[text]) // HALF
                row = (score, question, answer, -nth)
                if row > best.get((text, part.item), (0,)):
                    best[text, part.item] = row
    return [(t, i, -r[3], *r[:3]) for (t, i), r in sorted(best.items())]


def ranges(low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """The numbers of all ranges ``low[i]:high[i]``, one after another."""
    size = high - low
    return np.arange(size.sum()) + np.repeat(low - (np.cumsum(size) - size), size)


def share(wanted: np.ndarray, held: np.ndarray) -> float:
    """Share of the distinct shingles ``wanted`` that occur in the words ``held``; 1 if none is wanted."""
    if not len(wanted):
        return 1.0
    found = np.zeros(len(wanted), bool)
    for k in range(1, SHINGLE + 1):
        if len(held) >= k:
            found |= np.isin(wanted, w.gram_hashes(held, k))
    return float(found.mean())


def part_table(benchmark: DataFrame, item_col: str, text_col: str) -> DataFrame:
    """A row for each part of the items, stored: ``item``, a number ``part``, and hashes as signed integers."""
    names = ["item", "words", "question", "answer"]
    rows = benchmark.select(F.col(f"`{item_col}`").cast("bigint").alias("item"), F.col(f"`{text_col}`").alias("text"))

    def cut(batches):
        for batch in batches:
            for item, text in zip(batch["item"].to_pylist(), batch["text"].to_pylist()):
                parts = item_parts(item, text)
                lists = [[getattr(p, k).view(np.int64) for p in parts] for k in names[1:]]
                hashes = [pa.array(x, pa.list_(pa.int64())) for x in lists]
                yield pa.RecordBatch.from_arrays([pa.array([item] * len(parts), pa.int64()), *hashes], names)

    schema = "item bigint, words array<bigint>, question array<bigint>, answer array<bigint>"
    parts = rows.filter(F.col("item").isNotNull()).mapInArrow(cut, schema)
    return stored(parts.withColumn("part", F.monotonically_increasing_id()))


def item_groups(benchmark: DataFrame, item_col: str = "item_id", text_col: str = "text") -> Iterator[Index]:
    """Indexes over ``GROUP`` parts each, in order of the items' ids, each made when it is asked for."""
    parts = part_table(benchmark, item_col, text_col)
    n, words = parts.agg(F.count(F.lit(1)), F.sum(F.size("words"))).first()
    terms = parts.select("part", F.explode(F.array_distinct("words")).alias("term"))
    spread = terms.groupBy("term").agg(F.count(F.lit(1)).alias("n"))
    known = terms.join(spread, "term").groupBy("part").agg(F.collect_list(F.struct("term", "n")).alias("spread"))
    rows = parts.join(known, "part").orderBy("item", "part")
    for group in _grouped(rows.toLocalIterator()):
        held = [Part(r["item"], *(np.array(r[k], np.int64).view(w.U64) for k in ("words", "question", "answer"))) for r in group]
        yield Index.of(held, Totals(n, words, {t % 2**64: k for r in group for t, k in r["spread"]}))


def _grouped(rows):
    group = []
    for r in rows:
        group.append(r)
        if len(group) == GROUP:
            yield group
            group = []
    if group:
        yield group


def sent_groups(benchmark: DataFrame) -> list[Broadcast]:
    """All groups as broadcasts, which Spark keeps on disk where memory is short; the driver makes one at a time."""
    return [benchmark.sparkSession.sparkContext.broadcast(index) for index in item_groups(benchmark)]


def received(sent: list[Broadcast]) -> Iterator[Index]:
    """The groups in a task, where a single one is kept and several are read anew each time."""
    for one in sent:
        path = getattr(one, "_path", None)  # not with encryption
        yield one.value if len(sent) == 1 or path is None else one.load_from_path(path)


def find_leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Verified pairs: id, ``item_id``, ``passage`` (number of its first half), ``score`` and both shares.

    One row per row of ``docs`` and item with a verified passage, the best-scoring one. Null and
    empty texts or items match nothing, nor do items with a null id; an item of fewer than five
    words is one shingle per side. Repeated rows give repeated pairs.
    """
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    schema = f"id {kind}, item_id bigint, passage bigint, score double, question double, answer double"
    names = ["id", "item_id", "passage", "score", "question", "answer"]
    sent = sent_groups(benchmark)

    def run(batches):
        for part in w.slices(batches, "text"):
            found = list(zip(*leaks(received(sent), part["text"])))
            if found:
                ids = part["id"].take(pa.array(found[0], pa.int64()))
                kinds = [pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64()]
                rest = [pa.array(x, k) for x, k in zip(found[1:], kinds)]
                yield pa.RecordBatch.from_arrays([ids, *rest], names)

    return rows.mapInArrow(run, schema).withColumnRenamed("id", id_col)


def drop_leaks(docs: DataFrame, benchmark: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` without a verified passage, unchanged and in their partitions."""
    sent = sent_groups(benchmark)

    def run(batches):
        for part in w.slices(batches, text_col):
            keep = np.ones(part.num_rows, bool)
            keep[[x[0] for x in leaks(received(sent), part[text_col])]] = False
            yield part.filter(pa.array(keep))

    return docs.mapInArrow(run, docs.schema)


def op2_decontaminate(spark, sf_dir: str) -> DataFrame:
    return find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
