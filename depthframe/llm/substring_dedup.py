"""Substring de-duplication with an FM-index per shard.

A window is ``WINDOW`` consecutive words of one document. Windows that also start in a document with
a smaller id are found, and the words they cover are removed. To avoid holding every document
against every index, texts are routed by content:

1. Every window names one of its ``GRAM``-word grams, the one with the smallest hash (the leftmost of
   equals). Equal windows name equal grams. Grams named in one document only are dropped; a
   document learns which of its own are left.
2. Runs of windows that name the same remaining gram are cut out as segments and sent to the shard
   of that gram. Of equal segments only the one of the smallest id is sent by a task, the others
   are known to match. Grams of more than ``HOT`` documents send windows one by one, to shards that
   depend on the window's first half too, so that no shard receives all surroundings of a
   frequent passage.
3. Each shard builds an FM-index of its distinct segments and runs matching statistics of each
   against it: the backward search over a wavelet matrix goes on while the match occurs in a
   smaller document; matches of at least ``WINDOW`` words are reported as intervals.

Words are told apart by 64-bit hashes (48 bits in the shards). Null ids count as larger than all.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from depthframe.llm import bloom
from depthframe.llm import words as w
from depthframe.llm.common import stored, table
from depthframe.llm.fm_index import FMIndex, matched_windows

WINDOW, GRAM = 50, 12
HOT = 20_000
SHARD_GRAMS, SHARD_WORDS = 1_000_000, 700_000
FLUSH_WORDS = 1_000_000
LAST = np.iinfo(np.int64).max
U64 = w.U64


def named_grams(got: w.Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First word of every window, and the place and hash of the gram that it names."""
    span = WINDOW - GRAM + 1
    windows = np.flatnonzero(w.gram_valid(got.offsets, WINDOW))
    if not len(windows):
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(0, U64)
    grams = w.gram_hashes(got.hashes, GRAM)
    least = (grams >> U64(32) << U64(32)) | np.arange(len(grams), dtype=U64)
    done = 1
    while 2 * done <= span:
        least = np.minimum(least[:-done], least[done:])
        done *= 2
    least = np.minimum(least[: len(least) - (span - done)], least[span - done :])
    place = (least[windows] & U64(0xFFFFFFFF)).astype(np.int64)
    return windows, place, grams[place]


def gram_codes(grams: np.ndarray, shards: int) -> np.ndarray:
    """Shard and 32 further bits of a gram in one number."""
    spread = w.mix(grams)
    return ((spread % U64(shards)) << U64(32)) | ((spread // U64(shards)) & U64(0xFFFFFFFF))


def _flushed(batches, width: int, run):
    """Call ``run`` with runs of slices that hold about ``FLUSH_WORDS`` words."""
    held, n = [], 0
    for part in w.slices(batches, "text"):
        got = w.split_words(part["text"])
        held.append((part, got))
        n += len(got.hashes)
        if n >= FLUSH_WORDS:
            yield from run(held)
            held, n = [], 0
    if held:
        yield from run(held)


def _grams_by_shard(rows: DataFrame, shards: int) -> DataFrame:
    """(shard, grams): 12 bytes for each distinct gram that a document names."""

    def run(held):
        code, owner = [], []
        for part, got in held:
            windows, place, gram = named_grams(got)
            doc = np.searchsorted(got.offsets, windows, "right") - 1
            ids = part["order"].to_numpy()[doc]
            new = np.r_[True, (place[1:] != place[:-1])] if len(place) else np.zeros(0, bool)
            code.append(gram_codes(gram[new], shards))
            owner.append(ids[new])
        code, owner = np.concatenate(code), np.concatenate(owner)
        order = np.lexsort((owner, code))
        code, owner = code[order], owner[order]
        new = np.ones(len(code), bool)
        new[1:] = (code[1:] != code[:-1]) | (owner[1:] != owner[:-1])
        code, owner = code[new], owner[new]
        shard, at = np.unique(code >> U64(32), return_index=True)
        word = (code & U64(0xFFFFFFFF)).astype(np.uint32)
        ends = np.r_[at[1:], len(code)]
        blobs = [word[a:b].tobytes() + owner[a:b].tobytes() for a, b in zip(at, ends)]
        for low in range(0, len(blobs), 256):
            yield pa.RecordBatch.from_arrays(
                [pa.array(shard[low : low + 256].astype(np.int64)), pa.array(blobs[low : low + 256], pa.binary())],
                ["shard", "grams"],
            )

    return rows.select("order", "text").mapInArrow(
        lambda batches: _flushed(batches, GRAM, run), "shard bigint, grams binary"
    )


def _repeated(grams: DataFrame) -> DataFrame:
    """(order, codes, n): for each document of a shard, codes of its grams that others name too.

    Codes of hot grams have their highest bit set.
    """

    def run(group: pa.Table) -> pa.Table:
        words, owners = [], []
        for blob in group["grams"].to_pylist():
            n = len(blob) // 12
            words.append(np.frombuffer(blob, np.uint32, n))
            owners.append(np.frombuffer(blob, np.int64, n, 4 * n))
        word, owner = np.concatenate(words), np.concatenate(owners)
        order = np.lexsort((owner, word))
        word, owner = word[order], owner[order]
        new = np.ones(len(word), bool)
        new[1:] = (word[1:] != word[:-1]) | (owner[1:] != owner[:-1])
        word, owner = word[new], owner[new]
        start = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
        count = np.diff(np.r_[start, len(word)])
        shard = U64(group["shard"][0].as_py())
        code = (shard << U64(32)) | word.astype(U64)
        code |= np.repeat((count > HOT).astype(U64) << U64(63), count)
        keep = np.repeat(count > 1, count)
        code, owner = code[keep], owner[keep]
        order = np.argsort(owner, kind="stable")
        code, owner = code[order], owner[order]
        ids, at = np.unique(owner, return_index=True)
        ends = np.r_[at[1:], len(owner)].astype(np.int64)
        blobs = [code[a:b].tobytes() for a, b in zip(at, ends)]
        return pa.table([pa.array(ids), pa.array(blobs, pa.binary()), pa.array(ends - at)], ["order", "codes", "n"])

    return grams.groupBy("shard").applyInArrow(run, "order bigint, codes binary, n bigint")


_FIELDS = [("order", np.int64), ("mark", np.int64), ("start", np.int64), ("size", np.int64)]


def pack_segments(fields: list[np.ndarray], words: np.ndarray) -> bytes:
    """Length-prefixed arrays: owner, text mark, first word and size of each segment, then their words."""
    high, low = (words >> U64(32)).astype(np.uint32), ((words >> U64(16)) & U64(0xFFFF)).astype(np.uint16)
    parts = [np.int64(len(fields[0])).tobytes(), *(f.astype(np.int64).tobytes() for f in fields)]
    return b"".join([*parts, high.tobytes(), low.tobytes()])


def unpack_segments(blob: bytes) -> tuple[list[np.ndarray], np.ndarray]:
    n = int(np.frombuffer(blob, np.int64, 1)[0])
    fields = [np.frombuffer(blob, np.int64, n, 8 + 8 * n * i) for i in range(len(_FIELDS))]
    total, at = int(fields[3].sum()), 8 + 8 * n * len(_FIELDS)
    high = np.frombuffer(blob, np.uint32, total, at).astype(U64)
    return fields, (high << U64(32)) | (np.frombuffer(blob, np.uint16, total, at + 4 * total).astype(U64) << U64(16))


def ragged(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Indexes start[i], ..., start[i] + size[i] - 1, one run after the other."""
    before = np.cumsum(size) - size
    return np.arange(int(size.sum())) - np.repeat(before, size) + np.repeat(start, size)


def segment_hashes(words: np.ndarray, size: np.ndarray) -> np.ndarray:
    """A hash of each run of words; the runs follow each other in ``words``."""
    before = np.cumsum(size) - size
    place = (np.arange(len(words)) - np.repeat(before, size)).astype(U64)
    mixed = w.mix((words & ~U64(0xFFFF)) * (U64(2) * place + U64(1)) + place)
    return w.mix(np.add.reduceat(mixed, before) + size.astype(U64)) if len(size) else np.zeros(0, U64)


def _segments(docs: DataFrame, gram_shards: int, shards: int) -> DataFrame:
    """(shard, segments, order, mark, spans): segments by shard, or spans known to match already."""
    names = ["shard", "segments", "order", "mark", "spans"]

    def run(held):
        fields, words, route = [], [], []
        for part, got in held:
            windows, place, gram = named_grams(got)
            doc = np.searchsorted(got.offsets, windows, "right") - 1
            code = gram_codes(gram, gram_shards)
            mine = np.zeros(len(windows), np.int8)
            edges = np.searchsorted(doc, np.arange(len(got) + 1))
            for i, blobs in enumerate(part["codes"].to_pylist()):
                if edges[i + 1] > edges[i]:
                    own = np.frombuffer(b"".join(blobs), U64)
                    hot = own >> U64(63) == 1
                    here = code[edges[i] : edges[i + 1]]
                    mine[edges[i] : edges[i + 1]] = np.isin(here, own & U64(LAST)).astype(np.int8) + np.isin(
                        here, own[hot] & U64(LAST)
                    )
            keep = np.flatnonzero(mine)
            windows, place, doc, code, hot = windows[keep], place[keep], doc[keep], code[keep], mine[keep] == 2
            if not len(windows):
                continue
            new = np.ones(len(windows), bool)
            new[1:] = (place[1:] != place[:-1]) | (windows[1:] != windows[:-1] + 1) | hot[1:]
            first = np.flatnonzero(new)
            size = np.diff(np.r_[first, len(windows)]) + WINDOW - 1
            at, d = windows[first], doc[first]
            to = code[first]
            if hot.any():
                halves = w.gram_hashes(got.hashes, WINDOW // 2)[at] + (place[first] - at).astype(U64)
                to = np.where(hot[first], w.mix(to + w.mix(halves)), to)
            fields.append((part["order"].to_numpy()[d], part["mark"].to_numpy()[d], at - got.offsets[d], size))
            words.append(got.hashes[ragged(at, size)])
            route.append(w.mix(to))
        if not fields:
            return
        order, mark, start, size = (np.concatenate(x) for x in zip(*fields))
        words, route = np.concatenate(words), np.concatenate(route)
        content = segment_hashes(words, size)
        ranked = np.lexsort((order, content))
        lead = np.r_[True, content[ranked][1:] != content[ranked][:-1]]
        least = order[ranked][np.flatnonzero(lead)][np.cumsum(lead) - 1]
        sent = np.zeros(len(order), bool)
        sent[ranked] = order[ranked] == least
        yield from known(order[~sent], mark[~sent], start[~sent], size[~sent])
        at = np.cumsum(size) - size
        shard = (route % U64(shards)).astype(np.int64)
        pick = np.flatnonzero(sent)
        pick = pick[np.argsort(shard[pick], kind="stable")]
        to, cut = np.unique(shard[pick], return_index=True)
        for s, a, b in zip(to, cut, np.r_[cut[1:], len(pick)]):
            rows = pick[a:b]
            blob = pack_segments([x[rows] for x in (order, mark, start, size)], words[ragged(at[rows], size[rows])])
            yield pa.RecordBatch.from_arrays(
                [pa.array([s], pa.int64()), pa.array([blob], pa.binary()), *_nothing(1)], names
            )

    def known(order, mark, start, size):
        if len(order):
            spans = [x.tobytes() for x in np.column_stack([start, start + size])]
            columns = [pa.array(order), pa.array(mark), pa.array(spans, pa.binary())]
            none = [pa.nulls(len(order), pa.int64()), pa.nulls(len(order), pa.binary())]
            yield pa.RecordBatch.from_arrays([*none, *columns], names)

    def _nothing(n):
        return [pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.binary())]

    return docs.mapInArrow(
        lambda batches: _flushed(batches, WINDOW, run),
        "shard bigint, segments binary, order bigint, mark bigint, spans binary",
    )


def match_segments(fields: list[np.ndarray], words: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(segment, start, end) of the word ranges covered by windows of smaller owners."""
    order, _, start, size = fields
    content = segment_hashes(words, size)
    ranked = np.lexsort((order, content))
    lead = np.r_[True, content[ranked][1:] != content[ranked][:-1]]
    kind = np.empty(len(order), np.int64)
    kind[ranked] = np.cumsum(lead) - 1
    reps = ranked[lead]
    at = (np.cumsum(size) - size)[reps]
    length = size[reps]
    codes, symbol = np.unique(words[ragged(at, length)], return_inverse=True)
    begin = np.cumsum(length + 1) - length - 1
    symbols = np.zeros(int((length + 1).sum()), np.int64)
    symbols[ragged(begin, length)] = symbol + 1
    ranks, owner = np.unique(order[reps], return_inverse=True)
    index = FMIndex(symbols, np.repeat(owner, length + 1), WINDOW)
    hit = matched_windows(index, symbols, begin, length, owner, WINDOW)
    count = length - WINDOW + 1
    base = np.cumsum(count) - count
    segment, low, high = [], [], []
    edge = np.diff(np.r_[0, hit.astype(np.int8), 0])
    # runs of matched windows, split at the borders of segments
    border = np.zeros(len(hit) + 1, bool)
    border[base] = True
    first = np.flatnonzero(hit & (border[:-1] | (edge[:-1] == 1)))
    after = np.flatnonzero(hit & np.r_[border[1:-1], True] | (hit & (edge[1:] == -1)))
    which = np.searchsorted(base, first, "right") - 1
    runs = np.searchsorted(which, np.arange(len(reps) + 1))
    smaller = order > order[reps][kind]
    whole = np.flatnonzero(smaller)
    segment.append(whole)
    low.append(start[whole])
    high.append(start[whole] + size[whole])
    part = np.flatnonzero(~smaller)
    n = runs[kind[part] + 1] - runs[kind[part]]
    part, run = np.repeat(part, n), ragged(runs[kind[part]], n)
    segment.append(part)
    low.append(start[part] + first[run] - base[kind[part]])
    high.append(start[part] + after[run] - base[kind[part]] + WINDOW)
    return tuple(np.concatenate(x) for x in (segment, low, high))


def _match(segments: DataFrame) -> DataFrame:
    """(order, mark, spans): word ranges to remove, 16 bytes each."""

    def run(group: pa.Table) -> pa.Table:
        parts = [unpack_segments(blob) for blob in group["segments"].to_pylist()]
        fields = [np.concatenate(x) for x in zip(*(f for f, _ in parts))]
        segment, low, high = match_segments(fields, np.concatenate([x for _, x in parts]))
        order, mark = fields[0][segment], fields[1][segment]
        ranked = np.lexsort((low, mark, order))
        order, mark, spans = order[ranked], mark[ranked], np.column_stack([low, high])[ranked].astype(np.int64)
        new = np.flatnonzero(np.r_[True, (order[1:] != order[:-1]) | (mark[1:] != mark[:-1])]) if len(order) else []
        ends = np.r_[new[1:], len(order)].astype(int) if len(order) else []
        blobs = [spans[a:b].tobytes() for a, b in zip(new, ends)]
        return pa.table([pa.array(order[new] if len(order) else order), pa.array(mark[new] if len(order) else mark), pa.array(blobs, pa.binary())], ["order", "mark", "spans"])

    return segments.groupBy("shard").applyInArrow(run, "order bigint, mark bigint, spans binary")


def _only(rows: DataFrame, column: str, others: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``rows`` that ``others`` may hold, and the rest; the filter between them is of bounded size."""
    blocks = bloom.block_count(others.count())
    marked = bloom.mark(rows, column, bloom.filter_words(others, column, blocks), blocks)
    return marked.filter("maybe").drop("maybe"), marked.filter("not maybe").drop("maybe")


def repeated_spans(rows: DataFrame) -> DataFrame:
    """(order, mark, spans): per text the list of blobs of word ranges that an earlier text holds.

    ``rows`` has order (the id as bigint, the largest number for null), mark (a hash of the text,
    which tells rows of one id apart) and text.
    """
    n = rows.count()
    gram_shards = max(1, -(-n * 40 // SHARD_GRAMS))
    repeated = stored(_repeated(_grams_by_shard(rows, gram_shards)))
    total = repeated.agg(F.sum("n")).first()[0] or 0
    shards = max(1, -(-int(total) * (WINDOW + 20) // SHARD_WORDS))
    codes = repeated.groupBy("order").agg(F.collect_list("codes").alias("codes"))
    some, _ = _only(rows, "order", repeated.select("order").distinct())
    segments = stored(_segments(some.join(codes, "order").select("order", "mark", "text", "codes"), gram_shards, shards))
    found = _match(segments.filter("shard IS NOT NULL").select("shard", "segments"))
    known = segments.filter("shard IS NULL").select("order", "mark", "spans")
    return stored(found.unionByName(known).groupBy("order", "mark").agg(F.collect_list("spans").alias("spans")))


def _clean(rows: DataFrame, id_type: str) -> DataFrame:
    """Kept text and counts of rows with their spans (null: none)."""
    schema = f"id {id_type}, n_words bigint, n_removed bigint, kept string"

    def run(batches):
        for batch in batches:
            total, removed, kept = [], [], []
            for text, spans in zip(batch["text"].to_pylist(), batch["spans"].to_pylist()):
                own = (text or "").encode().split()
                total.append(len(own))
                if spans:
                    out = np.zeros(len(own) + 1, np.int64)
                    cut = np.frombuffer(b"".join(spans), np.int64).reshape(-1, 2)
                    np.add.at(out, cut[:, 0], 1)
                    np.add.at(out, cut[:, 1], -1)
                    gone = np.cumsum(out)[:-1] > 0
                    removed.append(int(gone.sum()))
                    own = [x for x, g in zip(own, gone.tolist()) if not g]
                else:
                    removed.append(0)
                kept.append(b" ".join(own).decode())
            yield pa.RecordBatch.from_arrays(
                [batch["id"], pa.array(total, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.string())],
                ["id", "n_words", "n_removed", "kept"],
            )

    return rows.select("id", "text", "spans").mapInArrow(run, schema)


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id (an integer), ``n_words``, ``n_removed`` and ``kept`` (words by one space).

    Windows are judged on the input. Rows with the same id are not smaller than each other, so
    repeated rows lose the same words; null ids count as larger than all others. Null and empty
    texts have no words. Other columns are ignored.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    text = F.col(f"`{text_col}`")
    rows = docs.select(
        F.col(f"`{id_col}`").alias("id"),
        F.coalesce(F.col(f"`{id_col}`").cast("bigint"), F.lit(int(LAST))).alias("order"),
        F.xxhash64(text).alias("mark"),
        text.alias("text"),
    )
    spans = repeated_spans(rows.select("order", "mark", "text"))
    some, rest = _only(rows, "order", spans.select("order").distinct())
    cut = some.join(spans, ["order", "mark"], "left")
    whole = rest.withColumn("spans", F.lit(None).cast("array<binary>"))
    names = ["id", "text", "spans"]
    out = _clean(cut.select(names).unionByName(whole.select(names)), kind)
    return out.withColumnRenamed("id", id_col)


def op6_substring_dedup(spark, sf_dir: str) -> DataFrame:
    kept = remove_repeats(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2(F.encode("kept", "UTF-8"), 256).alias("kept_sha256"))


SQL = """
WITH w AS (
    SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS ws
    FROM documents
),
p AS (
    SELECT doc_id, unnest(range(1, len(ws) - 48)) AS i, ws FROM w WHERE len(ws) >= 50
),
g AS (SELECT doc_id, i, md5(array_to_string(ws[i:i + 49], ' ')) AS h FROM p),
m AS (SELECT doc_id, i FROM (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY h) AS d FROM g) WHERE d < doc_id),
r AS (SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS i FROM m),
x AS (SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS i FROM w),
k AS (
    SELECT x.doc_id, string_agg(word, ' ' ORDER BY x.i) AS kept, count(*) AS n_kept
    FROM x LEFT JOIN r ON r.doc_id = x.doc_id AND r.i = x.i WHERE r.i IS NULL GROUP BY x.doc_id
)
SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(len(ws) - coalesce(n_kept, 0) AS BIGINT) AS n_removed,
       sha256(coalesce(kept, '')) AS kept_sha256
FROM w LEFT JOIN k ON k.doc_id = w.doc_id
"""
