"""N-gram Jaccard self-join, size-aware: subsets for light sets, inverted lists for heavy ones.

A document's set holds its distinct five-word shingles. Two sets link if
``100 * intersection >= 80 * union``. The join is exact:

1. One pass over the texts gives each set's key (a hash of the set) and size, and a fixed-size
   sketch of shingle counts. Equal sets are one class from here on.
2. A second pass emits postings (token, class, size). Heavy sets emit the shingles of their
   prefix under a global order, rare ones first by the sketch: sets that link share one of them.
   Light sets emit hashes of all their subsets of the sizes two linked light sets must share. The
   boundary is the largest size up to which enumerating subsets costs no more than scanning the
   lists of a prefix of mean length. Sets that can link over the boundary emit both.
3. Postings are grouped by shards of tokens. A list of two classes gives their pair if they fit in
   size; a longer one is chained in order of size, and each member is tied to the first one of
   its size range. Pairs whose parity bitmaps differ in more places than a link allows are out,
   the others are verified on the whole sets.
4. Longer lists in which several components are left give the closest pair by bitmaps of every two
   of them, and after these are verified, all pairs between the components still apart that
   sizes and bitmaps allow, again verified.

Shingle hashes have 64 bits (48 in verification); equality of hashes counts as equality.
"""

from __future__ import annotations

from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from depthframe.llm import bloom
from depthframe.llm import words as w
from depthframe.llm.common import stored, table, whole
from depthframe.llm.components import components

WORDS = 5
SKETCH_BITS, SKETCH_SLICES = 20, 64
LIGHT_AT_MOST = 12
SHARD_POSTINGS = 500_000
FLUSH_POSTINGS = 2_000_000
BITMAP_LEAST, BITMAP_MOST = 64, 8192
U64 = w.U64


def shingle_sets(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingles of each text, as one array and its offsets."""
    got = w.split_words(column, w.BLANK, w.LOWER)
    grams, valid = w.gram_hashes(got.hashes, WORDS), w.gram_valid(got.offsets, WORDS)
    words = np.diff(got.offsets)
    counts = np.maximum(0, words - WORDS + 1)
    short = np.flatnonzero((words > 0) & (words < WORDS))
    counts[short] = 1
    ends = np.cumsum(counts)
    out = np.empty(int(ends[-1]) if len(ends) else 0, U64)
    long = np.ones(len(out), bool)
    long[ends[short] - 1] = False
    out[long] = grams[valid]
    for i in short:
        low, high = got.offsets[i], got.offsets[i + 1]
        out[ends[i] - 1] = w.gram_hashes(got.hashes[low:high], int(high - low))[0]
    starts = ends - counts
    for low, high in zip(starts.tolist(), ends.tolist()):
        if high - low > 1:
            out[low:high].sort()
    new = np.ones(len(out), bool)
    new[1:] = out[1:] != out[:-1]
    new[starts[counts > 0]] = True
    offsets = np.r_[0, np.cumsum(new)][np.r_[0, ends]] if len(ends) else np.zeros(1, np.int64)
    return out[new], offsets


def set_keys(sets: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A hash of each whole set; 0 for empty sets."""
    out = np.zeros(len(offsets) - 1, U64)
    full = np.flatnonzero(np.diff(offsets))
    if len(full):
        out[full] = w.mix(np.add.reduceat(w.mix(sets + U64(77)), offsets[full]))
    return out


def least_overlap(a: int, b: int) -> int:
    """Smallest intersection of sets of these sizes with 100 * intersection >= 80 * union."""
    return -(-4 * (a + b) // 9)


def prefix_length(n: np.ndarray) -> np.ndarray:
    return n - (4 * n + 4) // 5 + 1


def may_link(a, b):
    """Whether sizes a <= b allow a link."""
    return 5 * a >= 4 * b


def subset_sizes(n: int, light: int) -> set[int]:
    """Intersection sizes that a light set of ``n`` needs with any light partner."""
    return {least_overlap(n, t) for t in range(1, light + 1) if may_link(min(n, t), max(n, t))}


def light_boundary(mean_list: float) -> int:
    """Largest size up to which subsets cost no more than the inverted lists of a prefix."""
    light = 0
    for n in range(1, LIGHT_AT_MOST + 1):
        subsets = sum(comb(n, c) for c in subset_sizes(n, n) if c <= n)
        if subsets > int(prefix_length(np.array(n))) * max(1.0, mean_list):
            break
        light = n
    return light


def _slot(shingles: np.ndarray) -> np.ndarray:
    return (shingles >> U64(64 - SKETCH_BITS)).astype(np.int64)


def parity_bitmaps(sets: np.ndarray, offsets: np.ndarray) -> list[bytes]:
    """For each set, which of about as many slots as it has members hold an odd number of them.

    Bitmaps of two sets differ in at most as many places as the sets have members not in common.
    """
    out = []
    for low, high in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
        bits = min(max(BITMAP_LEAST, 1 << max(0, high - low - 1).bit_length()), BITMAP_MOST)
        count = np.bincount((sets[low:high] & U64(bits - 1)).astype(np.int64), minlength=bits)
        out.append(np.packbits((count & 1).astype(np.uint8), bitorder="little").tobytes())
    return out


def least_difference(x: bytes, y: bytes) -> int:
    """A lower bound of the members not in common, from two bitmaps; the wider one is folded."""
    x, y = np.frombuffer(x, U64), np.frombuffer(y, U64)
    while len(x) > len(y):
        x = x[: len(x) // 2] ^ x[len(x) // 2 :]
    while len(y) > len(x):
        y = y[: len(y) // 2] ^ y[len(y) // 2 :]
    return int(np.bitwise_count(x ^ y).sum())


def _describe(rows: DataFrame) -> DataFrame:
    """(id, key, n, bits) of every row and, in other rows, (slice, counts) of the sketch by task."""
    kind = rows.schema["id"].dataType.simpleString()
    schema = f"id {kind}, key bigint, n bigint, bits binary, slice int, counts binary"
    names = ["id", "key", "n", "bits", "slice", "counts"]
    size = 1 << SKETCH_BITS
    id_kind = _arrow_kind(kind)

    def run(batches):
        sketch = np.zeros(size, np.int64)
        for part in w.slices(batches, "text"):
            sets, offsets = shingle_sets(part["text"])
            sketch += np.bincount(_slot(sets), minlength=size)
            key = pa.array(set_keys(sets, offsets).view(np.int64))
            bits = pa.array(parity_bitmaps(sets, offsets), pa.binary())
            none = [pa.nulls(part.num_rows, pa.int32()), pa.nulls(part.num_rows, pa.binary())]
            yield pa.RecordBatch.from_arrays([part["id"], key, pa.array(np.diff(offsets)), bits, *none], names)
        if sketch.any():
            packed = np.minimum(sketch, 255).astype(np.uint8).reshape(SKETCH_SLICES, -1)
            none = [pa.nulls(SKETCH_SLICES, k) for k in (id_kind, pa.int64(), pa.int64(), pa.binary())]
            blobs = pa.array([x.tobytes() for x in packed], pa.binary())
            yield pa.RecordBatch.from_arrays([*none, pa.array(range(SKETCH_SLICES), pa.int32()), blobs], names)

    return rows.mapInArrow(run, schema)


def _arrow_kind(kind: str) -> pa.DataType:
    return {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string(), "smallint": pa.int16()}[kind]


def _sketch(described: DataFrame) -> np.ndarray:
    """Counts of all tasks added up, slice by slice; its size is fixed."""

    def add(batches):
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, blob in zip(batch["slice"].to_pylist(), batch["counts"]):
                counts = np.frombuffer(blob.as_buffer(), np.uint8)
                total[k] = total.get(k, 0) + counts.astype(np.int64)
        if total:
            blobs = [x.tobytes() for x in total.values()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(total), pa.int32()), pa.array(blobs, pa.binary())], ["slice", "counts"]
            )

    parts = described.filter("slice IS NOT NULL").select("slice", "counts").repartition(SKETCH_SLICES, "slice")
    out = np.zeros((SKETCH_SLICES, (1 << SKETCH_BITS) // SKETCH_SLICES), np.int64)
    for r in parts.mapInArrow(add, "slice int, counts binary").collect():
        out[r["slice"]] += np.frombuffer(r["counts"], np.int64)
    return out.ravel()


def order_levels(sketch: np.ndarray) -> np.ndarray:
    """Level of each slot in the global order: quarter octaves above the mean count."""
    mean = max(1.0, float(sketch.mean()))
    return np.floor(4 * np.log2(np.maximum(1.0, sketch / mean))).astype(np.uint8)


def postings_of(
    sets: np.ndarray, offsets: np.ndarray, keys: np.ndarray, levels: np.ndarray, light: int
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Tokens, set keys and set sizes of the postings of some sets."""
    ordered = (levels[_slot(sets)].astype(U64) << U64(56)) | (sets >> U64(8))
    sizes = np.diff(offsets)
    heavy = np.array([n > light or may_link(n, light + 1) for n in sizes.tolist()], bool) & (sizes > 0)
    tokens, owners = [], []
    for i in np.flatnonzero(sizes > 0).tolist():
        low, high = offsets[i], offsets[i + 1]
        if heavy[i]:
            n = high - low
            x = ordered[low:high].copy()
            x.sort()
            tokens.append(x[: prefix_length(n)])
            owners.append((i, len(tokens[-1])))
        if high - low <= light:
            mixed = w.mix(sets[low:high] + U64(78)).tolist()
            for c in subset_sizes(int(high - low), light):
                if c <= high - low:
                    sums = [sum(x) % 2**64 for x in combinations(mixed, c)]
                    tokens.append(w.mix(np.array(sums, U64) + U64(c)))
                    owners.append((i, len(sums)))
    if not tokens:
        return np.zeros(0, U64), np.zeros(0, U64), np.zeros(0, np.uint32)
    row = np.repeat([o for o, _ in owners], [n for _, n in owners])
    return np.concatenate(tokens), keys[row], sizes[row].astype(np.uint32)


def _post(rows: DataFrame, levels, light: int, shards: int) -> DataFrame:
    """(shard, postings): arrays of 16 bytes a posting, one row for each shard and flush of a task."""

    def run(batches):
        held, n = [], 0
        for part in w.slices(batches, "text"):
            sets, offsets = shingle_sets(part["text"])
            held.append(postings_of(sets, offsets, set_keys(sets, offsets), levels.value, light))
            n += len(held[-1][0])
            if n >= FLUSH_POSTINGS:
                yield from flush(held)
                held, n = [], 0
        yield from flush(held)

    def flush(held):
        if not held:
            return
        token, key, size = (np.concatenate(x) for x in zip(*held))
        spread = w.mix(token)
        shard = (spread % U64(shards)).astype(np.int64)
        word = ((spread // U64(shards)) & U64(0xFFFFFFFF)).astype(np.uint32)
        order = np.argsort(shard, kind="stable")
        shard, word, key, size = shard[order], word[order], key[order], size[order]
        names, at = np.unique(shard, return_index=True)
        ends = np.r_[at[1:], len(shard)]
        blobs = [word[a:b].tobytes() + key[a:b].tobytes() + size[a:b].tobytes() for a, b in zip(at, ends)]
        for low in range(0, len(blobs), 256):
            yield pa.RecordBatch.from_arrays(
                [pa.array(names[low : low + 256]), pa.array(blobs[low : low + 256], pa.binary())], ["shard", "postings"]
            )

    return rows.select("text").mapInArrow(run, "shard bigint, postings binary")


def pairs_of_lists(token: np.ndarray, key: np.ndarray, size: np.ndarray):
    """Pairs of keys (smaller first) and (list, key, size) of the longer lists, from postings."""
    order = np.lexsort((key, size, token))
    token, key, size = token[order], key[order], size[order].astype(np.int64)
    new = np.ones(len(token), bool)
    new[1:] = (token[1:] != token[:-1]) | (key[1:] != key[:-1])
    token, key, size = token[new], key[new].view(np.int64), size[new]
    start = np.flatnonzero(np.r_[True, token[1:] != token[:-1]]) if len(token) else np.zeros(0, int)
    count = np.diff(np.r_[start, len(token)])
    two = start[count == 2]
    fits = may_link(size[two], size[two + 1])
    a, b = [key[two][fits]], [key[two + 1][fits]]
    members: dict[int, tuple] = {}
    for s, c in zip(start[count > 2].tolist(), count[count > 2].tolist()):
        k, z = key[s : s + c], size[s : s + c]
        first = np.searchsorted(5 * z, 4 * z)  # first member that may link with each
        head, at = np.zeros(c, int), 0
        for m in range(c):
            at = m if first[m] > at else at
            head[m] = at
        i, j = np.r_[np.arange(c - 1), head], np.r_[np.arange(1, c), np.arange(c)]
        mixed = w.mix(k.view(U64) + U64(79))
        members[int(mixed.sum().view(np.int64))] = (k, z)
        good = may_link(z[i], z[j]) & (i != j)
        a.append(k[i[good]])
        b.append(k[j[good]])
    a, b = np.concatenate(a), np.concatenate(b)
    a, b = np.minimum(a, b), np.maximum(a, b)
    order = np.lexsort((b, a))
    a, b = a[order], b[order]
    new = np.ones(len(a), bool)
    new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    return a[new], b[new], members


def _match(posted: DataFrame) -> DataFrame:
    """(list, a, b, n): candidate pairs where ``list`` is null, members a of long lists of size n else."""
    names = ["list", "a", "b", "n"]

    def run(group: pa.Table) -> pa.Table:
        parts = []
        for blob in group["postings"].to_pylist():
            n = len(blob) // 16
            parts.append((
                np.frombuffer(blob, np.uint32, n), np.frombuffer(blob, U64, n, 4 * n), np.frombuffer(blob, np.uint32, n, 12 * n)
            ))
        a, b, members = pairs_of_lists(*(np.concatenate(x) for x in zip(*parts)))
        blocks = [pa.table([pa.nulls(len(a), pa.int64()), pa.array(a), pa.array(b), pa.nulls(len(a), pa.int64())], names)]
        for name, (k, z) in members.items():
            blocks.append(
                pa.table([pa.array(np.full(len(k), name)), pa.array(k), pa.nulls(len(k), pa.int64()), pa.array(z)], names)
            )
        return pa.concat_tables(blocks)

    return posted.groupBy("shard").applyInArrow(run, "list bigint, a bigint, b bigint, n bigint")


def pack48(x: np.ndarray) -> bytes:
    x = x >> U64(16)
    return (x >> U64(16)).astype(np.uint32).tobytes() + (x & U64(0xFFFF)).astype(np.uint16).tobytes()


def unpack48(blob: bytes) -> np.ndarray:
    n = len(blob) // 6
    return (np.frombuffer(blob, np.uint32, n).astype(U64) << U64(16)) | np.frombuffer(blob, np.uint16, n, 4 * n)


def _class_sets(rows: DataFrame, classes: DataFrame, keys: DataFrame) -> DataFrame:
    """(key, shingles) of the wanted classes, read from the document they are named by.

    A Bloom filter of bounded size keeps most other texts out of the shuffle. Rows that share an id
    may add sets that nobody asked for or repeat one; both are harmless to :func:`_verify`.
    """
    wanted = stored(classes.join(keys.distinct(), "key").select(F.col("rep").alias("wanted")).distinct())
    blocks = bloom.block_count(wanted.count())
    marked = bloom.mark(rows, "id", bloom.filter_words(wanted, "wanted", blocks), blocks)
    texts = marked.filter("maybe").select("id", "text").join(wanted, F.col("id").eqNullSafe(F.col("wanted")), "left_semi")

    def run(batches):
        for part in w.slices(batches, "text"):
            sets, offsets = shingle_sets(part["text"])
            key = set_keys(sets, offsets).view(np.int64)
            blobs = [pack48(sets[a:b]) for a, b in zip(offsets[:-1], offsets[1:])]
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(blobs, pa.binary())], ["key", "shingles"])

    return stored(texts.select("text").mapInArrow(run, "key bigint, shingles binary"))


def _plausible(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """The pairs whose bitmaps do not rule out a link."""
    left = classes.select(F.col("key").alias("a"), F.col("n").alias("m"), F.col("bits").alias("x"))
    right = classes.select(F.col("key").alias("b"), F.col("n").alias("n"), F.col("bits").alias("y"))

    def run(batches):
        for batch in batches:
            columns = (batch[c].to_pylist() for c in ("m", "n", "x", "y"))
            good = [9 * least_difference(x, y) <= m + n for m, n, x, y in zip(*columns)]
            yield batch.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    both = pairs.join(left, "a").join(right, "b").select("a", "b", "m", "n", "x", "y")
    return both.mapInArrow(run, "a bigint, b bigint")


def linked(x: np.ndarray, y: np.ndarray) -> bool:
    both = len(np.intersect1d(x, y, assume_unique=True))
    return 100 * both >= 80 * (len(x) + len(y) - both)


def _verify(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) that link, on their whole sets."""
    left = sets.select(F.col("key").alias("a"), F.col("shingles").alias("x"))
    right = sets.select(F.col("key").alias("b"), F.col("shingles").alias("y"))

    def run(batches):
        for batch in batches:
            good = [linked(unpack48(x), unpack48(y)) for x, y in zip(batch["x"].to_pylist(), batch["y"].to_pylist())]
            yield batch.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    both = pairs.join(left, "a").join(right, "b").select("a", "b", "x", "y")
    return both.mapInArrow(run, "a bigint, b bigint").distinct()


def _links(rows: DataFrame, classes: DataFrame, pairs: DataFrame) -> DataFrame:
    """The plausible pairs that link."""
    pairs = stored(pairs)
    if pairs.isEmpty():
        return pairs
    keys = pairs.select(F.col("a").alias("key")).unionByName(pairs.select(F.col("b").alias("key")))
    return stored(_verify(pairs, _class_sets(rows, classes, keys)))


def plausible_pairs(key, size, root, bits, closest: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of members of one list in different components that sizes and bitmaps allow to link.

    Bitmaps are compared one member against all others at a time; wider ones are folded. With
    ``closest`` only the pair that differs least is kept for every two components.
    """
    widths = np.array([len(x) for x in bits])
    rows = {n: np.flatnonzero(widths == n) for n in np.unique(widths).tolist()}
    maps = {n: np.frombuffer(b"".join(bits[i] for i in at), U64).reshape(len(at), -1) for n, at in rows.items()}
    kept, n_kept = [np.zeros((3, 0), np.int64)], 0
    for n, at in rows.items():
        for m, others in rows.items():
            # sizes of a link differ by a quarter at most, so widths by one step
            if m not in (n, 2 * n):
                continue
            wide = maps[m] if m == n else maps[m][:, : n // 8] ^ maps[m][:, n // 8 :]
            for i, x in enumerate(maps[n]):
                low = i + 1 if m == n else 0
                to = others[low:]
                small, large = np.minimum(size[at[i]], size[to]), np.maximum(size[at[i]], size[to])
                good = (root[to] != root[at[i]]) & may_link(small, large)
                close = np.flatnonzero(good)
                differ = np.bitwise_count(wide[low:][close] ^ x).sum(1, dtype=np.int64)
                fits = 9 * differ <= (small + large)[close]
                to, differ = to[close[fits]], differ[fits]
                kept.append(np.stack([np.full(len(to), at[i]), to, differ]))
                n_kept += len(to)
                if closest and n_kept > 200_000:
                    kept = [_closest(np.concatenate(kept, axis=1), root)]
                    n_kept = 0
    i, j, _ = (lambda x: _closest(x, root) if closest else x)(np.concatenate(kept, axis=1))
    return np.minimum(key[i], key[j]), np.maximum(key[i], key[j])


def _closest(pairs: np.ndarray, root: np.ndarray) -> np.ndarray:
    """The (i, j, difference) of least difference for every two components."""
    i, j, differ = pairs
    low, high = np.minimum(root[i], root[j]), np.maximum(root[i], root[j])
    order = np.lexsort((differ, high, low))
    new = np.ones(len(order), bool)
    new[1:] = (low[order][1:] != low[order][:-1]) | (high[order][1:] != high[order][:-1])
    return pairs[:, order[new]]


def _across(lists: DataFrame, classes: DataFrame, roots: DataFrame, closest: bool) -> DataFrame:
    """Plausible pairs of the longer lists whose members are still in different components."""
    named = lists.join(roots, lists["a"] == roots["node"], "left").select(
        "list", "a", "n", F.coalesce("root", "a").alias("root")
    )
    open_lists = named.groupBy("list").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).filter("lo <> hi")
    named = named.join(open_lists.select("list"), "list")
    named = named.join(classes.select(F.col("key").alias("a"), "bits"), "a")

    def run(group: pa.Table) -> pa.Table:
        key, size, root = (group[c].to_numpy() for c in ("a", "n", "root"))
        a, b = plausible_pairs(key, size, root, group["bits"].to_pylist(), closest)
        return pa.table([pa.array(a), pa.array(b)], ["a", "b"])

    return named.groupBy("list").applyInArrow(run, "a bigint, b bigint").distinct()


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, ``n_shingles``, ``component_id``, ``n_copies`` and ``n_links``.

    ``component_id`` is the smallest id reachable by links, ``n_copies`` the rows with an equal set and
    ``n_links`` the number of different sets found linked with it (verified pairs only, at least
    what its component needs). Null, empty and blank texts have an empty set, which links with
    nothing; their component is their own id. Null ids take part in links but name a component
    only if it has no other. Repeated rows are copies of each other. Other columns are ignored.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
    described = stored(_describe(rows))
    known = described.filter("slice IS NULL").select("id", "key", "n", "bits")
    full = known.filter("n > 0")
    classes = stored(
        full.groupBy("key").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("n_copies"), F.first("n").alias("n"), F.first("bits").alias("bits"))
    )
    sketch = _sketch(described)
    mean_list = float((sketch.astype(float) ** 2).sum() / max(1, sketch.sum()) - sketch.mean()) if sketch.any() else 1.0
    light = light_boundary(mean_list)
    levels = spark.sparkContext.broadcast(order_levels(sketch))
    total = full.agg(F.sum(F.col("n") - F.floor((4 * F.col("n") + 4) / 5) + 1)).first()[0] or 0
    shards = max(1, -(-int(total) // SHARD_POSTINGS))
    found = stored(_match(_post(rows, levels, light, shards)))
    pairs = stored(found.filter("list IS NULL").select("a", "b").distinct())
    lists = found.filter("list IS NOT NULL").select("list", "a", "n").distinct()
    links = _links(rows, classes, _plausible(pairs, classes))
    for closest in (True, False):
        more = _across(lists, classes, components(links), closest).join(pairs, ["a", "b"], "left_anti")
        more = stored(more)
        pairs = stored(pairs.unionByName(more))
        links = stored(links.unionByName(_links(rows, classes, more)))
    roots = stored(components(links))
    degree = links.select(F.col("a").alias("key")).unionByName(links.select(F.col("b").alias("key"))).groupBy("key").count()
    joined = classes.join(roots, classes["key"] == roots["node"]).select("key", "root", "rep")
    best = joined.groupBy("root").agg(F.min("rep").alias("component_id"))
    in_group = joined.join(best, "root").select("key", "component_id")
    named = (
        classes.join(in_group, "key", "left")
        .join(degree, "key", "left")
        .select("key", "n_copies", F.coalesce("component_id", "rep").alias("component_id"), F.coalesce("count", F.lit(0)).alias("n_links"))
    )
    empty = known.filter("n = 0").select(
        "id", "n", F.col("id").alias("component_id"), F.lit(1).cast("bigint").alias("n_copies"), F.lit(0).cast("bigint").alias("n_links")
    )
    out = full.drop("bits").join(named, "key").select("id", "n", "component_id", "n_copies", "n_links").unionByName(empty)
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), "component_id", "n_copies", "n_links")


def op4_jaccard_join(spark, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


SQL = """
WITH RECURSIVE w AS (
    SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''),
        'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS ws
    FROM documents
),
g AS (
    SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
        ELSE list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')) END) AS s
    FROM w
),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
o AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS o FROM g x JOIN g y ON x.s = y.s AND x.doc_id <> y.doc_id GROUP BY 1, 2),
e AS (SELECT a, b FROM o JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * o >= 80 * (x.n + y.n - o)),
r(a, b) AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a)
SELECT d.doc_id, coalesce(any_value(n.n), 0) AS n_shingles, least(d.doc_id, coalesce(min(r.b), d.doc_id)) AS component_id
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN r ON r.a = d.doc_id GROUP BY d.doc_id
"""


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` whose id names their component, with all columns.

    An id goes only if all of its rows belong to components of smaller ids. Rows without id stay
    unless an id names their component. Rows that cannot go never leave their tasks.
    """
    found = jaccard_components(docs, id_col, text_col)
    goes = found.groupBy(F.col(id_col).alias("gone")).agg(
        F.max(F.col("component_id").eqNullSafe(F.col(id_col))).alias("stays")
    )
    goes = stored(goes.filter("not stays").select("gone"))
    rows = docs.select(whole(docs), F.col(f"`{id_col}`").alias("id"))
    blocks = bloom.block_count(goes.count())
    marked = bloom.mark(rows, "id", bloom.filter_words(goes, "gone", blocks), blocks)
    some = marked.filter("maybe").join(goes, F.col("id").eqNullSafe(F.col("gone")), "left_anti")
    return marked.filter("not maybe").select("row").unionByName(some.select("row")).select("row.*")
