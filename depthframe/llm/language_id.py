"""Language identification by a bidirectional gated recurrent network over bytes.

Each direction is a recurrent layer with an update gate: ``g = (1 + s(a)) / 2``, ``c = s(b)``,
``h' = g h + (1 - g) c``, where (a, b) are a table row of the byte plus ``U h`` and s is the softsign
``x / (1 + |x|)``, which costs a fifth of a hyperbolic tangent here. At every position both
states are mapped to language probabilities; a document's probabilities are the mean over all
its positions. Trained in numpy by backpropagation through time, scored in numpy.

For scoring, a text is cut into segments of ``SEGMENT`` bytes that start ``CONTEXT`` bytes early (in
reading order of either direction), so that thousands of segments advance together; every byte of
the text is labelled once. The lead lets the state settle: against one uncut run over each text, pooled
probabilities of 60 texts moved by 0.00006 at most (with a lead of 20 bytes by 0.03). Positions that
are no letters are read but not pooled.

Training uses a bounded sample of documents: for each language, of the ``SAMPLE`` documents with a letter
that come first by a hash of their id, the shortest ones that together have at most ``TRAIN_BYTES``
bytes, one at least. Of a document taken, the whole text is used, in windows of ``LENGTH`` bytes, and there
are at least as many steps as it takes to see every window.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from depthframe.llm import words as w
from depthframe.llm.common import table

UNITS = 8
SAMPLE, TRAIN_BYTES, LENGTH = 150, 1 << 18, 64
STEPS, BATCH, RATE = 240, 64, 0.02
SEGMENT, CONTEXT, LANES = 256, 64, 4096
UNKNOWN = "und"
F32 = np.float32

LETTER = np.zeros(256, bool)
LETTER[128:] = True
for _lo, _hi in ("AZ", "az"):
    LETTER[ord(_lo) : ord(_hi) + 1] = True


@dataclass
class Network:
    """``table[d]``: 256 rows of (gate, candidate) input; ``recurrent[d]``; d = forward, backward."""

    labels: list[str]
    table: np.ndarray
    recurrent: np.ndarray
    out: np.ndarray
    bias: np.ndarray

    @classmethod
    def fresh(cls, labels: list[str], seed: int = 3) -> Network:
        rng = np.random.default_rng(seed)
        n = len(labels)
        return cls(
            labels,
            rng.normal(0, 0.5, (2, 256, 2 * UNITS)).astype(F32),
            rng.normal(0, 0.3, (2, UNITS, 2 * UNITS)).astype(F32),
            rng.normal(0, 0.3, (2 * UNITS, n)).astype(F32),
            np.zeros(n, F32),
        )

    def parts(self) -> list[np.ndarray]:
        return [self.table, self.recurrent, self.out, self.bias]


def softsign(z: np.ndarray) -> np.ndarray:
    return z / (1 + np.abs(z))


def _softmax(z: np.ndarray) -> np.ndarray:
    z = np.exp(z - z.max(-1, keepdims=True))
    return z / z.sum(-1, keepdims=True)


def gradients(net: Network, x: np.ndarray, y: np.ndarray) -> tuple[float, list[np.ndarray]]:
    """Mean loss over all positions of ``x`` (batch x time) and its gradients."""
    n, time = x.shape
    seen = [x, x[:, ::-1]]
    states, kept = [], []
    for d in (0, 1):
        h = np.zeros((n, UNITS), F32)
        hs, gs, cs = (np.zeros((time, n, UNITS), F32) for _ in range(3))
        before = np.zeros((time, n, UNITS), F32)
        for t in range(time):
            z = net.table[d][seen[d][:, t]] + h @ net.recurrent[d]
            g, c = 0.5 + 0.5 * softsign(z[:, :UNITS]), softsign(z[:, UNITS:])
            before[t] = h
            h = g * h + (1 - g) * c
            hs[t], gs[t], cs[t] = h, g, c
        states.append(hs if d == 0 else hs[::-1])
        kept.append((before, gs, cs))
    both = np.concatenate(states, axis=2)
    p = _softmax(both @ net.out + net.bias)
    own = p[:, np.arange(n), y]
    loss = float(-np.log(np.maximum(own, 1e-9)).mean())
    error = p
    error[:, np.arange(n), y] -= 1
    error /= n * time
    d_out = np.einsum("tnh,tnl->hl", both, error)
    d_bias = error.sum((0, 1))
    d_both = error @ net.out.T
    d_table, d_recurrent = np.zeros_like(net.table), np.zeros_like(net.recurrent)
    for d in (0, 1):
        part = d_both[:, :, d * UNITS : (d + 1) * UNITS]
        part = part if d == 0 else part[::-1]
        before, gs, cs = kept[d]
        carry = np.zeros((n, UNITS), F32)
        for t in range(time - 1, -1, -1):
            dh = part[t] + carry
            g, c = gs[t], cs[t]
            gate = dh * (before[t] - c) * 0.5 * (1 - np.abs(2 * g - 1)) ** 2
            dz = np.concatenate([gate, dh * (1 - g) * (1 - np.abs(c)) ** 2], axis=1)
            np.add.at(d_table[d], seen[d][:, t], dz)
            d_recurrent[d] += before[t].T @ dz
            carry = dh * g + dz @ net.recurrent[d].T
    return loss, [d_table, d_recurrent, d_out, d_bias]


def train(windows: np.ndarray, y: np.ndarray, labels: list[str], steps: int = STEPS) -> Network:
    """Adam over shuffled batches, one round over all at least. ``windows`` is (rows x LENGTH) bytes."""
    steps = max(steps, -(-len(windows) // BATCH))
    net, rng = Network.fresh(labels), np.random.default_rng(4)
    parts = net.parts()
    m, v = [np.zeros_like(p) for p in parts], [np.zeros_like(p) for p in parts]
    order = np.zeros(0, int)
    for step in range(1, steps + 1):
        if not len(order):
            order = rng.permutation(len(windows))
        rows, order = order[:BATCH], order[BATCH:]
        _, grads = gradients(net, windows[rows], y[rows])
        for p, g, a, b in zip(parts, grads, m, v):
            a += 0.1 * (g - a)
            b += 0.01 * (g * g - b)
            p -= RATE * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.99**step)) + 1e-6)
    return net


class Scorer:
    """Scores texts in lanes; gate and candidate have arrays of their own, so that they are contiguous."""

    def __init__(self, net: Network):
        self.net = net
        part = [slice(0, UNITS), slice(UNITS, 2 * UNITS)]
        self.table = [[np.ascontiguousarray(net.table[d][:, p]) for p in part] for d in (0, 1)]
        self.recurrent = [[np.ascontiguousarray(net.recurrent[d][:, p]) for p in part] for d in (0, 1)]

    def probabilities(self, raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Summed language probabilities of the letter positions of each text, and their number."""
        sizes = np.diff(at)
        total, letters = np.zeros((len(sizes), len(self.net.labels))), np.zeros(len(sizes), np.int64)
        pieces = -(-sizes // SEGMENT)
        text = np.repeat(np.arange(len(sizes)), pieces)
        nth = np.arange(len(text)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        low = at[:-1][text] + nth * SEGMENT
        for a in range(0, len(text), LANES):
            rows, start = text[a : a + LANES], low[a : a + LANES]
            got, n = self._lanes(raw, start, at[:-1][rows], at[1:][rows])
            np.add.at(total, rows, got)
            np.add.at(letters, rows, n)
        return total, letters

    def _lanes(self, raw, start, first, last):
        n, span = len(start), SEGMENT + 2 * CONTEXT
        where = start[None, :] - CONTEXT + np.arange(span)[:, None]
        inside = (where >= first) & (where < last)
        byte = raw[np.clip(where, 0, len(raw) - 1)]
        whole = inside.all(1)
        own = slice(CONTEXT, CONTEXT + SEGMENT)
        logits = np.empty((SEGMENT, len(self.net.labels), n), F32)
        g, c, size, row = (np.empty((n, UNITS), F32) for _ in range(4))
        for d in (0, 1):
            out = np.ascontiguousarray(self.net.out[d * UNITS : (d + 1) * UNITS].T)
            h = np.zeros((n, UNITS), F32)
            steps = range(CONTEXT + SEGMENT) if d == 0 else range(span - 1, CONTEXT - 1, -1)
            for t in steps:
                for z, table, recurrent in zip((g, c), self.table[d], self.recurrent[d]):
                    np.matmul(h, recurrent, out=z)
                    z += np.take(table, byte[t], axis=0, out=row, mode="clip")
                    np.abs(z, out=size)
                    size += 1
                    z /= size
                g += 1
                g *= F32(0.5)
                h -= c
                h *= g
                h += c
                if not whole[t]:  # texts begin and end with an empty state
                    h *= inside[t][:, None]
                if own.start <= t < own.stop:
                    if d == 0:
                        np.matmul(out, h.T, out=logits[t - CONTEXT])
                    else:
                        logits[t - CONTEXT] += out @ h.T
        used = inside[own] & LETTER[byte[own]]
        logits += self.net.bias[None, :, None]
        np.exp(logits, out=logits)
        logits *= (used / logits.sum(1))[:, None, :]
        return logits.sum(0).T, used.sum(0)


def windows_of(text: str, length: int = LENGTH) -> list[np.ndarray]:
    """Windows that cover every byte; the last one ends with the text, a short text is padded."""
    raw = np.frombuffer(text.encode(), np.uint8)
    if len(raw) <= length:
        return [np.pad(raw, (0, length - len(raw)), constant_values=0x20)]
    last = len(raw) - length
    return [raw[s : s + length] for s in [*range(0, last, length), last]]


def training_windows(docs: DataFrame, per_label: int = SAMPLE, max_bytes: int = TRAIN_BYTES) -> DataFrame:
    """(lang, window) of the sampled documents of each language; see the module's text.

    Null and letterless texts, null ids and null languages are no candidates. The rank is limited
    before the shuffle, so a language that holds most rows stays small. Of rows with one id and
    language the smallest text is taken, once.
    """
    rows = docs.select(
        F.col("`doc_id`").alias("id"), F.col("`lang`").alias("lang"), F.col("`text`").alias("text")
    ).filter(F.col("lang").isNotNull() & F.col("id").isNotNull() & F.col("text").rlike("\\p{L}"))
    sized = rows.select("id", "lang", F.octet_length("text").cast("bigint").alias("size"))
    order = Window.partitionBy("lang").orderBy(F.xxhash64("id"), "id")
    first = sized.withColumn("n", F.row_number().over(order)).filter(F.col("n") <= per_label)
    short = Window.partitionBy("lang").orderBy("size", "n")
    upto = F.sum("size").over(short.rowsBetween(Window.unboundedPreceding, 0))
    taken = (
        first.select("id", "lang", upto.alias("upto"), F.row_number().over(short).alias("nth"))
        .filter((F.col("upto") <= max_bytes) | (F.col("nth") == 1))
        .select("id", "lang")
        .distinct()
    )
    # At most ``per_label`` rows for each language.
    texts = rows.join(F.broadcast(taken), ["id", "lang"], "left_semi").groupBy("id", "lang").agg(F.min("text").alias("text"))

    def cut(batches):
        for batch in batches:
            langs, out = [], []
            for lang, text in zip(batch["lang"].to_pylist(), batch["text"].to_pylist()):
                for x in windows_of(text):
                    langs.append(lang)
                    out.append(x.tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(out, pa.binary())], ["lang", "window"])

    return texts.select("lang", "text").mapInArrow(cut, "lang string, window binary")


def fit(docs: DataFrame) -> Network | None:
    """Network for the languages of ``docs`` (doc_id, text, lang); none if there is no labelled text."""
    rows = sorted((r["lang"], bytes(r["window"])) for r in training_windows(docs).collect())
    if not rows:
        return None
    labels = sorted({lang for lang, _ in rows})
    x = np.frombuffer(b"".join(x for _, x in rows), np.uint8).reshape(len(rows), LENGTH)
    return train(x, np.array([labels.index(lang) for lang, _ in rows]), labels)


def _has_letter(column: pa.Array, raw: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Whether each text has a letter; only texts without ASCII letters are looked at one by one."""
    seen = np.r_[0, np.cumsum(LETTER[raw] & (raw < 128))]
    found = seen[at[1:]] > seen[at[:-1]]
    for i in np.flatnonzero(~found & (np.diff(at) > 0)):
        found[i] = any(c.isalpha() for c in column[int(i)].as_py())
    return found


def identify(docs: DataFrame, net: Network | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, ``lang_pred``, ``score`` (pooled probability of the label).

    Null, empty and letterless texts are ``und`` with score 0, as is every text without a network.
    Other columns are ignored and repeated rows get equal answers.
    """
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
    kind = rows.schema["id"].dataType.simpleString()

    def run(batches):
        scorer = Scorer(net) if net else None
        names = np.array([*(net.labels if net else []), UNKNOWN], object)
        for part in w.slices(batches, "text"):
            raw, at = w.text_bytes(part["text"])
            label, score = np.full(part.num_rows, len(names) - 1), np.zeros(part.num_rows)
            if scorer and len(raw):
                total, letters = scorer.probabilities(raw, at)
                known = _has_letter(part["text"], raw, at)
                mean = total / np.maximum(letters, 1)[:, None]
                label = np.where(known, mean.argmax(1), label)
                score = np.where(known, np.minimum(mean.max(1), 1.0), 0.0)
            yield pa.RecordBatch.from_arrays([part["id"], pa.array(names[label]), pa.array(score)], ["id", "lang_pred", "score"])

    return rows.mapInArrow(run, f"id {kind}, lang_pred string, score double").withColumnRenamed("id", id_col)


def held_out(doc_id: Column) -> Column:
    """Whether a document is kept out of training; a null id is neither held out nor trained on."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(5)) == 0, F.lit(False))


def op1_language_id(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    net = fit(docs.filter(~held_out(F.col("doc_id"))))
    found = identify(docs, net)
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
