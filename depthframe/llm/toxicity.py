"""Toxicity grades by cumulative-link ordinal regression on sparse text features.

Features of a text are the distinct hashes of its words and of their 4, 5 and 6 leading bytes
(lower case, letters and digits). For grades 0 to K-1 the model is
``P(grade > k) = sigmoid(w.x - t_k)`` with one weight vector and ordered thresholds; the expected
severity is the sum of these probabilities.

Labels say only toxic or not, so graded severity is derived for training: 0 is not toxic; among
toxic texts, those whose number of telling features is above the median are 2, the others 1. A
feature is telling if it occurs in toxic texts of the sample more often than chance allows: so often
that, of all features of the sample together, at most one would be expected to (see
:func:`telling`). No number of texts is fixed, so small and large tables are judged alike.

Training uses a bounded sample: the ``SAMPLE`` labelled documents of either class that come first by
a hash of their id, at most. A sampled row counts for all labelled rows it stands for, so that
probabilities and ``REJECT`` mean the same however many labels there are. Scoring reads every text whole; it is one pass without a shuffle.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from depthframe.llm import words as w
from depthframe.llm.common import stored, table

SAMPLE = 2000
STEMS = (4, 5, 6)
GRADES = 3
#: A feature is telling from this many standard deviations on.
TELLING_Z = 5.0
#: Share of the sampled texts with the feature that must be toxic.
TELLING_SHARE = 0.9
#: Features are sought for toxic texts that hold fewer chosen features than this.
COVER = 8
REJECT = 0.2


def features(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct (row, feature) pairs as two arrays."""
    got = w.split_words(column, w.NOT_WORD, w.LOWER, STEMS)
    row = np.repeat(np.arange(len(got)), np.diff(got.offsets))
    rows = np.concatenate([row] * (1 + len(STEMS)))
    ids = np.concatenate([got.hashes, *(got.stems[n] + w.U64(n) for n in STEMS)])
    order = np.lexsort((ids, rows))
    rows, ids = rows[order], ids[order]
    new = np.ones(len(ids), bool)
    new[1:] = (ids[1:] != ids[:-1]) | (rows[1:] != rows[:-1])
    return rows[new], ids[new]


@dataclass
class OrdinalModel:
    """``keys`` are the sorted feature hashes, ``thresholds`` increase."""

    keys: np.ndarray
    weights: np.ndarray
    thresholds: np.ndarray

    def latent(self, column: pa.Array) -> np.ndarray:
        got = w.split_words(column, w.NOT_WORD, w.LOWER, STEMS)
        total = np.zeros(len(got))
        if not len(self.keys):
            return total
        row = np.repeat(np.arange(len(got)), np.diff(got.offsets))
        pairs = []
        for ids in (got.hashes, *(got.stems[n] + w.U64(n) for n in STEMS)):
            at = np.searchsorted(self.keys, ids)
            hit = self.keys[np.minimum(at, len(self.keys) - 1)] == ids
            pairs.append(row[hit] * len(self.keys) + at[hit])
        pair = np.unique(np.concatenate(pairs))
        np.add.at(total, pair // len(self.keys), self.weights[pair % len(self.keys)])
        return total

    def above(self, latent: np.ndarray) -> np.ndarray:
        """P(grade > k) for each row and k."""
        return 1 / (1 + np.exp(np.clip(self.thresholds[None, :] - latent[:, None], -60, 60)))


def may_tell(bad, clean):
    """Whether a feature in so many toxic and other texts of the sample is worth a look."""
    return (bad >= 2) & (bad >= TELLING_SHARE * (bad + clean))


def least_texts(toxic: int, clean: int, tested: int) -> float:
    """So many texts are all toxic by chance for less than one of ``tested`` features; infinite if none suffice.

    The exact (hypergeometric) test of drawing only toxic texts.
    """
    chance = 1.0
    for k in range(toxic):
        chance *= (toxic - k) / (toxic + clean - k)
        if chance * max(1, tested) <= 1:
            return k + 1
    return float("inf")


def telling(rows: np.ndarray, at: np.ndarray, toxic: np.ndarray, tested: int | None = None) -> list[int]:
    """Features that lean to toxic texts beyond chance, chosen greedily; (row, feature) pairs are distinct.

    ``tested`` is the number of features of the sample, those left out before included.

    Each choice is the feature that leans most among the toxic texts which fewer than ``COVER``
    chosen features occur in. Words that toxic texts only share because they are copies of each
    other explain nothing once the words they are toxic by are chosen, and so stay out.
    """
    bad_row = toxic.astype(bool)
    size = int(at.max(initial=-1)) + 1
    clean = np.bincount(at[~bad_row[rows]], minlength=size)
    covered, chosen = np.zeros(len(toxic), int), []
    open_rows = bad_row.copy()
    tested = max(size, tested or 0)
    while size:
        bad = np.bincount(at[open_rows[rows]], minlength=size)
        rate = open_rows.sum() / max(1, open_rows.sum() + (~bad_row).sum())
        seen = bad + clean
        z = (bad - seen * rate) / np.sqrt(np.maximum(seen * rate * (1 - rate), 1e-9))
        z[(bad < least_texts(int(open_rows.sum()), int((~bad_row).sum()), tested)) | (z < TELLING_Z)] = 0
        z[chosen] = 0
        best = int(np.argmax(z))
        if z[best] <= 0:
            break
        chosen.append(best)
        covered[rows[at == best]] += 1
        open_rows &= covered < COVER
    return chosen


def derived_grades(count: np.ndarray, toxic: np.ndarray) -> np.ndarray:
    middle = np.median(count[toxic]) if toxic.any() else 0
    return np.where(toxic, 1 + (count > middle), 0).astype(int)


def fit_ordinal(
    x: np.ndarray, y: np.ndarray, grades: int, steps: int = 300, decay: float = 1e-3, counts: np.ndarray | None = None
):
    """Weights and increasing thresholds by full-batch Adam on the cumulative-link likelihood.

    ``counts`` says how often each row counts, once by default.
    """
    n, d = x.shape
    counts = np.ones(n) if counts is None else counts
    theta = np.zeros(d + grades - 1)
    theta[d:] = np.r_[0.0, np.full(grades - 2, np.log(1.0))]
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    for step in range(1, steps + 1):
        t = np.cumsum(np.r_[theta[d], np.exp(theta[d + 1 :])])
        z = x @ theta[:d]
        above = 1 / (1 + np.exp(np.clip(t[None, :] - z[:, None], -60, 60)))
        edge = np.c_[np.ones(n), above, np.zeros(n)]
        p = np.maximum(edge[np.arange(n), y] - edge[np.arange(n), y + 1], 1e-12)
        slope = np.c_[np.zeros(n), above * (1 - above), np.zeros(n)]
        low, high = counts * slope[np.arange(n), y] / p, counts * slope[np.arange(n), y + 1] / p
        g_w = -(x.T @ (low - high)) / n + decay * theta[:d]
        g_t = np.zeros(grades - 1)
        np.add.at(g_t, np.clip(y - 1, 0, grades - 2), np.where(y > 0, low, 0) / n)
        np.add.at(g_t, np.clip(y, 0, grades - 2), np.where(y < grades - 1, -high, 0) / n)
        tail = np.cumsum(g_t[::-1])[::-1]
        grad = np.r_[g_w, tail[0], tail[1:] * np.exp(theta[d + 1 :])]
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        theta -= 0.05 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-9)
    return theta[:d], np.cumsum(np.r_[theta[d], np.exp(theta[d + 1 :])])


def fit_features(
    keys: np.ndarray, rows: np.ndarray, at: np.ndarray, toxic: np.ndarray, counts: np.ndarray | None = None,
    tested: int | None = None,
) -> OrdinalModel:
    """Model from the (row, index into ``keys``) pairs of a sample. Without a telling feature every grade is 0."""
    chosen = telling(rows, at, toxic, tested)
    if not chosen:
        return OrdinalModel(keys[:0], np.zeros(0), np.full(GRADES - 1, 60.0))
    column = np.full(len(keys), -1)
    chosen = sorted(chosen, key=lambda i: keys[i])
    column[chosen] = np.arange(len(chosen))
    use = column[at] >= 0
    x = np.zeros((len(toxic), len(chosen)))
    x[rows[use], column[at[use]]] = 1
    y = derived_grades(x.sum(1), toxic.astype(bool))
    return OrdinalModel(keys[chosen], *fit_ordinal(x, y, GRADES, counts=counts))


def train(column: pa.Array, toxic: np.ndarray) -> OrdinalModel:
    """Fit on labelled texts that are at hand."""
    rows, ids = features(column)
    keys, at = np.unique(ids, return_inverse=True)
    bad = np.bincount(at[toxic[rows] > 0], minlength=len(keys))
    use, tested = may_tell(bad, np.bincount(at, minlength=len(keys)) - bad)[at], len(keys)
    keys, at = np.unique(ids[use], return_inverse=True)
    return fit_features(keys, rows[use], at, toxic, tested=tested)


def label_marks(labels: DataFrame) -> DataFrame:
    """One row per labelled document; null labels are left out."""
    return (
        labels.filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull())
        .groupBy(F.col("doc_id").alias("l_id"))
        .agg(F.max("toxic").alias("l_toxic"))
    )


def class_counts(labels: DataFrame, per_class: int = SAMPLE) -> np.ndarray:
    """How often a sampled row of either class counts: its labels by its sampled ones, 1 for the less thinned class."""
    total = dict(label_marks(labels).groupBy("l_toxic").count().collect())
    rows = np.array([total.get(c, 0) / per_class for c in (0, 1)])
    return np.maximum(rows, 1) / np.maximum(rows, 1).min()


def labelled_sample(docs: DataFrame, labels: DataFrame, per_class: int = SAMPLE) -> DataFrame:
    """(text, toxic) of at most ``per_class`` documents of either class."""
    marks = label_marks(labels)
    first = [
        marks.filter(F.col("l_toxic") == c).orderBy(F.xxhash64("l_id"), "l_id").limit(per_class) for c in (0, 1)
    ]
    chosen = F.broadcast(first[0].unionByName(first[1]))
    rows = docs.select(F.col("`doc_id`").alias("d_id"), F.col("`text`").alias("d_text"))
    return rows.join(chosen, F.col("d_id") == F.col("l_id")).select(
        "d_text", F.when(F.col("l_toxic") > 0, 1).otherwise(0).cast("int").alias("l_toxic")
    )


def fit(docs: DataFrame, labels: DataFrame) -> OrdinalModel:
    """Fit on a bounded sample. Features are counted by Spark; the driver gets those that may tell."""
    sample = stored(labelled_sample(docs, labels))

    def all_features(batches):
        for part in w.slices(batches, "d_text"):
            rows, ids = features(part["d_text"])
            mark = part["l_toxic"].to_numpy()[rows]
            yield pa.RecordBatch.from_arrays([pa.array(ids.view(np.int64)), pa.array(mark, pa.int32())], ["f", "toxic"])

    counts = stored(
        sample.mapInArrow(all_features, "f bigint, toxic int")
        .groupBy("f")
        .agg(F.sum("toxic").alias("bad"), F.sum(F.lit(1) - F.col("toxic")).alias("clean"))
    )
    found = counts.filter(may_tell(F.col("bad"), F.col("clean"))).select("f").toArrow()
    keys = np.sort(found["f"].to_numpy().view(np.uint64)) if found.num_rows else np.zeros(0, np.uint64)

    def own_features(batches):
        for part in w.slices(batches, "d_text"):
            rows, ids = features(part["d_text"])
            at = np.minimum(np.searchsorted(keys, ids), max(0, len(keys) - 1))
            hit = keys[at] == ids if len(keys) else np.zeros(len(ids), bool)
            cut = np.searchsorted(rows[hit], np.arange(part.num_rows + 1))
            lists = pa.ListArray.from_arrays(pa.array(cut.astype(np.int32)), pa.array(at[hit].astype(np.int32)))
            yield pa.RecordBatch.from_arrays([part["l_toxic"].cast(pa.int32()), lists], ["toxic", "at"])

    marked = sample.mapInArrow(own_features, "toxic int, at array<int>").toArrow().combine_chunks()
    if not marked.num_rows:
        return fit_features(keys, np.zeros(0, int), np.zeros(0, int), np.zeros(0))
    lists, toxic = marked["at"].combine_chunks(), marked["toxic"].to_numpy()
    rows = np.repeat(np.arange(len(lists)), lists.value_lengths().to_numpy())
    return fit_features(keys, rows, lists.flatten().to_numpy(), toxic.astype(float), class_counts(labels)[toxic], counts.count())


def grade(docs: DataFrame, model: OrdinalModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, ``severity`` (0 to K-1), ``grade`` (most probable), ``toxic``.

    ``toxic`` is P(grade > 0) >= ``REJECT``. Null and empty texts have no feature and so the
    severity of the bare thresholds. Repeated rows are judged alike; other columns are ignored.
    """
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    names = ["id", "severity", "grade", "toxic"]

    def run(batches):
        for part in w.slices(batches, "text"):
            above = model.above(model.latent(part["text"]))
            edge = np.c_[np.ones(len(above)), above, np.zeros(len(above))]
            best = np.argmax(edge[:, :-1] - edge[:, 1:], axis=1)
            columns = [pa.array(above.sum(1)), pa.array(best.astype(np.int32)), pa.array(above[:, 0] >= REJECT)]
            yield pa.RecordBatch.from_arrays([part["id"], *columns], names)

    out = rows.mapInArrow(run, f"id {kind}, severity double, grade int, toxic boolean")
    return out.withColumnRenamed("id", id_col)


def op3_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return grade(docs, fit(docs, table(spark, sf_dir, "labels")))


def clean_documents(docs: DataFrame, model: OrdinalModel, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that the model does not reject, unchanged and in their partitions."""

    def run(batches):
        for part in w.slices(batches, text_col):
            reject = model.above(model.latent(part[text_col]))[:, 0] >= REJECT
            yield part.filter(pa.array(~reject))

    return docs.mapInArrow(run, docs.schema)
