"""Toxicity by cumulative-link ordinal regression.

P(grade > k) = sigmoid(w . x - t_k): one weight vector for all grades, and thresholds
t_0 <= t_1 <= ... between them.  x has a 1 for each selected feature that a text holds.
Features are words, lower-cased in A-Z and without punctuation at their ends, and their
first 4, 5 and 6 bytes, each a 64-bit hash; those whose document frequencies differ most
between toxic and clean texts, and by LEAST_Z standard errors or more, are selected.  The result is the expected
severity, the sum of P(grade > k) over k.

The labels are 0 and 1.  Severity grades follow from them: a document labelled clean has
grade 0, and a toxic one has grade 1, 2 or 3 by how many of its words are distinctive,
with the limits GRADES.

Training reads a bounded sample: at most SAMPLE documents of either label, those with the
least hashes of their ids, and one text of each id, the first in sort order.  Scoring reads every document whole.

Defined results: null or blank text has no feature and the severity of the intercept;
labels without a document, null labels and null ids are not trained on; of several labels
of one document the greatest counts; if a label is missing altogether no text is toxic;
equal rows have equal results; a text of any length is read whole; an empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nocturne.llm.common import materialize
from nocturne.llm.textvec import LOWER, buffer_of, pieces, span_hashes, words_of

SAMPLE = 3000
FEATURES = 512
LEAST_DOCS = 3
LEAST_Z = 4.0
CUT = 0.2
PREFIXES = (4, 5, 6)
GRADES = (2, 5)

_EDGE = np.zeros(256, bool)
_EDGE[[c for c in range(33, 127) if not chr(c).isalnum()]] = True


def features_of(text: pa.Array) -> tuple[int, np.ndarray, np.ndarray]:
    """(rows, row of each feature, hash of each feature), not yet distinct."""
    w = words_of(*buffer_of(text))
    start, end = w.start.copy(), w.end.copy()
    for _ in range(3):  # up to three marks at either end
        trim = (end - start > 1) & _EDGE[w.data[np.maximum(end - 1, 0)]] if len(end) else np.zeros(0, bool)
        end[trim] -= 1
        trim = (end - start > 1) & _EDGE[w.data[start]] if len(start) else trim
        start[trim] += 1
    rows = w.rows()
    total = span_hashes(LOWER[w.data])
    found = [(rows, total(start, end))]
    for n, k in enumerate(PREFIXES):
        long = end - start > k
        found.append((rows[long], total(start[long], start[long] + k) + np.uint64(n + 1)))
    return len(w.first) - 1, np.concatenate([a for a, _ in found]), np.concatenate([b for _, b in found])


def _distinct(rows: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((keys, rows))
    rows, keys = rows[order], keys[order]
    new = np.ones(len(rows), bool)
    new[1:] = (rows[1:] != rows[:-1]) | (keys[1:] != keys[:-1])
    return rows[new], keys[new]


@dataclass
class Model:
    """Sorted feature hashes with their weights, and the thresholds."""

    keys: np.ndarray
    weights: np.ndarray
    thresholds: np.ndarray

    def score(self, text: pa.Array) -> np.ndarray:
        n, rows, keys = features_of(text)
        if not len(self.keys) or not len(keys):
            return np.zeros(n)
        maybe = np.zeros(1 << 16, bool)
        maybe[(self.keys & np.uint64(0xFFFF)).astype(np.int64)] = True
        hit = maybe[(keys & np.uint64(0xFFFF)).astype(np.int64)]
        rows, keys = rows[hit], keys[hit]
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        hit = self.keys[at] == keys
        rows, at = _distinct(rows[hit], at[hit])
        return np.bincount(rows, self.weights[at], n)

    def above(self, score: np.ndarray) -> np.ndarray:
        """P(grade > k) for each k, a column each."""
        return 1 / (1 + np.exp(np.clip(self.thresholds[None, :] - score[:, None], -500, 500)))


def fit_ordinal(x: np.ndarray, grade: np.ndarray, n_grades: int, rounds: int = 400, rate: float = 0.05, l2: float = 1e-3) -> tuple[np.ndarray, np.ndarray]:
    """Weights and thresholds that minimise the mean negative log likelihood, by Adam steps on the whole sample."""
    n, m = x.shape
    w = np.zeros(m)
    upto = np.array([np.clip((grade > k).mean(), 1e-3, 1 - 1e-3) for k in range(n_grades - 1)])
    t = -np.log(upto / (1 - upto))
    state = np.concatenate((w, [t[0]], np.log(np.maximum(np.diff(t), 1e-2))))
    first, second = np.zeros_like(state), np.zeros_like(state)
    for step in range(1, rounds + 1):
        w, gaps = state[:m], np.exp(state[m + 1 :])
        t = np.cumsum(np.concatenate(([state[m]], gaps)))
        s = (x @ w.astype(x.dtype)).astype(float)  # the matrix keeps its type
        edge = np.concatenate((np.full((n, 1), -np.inf), t[None, :] - s[:, None], np.full((n, 1), np.inf)), axis=1)
        cdf = 1 / (1 + np.exp(-np.clip(edge, -40, 40)))
        pdf = cdf * (1 - cdf)
        row = np.arange(n)
        p = np.maximum(cdf[row, grade + 1] - cdf[row, grade], 1e-12)
        high, low = pdf[row, grade + 1] / p, pdf[row, grade] / p
        high[grade == n_grades - 1] = 0
        low[grade == 0] = 0
        slope_s = (high - low) / n
        slope_t = np.zeros(n_grades - 1)
        for k in range(n_grades - 1):
            slope_t[k] = (-high[grade == k].sum() + low[grade == k + 1].sum()) / n
        tail = np.cumsum(slope_t[::-1])[::-1]
        grad = np.concatenate((slope_s.astype(x.dtype) @ x + l2 * w, [tail[0]], tail[1:] * gaps))
        first, second = 0.9 * first + 0.1 * grad, 0.999 * second + 0.001 * grad**2
        state = state - rate * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
    return state[:m], np.cumsum(np.concatenate(([state[m]], np.exp(state[m + 1 :]))))


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", sample: int = SAMPLE, n_features: int = FEATURES) -> Model:
    spark = docs.sparkSession
    marks = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg((F.max(label) > 0).cast("int").alias("toxic"))
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    chosen = marks.where("toxic = 1").orderBy(*order).limit(sample).unionByName(marks.where("toxic = 0").orderBy(*order).limit(sample))
    taken = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.max("toxic").alias("toxic"))
    taken = materialize(taken, "sample")
    totals = {r["toxic"]: r["n"] for r in taken.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(totals) < 2:
        return Model(np.zeros(0, np.uint64), np.zeros(0), np.array([40.0, 41.0, 42.0]))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch, 0):
                _, rows, keys = features_of(piece.column(0))
                rows, keys = _distinct(rows, keys)
                toxic = piece.column(1).to_numpy(zero_copy_only=False)[rows]
                yield pa.record_batch([pa.array(keys.view(np.int64)), pa.array(toxic.astype(np.int32))], names=["key", "toxic"])

    counts = taken.select("text", "toxic").mapInArrow(count, "key long, toxic int").groupBy("key").agg(
        F.sum("toxic").alias("a"), F.sum(1 - F.col("toxic")).alias("b")
    )
    pa_, pb = F.col("a") / totals[1], F.col("b") / totals[0]
    mean = (F.col("a") + F.col("b")) / (totals[0] + totals[1])
    z = (pa_ - pb) / F.sqrt(mean * (1 - mean) * (1 / totals[1] + 1 / totals[0]) + 1e-9)
    best = counts.where((F.col("a") + F.col("b")) >= LEAST_DOCS).select("key", z.alias("z"), "a", "b").where(F.abs("z") >= LEAST_Z).orderBy(F.abs("z").desc(), "key").limit(n_features).collect()
    if not best:
        return Model(np.zeros(0, np.uint64), np.zeros(0), np.array([40.0, 41.0, 42.0]))
    keys = np.array([r["key"] for r in best], np.int64).view(np.uint64)
    telling = np.array([r["a"] * totals[0] > 20 * r["b"] * totals[1] for r in best], float)
    order_ = np.argsort(keys)
    keys, telling = keys[order_], telling[order_]
    shared = spark.sparkContext.broadcast(keys)

    def held(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chosen = shared.value
        for batch in batches:
            for piece in pieces(batch, 0):
                n, rows, found = features_of(piece.column(0))
                at = np.minimum(np.searchsorted(chosen, found), len(chosen) - 1)
                hit = chosen[at] == found
                rows, at = _distinct(rows[hit], at[hit])
                cut = np.searchsorted(rows, np.arange(n + 1))
                lists = pa.ListArray.from_arrays(pa.array(cut.astype(np.int32)), pa.array(at.astype(np.int32)))
                yield pa.record_batch([piece.column(1), lists], names=["toxic", "at"])

    rows = taken.select("text", "toxic").mapInArrow(held, "toxic int, at array<int>").collect()
    x = np.zeros((len(rows), len(keys)), np.float32)
    toxic = np.zeros(len(rows), np.int64)
    for i, r in enumerate(rows):
        x[i, r["at"]] = 1
        toxic[i] = r["toxic"]
    hits = x @ telling
    grade = np.where(toxic > 0, 1 + np.searchsorted(np.array(GRADES) * (1 + len(PREFIXES)), hits), 0)
    w, t = fit_ordinal(x, grade, len(GRADES) + 2)
    return Model(keys, w, t)


def toxicity(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, severity (expected grade), p_toxic, grade (most likely) and toxic (p_toxic over CUT) of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch, 1):
                above = shared.value.above(shared.value.score(piece.column(1)))
                edges = np.concatenate((np.ones((len(above), 1)), above, np.zeros((len(above), 1))), axis=1)
                yield pa.record_batch(
                    [
                        piece.column(0),
                        pa.array(np.round(above.sum(axis=1), 6)),
                        pa.array(np.round(above[:, 0], 6)),
                        pa.array(np.argmax(edges[:, :-1] - edges[:, 1:], axis=1).astype(np.int32)),
                        pa.array(above[:, 0] > CUT),
                    ],
                    names=["doc_id", "severity", "p_toxic", "grade", "toxic"],
                )

    slim = docs.select("doc_id", "text")
    kind = slim.schema["doc_id"].dataType.simpleString()
    return slim.mapInArrow(kernel, f"doc_id {kind}, severity double, p_toxic double, grade int, toxic boolean")
