"""Toxicity grades by cumulative-link ordinal regression on sparse text features.

P(grade <= k) = sigmoid(threshold_k - score): one weight vector for all
thresholds, which are kept in order. Features are hashed words, present or not.
The model is fitted on a bounded sample of labelled documents; every document
is scored on its whole text.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import kept_rows, pick, worker_cache

#: UTF-8 bytes of the words: A-Z lowered, every other ASCII byte that is no letter or digit a blank.
LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))
FEATURES = 1 << 20
#: Bound of the labelled sample that the model is fitted on (the rows of least hash of their id).
SAMPLE_ROWS = 10_000


def features(text: str | None) -> np.ndarray:
    """Sorted distinct feature numbers of a whole text."""
    words = set((text or "").encode("utf-8", "surrogatepass").translate(LETTERS).split())
    ids = np.fromiter(map(zlib.crc32, words), np.int64, len(words)) & (FEATURES - 1)
    return np.unique(ids)


@dataclass
class OrdinalModel:
    weights: np.ndarray  # by feature
    thresholds: np.ndarray  # ascending, one fewer than grades

    def score(self, ids: np.ndarray) -> float:
        return float(self.weights[ids].sum())

    def above(self, score):
        """P(grade > k) for each threshold k."""
        z = np.clip(np.subtract.outer(np.atleast_1d(score), self.thresholds), -500, 500)
        return 1.0 / (1.0 + np.exp(-z))

    def expected(self, score):
        """Expected grade: the sum of P(grade > k)."""
        return self.above(score).sum(axis=1)


class _Rows:
    """Sparse binary matrix over the features that at least ``least`` rows have."""

    def __init__(self, rows: list[np.ndarray], least: int) -> None:
        flat = np.concatenate(rows) if rows else np.zeros(0, np.int64)
        ids, inverse, seen = np.unique(flat, return_inverse=True, return_counts=True)
        kept = seen >= least
        self.ids = ids[kept]
        number = np.cumsum(kept) - 1
        owner = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
        use = kept[inverse]
        self.col, self.row, self.n = number[inverse][use].astype(np.int32), owner[use].astype(np.int32), len(rows)

    def dot(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, w[self.col], self.n)

    def back(self, g: np.ndarray) -> np.ndarray:
        return np.bincount(self.col, g[self.row], len(self.ids))


def fit(rows: list[np.ndarray], grades: np.ndarray, least: int = 3, l1: float = 1.0, steps: int = 150, rate: float = 0.1) -> OrdinalModel:
    """Maximum likelihood with an L1 penalty of ``l1`` on the summed log-likelihood: Adam steps with soft thresholding, so that words without a say weigh 0."""
    top = int(grades.max(initial=0))
    x = _Rows(rows, least)
    weights = np.zeros(FEATURES, np.float64)
    if top == 0 or len(rows) < 2:
        return OrdinalModel(weights, np.full(max(top, 1), 20.0))
    share = np.array([(grades > k).mean() for k in range(top)])
    first = -np.log(np.maximum(share, 1e-6) / np.maximum(1 - share, 1e-6))
    theta = np.concatenate([first[:1], np.log(np.maximum(np.diff(first), 1e-2))])  # first threshold, then log gaps
    w = np.zeros(len(x.ids))
    state = [[np.zeros_like(v), np.zeros_like(v)] for v in (w, theta)]
    sig = lambda z: 1.0 / (1.0 + np.exp(-np.clip(z, -500, 500)))
    for step in range(1, steps + 1):
        cuts = np.concatenate([[-np.inf], theta[0] + np.concatenate([[0.0], np.cumsum(np.exp(theta[1:]))]), [np.inf]])
        s = x.dot(w)
        up, low = sig(cuts[grades + 1] - s), sig(cuts[grades] - s)
        p = np.maximum(up - low, 1e-12)
        d_up, d_low = up * (1 - up) / p, low * (1 - low) / p
        g_w = x.back(d_up - d_low) / x.n
        g_cut = np.zeros(top)
        np.add.at(g_cut, np.minimum(grades, top - 1), np.where(grades < top, -d_up, 0.0) / x.n)
        np.add.at(g_cut, np.maximum(grades - 1, 0), np.where(grades > 0, d_low, 0.0) / x.n)
        g_theta = np.array([g_cut.sum(), *[g_cut[k:].sum() * np.exp(theta[k]) for k in range(1, top)]])
        lr = rate / (1 + step / 50)
        for v, g, m in ((w, g_w, state[0]), (theta, g_theta, state[1])):
            m[0] += 0.1 * (g - m[0])
            m[1] += 0.001 * (g * g - m[1])
            v -= lr * (m[0] / (1 - 0.9**step)) / (np.sqrt(m[1] / (1 - 0.999**step)) + 1e-8)
        scale = np.sqrt(state[0][1] / (1 - 0.999**step)) + 1e-8
        w = np.sign(w) * np.maximum(np.abs(w) - lr * l1 / x.n / scale, 0.0)
    weights[x.ids] = w
    return OrdinalModel(weights, theta[0] + np.concatenate([[0.0], np.cumsum(np.exp(theta[1:]))]))


def graded(rows: list[np.ndarray], toxic: np.ndarray, least: int = 5, odds: float = 3.0) -> np.ndarray:
    """Grades 0, 1, 2 from yes-or-no labels: the toxic half with more marker words is graded 2.

    A marker is a word that toxic sample rows have at least exp(``odds``) times as often as others. Labels above 0 are
    toxic, all others are not.
    """
    toxic = (toxic > 0).astype(np.int64)
    x = _Rows(rows, least)
    yes = x.back(toxic.astype(float))
    no = x.back(1.0 - toxic)
    marks = np.log((yes + 0.5) / (toxic.sum() + 1)) - np.log((no + 0.5) / ((1 - toxic).sum() + 1)) > odds
    hits = x.dot(marks.astype(float))
    middle = np.median(hits[toxic == 1]) if toxic.any() else 0.0
    return toxic.astype(np.int64) + ((toxic == 1) & (hits > middle))


def train(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample_rows: int = SAMPLE_ROWS, binary: bool = True) -> OrdinalModel:
    """The model from at most ``sample_rows`` labelled documents; rows without label do not count.

    ``binary``: the label is 0 or 1 and is graded by :func:`graded`; else it is the grade.
    The sample's ids (16 bytes a row) are broadcast, and its features come to the driver.
    """
    docs = pick(df, doc_id=id_col, text=text_col)
    marks = pick(labels, doc_id=id_col, grade=label_col).filter("doc_id is not null and grade is not null")
    sample = marks.groupBy("doc_id").agg(F.max("grade").cast("int").alias("grade")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_cache("toxicity")
        for batch in batches:
            ids = [features(t.as_py()).astype("<i4").tobytes() for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.binary()), batch.column(2)], names=["doc_id", "ids", "grade"])

    picked = docs.join(F.broadcast(sample), "doc_id").select(F.col("doc_id").cast("long"), "text", "grade")
    found = picked.mapInArrow(run, "doc_id long, ids binary, grade int").groupBy("doc_id").agg(F.min("ids").alias("ids"), F.max("grade").alias("grade"))
    got = found.orderBy("doc_id").collect()
    rows = [np.frombuffer(r[1], "<i4").astype(np.int64) for r in got]
    grades = np.array([r[2] for r in got], np.int64)
    return fit(rows, graded(rows, grades) if binary and len(rows) else grades)


def score_documents(df: DataFrame, model: OrdinalModel, id_col: str = "doc_id", text_col: str = "text", cut: float = 0.25) -> DataFrame:
    """One row per document: doc_id, severity (expected grade), grade (most likely), p_toxic, rejected (p_toxic >= ``cut``).

    Null and empty texts have no features and score the base rate. Repeated
    rows are scored each; an empty table gives no rows.
    """
    docs = pick(df, doc_id=id_col, text=text_col).select(F.col("doc_id").cast("long"), "text")
    shared = docs.sparkSession.sparkContext.broadcast((model.weights.astype(np.float32), model.thresholds))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_cache("toxicity")
        weights, thresholds = shared.value
        held = OrdinalModel(weights, thresholds)
        for batch in batches:
            above = held.above(np.array([held.score(features(t.as_py())) for t in batch.column(1)])) if batch.num_rows else np.zeros((0, len(thresholds)))
            each = np.concatenate([np.ones((len(above), 1)), above], axis=1) - np.concatenate([above, np.zeros((len(above), 1))], axis=1)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(above.sum(axis=1)), pa.array(each.argmax(axis=1).astype(np.int32)), pa.array(above[:, 0]), pa.array(above[:, 0] >= cut)],
                names=["doc_id", "severity", "grade", "p_toxic", "rejected"],
            )

    return docs.mapInArrow(run, "doc_id long, severity double, grade int, p_toxic double, rejected boolean")


def reject_toxic(df: DataFrame, model: OrdinalModel, text_col: str = "text", cut: float = 0.25) -> DataFrame:
    """The rows of ``df``, all columns as they are, whose texts are not rejected."""
    at = df.columns.index(text_col)
    shared = df.sparkSession.sparkContext.broadcast((model.weights.astype(np.float32), model.thresholds))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_cache("toxicity")
        weights, thresholds = shared.value
        held = OrdinalModel(weights, thresholds)
        for batch in batches:
            if batch.num_rows:
                above = held.above(np.array([held.score(features(t.as_py())) for t in batch.column(at)]))
                yield batch.filter(pa.array(above[:, 0] < cut))

    return kept_rows(df, run)
