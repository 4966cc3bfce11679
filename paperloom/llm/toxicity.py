"""Toxicity scores: a linear classifier over character n-grams scaled by naive
Bayes log-count ratios.

A text's features are the distinct character n-grams (ORDERS, lower-cased, any
white space one space) hashed to 2**BITS buckets.  With p and q the smoothed
document counts of a bucket in labelled toxic and other texts, its ratio is
log((p / |p|) / (q / |q|)), shrunk towards zero by ERRORS of its own standard
errors (and zero within them, as it is then no more than chance); the classifier
is a logistic regression on the indicator features times these ratios.  No
number of buckets is fixed: more labelled texts make more ratios sure.  The
bucket counts are summed on the executors.

It is fitted on a bounded sample of labelled training rows: about DOCS_PER_CLASS
of each label, the first by a hash of the id.  The intercept is then moved from the
sample's class shares to those of all labelled training rows.

Null and empty texts have no features and score the intercept alone; texts
shorter than an n-gram have those that fit.  Without labels of both kinds every
score is the share of label 1 (0 without any).  Of several labels for one id
the largest counts; labels with a null id or value are ignored.  Of the rows
that repeat a sampled id each counts in the ratios and the first by its features
in the regression.  Equal texts have equal scores, every row of docs has one,
and an empty docs table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperloom.llm.common import id_remainder, slices, texts_of, thinned

ORDERS = (4, 5, 6)
BITS = 19
DOCS_PER_CLASS = 2000
ERRORS = 3.0
THRESHOLD = 0.3
_MULTIPLIER, _MIX = np.uint64(0x100000001B3), np.uint64(0x9E3779B97F4A7C15)


class Featurizer:
    def __init__(self, orders: tuple[int, ...] = ORDERS, bits: int = BITS):
        self.orders, self.bits = orders, bits
        self._last = np.empty(1 << bits, np.int32)

    def __call__(self, text: bytes | None) -> np.ndarray:
        """Distinct buckets of a text's n-grams."""
        s = " ".join((text or b"").decode("utf-8", "replace").lower().split())
        if not s:
            return np.empty(0, np.int64)
        codes = np.frombuffer(f" {s} ".encode("utf-32-le"), np.uint32).astype(np.uint64)
        found, h = [], codes
        for n in range(2, max(self.orders) + 1):
            if len(codes) < n:
                break
            h = h[:-1] * _MULTIPLIER + codes[n - 1 :]
            if n in self.orders:
                found.append((((h + np.uint64(n)) * _MIX) >> np.uint64(64 - self.bits)).astype(np.int64))
        if not found:
            return np.empty(0, np.int64)
        at = np.concatenate(found)
        order = np.arange(len(at), dtype=np.int32)
        self._last[at] = order
        return at[self._last[at] == order]


class Model:
    """Weight times ratio of each bucket, and the intercept."""

    def __init__(self, weights: np.ndarray, intercept: float, orders: tuple[int, ...], bits: int):
        self.weights, self.intercept, self.orders, self.bits = weights.astype(np.float32), intercept, orders, bits

    def score(self, features: np.ndarray) -> float:
        z = self.intercept + float(self.weights[features].sum(dtype=np.float64))
        return float(1 / (1 + np.exp(-np.clip(z, -60, 60))))


def _logit(p: float) -> float:
    p = min(max(p, 1e-6), 1 - 1e-6)
    return float(np.log(p) - np.log1p(-p))


def choose(p: np.ndarray, q: np.ndarray, errors: float = ERRORS) -> tuple[np.ndarray, np.ndarray]:
    """The buckets whose log-count ratio is more than `errors` standard errors
    from zero, and their ratios less those errors; p and q are document counts
    of label 1 and 0, smoothed by one over the buckets that occur."""
    seen = np.flatnonzero(p + q)
    p, q = p[seen] + 1.0, q[seen] + 1.0
    ratio = np.log(p / p.sum()) - np.log(q / q.sum())
    shrunk = np.abs(ratio) - errors * np.sqrt(1 / p + 1 / q)
    sure = shrunk > 0
    return seen[sure], (np.sign(ratio) * shrunk)[sure]


def train(features: list[np.ndarray], labels: np.ndarray, chosen: np.ndarray, ratio: np.ndarray, prior: float, orders: tuple[int, ...] = ORDERS, bits: int = BITS, l2: float = 0.3, rounds: int = 800) -> Model:
    """Logistic regression on ratio-scaled indicators of the chosen buckets, by
    full-batch gradients with momentum.  features: positions in `chosen`."""
    weights = np.zeros(1 << bits)
    y = np.asarray(labels, np.float64)
    if not 0 < y.sum() < len(y):
        return Model(weights, _logit(prior), orders, bits)
    at = np.concatenate(features).astype(np.int64)
    doc = np.repeat(np.arange(len(y)), [len(f) for f in features])
    scaled, width = ratio[at], len(chosen)
    # both classes weigh the same; the intercept is moved to the prior afterwards
    importance = np.where(y > 0, 0.5 / y.sum(), 0.5 / (1 - y).sum())
    # power iterations for the largest curvature
    v, top = np.ones(width), 1.0
    for _ in range(8):
        v = np.bincount(at, weights=(importance * np.bincount(doc, weights=v[at] * scaled, minlength=len(y)))[doc] * scaled, minlength=width)
        top = float(np.linalg.norm(v))
        v /= max(top, 1e-12)
    penalty = l2 / len(y)
    step = 1 / (0.25 * max(top, 1.0) * 1.1 + penalty)
    w, b, vw, vb = np.zeros(width), 0.0, 0.0, 0.0
    for k in range(rounds):
        mix = k / (k + 3)
        lw, lb = w + mix * vw, b + mix * vb
        z = np.bincount(doc, weights=lw[at] * scaled, minlength=len(y)) + lb
        residual = (1 / (1 + np.exp(-np.clip(z, -60, 60))) - y) * importance
        nw = lw - step * (np.bincount(at, weights=residual[doc] * scaled, minlength=width) + penalty * lw)
        nb = lb - step * residual.sum()
        vw, vb, w, b = nw - w, nb - b, nw, nb
    weights[chosen] = w * ratio
    return Model(weights, b + _logit(prior), orders, bits)


def sample(docs: DataFrame, labels: DataFrame, learn: Column, label_col: str, id_col: str = "doc_id", text_col: str = "text", docs_per_class: int = DOCS_PER_CLASS) -> tuple[DataFrame, DataFrame]:
    """(id, y) of all labelled training ids, and (text, y) of the bounded sample."""
    known = labels.where(learn).select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("y")).where("id is not null and y is not null")
    known = known.groupBy("id").agg(F.max("y").alias("y"))
    first = thinned(known, "id", docs_per_class, "y")  # about 2 * docs_per_class rows
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(first), "id")
    return known, texts


def fit(docs: DataFrame, labels: DataFrame, learn: Column, label_col: str = "toxic", id_col: str = "doc_id", text_col: str = "text", docs_per_class: int = DOCS_PER_CLASS) -> Model:
    known, texts = sample(docs, labels, learn, label_col, id_col, text_col, docs_per_class)
    size = 1 << BITS

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features, n = Featurizer(), np.zeros((2, size), np.int64)
        for batch in slices(batches):
            for y, text in zip(batch.column("y").to_pylist(), texts_of(batch), strict=True):
                n[int(y > 0), features(text)] += 1
        rows = np.flatnonzero(n.any(axis=0))
        yield pa.RecordBatch.from_arrays([pa.array(rows.astype(np.int32)), pa.array(n[1, rows]), pa.array(n[0, rows])], names=["bucket", "p", "q"])

    counted = texts.select("y", "text").mapInArrow(count, "bucket int, p long, q long")
    table = counted.groupBy("bucket").agg(F.sum("p").alias("p"), F.sum("q").alias("q")).toPandas()  # a row for each bucket
    p, q = np.zeros(size), np.zeros(size)
    p[table["bucket"]], q[table["bucket"]] = table["p"], table["q"]
    chosen, ratio = choose(p, q)
    slot = np.full(size, -1, np.int32)
    slot[chosen] = np.arange(len(chosen))
    sent = docs.sparkSession.sparkContext.broadcast(slot)

    def featurize(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features, slot = Featurizer(), sent.value
        for batch in slices(batches):
            found = [slot[features(t)] for t in texts_of(batch)]
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("y"), pa.array([f[f >= 0].tobytes() for f in found], pa.binary())], names=["id", "y", "f"])

    rows = texts.select("id", "y", "text").mapInArrow(featurize, "id long, y int, f binary")
    rows = rows.groupBy("id", "y").agg(F.min("f").alias("f")).toPandas().sort_values("id")
    share = known.agg(F.avg("y")).first()[0] or 0.0
    return train([np.frombuffer(f, np.int32) for f in rows["f"]], rows["y"].to_numpy(), chosen, ratio, share)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score)."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        features = Featurizer(model.orders, model.bits)
        for batch in slices(batches):
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([model.score(features(t)) for t in texts_of(batch)], pa.float64())], names=["doc_id", "score"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, score double")


def report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    model = fit(docs, labels, id_remainder("doc_id", 4) != 2)
    return score(docs, model).select("doc_id", (id_remainder("doc_id", 4) == 2).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
