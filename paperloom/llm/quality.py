"""Quality scores by positive-unlabelled learning.

Trusted positives are training rows labelled 1; the unlabelled set is web text
whose labels, if any, are never read.  The class prior (the share of good text
in the unlabelled set) is estimated first, from the two samples alone: a
classifier tells positives from unlabelled texts, and the prior is the smallest
ratio, over its thresholds, of the unlabelled share above to the positive share
above, each widened by its sampling error.  The scorer then minimises the
non-negative unbiased risk

    prior * R+(positives) + max(0, R-(unlabelled) - prior * R-(positives))

with the logistic loss; in steps where the second part is negative its gradient
is reversed.  The scorer is linear in ramp features of bounded text statistics
(repetition of words, word pairs and lines, character classes, word lengths),
so it says the same about a text at any size of the corpus.

Both samples are bounded: about the SAMPLE first rows each, by a hash of the
id, chosen by a threshold on the hash and not by a sort.

Null and empty texts have the statistics of no words.  Without a positive every
score is 0.5.  Of several labels for one id the largest counts; labels with a
null id or value are ignored.  Of the rows that repeat a sampled id the first by
its statistics is learnt from.  Equal texts have equal scores, every row of docs
has one, and an empty docs table gives an empty result.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperloom.llm.common import id_remainder, slices, texts_of, thinned

SAMPLE = 4000
THRESHOLD = 0.3
RAMPS = 8
N_STATISTICS = 16


def statistics(text: bytes | None) -> list[float]:
    """Numbers of bounded range that describe a whole text."""
    text = text or b""
    words = text.split()
    n, size = len(words), max(1, len(text))
    c = np.bincount(np.frombuffer(text, np.uint8), minlength=256) if text else np.zeros(256, np.int64)
    upper, lower, digit, space = c[65:91].sum(), c[97:123].sum(), c[48:58].sum(), c[9:14].sum() + c[32]
    wide, ending = c[128:].sum(), c[33] + c[46] + c[63]
    marks = c[33:127].sum() - upper - lower - digit
    p = c[c > 0] / size
    lines = [x for x in text.split(b"\n") if x]
    folded = [w.lower() for w in words]
    counts = Counter(folded)
    pairs = len(set(zip(folded, folded[1:], strict=False)))
    same = sum(map(bytes.__eq__, folded, folded[1:]))
    k = max(1, n)
    alnum = sum(1 for w in counts if w.isalpha() or max(w) > 127)
    return [
        upper / max(1, upper + lower), digit / size, marks / size, (marks - ending - c[44]) / size, wide / size, space / size, c[33] / k,
        float(-(p * np.log2(p)).sum()) / 8, np.log1p(n) / 12, min(1.0, (size - space) / k / 20), len(counts) / k if n else 0.0,
        (pairs + 1) / k if n else 0.0, same / k, max(counts.values(), default=0) / k, 1 - len(set(lines)) / max(1, len(lines)), alnum / max(1, len(counts)),
    ]


class Model:
    """Standardised ramps of the statistics, and a linear scorer."""

    def __init__(self, knots: np.ndarray, mean: np.ndarray, scale: np.ndarray):
        self.knots, self.mean, self.scale = knots, mean, scale
        self.w, self.b, self.prior = np.zeros(len(mean)), 0.0, 0.5

    @classmethod
    def over(cls, x: np.ndarray) -> "Model":
        knots = np.quantile(x, np.linspace(0.005, 0.995, RAMPS + 1), axis=0)
        bare = cls(knots, np.zeros(1), np.ones(1))
        f = bare._ramps(x)
        return cls(knots, f.mean(0), np.maximum(f.std(0), 1e-3))

    def _ramps(self, x: np.ndarray) -> np.ndarray:
        """Position of each statistic within each of its quantile ranges, and
        how far it lies beyond them, in 0..1."""
        lo, hi = self.knots[:-1], self.knots[1:]
        inside = np.clip((x[:, None, :] - lo) / np.maximum(hi - lo, 1e-9), 0, 1).reshape(len(x), -1)
        width = np.maximum(self.knots[-1] - self.knots[0], 0.02)
        over = np.clip((x - self.knots[-1]) / width, 0, 1)
        under = np.clip((self.knots[0] - x) / width, 0, 1)
        return np.concatenate([inside, over, under], axis=1)

    def features(self, x: np.ndarray) -> np.ndarray:
        return np.clip((self._ramps(x) - self.mean) / self.scale, -12, 12)

    def score(self, x: np.ndarray) -> np.ndarray:
        return _sigmoid(self.features(x) @ self.w + self.b)


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -60, 60)))


def risk(margin_p: np.ndarray, margin_u: np.ndarray, prior: float) -> tuple[float, float]:
    """The positive part and the (not yet clipped) negative part of the risk."""
    loss = lambda z: np.logaddexp(0, -z)
    return prior * loss(margin_p).mean(), loss(-margin_u).mean() - prior * loss(-margin_p).mean()


def minimise(fp: np.ndarray, fu: np.ndarray, prior: float, l2: float = 2e-3, rounds: int = 600, rate: float = 0.02) -> tuple[np.ndarray, float]:
    """Weights and intercept at the smallest non-negative risk, by Adam."""
    w, b = np.zeros(fp.shape[1]), 0.0
    m, v = np.zeros(len(w) + 1), np.zeros(len(w) + 1)
    best, kept = np.inf, (w, b)
    for k in range(1, rounds + 1):
        zp, zu = fp @ w + b, fu @ w + b
        plus, minus = risk(zp, zu, prior)
        total = plus + max(0.0, minus) + l2 * float(w @ w)
        if total < best:
            best, kept = total, (w.copy(), b)
        gp = -prior * (1 - _sigmoid(zp)) / len(zp)
        gn_u, gn_p = _sigmoid(zu) / len(zu), -prior * _sigmoid(zp) / len(zp)
        sign = 1.0 if minus >= 0 else -1.0
        a, c = (gp if sign > 0 else 0 * gp) + sign * gn_p, sign * gn_u
        g = np.append(fp.T @ a + fu.T @ c + 2 * l2 * w, a.sum() + c.sum())
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        step = rate * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.999**k)) + 1e-8)
        w, b = w - step[:-1], b - step[-1]
    return kept


def estimate_prior(sp: np.ndarray, su: np.ndarray) -> float:
    """Smallest ratio of the unlabelled share to the positive share above a
    threshold, over thresholds that a fair part of the positives passes."""
    cuts = np.quantile(sp, np.linspace(0, 0.9, 181))
    up = np.array([(sp >= t).mean() for t in cuts])
    uu = np.array([(su >= t).mean() for t in cuts])
    slack = np.sqrt(uu * (1 - uu) / len(su)) + np.sqrt(up * (1 - up) / len(sp))
    return float(np.clip(((uu + slack) / np.maximum(up - slack, 1e-6)).min(), 0.05, 0.999))


def train(xp: np.ndarray, xu: np.ndarray) -> Model:
    """xp, xu: statistics of positives and of unlabelled texts."""
    model = Model.over(np.concatenate([xp, xu]))
    fp, fu = model.features(xp), model.features(xu)
    # a plain classifier of one sample against the other ranks texts for the prior;
    # each half is ranked by what the other half taught
    order_p, order_u = np.arange(len(fp)) % 2, np.arange(len(fu)) % 2
    sp, su = np.zeros(len(fp)), np.zeros(len(fu))
    for half in (0, 1):
        w, b = minimise(fp[order_p != half], fu[order_u != half], 0.5, rounds=250)
        sp[order_p == half], su[order_u == half] = fp[order_p == half] @ w + b, fu[order_u == half] @ w + b
    model.prior = estimate_prior(sp, su)
    model.w, model.b = minimise(fp, fu, model.prior)
    return model


def _measured(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([statistics(t) for t in texts_of(batch)], pa.list_(pa.float64()))], names=["doc_id", "x"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, x array<double>")


def fit(docs: DataFrame, labels: DataFrame, learn: Column, label_col: str = "quality", id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE) -> Model | None:
    """learn: which rows (by id) may be learnt from; both samples are of them."""
    positive = labels.where(learn).groupBy(F.col(id_col).alias("id")).agg(F.max(label_col).alias("y")).where("y = 1 and id is not null").select("id")
    first = thinned(positive, "id", sample).withColumn("kind", F.lit(1))
    web = thinned(docs.where(learn).select(F.col(id_col).alias("id")), "id", sample, salt="web").distinct().withColumn("kind", F.lit(0))
    chosen = first.unionByName(web).groupBy("id").agg(F.collect_set("kind").alias("kinds"))  # about 2 * sample ids
    rows = _measured(docs.join(F.broadcast(chosen), docs[id_col] == chosen["id"], "left_semi"), id_col, text_col).join(F.broadcast(chosen), F.col("doc_id") == F.col("id"))
    got = rows.groupBy("doc_id").agg(F.min("x").alias("x"), F.first("kinds").alias("kinds")).toPandas().sort_values("doc_id")
    x = np.array(got["x"].tolist(), np.float64).reshape(-1, N_STATISTICS)
    is_p, is_u = (np.array([k in s for s in got["kinds"]], bool) for k in (1, 0))
    return train(x[is_p], x[is_u]) if is_p.any() and is_u.any() else None


def score(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score)."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        for batch in slices(batches):
            x = np.array([statistics(t) for t in texts_of(batch)])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(model.score(x) if model is not None else np.full(len(x), 0.5))], names=["doc_id", "score"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, score double")


def report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    model = fit(docs, labels, id_remainder("doc_id", 5) != 0)
    return score(docs, model).select("doc_id", (id_remainder("doc_id", 5) == 0).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def accepted(docs: DataFrame, model: Model | None, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs that score the threshold or more; columns unchanged."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        for batch in slices(batches, text_col):
            if model is not None:
                batch = batch.filter(pa.array(model.score(np.array([statistics(t) for t in texts_of(batch, text_col)])) >= threshold))
            yield batch

    return docs.mapInArrow(run, docs.schema)
