import random

import numpy as np
from pyspark.sql import functions as F

from paperloom.llm import quality, toxicity

VOCABULARY = [a + b for a in ("ba", "de", "fi", "go", "lu", "mer") for b in ("tan", "sor", "vil", "nek", "par", "ond")]


def prose(rng, n):
    words = [rng.choice(VOCABULARY) for _ in range(n)]
    return ". ".join(" ".join(words[i : i + 9]).capitalize() for i in range(0, n, 9)) + "."


def toxic_table(spark):
    rng = random.Random(4)
    rows, labels = [], []
    for i in range(400):
        bad = i % 4 == 0
        words = prose(rng, rng.randrange(20, 200)).split()
        if bad:
            words.insert(rng.randrange(len(words)), rng.choice(["you idiot", "pathetic scum"]))
        rows.append((i, " ".join(words), "x"))
        labels.append((i, int(bad)))
    rows += [(900, None, "x"), (901, "", "x"), (902, "ab", "x"), (None, "idiot", "x"), (903, prose(rng, 30000), "x"), (903, "idiot " * 5, "x")]
    labels += [(None, 1), (7, None), (5, 0)]
    return spark.createDataFrame(rows, "doc_id long, text string, score string"), spark.createDataFrame(labels, "doc_id long, toxic int")


def test_toxicity_on_held_out_rows(spark):
    docs, labels = toxic_table(spark)
    got = toxicity.report(docs, labels).collect()
    assert len(got) == 406 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got)
    held = [r for r in got if r.held_out and r.doc_id is not None and r.doc_id < 400]
    assert held and np.mean([r.predicted == int(r.doc_id % 4 == 0) for r in held]) > 0.95


def test_toxicity_without_labels(spark):
    docs, labels = toxic_table(spark)
    assert {r.predicted for r in toxicity.report(docs, labels.limit(0)).collect()} == {0}
    assert toxicity.report(docs.limit(0), labels).count() == 0


def test_ratio_is_the_naive_bayes_log_count_ratio_less_its_errors():
    p, q = np.array([5.0, 0, 3, 0]), np.array([0.0, 0, 3, 7])
    a, b = p[[0, 2, 3]] + 1, q[[0, 2, 3]] + 1  # the second bucket does not occur
    want = np.log(a / a.sum()) - np.log(b / b.sum())
    chosen, ratio = toxicity.choose(p, q, errors=0)
    assert chosen.tolist() == [0, 2, 3] and np.allclose(ratio, want)
    chosen, ratio = toxicity.choose(p, q, errors=1)
    error = np.sqrt(1 / a + 1 / b)
    sure = np.abs(want) > error
    assert chosen.tolist() == np.array([0, 2, 3])[sure].tolist() and np.allclose(np.abs(ratio), (np.abs(want) - error)[sure])


def test_number_of_buckets_grows_with_the_evidence():
    rng = np.random.default_rng(5)
    share_p, share_q = rng.random(3000), rng.random(3000)
    sizes = [len(toxicity.choose(rng.binomial(n, share_p), rng.binomial(n, share_q))[0]) for n in (20, 200, 2000)]
    assert sizes == sorted(sizes) and sizes[0] < sizes[-1] and sizes[-1] > 1024


def brute_toxicity(texts, labels, size, orders, l2=0.3):
    """Counts, ratios and a regression by plain gradients, text by text."""
    f = toxicity.Featurizer(orders, size)
    sets = [set(f(t).tolist()) for t in texts]
    p, q = {}, {}
    for s, y in zip(sets, labels, strict=True):
        for b in s:
            p[b], q[b] = p.get(b, 0) + y, q.get(b, 0) + 1 - y
    np_, nq = sum(p[b] + 1 for b in p), sum(q[b] + 1 for b in q)
    ratio = {}
    for b in p:
        r, e = np.log((p[b] + 1) / np_) - np.log((q[b] + 1) / nq), toxicity.ERRORS * np.sqrt(1 / (p[b] + 1) + 1 / (q[b] + 1))
        if abs(r) > e:
            ratio[b] = np.sign(r) * (abs(r) - e)
    names = sorted(ratio)
    x = np.array([[ratio[b] * (b in s) for b in names] for s in sets])
    y = np.array(labels, float)
    w, c, importance = np.zeros(len(names)), 0.0, np.where(y > 0, 0.5 / y.sum(), 0.5 / (1 - y).sum())
    for _ in range(6000):
        g = (1 / (1 + np.exp(-(x @ w + c))) - y) * importance
        w, c = w - 0.5 * (x.T @ g + l2 / len(y) * w), c - 0.5 * g.sum()
    share = y.mean()
    return 1 / (1 + np.exp(-(x @ w + c + np.log(share) - np.log1p(-share))))


def test_toxicity_equals_a_plain_statement_of_the_method(spark):
    rng = random.Random(9)
    rows = [(i, prose(rng, 12) + (" you idiot" if i % 3 == 0 else "")) for i in range(60)]
    labels = [(i, int(i % 3 == 0)) for i, _ in rows]
    docs, marked = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    model = toxicity.fit(docs, marked, F.col("doc_id").isNotNull())
    got = {r.doc_id: r.score for r in toxicity.score(docs, model).collect()}
    want = brute_toxicity([t.encode() for _, t in rows], [y for _, y in labels], toxicity.BITS, toxicity.ORDERS)
    assert max(abs(got[i] - want[i]) for i, _ in rows) < 0.02


def test_features_are_distinct_and_whole():
    f = toxicity.Featurizer((3,), 16)
    text = b"abc ABC  abc\nabc"
    assert len(f(text)) == len({" abc abc abc abc "[i : i + 3] for i in range(15)}) and len(f(None)) == len(f(b"")) == 0


def good_and_bad(rng, i):
    text = prose(rng, rng.randrange(60, 300))
    if i % 5 == 0:
        return " ".join(w for x in text.split()[:20] for w in [x] * 15)
    return text


def test_quality_on_held_out_rows(spark):
    rng = random.Random(8)
    rows = [(i, good_and_bad(rng, i)) for i in range(1200)] + [(5000, None), (5001, ""), (None, "text"), (5002, prose(rng, 30000)), (5002, None)]
    labels = [(i, int(i % 5 != 0)) for i in range(0, 1200, 2)] + [(None, 1), (3, None)]
    docs, marked = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int")
    got = quality.report(docs, marked).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got)
    held = [r for r in got if r.held_out and r.doc_id is not None and r.doc_id < 1200]
    assert np.mean([r.predicted == int(r.doc_id % 5 != 0) for r in held]) > 0.95


def test_quality_without_positives(spark):
    docs, marked = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string"), spark.createDataFrame([], "doc_id long, quality int")
    assert {r.score for r in quality.report(docs, marked).collect()} == {0.5}


def test_risk_is_unbiased_and_prior_is_found():
    rng = np.random.default_rng(0)
    pos, neg = rng.normal(2, 1, (4000, 1)), rng.normal(-2, 1, (4000, 1))
    mixed = np.concatenate([pos[:1400], neg[:600]])  # prior 0.7
    _, minus = quality.risk(pos[2000:, 0], mixed[:, 0], 0.7)
    direct = 0.3 * np.logaddexp(0, neg[2000:, 0]).mean()
    assert abs(minus - direct) < 0.08
    assert abs(quality.estimate_prior(pos[2000:, 0], mixed[:, 0]) - 0.7) < 0.06


def test_quality_edges(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, x string, kind string")
    marked = spark.createDataFrame([(1, 1)], "doc_id long, quality int")
    assert quality.report(empty, marked).count() == 0
    docs = spark.createDataFrame([(i, "some plain text here " * (i % 4 + 1), "c", "d") for i in range(40)] * 2, empty.schema)
    got = quality.report(docs, spark.createDataFrame([(i, 1) for i in range(40)], marked.schema)).collect()
    assert len(got) == 80 and len({(r.doc_id % 4, round(r.score, 9)) for r in got}) == 4  # equal texts, equal scores


def test_quality_model_equals_one_fitted_on_the_same_rows_by_hand(spark):
    rng = random.Random(11)
    rows = [(i, good_and_bad(rng, i)) for i in range(300)]
    labels = [(i, int(i % 5 != 0)) for i in range(0, 300, 2)]
    docs, marked = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int")
    model = quality.fit(docs, marked, F.col("doc_id") >= 0)
    stats = {i: quality.statistics(t.encode()) for i, t in rows}
    good = np.array([stats[i] for i, y in labels if y])
    want = quality.train(good, np.array([stats[i] for i, _ in rows]))
    assert abs(model.prior - want.prior) < 1e-9 and np.allclose(model.w, want.w)
    got = {r.doc_id: r.score for r in quality.score(docs, model).collect()}
    for i, _ in rows:
        knots, x = want.knots, np.array(stats[i])
        ramps = [min(1.0, max(0.0, (x[j] - knots[k, j]) / max(knots[k + 1, j] - knots[k, j], 1e-9))) for k in range(len(knots) - 1) for j in range(len(x))]
        width = [max(knots[-1, j] - knots[0, j], 0.02) for j in range(len(x))]
        ramps += [min(1.0, max(0.0, (x[j] - knots[-1, j]) / width[j])) for j in range(len(x))] + [min(1.0, max(0.0, (knots[0, j] - x[j]) / width[j])) for j in range(len(x))]
        z = sum(w * min(12, max(-12, (r - m) / s)) for w, r, m, s in zip(want.w, ramps, want.mean, want.scale, strict=True)) + want.b
        assert abs(got[i] - 1 / (1 + np.exp(-z))) < 1e-9
