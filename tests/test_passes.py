"""Retrieval in few passes: what a task keeps, repeated ids, verbatim passages."""

import math
import random
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest

from paperloom.operators import lexical, topk, vector, verbatim

TABLES = Path("/root/testdata/sf0.001")


def test_best_of_many_batches(monkeypatch):
    monkeypatch.setattr(topk, "HELD", 1)
    rng = np.random.default_rng(0)
    scores = rng.integers(0, 6, (400, 3)).astype(float)  # many ties
    scores[5, 0], scores[6, 1] = np.nan, -np.inf
    for items in (pa.array(rng.permutation(400)), pa.array([f"c{i}" for i in rng.permutation(400)])):
        best = topk.Best(3, 7)
        for i in range(0, 400, 13):
            best.offer(scores[i : i + 13], items.slice(i, 13))
            assert best.rows <= 2 * 3 * 7 + 13 * 3
        got = best.batch(pa.array(["x", "y", "z"]))
        ids = items.to_pylist()
        for q, name in enumerate("xyz"):
            order = sorted(range(400), key=lambda i: (-math.inf if np.isnan(scores[i, q]) else -scores[i, q], ids[i]))[:7]
            rows = [r["doc_id"] for r in got.to_pylist() if r["query_id"] == name]
            assert rows == [ids[i] for i in order]
    assert topk.Best(2, 3).batch(pa.array([1, 2])) is None
    assert topk.rounded(np.array([0.0078125, -0.0078125, 1e300, 2.0]), 6).tolist() == [0.007813, -0.007813, 1e300, 2.0]


def test_bm25_in_bounds_and_repeated_ids(spark, monkeypatch):
    rng = random.Random(1)
    docs = [(i % 37, " ".join(rng.choices(["a", "B", "c", "dd", "世", "é"], weights=[9, 4, 2, 1, 1, 3], k=rng.randrange(0, 25)))) for i in range(60)] + [(99, None)]
    queries = [(q, t) for q, t in enumerate(["a b", "世 dd dd", "zz", "", None, "c A a"])]
    one = [(r.query_id, r.doc_id, r.score, r["rank"]) for r in lexical.search(lexical.build(spark.createDataFrame(docs, "id long, text string"), "id", "text"), spark.createDataFrame(queries, "query_id int, query string"), 5).collect()]
    toks = [(i, [t for t in (x or "").lower().split() if t != "é"]) for i, x in docs]
    n, avg = len(toks), sum(len(t) for _, t in toks) / len(toks)
    words = {t for _, ts in toks for t in ts}
    idf = {t: math.log(n - c + 0.5) - math.log(c + 0.5) for t in words for c in [sum(t in ts for _, ts in toks)]}
    idf = {t: v if v >= 0 else 0.25 * sum(idf.values()) / len(idf) for t, v in idf.items()}
    want = []
    for q, text in queries:
        scores = {}
        for d in {i for i, _ in toks}:
            tf = {}
            for i, ts in toks:
                for t in ts if i == d else ():
                    tf[t, len(ts)] = tf.get((t, len(ts)), 0) + 1
            scores[d] = round(sum(idf[t] * c * 2.5 / (c + 1.5 * (0.25 + 0.75 * dl / avg)) for w in (text or "").lower().split() for (t, dl), c in tf.items() if t == w), 6)
        best = sorted((-s, d) for d, s in scores.items() if s > 0)[:5]
        want += [(q, d, -s, k + 1) for k, (s, d) in enumerate(best)]
    assert sorted(one) == sorted(want)
    monkeypatch.setattr(lexical, "QUERY_BYTES", 70)
    monkeypatch.setattr(topk, "CELLS", 4)
    blocks = lexical.search(lexical.build(spark.createDataFrame(docs, "id long, text string"), "id", "text"), spark.createDataFrame(queries, "query_id int, query string"), 5)
    assert sorted((r.query_id, r.doc_id, r.score, r["rank"]) for r in blocks.collect()) == sorted(want)


def test_scores_do_not_leave_their_task(spark):
    docs = spark.range(400).selectExpr("id", "concat('a b ', id) as text").repartition(2)
    found = lexical.search(lexical.build(docs, "id", "text"), spark.createDataFrame([(1, "a"), (2, "b")], "query_id int, query string"), 3)
    assert found.count() == 6 and "Generate" not in found._jdf.queryExecution().executedPlan().toString()


def test_dense_nulls_and_lengths(spark):
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, None), (3, [1.0]), (4, [None, 1.0]), (5, [0.5, 3.0]), (6, [1.0, 9.0])], "doc_id int, vector array<double>")
    got = vector.search(v, spark.createDataFrame([("p", [1.0, 0.0]), ("n", None)], "query_id string, vector array<double>"), 5).orderBy("query_id", "rank").collect()
    assert [(r.doc_id, r.score) for r in got if r.query_id == "p"] == [(1, 1.0), (6, 1.0), (5, 0.5), (2, None), (3, None)]
    assert [(r.doc_id, r.score) for r in got if r.query_id == "n"] == [(i, None) for i in range(1, 6)]


def test_verbatim(spark, monkeypatch):
    rng = random.Random(2)
    word = lambda: "".join(rng.choices("abé ", k=rng.randrange(0, 40)))
    texts = [None, "", *[word() * 3 for _ in range(80)]]
    items = [None, "", "ab", "é", "not there at all", *[t[3:30] for t in texts[2:30]], *[t[1:20] for t in texts[30:40]]]
    want = {(q, d) for q, p in enumerate(items) for d, t in enumerate(texts) if p is not None and t is not None and p in t}
    for size in (1 << 20, 400):
        monkeypatch.setattr(verbatim, "PASSAGE_BYTES", size)
        got = verbatim.holders(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), spark.createDataFrame(list(enumerate(items)), "query_id int, passage string")).collect()
        assert len(got) == len(want) and {tuple(r) for r in got} == want


@pytest.mark.skipif(not TABLES.exists(), reason="the supplied tables are not here")
def test_lists_are_worked_out_once(spark):
    from paperloom.plans import retrieval

    plan = retrieval.stage_ranks(spark, str(TABLES))._jdf.queryExecution().withCachedData().treeString()
    assert plan.count("InMemoryRelation") >= 4
    spark.catalog.clearCache()


def test_strings_become_objects_a_few_at_a_time():
    import tracemalloc

    import pyarrow.compute as pc

    from paperloom.operators.sizing import mapped

    texts = pa.array([None, "", *["é" * 5000] * 4000])
    tracemalloc.start()
    got = mapped(texts, lambda t: None if t is None else [t, t], pa.list_(pa.string()))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 8 << 20 and got.null_count == 1 and len(got) == 4002 and pc.sum(pc.binary_length(got.flatten())).as_py() == 2 * 2 * 5000 * 4000
    assert len(mapped(pa.array([], pa.string()), str, pa.string())) == 0
    sliced = mapped(pa.array(["a", "bb", "ccc"]).slice(1), len, pa.int64(), 1)
    assert sliced.to_pylist() == [2, 3]
