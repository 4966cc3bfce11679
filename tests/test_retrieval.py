"""Literal cases of ranking and fusion, and BM25 against its definition."""

import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from paperloom.operators import evaluation, fusion, lexical, ranking, vector

RANKED = "query_id string, doc_id long, rank int"


def ranked(spark, *docs, q="q"):
    return spark.createDataFrame([(q, d, i + 1) for i, d in enumerate(docs)], RANKED)


def order(df):
    return [r.doc_id for r in df.orderBy("rank").collect()]


def test_rrf(spark):
    assert order(fusion.rrf(ranked(spark, 0, 1, 2), ranked(spark, 1, 2))) == [1, 2, 0]
    a, b = ranked(spark, 0, 1), ranked(spark, 1, 0)
    assert order(fusion.rrf(a, b, dense_weight=2)) == [0, 1] and order(fusion.rrf(a, b, lexical_weight=2)) == [1, 0] and order(fusion.rrf(a, b)) == [0, 1]


def test_bm25_definition(spark):
    rng = random.Random(0)
    docs = [(i, " ".join(rng.choices("abcdefgh", weights=[30, 8, 4, 2, 1, 1, 1, 1], k=rng.randrange(0, 30)))) for i in range(40)]
    queries = [("q1", "a b b e"), ("q2", "h Z 世"), ("q3", "")]
    toks = {i: t.split() for i, t in docs}
    n, avg = len(docs), sum(map(len, toks.values())) / len(docs)
    df = Counter(t for ts in toks.values() for t in set(ts))
    idf = {t: math.log(n - c + 0.5) - math.log(c + 0.5) for t, c in df.items()}
    mean = sum(idf.values()) / len(idf)
    idf = {t: 0.25 * mean if v < 0 else v for t, v in idf.items()}
    got = lexical.search(lexical.build(spark.createDataFrame(docs, "id long, text string"), "id", "text"), spark.createDataFrame(queries, "query_id string, query string"))
    for q, text in queries:
        want = {i: sum(idf.get(t, 0) * ts.count(t) * 2.5 / (ts.count(t) + 1.5 * (0.25 + 0.75 * len(ts) / avg)) for t in text.lower().split() if t in ts) for i, ts in toks.items()}
        want = sorted(((round(s, 6), i) for i, s in want.items() if round(s, 6) > 0), key=lambda x: (-x[0], x[1]))
        assert [(r.score, r.doc_id) for r in got.where(F.col("query_id") == q).orderBy("rank").collect()] == want


def test_dense_blocks_codec_and_models(spark, monkeypatch):
    rng = np.random.default_rng(0)
    v = spark.createDataFrame([(i, [float(x) for x in rng.normal(size=4)]) for i in range(50)], "doc_id long, vector array<float>")
    q = v.where("doc_id < 9").select(F.col("doc_id").alias("query_id"), "vector")
    one = sorted(map(tuple, vector.search(v, q, 5).collect()))
    monkeypatch.setattr(vector, "BROADCAST_BYTES", 256)
    assert sorted(map(tuple, vector.search(v, q, 5).collect())) == one and len(one) == 45
    assert v.select(vector.unpack_f32(vector.pack_f32("vector")).alias("x")).collect() == v.select(F.col("vector").alias("x")).collect()
    got = vector.embed(spark.createDataFrame([("ab",), (None,)], "t string"), "t", lambda ts: np.array([[len(t), 0.0] for t in ts])).collect()
    assert [list(r.vector) for r in got] == [[1.0, 0.0], [0.0, 0.0]]
    assert vector.violations(v).first().ready and not vector.violations(v.limit(0)).first().ready


def test_rules(spark):
    row = lambda q, c, s, st: spark.range(1).select(ranking.rule_score(F.lit(q), F.lit(c), F.lit(s).cast("double"), F.lit(st)).alias("r"), ranking.compatibility(F.lit(q), F.lit(c)).alias("k")).first()
    assert tuple(row("principle", "technical_training", 0.95, "pass")) == (0.99, "primary")
    assert row("competition", "equipment_list", 1.0, "pass").k == "none" and row("nonsense", "other", 1.0, "pass").r == 0
    assert row("general", "other", None, None).r == 0.4


def test_rerank_fallback_and_labels(spark):
    c = spark.createDataFrame([("q", 1, 1, 0.1, 0.0), ("q", 2, 2, 0.9, 1.0), ("p", 1, 1, None, 1.0), ("p", 2, 2, 0.9, 1.0)], "query_id string, doc_id long, rank int, model_score double, rule_score double")
    got = {(r.query_id, r.doc_id): (r.final_rank, r.fallback) for r in ranking.rerank(c).collect()}
    assert got == {("q", 2): (1, False), ("q", 1): (2, False), ("p", 1): (1, True), ("p", 2): (2, True)}
    score = lambda s: spark.createDataFrame([(s,)], "a string").select(ranking.label_score(F.col("a"))).first()[0]
    assert [score("Answer: direct."), score("RELATED"), score("irrelevant")] == [1.0, 0.5, 0.0]
    with pytest.raises(Exception, match="relevance label"):
        score("no idea")
    assert round(spark.range(1).select(ranking.yes_probability(F.lit(0.0), F.lit(0.0))).first()[0], 3) == 0.5


def test_rollup_delta_summary(spark):
    hits = spark.createDataFrame([("q", "s1", "c1", 1), ("q", "gone", "c2", 2), ("q", "s2", "c3", 3), ("q", "s1", "c4", 4)], "query_id string, section_id string, chunk_id string, rank int")
    known = spark.createDataFrame([("s1",), ("s2",)], "section_id string")
    assert {(r.section_id, r.section_rank, tuple(r.chunk_ids)) for r in ranking.section_rollup(hits, known).collect()} == {("s1", 1, ("c1", "c4")), ("s2", 3, ("c3",))}
    assert {r.doc_id: r.delta for r in ranking.rank_delta(ranked(spark, 0, 1, 2), ranked(spark, 2, 0, 1)).collect()} == {2: 2, 0: -1, 1: -1}
    assert len(ranking.candidate_summary(ranked(spark, *range(30))).first().candidates) == 20


def test_evaluation(spark):
    cases = spark.createDataFrame([("q",), ("p",)], "query_id string")
    rel = spark.createDataFrame([("q", 7)], "query_id string, doc_id long")
    ranks = evaluation.first_rank(ranked(spark, 3, 7), rel, cases)
    m = evaluation.metrics(ranks.where("query_id = 'q'")).first()
    assert (m.hit_1, m.hit_3, m.hit_5, m.hit_10, m.mrr) == (0, 1, 1, 1, 0.5)
    assert evaluation.metrics(ranks).first().mrr == 0.25
    e = spark.createDataFrame([("T", ["A", "B"], [("T", ["B"])]), ("T", ["A"], [("T", ["B"])])], "title string, path array<string>, exp array<struct<title:string,path_contains:array<string>>>")
    assert [r[0] for r in e.select(evaluation.expected(F.col("title"), F.col("path"), F.col("exp"))).collect()] == [True, False]
    rep = spark.createDataFrame([("c1", "x", "r1"), (None, "y", "r2")], "case_id string, query string, result string")
    ask = spark.createDataFrame([("c1", "other"), ("c2", "y")], "case_id string, query string")
    assert {r.case_id: r.result for r in evaluation.replay(ask, rep).collect()} == {"c1": "r1", "c2": "r2"}


def test_annotation_violations(spark):
    sections = spark.createDataFrame([("s", "d", "the quote is here", 2, 4)], "section_id string, document_id string, text string, page_start int, page_end int")
    row = lambda i, **o: tuple(({"case_id": i, "case_kind": "positive", "language": "en", "query": f"what {i}", "expected_document_id": "d", "expected_section_id": "s", "evidence_quote": "quote", "evidence_page_start": 2, "evidence_page_end": 3} | o).values())
    cases = spark.createDataFrame([row("a"), row("b", evidence_quote="absent"), row("c", language="zh"), row("d", expected_section_id="x")], "case_id string, case_kind string, language string, query string, expected_document_id string, expected_section_id string, evidence_quote string, evidence_page_start int, evidence_page_end int")
    assert {(r.case_id, r.violation) for r in evaluation.annotation_violations(cases, sections, 4).collect()} == {("b", "quote_not_verbatim"), ("c", "language_mismatch"), ("d", "unknown_section")}


def test_service_answers_requests(spark):
    from paperloom.operators import service

    chunk = "chunk_id string, document_id string, section_id string, document_content_type string, metadata_confidence double, quality struct<rag_text_status:string,table_quality:string>, text string, index_text string"
    chunks = spark.createDataFrame([(f"c{i}", f"D{i % 2}", f"s{i % 3}", "technical_training", 0.9, ("pass", None), f"text about engine {'valve' if i % 2 else 'pump'} {i}", f"index {i}") for i in range(6)], chunk)
    sections = spark.createDataFrame([(f"s{i}", f"D{i}", f"Title {i}", ["p"], 1, 2, "body") for i in range(2)], "section_id string, document_id string, title string, path array<string>, page_start int, page_end int, text string")
    documents = spark.createDataFrame([("D0", "d0.pdf", "other", 0.5)], "document_id string, filename string, content_type string, metadata_confidence double")
    vectors = spark.createDataFrame([(f"c{i}", [1.0, float(i)]) for i in range(6)], "doc_id string, vector array<double>")
    engine = service.Engine(chunks, sections, documents, vectors, lambda c: c.withColumn("model_score", F.length("chunk_profile") / 100.0))
    asked = spark.createDataFrame([(1, "valve engine", "principle", 4), (2, "pump", "repair", None)], "query_id long, query string, question_type string, top_chunks int")
    got = engine.retrieve(asked, spark.createDataFrame([(1, [0.0, 1.0]), (2, [1.0, 0.0])], "query_id long, vector array<double>"))
    by_query = {q: got.chunks.where(f"query_id = {q}").orderBy("rank").collect() for q in (1, 2)}
    assert [len(v) for v in by_query.values()] == [4, 6] and [r.rank for r in by_query[2]] == [1, 2, 3, 4, 5, 6] and engine.ready()
    assert {r.section_id for r in got.sections.collect()} <= {"s0", "s1"} and {r.document_id for r in got.documents.collect()} == {"D0"}
    payload = {r.query_id: r for r in service.agent_payload(got).collect()}
    assert all(len(r.sources) == 1 and r.sources[0].filename == "d0.pdf" for r in payload.values())
    assert {e.section_title for r in payload.values() for e in r.evidence} <= {"Title 0", "Title 1", None}
    for bad in ({"query": " "}, {"query": "q" * 4001}, {"question_type": "odd"}, {"top_chunks": 16}):
        with pytest.raises(Exception, match="query is empty|unknown question|top_chunks"):
            service.checked_requests(asked.withColumns({k: F.lit(v) for k, v in bad.items()})).collect()
    with pytest.raises(Exception, match="must not be empty"):
        asked.select(service.profile_pair(F.col("question_type"), F.lit(" "), F.col("query"), F.lit("x"))).collect()


def test_levels_and_report(spark):
    hits = spark.createDataFrame([(1, 1, "s1", "d1"), (1, 2, "s1", "d1"), (1, 3, "s2", "d1"), (1, 4, "s3", "d2"), (2, 1, "s9", "d9")], "query_id int, rank int, section string, document string")
    relevant = spark.createDataFrame([(1, "s3", "d2"), (2, "s8", "d9")], "query_id int, section string, document string")
    got = {r.level: r for r in evaluation.level_metrics(hits, relevant, relevant, ("section", "document")).collect()}
    assert (got["section"].hit_3, got["section"].mrr, got["document"].hit_1, got["document"].mrr) == (0.5, 0.1667, 0.5, 0.75)
    ranks = spark.createDataFrame([("dense", 1, 1), ("dense", 2, None), ("rrf", 1, 2), ("rrf", 2, 1)], "stage string, query_id int, rank int")
    r = evaluation.report(ranks).first()
    assert [(s.stage, s.cases, s.hit_1, s.mrr) for s in r.stages] == [("dense", 2, 0.5, 0.5), ("rrf", 2, 0.5, 0.75)] and [c.query_id for c in r.cases] == [1, 2] and '"rrf":2' in r.cases[0].result


def test_ingestion_job(spark, tmp_path):
    from paperloom.plans import ingestion

    schema = "document_id string, page int, markdown_text string, direct_text string, ocr_text string, ocr_error string, toc_items array<struct<level:int,title:string,page:int>>"
    rows = [(d, p, f"# Chapter {p}\nBody of page {p} in {d}.\n", "x", None, None, None) for d in ("A", "B") for p in (1, 2)]
    raw = spark.createDataFrame(rows, schema)
    done = ingestion.ingest(spark, raw, f"{tmp_path}/w", f"{tmp_path}/o")
    chunks = ingestion.io.published(spark, f"{tmp_path}/o", "chunks", done.version)
    assert chunks.count() == 4 and set(done.seconds) == {"pages", "clean", "sections", "chunks", "report"} and all(s > 0 for s in done.seconds.values())
    assert {r.section_id for r in ingestion.io.published(spark, f"{tmp_path}/o", "sections", done.version).collect()} == {f"{d}:s000{i}" for d in "AB" for i in (1, 2)}
    failed = raw.unionByName(spark.createDataFrame([("C", None, None, None, None, "ValueError: broken", None)], schema))
    assert {r.document_id: r.error for r in ingestion.document_statuses(failed).where("status = 'failed'").collect()} == {"C": "ValueError: broken"}
    with pytest.raises(ValueError, match="C failed"):
        ingestion.ingest(spark, failed, f"{tmp_path}/w", f"{tmp_path}/o")
    with pytest.raises(Exception):  # the earlier output is withdrawn
        ingestion.io.published(spark, f"{tmp_path}/o", "chunks", done.version)
    for bad in ({"chunk_size": 0}, {"chunk_overlap": 1800}, {"dpi": 50}, {"ocr_language": " "}, {"replacement_threshold": 1.1}):
        with pytest.raises(ValueError):
            ingestion.Settings(**bad).checked()
