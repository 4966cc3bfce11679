"""Queries of text predicates, retrieval, fusion, ranking and evaluation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom.functions import text as T
from paperloom.operators import evaluation, fusion, lexical, ranking, vector
from paperloom.operators.sizing import once
from paperloom.plans import adapters as A
from paperloom.plans.adapters import CHUNKS, QUERIES as QUERY_VIEW, RELEVANT, table

RATIOS = [1, 2, 3, 5, 10, 20]
TOP = 15

TOKENS = "list_transform(regexp_extract_all({}, '[A-Za-z0-9]+|[一-鿿]'), lambda x: lower(x))"

BM25 = f"""
  tok AS MATERIALIZED (SELECT doc_id, {TOKENS.format("text")} AS t FROM chunks),
  corpus AS (SELECT count(*) AS n, avg(len(t)) AS avgdl FROM tok),
  postings AS MATERIALIZED (SELECT doc_id, term, dl, count(*) AS tf FROM (SELECT doc_id, len(t) AS dl, unnest(t) AS term FROM tok) GROUP BY doc_id, term, dl),
  raw AS MATERIALIZED (SELECT term, ln(n - count(*) + 0.5) - ln(count(*) + 0.5) AS raw FROM postings, corpus GROUP BY term, n),
  terms AS MATERIALIZED (SELECT term, CASE WHEN raw < 0 THEN 0.25 * (SELECT avg(raw) FROM raw) ELSE raw END AS idf FROM raw),
  wanted AS MATERIALIZED (SELECT query_id, term, count(*) AS qtf FROM (SELECT query_id, unnest({TOKENS.format("query")}) AS term FROM queries) GROUP BY query_id, term),
  bm25 AS MATERIALIZED (SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM (
    SELECT query_id, doc_id, round(sum(qtf * idf * tf * 2.5 / (tf + 1.5 * (1 - 0.75 + 0.75 * dl / avgdl))), 6) AS score
    FROM wanted JOIN terms USING (term) JOIN postings USING (term), corpus GROUP BY query_id, doc_id) WHERE score > 0 QUALIFY rank <= 50)"""

DENSE = """
  dense AS (SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM (
    SELECT q.vec_id AS query_id, e.vec_id AS doc_id, round(list_dot_product(q.embedding::DOUBLE[], e.embedding::DOUBLE[]), 6) AS score
    FROM embeddings e, (SELECT * FROM embeddings WHERE vec_id IN (SELECT query_id FROM queries)) q) QUALIFY rank <= 50)"""

BOTH = """
  both_routes AS (SELECT query_id, doc_id, min(d) AS dense_rank, min(l) AS lexical_rank FROM (
    SELECT query_id, doc_id, rank AS d, NULL AS l FROM dense UNION ALL SELECT query_id, doc_id, NULL, rank FROM bm25) GROUP BY query_id, doc_id)"""


def _rrf_sql(ratio: str) -> str:
    return f"round(coalesce({ratio} / (dense_rank + 60), 0.0) + coalesce(1.0::DOUBLE / (lexical_rank + 60), 0.0), 9)"


RRF = f"""{BOTH},
  rrf AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, dense_rank ASC NULLS LAST, lexical_rank) AS rank
    FROM (SELECT *, {_rrf_sql("20.0::DOUBLE")} AS score FROM both_routes))"""

_compat = " ".join(f"WHEN question_type = '{q}' AND content_type = '{c}' THEN '{kind}'" for kind, pairs in (("primary", ranking.PRIMARY), ("supporting", ranking.SUPPORTING)) for q, cs in pairs.items() for c in cs)
RULE_SQL = f"""round(0.6::DOUBLE * CASE compat WHEN 'primary' THEN 1.0 WHEN 'supporting' THEN 0.5 ELSE 0.0 END + 0.2::DOUBLE * confidence
    + 0.2::DOUBLE * CASE rag_text_status WHEN 'pass' THEN 1.0 WHEN 'warning' THEN 0.75 WHEN 'quarantine' THEN 0.0 ELSE 0.5 END, 6)"""
RULES = f"""
  candidates AS (SELECT r.*, c.section_id, c.content_type, c.confidence, c.rag_text_status, q.question_type, CASE {_compat} ELSE 'none' END AS compat
    FROM rrf r JOIN chunks c USING (doc_id) JOIN queries q USING (query_id) WHERE rank <= {TOP}),
  reranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY final_score DESC, rank) AS final_rank FROM (
    SELECT *, round(0.8::DOUBLE * score * 3 + 0.2::DOUBLE * rule_score, 9) AS final_score FROM (SELECT *, {RULE_SQL} AS rule_score FROM candidates)))"""
HYBRID = f"WITH {CHUNKS}, {QUERY_VIEW}, {BM25}, {DENSE}, {RRF}, {RULES}"
ROLLED = """
  rolled AS (SELECT query_id, section_id, min(final_rank) AS best_rank, array_to_string(list(doc_id ORDER BY final_rank), ',') AS chunk_ids FROM reranked GROUP BY query_id, section_id)"""


def bm25(spark: SparkSession, d: str) -> DataFrame:
    return lexical.search(lexical.build(table(spark, d, "documents"), "doc_id", "text"), A.queries(spark, d))


def dense(spark: SparkSession, d: str) -> DataFrame:
    return vector.search(A.vectors(spark, d), A.query_vectors(spark, d))


def _routes(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """The lists of both routes, 50 rows a query, each worked out once for all
    that a query reads of it."""
    return once(dense(spark, d)), once(bm25(spark, d))


def rrf(spark: SparkSession, d: str) -> DataFrame:
    return _fused(dense(spark, d), bm25(spark, d))


def _fused(dense_list: DataFrame, lexical_list: DataFrame) -> DataFrame:
    return fusion.rrf(dense_list, lexical_list, dense_weight=20.0)


def reranked(spark: SparkSession, d: str, fused: DataFrame | None = None) -> DataFrame:
    """Fused candidates under a stand-in model score and the business rule."""
    fused = rrf(spark, d) if fused is None else fused
    hits = fused.where(F.col("rank") <= TOP).join(A.chunks(spark, d).drop("text"), "doc_id").join(A.queries(spark, d).drop("query"), "query_id")
    rule = ranking.rule_score(F.col("question_type"), F.col("content_type"), F.col("confidence"), F.col("rag_text_status"))
    return ranking.rerank(hits.withColumns({"rule_score": rule, "model_score": F.col("score") * 3, "compat": ranking.compatibility(F.col("question_type"), F.col("content_type"))}))


def hybrid_topk(spark: SparkSession, d: str) -> DataFrame:
    """BM25 and dense top 50, fused, reranked and rolled up into sections."""
    hits = once(reranked(spark, d).select("query_id", "section_id", F.col("doc_id").alias("chunk_id"), F.col("final_rank").alias("rank"), "final_score"))
    rolled = ranking.section_rollup(hits.drop("final_score"))
    best = hits.groupBy("query_id", "section_id").agg(F.max("final_score").alias("best_score"))
    return rolled.join(best, ["query_id", "section_id"]).select("query_id", "section_id", "section_rank", "best_rank", "best_score", F.array_join(F.transform("chunk_ids", lambda x: x.cast("string")), ",").alias("chunk_ids"))


def _stages(spark: SparkSession, d: str) -> DataFrame:
    """(stage, query_id, doc_id, rank) of all routes."""
    dense_list, lexical_list = _routes(spark, d)
    fused = once(_fused(dense_list, lexical_list))
    lists = {"dense": dense_list, "bm25": lexical_list, "rrf": fused, "reranker": once(reranked(spark, d, fused)).select("query_id", "doc_id", F.col("final_rank").alias("rank"))}
    out = None
    for name, ranked in lists.items():
        part = ranked.select(F.lit(name).alias("stage"), "query_id", "doc_id", F.col("rank").cast("int").alias("rank"))
        out = part if out is None else out.unionByName(part)
    return out


def stage_ranks(spark: SparkSession, d: str) -> DataFrame:
    rel = once(A.relevant(spark, d))
    return evaluation.first_rank(_stages(spark, d), rel, rel, keys=("stage",))


STAGE_RANKS = f"""{HYBRID}, {RELEVANT},
  stages AS (SELECT 'dense' AS stage, query_id, doc_id, rank FROM dense UNION ALL SELECT 'bm25', query_id, doc_id, rank FROM bm25
    UNION ALL SELECT 'rrf', query_id, doc_id, rank FROM rrf UNION ALL SELECT 'reranker', query_id, doc_id, final_rank FROM reranked),
  found AS (SELECT stage, query_id, min(rank) AS rank FROM stages JOIN relevant USING (query_id, doc_id) GROUP BY stage, query_id),
  stage_ranks AS (SELECT c.query_id, s.stage, f.rank FROM (SELECT DISTINCT query_id FROM relevant) c, (SELECT DISTINCT stage FROM stages) s LEFT JOIN found f ON f.query_id = c.query_id AND f.stage = s.stage)"""
METRICS = "count(*) AS cases, " + ", ".join(f"round(avg(CASE WHEN rank <= {k} THEN 1.0 ELSE 0.0 END), 4) AS hit_{k}" for k in evaluation.CUTS) + ", round(avg(coalesce(1.0::DOUBLE / rank, 0.0)), 4) AS mrr"


def tokens_count(spark: SparkSession, d: str) -> DataFrame:
    t = T.tokens(F.col("text"))
    return table(spark, d, "documents").select("doc_id", F.size(t).alias("n_tokens"), F.size(F.array_distinct(t)).alias("n_distinct"), T.language(F.coalesce("text", F.lit(""))).alias("language"))


def replacement_ratio(spark: SparkSession, d: str) -> DataFrame:
    """Every seventh text damaged; another representation every eleventh row."""
    docs = table(spark, d, "documents")
    damaged = F.when(F.col("doc_id") % 7 == 0, F.replace("text", F.lit("e"), F.lit("�"))).otherwise(F.col("text"))
    pages = docs.select("doc_id", F.when(F.col("doc_id") % 13 == 0, "").otherwise(damaged).alias("markdown_text"), F.when(F.col("doc_id") % 11 != 0, F.col("text")).alias("direct_text"), F.when(F.col("doc_id") % 3 == 0, F.col("text")).alias("ocr_text"), F.when(F.col("doc_id") % 17 == 0, "no language data").alias("ocr_error"))
    got = pages.select("doc_id", *[c.alias(n) for n, c in T.select_page().items()])
    return got.select("doc_id", "strategy", "status", "fallback_reason", "markdown_replacement_ratio", "direct_replacement_ratio", "selected_replacement_ratio", "ocr_used", F.length("text").alias("n_text"))


def _ratio_sql(c: str) -> str:
    return f"(length({c}) - length(replace({c}, '�', ''))) / greatest(length(regexp_replace({c}, '[\\s\\x{{00a0}}]', '', 'g')), 1)"


REPLACEMENT_SQL = f"""
  WITH p AS (SELECT doc_id, CASE WHEN doc_id % 13 = 0 THEN '' WHEN doc_id % 7 = 0 THEN replace(text, 'e', '�') ELSE text END AS md, CASE WHEN doc_id % 11 <> 0 THEN text ELSE '' END AS di,
    CASE WHEN doc_id % 3 = 0 THEN text ELSE '' END AS ocr, CASE WHEN doc_id % 17 = 0 THEN 'no language data' END AS err FROM documents),
  r AS (SELECT *, {_ratio_sql("md")} AS mr, {_ratio_sql("di")} AS dr, regexp_matches(md, '[\\p{{L}}\\p{{N}}]') AS mu, regexp_matches(di, '[\\p{{L}}\\p{{N}}]') AS du, regexp_matches(ocr, '[\\p{{L}}\\p{{N}}]') AS ou FROM p),
  k AS (SELECT *, CASE WHEN mr > 0.1 AND du AND dr < mr THEN 1 WHEN NOT mu AND du THEN 2 WHEN NOT mu AND NOT du THEN 3 ELSE 4 END AS rule FROM r),
  s AS (SELECT *, CASE WHEN rule IN (1, 2) THEN di WHEN rule = 3 AND err IS NOT NULL THEN '' WHEN rule = 3 THEN ocr ELSE md END AS sel FROM k),
  f AS (SELECT *, {_ratio_sql("sel")} AS sr FROM s)
  SELECT doc_id, CASE WHEN rule IN (1, 2) THEN 'plain_text' WHEN rule = 3 THEN 'ocr' ELSE 'markdown' END AS strategy,
    CASE WHEN sr > 0.1 OR rule = 3 AND (err IS NOT NULL OR NOT ou) THEN 'failed' ELSE 'complete' END AS status,
    CASE WHEN sr > 0.1 THEN 'selected_text_replacement_ratio' WHEN rule = 1 THEN 'markdown_replacement_ratio' WHEN rule = 2 THEN 'markdown_empty' WHEN rule = 3 AND err IS NULL AND NOT ou THEN 'ocr_returned_no_text' WHEN rule = 3 THEN 'no_extractable_text' END AS fallback_reason,
    round(mr, 4) AS markdown_replacement_ratio, round(dr, 4) AS direct_replacement_ratio, round(sr, 4) AS selected_replacement_ratio, rule = 3 AS ocr_used, length(sel) AS n_text FROM f"""


def business_rule_score(spark: SparkSession, d: str) -> DataFrame:
    """Every chunk under the eight question types."""
    from paperloom.schemas import QUESTION_TYPES

    each = A.chunks(spark, d).withColumn("question_type", F.explode(F.array(*map(F.lit, QUESTION_TYPES))))
    q, c = F.col("question_type"), F.col("content_type")
    return each.select("doc_id", "question_type", "content_type", ranking.compatibility(q, c).alias("compat"), ranking.rule_score(q, c, F.col("confidence"), F.col("rag_text_status")).alias("rule_score"))


def rank_delta(spark: SparkSession, d: str) -> DataFrame:
    fused = once(rrf(spark, d))
    before = fused.where(F.col("rank") <= TOP)
    after = reranked(spark, d, fused).where(F.col("final_rank") <= 10).select("query_id", "doc_id", F.col("final_rank").alias("rank"))
    return ranking.rank_delta(before, after)


def rrf_weight_sweep(spark: SparkSession, d: str) -> DataFrame:
    rel = once(A.relevant(spark, d))
    swept = fusion.rrf_sweep(*_routes(spark, d), RATIOS)
    return evaluation.metrics(evaluation.first_rank(swept, rel, rel, keys=("ratio",)), "ratio")


def eval_by_slice(spark: SparkSession, d: str) -> DataFrame:
    lang = table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), T.language(F.coalesce("text", F.lit(""))).alias("language"))
    return evaluation.metrics(stage_ranks(spark, d).join(lang, "query_id"), "language", "stage")


def reranker_effect(spark: SparkSession, d: str) -> DataFrame:
    from paperloom.operators import monitoring

    wide = stage_ranks(spark, d).groupBy("query_id").pivot("stage", ["rrf", "reranker"]).agg(F.first("rank"))
    return monitoring.reranker_effect(wide.join(A.queries(spark, d).select("query_id", "question_type"), "query_id"))


def bad_case_detect(spark: SparkSession, d: str) -> DataFrame:
    from paperloom.operators import monitoring

    wide = stage_ranks(spark, d).groupBy("query_id").pivot("stage", ["rrf", "reranker"]).agg(F.first("rank"))
    cases = wide.select(
        F.col("query_id").cast("string").alias("case_id"), F.lit("reranker").alias("final_stage"), F.struct(F.col("rrf"), F.col("reranker")).alias("ranks"), F.when(F.col("query_id") % 3 == 0, F.when(F.col("rrf").isNotNull(), 1).otherwise(0)).alias("n_candidates"),
        F.when(F.col("query_id") % 5 == 0, "out of memory").alias("reranker_error"), (F.col("query_id") % 4 == 0).alias("safety"),
    )
    return monitoring.retrieval_bad_cases(cases, "v2").select("key", "case_id", "failure_stage", "reason", "safety", "status")


BAD_CASE_SQL = f"""{STAGE_RANKS},
  wide AS (SELECT query_id, max(rank) FILTER (stage = 'rrf') AS rrf, max(rank) FILTER (stage = 'reranker') AS reranker FROM stage_ranks GROUP BY query_id),
  c AS (SELECT query_id::VARCHAR AS case_id, rrf, reranker, CASE WHEN query_id % 3 = 0 THEN CASE WHEN rrf IS NOT NULL THEN 1 ELSE 0 END END AS n, query_id % 5 = 0 AS err, query_id % 4 = 0 AS safe FROM wide),
  hits AS (SELECT case_id, 'retrieval' AS failure_stage, 'empty_retrieval' AS reason, false AS safety FROM c WHERE n = 0
    UNION ALL SELECT case_id, 'reranker', 'expected_rank_gt_5', false FROM c WHERE reranker IS NULL OR reranker > 5
    UNION ALL SELECT case_id, 'reranker', 'reranker_fallback', false FROM c WHERE err
    UNION ALL SELECT case_id, 'reranker', 'reranker_demoted_expected', false FROM c WHERE rrf IS NOT NULL AND (reranker IS NULL OR reranker > rrf)
    UNION ALL SELECT case_id, 'reranker', 'safety_case_failed', true FROM c WHERE safe AND (reranker IS NULL OR reranker > 1))
  SELECT case_id || ':' || failure_stage || ':' || reason AS key, case_id, failure_stage, reason, safety, 'OPEN' AS status FROM hits"""


QUERIES = {
    "hybrid_topk": hybrid_topk, "tokens_count": tokens_count, "replacement_ratio": replacement_ratio, "bm25_topk": bm25, "dense_topk": dense, "rrf_fusion": rrf, "rrf_weight_sweep": rrf_weight_sweep,
    "business_rule_score": business_rule_score, "section_rollup": lambda s, d: ranking.section_order(reranked(s, d).select("query_id", "section_id", "doc_id", F.col("final_rank").alias("rank"))),
    "rank_delta": rank_delta, "eval_metrics": lambda s, d: evaluation.metrics(stage_ranks(s, d), "stage"), "eval_by_slice": eval_by_slice, "reranker_effect": reranker_effect, "bad_case_detect": bad_case_detect,
    "vector_preconditions": lambda s, d: vector.violations(A.vectors(s, d)),
}

_effect = "count(*) FILTER (rrf IS NOT NULL) AS eligible_cases, round(count(*) FILTER (reranker < rrf) / greatest(count(*) FILTER (rrf IS NOT NULL), 1), 6) AS positive_lift_rate, round(count(*) FILTER (rrf IS NOT NULL AND (reranker IS NULL OR reranker > rrf)) / greatest(count(*) FILTER (rrf IS NOT NULL), 1), 6) AS harm_rate"
ORACLES = {
    "hybrid_topk": f"{HYBRID}, {ROLLED} SELECT r.query_id, r.section_id, row_number() OVER (PARTITION BY r.query_id ORDER BY best_rank) AS section_rank, best_rank, best_score, chunk_ids FROM rolled r JOIN (SELECT query_id, section_id, max(final_score) AS best_score FROM reranked GROUP BY ALL) b USING (query_id, section_id)",
    "tokens_count": f"SELECT doc_id, len({TOKENS.format('text')}) AS n_tokens, len(list_distinct({TOKENS.format('text')})) AS n_distinct, CASE WHEN regexp_matches(text, '[一-鿿]') THEN 'zh' ELSE 'en' END AS language FROM documents",
    "replacement_ratio": REPLACEMENT_SQL,
    "bm25_topk": f"WITH {CHUNKS}, {QUERY_VIEW}, {BM25} SELECT query_id, doc_id, score, rank FROM bm25",
    "dense_topk": f"WITH {QUERY_VIEW}, {DENSE} SELECT query_id, doc_id, score, rank FROM dense",
    "rrf_fusion": f"WITH {CHUNKS}, {QUERY_VIEW}, {BM25}, {DENSE}, {RRF} SELECT query_id, doc_id, dense_rank, lexical_rank, score, rank FROM rrf",
    "rrf_weight_sweep": f"""WITH {CHUNKS}, {QUERY_VIEW}, {BM25}, {DENSE}, {BOTH}, {RELEVANT},
      swept AS (SELECT ratio, query_id, doc_id, row_number() OVER (PARTITION BY query_id, ratio ORDER BY score DESC, dense_rank ASC NULLS LAST, lexical_rank) AS rank
        FROM (SELECT *, {_rrf_sql("ratio")} AS score FROM both_routes, (SELECT unnest({[float(r) for r in RATIOS]})::DOUBLE AS ratio))),
      found AS (SELECT ratio, query_id, min(rank) AS rank FROM swept JOIN relevant USING (query_id, doc_id) GROUP BY ALL),
      ranks AS (SELECT r.ratio, c.query_id, f.rank FROM (SELECT DISTINCT query_id FROM relevant) c, (SELECT DISTINCT ratio FROM swept) r LEFT JOIN found f ON f.query_id = c.query_id AND f.ratio = r.ratio)
      SELECT ratio, {METRICS} FROM ranks GROUP BY ratio""",
    "business_rule_score": f"WITH {CHUNKS}, each AS (SELECT *, CASE {_compat} ELSE 'none' END AS compat FROM (SELECT *, unnest({list(ranking.QUESTION_LABELS)}) AS question_type FROM chunks)) SELECT doc_id, question_type, content_type, compat, {RULE_SQL} AS rule_score FROM each",
    "section_rollup": f"{HYBRID} SELECT query_id, section_id, doc_id, rank, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS section_rank FROM (SELECT query_id, section_id, arg_min(doc_id, final_rank) AS doc_id, min(final_rank) AS rank FROM reranked GROUP BY ALL)",
    "rank_delta": f"""{HYBRID} SELECT coalesce(a.query_id, b.query_id) AS query_id, coalesce(a.doc_id, b.doc_id) AS doc_id, a.rank AS before_rank, b.final_rank AS after_rank, coalesce(a.rank, 21) - coalesce(b.final_rank, 21) AS delta
      FROM (SELECT * FROM rrf WHERE rank <= {TOP}) a FULL JOIN (SELECT * FROM reranked WHERE final_rank <= 10) b ON a.query_id = b.query_id AND a.doc_id = b.doc_id""",
    "eval_metrics": f"{STAGE_RANKS} SELECT stage, {METRICS} FROM stage_ranks GROUP BY stage",
    "eval_by_slice": f"{STAGE_RANKS} SELECT language, stage, {METRICS} FROM stage_ranks JOIN (SELECT item_id AS query_id, CASE WHEN regexp_matches(coalesce(text, ''), '[一-鿿]') THEN 'zh' ELSE 'en' END AS language FROM benchmark) USING (query_id) GROUP BY ALL",
    "reranker_effect": f"""{STAGE_RANKS}, wide AS (SELECT query_id, max(rank) FILTER (stage = 'rrf') AS rrf, max(rank) FILTER (stage = 'reranker') AS reranker FROM stage_ranks GROUP BY query_id)
      SELECT coalesce(question_type, 'overall') AS question_type, {_effect} FROM wide JOIN queries USING (query_id) GROUP BY ROLLUP (question_type)""",
    "bad_case_detect": BAD_CASE_SQL,
    "vector_preconditions": "SELECT count(*) AS n, count(*) FILTER (embedding IS NULL) AS missing, count(DISTINCT len(embedding)) AS dimensions, coalesce(min(len(embedding)), 0) AS dimension, count(*) > 0 AND count(*) FILTER (embedding IS NULL) = 0 AND count(DISTINCT len(embedding)) = 1 AND coalesce(min(len(embedding)), 0) > 0 AS ready FROM embeddings",
}
