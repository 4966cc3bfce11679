"""The supplied tables as the domain's views, and the same views in SQL.

chunks: documents (section = source, content type and confidence by id, quality
from labels); queries: the benchmark passages; samples: events;
page lines: the headings and paragraphs of raw pages; grids: parts; tasks,
resources and reservations: orders, suppliers and line items; order log: events.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom.operators import verbatim
from paperloom.schemas import CONTENT_TYPES, QUESTION_TYPES


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _pick(values: tuple[str, ...], index) -> F.Column:
    return F.element_at(F.array(*map(F.lit, values)), (index + 1).cast("int"))


def _sql_list(values: tuple[str, ...]) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.max("toxic").alias("toxic"), F.max("quality").alias("quality"))
    status = F.when(F.col("toxic") == 1, "quarantine").when(F.col("quality") == 1, "pass").when(F.col("quality") == 0, "warning").otherwise("unknown")
    docs = table(spark, sf_dir, "documents").join(labels, "doc_id", "left")
    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.col("source").alias("section_id"), "lang", _pick(CONTENT_TYPES, F.col("doc_id") % 9).alias("content_type"), ((F.col("doc_id") % 100) / 100).alias("confidence"), status.alias("rag_text_status"))


CHUNKS = f"""
  lab AS (SELECT doc_id, max(toxic) AS toxic, max(quality) AS quality FROM labels GROUP BY doc_id),
  chunks AS (SELECT doc_id, coalesce(text, '') AS text, source AS section_id, lang, {_sql_list(CONTENT_TYPES)}[doc_id % 9 + 1] AS content_type, (doc_id % 100) / 100 AS confidence,
    CASE WHEN toxic = 1 THEN 'quarantine' WHEN quality = 1 THEN 'pass' WHEN quality = 0 THEN 'warning' ELSE 'unknown' END AS rag_text_status
    FROM documents LEFT JOIN lab USING (doc_id))"""


def queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"), _pick(QUESTION_TYPES, F.col("item_id") % 8).alias("question_type"))


QUERIES = f"""
  queries AS (SELECT item_id AS query_id, text AS query, {_sql_list(QUESTION_TYPES)}[item_id % 8 + 1] AS question_type FROM benchmark)"""


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), F.col("embedding").alias("vector"))


def query_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stored vector of the same number stands for a query's embedding."""
    v = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))
    return v.join(queries(spark, sf_dir).select("query_id"), "query_id", "left_semi")


def relevant(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(query_id, doc_id): documents that hold a benchmark passage verbatim; the
    benchmark is the stated query set."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    items = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("passage"))
    return verbatim.holders(docs, items)


RELEVANT = "\n  relevant AS (SELECT DISTINCT item_id AS query_id, doc_id FROM documents d JOIN benchmark b ON contains(d.text, b.text))"


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("int")
    kind = F.col("event_type")
    return table(spark, sf_dir, "events").select(
        F.col("event_id"), F.col("ts").alias("timestamp"), F.when(kind == "error", "error").when(kind == "click", "fallback").otherwise("complete").alias("status"),
        F.when(kind == "error", F.when(k % 2 == 0, "TIMEOUT").otherwise("MODEL")).alias("error_code"), F.col("value").alias("total_seconds"),
        F.map_from_arrays(F.array(F.lit("dense"), F.lit("rerank")), F.array(F.col("value") * 0.25, F.col("value") * 0.5)).alias("stage_seconds"),
        (k % 5).alias("candidate_count"), (kind == "click").alias("fallback"), F.concat(F.lit("v"), (F.col("user_id") % 3).cast("string")).alias("release_version"),
        _pick(QUESTION_TYPES, F.col("user_id") % 8).alias("question_type"), F.when(F.col("user_id") % 2 == 0, "en").otherwise("zh").alias("language"), F.when(F.col("user_id") % 7 != 0, _pick(CONTENT_TYPES, F.col("user_id") % 9)).alias("document_type"),
    )


SAMPLES = f"""
  samples AS (SELECT event_id, ts AS timestamp, CASE event_type WHEN 'error' THEN 'error' WHEN 'click' THEN 'fallback' ELSE 'complete' END AS status,
    CASE WHEN event_type = 'error' THEN CASE WHEN k % 2 = 0 THEN 'TIMEOUT' ELSE 'MODEL' END END AS error_code, value AS total_seconds, k % 5 AS candidate_count, event_type = 'click' AS fallback,
    'v' || (user_id % 3) AS release_version, {_sql_list(QUESTION_TYPES)}[user_id % 8 + 1] AS question_type, CASE WHEN user_id % 2 = 0 THEN 'en' ELSE 'zh' END AS language,
    CASE WHEN user_id % 7 <> 0 THEN {_sql_list(CONTENT_TYPES)}[user_id % 9 + 1] END AS document_type
    FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events))"""


def page_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(document_id, page_id, pos, level, text): what follows each heading,
    paragraph, bold or list tag of the pages, in order; a document is ten pages."""
    rows = table(spark, sf_dir, "pages").select("page_id", F.posexplode(F.split(F.coalesce("html", F.lit("")), "<")).alias("pos", "part"))
    rows = rows.where(F.col("part").rlike("^(h[1-6]|p|b|li)[ >]"))
    level = F.nullif(F.regexp_extract("part", "^h([1-6])", 1), F.lit("")).cast("int")
    text = F.btrim(F.regexp_replace(F.regexp_replace("part", "^[^>]*>", ""), r"[ \t\r\n]+", " "))
    return rows.select(F.floor(F.col("page_id") / 10).alias("document_id"), "page_id", "pos", level.alias("level"), text.alias("text")).where("text != ''")


PAGE_LINES = r"""
  parts AS (SELECT page_id, unnest(string_split(coalesce(html, ''), '<')) AS part, generate_subscripts(string_split(coalesce(html, ''), '<'), 1) - 1 AS pos FROM pages),
  page_lines AS (SELECT * FROM (SELECT page_id // 10 AS document_id, page_id, pos, TRY_CAST(nullif(regexp_extract(part, '^h([1-6])', 1), '') AS INTEGER) AS level,
    trim(regexp_replace(regexp_replace(part, '^[^>]*>', ''), '[ \t\r\n]+', ' ', 'g')) AS text FROM parts WHERE regexp_matches(part, '^(h[1-6]|p|b|li)[ >]')) WHERE text <> '')"""
