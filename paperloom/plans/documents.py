"""Queries of cleaning, tables, sections, chunks, annotations and windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from paperloom.functions.text import line_key
from paperloom.operators import chunking, cleaning, sections, tables
from paperloom.plans import adapters as A
from paperloom.plans.adapters import PAGE_LINES, SAMPLES, table
from paperloom.streaming import runtime


def _doc_lines(spark: SparkSession, d: str) -> DataFrame:
    """Sentences of documents as picture lines; a source is the document."""
    docs = table(spark, d, "documents").where("text is not null")
    rows = docs.select(F.col("source").alias("document_id"), F.col("doc_id").alias("page"), F.posexplode(F.split("text", r"[.\n]")).alias("pos", "line"))
    return rows.withColumn("line", F.btrim("line")).withColumn("line_key", line_key(F.col("line"))).where("line != ''")


LINES = """
  l0 AS (SELECT source AS document_id, doc_id AS page, unnest(string_split_regex(text, '[.\\n]')) AS line, generate_subscripts(string_split_regex(text, '[.\\n]'), 1) - 1 AS pos FROM documents WHERE text IS NOT NULL),
  doc_lines AS (SELECT * FROM (SELECT document_id, page, pos, trim(line) AS line, regexp_replace(lower(trim(line)), '[^a-z0-9]+', '', 'g') AS line_key FROM l0) WHERE line <> ''),
  repeated AS (SELECT document_id, line_key, count(*) AS n FROM doc_lines WHERE line_key <> '' AND length(line) <= 24 GROUP BY ALL HAVING count(*) >= 3)"""


def line_watermark_clean(spark: SparkSession, d: str) -> DataFrame:
    rows = _doc_lines(spark, d)
    pages = cleaning.kept_lines(cleaning.judged_lines(rows, cleaning.repeated_keys(rows)))
    return pages.select("document_id", "page", F.length("text").alias("n_text"), F.sha2("text", 256).alias("text_sha256"), "watermark_removed", "image_internal_text_removed", "kept")


def _raw_pages(spark: SparkSession, d: str) -> DataFrame:
    """Documents as parsed pages: prose, a picture block of the second line's
    sentences (none where there is no second line), prose; damaged words and a
    table by the id.  A source is the document."""
    k, text = F.col("doc_id"), F.coalesce("text", F.lit(""))
    head, rest = F.substring_index(text, "\n", 1), F.expr("substr(coalesce(text, ''), locate('\n', coalesce(text, '')) + 1)")
    second, tail = F.substring_index(rest, "\n", 1), F.when(F.contains(rest, F.lit("\n")), F.expr("substr(substr(coalesce(text, ''), locate('\n', coalesce(text, '')) + 1), locate('\n', substr(coalesce(text, ''), locate('\n', coalesce(text, '')) + 1)))")).otherwise("")
    block = F.concat(F.lit("\n<!-- Start of picture text -->"), F.replace(second, F.lit(". "), F.lit("<br>")), F.lit("<br>x<!-- End of picture text -->"))
    page = F.when(F.contains(text, F.lit("\n")), F.concat(head, block, tail)).otherwise(text)
    page = F.when(k % 10 == 0, F.concat(page, F.lit("\n| Name | V | W |\n|---|---|---|\n| a | b | c |\n"))).when(k % 10 == 1, F.concat(page, F.lit("\nProtected by Copyright"))).otherwise(page)
    parsing = F.struct(F.when(k % 9 == 2, "failed").otherwise("complete").alias("status"), F.when(k % 5 == 3, "ocr").otherwise("markdown").alias("strategy"), ((k % 3) / 10).alias("selected_replacement_ratio"), (k % 5 == 3).alias("ocr_used"))
    return table(spark, d, "documents").select(F.col("source").alias("document_id"), k.alias("page"), page.alias("text"), F.when(k % 7 != 0, parsing).alias("parsing"))


def page_clean(spark: SparkSession, d: str) -> DataFrame:
    p = cleaning.process_pages(_raw_pages(spark, d))
    return p.select("document_id", "page", "raw_chars", "text_chars", F.sha2("text", 256).alias("text_sha256"), "watermark_removed", "image_internal_text_removed", "watermark_in_text", "table_count", "low_quality_tables", F.array_join("warnings", ",").alias("warnings"), "rag_text_status")


def document_report(spark: SparkSession, d: str) -> DataFrame:
    r = cleaning.document_report(cleaning.process_pages(_raw_pages(spark, d)))
    return r.select("document_id", "page_count", "normal_pages", "warning_pages", "quarantine_pages", "watermark_in_text_pages", "watermark_removed", "image_internal_text_removed", "table_count", "low_quality_tables", "parser_fallback_pages", "ocr_pages", "parser_failed_pages", F.array_join("warnings", ",").alias("warnings"))


def _page_clean_sql() -> str:
    """Blocks and their lines by position, put together again by string_agg."""
    obvious = " OR ".join(f"contains(lower(line), '{p}')" for p in cleaning.OBVIOUS)
    residual = " OR ".join(f"contains(lower(text), '{p}')" for p in cleaning.RESIDUAL)
    return rf"""
  src AS (SELECT source AS document_id, doc_id AS page, coalesce(text, '') AS t FROM documents),
  cut AS (SELECT *, contains(t, chr(10)) AS blocked, split_part(t, chr(10), 1) AS head, substr(t, strpos(t, chr(10)) + 1) AS rest FROM src),
  three AS (SELECT *, split_part(rest, chr(10), 1) AS second, CASE WHEN contains(rest, chr(10)) THEN substr(rest, strpos(rest, chr(10))) ELSE '' END AS tail,
    CASE WHEN page % 10 = 0 THEN chr(10) || '| Name | V | W |' || chr(10) || '|---|---|---|' || chr(10) || '| a | b | c |' || chr(10) WHEN page % 10 = 1 THEN chr(10) || 'Protected by Copyright' ELSE '' END AS extra FROM cut),
  ls AS (SELECT document_id, page, i, line, regexp_replace(lower(line), '[^a-z0-9]+', '', 'g') AS line_key FROM (
    SELECT document_id, page, unnest(parts) AS raw, generate_subscripts(parts, 1) AS i, trim(regexp_replace(regexp_replace(raw, '<[^>]+>', '', 'g'), '[\s\x{{00a0}}]+', ' ', 'g')) AS line
    FROM (SELECT *, string_split(replace(second, '. ', '<br>') || '<br>x', '<br>') AS parts FROM three WHERE blocked)) WHERE line <> ''),
  rep AS (SELECT document_id, line_key FROM ls WHERE line_key <> '' AND length(line) <= 24 GROUP BY ALL HAVING count(*) >= 3),
  judged AS (SELECT ls.*, CASE WHEN {obvious} OR r.line_key IS NOT NULL THEN 'w' WHEN length(line) <= 2 AND NOT regexp_matches(line, '[0-9]') THEN 'n' ELSE 'k' END AS fate FROM ls LEFT JOIN rep r ON r.document_id = ls.document_id AND r.line_key = ls.line_key),
  blocks AS (SELECT document_id, page, string_agg(line, chr(10) ORDER BY i) FILTER (fate = 'k') AS kept, count(*) FILTER (fate = 'w') AS w, count(*) FILTER (fate = 'n') AS n FROM judged GROUP BY ALL),
  made AS (SELECT t.document_id, t.page, length(CASE WHEN blocked THEN head || chr(10) || '<!-- Start of picture text -->' || replace(second, '. ', '<br>') || '<br>x<!-- End of picture text -->' || tail ELSE t.t END || extra) AS raw_chars,
    CASE WHEN blocked THEN head || chr(10) || coalesce('<!-- Start of picture text -->' || chr(10) || kept || chr(10) || '<!-- End of picture text -->', '') || tail ELSE t.t END || extra AS text, coalesce(w, 0) AS watermark_removed, coalesce(n, 0) AS image_internal_text_removed,
    (t.page % 10 = 0)::INT AS tables, CASE WHEN t.page % 7 <> 0 THEN t.page END AS k FROM three t LEFT JOIN blocks b ON b.document_id = t.document_id AND b.page = t.page),
  told AS (SELECT *, {residual} AS watermark_in_text, coalesce(k % 5 = 3, false) AS ocr, coalesce(k % 9 = 2, false) AS failed, coalesce(k % 9 = 2 AND k % 3 > 0, false) AS corrupted FROM made),
  gated AS (SELECT *, list_filter([CASE WHEN ocr THEN 'parser_fallback' END, CASE WHEN ocr THEN 'ocr_used' END, CASE WHEN failed THEN 'parser_failed' END, CASE WHEN corrupted THEN 'corrupted_text' END, CASE WHEN watermark_in_text THEN 'watermark_in_text' END], lambda x: x IS NOT NULL) AS warned FROM told),
  pages_done AS (SELECT *, CASE WHEN failed OR watermark_in_text THEN 'quarantine' WHEN len(warned) > 0 THEN 'warning' ELSE 'pass' END AS rag_text_status FROM gated)"""


def _grid_rows(spark: SparkSession, d: str) -> DataFrame:
    """Five parts in a row as a table of four columns, some cells blank or cut."""
    p = table(spark, d, "part")
    k = F.col("p_partkey")
    cells = F.array(F.col("p_name"), F.when(k % 3 == 0, "").otherwise(F.col("p_brand")), F.when(k % 4 != 0, F.col("p_type")), F.substring("p_container", 1, 2) if "p_container" in p.columns else F.substring("p_brand", 1, 2))
    cells = F.when(k % 11 == 0, F.slice(cells, 1, 2)).otherwise(cells)
    grouped = p.select(F.floor(k / 5).alias("page"), F.struct(k.alias("k"), cells.alias("c")).alias("x")).groupBy("page").agg(F.array_sort(F.collect_list("x")).alias("x"))
    return grouped.select("page", F.transform("x", lambda r: r["c"]).alias("rows"))


def table_quality(spark: SparkSession, d: str) -> DataFrame:
    g = _grid_rows(spark, d)
    words = F.flatten(F.transform(tables.clean_rows(F.col("rows")), lambda r: F.flatten(F.transform(r, lambda c: F.split(c, " ")))))
    words = F.concat(F.filter(words, lambda w: w != ""), F.when(F.col("page") % 2 == 0, F.array(F.lit("draft"), F.lit("unseen"))).otherwise(F.array().cast("array<string>")))
    got = g.select("page", tables.table_check(tables.clean_rows(F.col("rows"))).alias("c"), tables.candidate_quality(F.col("rows"), words, F.array(F.lit("draftcopy"))).alias("q"))
    return got.select("page", F.col("c.columns"), F.col("c.empty_ratio"), F.col("c.fragmented_ratio"), F.col("c.consistent"), F.col("c.quality").alias("check_quality"), F.col("q.score"), F.col("q.quality"), *[F.round(f"q.{c}", 3).alias(c) for c in ("consistency", "short_ratio", "coverage", "watermark_rate")], F.array_join("q.reasons", ",").alias("reasons"))


def _table_sql(container: bool) -> str:
    last = "substring(p_container, 1, 2)" if container else "substring(p_brand, 1, 2)"
    return f"""
  WITH g AS (SELECT p_partkey // 5 AS page, list(CASE WHEN p_partkey % 11 = 0 THEN c[1:2] ELSE c END ORDER BY p_partkey) AS rows FROM (SELECT p_partkey, [trim(p_name), CASE WHEN p_partkey % 3 = 0 THEN '' ELSE trim(p_brand) END, CASE WHEN p_partkey % 4 <> 0 THEN trim(p_type) ELSE '' END, trim({last})] AS c FROM part) GROUP BY 1),
  m AS (SELECT page, rows, len(rows) AS n, list_transform(rows, lambda r: len(r)) AS widths, flatten(rows) AS cells FROM g),
  f AS (SELECT *, list_filter(cells, lambda c: c <> '') AS filled, list_max(widths) AS columns, list_max(list_transform(widths, lambda w: len(list_filter(widths, lambda x: x = w)))) AS modal,
    list_concat(list_filter(flatten(list_transform(cells, lambda c: string_split(c, ' '))), lambda w: w <> ''), CASE WHEN page % 2 = 0 THEN ['draft', 'unseen'] ELSE [] END) AS words FROM m),
  t AS (SELECT *, list_distinct(list_filter(regexp_extract_all(lower(array_to_string(words, ' ')), '[a-z0-9]+'), lambda x: length(x) > 1)) AS src, list_distinct(list_filter(regexp_extract_all(lower(array_to_string(cells, ' ')), '[a-z0-9]+'), lambda x: length(x) > 1)) AS got FROM f),
  q AS (SELECT *, modal / greatest(n, 1) AS cons, 1 - len(filled) / len(cells) AS e1, 1 - len(filled) / greatest(n * columns, 1) AS e2, len(list_filter(filled, lambda c: length(c) <= 3)) / greatest(len(filled), 1) AS s3, len(list_filter(filled, lambda c: length(c) <= 2)) / greatest(len(filled), 1) AS s2,
    len(list_intersect(src, got)) / greatest(len(src), 1) AS cov, len(list_filter(words, lambda w: regexp_replace(lower(w), '[^a-z0-9]+', '', 'g') <> '' AND contains('draftcopy', regexp_replace(lower(w), '[^a-z0-9]+', '', 'g')))) / greatest(len(words), 1) AS wm, len(list_distinct(widths)) <= 1 AS consistent FROM t),
  r AS (SELECT *, CASE WHEN n < 2 THEN 0.0 ELSE round(least(greatest(0.35::DOUBLE * cons + 0.25::DOUBLE * (1 - e2) + 0.15::DOUBLE * (1 - s2) + 0.25::DOUBLE * cov - 0.20::DOUBLE * wm, 0), 1), 3) END AS score,
    CASE WHEN n < 2 THEN 'fewer_than_two_rows' ELSE array_to_string(list_filter([CASE WHEN columns < 2 THEN 'single_column' END, CASE WHEN e2 > 0.45 THEN 'empty_cells' END, CASE WHEN cons < 0.75 THEN 'inconsistent_columns' END, CASE WHEN s2 > 0.45 THEN 'fragmented_cells' END, CASE WHEN cov < 0.55 THEN 'low_source_coverage' END, CASE WHEN wm > 0.10 THEN 'watermark_contamination' END], lambda x: x IS NOT NULL), ',') END AS reasons FROM q)
  SELECT page, columns, round(e1, 3) AS empty_ratio, round(s3, 3) AS fragmented_ratio, consistent, CASE WHEN columns < 2 OR e1 > 0.45 OR s3 > 0.45 OR NOT consistent THEN 'low' ELSE 'good' END AS check_quality, score,
    CASE WHEN n < 2 THEN 'failed' WHEN score >= 0.80 AND reasons = '' THEN 'good' WHEN score >= 0.60 THEN 'warning' ELSE 'failed' END AS quality, CASE WHEN n < 2 THEN 0 ELSE round(cons, 3) END AS consistency, CASE WHEN n < 2 THEN 1 ELSE round(s2, 3) END AS short_ratio, CASE WHEN n < 2 THEN 0 ELSE round(cov, 3) END AS coverage, CASE WHEN n < 2 THEN 0 ELSE round(wm, 3) END AS watermark_rate, reasons FROM r"""


def table_best_candidate(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey")
    score = F.round((k * 37 % 101) / 100, 3)
    c = table(spark, d, "part").select(F.lit("D").alias("document_id"), F.floor(k / 4).alias("page"), k.alias("ord"), F.when(k % 3 == 0, "fallback").otherwise("native").alias("origin"), score.alias("score"), tables.graded(score, k % 5 != 0).alias("quality"))
    return tables.best_candidates(c).select("page", "ord", "origin", "score", "quality", "table_status")


BEST_SQL = """
  WITH c AS (SELECT p_partkey // 4 AS page, p_partkey AS ord, CASE WHEN p_partkey % 3 = 0 THEN 'fallback' ELSE 'native' END AS origin, round((p_partkey * 37 % 101) / 100, 3) AS score FROM part),
  q AS (SELECT *, CASE WHEN score >= 0.80 AND ord % 5 <> 0 THEN 'good' WHEN score >= 0.60 THEN 'warning' ELSE 'failed' END AS quality FROM c),
  f AS (SELECT *, arg_min(quality, ord) FILTER (origin = 'native') OVER (PARTITION BY page) AS first FROM q)
  SELECT page, ord, origin, score, quality, CASE WHEN quality = 'failed' THEN 'quarantine_table' ELSE quality END AS table_status FROM f WHERE origin = 'native' OR first IS NULL OR first <> 'good' QUALIFY row_number() OVER (PARTITION BY page ORDER BY score DESC, ord) = 1"""

_internal = ", ".join(f"'{x}'" for x in sections.INTERNAL)
OUTLINE = f"""{PAGE_LINES},
  b AS (SELECT *, coalesce(level <= 4 AND NOT (trim(lower(text), ' :.-') IN ({_internal}) OR starts_with(trim(lower(text), ' :.-'), 'advantages of ') OR starts_with(trim(lower(text), ' :.-'), 'special features of ')) AND length(text) BETWEEN 3 AND 180 AND regexp_matches(text, '\\p{{L}}'), false) AS is_boundary FROM page_lines),
  o AS (SELECT *, sum(is_boundary::INT) OVER (PARTITION BY document_id ORDER BY page_id, pos) AS section FROM b)"""


def section_outline(spark: SparkSession, d: str) -> DataFrame:
    s = sections.outlined_sections(A.page_lines(spark, d))
    return s.select("document_id", "section_id", "title", "level", F.array_join("path", " > ").alias("path"), "page_start", "page_end", F.sha2("text", 256).alias("text_sha256"), F.size("subheadings").alias("n_subheadings"), "confidence")


OUTLINE_SQL = f"""WITH {OUTLINE},
  s AS (SELECT document_id, section, min(page_id) AS page_start, max(page_id) AS page_end, string_agg(text, chr(10) || chr(10) ORDER BY page_id, pos) AS text, arg_min(is_boundary, (page_id, pos)) AS headed, arg_min(text, (page_id, pos)) AS first_text, arg_min(level, (page_id, pos)) AS first_level,
      count(DISTINCT text) FILTER (level IS NOT NULL AND NOT is_boundary) AS n_subheadings FROM o GROUP BY document_id, section)
  SELECT document_id, document_id || ':s' || lpad(row_number() OVER (PARTITION BY document_id ORDER BY section)::VARCHAR, 4, '0') AS section_id, CASE WHEN headed THEN first_text ELSE 'Document introduction' END AS title, CASE WHEN headed THEN first_level ELSE 1 END AS level,
    CASE WHEN headed THEN {{path}} ELSE 'Document introduction' END AS path, page_start, page_end, sha256(text) AS text_sha256, n_subheadings, CASE WHEN headed THEN 0.8 ELSE 0.5 END AS confidence FROM s"""


def section_quality(spark: SparkSession, d: str) -> DataFrame:
    c = A.chunks(spark, d)
    return c.groupBy("section_id").agg(sections.worst(F.col("rag_text_status"), F.col("doc_id")).alias("rag_text_status"), F.max(sections.severity(F.col("rag_text_status"))).alias("severity"))


def chunk_subheading_ffill(spark: SparkSession, d: str) -> DataFrame:
    """Lines as chunks of their page; headings carry forward, short lines go."""
    rows = A.page_lines(spark, d)
    w = Window.partitionBy("page_id").orderBy("pos")
    rows = rows.withColumn("subheading", F.last(F.when(F.col("level").isNotNull(), F.col("text")), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.where(F.length("text") > 10).withColumn("chunk_index", F.row_number().over(w)).select("page_id", "pos", "chunk_index", "subheading")


def chunk_recursive(spark: SparkSession, d: str) -> DataFrame:
    empty = F.array().cast("array<string>")
    docs = table(spark, d, "documents").where("text is not null")
    s = docs.select(F.concat(F.lit("D"), F.col("doc_id").cast("string")).alias("document_id"), F.concat(F.lit("D"), F.col("doc_id").cast("string"), F.lit(":s0001")).alias("section_id"), F.col("source").alias("title"), F.array("source").alias("path"), F.lit(1).alias("level"), F.lit(1).alias("page_start"), F.lit(1).alias("page_end"), "text", empty.alias("subheadings"), F.lit(None).cast("string").alias("quality"), F.lit(None).cast("string").alias("boundary"))
    return chunking.chunk_sections(s).select("chunk_id", "section_id", "chunk_index", "text")


def quote_validation(spark: SparkSession, d: str) -> DataFrame:
    """Benchmark passages as quotes: in how many documents each is verbatim."""
    rel = A.relevant(spark, d)
    items = table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"))
    found = items.join(rel, "query_id", "left").groupBy("query_id").agg(F.count("doc_id").alias("n_documents"), F.min("doc_id").alias("first_doc"))
    return found.withColumn("valid", F.col("n_documents") > 0)


def _hours(spark: SparkSession, d: str) -> DataFrame:
    out = runtime.tumbling(A.samples(spark, d), "6 hours")
    return out.withColumns({c: F.date_format(c, "yyyy-MM-dd HH:mm:ss") for c in ("window_start", "window_end")})


def _sessions(spark: SparkSession, d: str) -> DataFrame:
    out = runtime.sessions(A.samples(spark, d), "release_version", "30 minutes")
    return out.select("release_version", F.date_format("session_start", "yyyy-MM-dd HH:mm:ss").alias("session_start"), F.date_format("session_end", "yyyy-MM-dd HH:mm:ss").alias("session_end"), "requests", "success_rate")


_WINDOWED = "count(*) AS requests, round(count(*) FILTER (status = 'complete') / count(*), 6) AS success_rate, round(count(*) FILTER (fallback) / count(*), 6) AS fallback_rate, round(count(*) FILTER (error_code = 'TIMEOUT') / count(*), 6) AS timeout_rate, round(avg(total_seconds), 6) AS mean_seconds"

QUERIES = {
    "repeated_fragments": lambda s, d: cleaning.repeated_keys(_doc_lines(s, d)), "line_watermark_clean": line_watermark_clean, "page_clean": page_clean, "document_report": document_report, "table_quality": table_quality, "table_best_candidate": table_best_candidate, "section_outline": section_outline, "section_quality": section_quality,
    "chunk_subheading_ffill": chunk_subheading_ffill, "chunk_recursive": chunk_recursive, "quote_validation": quote_validation, "runtime_tumbling": _hours, "runtime_session": _sessions,
}
_fate = "CASE WHEN " + " OR ".join(f"contains(lower(line), '{p}')" for p in cleaning.OBVIOUS) + " THEN 'w' WHEN r.n IS NOT NULL THEN 'w' WHEN length(line) <= 2 AND NOT regexp_matches(line, '[0-9]') THEN 'n' ELSE 'k' END"
ORACLES = {
    "repeated_fragments": f"WITH {LINES} SELECT document_id, line_key, n FROM repeated",
    "line_watermark_clean": f"""WITH {LINES}, j AS (SELECT l.*, {_fate} AS fate FROM doc_lines l LEFT JOIN repeated r ON r.document_id = l.document_id AND r.line_key = l.line_key),
      p AS (SELECT document_id, page, coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (fate = 'k'), '') AS text, count(*) FILTER (fate = 'w') AS watermark_removed, count(*) FILTER (fate = 'n') AS image_internal_text_removed, count(*) FILTER (fate = 'k') AS kept FROM j GROUP BY ALL)
      SELECT document_id, page, length(text) AS n_text, sha256(text) AS text_sha256, watermark_removed, image_internal_text_removed, kept FROM p""",
    "page_clean": f"WITH {_page_clean_sql()} SELECT document_id, page, raw_chars, length(text) AS text_chars, sha256(text) AS text_sha256, watermark_removed, image_internal_text_removed, watermark_in_text, tables AS table_count, tables AS low_quality_tables, array_to_string(warned, ',') AS warnings, rag_text_status FROM pages_done",
    "document_report": f"""WITH {_page_clean_sql()} SELECT document_id, count(*) AS page_count, count(*) FILTER (rag_text_status = 'pass') AS normal_pages, count(*) FILTER (rag_text_status = 'warning') AS warning_pages, count(*) FILTER (rag_text_status = 'quarantine') AS quarantine_pages, count(*) FILTER (watermark_in_text) AS watermark_in_text_pages,
      sum(watermark_removed)::BIGINT AS watermark_removed, sum(image_internal_text_removed)::BIGINT AS image_internal_text_removed, sum(tables)::BIGINT AS table_count, sum(tables)::BIGINT AS low_quality_tables, count(*) FILTER (ocr) AS parser_fallback_pages, count(*) FILTER (ocr) AS ocr_pages, count(*) FILTER (failed) AS parser_failed_pages,
      array_to_string(list_sort(list_distinct(flatten(list(warned)))), ',') AS warnings FROM pages_done GROUP BY document_id""",
    "table_quality": _table_sql(False), "table_best_candidate": BEST_SQL,
    "section_outline": OUTLINE_SQL.replace("{path}", "first_text"),
    "section_quality": f"WITH {A.CHUNKS}, v AS (SELECT *, CASE rag_text_status WHEN 'pass' THEN 0 WHEN 'quarantine' THEN 2 ELSE 1 END AS k FROM chunks) SELECT section_id, arg_max(rag_text_status, (k, -doc_id)) AS rag_text_status, max(k) AS severity FROM v GROUP BY section_id",
    "chunk_subheading_ffill": f"""WITH {PAGE_LINES}, s AS (SELECT *, last_value(CASE WHEN level IS NOT NULL THEN text END IGNORE NULLS) OVER (PARTITION BY page_id ORDER BY pos ROWS UNBOUNDED PRECEDING) AS subheading FROM page_lines)
      SELECT page_id, pos, row_number() OVER (PARTITION BY page_id ORDER BY pos) AS chunk_index, subheading FROM s WHERE length(text) > 10""",
    "quote_validation": f"WITH {A.RELEVANT} SELECT item_id AS query_id, count(doc_id) AS n_documents, min(doc_id) AS first_doc, count(doc_id) > 0 AS valid FROM benchmark LEFT JOIN relevant ON query_id = item_id GROUP BY item_id",
    "runtime_tumbling": f"WITH {SAMPLES} SELECT strftime(w, '%Y-%m-%d %H:%M:%S') AS window_start, strftime(w + INTERVAL 6 HOUR, '%Y-%m-%d %H:%M:%S') AS window_end, {_WINDOWED} FROM (SELECT *, time_bucket(INTERVAL 6 HOUR, timestamp, TIMESTAMP '1970-01-01') AS w FROM samples) GROUP BY w",
    "runtime_session": f"""WITH {SAMPLES}, g AS (SELECT *, CASE WHEN timestamp >= lag(timestamp) OVER w + INTERVAL 30 MINUTE OR lag(timestamp) OVER w IS NULL THEN 1 ELSE 0 END AS new FROM samples WINDOW w AS (PARTITION BY release_version ORDER BY timestamp, event_id)),
      k AS (SELECT *, sum(new) OVER (PARTITION BY release_version ORDER BY timestamp, event_id) AS s FROM g)
      SELECT release_version, strftime(min(timestamp), '%Y-%m-%d %H:%M:%S') AS session_start, strftime(max(timestamp) + INTERVAL 30 MINUTE, '%Y-%m-%d %H:%M:%S') AS session_end, count(*) AS requests, round(count(*) FILTER (status = 'complete') / count(*), 6) AS success_rate FROM k GROUP BY release_version, s""",
}
