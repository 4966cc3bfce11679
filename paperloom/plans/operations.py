"""Queries of monitoring, integrity, scheduling and work orders."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from paperloom.operators import integrity, monitoring, scheduling, workorders
from paperloom.plans import adapters as A
from paperloom.plans.adapters import SAMPLES, table

_rate = lambda c: f"round(count(*) FILTER ({c}) / greatest(count(*), 1), 6)"
_q = lambda v, p: f"round(quantile_cont({v}, {p}), 6)"
HEALTH = f"""count(*) AS requests, {_rate("status = 'complete'")} AS success_rate, {_rate("fallback")} AS fallback_rate, {_rate("coalesce(candidate_count, 0) = 0")} AS empty_retrieval_rate,
  {_rate("error_code = 'TIMEOUT'")} AS timeout_rate, {_q("total_seconds", 0.5)} AS p50, {_q("total_seconds", 0.95)} AS p95, {_q("total_seconds", 0.99)} AS p99"""
HALF = "2024-01-16"


def _halves(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Health of the later and the earlier samples, on either side of the middle event."""
    s = A.samples(spark, d)
    middle = F.broadcast(s.agg((F.max("event_id") / 2).alias("_m")))
    both = s.crossJoin(middle)
    worse = both.where("event_id > _m").withColumn("total_seconds", F.col("total_seconds") * 2)
    return monitoring.runtime_health(worse), monitoring.runtime_health(both.where("event_id <= _m"))


HALVES = f"""WITH {SAMPLES}, m AS (SELECT max(event_id) / 2 AS m FROM samples),
  cur AS (SELECT {HEALTH} FROM (SELECT * REPLACE (total_seconds * 2 AS total_seconds) FROM samples, m WHERE event_id > m)),
  bas AS (SELECT {HEALTH} FROM samples, m WHERE event_id <= m)"""


def alerts_vs_baseline(spark: SparkSession, d: str) -> DataFrame:
    now, then = _halves(spark, d)
    return monitoring.alerts(now, then)


def release_gate(spark: SparkSession, d: str) -> DataFrame:
    now, then = _halves(spark, d)
    score = lambda h, hit: h.select(F.lit(hit).alias("hit_5"), F.col("success_rate").alias("mrr"), "p95", F.lit(1).alias("new_severe"))
    return monitoring.release_gate(score(now, 0.8), score(then, 0.9))


def bad_case_upsert(spark: SparkSession, d: str) -> DataFrame:
    """Labels as the stored state (of two reasons), documents as what is found now."""
    reason = F.when(F.col("quality") == 0, "low_quality").otherwise("empty")
    stored = table(spark, d, "labels").select(
        F.concat(F.col("doc_id").cast("string"), F.lit(":retrieval:"), reason).alias("key"), F.col("doc_id").cast("string").alias("case_id"), F.lit("retrieval").alias("failure_stage"), reason.alias("reason"), F.lit("v1").alias("introduced_by_version"), F.lit(False).alias("safety"),
        F.when(F.col("toxic") == 1, "FIXED").when(F.col("quality") == 1, "CONFIRMED").otherwise("OPEN").alias("status"), F.when(F.col("quality") == 1, "bm25").alias("root_cause"), F.lit("2024-01-01 00:00:00").cast("timestamp").alias("created_at"), F.lit("2024-01-01 00:00:00").cast("timestamp").alias("updated_at"),
    )
    found = table(spark, d, "documents").select(
        F.concat(F.col("doc_id").cast("string"), F.lit(":retrieval:empty")).alias("key"), F.col("doc_id").cast("string").alias("case_id"), F.lit("retrieval").alias("failure_stage"), F.lit("empty").alias("reason"), F.lit("v2").alias("introduced_by_version"), F.lit(False).alias("safety")
    )
    out = monitoring.upsert_bad_cases(stored, found, F.lit("2024-02-01 00:00:00").cast("timestamp"))
    return out.select("key", "status", "root_cause", "introduced_by_version", F.date_format("created_at", "yyyy-MM-dd").alias("created"), F.date_format("updated_at", "yyyy-MM-dd").alias("updated"))


def _records(spark: SparkSession, d: str) -> DataFrame:
    """Conversations as answers: user turns are claims that cite the turns
    around them; every other turn supports the claims of its neighbours."""
    c = table(spark, d, "conversations").where("conv_id is not null and turn is not null").select("conv_id", "turn", "role")
    s = lambda e: e.cast("string")
    claim = F.when(F.col("role") == "user", F.struct(s(F.col("turn")).alias("id"), F.when(F.col("turn") % 3 == 0, F.array().cast("array<string>")).otherwise(F.array(s(F.col("turn") + 1), s(F.col("turn") + 2))).alias("citation_ids")))
    citation = F.struct(s(F.col("turn")).alias("id"), F.array(s(F.col("turn") - 1)).alias("supports_claim_ids"))
    return c.groupBy("conv_id").agg(F.collect_list(claim).alias("claims"), F.collect_list(citation).alias("citations")).select(
        F.col("conv_id").alias("record_id"), "claims", "citations", (F.col("conv_id") % 5 == 0).alias("refused"), (F.col("conv_id") % 2 == 0).alias("evidence_available"), F.lit(10).alias("tokens"), F.lit(0.5).alias("cost"))


CITATION_SQL = """
  WITH c AS (SELECT conv_id, turn, role FROM conversations WHERE conv_id IS NOT NULL AND turn IS NOT NULL),
  claims AS (SELECT conv_id, turn FROM c WHERE role = 'user'),
  links AS (SELECT conv_id, turn, unnest([turn + 1, turn + 2]) AS cites FROM claims WHERE turn % 3 <> 0),
  good AS (SELECT l.conv_id, l.turn, l.cites, max((c.turn IS NOT NULL AND c.turn - 1 = l.turn)::INT) AS ok FROM links l LEFT JOIN c ON c.conv_id = l.conv_id AND c.turn = l.cites GROUP BY ALL),
  per AS (SELECT cl.conv_id, cl.turn, count(g.cites) AS links, coalesce(sum(ok), 0) AS good FROM claims cl LEFT JOIN good g USING (conv_id, turn) GROUP BY ALL),
  tot AS (SELECT conv_id, count(*) AS n, count(*) FILTER (links > 0) AS cited, sum(links) AS links, sum(good) AS good, count(*) FILTER (good > 0) AS supported FROM per GROUP BY conv_id)
  SELECT conv_id AS record_id, round(coalesce(cited, 0) / greatest(coalesce(n, 0), 1), 6) AS citation_coverage, round(coalesce(good, 0) / greatest(coalesce(links, 0), 1), 6) AS citation_correctness, round(coalesce(supported, 0) / greatest(coalesce(n, 0), 1), 6) AS groundedness,
    coalesce(n, 0) > 0 AND supported < n AS unsupported_answer, conv_id % 5 = 0 AND conv_id % 2 <> 0 AS insufficient_evidence_refusal, 10 AS tokens, 0.5 AS cost
  FROM (SELECT DISTINCT conv_id FROM c) LEFT JOIN tot USING (conv_id)"""


def _hashed(spark: SparkSession, d: str) -> DataFrame:
    text = F.concat_ws("|", F.col("doc_id").cast("string"), F.coalesce("lang", F.lit("")), F.coalesce("source", F.lit("")), F.coalesce("text", F.lit("")))
    return table(spark, d, "documents").select("doc_id", "source", "lang", F.sha2(text, 256).alias("content_sha256"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"))


HASHED = "h AS (SELECT doc_id, source, lang, sha256(concat_ws('|', doc_id::VARCHAR, coalesce(lang, ''), coalesce(source, ''), coalesce(text, ''))) AS content_sha256, sha256(coalesce(text, '')) AS text_sha256 FROM documents)"


def canonical_hash(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").withColumn("share", F.col("doc_id") / 8)
    return docs.select("doc_id", integrity.canonical_hash("doc_id", "text", "lang", "source", "share").alias("canonical_sha256"))


def _store(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Sources as documents, their rows by language as sections, rows as chunks;
    every thirteenth chunk was changed after its hash was taken."""
    docs = table(spark, d, "documents").where("source is not null").withColumn("section_id", F.concat_ws(":s", "source", F.coalesce("lang", F.lit("none"))))
    quality = F.struct(F.lit("pass").alias("rag_text_status"), F.lit(None).cast("string").alias("table_quality"))
    boundary = F.struct(F.lit("implicit").alias("source"), F.lit(0.5).alias("confidence"), F.lit(None).cast("int").alias("page"))
    none = F.lit(None).cast("string")
    sections = docs.groupBy("section_id", F.col("source").alias("document_id"), F.col("lang").alias("title")).agg(F.max("n_chars").cast("int").alias("level")).select("section_id", "document_id", "title", F.array("title").alias("path"), "level", F.lit(1).alias("page_start"), F.lit(1).alias("page_end"), F.lit("").alias("text"), F.array().cast("array<string>").alias("subheadings"), quality.alias("quality"), boundary.alias("boundary"))
    chunks = docs.select(
        F.concat_ws(":c", "section_id", "doc_id").alias("chunk_id"), F.col("source").alias("document_id"), none.alias("document_content_type"), F.lit(0.95).alias("metadata_confidence"), "section_id", F.col("lang").alias("section_title"), F.array("lang").alias("section_path"), F.lit(1).alias("section_level"), F.lit(1).alias("section_page_start"), F.lit(1).alias("section_page_end"),
        F.lit(1).alias("chunk_index"), none.alias("subheading"), F.array().cast("array<string>").alias("subheadings"), "text", none.alias("index_text"), quality.alias("quality"), boundary.alias("boundary"), none.alias("parser"), none.alias("splitter"), none.alias("source_sha256"), "doc_id",
    )
    sections, chunks = sections.withColumn("content_sha256", integrity.section_hash()), chunks.withColumn("content_sha256", integrity.chunk_hash())
    counts = sections.groupBy(F.col("document_id").alias("id")).agg(F.count("*").cast("int").alias("section_count")).join(chunks.groupBy(F.col("document_id").alias("id")).agg(F.count("*").cast("int").alias("chunk_count")), "id")
    named = counts.select("id", none.alias("filename"), none.alias("source_path"), none.alias("source_sha256"), F.lit("other").alias("content_type"), F.lit(0.95).alias("metadata_confidence"), F.lit(4).alias("pipeline_version"), none.alias("pipeline_fingerprint"), F.lit(1).alias("page_count"), "section_count", "chunk_count")
    made = integrity.document_hashes(named, sections, chunks).select("id", F.col("computed_sha256").alias("artifact_sha256"))
    documents = named.join(made, "id").withColumn("hash_algorithm", F.lit(integrity.HASH_ALGORITHM))
    changed = chunks.withColumn("text", F.when(F.col("doc_id") % 13 == 0, F.concat(F.coalesce("text", F.lit("")), F.lit("!"))).otherwise(F.col("text")))
    return documents, sections, changed


def store_verify(spark: SparkSession, d: str) -> DataFrame:
    """What verification finds: each changed chunk, and the document of each."""
    return integrity.verify_store(*_store(spark, d))


def referential_violations(spark: SparkSession, d: str) -> DataFrame:
    """Suppliers as documents, parts as sections, line items as chunks."""
    documents = table(spark, d, "supplier").select(F.concat(F.lit("D"), F.col("s_suppkey").cast("string")).alias("document_id"))
    sections = table(spark, d, "part").select(F.concat(F.lit("D"), (F.col("p_partkey") % 97).cast("string")).alias("document_id"), F.concat(F.lit("D"), (F.col("p_partkey") % 97).cast("string"), F.lit(":s"), (F.col("p_partkey") % 1900).cast("string")).alias("section_id"))
    part = F.col("l_partkey") + F.when(F.col("l_orderkey") % 50 == 0, 100000).otherwise(0)
    own = F.concat(F.lit("D"), (part % 97).cast("string"))
    chunks = table(spark, d, "lineitem").select(F.when(F.col("l_orderkey") % 70 == 0, "Dx").otherwise(own).alias("document_id"), F.concat(own, F.lit(":s"), (part % 1900).cast("string")).alias("section_id"), F.concat(own, F.lit(":s"), (part % 1900).cast("string"), F.lit(":c"), F.col("l_orderkey").cast("string"), F.lit("-"), F.col("l_linenumber").cast("string")).alias("chunk_id"))
    return integrity.violations(documents, sections, chunks).groupBy("violation").agg(F.count("*").alias("n"), F.min("key").alias("first_key"), F.max("key").alias("last_key"))


REFERENTIAL_SQL = """
  WITH documents_ AS (SELECT 'D' || s_suppkey AS document_id FROM supplier),
  sections AS (SELECT 'D' || (p_partkey % 97) AS document_id, 'D' || (p_partkey % 97) || ':s' || (p_partkey % 1900) AS section_id FROM part),
  li AS (SELECT *, l_partkey + CASE WHEN l_orderkey % 50 = 0 THEN 100000 ELSE 0 END AS p FROM lineitem),
  chunks AS (SELECT CASE WHEN l_orderkey % 70 = 0 THEN 'Dx' ELSE 'D' || (p % 97) END AS document_id, 'D' || (p % 97) || ':s' || (p % 1900) AS section_id, 'D' || (p % 97) || ':s' || (p % 1900) || ':c' || l_orderkey || '-' || l_linenumber AS chunk_id FROM li),
  sec AS (SELECT section_id, min(document_id) AS d FROM sections GROUP BY section_id),
  v AS (SELECT 'repeated_section' AS violation, section_id AS key FROM sections GROUP BY section_id HAVING count(*) > 1
    UNION ALL SELECT 'repeated_chunk', chunk_id FROM chunks GROUP BY chunk_id HAVING count(*) > 1
    UNION ALL SELECT 'unknown_section', chunk_id FROM chunks LEFT JOIN sec USING (section_id) WHERE d IS NULL
    UNION ALL SELECT 'other_document', chunk_id FROM chunks JOIN sec USING (section_id) WHERE d <> document_id
    UNION ALL SELECT 'section_namespace', section_id FROM sections WHERE NOT starts_with(section_id, document_id || ':')
    UNION ALL SELECT 'chunk_namespace', chunk_id FROM chunks WHERE NOT starts_with(chunk_id, section_id || ':')
    UNION ALL SELECT 'unknown_document', section_id FROM sections WHERE document_id NOT IN (SELECT document_id FROM documents_)
    UNION ALL SELECT 'document_without_sections', document_id FROM documents_ WHERE document_id NOT IN (SELECT document_id FROM sections)
    UNION ALL SELECT 'document_without_chunks', document_id FROM documents_ WHERE document_id NOT IN (SELECT document_id FROM chunks))
  SELECT violation, count(*) AS n, min(key) AS first_key, max(key) AS last_key FROM v GROUP BY violation"""


def incremental_changed(spark: SparkSession, d: str) -> DataFrame:
    """All documents; by their language French ones are new, German ones went."""
    h = _hashed(spark, d).select(F.col("doc_id").alias("document_id"), "lang", F.when(F.col("doc_id") % 7 == 0, "stale").otherwise(F.col("content_sha256")).alias("was"), F.col("content_sha256").alias("artifact_sha256"))
    stored = h.where(~F.col("lang").eqNullSafe(F.lit("fr"))).select("document_id", F.col("was").alias("artifact_sha256"))
    return integrity.changes(stored, h.where(~F.col("lang").eqNullSafe(F.lit("de"))))


def interval_conflicts(spark: SparkSession, d: str) -> DataFrame:
    """Line items as reservations of their supplier for as many days
    from shipping as their line number;
    orders as wishes for a supplier; per order the reservations in its way."""
    res = table(spark, d, "lineitem").select(F.lit("supplier").alias("resource_type"), F.col("l_suppkey").alias("resource_id"), F.col("l_shipdate").cast("timestamp").alias("start_time"), (F.col("l_shipdate").cast("timestamp") + F.make_dt_interval(days=F.col("l_linenumber").cast("int"))).alias("end_time"))
    day = F.col("o_orderdate").cast("timestamp")
    top = table(spark, d, "supplier").agg(F.max("s_suppkey").alias("_n"))
    want = table(spark, d, "orders").crossJoin(F.broadcast(top)).select("o_orderkey", (F.col("o_custkey") % F.col("_n") + 1).alias("id"), day.alias("start"), (day + F.make_dt_interval(days=F.lit(2))).alias("end"))
    pairs = scheduling.overlap_pairs(want, res.withColumnRenamed("resource_id", "id"), ("id",))
    return pairs.groupBy("o_orderkey").agg(F.count("*").alias("n_conflicts"))


INTERVAL_SQL = """
  SELECT o_orderkey, count(*) AS n_conflicts FROM (SELECT o_orderkey, o_custkey % (SELECT max(s_suppkey) FROM supplier) + 1 AS id, o_orderdate::TIMESTAMP AS s, o_orderdate::TIMESTAMP + INTERVAL 2 DAY AS e FROM orders) o
  JOIN lineitem l ON l.l_suppkey = o.id AND o.s < l.l_shipdate::TIMESTAMP + l.l_linenumber::INT * INTERVAL 1 DAY AND l.l_shipdate::TIMESTAMP < o.e GROUP BY o_orderkey"""


def capability_division(spark: SparkSession, d: str) -> DataFrame:
    """Suppliers that have shipped every ship mode in a required pair of modes."""
    have = table(spark, d, "lineitem").groupBy("l_suppkey").agg(F.collect_set(F.concat_ws("/", "l_returnflag", "l_linestatus")).alias("held"))
    need = spark.createDataFrame([("A", ["R/F"]), ("B", ["A/F", "N/O"]), ("C", ["R/F", "A/F", "N/O", "N/F"]), ("D", ["X/X"])], "task string, required array<string>")
    return have.crossJoin(F.broadcast(need)).where(scheduling.has_all(F.col("required"), F.col("held"))).groupBy("task").agg(F.count("*").alias("n_suppliers"), F.min("l_suppkey").alias("first_supplier"), F.max("l_suppkey").alias("last_supplier"))


CAPABILITY_SQL = """
  WITH need AS (SELECT * FROM (VALUES ('A', 'R/F'), ('B', 'A/F'), ('B', 'N/O'), ('C', 'R/F'), ('C', 'A/F'), ('C', 'N/O'), ('C', 'N/F'), ('D', 'X/X')) t(task, skill)),
  held AS (SELECT DISTINCT l_suppkey, l_returnflag || '/' || l_linestatus AS skill FROM lineitem)
  SELECT task, count(*) AS n_suppliers, min(l_suppkey) AS first_supplier, max(l_suppkey) AS last_supplier FROM (SELECT DISTINCT task FROM need) t, (SELECT DISTINCT l_suppkey FROM held) s
  WHERE NOT EXISTS (SELECT 1 FROM need n WHERE n.task = t.task AND NOT EXISTS (SELECT 1 FROM held h WHERE h.l_suppkey = s.l_suppkey AND h.skill = n.skill)) GROUP BY task"""

DAY = "timestamp '2024-01-01 00:00:00'"


def _shop(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Suppliers as resources of stores of twelve (a third each technicians,
    workstations and devices), orders as tasks, customers as reservations of one day."""
    k = F.col("s_suppkey")
    day = F.expr(DAY)
    minutes = lambda m: day + F.make_dt_interval(mins=m.cast("int"))
    kind = F.element_at(F.array(*map(F.lit, ("technician", "workstation", "equipment"))), (k % 3 + 1).cast("int"))
    store = lambda c: F.concat(F.lit("S"), c.cast("string"))
    skill = lambda c: F.concat(F.lit("skill"), c.cast("string"))
    resources = table(spark, d, "supplier").select(
        kind.alias("kind"), k.cast("int").alias("ord"), F.concat(F.lit("R"), k.cast("string")).alias("id"), store(F.floor(k / 12)).alias("store_id"), F.concat(F.lit("type"), (F.floor(k / 3) % 2).cast("string")).alias("type"),
        F.array(F.struct(minutes(F.lit(480) + k % 5 * 7).alias("start"), minutes(F.lit(900) + k % 4 * 45).alias("end"))).alias("availability"),
        F.array(F.struct(skill(F.floor(k / 6) % 2).alias("skill"), F.when(k % 2 == 0, minutes(F.lit(500) + k % 60)).alias("valid_from"), F.lit(None).cast("timestamp").alias("valid_until")), F.struct(F.lit("skill2").alias("skill"), F.lit(None).cast("timestamp").alias("valid_from"), F.lit(None).cast("timestamp").alias("valid_until"))).alias("abilities"),
    )
    o = F.col("o_orderkey")
    none = F.array().cast("array<string>")
    top = F.broadcast(table(spark, d, "supplier").agg(F.max("s_suppkey").alias("_n")))
    tasks = table(spark, d, "orders").crossJoin(top).select(
        o.cast("string").alias("task_id"), F.lit("b").alias("brand"), store(o % (F.floor(F.col("_n") / 12) + 2)).alias("store_id"), F.lit("car").alias("category"), F.lit("ice").alias("powertrain"), (F.lit(20) + o % 5 * 25).cast("int").alias("duration_minutes"),
        minutes(F.lit(470) + o % 200).alias("earliest_start"), minutes(F.lit(470) + o % 200 + 30 + o % 7 * 30).alias("latest_end"), F.array(skill(o % 4)).alias("required_skills"),
        F.when(o % 2 == 0, F.array(F.concat(F.lit("type"), (F.floor(o / 2) % 2).cast("string")))).otherwise(none).alias("required_workstation_types"), F.when(o % 3 == 0, F.array(F.lit("type1"), F.lit("type0"))).otherwise(none).alias("required_equipment_types"), F.lit(None).cast("array<string>").alias("allowed_technician_ids"),
    )
    c = F.col("c_custkey")
    rk = c % F.col("_n") + 1
    reservations = table(spark, d, "customer").crossJoin(top).select(F.element_at(F.array(*map(F.lit, ("technician", "workstation", "equipment"))), (rk % 3 + 1).cast("int")).alias("resource_type"), F.concat(F.lit("R"), rk.cast("string")).alias("resource_id"), minutes(F.lit(480) + c % 300).alias("start_time"), minutes(F.lit(480) + c % 300 + 15 + c % 40).alias("end_time"), F.lit("x").alias("task_id"), F.when(F.col("c_acctbal") < 0, "CANCELLED").otherwise("ACTIVE").alias("status"))
    return tasks, resources, reservations


def _planned(spark: SparkSession, d: str) -> DataFrame:
    return scheduling.plan(*_shop(spark, d))


def first_fit_schedule(spark: SparkSession, d: str) -> DataFrame:
    return _planned(spark, d).where("status = 'FEASIBLE'").select("task_id", F.date_format("start", "HH:mm").alias("start"), F.date_format("end", "HH:mm").alias("end"), "technician_id", "workstation_id", F.array_join("equipment_ids", ",").alias("equipment_ids"))


def infeasible_reasons(spark: SparkSession, d: str) -> DataFrame:
    return _planned(spark, d).where("status = 'INFEASIBLE'").select("task_id", F.array_join("reasons", ",").alias("reasons"))


#: The minute grid, every combination tried: what the reduced grid must equal.
SHOP_SQL = f"""
  WITH res AS (SELECT ['technician', 'workstation', 'equipment'][s_suppkey % 3 + 1] AS kind, s_suppkey AS ord, 'R' || s_suppkey AS id, 'S' || (s_suppkey // 12) AS store_id, 'type' || ((s_suppkey // 3) % 2) AS type,
      480 + s_suppkey % 5 * 7 AS a, 900 + s_suppkey % 4 * 45 AS z, 'skill' || ((s_suppkey // 6) % 2) AS skill, CASE WHEN s_suppkey % 2 = 0 THEN 500 + s_suppkey % 60 ELSE 0 END AS vf FROM supplier),
  tasks AS (SELECT o_orderkey AS o, 'S' || (o_orderkey % ((SELECT max(s_suppkey) FROM supplier) // 12 + 2)) AS store_id, 20 + o_orderkey % 5 * 25 AS dur, 470 + o_orderkey % 200 AS e, 470 + o_orderkey % 200 + 30 + o_orderkey % 7 * 30 AS l, 'skill' || (o_orderkey % 4) AS skill,
      CASE WHEN o_orderkey % 2 = 0 THEN 'type' || ((o_orderkey // 2) % 2) END AS wtype, o_orderkey % 3 = 0 AS eq FROM orders),
  rsv AS (SELECT 'R' || (c_custkey % (SELECT max(s_suppkey) FROM supplier) + 1) AS id, 480 + c_custkey % 300 AS s, 480 + c_custkey % 300 + 15 + c_custkey % 40 AS x FROM customer WHERE c_acctbal IS NULL OR c_acctbal >= 0),
  fits AS (SELECT * FROM tasks WHERE e + dur <= l),
  grid AS (SELECT *, unnest(generate_series(e, l - dur)) AS t FROM fits),
  spans AS (SELECT DISTINCT store_id, t, dur FROM grid),
  use_ AS (SELECT s.store_id, s.t, s.dur, r.kind, r.ord, r.id, r.type, r.skill, r.vf <= s.t AS valid, NOT EXISTS (SELECT 1 FROM rsv v WHERE v.id = r.id AND v.s < s.t + s.dur AND s.t < v.x) AS free
     FROM spans s JOIN res r ON r.store_id = s.store_id AND r.a <= s.t AND s.t + s.dur <= r.z),
  per AS (SELECT g.o, g.t, g.dur, g.eq,
      bool_or(u.kind = 'technician' AND (g.skill = 'skill2' OR u.skill = g.skill AND u.valid)) AS t_any, bool_or(u.kind = 'workstation' AND (g.wtype IS NULL OR u.type = g.wtype)) AS w_any,
      NOT g.eq OR bool_or(u.kind = 'equipment' AND u.type = 'type0') AND bool_or(u.kind = 'equipment' AND u.type = 'type1') AS e_any,
      arg_min(u.id, u.ord) FILTER (u.free AND u.kind = 'technician' AND (g.skill = 'skill2' OR u.skill = g.skill AND u.valid)) AS tech, arg_min(u.id, u.ord) FILTER (u.free AND u.kind = 'workstation' AND (g.wtype IS NULL OR u.type = g.wtype)) AS ws,
      arg_min(u.id, u.ord) FILTER (u.free AND u.kind = 'equipment' AND u.type = 'type0') AS e0, arg_min(u.id, u.ord) FILTER (u.free AND u.kind = 'equipment' AND u.type = 'type1') AS e1
     FROM grid g LEFT JOIN use_ u ON u.store_id = g.store_id AND u.t = g.t AND u.dur = g.dur GROUP BY g.o, g.t, g.dur, g.eq),
  best AS (SELECT * FROM per WHERE tech IS NOT NULL AND ws IS NOT NULL AND (NOT eq OR e0 IS NOT NULL AND e1 IS NOT NULL) QUALIFY row_number() OVER (PARTITION BY o ORDER BY t) = 1),
  flags AS (SELECT o, coalesce(bool_or(t_any), false) AS t, coalesce(bool_or(w_any), false) AS w, coalesce(bool_or(e_any), false) AS e FROM per GROUP BY o)"""
_clock = lambda m: f"lpad((({m}) // 60)::VARCHAR, 2, '0') || ':' || lpad((({m}) % 60)::VARCHAR, 2, '0')"


def order_log(spark: SparkSession, d: str) -> DataFrame:
    """Events of a user as the status changes of one order."""
    status = F.element_at(F.array(*map(F.lit, ("CONFIRMED", "CHECKED_IN", "COMPLETED", "CANCELLED"))), (F.col("event_id") % 4 + 1).cast("int"))
    return table(spark, d, "events").select(F.col("user_id").alias("order_key"), F.struct("ts", "event_id").alias("seq"), "event_id", status.alias("to_status"))


ORDER_LOG = "log AS (SELECT user_id AS order_key, ts, event_id, ['CONFIRMED', 'CHECKED_IN', 'COMPLETED', 'CANCELLED'][event_id % 4 + 1] AS to_status FROM events)"


def active_reservations(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("order_key")
    now = workorders.latest(order_log(spark, d)).withColumns({"technician_id": F.concat(F.lit("T"), (k % 5).cast("string")), "workstation_id": F.concat(F.lit("W"), (k % 3).cast("string")), "equipment_ids": F.when(k % 2 == 0, F.array(F.lit("E0"), F.lit("E1"))), "start_time": F.expr(DAY), "end_time": F.expr(DAY)})
    return workorders.reservations_of(now).where("status = 'ACTIVE'").groupBy("resource_type", "resource_id").agg(F.count("*").alias("n"), F.min("order_key").alias("first_order"))


def order_state_machine(spark: SparkSession, d: str) -> DataFrame:
    """Every event as a command; ten users share a store, five a technician."""
    e = table(spark, d, "events")
    kind = F.element_at(F.array(*map(F.lit, ("create", "create", "check_in", "complete", "cancel", "reschedule"))), (F.col("event_id") % 6 + 1).cast("int"))
    at = F.date_trunc("hour", "ts")
    commands = e.select(
        F.col("event_id").alias("command_id"), kind.alias("kind"), F.concat(F.lit("O"), F.col("user_id").cast("string"), F.lit("-"), F.floor(F.col("event_id") / 60).cast("string")).alias("order_key"), F.lit(None).cast("string").alias("idempotency_key"), F.when(F.col("event_id") % 5 == 0, "CUSTOMER").otherwise("SERVICE_ADVISOR").alias("actor_role"),
        F.concat(F.lit("T"), F.floor(F.col("user_id") / 5).cast("string")).alias("technician_id"), F.concat(F.lit("W"), F.floor(F.col("user_id") / 2).cast("string")).alias("workstation_id"), F.array().cast("array<string>").alias("equipment_ids"), at.alias("start_time"), (at + F.make_dt_interval(hours=F.lit(2))).alias("end_time"), F.floor(F.col("user_id") / 10).alias("store"),
    )
    return workorders.apply_commands(commands, "store")


QUERIES = {
    "runtime_health": lambda s, d: monitoring.runtime_health(A.samples(s, d)), "stage_latency": lambda s, d: monitoring.stage_latency(A.samples(s, d)), "health_by_dimension": lambda s, d: monitoring.health_by_dimension(A.samples(s, d)),
    "error_counts": lambda s, d: monitoring.error_counts(A.samples(s, d)), "alerts_vs_baseline": alerts_vs_baseline, "release_gate": release_gate, "bad_case_upsert": bad_case_upsert, "citation_quality": lambda s, d: monitoring.answer_quality(_records(s, d)),
    "content_hash": lambda s, d: _hashed(s, d).select("doc_id", "content_sha256"), "exact_duplicates": lambda s, d: integrity.exact_duplicates(_hashed(s, d), "doc_id", "text_sha256"), "merkle_document_hash": lambda s, d: integrity.merkle(_hashed(s, d), "source", "doc_id", "content_sha256", F.floor(F.col("doc_id") / integrity.BLOCK)),
    "canonical_hash": canonical_hash, "store_verify": store_verify, "referential_violations": referential_violations, "incremental_changed": incremental_changed, "interval_conflicts": interval_conflicts, "capability_division": capability_division, "first_fit_schedule": first_fit_schedule, "infeasible_reasons": infeasible_reasons,
    "order_state_transitions": lambda s, d: workorders.invalid_transitions(order_log(s, d)).groupBy("from_status", "to_status", "allowed").agg(F.count("*").alias("n")), "active_reservations": active_reservations, "order_state_machine": order_state_machine,
    "id_collisions": lambda s, d: integrity.id_collisions(_hashed(s, d), "text_sha256"),
}
ORACLES = {
    "runtime_health": f"WITH {SAMPLES} SELECT {HEALTH} FROM samples",
    "stage_latency": f"WITH {SAMPLES} SELECT stage, {_q('x', 0.5)} AS p50, {_q('x', 0.95)} AS p95 FROM (SELECT 'dense' AS stage, total_seconds * 0.25 AS x FROM samples UNION ALL SELECT 'rerank', total_seconds * 0.5 FROM samples) GROUP BY stage",
    "health_by_dimension": f"""WITH {SAMPLES}, each AS (SELECT *, unnest([{{'d': 'release_version', 'v': release_version}}, {{'d': 'question_type', 'v': question_type}}, {{'d': 'language', 'v': language}}, {{'d': 'document_type', 'v': document_type}}]) AS p FROM samples)
      SELECT p.d AS dimension, p.v AS value, {HEALTH} FROM each WHERE p.v IS NOT NULL AND p.v <> '' GROUP BY p.d, p.v""",
    "error_counts": f"WITH {SAMPLES} SELECT error_code, count(*) AS n FROM samples WHERE error_code IS NOT NULL GROUP BY error_code",
    "alerts_vs_baseline": f"""{HALVES}, c AS (SELECT unnest([{{'m': 'latency.p95', 'v': cur.p95, 't': bas.p95 * 1.5}}, {{'m': 'fallback_rate', 'v': cur.fallback_rate, 't': bas.fallback_rate * 2}}, {{'m': 'empty_retrieval_rate', 'v': cur.empty_retrieval_rate, 't': bas.empty_retrieval_rate * 2}},
      {{'m': 'failure_rate', 'v': 1 - cur.success_rate, 't': (1 - bas.success_rate) * 2}}]) AS x FROM cur, bas WHERE cur.requests >= 20) SELECT x.m AS metric, round(x.v, 6) AS value, round(x.t, 6) AS threshold FROM c WHERE round(x.v, 6) > round(x.t, 6)""",
    "release_gate": f"""{HALVES}, f AS (SELECT array_to_string(list_filter(['hit@5 regressed', CASE WHEN cur.success_rate < bas.success_rate THEN 'mrr regressed' END, CASE WHEN cur.p95 > bas.p95 * 1.2 THEN 'p95 latency regressed' END, 'new severe bad cases'], lambda x: x IS NOT NULL), '; ') AS failures FROM cur, bas)
      SELECT failures = '' AS passed, failures FROM f""",
    "bad_case_upsert": """WITH s AS (SELECT doc_id, CASE WHEN quality = 0 THEN 'low_quality' ELSE 'empty' END AS reason, CASE WHEN toxic = 1 THEN 'FIXED' WHEN quality = 1 THEN 'CONFIRMED' ELSE 'OPEN' END AS status, CASE WHEN quality = 1 THEN 'bm25' END AS cause FROM labels), f AS (SELECT DISTINCT doc_id, 'empty' AS reason FROM documents)
      SELECT coalesce(s.doc_id, f.doc_id) || ':retrieval:' || coalesce(s.reason, f.reason) AS key, CASE WHEN s.doc_id IS NOT NULL AND (f.doc_id IS NULL OR s.status <> 'FIXED') THEN s.status ELSE 'OPEN' END AS status, CASE WHEN s.doc_id IS NOT NULL AND (f.doc_id IS NULL OR s.status <> 'FIXED') THEN s.cause END AS root_cause,
        CASE WHEN f.doc_id IS NOT NULL THEN 'v2' ELSE 'v1' END AS introduced_by_version, CASE WHEN s.doc_id IS NOT NULL THEN '2024-01-01' ELSE '2024-02-01' END AS created, CASE WHEN f.doc_id IS NOT NULL THEN '2024-02-01' ELSE '2024-01-01' END AS updated FROM s FULL JOIN f ON s.doc_id = f.doc_id AND s.reason = f.reason""",
    "citation_quality": CITATION_SQL,
    "content_hash": f"WITH {HASHED} SELECT doc_id, content_sha256 FROM h",
    "exact_duplicates": f"WITH {HASHED} SELECT text_sha256, count(*) AS copies, min(doc_id) AS first_id FROM h GROUP BY text_sha256 HAVING count(*) > 1",
    "merkle_document_hash": f"WITH {HASHED} SELECT source, sum(n)::BIGINT AS n, sha256(string_agg(b || ':' || x, ',' ORDER BY b, x)) AS merkle_sha256 FROM (SELECT source, doc_id // {integrity.BLOCK} AS b, count(*) AS n, sha256(string_agg(doc_id || ':' || content_sha256, ',' ORDER BY doc_id, content_sha256)) AS x FROM h GROUP BY ALL) GROUP BY source",
    "canonical_hash": "SELECT doc_id, sha256(to_json({'doc_id': doc_id, 'lang': lang, 'share': doc_id / 8, 'source': source, 'text': text})::VARCHAR) AS canonical_sha256 FROM documents",
    "store_verify": "SELECT 'chunk_hash_mismatch' AS violation, source || ':s' || coalesce(lang, 'none') || ':c' || doc_id AS key FROM documents WHERE source IS NOT NULL AND doc_id % 13 = 0 UNION ALL SELECT DISTINCT 'document_hash_mismatch', source FROM documents WHERE source IS NOT NULL AND doc_id % 13 = 0",
    "referential_violations": REFERENTIAL_SQL,
    "incremental_changed": f"""WITH {HASHED}, a AS (SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN 'stale' ELSE content_sha256 END AS x FROM h WHERE lang IS DISTINCT FROM 'fr'), b AS (SELECT doc_id, content_sha256 AS y FROM h WHERE lang IS DISTINCT FROM 'de')
      SELECT coalesce(a.doc_id, b.doc_id) AS document_id, CASE WHEN x IS NULL THEN 'added' WHEN y IS NULL THEN 'removed' WHEN x = y THEN 'unchanged' ELSE 'changed' END AS change FROM a FULL JOIN b ON a.doc_id = b.doc_id""",
    "interval_conflicts": INTERVAL_SQL, "capability_division": CAPABILITY_SQL,
    "first_fit_schedule": f"""{SHOP_SQL} SELECT o::VARCHAR AS task_id, {_clock("t")} AS start, {_clock("t + dur")} AS "end", tech AS technician_id, ws AS workstation_id, CASE WHEN eq THEN e0 || ',' || e1 ELSE '' END AS equipment_ids FROM best""",
    "infeasible_reasons": f"""{SHOP_SQL} SELECT k.o::VARCHAR AS task_id, CASE WHEN k.e + k.dur > k.l THEN 'window_too_short' WHEN f.t AND f.w AND f.e THEN 'resource_conflict,no_available_time'
      ELSE concat_ws(',', CASE WHEN NOT f.t THEN 'no_qualified_technician' END, CASE WHEN NOT f.w THEN 'no_compatible_workstation' END, CASE WHEN NOT f.e THEN 'no_required_equipment' END) END AS reasons FROM tasks k LEFT JOIN flags f ON f.o = k.o WHERE k.o NOT IN (SELECT o FROM best)""",
    "order_state_transitions": f"""WITH {ORDER_LOG}, w AS (SELECT *, lag(to_status) OVER (PARTITION BY order_key ORDER BY ts, event_id) AS from_status FROM log)
      SELECT from_status, to_status, CASE WHEN from_status IS NULL THEN to_status = 'CONFIRMED' ELSE (from_status, to_status) IN (('CONFIRMED', 'CHECKED_IN'), ('CONFIRMED', 'CANCELLED'), ('CHECKED_IN', 'COMPLETED')) END AS allowed, count(*) AS n FROM w GROUP BY ALL""",
    "active_reservations": f"""WITH {ORDER_LOG}, l AS (SELECT order_key, arg_max(to_status, (ts, event_id)) AS status FROM log GROUP BY order_key), a AS (SELECT * FROM l WHERE status NOT IN ('CANCELLED', 'COMPLETED')),
      r AS (SELECT order_key, 'technician' AS resource_type, 'T' || (order_key % 5) AS resource_id FROM a UNION ALL SELECT order_key, 'workstation', 'W' || (order_key % 3) FROM a UNION ALL SELECT order_key, 'equipment', unnest(['E0', 'E1']) FROM a WHERE order_key % 2 = 0)
      SELECT resource_type, resource_id, count(*) AS n, min(order_key) AS first_order FROM r GROUP BY ALL""",
    "id_collisions": f"WITH {HASHED}, g AS (SELECT count(*) AS n FROM h GROUP BY text_sha256 HAVING count(*) > 1) SELECT count(*) AS collision_keys, coalesce(sum(n - 1), 0) AS extra_records FROM g",
}
