"""Literal cases of monitoring, integrity, scheduling, work orders, sources and
streams, and a random check of the planner against the whole minute grid."""

import json
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from paperloom import schemas
from paperloom.operators import integrity, monitoring, scheduling, workorders
from paperloom.sources import io
from paperloom.streaming import runtime

BASE = datetime(2024, 5, 6, 8)
at = lambda m: BASE + timedelta(minutes=m)
SAMPLE = "status string, error_code string, total_seconds double, stage_seconds map<string,double>, candidate_count int, fallback boolean"


def health(spark, rows):
    return monitoring.runtime_health(spark.createDataFrame(rows, SAMPLE))


def test_health_and_alerts(spark):
    baseline = health(spark, [("complete", None, 1.0, None, 2, False)] * 20)
    rows = [("error" if i == 0 else "complete", None, 3.0, {"dense": 0.2}, 0 if i == 0 else 2, i < 2) for i in range(20)]
    current = health(spark, rows)
    assert current.first().p95 == 3 and {"latency.p95", "failure_rate", "fallback_rate"} <= {r.metric for r in monitoring.alerts(current, baseline).collect()}
    assert monitoring.alerts(health(spark, rows[:19]), baseline).count() == 0
    assert monitoring.stage_latency(spark.createDataFrame(rows, SAMPLE)).first().p50 == 0.2
    empty = health(spark, []).first()
    assert (empty.requests, empty.success_rate, empty.p95) == (0, 0.0, None)
    assert health(spark, [("complete", "TIMEOUT", None, None, None, None)]).first().empty_retrieval_rate == 1.0


def test_bad_cases_life(spark):
    cases = spark.createDataFrame([("c1", "reranker", (2, 8), 1, None, False), ("c2", "reranker", (None, None), 0, "boom", True)], "case_id string, final_stage string, ranks struct<rrf:int,reranker:int>, n_candidates int, reranker_error string, safety boolean")
    found = monitoring.retrieval_bad_cases(cases, "0.3")
    assert {r.reason for r in found.where("case_id = 'c1'").collect()} == {"expected_rank_gt_5", "reranker_demoted_expected"}
    assert {r.reason for r in found.where("case_id = 'c2'").collect()} == {"empty_retrieval", "expected_rank_gt_5", "reranker_fallback", "safety_case_failed"}
    key, then, now = "c1:reranker:expected_rank_gt_5", F.lit(BASE), F.lit(at(60))
    first = monitoring.upsert_bad_cases(spark.createDataFrame([], schemas.BAD_CASES), found.where(F.col("key") == key), then)
    with pytest.raises(Exception, match="classify"):
        monitoring.resolve(first, key, now).collect()
    fixed = monitoring.resolve(monitoring.classify(first, key, "bm25", now), key, now)
    assert [(r.status, r.root_cause) for r in fixed.collect()] == [("FIXED", "bm25")]
    again = monitoring.upsert_bad_cases(fixed, found.where(F.col("key") == key), now).first()
    assert (again.status, again.root_cause, again.created_at) == ("OPEN", None, BASE)
    kept = monitoring.upsert_bad_cases(monitoring.classify(first, key, "bm25", now), found.where(F.col("key") == key), now).first()
    assert (kept.status, kept.root_cause) == ("CONFIRMED", "bm25")
    with pytest.raises(ValueError):
        monitoring.classify(first, key, "unheard of", now)


def test_answer_quality_and_gate(spark):
    row = (1, [("a", ["x"]), ("b", [])], [("x", ["a"])], False, True, 5, 0.1, "c9", True)
    r = spark.createDataFrame([row], "record_id int, claims array<struct<id:string,citation_ids:array<string>>>, citations array<struct<id:string,supports_claim_ids:array<string>>>, refused boolean, evidence_available boolean, tokens int, cost double, case_id string, user_downvote boolean")
    q = monitoring.answer_quality(r).first()
    assert (q.citation_coverage, q.citation_correctness, q.groundedness, q.unsupported_answer) == (0.5, 1.0, 0.5, True)
    assert {x.reason for x in monitoring.answer_bad_cases(r, "v").collect()} == {"user_downvote", "answer_not_grounded"}
    make = lambda *v: spark.createDataFrame([v], "hit_5 double, mrr double, p95 double, new_severe int")
    gate = monitoring.release_gate(make(0.8, 0.7, 1.3, 1), make(0.9, 0.7, 1.0, 0)).first()
    assert not gate.passed and gate.failures.count(";") == 2
    assert monitoring.release_gate(make(0.9, 0.7, 1.2, 0), make(0.9, 0.7, 1.0, 0)).first().passed


def test_promotion(spark):
    cases = spark.createDataFrame([("k1", "a", "FIXED", "{}"), ("k2", "a", "FIXED", "{}"), ("k3", "b", "OPEN", "{}"), ("k4", "c", "CONFIRMED", None), ("k5", "d", "CONFIRMED", "{}")], "key string, case_id string, status string, regression_case string")
    golden = spark.createDataFrame([("d", "old")], "case_id string, payload string")
    assert sorted((r.case_id, r.payload) for r in monitoring.promote(cases, golden).collect()) == [("a", "{}"), ("d", "old")]


def test_validation_and_incremental(spark):
    docs = spark.createDataFrame([("D",), ("E",)], "document_id string")
    sections = spark.createDataFrame([("D:s1", "D"), ("D:s1", "D"), ("X:s2", "D")], "section_id string, document_id string")
    chunks = spark.createDataFrame([("D:s1:c1", "D:s1", "D"), ("D:s9:c1", "D:s9", "D"), ("D:s1:c2", "D:s1", "E")], "chunk_id string, section_id string, document_id string")
    found = {(r.violation, r.key) for r in integrity.violations(docs, sections, chunks).collect()}
    assert found == {("repeated_section", "D:s1"), ("section_namespace", "X:s2"), ("unknown_section", "D:s9:c1"), ("other_document", "D:s1:c2"), ("document_without_sections", "E")}
    with pytest.raises(ValueError):
        integrity.assert_valid(integrity.violations(docs, sections, chunks))
    manifest = spark.createDataFrame([(k, f"p{k}", "h", 1, "f") for k in "abcd"], schemas.MANIFEST)
    all_ = list(integrity.ARTIFACTS)
    state = spark.createDataFrame([("a", "complete", "h", "fp", all_), ("b", "complete", "other", "fp", all_), ("c", "complete", "h", "fp", all_[:-1])], schemas.INGEST_STATE)
    assert sorted(r.pdf_id for r in integrity.to_ingest(manifest, state, "fp").collect()) == ["b", "c", "d"]
    assert integrity.to_ingest(manifest, state, "new").count() == 4


def test_tampering_is_found(spark):
    rows = spark.createDataFrame([("s1", "text", None), ("s2", "more", "t")], "section_id string, text string, title string")
    stored = rows.withColumn("content_sha256", integrity.canonical_hash("text", "title"))
    assert integrity.verify(stored, "section_id", ("title", "text")).count() == 0
    bad = stored.withColumn("text", F.when(F.col("section_id") == "s1", "tampered").otherwise(F.col("text")))
    assert [r.section_id for r in integrity.verify(bad, "section_id", ("title", "text")).collect()] == ["s1"]
    assert integrity.fingerprint({"b": 1, "a": 2}) == integrity.fingerprint({"a": 2, "b": 1})


def resource(kind, n, id_, type_=None, skills=(), until=480, store="s1"):
    return (kind, n, id_, store, type_, [(at(0), at(until))], [(s, None, None) for s in skills])


def task(spark, resources, reservations=(), vehicle=None, **over):
    t = {"task_id": "t", "brand": "b", "store_id": "s1", "category": "car", "powertrain": "ice", "duration_minutes": 60, "earliest_start": at(0), "latest_end": at(480), "required_skills": ["brake"], "required_workstation_types": ["lift"], "required_equipment_types": [], "allowed_technician_ids": None} | over
    return scheduling.plan(spark.createDataFrame([tuple(t.values())], schemas.TASKS), spark.createDataFrame(resources, schemas.RESOURCES), spark.createDataFrame(list(reservations), schemas.RESERVATIONS), vehicle).first()


def test_first_fit_cases(spark):
    base = [resource("technician", 0, "t1", skills=["brake"]), resource("workstation", 0, "w1", "lift"), resource("equipment", 0, "z1", "z"), resource("equipment", 1, "a1", "a")]
    held = lambda kind, id_, a=0, b=60: (kind, id_, at(a), at(b), "x", "ACTIVE")
    r = task(spark, base, required_equipment_types=["z", "a"])
    assert (r.status, r.start, r.technician_id, r.workstation_id, r.equipment_ids) == ("FEASIBLE", at(0), "t1", "w1", ["a1", "z1"])
    assert task(spark, base, required_skills=["other"]).reasons == ["no_qualified_technician"]
    assert task(spark, base, allowed_technician_ids=["t9"]).reasons == ["no_qualified_technician"]
    assert task(spark, base, [held("workstation", "w1")], latest_end=at(60)).reasons == ["resource_conflict", "no_available_time"]
    assert task(spark, base, [held("equipment", "z1")], required_equipment_types=["z"], latest_end=at(60)).reasons == ["resource_conflict", "no_available_time"]
    assert task(spark, base, [held("technician", "t1")]).start == at(60)
    assert task(spark, base, latest_end=at(59)).reasons == ["window_too_short"]
    assert task(spark, base, vehicle={"brand": "other"}).reasons == ["scope_mismatch"]
    assert task(spark, base, required_workstation_types=["pit"], required_equipment_types=["q"]).reasons == ["no_compatible_workstation", "no_required_equipment"]


def full_grid(t, resources, reservations):
    """The definition: every minute, every combination in order."""
    start = t["earliest_start"]
    while start + timedelta(minutes=t["duration_minutes"]) <= t["latest_end"]:
        end = start + timedelta(minutes=t["duration_minutes"])
        usable = lambda r: r[3] == t["store_id"] and any(a <= start and end <= b for a, b in r[5])  # noqa: B023, E731
        free = lambda r: not any(v[0] == r[0] and v[1] == r[2] and v[5] == "ACTIVE" and v[2] < end and start < v[3] for v in reservations)  # noqa: B023, E731
        skills = lambda r: {s for s, f, u in r[6] if (f is None or f <= start) and (u is None or end <= u)}  # noqa: B023, E731
        ok = [r for r in sorted(resources, key=lambda r: r[1]) if usable(r) and free(r)]
        tech = [r[2] for r in ok if r[0] == "technician" and set(t["required_skills"]) <= skills(r)]
        bay = [r[2] for r in ok if r[0] == "workstation" and (not t["required_workstation_types"] or r[4] in t["required_workstation_types"])]
        tools = [[r[2] for r in ok if r[0] == "equipment" and r[4] == k] for k in sorted(set(t["required_equipment_types"]))]
        if tech and bay and all(tools):
            return start, tech[0], bay[0], [x[0] for x in tools]
        start += timedelta(minutes=1)
    return None


def test_reduced_grid_equals_full_grid(spark):
    rng = random.Random(11)
    resources, n = [], 0
    for kind, count in (("technician", 8), ("workstation", 6), ("equipment", 6)):
        for _ in range(count):
            n += 1
            a = rng.randrange(0, 120)
            slots = [(at(a), at(a + rng.randrange(60, 200)))] + ([(at(330), at(400))] if rng.random() < 0.4 else [])
            skills = [(s, at(rng.randrange(0, 150)) if rng.random() < 0.5 else None, at(rng.randrange(200, 400)) if rng.random() < 0.3 else None) for s in ("x", "y") if rng.random() < 0.8]
            resources.append((kind, n, f"r{n}", rng.choice(["s1", "s2"]), rng.choice(["p", "q"]), slots, skills))
    reservations = [(r[0], r[2], at(s), at(s + rng.randrange(5, 90)), "x", rng.choice(["ACTIVE", "ACTIVE", "CANCELLED"])) for r in resources for s in rng.sample(range(300), 2)]
    tasks = []
    for i in range(150):
        e = rng.randrange(0, 200)
        tasks.append((str(i), "b", rng.choice(["s1", "s2", "s3"]), "car", "ice", rng.choice([10, 25, 60]), at(e) + timedelta(seconds=rng.choice([0, 30])), at(e + rng.randrange(5, 200)), rng.sample(["x", "y"], rng.randrange(0, 3)), rng.sample(["p", "q"], rng.randrange(0, 3)), rng.sample(["p", "q"], rng.randrange(0, 3)), None))
    got = {r.task_id: r for r in scheduling.plan(spark.createDataFrame(tasks, schemas.TASKS), spark.createDataFrame(resources, schemas.RESOURCES), spark.createDataFrame(reservations, schemas.RESERVATIONS)).collect()}
    names = "task_id brand store_id category powertrain duration_minutes earliest_start latest_end required_skills required_workstation_types required_equipment_types allowed_technician_ids".split()
    feasible = 0
    for t in tasks:
        want, r = full_grid(dict(zip(names, t, strict=True)), resources, reservations), got[t[0]]
        assert (want is not None) == (r.status == "FEASIBLE"), t
        if want:
            feasible += 1
            assert (r.start, r.technician_id, r.workstation_id, r.equipment_ids) == want, t
    assert feasible > 10


def command(i, kind, order, key=None, role="SERVICE_ADVISOR", tech="t1", a=0, b=60, store="s"):
    return (i, kind, order, key, role, tech, "w" + tech[1:], ["e1"] if tech == "t1" else None, at(a), at(b), store)


def test_order_life(spark):
    rows = [
        command(1, "create", "o1", "k1"), command(2, "create", "o1b", "k1"), command(3, "create", "o2", "k2"), command(4, "create", "o3", "k3", a=60, b=90), command(5, "check_in", "o1", role="CUSTOMER"), command(6, "reschedule", "o3", a=30, b=70),
        command(7, "cancel", "o1"), command(8, "reschedule", "o3", a=30, b=70), command(9, "check_in", "o3"), command(10, "complete", "o3"), command(11, "cancel", "o3"), command(12, "cancel", "nowhere"), command(13, "create", "o9", "k9", store="other"),
    ]
    got = {r.command_id: r for r in workorders.apply_commands(spark.createDataFrame(rows, schemas.COMMANDS + ", store STRING"), "store").collect()}
    assert [got[i].result for i in range(1, 14)] == ["ok", "existing", "reservation_conflict", "ok", "forbidden", "reservation_conflict", "ok", "ok", "ok", "ok", "invalid_transition", "not_found", "ok"]
    assert got[2].order_key == "o1" and got[10].to_status == "COMPLETED" and got[10].version == 4


def test_reservations_and_tokens(spark):
    o = spark.createDataFrame([("o", "t", "w", ["e", "f"], at(0), at(9), "CONFIRMED"), ("p", "t", "w", None, at(0), at(9), "CANCELLED")], "order_key string, technician_id string, workstation_id string, equipment_ids array<string>, start_time timestamp, end_time timestamp, status string")
    got = workorders.reservations_of(o).groupBy("order_key", "status").count().collect()
    assert {(r.order_key, r.status, r["count"]) for r in got} == {("o", "ACTIVE", 4), ("p", "CANCELLED", 2)}
    row = spark.range(1).select(workorders.token_hash(F.lit("secret")).alias("h"), F.lit(BASE).alias("now"))
    check = lambda given, exp, used: row.select(workorders.token_result(F.lit(given), F.col("h"), F.lit(exp), F.lit(used).cast("timestamp"), F.col("now"))).first()[0]
    assert [check("secret", at(1), None), check("wrong", at(1), None), check("secret", at(0), None), check("secret", at(1), at(-1))] == ["ok", "invalid_token", "plan_expired", "plan_already_used"]


def test_manifest_metadata_and_arrays(spark, tmp_path):
    (tmp_path / "m.json").write_text(json.dumps([{"pdf_id": f"p{i}", "relative_path": f"a/{i}.pdf", "sha256": "h", "page_count": i, "filename": "f"} for i in range(25)]))
    got = io.read_manifest(spark, str(tmp_path / "m.json"), 3, 20).orderBy("ord").collect()
    assert [r.pdf_id for r in got] == [f"p{i}" for i in range(3, 23)]
    (tmp_path / "bad.json").write_text(json.dumps([{"pdf_id": "p", "relative_path": "../x.pdf"}]))
    with pytest.raises(Exception, match="leaves the corpus"):
        io.read_manifest(spark, str(tmp_path / "bad.json")).collect()
    for name, body in (("l.json", [{"pdf_id": "a", "filename": "1"}, {"document_id": "a", "filename": "2"}]), ("s.json", {"selection": [{"pdf_id": "a", "filename": "2"}]}), ("d.json", {"documents": [{"pdf_id": "a", "filename": "2"}]})):
        (tmp_path / name).write_text(json.dumps(body))
        assert [(r.document_id, r.filename) for r in io.read_metadata(spark, str(tmp_path / name)).collect()] == [("a", "2")]
    (tmp_path / "broken.json").write_text("{nope")
    assert io.read_tolerant(spark, str(tmp_path / "broken.json"), "a STRING").count() == 0 and io.read_tolerant(spark, str(tmp_path / "absent.json"), "a STRING").count() == 0


def test_publishing(spark, tmp_path):
    table, state = spark.range(3), spark.createDataFrame([("D", "complete")], "document_id string, status string")
    none = spark.createDataFrame([], "violation string, key string")
    version = io.publish_if_valid({"chunks": table}, str(tmp_path / "kb"), state, state, none)
    assert io.published(spark, str(tmp_path / "kb"), "chunks", version).count() == 3
    with pytest.raises(ValueError):
        io.publish_if_valid({"chunks": table}, str(tmp_path / "kb2"), state, state.withColumn("status", F.lit("failed")), none)
    assert not (tmp_path / "kb2").exists()
    io.replace_partitions(spark.createDataFrame([("D", 1), ("E", 1)], "document_id string, x int"), str(tmp_path / "p"))
    io.replace_partitions(spark.createDataFrame([("D", 2)], "document_id string, x int"), str(tmp_path / "p"))
    assert sorted((r.document_id, r.x) for r in spark.read.parquet(str(tmp_path / "p")).collect()) == [("D", 2), ("E", 1)]


def test_embeddings_and_sync(spark):
    chunks = spark.createDataFrame([("c1",), ("c2",)], "chunk_id string")
    got = io.with_embeddings(chunks, spark.createDataFrame([("c1", [1.0, 2.0])], "chunk_id string, vector array<float>"), "m").orderBy("chunk_id").collect()
    assert (got[0].embedding_dimension, got[0].embedding_model, got[1].embedding) == (2, "m", None)
    with pytest.raises(ValueError):
        io.with_embeddings(chunks, spark.createDataFrame([("c9", [1.0])], "chunk_id string, vector array<float>"), "m")
    make = lambda *rows: spark.createDataFrame(list(rows), "case_id string, title string")
    assert {r.case_id: r.action for r in io.sync_dataset(make(("a", "1"), ("b", "1"), ("d", "1")), make(("a", "2"), ("b", "1"), ("c", "1"))).collect()} == {"a": "updated", "b": "unchanged", "c": "created", "d": "kept"}


def test_parse_files_isolates_errors(spark):
    files = spark.createDataFrame([("a", bytearray(b"x")), ("b", bytearray(b""))], "path string, content binary")

    def parser(path, content):
        if not content:
            raise ValueError("empty")
        return [{"document_id": path, "page": 1, "markdown_text": content.decode()}]

    got = {r.document_id: r for r in io.parse_files(files, parser).collect()}
    assert got["a"].markdown_text == "x" and got["b"].ocr_error == "ValueError: empty" and got["b"].page is None


def test_samples_log_and_stream(spark, tmp_path):
    raw = spark.createDataFrame([("complete", 1.0, "secret", at(0)), ("error", 2.0, "secret", at(70))], "status string, total_seconds double, query string, timestamp timestamp")
    io.append_samples(raw, str(tmp_path / "log"))
    assert "secret" not in "".join(p.read_text() for p in (tmp_path / "log").glob("*.json")) and io.read_samples(spark, str(tmp_path / "log")).count() == 2
    with pytest.raises(Exception, match="unknown status"):
        io.append_samples(raw.withColumn("status", F.lit("odd")), str(tmp_path / "log2"))
    stream = runtime.tumbling(runtime.read_samples(spark, str(tmp_path / "log")))
    q = stream.writeStream.format("memory").queryName("windows").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    want = runtime.tumbling(io.read_samples(spark, str(tmp_path / "log"))).orderBy("window_start").collect()
    assert spark.table("windows").orderBy("window_start").collect() == want and len(want) == 2


def test_bad_case_stream(spark, tmp_path):
    columns = "key string, case_id string, failure_stage string, reason string, introduced_by_version string, safety boolean"
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.json").write_text(json.dumps({"key": "k", "case_id": "c", "failure_stage": "s", "reason": "r", "introduced_by_version": "v", "safety": False}))
    held = {"df": spark.createDataFrame([], schemas.BAD_CASES)}
    q = runtime.upsert_bad_cases(spark.readStream.schema(columns).json(str(tmp_path / "in")), lambda: held["df"], lambda df, n: held.update(df=spark.createDataFrame(df.collect(), df.schema)), str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    assert [(r.key, r.status) for r in held["df"].collect()] == [("k", "OPEN")]


STORE_SECTION = "section_id string, document_id string, title string, path array<string>, level int, page_start int, page_end int, text string, subheadings array<string>, quality struct<rag_text_status:string,table_quality:string>, boundary struct<source:string,confidence:double,page:int>"


def test_hashes_are_those_of_canonical_json(spark):
    """The bytes hashed are those of sorted, compact JSON with characters as they are."""
    import hashlib
    import json

    rows = [("D:s1", "D", 'Title "ä" \\ \n\t\u2028', ["a", "b"], 1, 1, 2, "text/", ["x"], ("pass", None), ("implicit", 0.5, None)), ("D:s2", "D", None, None, None, None, None, None, None, None, None)]
    got = {r.section_id: r.h for r in spark.createDataFrame(rows, STORE_SECTION).select("section_id", integrity.section_hash().alias("h")).collect()}
    first = {"id": "D:s1", "document_id": "D", "title": rows[0][2], "path": ["a", "b"], "level": 1, "page_start": 1, "page_end": 2, "text": "text/", "subheadings": ["x"], "quality": {"rag_text_status": "pass", "table_quality": None}, "boundary": {"source": "implicit", "confidence": 0.5}}
    second = {"id": "D:s2", "document_id": "D", "title": "", "path": [], "level": None, "page_start": None, "page_end": None, "text": "", "subheadings": [], "quality": {}, "boundary": {}}
    for key, payload in (("D:s1", first), ("D:s2", second)):
        assert got[key] == hashlib.sha256(json.dumps(payload, ensure_ascii=False, sort_keys=True, separators=(",", ":")).encode()).hexdigest()
    numbers = spark.createDataFrame([(0.1, 1e21, 1e-7, 3.0, -0.0)], "a double, b double, c double, d double, e double").select(integrity.canonical_json(F.struct("e", "d", "c", "b", "a")).alias("j")).first().j
    assert numbers == json.dumps({"a": 0.1, "b": 1e21, "c": 1e-7, "d": 3.0, "e": -0.0}, separators=(",", ":"))


def test_equal_hash_of_a_broken_store_is_imported_again(spark):
    stored = spark.createDataFrame([("A", "h1"), ("B", "h2"), ("C", "h3")], "id string, artifact_sha256 string")
    incoming = spark.createDataFrame([("A", "h1"), ("B", "h2"), ("C", "new"), ("E", "h")], "id string, artifact_sha256 string")
    got = {r.id: r.change for r in integrity.to_import(stored, incoming, spark.createDataFrame([("B",)], "id string")).collect()}
    assert got == {"A": "skipped", "B": "imported", "C": "imported", "E": "imported"}


def test_overlap_pairs_equal_all_pairs(spark):
    import datetime
    import random

    rng, day = random.Random(3), datetime.datetime(2024, 1, 1)
    spans = lambda n: [(i, i % 3, day + datetime.timedelta(hours=a), day + datetime.timedelta(hours=a + rng.randrange(0, 90))) for i in range(n) for a in [rng.randrange(300)]]
    a, b = spans(60), spans(80)
    left, right = spark.createDataFrame(a, "i int, id int, start timestamp, end timestamp"), spark.createDataFrame(b, "j int, id int, start_time timestamp, end_time timestamp")
    got = sorted((r.i, r.j) for r in scheduling.overlap_pairs(left, right, ("id",)).collect())
    assert got == sorted((x[0], y[0]) for x in a for y in b if x[1] == y[1] and x[2] < x[3] and y[2] < y[3] and x[2] < y[3] and y[2] < x[3])


def test_percentiles_equal_numpy(spark):
    import numpy as np

    rng = np.random.default_rng(2)
    groups = {"a": rng.lognormal(0, 2, 500), "b": np.array([3.0]), "c": np.repeat([1.0, 2.0], [7, 4]), None: rng.integers(0, 5, 100).astype(float), "d": np.array([-1e9, 0.0, 1e9, 1e-9])}
    rows = [(g, float(v)) for g, vs in groups.items() for v in vs] + [("e", None), ("a", None)]
    got = {r.g: r for r in monitoring.exact_percentiles(spark.createDataFrame(rows, "g string, x double").repartition(5), ["g"], "x", monitoring.LEVELS).collect()}
    assert set(got) == set(groups)
    for g, vs in groups.items():
        assert [got[g][n] for n in monitoring.LEVELS] == pytest.approx([round(float(np.quantile(vs, p)), 6) for p in monitoring.LEVELS.values()], rel=1e-9, abs=1e-6)


def test_plans_are_used_once_and_superseded(spark):
    from paperloom.operators import workorders as W

    plans = spark.createDataFrame([(p, e) for p, e in (("p1", at(60)), ("p2", at(60)), ("p3", at(5)), ("p4", None), ("p5", None))], "plan_id string, expires_at timestamp").withColumn("token_hash", W.token_hash(F.concat(F.lit("t-"), F.col("plan_id"))))
    uses = [(1, "p1", "wrong", at(1), "o1"), (2, "p1", "t-p1", at(2), "o1"), (3, "p1", "t-p1", at(3), "o1"), (4, "p2", "t-p2", at(4), "o1"), (5, "p3", "t-p3", at(5), "o2"), (6, "p4", "", at(6), "o2"), (7, "p4", "t-p4", at(7), "o2"), (8, "p9", "t", at(8), "o2"), (9, "p4", None, at(9), "o2")]
    used = W.used_plans(plans, spark.createDataFrame(uses, "command_id long, plan_id string, token string, at timestamp, order_key string"))
    assert {r.command_id: r.result for r in used.collect()} == {1: "invalid_token", 2: "ok", 3: "plan_already_used", 4: "ok", 5: "plan_expired", 6: "confirmation_required", 7: "ok", 8: "plan_not_found", 9: "confirmation_required"}
    states = {r.plan_id: r for r in W.plan_states(plans, used).collect()}
    assert {p: r.status for p, r in states.items()} == {"p1": "SUPERSEDED", "p2": "USED", "p3": "CONFIRMED", "p4": "USED", "p5": "CONFIRMED"}
    assert (states["p1"].superseded_at, states["p1"].by_plan_id) == (at(4), "p2")


def test_planner_from_the_store_and_catalogue(spark):
    technicians = spark.createDataFrame([("T2", "S"), ("T1", "S")], "id string, store_id string")
    links = spark.createDataFrame([("T1", "c1", None, None), ("T2", "c2", None, None), ("T2", "c1", at(500), None)], "technician_id string, capability_id string, valid_from timestamp, valid_until timestamp")
    capabilities = spark.createDataFrame([("c1", "brake"), ("c2", "paint")], "id string, code string")
    stations = spark.createDataFrame([("W1", "S", "lift")], "id string, store_id string, workstation_type string")
    devices = spark.createDataFrame([], "id string, store_id string, equipment_type string")
    resources = scheduling.store_resources(technicians, links, capabilities, stations, devices, F.lit(at(0)))
    assert {(r.id, r.ord, len(r.abilities), r.availability[0].start.hour, r.availability[0].end.hour) for r in resources.collect()} == {("T1", 1, 1, 8, 18), ("T2", 2, 2, 8, 18), ("W1", 1, 0, 8, 18)}
    catalogue = spark.createDataFrame([("brake-check", "b", "S", 30, ["brake"], ["lift"], None)], "code string, brand string, store_id string, duration_minutes int, required_skills array<string>, required_workstation_types array<string>, required_equipment_types array<string>")
    asked = spark.createDataFrame([("r1", "brake-check", at(120), "car", "ice")], "request_id string, service_type string, scheduled_at timestamp, category string, powertrain string")
    tasks = scheduling.catalogue_tasks(asked, catalogue)
    (r,) = scheduling.plan(tasks, resources, spark.createDataFrame([], schemas.RESERVATIONS)).collect()
    assert (r.status, r.technician_id, r.workstation_id, r.start) == ("FEASIBLE", "T1", "W1", at(60))
    with pytest.raises(Exception, match="not in the catalogue"):
        scheduling.catalogue_tasks(asked.withColumn("service_type", F.lit("x")), catalogue).collect()


def test_files_reports_and_shards(spark, tmp_path):
    io.replace_file("one", f"{tmp_path}/r.json", spark)
    io.replace_file('{"a": "ä"}', f"{tmp_path}/r.json", spark)
    assert (tmp_path / "r.json").read_text() == '{"a": "ä"}' and not list(tmp_path.glob("*.tmp"))
    df = spark.createDataFrame([("b", None), ("a", "x|y\nz")], "k string, v string")
    io.write_markdown(df, f"{tmp_path}/md")
    assert "".join(p.read_text() for p in (tmp_path / "md").glob("part-*")) == "| k | v |\n|---|---|\n| a | x y z |\n| b |  |\n"
    io.write_json(df, f"{tmp_path}/js")
    assert sorted(json.loads(x)["k"] for p in (tmp_path / "js").glob("part-*") for x in p.read_text().splitlines()) == ["a", "b"]
    (tmp_path / "c").mkdir()
    for name, body in (("one.pdf", b"%PDF-1 a"), ("two.pdf", b"no"), ("same.pdf", b"%PDF-1 a")):
        (tmp_path / "c" / name).write_bytes(body)
    files = spark.read.format("binaryFile").load(f"{tmp_path}/c")
    sha = {r.path.split("/")[-1]: r.sha256 for r in io.file_versions(files).collect()}
    manifest = spark.createDataFrame([("one.pdf", sha["one.pdf"], 3), ("two.pdf", "x", 1), ("same.pdf", sha["same.pdf"], 1), ("gone.pdf", "x", 1), ("gone2.pdf", "x", 1)], "relative_path string, sha256 string, page_count int")
    pages = spark.createDataFrame([("one.pdf", 2), ("same.pdf", 1)], "relative_path string, n_pages int")
    got = {r.relative_path: r.problems for r in io.audit_files(manifest, files, f"{tmp_path}/c", pages).collect()}
    assert got == {"one.pdf": ["duplicate_content", "page_count_mismatch"], "two.pdf": ["bad_signature", "hash_mismatch"], "same.pdf": ["duplicate_content"], "gone.pdf": ["missing"], "gone2.pdf": ["missing"]}
    for n in (1, 2):
        (tmp_path / f"s{n}.json").write_text(json.dumps([{"query": f"q{n}"}, {"query": "z", "case_id": "own"}]))
    paths = [f"{tmp_path}/s{n}.json" for n in (1, 2)]
    assert sorted((r.query, r._ord, r.case_id) for r in io.read_shards(spark, paths, 2).collect()) == [("q1", 1, None), ("q2", 1, None), ("z", 2, "own"), ("z", 2, "own")]
    with pytest.raises(ValueError):
        io.read_shards(spark, paths)
