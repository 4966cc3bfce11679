"""Runtime quality monitoring: rates, exact percentiles, slices, alerts, bad
cases and release gates."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

DIMENSIONS = ("release_version", "question_type", "language", "document_type")
LEVELS = {"p50": 0.50, "p95": 0.95, "p99": 0.99}
STEPS = 4096
#: Keys a stored sample may have, and domains of its enumerations: fixed values.
STATUSES = ("complete", "fallback", "error")
REGRESSION_FIELDS = ("case_id", "query", "question_type", "required_knowledge", "expected_title", "expected_path_contains", "expected_sections")
ROOT_CAUSES = ("parsing", "cleaning", "sectioning", "chunking", "embedding", "dense_retrieval", "bm25", "fusion", "reranking", "prompt", "evaluation_data")


def rate(condition: Column) -> Column:
    """Share of rows; 0 of none, and a null condition does not count."""
    return F.round(F.count_if(condition) / F.greatest(F.count("*"), F.lit(1)), 6)


def health_columns() -> list[Column]:
    return [
        F.count("*").alias("requests"), rate(F.col("status") == "complete").alias("success_rate"), rate(F.col("fallback")).alias("fallback_rate"),
        rate(F.coalesce("candidate_count", F.lit(0)) == 0).alias("empty_retrieval_rate"), rate(F.col("error_code") == "TIMEOUT").alias("timeout_rate"),
    ]


def _same(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Join by keys, of which nulls are equal; with the keys of left."""
    renamed = right.select(*[F.col(k).alias(f"_r{i}") for i, k in enumerate(keys)], *[c for c in right.columns if c not in keys])
    on = F.lit(True)
    for i, k in enumerate(keys):
        on = on & F.col(k).eqNullSafe(F.col(f"_r{i}"))
    return left.join(renamed, on, how).drop(*[f"_r{i}" for i in range(len(keys))])


def exact_percentiles(rows: DataFrame, by: list[str], value: str, levels: dict[str, float]) -> DataFrame:
    """(by, a column for each level): percentiles with linear interpolation, null
    values left out.

    Equal values are counted before they are shuffled.  The distinct values of a
    group fall into STEPS equal ranges between its smallest and largest; the
    ranges are ranked by their counts, and values within their range, so a group
    of any size is ranked in many tasks."""
    by = [*by, "_all"]
    counts = rows.where(F.col(value).isNotNull()).withColumn("_all", F.lit(0)).groupBy(*by, F.col(value).cast("double").alias("v")).agg(F.count("*").alias("n"))
    bounds = counts.groupBy(*by).agg(F.min("v").alias("lo"), F.max("v").alias("hi"), F.sum("n").alias("total"))
    share = F.coalesce((F.col("v") - F.col("lo")) / F.nullif(F.col("hi") - F.col("lo"), F.lit(0.0)), F.lit(0.0))
    placed = _same(counts, bounds, by).withColumn("step", F.least(F.floor(share * STEPS), F.lit(STEPS - 1)))
    before = F.coalesce(F.sum("s").over(Window.partitionBy(*by).orderBy("step").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranges = placed.groupBy(*by, "step").agg(F.sum("n").alias("s")).withColumn("before", before).drop("s")
    upto = F.col("before") + F.sum("n").over(Window.partitionBy(*by, "step").orderBy("v"))
    ranked = _same(placed, ranges, [*by, "step"]).withColumn("upto", upto).withColumn("first", F.col("upto") - F.col("n"))
    at = {name: F.lit(p) * (F.col("total") - 1) for name, p in levels.items()}
    held = lambda r: F.max(F.when((F.col("first") <= r) & (r < F.col("upto")), F.col("v")))
    wanted = [c for name, pos in at.items() for c in (held(F.floor(pos)).alias(f"_lo_{name}"), held(F.ceil(pos)).alias(f"_hi_{name}"))]
    found = ranked.groupBy(*by, "total").agg(*wanted)
    weight = {name: pos - F.floor(pos) for name, pos in at.items()}
    return found.select(*by[:-1], *[F.round((1 - weight[n]) * F.col(f"_lo_{n}") + weight[n] * F.col(f"_hi_{n}"), 6).alias(n) for n in levels])


def runtime_health(samples: DataFrame, *by: str) -> DataFrame:
    """Rates and percentiles of each group; without `by` one row, of no samples too."""
    return _same(samples.groupBy(*by).agg(*health_columns()), exact_percentiles(samples, list(by), "total_seconds", LEVELS), list(by), "left")


def stage_latency(samples: DataFrame, *by: str) -> DataFrame:
    each = samples.select(*by, F.explode("stage_seconds").alias("stage", "seconds"))
    return exact_percentiles(each, [*by, "stage"], "seconds", {n: LEVELS[n] for n in ("p50", "p95")})


def error_counts(samples: DataFrame) -> DataFrame:
    return samples.where("error_code is not null and error_code != ''").groupBy("error_code").agg(F.count("*").alias("n"))


def health_by_dimension(samples: DataFrame, dimensions: tuple[str, ...] = DIMENSIONS) -> DataFrame:
    """(dimension, value, ...) for each value of each dimension by itself: the
    rows are shuffled once, unpivoted.  Missing and empty values have no slice."""
    measures = ["status", "fallback", "candidate_count", "error_code", "total_seconds"]
    pairs = F.array(*[F.struct(F.lit(d).alias("dimension"), F.col(d).cast("string").alias("value")) for d in dimensions])
    each = samples.select(*measures, F.explode(pairs).alias("p")).select(*measures, "p.*").where("value is not null and value != ''")
    return runtime_health(each, "dimension", "value")


@dataclass(frozen=True)
class AlertPolicy:
    latency: float = 1.5
    rate: float = 2.0
    minimum_requests: int = 20


def alerts(current: DataFrame, baseline: DataFrame, policy: AlertPolicy = AlertPolicy()) -> DataFrame:
    """(metric, value, threshold) of what is above its multiple of the baseline;
    both inputs are one row of runtime_health.  The metric names are fixed values."""
    checks = (("latency.p95", F.col("p95"), policy.latency), ("fallback_rate", F.col("fallback_rate"), policy.rate), ("empty_retrieval_rate", F.col("empty_retrieval_rate"), policy.rate), ("failure_rate", 1 - F.col("success_rate"), policy.rate))
    row = lambda name: F.array(*[F.struct(F.lit(m).alias("metric"), F.round(c, 6).alias(name), F.lit(k).alias("multiple")) for m, c, k in checks])
    now = current.where(F.col("requests") >= policy.minimum_requests).select(F.explode(row("value")).alias("c")).select("c.metric", "c.value")
    then = baseline.select(F.explode(row("normal")).alias("b")).select("b.metric", F.round(F.col("b.normal") * F.col("b.multiple"), 6).alias("threshold"))
    return now.join(F.broadcast(then), "metric").where("value > threshold")


def release_gate(candidate: DataFrame, baseline: DataFrame, tolerance: float = 1.2) -> DataFrame:
    """One row (passed, failures) from one-row inputs (hit_5, mrr, p95,
    new_severe); reranker metrics are given if there are any, else the fused ones.
    The messages are fixed values."""
    b = baseline.select(F.col("hit_5").alias("b_hit"), F.col("mrr").alias("b_mrr"), F.col("p95").alias("b_p95"))
    failures = F.array_compact(F.array(
        F.when(F.coalesce("hit_5", F.lit(0.0)) < F.coalesce("b_hit", F.lit(0.0)), "hit@5 regressed"), F.when(F.coalesce("mrr", F.lit(0.0)) < F.coalesce("b_mrr", F.lit(0.0)), "mrr regressed"),
        F.when(F.col("p95") > F.col("b_p95") * tolerance, "p95 latency regressed"), F.when(F.coalesce("new_severe", F.lit(0)) > 0, "new severe bad cases"),
    ))
    return candidate.crossJoin(F.broadcast(b)).select((F.size(failures) == 0).alias("passed"), F.array_join(failures, "; ").alias("failures"))


def reranker_effect(cases: DataFrame) -> DataFrame:
    """Lift and harm of reranking (rrf, reranker ranks), by question type and overall."""
    eligible = F.col("rrf").isNotNull()
    n = F.count_if(eligible)
    share = lambda c: F.round(F.count_if(eligible & c) / F.greatest(n, F.lit(1)), 6)
    return cases.rollup("question_type").agg(
        n.alias("eligible_cases"), share(F.coalesce(F.col("reranker") < F.col("rrf"), F.lit(False))).alias("positive_lift_rate"), share(F.col("reranker").isNull() | (F.col("reranker") > F.col("rrf"))).alias("harm_rate")
    ).withColumn("question_type", F.coalesce("question_type", F.lit("overall")))


def answer_quality(records: DataFrame) -> DataFrame:
    """records (record_id, claims array<struct<id,citation_ids>>, citations
    array<struct<id,supports_claim_ids>>, refused, evidence_available, tokens,
    cost) -> citation coverage, correctness, groundedness; within the row."""
    supports = lambda link, claim: F.exists("citations", lambda c: (c["id"] == link) & F.array_contains(c["supports_claim_ids"], claim))
    none = F.array()
    claims = F.coalesce("claims", none.cast("array<struct<id:string,citation_ids:array<string>>>"))
    links = lambda c: F.coalesce(c["citation_ids"], none.cast("array<string>"))
    each = F.transform(claims, lambda c: F.struct(F.size(links(c)).alias("links"), F.size(F.filter(links(c), lambda x: F.coalesce(supports(x, c["id"]), F.lit(False)))).alias("good")))
    total = F.size("_c")
    add = lambda f: F.aggregate("_c", F.lit(0), lambda s, c: s + f(c))
    out = records.withColumn("_c", each)
    out = out.withColumns({"_cited": add(lambda c: (c["links"] > 0).cast("int")), "_links": add(lambda c: c["links"]), "_good": add(lambda c: c["good"]), "_supported": add(lambda c: (c["good"] > 0).cast("int"))})
    at_least = lambda c: F.greatest(c, F.lit(1))
    return out.select(
        "record_id", F.round(F.col("_cited") / at_least(total), 6).alias("citation_coverage"), F.round(F.col("_good") / at_least(F.col("_links")), 6).alias("citation_correctness"), F.round(F.col("_supported") / at_least(total), 6).alias("groundedness"),
        ((total > 0) & (F.col("_supported") < total)).alias("unsupported_answer"), (F.coalesce("refused", F.lit(False)) & ~F.coalesce("evidence_available", F.lit(True))).alias("insufficient_evidence_refusal"),
        F.coalesce("tokens", F.lit(0)).alias("tokens"), F.coalesce("cost", F.lit(0.0)).alias("cost"),
    )


def _cases(df: DataFrame, rules: list[tuple[Column, Column, str, bool]], version: str) -> DataFrame:
    """One row for each rule that holds."""
    entries = F.array(*[F.when(F.coalesce(c, F.lit(False)), F.struct(stage.alias("failure_stage"), F.lit(reason).alias("reason"), F.lit(safe).alias("safety"))) for c, stage, reason, safe in rules])
    each = df.withColumn("_e", F.explode(F.array_compact(entries)))
    return each.select(F.concat_ws(":", "case_id", "_e.failure_stage", "_e.reason").alias("key"), "case_id", "_e.failure_stage", "_e.reason", F.lit(version).alias("introduced_by_version"), "_e.safety", F.lit("OPEN").alias("status"))


def retrieval_bad_cases(cases: DataFrame, version: str) -> DataFrame:
    """cases (case_id, final_stage, ranks, n_candidates (null: not reported),
    reranker_error, safety)."""
    stage = F.coalesce("final_stage", F.lit("reranker"))
    final, rrf, rr = F.col("ranks.reranker"), F.col("ranks.rrf"), F.col("ranks.reranker")
    final = F.when(stage == "rrf", rrf).otherwise(final)
    rules = [
        (F.col("n_candidates") == 0, F.lit("retrieval"), "empty_retrieval", False), (final.isNull() | (final > 5), stage, "expected_rank_gt_5", False),
        (F.coalesce("reranker_error", F.lit("")) != "", F.lit("reranker"), "reranker_fallback", False), (rrf.isNotNull() & (rr.isNull() | (rr > rrf)), F.lit("reranker"), "reranker_demoted_expected", False),
        (F.col("safety") & (final.isNull() | (final > 1)), stage, "safety_case_failed", True),
    ]
    return _cases(cases, rules, version)


def answer_bad_cases(records: DataFrame, version: str) -> DataFrame:
    """records of answer_quality input with case_id and user_downvote."""
    scored = records.join(answer_quality(records).drop("tokens", "cost"), "record_id")
    rules = [
        (F.col("user_downvote"), F.lit("answer"), "user_downvote", False), (F.col("unsupported_answer"), F.lit("answer"), "answer_not_grounded", False),
        ((F.col("citation_correctness") < 1) & (F.size("citations") > 0), F.lit("citation"), "citation_does_not_support_claim", False),
    ]
    return _cases(scored, rules, version)


def upsert_bad_cases(stored: DataFrame, found: DataFrame, now: Column) -> DataFrame:
    """Full outer join on key: what is known keeps its creation time, and its
    status and root cause unless it was FIXED, which opens it again."""
    s, f = stored.alias("s"), found.dropDuplicates(["key"]).alias("f")
    both = s.join(f, F.col("s.key") == F.col("f.key"), "full_outer")
    seen, old = F.col("f.key").isNotNull(), F.col("s.key").isNotNull()
    kept = old & (~seen | (F.col("s.status") != "FIXED"))
    latest = lambda c: F.coalesce(f"f.{c}", f"s.{c}").alias(c)
    return both.select(
        latest("key"), latest("case_id"), latest("failure_stage"), latest("reason"), latest("introduced_by_version"), latest("safety"),
        F.when(kept, F.col("s.status")).otherwise("OPEN").alias("status"), F.when(kept, F.col("s.root_cause")).alias("root_cause"),
        F.when(old, F.col("s.created_at")).otherwise(now).alias("created_at"), F.when(seen, now).otherwise(F.col("s.updated_at")).alias("updated_at"),
    )


def classify(cases: DataFrame, key: str, root_cause: str, now: Column) -> DataFrame:
    if root_cause not in ROOT_CAUSES:
        raise ValueError(f"unknown root cause: {root_cause}")
    return _updated(cases, key, {"root_cause": F.lit(root_cause), "status": F.lit("CONFIRMED"), "updated_at": now})


def resolve(cases: DataFrame, key: str, now: Column) -> DataFrame:
    """Only a case with a root cause can be FIXED."""
    cause = F.when(F.assert_true(F.col("root_cause").isNotNull(), F.lit("classify the case first")).isNull(), F.lit("FIXED"))
    return _updated(cases, key, {"status": cause, "updated_at": now})


def _updated(cases: DataFrame, key: str, values: dict[str, Column]) -> DataFrame:
    mine = F.col("key") == key
    return cases.select(*[F.when(mine, values[c]).otherwise(F.col(c)).alias(c) if c in values else F.col(c) for c in cases.columns])


def promote(cases: DataFrame, golden: DataFrame) -> DataFrame:
    """Cases no longer open with a regression payload, appended if their id is new."""
    new = cases.where("status != 'OPEN' and regression_case is not null").withColumn("_k", F.row_number().over(Window.partitionBy("case_id").orderBy("key"))).where("_k = 1")
    return golden.unionByName(new.join(golden, "case_id", "left_anti").select("case_id", F.col("regression_case").alias("payload")))


def dashboard(cases: DataFrame) -> DataFrame:
    """Counts of cases by root cause, open and fixed."""
    return cases.groupBy(F.coalesce("root_cause", F.lit("unclassified")).alias("root_cause")).agg(F.count_if(F.col("status") == "OPEN").alias("open"), F.count_if(F.col("status") == "FIXED").alias("fixed"), F.count("*").alias("n"))


def recordable(raw: DataFrame, now: Column, allowed: tuple[str, ...]) -> DataFrame:
    """Only allowed keys, an unknown status is an error, a missing time is now."""
    status = F.col("status").isin(*STATUSES)
    kept = raw.select(*[F.col(c) for c in raw.columns if c in allowed])
    kept = kept.where(F.assert_true(F.coalesce(status, F.lit(False)), F.concat(F.lit("unknown status: "), F.coalesce("status", F.lit("null")))).isNull())
    return kept.withColumn("timestamp", F.coalesce("timestamp", now) if "timestamp" in kept.columns else now)


def recorded_answers(records: DataFrame, versions: dict[str, str], now: Column) -> DataFrame:
    """answer_quality() of records as they are logged, with versions and time."""
    return with_versions(answer_quality(records), versions).withColumn("timestamp", now)


def with_versions(df: DataFrame, versions: dict[str, str]) -> DataFrame:
    return df.withColumns({k: F.lit(v) for k, v in versions.items()})
