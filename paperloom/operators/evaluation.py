"""Offline retrieval evaluation: ranks of expected items, Hit@K and MRR."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

CUTS = (1, 3, 5, 10)


def expected(title: Column, path: Column, expectations: Column) -> Column:
    """Whether any expectation (title, path_contains) fits a section."""
    return F.exists(expectations, lambda e: (e["title"] == title) & (F.size(F.array_except(e["path_contains"], path)) == 0))


def first_rank(ranked: DataFrame, relevant: DataFrame, cases: DataFrame, rank_col: str = "rank", keys: tuple[str, ...] = ()) -> DataFrame:
    """Rank of the first relevant item for every case (null: not found)."""
    hit = ranked.join(relevant.select("query_id", "doc_id").distinct(), ["query_id", "doc_id"]).groupBy("query_id", *keys).agg(F.min(rank_col).alias("rank"))
    wanted = cases.select("query_id").distinct() if not keys else cases.select("query_id").distinct().crossJoin(F.broadcast(ranked.select(*keys).distinct()))
    return wanted.join(hit, ["query_id", *keys], "left")


def metrics(ranks: DataFrame, *by: str, digits: int = 4) -> DataFrame:
    """cases, hit_1 .. hit_10 and mrr of (rank) rows; a missing rank is a miss."""
    hits = [F.round(F.avg(F.when(F.col("rank") <= k, 1.0).otherwise(0.0)), digits).alias(f"hit_{k}") for k in CUTS]
    return ranks.groupBy(*by).agg(F.count("*").alias("cases"), *hits, F.round(F.avg(F.coalesce(1.0 / F.col("rank"), F.lit(0.0))), digits).alias("mrr"))


def level_metrics(hits: DataFrame, relevant: DataFrame, cases: DataFrame, levels: tuple[str, ...]) -> DataFrame:
    """hits (query_id, rank, and a column for each level, a section or document
    say), relevant the same without rank: metrics of each level, where only the
    first hit of a value counts and values are ranked anew."""
    out = None
    for level in levels:
        first = hits.groupBy("query_id", F.col(level).alias("doc_id")).agg(F.min("rank").alias("_r"))
        ranked = first.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("_r", "doc_id")))
        part = metrics(first_rank(ranked, relevant.select("query_id", F.col(level).alias("doc_id")), cases)).withColumn("level", F.lit(level))
        out = part if out is None else out.unionByName(part)
    return out


def report(ranks: DataFrame, candidates: DataFrame | None = None) -> DataFrame:
    """One row: stages, the metrics of each stage, and cases, of each case the
    rank at every stage; ranks (stage, query_id, rank)."""
    by_stage = metrics(ranks, "stage").agg(F.array_sort(F.collect_list(F.struct("stage", "cases", *[f"hit_{k}" for k in CUTS], "mrr"))).alias("stages"))
    each = ranks.groupBy("query_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("stage", "rank")))).alias("ranks"))
    if candidates is not None:
        each = each.join(candidates.select("query_id", "candidates"), "query_id", "left")
    listed = each.agg(F.array_sort(F.collect_list(F.struct("query_id", F.to_json(F.struct(*[c for c in each.columns if c != "query_id"])).alias("result")))).alias("cases"))  # the cases of an evaluation set
    return by_stage.crossJoin(listed)


def case_scores(rank: Column) -> Column:
    return F.struct(*[F.when(rank <= k, 1.0).otherwise(0.0).alias(f"hit_{k}") for k in CUTS], F.coalesce(1.0 / rank, F.lit(0.0)).alias("mrr"))


def replay(cases: DataFrame, report: DataFrame) -> DataFrame:
    """Each case with its reported result, by case id and else by query; a case
    without either is an error."""
    by_id = report.where("case_id is not null").select("case_id", F.col("result").alias("_by_id"))
    by_query = report.groupBy("query").agg(F.first("result").alias("_by_query"))
    out = cases.join(by_id, "case_id", "left").join(by_query, "query", "left").withColumn("result", F.coalesce("_by_id", "_by_query"))
    return out.where(F.assert_true(F.col("result").isNotNull(), F.concat(F.lit("no result for "), F.coalesce("case_id", "query"))).isNull()).drop("_by_id", "_by_query")


def annotation_violations(cases: DataFrame, sections: DataFrame, positives_per_document: int = 3) -> DataFrame:
    """(case_id, violation): repeated ids or queries, unknown sections, quotes
    not in the section, pages outside it, language against script, and
    documents without their number of positives."""
    positive = cases.where("case_kind = 'positive'")
    known = sections.select(F.col("section_id").alias("expected_section_id"), F.col("text").alias("_text"), F.col("document_id").alias("_doc"), "page_start", "page_end")
    joined = positive.join(known, "expected_section_id", "left")
    cjk = F.col("query").rlike(r"[一-鿿]")
    checks = F.array(
        F.when(F.col("_text").isNull(), "unknown_section"), F.when(F.col("_doc") != F.col("expected_document_id"), "other_document"),
        F.when(~F.contains("_text", "evidence_quote"), "quote_not_verbatim"), F.when((F.col("evidence_page_start") < F.col("page_start")) | (F.col("evidence_page_end") > F.col("page_end")), "page_out_of_range"),
        F.when(cjk != (F.col("language") == "zh"), "language_mismatch"),
    )
    each = joined.select("case_id", F.explode(F.array_compact(checks)).alias("violation"))
    repeated = lambda c: cases.groupBy(c).agg(F.count("*").alias("n"), F.min("case_id").alias("case_id")).where("n > 1").select("case_id", F.lit(f"repeated_{c}").alias("violation"))
    twice = cases.groupBy("case_id").count().where("count > 1").select("case_id", F.lit("repeated_case_id").alias("violation"))
    quota = positive.groupBy("expected_document_id").count().where(F.col("count") != positives_per_document).select(F.col("expected_document_id").alias("case_id"), F.lit("positives_of_document").alias("violation"))
    return each.unionByName(twice).unionByName(repeated("query")).unionByName(quota)


def normalised_case(cases: DataFrame) -> DataFrame:
    """Inputs, reference outputs and metadata of evaluation cases; a missing id
    is its place in the file, and a case without a query is an error."""
    place = F.concat(F.lit("case_"), F.col("_ord").cast("string"))
    told = F.raise_error(F.concat(F.lit("an evaluation case has no query: "), F.coalesce("case_id", place)))
    cases = cases.withColumn("query", F.when(F.coalesce("query", F.lit("")) != "", F.col("query")).otherwise(told.cast("string")))
    return cases.select(
        F.coalesce("case_id", place).alias("case_id"), F.struct("query", "question_type", "required_knowledge").alias("inputs"),
        F.struct("expected_title", "expected_path_contains").alias("reference"), F.struct(F.coalesce("case_id", place).alias("case_id"), "question_type").alias("metadata"),
    )
