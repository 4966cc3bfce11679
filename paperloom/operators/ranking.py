"""Business rules, final scores, section roll-up and rank comparison."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from paperloom.schemas import CONTENT_TYPES, QUESTION_TYPES

#: Content types that suit a question type: fixed values.  Any other pair is `none`.
PRIMARY = {
    "principle": ("technical_training",), "diagnosis": ("diagnostic_manual", "repair_manual"), "repair": ("repair_manual",), "specification": ("repair_manual",),
    "maintenance": ("repair_manual",), "training": ("training_plan", "equipment_list"), "competition": ("competition_file",),
}
SUPPORTING = {
    "principle": ("repair_manual", "diagnostic_manual", "technical_article"), "diagnosis": ("technical_training", "technical_article"), "repair": ("diagnostic_manual", "technical_training"),
    "specification": ("diagnostic_manual", "technical_training"), "maintenance": ("technical_training", "technical_article"), "training": ("technical_training",), "competition": ("training_plan",), "general": CONTENT_TYPES,
}
#: Profile labels: fixed values.
QUESTION_LABELS = {
    "principle": "working principle / 工作原理", "diagnosis": "fault diagnosis / 故障诊断", "repair": "repair procedure / 维修操作", "specification": "technical specification / 技术参数",
    "maintenance": "maintenance guidance / 保养维护", "training": "training resources / 培训资源", "competition": "competition rules / 竞赛规则", "general": "general technical knowledge / 通用技术知识",
}
CONTENT_LABELS = {
    "technical_training": "OEM technical training / 原厂技术培训", "repair_manual": "repair service manual / 维修手册", "diagnostic_manual": "diagnostic manual / 诊断手册", "technical_article": "technical article / 技术文章",
    "competition_file": "competition technical file / 竞赛技术文件", "training_plan": "training plan / 培训方案", "equipment_list": "equipment list / 设备清单", "official_news": "official news / 官方新闻", "other": "other document / 其他文档",
}
RULE_WEIGHT = 0.2
COMPATIBILITY_POINTS = {"primary": 1.0, "supporting": 0.5, "none": 0.0}
QUALITY_POINTS = {"pass": 1.0, "warning": 0.75, "quarantine": 0.0}
MISSING_RANK = 21


def mapped(value: Column, table: dict, default: object = None) -> Column:
    out = F.lit(default)
    for k, v in reversed(table.items()):
        out = F.when(value == k, F.lit(v)).otherwise(out)
    return out


def compatibility(question_type: Column, content_type: Column) -> Column:
    pairs = [(k, t, "primary") for k, ts in PRIMARY.items() for t in ts] + [(k, t, "supporting") for k, ts in SUPPORTING.items() for t in ts]
    key = F.concat_ws("|", question_type, content_type)
    named = lambda kind: key.isin(*[f"{q}|{c}" for q, c, got in pairs if got == kind])
    return F.when(named("primary"), "primary").when(named("supporting"), "supporting").otherwise("none")


def rule_score(question_type: Column, content_type: Column, confidence: Column, status: Column) -> Column:
    """0.6 compatibility + 0.2 confidence + 0.2 text quality; 0 for unknown types."""
    known = question_type.isin(*QUESTION_TYPES) & content_type.isin(*CONTENT_TYPES)
    sure = F.least(F.greatest(F.coalesce(confidence, F.lit(0.0)), F.lit(0.0)), F.lit(1.0))
    points = 0.6 * mapped(compatibility(question_type, content_type), COMPATIBILITY_POINTS, 0.0) + 0.2 * sure + 0.2 * F.coalesce(mapped(status, QUALITY_POINTS, 0.5), F.lit(0.5))
    return F.when(F.coalesce(known, F.lit(False)), F.round(points, 6)).otherwise(F.lit(0.0))


def rule_reason(question_type: Column, content_type: Column) -> Column:
    known = F.coalesce(question_type.isin(*QUESTION_TYPES) & content_type.isin(*CONTENT_TYPES), F.lit(False))
    return F.when(known, compatibility(question_type, content_type)).otherwise("unknown_profile")


def final_score(model_score: Column, rule: Column, weight: float = RULE_WEIGHT) -> Column:
    return F.round((1 - weight) * model_score + weight * rule, 9)


def rerank(candidates: DataFrame, weight: float = RULE_WEIGHT) -> DataFrame:
    """candidates (query_id, doc_id, rank, model_score, rule_score) -> with
    final_score and final_rank; ties keep the earlier order.  A query with any
    failed model score (null) keeps its earlier order and is marked `fallback`."""
    by_query = Window.partitionBy("query_id")
    out = candidates.withColumn("fallback", F.max(F.col("model_score").isNull()).over(by_query))
    out = out.withColumn("final_score", F.when(~F.col("fallback"), final_score(F.col("model_score"), F.col("rule_score"), weight)))
    return out.withColumn("final_rank", F.row_number().over(by_query.orderBy(F.desc_nulls_last("final_score"), "rank")))


def yes_probability(no_logit: Column, yes_logit: Column) -> Column:
    """Softmax over two logits."""
    return 1 / (1 + F.exp(no_logit - yes_logit))


def label_score(answer: Column) -> Column:
    """DIRECT 1, RELATED 0.5, IRRELEVANT 0; any other answer fails."""
    label = F.regexp_extract(F.upper(answer), r"\b(DIRECT|RELATED|IRRELEVANT)\b", 1)
    value = mapped(label, {"DIRECT": 1.0, "RELATED": 0.5, "IRRELEVANT": 0.0})
    return F.when(F.assert_true(value.isNotNull(), F.concat(F.lit("not a relevance label: "), answer)).isNull(), value)


def model_scores(pairs: DataFrame, model: Callable[[list[str], list[str]], list[float]], query_col: str, text_col: str, out: str = "model_score") -> DataFrame:
    """Scores from any cross-encoder that maps queries and texts to numbers."""

    @F.pandas_udf("double")
    def run(queries: pd.Series, texts: pd.Series) -> pd.Series:
        return pd.Series(model(queries.tolist(), texts.tolist()), dtype="float64")

    return pairs.withColumn(out, run(query_col, text_col))


def query_profile(question_type: Column, knowledge: Column, query: Column) -> Column:
    return F.concat_ws("\n", F.concat(F.lit("Question type: "), mapped(question_type, QUESTION_LABELS)), F.concat(F.lit("Required knowledge: "), F.btrim(knowledge)), F.concat(F.lit("Query: "), F.btrim(query)))


def chunk_profile(content_type: Column, path: Column, subheadings: Column, text: Column) -> Column:
    return F.concat_ws(
        "\n", F.concat(F.lit("Document content type: "), mapped(content_type, CONTENT_LABELS)), F.concat(F.lit("Section: "), F.array_join(path, " > ")),
        F.when(F.size(subheadings) > 0, F.concat(F.lit("Subheadings: "), F.array_join(subheadings, " | "))), F.concat(F.lit("Content: "), F.btrim(text)),
    )


def section_rollup(hits: DataFrame, sections: DataFrame | None = None) -> DataFrame:
    """hits (query_id, section_id, chunk_id, rank) -> one row per section:
    section_rank is its place among sections by best chunk, counted before
    unknown sections are dropped; matched chunk ids by rank."""
    grouped = hits.groupBy("query_id", "section_id").agg(F.min("rank").alias("best_rank"), F.transform(F.array_sort(F.collect_list(F.struct("rank", "chunk_id"))), lambda x: x["chunk_id"]).alias("chunk_ids"))
    out = grouped.withColumn("section_rank", F.row_number().over(Window.partitionBy("query_id").orderBy("best_rank")))
    return out if sections is None else out.join(sections.select("section_id").distinct(), "section_id", "left_semi")


def section_order(hits: DataFrame) -> DataFrame:
    """First hit of each section, renumbered."""
    first = hits.withColumn("_k", F.row_number().over(Window.partitionBy("query_id", "section_id").orderBy("rank"))).where("_k = 1").drop("_k")
    return first.withColumn("section_rank", F.row_number().over(Window.partitionBy("query_id").orderBy("rank")))


def contributing_documents(hits: DataFrame, documents: DataFrame) -> DataFrame:
    return documents.join(hits.select("document_id"), "document_id", "left_semi")


def evidence(hits: DataFrame, documents: DataFrame, sections: DataFrame) -> DataFrame:
    """What an answer may quote: text, section title, file name, confidence."""
    kept = hits.join(documents.select("document_id", "filename", "metadata_confidence"), "document_id").join(sections.select("section_id", F.col("title").alias("section_title")), "section_id", "left")
    return kept.select("query_id", "rank", F.struct("text", "section_title", "filename", "metadata_confidence").alias("evidence"))


def candidate_summary(ranked: DataFrame, score_col: str | None = None, limit: int = 20) -> DataFrame:
    fields = [F.col("rank"), F.col("doc_id"), *([F.col(score_col)] if score_col else [])]
    return ranked.where(F.col("rank") <= limit).groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct(*fields))).alias("candidates"))


def rank_delta(before: DataFrame, after: DataFrame, missing: int = MISSING_RANK) -> DataFrame:
    """before - after rank of each item among the first 20 of either list; a
    missing rank is 21."""
    before, after = before.where(F.col("rank") < missing), after.where(F.col("rank") < missing)
    a, b = before.select("query_id", "doc_id", F.col("rank").alias("before_rank")), after.select("query_id", "doc_id", F.col("rank").alias("after_rank"))
    return a.join(b, ["query_id", "doc_id"], "full_outer").withColumn("delta", F.coalesce("before_rank", F.lit(missing)) - F.coalesce("after_rank", F.lit(missing)))
