"""Weighted reciprocal-rank fusion of ranked lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

RRF_K = 60


def reciprocal_ranks(dense: DataFrame, lexical: DataFrame, limit: int | None = 50) -> DataFrame:
    """(query_id, doc_id, dense_rank, lexical_rank) of what either route has."""
    cut = lambda d: d if limit is None else d.where(F.col("rank") <= limit)
    none = F.lit(None).cast("int")
    both = cut(dense).select("query_id", "doc_id", F.col("rank").alias("d"), none.alias("l")).unionByName(cut(lexical).select("query_id", "doc_id", none.alias("d"), F.col("rank").alias("l")))
    return both.groupBy("query_id", "doc_id").agg(F.min("d").alias("dense_rank"), F.min("l").alias("lexical_rank"))


def fused_score(dense_weight: float | Column = 1.0, lexical_weight: float | Column = 1.0, k: int = RRF_K, digits: int = 9) -> Column:
    as_column = lambda w: w if isinstance(w, Column) else F.lit(float(w))
    part = lambda w, c: F.coalesce(as_column(w) / (F.col(c) + k), F.lit(0.0))
    return F.round(part(dense_weight, "dense_rank") + part(lexical_weight, "lexical_rank"), digits)


def order(*keys: str) -> Window:
    """By score, ties in the order of the dense list, then of the lexical one."""
    return Window.partitionBy("query_id", *keys).orderBy(F.desc("score"), F.asc_nulls_last("dense_rank"), "lexical_rank")


def rrf(dense: DataFrame, lexical: DataFrame, limit: int = 50, top: int | None = None, dense_weight: float = 1.0, lexical_weight: float = 1.0) -> DataFrame:
    """(query_id, doc_id, dense_rank, lexical_rank, score, rank)."""
    scored = reciprocal_ranks(dense, lexical, limit).withColumn("score", fused_score(dense_weight, lexical_weight))
    out = scored.withColumn("rank", F.row_number().over(order()))
    return out if top is None else out.where(F.col("rank") <= top)


def rrf_sweep(dense: DataFrame, lexical: DataFrame, ratios: list[float], limit: int = 50) -> DataFrame:
    """rrf for each dense : lexical ratio, with a ratio column."""
    each = reciprocal_ranks(dense, lexical, limit).withColumn("ratio", F.explode(F.array(*[F.lit(float(r)) for r in ratios])))
    return each.withColumn("score", fused_score(F.col("ratio"))).withColumn("rank", F.row_number().over(order("ratio")))
