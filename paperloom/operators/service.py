"""Retrieval as a service over tables: many requests in, their chunks, sections
and documents out, and the compact payload that an answer is written from."""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperloom.operators import fusion, lexical, ranking, vector
from paperloom.operators.sizing import small
from paperloom.schemas import QUESTION_TYPES

#: Limits of a request: fixed values.
QUERY_CHARACTERS, TOP_CHUNKS = 4000, 15
ROUTE_LIMIT = 50


def _checked(good: Column, value: Column, message: str) -> Column:
    """value where good holds, else an error."""
    return F.when(F.coalesce(good, F.lit(False)), value).otherwise(F.raise_error(F.concat(F.lit(f"{message}: "), F.coalesce("query_id", F.lit("null")).cast("string"))).cast("string"))


def checked_requests(requests: DataFrame) -> DataFrame:
    """requests (query_id, query, question_type, top_chunks): a query without
    text or of more than QUERY_CHARACTERS, an unknown question type, or a number
    of chunks outside 1 to TOP_CHUNKS is an error; a missing number is the most."""
    top = F.coalesce(F.col("top_chunks") if "top_chunks" in requests.columns else F.lit(None), F.lit(TOP_CHUNKS)).cast("int")
    return requests.select(
        "query_id", _checked((F.btrim("query") != "") & (F.length("query") <= QUERY_CHARACTERS), F.col("query"), "query is empty or too long").alias("query"), _checked(F.col("question_type").isin(*QUESTION_TYPES), F.col("question_type"), "unknown question type").alias("question_type"),
        _checked(top.between(1, TOP_CHUNKS), top.cast("string"), "top_chunks must be between 1 and 15").cast("int").alias("top_chunks"),
    )


def profile_pair(question_type: Column, knowledge: Column, query: Column, index_text: Column) -> Column:
    """What a reranker compares; blank queries or knowledge are an error."""
    said = lambda c, name: F.when(F.btrim(F.coalesce(c, F.lit(""))) != "", c).otherwise(F.raise_error(F.lit(f"{name} must not be empty")).cast("string"))
    return F.struct(ranking.query_profile(question_type, said(knowledge, "required_knowledge"), said(query, "query")).alias("query_profile"), index_text.alias("chunk_profile"))


class Response(NamedTuple):
    chunks: DataFrame  # query_id, rank, chunk_id, section_id, document_id, rrf_score, reranker_score, business_rule_score, final_score, reason, text
    sections: DataFrame  # query_id, rank, section_id, document_id, title, path, page_start, page_end, text, matched_chunk_ids
    documents: DataFrame  # query_id and the columns of the documents that contribute


class Engine:
    """An index that is stated once and answers any number of requests.

    chunks: chunk_id, document_id, section_id, document_content_type,
    metadata_confidence, quality, text, index_text; vectors: doc_id (a chunk id)
    and vector.  score gives candidates (query_profile, chunk_profile, rrf_score,
    ...) a column model_score; null where the model failed."""

    def __init__(self, chunks: DataFrame, sections: DataFrame, documents: DataFrame, vectors: DataFrame, score: Callable[[DataFrame], DataFrame], dense_weight: float = 20.0, rule_weight: float = ranking.RULE_WEIGHT):
        self.chunks, self.sections, self.documents, self.vectors, self.score = chunks, sections, documents, vectors, score
        self.dense_weight, self.rule_weight = dense_weight, rule_weight
        self.index = lexical.build(chunks, "chunk_id", "text")

    def ready(self) -> bool:
        return bool(vector.violations(self.vectors).first()["ready"])

    def retrieve(self, requests: DataFrame, query_vectors: DataFrame) -> Response:
        """requests as for checked_requests(); query_vectors (query_id, vector)."""
        asked = checked_requests(requests)
        fused = fusion.rrf(vector.search(self.vectors, query_vectors, ROUTE_LIMIT), lexical.search(self.index, asked, ROUTE_LIMIT), dense_weight=self.dense_weight)
        fused = fused.select("query_id", F.col("doc_id").alias("chunk_id"), F.col("score").alias("rrf_score"), "rank").join(small(asked), "query_id").where(F.col("rank") <= F.col("top_chunks"))
        kept = self.chunks.select("chunk_id", "section_id", "document_id", "document_content_type", "metadata_confidence", F.col("quality.rag_text_status").alias("_status"), "text", "index_text").join(small(fused), "chunk_id")
        pair = profile_pair(F.col("question_type"), F.col("query"), F.col("query"), F.col("index_text"))
        kept = kept.withColumns({"pair": pair, "rule_score": ranking.rule_score(F.col("question_type"), F.col("document_content_type"), F.col("metadata_confidence"), F.col("_status")), "reason": ranking.rule_reason(F.col("question_type"), F.col("document_content_type"))})
        ranked = ranking.rerank(self.score(kept.select("*", "pair.*").drop("pair").withColumn("doc_id", F.col("chunk_id"))), self.rule_weight)
        six = lambda c: F.round(c, 6)
        chunks = ranked.select("query_id", F.col("final_rank").alias("rank"), "chunk_id", "section_id", "document_id", six("rrf_score").alias("rrf_score"), six("model_score").alias("reranker_score"), six("rule_score").alias("business_rule_score"), six("final_score").alias("final_score"), "reason", "text")
        rolled = ranking.section_rollup(chunks.select("query_id", "section_id", "chunk_id", "rank")).select("query_id", "section_id", F.col("section_rank").alias("rank"), F.col("chunk_ids").alias("matched_chunk_ids"))
        sections = self.sections.select("section_id", "document_id", "title", "path", "page_start", "page_end", "text").join(small(rolled), "section_id")
        documents = self.documents.join(small(chunks.select("query_id", "document_id").distinct()), "document_id")
        return Response(chunks, sections, documents)


def agent_payload(response: Response) -> DataFrame:
    """(query_id, evidence, sources): the text of each chunk of a known document
    with its section title and document, by rank, and the documents that have any."""
    about = ("filename", "content_type", "metadata_confidence")
    document = response.documents.select("query_id", "document_id", F.struct(*about).alias("document"))
    title = response.sections.select("query_id", "section_id", F.col("title").alias("section_title"))
    told = response.chunks.join(document, ["query_id", "document_id"]).join(title, ["query_id", "section_id"], "left")
    listed = F.array_sort(F.collect_list(F.struct("rank", F.struct("section_title", "text", "document").alias("e"))))  # TOP_CHUNKS at most
    return told.groupBy("query_id").agg(F.transform(listed, lambda x: x["e"]).alias("evidence"), F.array_sort(F.collect_set("document")).alias("sources"))
