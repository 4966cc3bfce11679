"""The ingestion job: parsed pages to published sections and chunks.

Every stage is a plan over all documents at once and is written before the next
one reads it, so its time is its own and a lost executor repeats one stage.  A
document that cannot be taken (its id, or no page of it) is set apart with its
error and does not end the batch; what is published is whole or not at all.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom.functions.text import parse_guards, select_page
from paperloom.operators import chunking, cleaning, integrity, sections
from paperloom.schemas import DOCUMENT_ID
from paperloom.sources import io


class Settings(NamedTuple):
    chunk_size: int = chunking.SIZE
    chunk_overlap: int = chunking.OVERLAP
    replacement_threshold: float = 0.10
    dpi: int = 200
    ocr_language: str = "eng"
    pipeline_version: int = 4

    def checked(self) -> "Settings":
        if self.chunk_size <= 0 or not 0 <= self.chunk_overlap < self.chunk_size:
            raise ValueError("chunk_size must be positive and chunk_overlap less than it")
        parse_guards(self.replacement_threshold, self.dpi, self.ocr_language)
        return self


class Outcome(NamedTuple):
    version: str
    seconds: dict[str, float]
    statuses: DataFrame  # document_id, status, error


def run_stages(stages: list[tuple[str, Callable[[], DataFrame]]], folder: str, spark: SparkSession) -> tuple[dict[str, DataFrame], dict[str, float]]:
    """Each stage's table as written under folder, and its wall time."""
    tables: dict[str, DataFrame] = {}
    seconds: dict[str, float] = {}
    for name, stage in stages:
        began = time.monotonic()
        stage(tables).write.mode("overwrite").parquet(f"{folder}/{name}")
        tables[name] = spark.read.parquet(f"{folder}/{name}")
        seconds[name] = round(time.monotonic() - began, 4)
    return tables, seconds


def document_statuses(raw: DataFrame, expected: DataFrame | None = None) -> DataFrame:
    """(document_id, status, error) of every document of the raw pages, or that is
    expected: failed if its id is outside the domain or it has no page."""
    seen = raw.groupBy("document_id").agg(F.count("page").alias("_n"), F.min("ocr_error").alias("_error"))
    every = seen if expected is None else expected.select("document_id").distinct().join(seen, "document_id", "full_outer")
    bad_id = ~F.coalesce(F.col("document_id").rlike(DOCUMENT_ID), F.lit(False))
    error = F.when(bad_id, "not a document id").when(F.coalesce("_n", F.lit(0)) == 0, F.coalesce("_error", F.lit("no page was parsed")))
    return every.select("document_id", F.when(error.isNull(), "complete").otherwise("failed").alias("status"), error.alias("error"))


def ingest(spark: SparkSession, raw: DataFrame, work: str, out: str, settings: Settings = Settings(), profiles: DataFrame | None = None, geometry: DataFrame | None = None, table_pages: DataFrame | None = None, expected: DataFrame | None = None) -> Outcome:
    """raw: document_id, page, markdown_text, direct_text, ocr_text, ocr_error,
    toc_items.  Stage tables go to `work`, the published set to `out`.  If any
    document failed or any validation does, the earlier combined output is
    withdrawn, nothing new is published, and the error names the first case."""
    settings = settings.checked()
    statuses = document_statuses(raw, expected)
    good = statuses.where("status = 'complete'").select("document_id")

    def pages(_: dict[str, DataFrame]) -> DataFrame:
        chosen = select_page(settings.replacement_threshold, settings.ocr_language)
        parsing = F.struct(*[c.alias(n) for n, c in chosen.items() if n != "text"])
        return raw.where("page is not null").join(good, "document_id", "left_semi").select("document_id", "page", chosen["text"].alias("text"), "toc_items", parsing.alias("parsing"))

    def clean(t: dict[str, DataFrame]) -> DataFrame:
        done = cleaning.process_pages(t["pages"], geometry, table_pages)
        return done.withColumn("post_processing", F.struct("rag_text_status", "table_quality"))

    def chunks(t: dict[str, DataFrame]) -> DataFrame:
        made = chunking.chunk_sections(t["sections"], profiles, settings.chunk_size, settings.chunk_overlap).withColumn("source_sha256", F.lit(None).cast("string"))
        return made.withColumn("content_sha256", integrity.chunk_hash())

    stages = [("pages", pages), ("clean", clean), ("sections", lambda t: sections.split_sections(t["clean"]).withColumn("content_sha256", integrity.section_hash())), ("chunks", chunks), ("report", lambda t: cleaning.document_report(t["clean"]))]
    tables, seconds = run_stages(stages, work, spark)
    known = good.select("document_id")
    violations = integrity.violations(known, tables["sections"], tables["chunks"])
    combined = {n: tables[n].orderBy("document_id", k) for n, k in (("sections", "section_id"), ("chunks", "chunk_id"))}
    settings_hash = integrity.fingerprint(settings._asdict())
    state = known.select("document_id", F.lit("complete").alias("status"), F.lit(settings_hash).alias("pipeline_fingerprint"))
    version = io.publish_if_valid(combined | {"report": tables["report"]}, out, state, statuses, violations)
    return Outcome(version, seconds, statuses)
