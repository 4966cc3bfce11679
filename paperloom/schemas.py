"""Explicit schemas (DDL, as readers and createDataFrame take them) and value
domains of the data model."""

from __future__ import annotations

# Value domains: fixed values.
QUESTION_TYPES = ("principle", "diagnosis", "repair", "specification", "maintenance", "training", "competition", "general")
CONTENT_TYPES = ("technical_training", "repair_manual", "diagnostic_manual", "technical_article", "competition_file", "training_plan", "equipment_list", "official_news", "other")
COMPATIBILITIES = ("primary", "supporting", "none")
REQUEST_STATUSES = ("complete", "fallback", "error")
BAD_CASE_STATUSES = ("OPEN", "CONFIRMED", "FIXED")
ORDER_STATUSES = ("CONFIRMED", "CHECKED_IN", "COMPLETED", "CANCELLED")
DOCUMENT_ID = r"^(?:[A-Za-z0-9][A-Za-z0-9._-]{0,127})\z"


# Field names and order of the stored tables: fixed values.
TOC_ITEM = "level INT, title STRING, page INT"
PARSING = "status STRING, strategy STRING, fallback_reason STRING, markdown_replacement_ratio DOUBLE, direct_replacement_ratio DOUBLE, selected_replacement_ratio DOUBLE, ocr_used BOOLEAN, ocr_language STRING, ocr_error STRING"
RAW_PAGES = "document_id STRING, page INT, markdown_text STRING, direct_text STRING, ocr_text STRING, ocr_error STRING"
PAGES = f"document_id STRING, page INT, text STRING, toc_items ARRAY<STRUCT<{TOC_ITEM}>>, parsing STRUCT<{PARSING}>, post_processing STRUCT<rag_text_status STRING, table_quality STRING>"
QUALITY = "rag_text_status STRING, table_quality STRING"
BOUNDARY = "source STRING, confidence DOUBLE, page INT"
SECTIONS = f"document_id STRING, section_id STRING, title STRING, path ARRAY<STRING>, level INT, page_start INT, page_end INT, text STRING, subheadings ARRAY<STRING>, quality STRUCT<{QUALITY}>, boundary STRUCT<{BOUNDARY}>"
CHUNKS = (
    "chunk_id STRING, document_id STRING, document_content_type STRING, metadata_confidence DOUBLE, section_id STRING, section_title STRING, section_path ARRAY<STRING>, section_level INT, "
    f"section_page_start INT, section_page_end INT, chunk_index INT, subheading STRING, subheadings ARRAY<STRING>, text STRING, index_text STRING, quality STRUCT<{QUALITY}>, boundary STRUCT<{BOUNDARY}>, parser STRING, splitter STRING, source_sha256 STRING"
)
DOCUMENTS = (
    "id STRING, filename STRING, source_path STRING, source_sha256 STRING, content_type STRING, metadata_confidence DOUBLE, pipeline_version INT, pipeline_fingerprint STRING, artifact_sha256 STRING, hash_algorithm STRING, "
    "hash_verified_at TIMESTAMP, page_count INT, section_count INT, chunk_count INT, ingestion_status STRING, imported_at TIMESTAMP, updated_at TIMESTAMP"
)
MANIFEST = "pdf_id STRING, relative_path STRING, sha256 STRING, page_count INT, filename STRING"
INGEST_STATE = "document_id STRING, status STRING, source_sha256 STRING, pipeline_fingerprint STRING, artifacts ARRAY<STRING>"
SAMPLES = (
    "timestamp TIMESTAMP, status STRING, error_code STRING, total_seconds DOUBLE, stage_seconds MAP<STRING, DOUBLE>, candidate_count INT, fallback BOOLEAN, release_version STRING, question_type STRING, language STRING, document_type STRING, "
    "trace_id STRING, request_id STRING, code_version STRING, index_version STRING, model_version STRING, prompt_version STRING"
)
BAD_CASES = "key STRING, case_id STRING, trace_id STRING, failure_stage STRING, reason STRING, introduced_by_version STRING, status STRING, root_cause STRING, safety BOOLEAN, regression_case STRING, created_at TIMESTAMP, updated_at TIMESTAMP"
CASES = (
    "case_id STRING, case_kind STRING, language STRING, query STRING, question_type STRING, required_knowledge STRING, expected_document_id STRING, expected_section_id STRING, expected_title STRING, "
    "expected_path_contains ARRAY<STRING>, evidence_page_start INT, evidence_page_end INT, evidence_quote STRING, annotation_status STRING"
)
SLOT = "start TIMESTAMP, end TIMESTAMP"
RESOURCES = f"kind STRING, ord INT, id STRING, store_id STRING, type STRING, availability ARRAY<STRUCT<{SLOT}>>, abilities ARRAY<STRUCT<skill STRING, valid_from TIMESTAMP, valid_until TIMESTAMP>>"
TASKS = (
    "task_id STRING, brand STRING, store_id STRING, category STRING, powertrain STRING, duration_minutes INT, earliest_start TIMESTAMP, latest_end TIMESTAMP, required_skills ARRAY<STRING>, "
    "required_workstation_types ARRAY<STRING>, required_equipment_types ARRAY<STRING>, allowed_technician_ids ARRAY<STRING>"
)
RESERVATIONS = "resource_type STRING, resource_id STRING, start_time TIMESTAMP, end_time TIMESTAMP, task_id STRING, status STRING"
COMMANDS = (
    "command_id LONG, kind STRING, order_key STRING, idempotency_key STRING, actor_role STRING, technician_id STRING, workstation_id STRING, equipment_ids ARRAY<STRING>, start_time TIMESTAMP, end_time TIMESTAMP"
)
# Report containers: fixed values.
TABLE_QUALITY = "table_id STRING, quality STRING, rows INT, columns INT, empty_cell_ratio DOUBLE, fragmented_cell_ratio DOUBLE, reason STRING"
TABLE_CANDIDATE = "page INT, source STRING, bbox ARRAY<DOUBLE>, rows ARRAY<ARRAY<STRING>>, score DOUBLE, status STRING, column_consistency DOUBLE, empty_cell_ratio DOUBLE, short_cell_ratio DOUBLE, source_coverage DOUBLE, watermark_hit_rate DOUBLE, reason STRING"
PAGE_TABLES = "page INT, candidates INT, selected_status STRING, selected_source STRING, selected_score DOUBLE"
PAGE_REPORT = (
    "page INT, text_chars_before INT, text_chars_after INT, parser_status STRING, parser_strategy STRING, parser_fallback_reason STRING, replacement_character_ratio DOUBLE, ocr_used BOOLEAN, ocr_language STRING, ocr_error STRING, rag_text_status STRING, "
    "geometry_watermark_detected BOOLEAN, watermark_in_text BOOLEAN, image_internal_text_detected BOOLEAN, table_detected BOOLEAN, table_quality STRING, watermark_removed INT, geometry_watermark_removed INT, image_internal_text_removed INT, "
    f"table_count INT, low_quality_tables INT, tables ARRAY<STRUCT<{TABLE_QUALITY}>>, warnings ARRAY<STRING>, quality STRING"
)
DOCUMENT_REPORT = (
    "page_count INT, normal_pages INT, warning_pages INT, failed_pages INT, rag_pass_pages INT, rag_warning_pages INT, quarantine_pages INT, geometry_watermark_pages INT, watermark_in_text_pages INT, watermark_removed INT, geometry_watermark_removed INT, "
    f"image_internal_text_removed INT, table_count INT, low_quality_tables INT, parser_fallback_pages INT, ocr_pages INT, parser_failed_pages INT, warnings ARRAY<STRING>, pages ARRAY<STRUCT<{PAGE_REPORT}>>"
)
