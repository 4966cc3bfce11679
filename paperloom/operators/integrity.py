"""Content hashes, referential validation and incremental change sets."""

from __future__ import annotations

import hashlib
import json

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from paperloom.operators.sizing import mapped

BLOCK = 1024
ARTIFACTS = ("raw_pages", "clean_pages", "sections", "chunks", "table_report", "quality_report")


def canonical_json(payload: Column, sparse: tuple[str, ...] = (), empty: tuple[str, ...] = ()) -> Column:
    """JSON of a struct with sorted keys, no white space and characters as they
    are, nulls kept; fields of `sparse` lose their null members, fields of
    `empty` that are null are {}.  Key order and the form of numbers are not to
    be had from the built-in writer."""

    def one(text: str | None) -> str | None:
        if text is None:
            return None
        value = json.loads(text)
        for k in sparse:
            if isinstance(value.get(k), dict):
                value[k] = {m: x for m, x in value[k].items() if x is not None}
        value |= {k: {} for k in empty if value.get(k) is None}
        return json.dumps(value, ensure_ascii=False, sort_keys=True, separators=(",", ":"))

    @F.arrow_udf(StringType())
    def run(texts: pa.Array) -> pa.Array:
        return mapped(texts, one, pa.string())

    return run(F.to_json(payload, {"ignoreNullFields": "false"}))


def canonical_hash(*fields: str, sparse: tuple[str, ...] = (), empty: tuple[str, ...] = ()) -> Column:
    """SHA-256 of the canonical JSON of the named columns."""
    return F.sha2(canonical_json(F.struct(*fields), sparse, empty), 256)


_list = lambda c: F.coalesce(F.col(c), F.array().cast("array<string>")).alias(c)
_text = lambda c: F.coalesce(F.col(c), F.lit("")).alias(c)
#: Fields that take part in the stored hashes: fixed values.
DOCUMENT_FIELDS = ("id", "filename", "source_path", "source_sha256", "content_type", "metadata_confidence", "pipeline_version", "pipeline_fingerprint", "page_count", "section_count", "chunk_count")
HASH_ALGORITHM = "sha256"


def section_hash() -> Column:
    """Of a section's content, over the columns of schemas.SECTIONS."""
    payload = F.struct(F.col("section_id").alias("id"), "document_id", _text("title"), _list("path"), "level", "page_start", "page_end", _text("text"), _list("subheadings"), "quality", "boundary")
    return F.sha2(canonical_json(payload, ("boundary",), ("quality", "boundary")), 256)


def chunk_hash() -> Column:
    """Of a chunk's content, over the columns of schemas.CHUNKS."""
    plain = ["section_title", _list("section_path"), "section_level", "section_page_start", "section_page_end", "subheading", _list("subheadings"), _text("text")]
    index_text = F.coalesce(F.nullif("index_text", F.lit("")), F.col("text"), F.lit("")).alias("index_text")
    kind = F.coalesce(F.nullif("document_content_type", F.lit("")), F.lit("other")).alias("content_type")
    payload = F.struct(F.col("chunk_id").alias("id"), "document_id", "section_id", F.coalesce("chunk_index", F.lit(0)).alias("chunk_index"), kind, "metadata_confidence", *plain, index_text, "quality", "boundary", "parser", "splitter", "source_sha256")
    return F.sha2(canonical_json(payload, ("boundary",), ("quality", "boundary")), 256)


def document_hashes(documents: DataFrame, sections: DataFrame, chunks: DataFrame) -> DataFrame:
    """(id, sections, chunks, computed_sha256): of each document the numbers of
    its rows and the hash of its fields with the sorted (id, hash) pairs of its
    sections and chunks, which carry content_sha256."""
    def pairs(rows: DataFrame, id_col: str, name: str) -> DataFrame:
        listed = F.array_sort(F.collect_list(F.struct(F.col(id_col).alias("a"), F.col("content_sha256").alias("b"))))  # one document's rows
        return rows.groupBy(F.col("document_id").alias("id")).agg(F.transform(listed, lambda p: F.array(p["a"], p["b"])).alias(name))

    none = F.array().cast("array<array<string>>")
    both = documents.select(*DOCUMENT_FIELDS).join(pairs(sections, "section_id", "sections"), "id", "left").join(pairs(chunks, "chunk_id", "chunks"), "id", "left")
    both = both.withColumns({c: F.coalesce(c, none) for c in ("sections", "chunks")})
    return both.select("id", F.size("sections").alias("n_sections"), F.size("chunks").alias("n_chunks"), canonical_hash(*DOCUMENT_FIELDS, "sections", "chunks").alias("computed_sha256"))


def verify_store(documents: DataFrame, sections: DataFrame, chunks: DataFrame) -> DataFrame:
    """(violation, key) of everything whose stored hash or count is not that of
    its content; no rows: the store is whole."""
    now_s, now_c = sections.withColumn("_now", section_hash()), chunks.withColumn("_now", chunk_hash())
    fresh = document_hashes(documents, now_s.withColumn("content_sha256", F.col("_now")), now_c.withColumn("content_sha256", F.col("_now")))
    d = documents.select("id", "artifact_sha256", "hash_algorithm", "section_count", "chunk_count").join(fresh, "id")
    differs = lambda a, b: ~F.col(a).eqNullSafe(F.col(b))
    parts = [
        _named(d.where(~F.col("hash_algorithm").eqNullSafe(F.lit(HASH_ALGORITHM)) | F.col("artifact_sha256").isNull()), "no_active_hash", "id"), _named(now_s.where(differs("content_sha256", "_now")), "section_hash_mismatch", "section_id"),
        _named(now_c.where(differs("content_sha256", "_now")), "chunk_hash_mismatch", "chunk_id"), _named(d.where(differs("section_count", "n_sections") | differs("chunk_count", "n_chunks")), "count_mismatch", "id"),
        _named(d.where(differs("artifact_sha256", "computed_sha256")), "document_hash_mismatch", "id"),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def to_import(stored: DataFrame, incoming: DataFrame, broken: DataFrame) -> DataFrame:
    """(id, change) of incoming (id, artifact_sha256): imported where the stored
    hash differs or is missing, or is equal but its document is in `broken`
    (id), as verification found it; else skipped."""
    was = stored.select("id", F.col("artifact_sha256").alias("_was")).dropDuplicates(["id"])
    bad = broken.select("id").distinct().withColumn("_bad", F.lit(True))
    keep = F.col("_was").eqNullSafe(F.col("artifact_sha256")) & F.col("_bad").isNull()
    return incoming.join(was, "id", "left").join(bad, "id", "left").select("id", F.when(keep, "skipped").otherwise("imported").alias("change"))


def _digest(pairs: Column) -> Column:
    return F.sha2(F.array_join(F.transform(pairs, lambda p: F.concat_ws(":", p["i"].cast("string"), p["h"])), ","), 256)


def merkle(rows: DataFrame, key: str, id_col: str, hash_col: str, block: Column, out: str = "merkle_sha256") -> DataFrame:
    """Two levels of hashes: of the sorted (id, hash) list of each block of a
    key, then of the sorted (block, hash) list.  A key of any size is grouped a
    block at a time; a block holds as many ids as `block` gives it."""
    listed = lambda a, b: F.array_sort(F.collect_list(F.struct(F.col(a).alias("i"), F.col(b).alias("h"))))
    leaves = rows.withColumn("_b", block).groupBy(key, "_b").agg(F.count("*").alias("_n"), _digest(listed(id_col, hash_col)).alias("_h"))
    return leaves.groupBy(key).agg(F.sum("_n").alias("n"), _digest(listed("_b", "_h")).alias(out))


def fingerprint(settings: dict) -> str:
    """Of a pipeline's settings, at planning time."""
    return hashlib.sha256(json.dumps(settings, sort_keys=True, separators=(",", ":"), ensure_ascii=False).encode()).hexdigest()


def valid_sha256(value: Column) -> Column:
    return F.coalesce(value, F.lit("")).rlike(r"^[0-9a-f]{64}\z")


def inconsistent(rows: DataFrame, key: str, value: str) -> DataFrame:
    """Keys with more than one distinct non-null value."""
    return rows.groupBy(key).agg(F.countDistinct(value).alias("n")).where("n > 1")


def _named(df: DataFrame, kind: str, key: str | Column) -> DataFrame:
    return df.select(F.lit(kind).alias("violation"), (F.col(key) if isinstance(key, str) else key).cast("string").alias("key"))


def violations(documents: DataFrame, sections: DataFrame, chunks: DataFrame) -> DataFrame:
    """All of a batch: (violation, key).  Repeated ids, unknown parents, ids
    outside their document's namespace, chunks under another document than
    their section, and documents without sections or chunks."""
    repeated = lambda d, c: d.groupBy(c).count().where("count > 1")
    sec = sections.select("section_id", F.col("document_id").alias("_doc")).dropDuplicates(["section_id"])
    parent = chunks.join(sec, "section_id", "left")
    outside = lambda d, c, p: d.where(~F.startswith(F.col(c), F.concat(F.col(p), F.lit(":"))))
    parts = [
        _named(repeated(sections, "section_id"), "repeated_section", "section_id"), _named(repeated(chunks, "chunk_id"), "repeated_chunk", "chunk_id"),
        _named(parent.where("_doc is null"), "unknown_section", "chunk_id"), _named(parent.where("_doc != document_id"), "other_document", "chunk_id"),
        _named(outside(sections, "section_id", "document_id"), "section_namespace", "section_id"), _named(outside(chunks, "chunk_id", "section_id"), "chunk_namespace", "chunk_id"),
        _named(sections.join(documents, "document_id", "left_anti"), "unknown_document", "section_id"),
        _named(documents.join(sections, "document_id", "left_anti"), "document_without_sections", "document_id"), _named(documents.join(chunks, "document_id", "left_anti"), "document_without_chunks", "document_id"),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def damaged_chunks(chunks: DataFrame) -> DataFrame:
    return chunks.agg(F.count_if(F.contains("text", F.lit("�"))).alias("replacement_character_chunks"))


def assert_valid(found: DataFrame) -> None:
    first = found.orderBy("violation", "key").take(1)
    if first:
        raise ValueError(f"{first[0]['violation']}: {first[0]['key']}")


def to_ingest(manifest: DataFrame, state: DataFrame, fingerprint_: str) -> DataFrame:
    """Manifest rows without a complete state of the same source, settings and
    all artifacts."""
    done = state.where((F.col("status") == "complete") & (F.col("pipeline_fingerprint") == fingerprint_) & (F.size(F.array_except(F.array(*map(F.lit, ARTIFACTS)), "artifacts")) == 0))
    return manifest.join(done.select(F.col("document_id").alias("pdf_id"), F.col("source_sha256").alias("sha256")), ["pdf_id", "sha256"], "left_anti")


def changes(stored: DataFrame, incoming: DataFrame, key: str = "document_id", hash_col: str = "artifact_sha256") -> DataFrame:
    """(key, change): added, changed, unchanged or removed."""
    a, b = stored.select(key, F.col(hash_col).alias("_was")), incoming.select(key, F.col(hash_col).alias("_is"))
    change = F.when(F.col("_was").isNull(), "added").when(F.col("_is").isNull(), "removed").when(F.col("_was") == F.col("_is"), "unchanged").otherwise("changed")
    return a.join(b, key, "full_outer").select(key, change.alias("change"))


def replace_documents(stored: DataFrame, incoming: DataFrame, key: str = "document_id") -> DataFrame:
    """Stored rows of other documents, and all incoming rows."""
    return stored.join(incoming.select(key).distinct(), key, "left_anti").unionByName(incoming)


def verify(stored: DataFrame, id_col: str, fields: tuple[str, ...], hash_col: str = "content_sha256") -> DataFrame:
    """Rows whose stored hash is not that of their content."""
    return stored.withColumn("_now", canonical_hash(*fields)).where(~F.col("_now").eqNullSafe(F.col(hash_col))).select(id_col, hash_col, F.col("_now").alias("computed_sha256"))


def page_count(sections: DataFrame, chunks: DataFrame) -> DataFrame:
    last = lambda d, a, b: d.select("document_id", F.greatest(a, b).alias("p"))
    return last(sections, "page_start", "page_end").unionByName(last(chunks, "section_page_start", "section_page_end")).groupBy("document_id").agg(F.coalesce(F.max("p"), F.lit(0)).alias("page_count"))


def id_collisions(rows: DataFrame, id_col: str) -> DataFrame:
    """One row: ids shared by several records, and the records beyond the first."""
    return rows.groupBy(id_col).count().where("count > 1").agg(F.count("*").alias("collision_keys"), F.coalesce(F.sum(F.col("count") - 1), F.lit(0)).alias("extra_records"))


def exact_duplicates(rows: DataFrame, id_col: str, hash_col: str) -> DataFrame:
    return rows.groupBy(hash_col).agg(F.count("*").alias("copies"), F.min(id_col).alias("first_id")).where("copies > 1")


def default_profile(document_id: Column) -> Column:
    return F.struct(F.when(document_id == "PDF-001", "official_news").otherwise("technical_training").alias("content_type"), F.lit(0.95).alias("metadata_confidence"))
