"""Readers and writers with explicit schemas.

Writers publish by a marker: data goes to a folder of its own first and a state
row is written last; readers only take folders whose state is complete.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from paperloom import schemas
from paperloom.operators import integrity, monitoring


def read_array(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A JSON array of objects; anything else fails."""
    return spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").json(path)


def read_tolerant(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Objects that parse; a missing or corrupt file has no rows."""
    try:
        whole = spark.read.option("wholetext", True).text(path)
        parsed = whole.select(F.from_json("value", f"{schema}, _corrupt STRING", {"columnNameOfCorruptRecord": "_corrupt"}).alias("x"))
        return parsed.where("x is not null and x._corrupt is null").select("x.*").drop("_corrupt")
    except Exception as e:
        if "PATH_NOT_FOUND" in str(e):
            return spark.createDataFrame([], schema)
        raise


def read_manifest(spark: SparkSession, path: str, offset: int = 0, limit: int | None = None) -> DataFrame:
    """Manifest entries offset .. offset + limit in file order, with their place."""
    if offset < 0 or limit is not None and limit <= 0:
        raise ValueError("offset must not be negative and limit must be positive")
    rows = spark.read.option("multiLine", True).option("wholetext", True).text(path).select(F.posexplode(F.from_json("value", f"array<struct<{schemas.MANIFEST.replace(' STRING', ': string').replace(' INT', ': int')}>>")).alias("ord", "m"))
    kept = rows.where(F.col("ord") >= offset) if limit is None else rows.where(F.col("ord").between(offset, offset + limit - 1))
    escape = F.col("m.relative_path").startswith("/") | F.array_contains(F.split("m.relative_path", r"[/\\]"), "..")
    return kept.where(F.assert_true(~F.coalesce(escape, F.lit(False)), F.concat(F.lit("path leaves the corpus: "), F.coalesce("m.relative_path", F.lit("")))).isNull()).select("ord", "m.*")


def read_manifest_csv(spark: SparkSession, path: str) -> DataFrame:
    """UTF-8 with or without a byte-order mark."""
    df = spark.read.option("header", True).csv(path)
    return df.toDF(*[c.removeprefix("﻿") for c in df.columns])


def audit_files(manifest: DataFrame, files: DataFrame, base: str, pages: DataFrame | None = None) -> DataFrame:
    """manifest (relative_path, sha256, page_count) against binaryFile rows under
    the folder base: missing files, wrong signatures or hashes, content that
    several entries share, and, with pages (relative_path, n_pages), wrong
    numbers of pages."""
    relative = F.regexp_replace(F.substring_index("path", base.rstrip("/").removeprefix("file:") + "/", -1), "^/+", "")
    content = files.select(relative.alias("relative_path"), F.sha2("content", 256).alias("_sha"), (F.substring(F.col("content"), 1, 5) == F.lit(b"%PDF-")).alias("_signed"))
    joined = manifest.join(content, "relative_path", "left")
    shared = joined.where("_sha is not null").groupBy("_sha").agg(F.count("*").alias("_same"))
    joined = joined.join(shared, "_sha", "left")
    counted = F.lit(False)
    if pages is not None:
        joined = joined.join(pages.select("relative_path", F.col("n_pages").alias("_pages")), "relative_path", "left")
        counted = F.coalesce(F.col("_pages") != F.col("page_count"), F.lit(False))
    problems = F.array_compact(F.array(F.when(F.col("_sha").isNull(), "missing"), F.when(~F.col("_signed"), "bad_signature"), F.when(F.col("_sha") != F.col("sha256"), "hash_mismatch"), F.when(F.col("_same") > 1, "duplicate_content"), F.when(counted, "page_count_mismatch")))
    return joined.select("relative_path", problems.alias("problems"))


def file_versions(files: DataFrame) -> DataFrame:
    """(path, sha256, version): the content's hash and its first 16 characters."""
    return files.select("path", F.sha2("content", 256).alias("sha256")).withColumn("version", F.substring("sha256", 1, 16))


def read_metadata(spark: SparkSession, path: str) -> DataFrame:
    """Document metadata: an array, or an object that holds it as `selection` or
    `documents`; of several entries for an id the last counts."""
    entry = "struct<document_id:string,pdf_id:string,filename:string,relative_path:string,content_type:string,metadata_confidence:double>"
    whole = spark.read.option("wholetext", True).text(path)
    body = F.coalesce(F.get_json_object("value", "$.selection"), F.get_json_object("value", "$.documents"), F.col("value"))
    listed = F.from_json(body, f"array<{entry}>")
    rows = whole.select(F.posexplode(listed).alias("ord", "e")).select("ord", "e.*").withColumn("document_id", F.coalesce("document_id", "pdf_id")).where("document_id is not null")
    last = F.row_number().over(Window.partitionBy("document_id").orderBy(F.desc("ord")))
    return rows.withColumn("_k", last).where("_k = 1").drop("_k", "ord", "pdf_id")


def read_samples(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines; blank lines are skipped."""
    return spark.read.schema(schemas.SAMPLES).json(path).where("status is not null")


def read_cases(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Cases of one or several shards, with their place in their file as _ord,
    from 1."""
    fields = ", ".join("{}: {}".format(*c.strip().split(" ", 1)) for c in schemas.CASES.split(", "))
    whole = spark.read.option("wholetext", True).text(paths)
    listed = F.from_json("value", f"array<struct<{fields}>>", {"mode": "FAILFAST"})
    return whole.select(F.posexplode(listed).alias("_at", "c")).select("c.*", (F.col("_at") + 1).alias("_ord"))


def read_shards(spark: SparkSession, paths: list[str], expected: int = 4) -> DataFrame:
    """Annotated cases of exactly `expected` shards."""
    if len(paths) != expected:
        raise ValueError(f"{expected} shards are needed, not {len(paths)}")
    return read_cases(spark, paths)


def read_table(spark: SparkSession, path: str, defaults: dict[str, Column] | None = None) -> DataFrame:
    """Parquet of any age: columns are merged, and missing values defaulted."""
    df = spark.read.option("mergeSchema", True).parquet(path)
    for name, value in (defaults or {}).items():
        df = df.withColumn(name, F.coalesce(name, value) if name in df.columns else value)
    return df


def read_jdbc(spark: SparkSession, url: str, table: str, **options: str) -> DataFrame:
    return spark.read.format("jdbc").options(url=url, dbtable=table, **options).load()


def parse_files(files: DataFrame, parser: Callable[[str, bytes], list[dict]], schema: str = schemas.RAW_PAGES) -> DataFrame:
    """Pages from binaryFile rows by any parser of (path, content); a file that
    fails gives one row with its error and no page."""
    names = [c.strip().split(" ")[0] for c in schema.split(",")]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for path, content in zip(frame["path"], frame["content"], strict=True):
                try:
                    rows += parser(path, content)
                except Exception as e:  # one document must not end the batch
                    rows.append({"document_id": path, "page": None, "ocr_error": f"{type(e).__name__}: {e}"[:240]})
            out = pd.DataFrame(rows, columns=names).astype(object)
            yield out.where(out.notna(), None)

    return files.select("path", "content").mapInPandas(run, schema)


def withdraw(folder: str, spark: SparkSession) -> None:
    """No version counts as published any more; a missing folder is fine."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/_state")
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def replace_file(text: str, path: str, spark: SparkSession) -> None:
    """A small file (a report, say) written beside its place and then renamed over it."""
    target, beside = (spark._jvm.org.apache.hadoop.fs.Path(p) for p in (path, f"{path}.{uuid.uuid4().hex}.tmp"))
    fs = target.getFileSystem(spark._jsc.hadoopConfiguration())
    out = fs.create(beside, True)
    try:
        out.write(bytearray(text.encode("utf-8")))
        out.hsync()
    finally:
        out.close()
    fs.delete(target, False)
    if not fs.rename(beside, target):
        raise OSError(f"{path} could not be replaced")


def write_json(df: DataFrame, folder: str) -> None:
    """One JSON object a line, nulls kept."""
    df.select(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias("value")).write.mode("overwrite").text(folder)


def write_markdown(df: DataFrame, folder: str) -> None:
    """A Markdown table in order of the first column, in one file: for reports."""
    cell = lambda c: F.regexp_replace(F.coalesce(F.col(c).cast("string"), F.lit("")), r"[|\r\n]", " ")
    line = F.concat(F.lit("| "), F.concat_ws(" | ", *[cell(c) for c in df.columns]), F.lit(" |"))
    head = df.sparkSession.createDataFrame([(0, "| " + " | ".join(df.columns) + " |"), (1, "|" + "---|" * len(df.columns))], "k int, value string")
    rows = df.select(F.lit(2).alias("k"), line.alias("value"), F.col(df.columns[0]).cast("string").alias("o"))
    head.withColumn("o", F.lit(None).cast("string")).unionByName(rows).coalesce(1).sortWithinPartitions("k", "o").select("value").write.mode("overwrite").text(folder)


def publish(tables: dict[str, DataFrame], folder: str, state: DataFrame) -> str:
    """Each table into a fresh folder, then the state as the last step."""
    version = uuid.uuid4().hex
    for name, df in tables.items():
        df.write.parquet(f"{folder}/{version}/{name}")
    state.withColumn("version", F.lit(version)).write.mode("append").parquet(f"{folder}/_state")
    return version


def published(spark: SparkSession, folder: str, name: str, version: str) -> DataFrame:
    done = spark.read.parquet(f"{folder}/_state").where((F.col("version") == version) & (F.col("status") == "complete"))
    if not done.take(1):
        raise ValueError(f"version {version} was not published")
    return spark.read.parquet(f"{folder}/{version}/{name}")


def publish_if_valid(tables: dict[str, DataFrame], folder: str, state: DataFrame, statuses: DataFrame, violations: DataFrame) -> str:
    """Nothing is written unless every document is done and nothing is violated;
    what was published before is withdrawn first, so a failed batch leaves no
    combined output that looks current."""
    withdraw(folder, state.sparkSession)
    failed = statuses.where("status not in ('complete', 'skipped')").take(1)
    if failed:
        raise ValueError(f"document {failed[0]['document_id']} failed")
    integrity.assert_valid(violations)
    return publish(tables, folder, state)


def replace_partitions(df: DataFrame, folder: str, key: str = "document_id") -> None:
    """Only the partitions of the documents in df are overwritten."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(key).parquet(folder)


def with_embeddings(chunks: DataFrame, embeddings: DataFrame, model: str) -> DataFrame:
    """chunks with the vectors of embeddings (chunk_id, vector); unknown or
    repeated chunk ids are an error."""
    unknown = embeddings.join(chunks.select("chunk_id"), "chunk_id", "left_anti").select(F.lit("unknown_chunk").alias("violation"), F.col("chunk_id").alias("key"))
    twice = embeddings.groupBy("chunk_id").count().where("count > 1").select(F.lit("repeated_chunk").alias("violation"), F.col("chunk_id").alias("key"))
    integrity.assert_valid(unknown.unionByName(twice))
    new = embeddings.select("chunk_id", F.col("vector").alias("_v"))
    joined = chunks.join(new, "chunk_id", "left")
    old = F.col("embedding") if "embedding" in chunks.columns else F.lit(None).cast("array<float>")
    return joined.withColumn("embedding", F.coalesce("_v", old)).withColumn("embedding_model", F.when(F.col("_v").isNotNull(), model).otherwise(F.col("embedding_model") if "embedding_model" in chunks.columns else F.lit(None))).withColumn("embedding_dimension", F.size("embedding")).drop("_v")


def append_samples(raw: DataFrame, folder: str) -> None:
    """Allowed keys only; unknown statuses fail; a missing time is now."""
    allowed = tuple(c.strip().split(" ")[0] for c in schemas.SAMPLES.replace("MAP<STRING, DOUBLE>", "MAP").split(","))
    monitoring.recordable(raw, F.current_timestamp(), allowed).write.mode("append").json(folder)


def sync_dataset(stored: DataFrame, cases: DataFrame, key: str = "case_id") -> DataFrame:
    """Stored and given cases merged, with action created, updated, unchanged or
    kept; payload is everything but the key."""
    body = lambda d: F.to_json(F.struct(*[c for c in sorted(d.columns) if c != key]))
    a, b = stored.select(key, body(stored).alias("_was")), cases.select(key, body(cases).alias("_is"))
    action = F.when(F.col("_was").isNull(), "created").when(F.col("_is").isNull(), "kept").when(F.col("_was") == F.col("_is"), "unchanged").otherwise("updated")
    return a.join(b, key, "full_outer").select(key, action.alias("action"), F.coalesce("_is", "_was").alias("payload"))
