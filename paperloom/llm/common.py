"""Helpers shared by the training-data operators.

Every operator selects the columns it needs first, so further columns of the
input (whatever their names) never reach it.
"""

from __future__ import annotations

import re
import tempfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the folder the cluster names in spark.checkpoint.dir.  Only on a local
    master, where all run on one machine, is one made if that is unset."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isDefined():
        return
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not re.match(r"local(\[|$)", sc.master):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="paperloom-checkpoint-"))


def materialize(df: DataFrame) -> DataFrame:
    """Compute once and cut lineage in the shared checkpoint folder, so a lost
    executor costs a re-read and not a recomputation."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def id_remainder(id_col: str, modulus: int) -> Column:
    """crc32 of the id's decimal text, modulo; null ids count as remainder 0."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % modulus, F.lit(0))


def texts_of(batch: pa.RecordBatch, column: str = "text") -> list[bytes | None]:
    """UTF-8 bytes of a string column, without decoding them."""
    return batch.column(batch.schema.get_field_index(column)).cast(pa.binary()).to_pylist()


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", max_bytes: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches so that the texts of each hold about max_bytes (a single
    longer text is a slice by itself): bounds a worker's memory."""
    import pyarrow.compute as pc

    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(column))), 0).to_pylist()
        start = total = 0
        for i, size in enumerate(sizes):
            if i > start and total + size > max_bytes:
                yield batch.slice(start, i - start)
                start, total = i, 0
            total += size
        yield batch.slice(start, n - start)


def few_rows(df: DataFrame, most: int = 1 << 14) -> DataFrame:
    """df, to be broadcast if it has at most `most` rows, which is looked up;
    else as it is, for Spark to join in its own way."""
    rows = df.limit(most + 1).collect()
    return F.broadcast(df.sparkSession.createDataFrame(rows, df.schema)) if len(rows) <= most else df


def thinned(rows: DataFrame, key: str, about: int, by: str | None = None, salt: str | None = None) -> DataFrame:
    """About `about` rows (of each value of `by`), the first by a hash of a key
    that differs between rows; rows with a null key are left out.  Two partial
    aggregations and a filter: no group meets in one task."""
    rows = rows.where(F.col(key).isNotNull())
    place = F.xxhash64(key, *([F.lit(salt)] if salt else [])).cast("double") / 2.0**64 + 0.5
    if by is None:
        n = rows.count()
        return rows.where(place * n <= about)
    sizes = few_rows(rows.groupBy(F.col(by).alias("_by")).agg(F.count("*").alias("_n")))  # a row for each label
    return rows.join(sizes, rows[by] == sizes["_by"]).where(place * F.col("_n") <= about).drop("_by", "_n")
