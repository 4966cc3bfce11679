"""Exact dense search and vector columns."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, FloatType

from paperloom.operators import topk
from paperloom.operators.sizing import BROADCAST_BYTES
from paperloom.operators.topk import ranked


def dot(a: Column, b: Column) -> Column:
    """In double precision."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def normalised(v: Column) -> Column:
    norm = F.sqrt(dot(v, v))
    return F.transform(v, lambda x: x.cast("double") / F.when(norm > 0, norm).otherwise(F.lit(1.0)))


def search(vectors: DataFrame, queries: DataFrame, k: int = 50, digits: int = 6) -> DataFrame:
    """vectors (doc_id, vector) x queries (query_id, vector) -> (query_id,
    doc_id, score, rank).  The stated queries go to every partition of the
    vectors once, which keeps the k best of each; those of more than
    BROADCAST_BYTES in blocks of it."""
    n, width = queries.agg(F.count("*"), F.coalesce(F.max(F.size("vector")), F.lit(0))).first()
    blocks = max(1, -(-n * (8 * width + 32) // BROADCAST_BYTES))
    rows, out = vectors.select("doc_id", "vector"), None
    for i in range(blocks):
        asked = queries.select("query_id", "vector").where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == i).collect()
        part = topk.search(rows, queries.schema["query_id"], [q["query_id"] for q in asked], _scorer([q["vector"] for q in asked], digits), k)
        out = part if out is None else out.unionByName(part)
    return ranked(out, k)


def _scorer(asked: list[list[float] | None], digits: int):
    """Dot products of stored vectors and those asked for; -inf, for null, where
    either is missing, has a missing number, or their lengths differ."""
    whole = [v is not None and None not in v for v in asked]
    sides = {w: [i for i, v in enumerate(asked) if whole[i] and len(v) == w] for w in {len(v) for v, good in zip(asked, whole, strict=True) if good}}
    matrices = {w: np.array([asked[i] for i in at], np.float64).reshape(len(at), w).T for w, at in sides.items()}
    step = max(1, topk.CELLS // max(1, len(asked)))

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            for start in range(0, batch.num_rows, step):
                held, items = batch.column("vector").slice(start, step), batch.column("doc_id").slice(start, step)
                length = pc.fill_null(pc.list_value_length(held), -1).to_numpy(zero_copy_only=False)
                flat = held.flatten()
                numbers = flat.cast(pa.float64()).to_numpy(zero_copy_only=False)
                first = np.cumsum(np.maximum(length, 0)) - np.maximum(length, 0)
                if flat.null_count:
                    gaps = np.concatenate([[0], np.cumsum(flat.is_null().to_numpy(zero_copy_only=False))])
                    length = np.where(gaps[first + np.maximum(length, 0)] > gaps[first], -1, length)
                scores = np.full((len(held), len(asked)), -np.inf)
                for w, at in sides.items():
                    rows = np.nonzero(length == w)[0]
                    with np.errstate(all="ignore"):
                        scores[np.ix_(rows, at)] = topk.rounded(numbers[first[rows][:, None] + np.arange(w)] @ matrices[w], digits)
                yield scores, items

    return run


def violations(vectors: DataFrame) -> DataFrame:
    """One row: rows, missing vectors, distinct dimensions; usable if rows and
    dimensions are as wanted."""
    return vectors.agg(F.count("*").alias("n"), F.count_if(F.col("vector").isNull()).alias("missing"), F.countDistinct(F.size("vector")).alias("dimensions"), F.coalesce(F.min(F.size("vector")), F.lit(0)).alias("dimension")).withColumn(
        "ready", (F.col("n") > 0) & (F.col("missing") == 0) & (F.col("dimensions") == 1) & (F.col("dimension") > 0)
    )


@F.pandas_udf(BinaryType())
def pack_f32(vectors: pd.Series) -> pd.Series:
    """Little-endian 32-bit floats."""
    return vectors.map(lambda v: None if v is None else np.asarray(v, "<f4").tobytes())


@F.pandas_udf(ArrayType(FloatType()))
def unpack_f32(blobs: pd.Series) -> pd.Series:
    return blobs.map(lambda b: None if b is None else np.frombuffer(b, "<f4"))


def embed(df: DataFrame, text_col: str, model: Callable[[list[str]], np.ndarray], batch: int = 8, out: str = "vector") -> DataFrame:
    """A vector column from any model that maps texts to rows, L2-normalised."""

    @F.pandas_udf("array<float>")
    def run(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for series in texts:
            values = series.fillna("").tolist()
            rows = [np.asarray(model(values[i : i + batch]), np.float64) for i in range(0, len(values), batch)]
            x = np.concatenate(rows) if rows else np.zeros((0, 1))
            norm = np.linalg.norm(x, axis=1, keepdims=True)
            yield pd.Series(list((x / np.where(norm > 0, norm, 1)).astype(np.float32)))

    return df.withColumn(out, run(F.col(text_col)))
