"""Runtime health over a stream of samples.  An extension: nothing here has a
batch counterpart with other semantics, and windows are by event time."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom.operators import monitoring
from paperloom.schemas import SAMPLES

LATE = "10 minutes"


def read_samples(spark: SparkSession, folder: str) -> DataFrame:
    """JSON lines appended to a folder, with the declared schema."""
    return spark.readStream.schema(SAMPLES).json(folder)


def _health(extra: list[Column] | None = None) -> list[Column]:
    rate = lambda c: F.round(F.count_if(c) / F.greatest(F.count("*"), F.lit(1)), 6)
    return [F.count("*").alias("requests"), rate(F.col("status") == "complete").alias("success_rate"), rate(F.col("fallback")).alias("fallback_rate"), rate(F.col("error_code") == "TIMEOUT").alias("timeout_rate"), F.round(F.avg("total_seconds"), 6).alias("mean_seconds"), *(extra or [])]


def tumbling(samples: DataFrame, width: str = "1 hour", slide: str | None = None, late: str = LATE) -> DataFrame:
    """Health per window; works on a stream and on a table."""
    w = F.window("timestamp", width, slide) if slide else F.window("timestamp", width)
    marked = samples.withWatermark("timestamp", late) if samples.isStreaming else samples
    out = marked.groupBy(w.alias("w")).agg(*_health())
    return out.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), *[c for c in out.columns if c != "w"])


def sessions(samples: DataFrame, key: str, gap: str = "30 minutes", late: str = LATE) -> DataFrame:
    marked = samples.withWatermark("timestamp", late) if samples.isStreaming else samples
    out = marked.groupBy(key, F.session_window("timestamp", gap).alias("w")).agg(*_health())
    return out.select(key, F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), *[c for c in out.columns if c not in (key, "w")])


def online_percentiles(samples: DataFrame, width: str = "1 hour", accuracy: int = 10000, late: str = LATE) -> DataFrame:
    """Approximate p50 and p95 per window, which a stream can keep."""
    marked = samples.withWatermark("timestamp", late) if samples.isStreaming else samples
    p = lambda q, n: F.percentile_approx("total_seconds", F.lit(q), accuracy).alias(n)
    return marked.groupBy(F.window("timestamp", width).alias("w")).agg(p(0.5, "p50"), p(0.95, "p95")).select(F.col("w.start").alias("window_start"), "p50", "p95")


def upsert_bad_cases(found: DataFrame, load: Callable[[], DataFrame], save: Callable[[DataFrame, int], None], checkpoint: str):
    """Each micro-batch merged into the stored cases; save() gets the batch
    number, so that a repeated batch can overwrite its own output."""

    def merge(batch: DataFrame, number: int) -> None:
        save(monitoring.upsert_bad_cases(load(), batch, F.current_timestamp()), number)

    return found.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint)
