"""Name -> query and name -> SQL of every registered query."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from paperloom.plans import documents, operations, retrieval

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {**retrieval.QUERIES, **operations.QUERIES, **documents.QUERIES}
ORACLES: dict[str, str] = {**retrieval.ORACLES, **operations.ORACLES, **documents.ORACLES}
