"""Connected components by alternating large-star and small-star steps.

Edges stay distributed; each round is written to the shared checkpoint folder.
The number of rounds grows with the logarithm of the component sizes.  All
grouping is by partial aggregation and joins with a unique side, so a vertex
with very many edges is split like any skewed join.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperloom.llm.common import materialize


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """edges (u, v) of longs -> (vertex, root) for every vertex of an edge other
    than the roots themselves; root is the smallest vertex of the component."""
    pairs = edges.where("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    pairs, was = _settled(pairs)
    for _ in range(max_rounds):
        pairs, now = _settled(_small_star(_large_star(pairs)))
        if now == was:
            return pairs.select(F.col("u").alias("vertex"), F.col("v").alias("root"))
        was = now
    raise RuntimeError("components did not settle")


def _settled(pairs: DataFrame) -> tuple[DataFrame, tuple]:
    pairs = materialize(pairs)
    row = pairs.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x"), F.sum(F.xxhash64("v", "u").cast("decimal(38,0)")).alias("s")).first()
    return pairs, tuple(row)


def _large_star(pairs: DataFrame) -> DataFrame:
    both = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(pairs: DataFrame) -> DataFrame:
    least = pairs.groupBy("u").agg(F.min("v").alias("m"))
    moved = pairs.join(least, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct()
