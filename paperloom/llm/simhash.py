"""SimHash near-duplicate detection by pigeonhole blocks.

Fingerprints are computed in one Arrow pass.  Equal fingerprints are one vertex,
so copies never multiply.  The 64 bits are split into five blocks: fingerprints
that differ in at most two bits agree on at least three whole blocks, so the
rows are keyed by each of the ten choices of three blocks, joined on that key
and verified by Hamming distance.  A key shared by many different fingerprints
(a large group of near copies) is not joined with itself: fingerprints at
distance two or less share a value at distance one or less from both, so each
member emits itself and its 64 one-bit neighbours, and all that meet in one
value (65 at most) are linked to the smallest of them.  Both ways are exact.

Null and word-free texts have fingerprint zero and are linked like any other.
A null id never becomes a component id unless every id in the component is null.
Repeated rows stay repeated rows.  An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperloom.llm.common import materialize, slices, texts_of
from paperloom.llm.components import connected_components

SEED = 42
SHINGLE = 3
BLOCKS = (13, 13, 13, 13, 12)
MAX_DISTANCE = 2
#: Keys with more distinct fingerprints than this take the neighbour path.
BUCKET = 48


def fingerprint(text: bytes | None, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """The unsigned 64-bit fingerprint of one UTF-8 text."""
    words = text.lower().split() if text else []
    if not words:
        return 0
    norm = b" ".join(words)
    h = xxhash.xxh64_intdigest
    if len(words) <= shingle:
        values = [h(norm, seed)]
    else:
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        ends = np.cumsum(lengths + 1) - 1
        starts = ends - lengths
        values = [h(norm[a:b], seed) for a, b in zip(starts.tolist(), ends[shingle - 1 :].tolist(), strict=False)]
    counts = np.zeros(64, np.int64)
    hashes = np.array(values, dtype=">u8").view(np.uint8).reshape(-1, 8)
    for i in range(0, len(hashes), 1 << 15):
        counts += np.unpackbits(hashes[i : i + (1 << 15)], axis=1).sum(axis=0, dtype=np.int32)
    return int.from_bytes(np.packbits(counts * 2 > len(values)).tobytes(), "big")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp): the fingerprint as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            values = np.array([fingerprint(t) for t in texts_of(batch)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(values)], names=["doc_id", "fp"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, fp long")


def block_masks(blocks: tuple[int, ...] = BLOCKS, max_distance: int = MAX_DISTANCE) -> list[int]:
    """Masks of the block choices of which close pairs agree on one at least,
    as signed longs."""
    masks, at = [], 0
    for width in blocks:
        masks.append(((1 << width) - 1) << at)
        at += width
    chosen = [sum(c) for c in combinations(masks, len(blocks) - max_distance)]
    return [m - (1 << 64) if m >> 63 else m for m in chosen]


def links(distinct_fps: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """(u, v), u > v: enough pairs of different fingerprints at distance two or
    less that their components are those of all such pairs."""
    masks = F.array(*[F.struct(F.lit(i).alias("m"), F.col("fp").bitwiseAND(F.lit(m)).alias("k")) for i, m in enumerate(block_masks())])
    keyed = distinct_fps.select("fp", F.explode(masks).alias("b")).select("fp", "b.m", "b.k")
    sizes = keyed.groupBy("m", "k").agg(F.count("*").alias("n")).where("n > 1")
    keyed = materialize(keyed.join(sizes, ["m", "k"]))
    small = keyed.where(F.col("n") <= bucket).select("m", "k", "fp")
    other = small.select("m", "k", F.col("fp").alias("v"))
    close = F.bit_count(F.col("fp").bitwiseXOR(F.col("v"))) <= MAX_DISTANCE
    pairs = small.join(other, ["m", "k"]).where((F.col("fp") > F.col("v")) & close).select(F.col("fp").alias("u"), "v")

    crowded = keyed.where(F.col("n") > bucket).select("fp").distinct()
    flips = F.array(F.lit(0).cast("long"), *[F.lit((1 << b) - (1 << 64) if b == 63 else 1 << b).cast("long") for b in range(64)])
    meets = crowded.select("fp", F.explode(F.transform(flips, lambda x: F.col("fp").bitwiseXOR(x))).alias("at"))
    met = meets.groupBy("at").agg(F.collect_list("fp").alias("all")).where(F.size("all") > 1)  # 65 at most
    stars = met.select(F.explode("all").alias("u"), F.array_min("all").alias("v")).where("u > v")
    return pairs.unionByName(stars).distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, fingerprint (16 hex digits), component_id
    (the smallest id reachable over links)."""
    fps = materialize(fingerprints(docs, id_col, text_col))
    vertices = materialize(fps.groupBy("fp").agg(F.min("doc_id").alias("first_id")))
    roots = connected_components(links(vertices.select("fp")))  # vertex, root: linked vertices only
    placed = vertices.join(roots, vertices.fp == roots.vertex, "left").select("fp", "first_id", F.coalesce("root", "fp").alias("root"))
    least = placed.groupBy("root").agg(F.min("first_id").alias("component_id"))
    classes = placed.join(least, "root").select(F.col("fp").alias("class_fp"), "component_id")
    return fps.join(classes, fps.fp == classes.class_fp).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs whose id is the smallest of their near-duplicate group.
    Rows with a null id stay, since nothing tells them apart; of the rows that
    repeat one id, one stays."""
    classes = materialize(near_duplicates(docs, id_col, text_col))
    gone = classes.where("doc_id > component_id").select(F.col("doc_id").alias("_id")).distinct()
    kept = docs.join(gone, docs[id_col] == F.col("_id"), "left_anti")  # the one shuffle of texts, if `gone` is large
    repeated = classes.where("doc_id = component_id").groupBy(F.col("doc_id").alias("_id")).count().where("count > 1").select("_id")
    if not repeated.take(1):
        return kept
    once = docs.join(repeated, docs[id_col] == F.col("_id"), "left_semi").dropDuplicates([id_col])
    return kept.join(repeated, docs[id_col] == F.col("_id"), "left_anti").unionByName(once)
