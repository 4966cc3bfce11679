"""The k best items of each query, kept while the rows pass.

A worker holds k rows for each query (and as many again before they are cut), so
what leaves it depends on the number of queries and not on that of the rows."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import DoubleType, StructType
from pyspark.sql.window import Window

#: Scores that are worked out at once, and rows held before they are cut: bounds of memory.
CELLS, HELD = 1 << 21, 1 << 18


def rounded(x: np.ndarray, digits: int) -> np.ndarray:
    """To digits decimals, halves away from zero, as round() of Spark and DuckDB;
    numbers too large to have as many decimals stay."""
    unit = 10.0**digits
    with np.errstate(all="ignore"):
        return np.where(np.abs(x) * unit < 2.0**51, np.copysign(np.floor(np.abs(x) * unit + 0.5) / unit, x) + 0.0, x)


class Best:
    """Rows (query, score, item) of the k best of n queries: by score descending
    (NaN first, -inf, which stands for null, last), ties by item."""

    def __init__(self, n: int, k: int):
        self.k, self.floor, self.rows, self.held = k, np.full(n, -np.inf), 0, []

    def offer(self, scores: np.ndarray, items: pa.Array, above: float | None = None) -> None:
        """scores (items x queries); with `above`, only those greater than it."""
        key = np.where(np.isnan(scores), np.inf, scores)
        good = key >= self.floor
        at, query = np.nonzero(good if above is None else good & (key > above))
        self.held.append((query.astype(np.int32), key[at, query], scores[at, query], items.take(pa.array(at))))
        self.rows += len(at)
        if self.rows > max(HELD, 2 * self.k * len(self.floor)):
            self.cut()

    def cut(self) -> None:
        query, key, score = (np.concatenate([h[i] for h in self.held]) for i in range(3))
        items = pa.concat_arrays([h[3] for h in self.held])
        table = pa.table({"q": query, "key": key, "item": items})
        order = pc.sort_indices(table, sort_keys=[("q", "ascending"), ("key", "descending"), ("item", "ascending")], null_placement="at_start").to_numpy()
        by = query[order]
        place = np.arange(len(by)) - np.searchsorted(by, by)
        last = order[place == self.k - 1]
        self.floor[query[last]] = key[last]
        order = order[place < self.k]
        self.held, self.rows = [(query[order], key[order], score[order], items.take(pa.array(order)))], len(order)

    def batch(self, queries: pa.Array) -> pa.RecordBatch | None:
        if not self.rows:
            return None
        self.cut()
        query, key, score, items = self.held[0]
        return pa.RecordBatch.from_arrays([queries.take(pa.array(query)), items, pa.array(score, pa.float64(), mask=key == -np.inf)], ["query_id", "doc_id", "score"])


def search(rows: DataFrame, query_field, queries: list, score: Callable[[Iterator[pa.RecordBatch]], Iterator[tuple[np.ndarray, pa.Array]]], k: int, above: float | None = None) -> DataFrame:
    """(query_id, doc_id, score): of each task over rows (doc_id, ...) the k best
    for each of `queries`, ids that go to every task.  score gives (scores of
    items x queries, items) for the batches of a task."""
    schema = StructType().add("query_id", query_field.dataType).add("doc_id", rows.schema["doc_id"].dataType).add("score", DoubleType())
    ids = pa.array(queries, to_arrow_type(query_field.dataType))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = Best(len(ids), k)
        for scores, items in score(batches):
            best.offer(scores, items, above)
        out = best.batch(ids)
        if out is not None:
            yield out

    return rows.mapInArrow(run, schema)


def ranked(scores: DataFrame, k: int | None = None, key: str = "query_id", item: str = "doc_id") -> DataFrame:
    """rank from 1 by score descending, ties by item."""
    out = scores.withColumn("rank", F.row_number().over(Window.partitionBy(key).orderBy(F.desc("score"), item)))
    return out if k is None else out.where(F.col("rank") <= k)
