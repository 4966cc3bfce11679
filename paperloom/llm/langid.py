"""Language identification by prediction by partial matching.

For each language a context tree of order three is counted over bytes of
lower-cased text and then frozen.  A byte that its context has seen costs
-log2(n / (N + q)) bits, N being the context's count and q its distinct bytes;
else the escape -log2(q / (N + q)) is paid and the next shorter context tried,
down to a uniform code over 256 bytes.  A text goes to the language that codes
it in the fewest bits.

Code lengths are exact: every byte value, every context that the sample has and
every count take part, in double precision.  As the statistics are frozen, a
gram (a byte after its three predecessors) costs the same wherever it stands, so
the distinct grams of a batch are coded once for each language and summed by
text.  Long texts are coded in pieces that carry their three bytes of context.

The model is fitted on a bounded sample: for each language, about
DOCS_PER_LANG training documents, the first by a hash of their id, of up to
DOC_BYTES bytes; where a language has fewer of those, also about as many longer
ones, whole.  Its grams are counted on the executors.

Null texts, empty ones and those without any letter (Unicode category L) are
`und` with score 0; so is every text when there is no row to learn from.  Ties
go to the language that sorts first.  Rows keep their number, equal texts have
equal predictions, and an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperloom.llm.common import few_rows, id_remainder, slices, texts_of, thinned

UNDETERMINED = "und"
DOCS_PER_LANG = 400
DOC_BYTES = 1 << 16
ORDER = 3
PIECE = 2 << 20
START = b"\n\n\n"
LETTER = regex.compile(r"\p{L}")


def prepared(text: bytes) -> bytes:
    return text.decode("utf-8", "replace").lower().encode("utf-8", "replace")


def grams(text: bytes) -> np.ndarray:
    """Four-byte grams as big-endian numbers, one for each byte behind the first three."""
    a = np.frombuffer(text, np.uint8).astype(np.uint32)
    return (a[:-3] << 24) | (a[1:-2] << 16) | (a[2:-1] << 8) | a[3:]


class _Tree:
    """Frozen context tree of one language: for each order the bits of the grams
    that it has seen and of the escapes from its contexts, by sorted key."""

    def __init__(self, gram: np.ndarray, n: np.ndarray):
        self.orders = []
        for order in range(ORDER, -1, -1):
            seen, at = np.unique(gram & ((1 << 8 * (order + 1)) - 1), return_inverse=True)
            count = np.bincount(at, weights=n)
            context, of = np.unique(seen >> 8, return_inverse=True)
            total, distinct = np.bincount(of, weights=count), np.bincount(of)
            self.orders.append((seen, np.log2((total + distinct)[of]) - np.log2(count), context, np.log2(total + distinct) - np.log2(distinct)))

    def bits(self, gram: np.ndarray) -> np.ndarray:
        """Code length of each gram."""
        out, left = np.zeros(len(gram)), np.arange(len(gram))
        for k, (seen, bits, context, escape) in enumerate(self.orders):
            key = gram[left] & ((1 << 8 * (ORDER + 1 - k)) - 1)
            at, found = _find(seen, key)
            out[left[found]] += bits[at[found]]
            left, key = left[~found], key[~found] >> 8
            at, found = _find(context, key)
            out[left[found]] += escape[at[found]]
        out[left] += 8
        return out


def _find(table: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each key stands in a sorted table, and whether it does."""
    at = np.minimum(np.searchsorted(table, key), len(table) - 1)
    return at, table[at] == key


class Model:
    """A frozen context tree for each language."""

    def __init__(self, counts: pd.DataFrame):
        """counts: lang, gram, n."""
        self.langs = sorted(counts["lang"].unique())
        own = {lang: rows for lang, rows in counts.groupby("lang")}
        self.trees = [_Tree(own[lang]["gram"].to_numpy(np.uint32), own[lang]["n"].to_numpy(np.float64)) for lang in self.langs]

    def code_lengths(self, texts: list[bytes], piece: int = PIECE) -> np.ndarray:
        """Bits of each text (rows) under each language (columns)."""
        out = np.zeros((len(texts), len(self.langs)))
        parts: list[tuple[int, bytes]] = []
        held = 0
        for i, text in enumerate(texts):
            for a in range(0, len(text), piece):
                part = START + text[:piece] if a == 0 else text[a - ORDER : a + piece]
                if held and held + len(part) > piece:
                    self._add(out, parts)
                    parts, held = [], 0
                parts.append((i, part))
                held += len(part)
        self._add(out, parts)
        return out

    def _add(self, out: np.ndarray, parts: list[tuple[int, bytes]]) -> None:
        if not parts:
            return
        found = [grams(part) for _, part in parts]
        at, distinct = pd.factorize(np.concatenate(found))
        begin = np.cumsum([0, *map(len, found[:-1])])
        owner = [i for i, _ in parts]
        for k, tree in enumerate(self.trees):
            np.add.at(out[:, k], owner, np.add.reduceat(tree.bits(distinct)[at], begin))


def fit(docs: DataFrame, learn: Column, lang_col: str = "lang", id_col: str = "doc_id", text_col: str = "text", docs_per_lang: int = DOCS_PER_LANG, doc_bytes: int = DOC_BYTES) -> Model | None:
    """Model of the rows where `learn` holds; None if there are none."""
    rows = docs.where(learn).select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"), F.col(id_col).alias("id")).where("lang is not null and octet_length(text) > 0")
    short = F.octet_length("text") <= doc_bytes
    sizes = few_rows(rows.where("id is not null").groupBy(F.col("lang").alias("_by")).agg(F.count_if(short).alias("_short")))
    few = rows.where(~short).join(sizes.where(F.col("_short") < docs_per_lang), F.col("lang") == F.col("_by")).select("lang", "text", "id")
    sample = thinned(rows.where(short), "id", docs_per_lang, "lang").unionByName(thinned(few, "id", docs_per_lang, "lang")).select("lang", "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            langs = np.array(batch.column("lang").to_pylist(), object)
            texts = texts_of(batch)
            for lang in np.unique(langs):
                g, n = np.unique(np.concatenate([grams(START + prepared(texts[i])) for i in np.flatnonzero(langs == lang)]), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(g)), pa.array(g.astype(np.int64)), pa.array(n.astype(np.int64))], names=["lang", "gram", "n"])

    counted = sample.mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    table = counted.orderBy("lang", "gram").toPandas()
    return Model(table) if len(table) else None


def predict(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, lang_pred, score, bits): score is the winner's share when each
    language weighs 2**-(its bits per byte, times 32 bytes at most)."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        for batch in slices(batches, max_bytes=2 << 20):
            texts = [prepared(t or b"") for t in texts_of(batch)]
            known = np.array([model is not None and LETTER.search(t.decode()) is not None for t in texts])
            langs, score, bits = np.full(len(texts), UNDETERMINED, object), np.zeros(len(texts)), np.zeros(len(texts))
            if known.any():
                lengths = model.code_lengths([t if k else b"" for t, k in zip(texts, known, strict=True)])
                best = lengths.argmin(1)
                sizes = np.maximum(1, np.array([len(t) for t in texts]))
                weights = np.exp2(-(lengths - lengths.min(1, keepdims=True)) * np.minimum(1, 32 / sizes)[:, None])
                langs[known] = np.array(model.langs, object)[best[known]]
                score[known] = (1 / weights.sum(1))[known]
                bits[known] = lengths.min(1)[known]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(langs, pa.string()), pa.array(score), pa.array(bits)], names=["doc_id", "lang_pred", "score", "bits"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, lang_pred string, score double, bits double")


def report(docs: DataFrame) -> DataFrame:
    """Predictions for all documents, learnt from those outside the held-out fold."""
    model = fit(docs, id_remainder("doc_id", 4) != 2)
    found = predict(docs, model)
    return found.select("doc_id", (id_remainder("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score", "bits")
