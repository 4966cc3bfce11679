"""Benchmark decontamination with one Aho-Corasick automaton.

Words are `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+` after lower-casing A-Z; on UTF-8
bytes that is: digits, ASCII letters and every byte from 0x80.  Every 13
consecutive words of an item (or all words of a shorter one) are one pattern,
with a space at either end, and the normalised text is scanned once.  Offsets
of hits are mapped back to code points of the original text.

The benchmark is a fixed set of tests, not a part of the corpus.  Its texts go
to the workers in blocks whose patterns have about BLOCK_BYTES, one broadcast and
one pass over the documents for each; workers cut the windows themselves, so what
is sent is an eighth of that.  With several blocks the hits found so far are
written to the shared checkpoint folder before the next block is sent, and the
driver holds one block at a time.

Null and word-free texts have no words and no hits.  Items with a null id or
text, and items without words, have no windows.  Items that share an id count
once.  Rows keep their number and their ids, nulls and repeats included.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperloom.llm.common import materialize, slices, texts_of

WINDOW = 13
BLOCK_BYTES = 16 << 20
WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
_TABLE = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
_BUILT: dict[str, ahocorasick.Automaton | None] = {}

SCAN = "doc_id long, n_words long, hits array<struct<first:int,last:int>>, items array<string>, spans array<struct<start:int,end:int>>"


def words_of(text: bytes | None) -> list[bytes]:
    return text.translate(_TABLE).split() if text else []


def windows_of(text: bytes | None, window: int = WINDOW) -> set[bytes]:
    words = words_of(text)
    if not words:
        return set()
    return {b" ".join(words[i : i + window]) for i in range(max(1, len(words) - window + 1))}


def item_blocks(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text", window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> Iterator[tuple[list[tuple[str, bytes]], bool]]:
    """Items (id, text) block by block, by the bytes of their windows, and whether
    the block is the last; the driver holds one block at a time."""
    rows = benchmark.select(F.col(id_col).cast("string").alias("i"), F.col(text_col).cast("binary").alias("t")).where("i is not null and t is not null")
    block: list[tuple[str, bytes]] = []
    total = 0
    for row in rows.toLocalIterator():
        size = sum(map(len, windows_of(bytes(row.t), window)))
        if block and total + size > block_bytes:
            yield block, False
            block, total = [], 0
        block.append((row.i, bytes(row.t)))
        total += size
    yield block, True


def patterns_of(block: list[tuple[str, bytes]], window: int = WINDOW) -> dict[bytes, set[str]]:
    """Windows and the ids of the items that hold them."""
    found: dict[bytes, set[str]] = {}
    for item, text in block:
        for pattern in windows_of(text, window):
            found.setdefault(pattern, set()).add(item)
    return found


def _automaton(key: str, block: list[tuple[str, bytes]], window: int) -> ahocorasick.Automaton | None:
    """Built once in each worker process."""
    if key not in _BUILT:
        _BUILT.clear()
        auto, patterns = ahocorasick.Automaton(), patterns_of(block, window)
        for pattern, items in patterns.items():
            auto.add_word(f" {pattern.decode('latin-1')} ", (pattern.count(b" ") + 1, len(pattern), tuple(items)))
        if patterns:
            auto.make_automaton()
        _BUILT[key] = auto if patterns else None
    return _BUILT[key]


def find(text: bytes | None, auto: ahocorasick.Automaton | None) -> tuple[int, list[tuple[int, int]], set[str]]:
    """Number of words, merged ranges [first, last) of hit words, items found."""
    words = words_of(text)
    if not words or auto is None:
        return len(words), [], set()
    norm = f" {b' '.join(words).decode('latin-1')} "
    found: set[str] = set()
    ranges: list[tuple[int, int]] = []
    starts = None
    for end, (n, size, items) in auto.iter(norm):
        if starts is None:  # where each word begins in norm
            starts = np.flatnonzero(np.frombuffer(norm.encode("latin-1"), np.uint8) == 32) + 1
        first = int(np.searchsorted(starts, end - size))
        found.update(items)
        ranges.append((first, first + n))
    return len(words), merge(ranges), found


def merge(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(ranges):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def char_spans(text: bytes, ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Code-point offsets in the original text of ranges of words."""
    at = [m.span() for m in WORD.finditer(text.decode("utf-8", "replace"))]
    return [(at[a][0], at[b - 1][1]) for a, b in ranges]


def scan(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per document: doc_id, n_words, hits (word ranges), items (ids
    with occurring windows, distinct), spans (code-point ranges)."""
    sc = docs.sparkSession.sparkContext
    start = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    df = start.withColumns({"hits": F.lit(None).cast("array<struct<first:int,last:int>>"), "items": F.lit(None).cast("array<string>")})
    for block, last in item_blocks(benchmark, window=window, block_bytes=block_bytes):
        sent, key = sc.broadcast(block), uuid.uuid4().hex

        def run(batches: Iterator[pa.RecordBatch], sent=sent, last=last, key=key) -> Iterator[pa.RecordBatch]:
            auto = _automaton(key, sent.value, window)
            for batch in slices(batches):
                texts = texts_of(batch)
                before = zip(batch.column("hits").to_pylist(), batch.column("items").to_pylist(), strict=True)
                n_words, hits, items, spans = [], [], [], []
                for text, (was, had) in zip(texts, before, strict=True):
                    n, ranges, found = find(text, auto)
                    ranges = merge(ranges + [(r["first"], r["last"]) for r in was or ()])
                    n_words.append(n)
                    hits.append([{"first": a, "last": b} for a, b in ranges])
                    items.append(sorted(found | set(had or ())))
                    spans.append([{"start": a, "end": b} for a, b in char_spans(text, ranges)] if last and ranges else [])
                columns = {"doc_id": batch.column("doc_id")}
                columns |= {"n_words": pa.array(n_words, pa.int64())} if last else {"text": batch.column("text")}
                columns |= {"hits": pa.array(hits, pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32())]))), "items": pa.array(items, pa.list_(pa.string()))}
                columns |= {"spans": pa.array(spans, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))} if last else {}
                yield pa.RecordBatch.from_pydict(columns)

        df = df.mapInArrow(run, SCAN if last else "doc_id long, text string, hits array<struct<first:int,last:int>>, items array<string>")
        if not last:
            df = materialize(df)
            sent.destroy()
    return df


def report(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The digest columns of scan()."""
    found = scan(docs, benchmark).withColumn("n_hit", F.aggregate("hits", F.lit(0).cast("long"), lambda n, r: n + r["last"] - r["first"]))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("items"), ","), 256).alias("items_sha256"),
        ((F.col("n_hit") > 0) & (F.col("n_hit") * 20 >= F.col("n_words"))).alias("contaminated"),
    )


def decontaminate(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """docs without the rows of which a twentieth or more is benchmark; from the
    other rows the passages that occur are cut out.  The columns are those of docs.
    Hits of all pattern blocks are collected on the original text, as in scan();
    the last block decides, so the size of the blocks has no effect."""
    sc = docs.sparkSession.sparkContext
    at, columns, kept = docs.columns.index(text_col), len(docs.columns), docs.schema
    # a column that no input has, behind all others
    df = docs.withColumn(f"_hits_{uuid.uuid4().hex}", F.lit(None).cast("array<struct<first:int,last:int>>"))
    carried = df.schema
    for block, last in item_blocks(benchmark, window=window, block_bytes=block_bytes):
        sent, key = sc.broadcast(block), uuid.uuid4().hex

        def run(batches: Iterator[pa.RecordBatch], sent=sent, last=last, key=key) -> Iterator[pa.RecordBatch]:
            auto = _automaton(key, sent.value, window)
            for batch in slices(batches, text_col):
                keep, texts, hits, changed = [], [], [], False
                for text, was in zip(texts_of(batch, text_col), batch.column(columns).to_pylist(), strict=True):
                    n, ranges, _ = find(text, auto)
                    ranges = merge(ranges + [(r["first"], r["last"]) for r in was or ()])
                    hits.append([{"first": a, "last": b} for a, b in ranges])
                    keep.append(20 * sum(b - a for a, b in ranges) < n or not ranges)
                    if last and ranges and keep[-1]:
                        text, changed = without(text, char_spans(text, ranges)), True
                    texts.append(text)
                if not last:
                    field = batch.schema.field(columns)
                    yield batch.set_column(columns, field.name, pa.array(hits, pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32())]))))
                    continue
                batch = batch.select(range(columns))
                if changed:
                    batch = batch.set_column(at, batch.schema.field(at), pa.array(texts, pa.binary()).cast(batch.schema.field(at).type))
                yield batch.filter(pa.array(keep, pa.bool_()))

        df = df.mapInArrow(run, kept if last else carried)
        if not last:
            df = materialize(df)
            sent.destroy()
    return df


def without(text: bytes, spans: list[tuple[int, int]]) -> bytes:
    s, out, at = text.decode("utf-8", "replace"), [], 0
    for a, b in spans:
        out.append(s[at:a])
        at = b
    return "".join([*out, s[at:]]).encode()


def oracle() -> str:
    """report() in DuckDB, by joining windows of every length that occurs."""
    words = "regexp_extract_all(translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
    return f"""
      WITH items AS (SELECT item_id::VARCHAR AS item, {words.format("text")} AS w FROM benchmark WHERE item_id IS NOT NULL AND text IS NOT NULL),
      windows AS (SELECT DISTINCT item, least(len(w), {WINDOW}) AS n, array_to_string(w[i:i + {WINDOW} - 1], ' ') AS p
                  FROM (SELECT item, w, unnest(generate_series(1, greatest(1, len(w) - {WINDOW} + 1))) AS i FROM items WHERE len(w) > 0)),
      d AS (SELECT row_number() OVER () AS row, doc_id, {words.format("coalesce(text, '')")} AS w FROM documents),
      grams AS (SELECT row, i, n, array_to_string(w[i:i + n - 1], ' ') AS p
                FROM (SELECT row, w, n, unnest(generate_series(1, len(w) - n + 1)) AS i FROM d, (SELECT DISTINCT n FROM windows) WHERE len(w) >= n)),
      hits AS (SELECT row, i, n, item FROM grams JOIN windows USING (n, p)),
      hit_words AS (SELECT row, count(DISTINCT k) AS n_hit FROM (SELECT row, unnest(generate_series(i, i + n - 1)) AS k FROM hits) GROUP BY row),
      hit_items AS (SELECT row, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids FROM (SELECT DISTINCT row, item FROM hits) GROUP BY row)
      SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
             coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
      FROM d LEFT JOIN hit_words USING (row) LEFT JOIN hit_items USING (row)"""
