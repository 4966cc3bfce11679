"""Sequence packing by minimum bin slack.

A document's ids are cut at every 2048; full windows are sequences by
themselves.  The remainders are dealt into groups of a few thousand.  In a group
each sequence starts from the longest piece left, and a bounded subset-sum over
the lengths left (one bit of an integer for each reachable sum) finds the
multiset whose sum is closest to the room; walking back over the stored bit sets
gives how many pieces of each length it takes.  A group leaves one sequence that
is not nearly full at most.

Ids come from a public tokenizer file, whose path is a parameter.

Null text is empty: its document is the single end id.  Repeated rows and rows
with the same or a null id are documents of their own.  An empty table gives an
empty result.
"""

from __future__ import annotations

import json
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperloom.llm.common import slices, texts_of

CAPACITY = 2048
END_ID = 1
GROUP_DOCS = 4096
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, pack_group long"
PACKED = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


#: Pre-token pattern that byte-level files mean by use_regex: a fixed value.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


class Encoder:
    """Little-endian 32-bit ids of texts under a byte-level BPE file.

    The file's vocabulary is run as merge ranks (an id's rank is its merge's
    place, so the ids are those of the file's own library, which the tests
    hold it to); that takes a third of the time.  A text that holds an added
    token, or that the pattern's engine gives up on, such as a million spaces,
    is encoded whole by the file's own library.  As in the library, with
    `encode_special_tokens` the strings of special tokens are ordinary text;
    without it, which is the library's default and what the operator uses, each
    is its one id.
    """

    def __init__(self, tokenizer_file: str, encode_special_tokens: bool = True):
        import tiktoken

        with open(tokenizer_file, encoding="utf-8") as f:
            vocabulary = json.load(f)
        pre, model = vocabulary.get("pre_tokenizer") or {}, vocabulary["model"]
        self._plain = not vocabulary.get("normalizer") and pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space") and model.get("type") == "BPE" and not any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges"))
        specials = {t["content"] for t in vocabulary["added_tokens"] if t["special"]}
        byte_of = _byte_characters()
        ranks = {bytes(byte_of[c] for c in token): i for token, i in vocabulary["model"]["vocab"].items() if token not in specials}
        self._encoding = tiktoken.Encoding("file", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self._file, self._library, self._encode_special = tokenizer_file, None, encode_special_tokens
        self._added = [t["content"] for t in vocabulary["added_tokens"] if not (t["special"] and encode_special_tokens)]

    def encode(self, text: str) -> bytes:
        if not self._plain or any(a in text for a in self._added):
            return self._by_library(text)
        try:
            ids = self._encoding.encode_to_numpy(text, disallowed_special=())
        except ValueError:  # backtracking beyond the engine's stack
            return self._by_library(text)
        return ids.astype("<u4", copy=False).tobytes()

    def _by_library(self, text: str) -> bytes:
        if self._library is None:
            from tokenizers import Tokenizer

            self._library = Tokenizer.from_file(self._file)
            self._library.encode_special_tokens = self._encode_special
        return np.array(self._library.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


def _byte_characters() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for:
    printable ones for themselves, the others in order from U+0100."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


_ENCODERS: dict[str, Encoder] = {}


def encoder(tokenizer_file: str) -> Encoder:
    """One for each worker process."""
    if tokenizer_file not in _ENCODERS:
        _ENCODERS[tokenizer_file] = Encoder(tokenizer_file, encode_special_tokens=False)
    return _ENCODERS[tokenizer_file]


def pieces(docs: DataFrame, tokenizer_file: str, groups: int, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """The pieces of each document; one pass, nothing but counts and checksums leaves it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, end, dealt = encoder(tokenizer_file).encode, np.array([end_id], "<u4").tobytes(), 0
        for batch in slices(batches):
            rows: dict[str, list] = defaultdict(list)
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), texts_of(batch), strict=True):
                ids, dealt = (encode(text.decode("utf-8", "replace")) if text else b"") + end, dealt + 1
                total = len(ids) // 4
                group = (zlib.crc32(str(doc_id).encode()) + dealt) % groups
                for a in range(0, total, capacity):
                    part = ids[4 * a : 4 * (a + capacity)]
                    for name, value in zip(("doc_id", "start", "length", "ids_crc32", "doc_tokens", "pack_group"), (doc_id, a, len(part) // 4, zlib.crc32(part), total, group), strict=True):
                        rows[name].append(value)
            yield pa.RecordBatch.from_pydict({k: pa.array(v, pa.int64()) for k, v in rows.items()})

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, PIECES)


def best_fill(room: int, lengths: list[int], counts: dict[int, int]) -> dict[int, int]:
    """How many pieces of each length (descending `lengths`, at most `counts`)
    sum closest to room from below."""
    mask, reach, steps = (1 << (room + 1)) - 1, 1, []
    for d in lengths:
        if d > room:
            continue
        left, k = min(counts[d], room // d), 1
        while left:
            k = min(k, left)
            wider = reach | (reach << (d * k)) & mask
            if wider != reach:
                steps.append((d, k, reach))
                reach = wider
            left, k = left - k, 2 * k
        if reach >> room:
            break
    at, taken = reach.bit_length() - 1, defaultdict(int)
    for d, k, before in reversed(steps):
        if not before >> at & 1:
            taken[d] += k
            at -= d * k
    return dict(taken)


def minimum_slack(lengths: list[int], capacity: int = CAPACITY) -> list[list[int]]:
    """Indices of lengths by sequence; each index once."""
    stacks: dict[int, list[int]] = defaultdict(list)
    for i in range(len(lengths) - 1, -1, -1):
        stacks[lengths[i]].append(i)
    counts = {d: len(s) for d, s in stacks.items()}
    order, out = sorted(counts, reverse=True), []
    while order:
        seed = order[0]
        counts[seed] -= 1
        take = [seed]
        for d, k in best_fill(capacity - seed, order, counts).items():
            counts[d] -= k
            take += [d] * k
        out.append([stacks[d].pop() for d in take])
        order = [d for d in order if counts[d]] if any(not counts[d] for d in take) else order
    return out


def pack(docs: DataFrame, tokenizer_file: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, group_docs: int = GROUP_DOCS) -> DataFrame:
    """One row per piece with its sequence and its offset there."""
    groups = max(1, -(-docs.count() // group_docs))

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["doc_id", "start", "ids_crc32"], kind="stable").reset_index(drop=True)
        lengths = pdf["length"].to_numpy()
        sequence, offset = np.empty(len(pdf), np.int64), np.zeros(len(pdf), np.int64)
        full = lengths == capacity
        sequence[full] = np.arange(full.sum())
        rest, n = np.flatnonzero(~full), int(full.sum())
        for k, chosen in enumerate(minimum_slack(lengths[rest].tolist(), capacity)):
            at = 0
            for i in rest[chosen]:
                sequence[i], offset[i] = n + k, at
                at += lengths[i]
        pdf["sequence_id"], pdf["offset"] = sequence + (int(key[0]) << 32), offset
        return pdf.drop(columns="pack_group")

    return pieces(docs, tokenizer_file, groups, id_col, text_col, capacity).groupBy("pack_group").applyInPandas(run, PACKED)
