import random
import zlib
from collections import defaultdict

import numpy as np
import pytest

from paperloom.llm import packing

public_tokenizers = pytest.importorskip("public_tokenizers")
FILE = public_tokenizers.path("byte_bpe_50k.json")


def reference():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(FILE)
    t.encode_special_tokens = True
    return t


def test_ids_are_those_of_the_file_library():
    rng, ref, enc = random.Random(3), reference(), packing.Encoder(FILE)
    pool = "abc XYZ'sé\n\t  0123 .,!?–日本語🎉  <|endoftext|>"
    texts = ["", " ", "a", "don't  stop\n\n now ", "<|endoftext|>", "x" * 3000] + ["".join(rng.choices(pool, k=rng.randrange(1, 80))) for _ in range(300)]
    for t in texts:
        assert np.frombuffer(enc.encode(t), "<u4").tolist() == ref.encode(t, add_special_tokens=False).ids


def test_white_space_beyond_a_million_characters():
    ref, enc = reference(), packing.Encoder(FILE)
    for run in (" ", "\n", " \t"):
        text = "a" + run * (1_200_000 // len(run)) + "b <|endoftext|>"
        assert np.frombuffer(enc.encode(text), "<u4").tolist() == ref.encode(text, add_special_tokens=False).ids


def test_operator_gives_the_ids_of_the_library_at_its_defaults(spark):
    from tokenizers import Tokenizer

    rng, ref, enc = random.Random(4), Tokenizer.from_file(FILE), packing.encoder(FILE)
    pool = ["<|endoftext|>", "<|endoftext|", "<|", "abc", " ", "\n", "日本", "'s", "12"]
    texts = ["", "abc <|endoftext|> def", "<|endoftext|>" * 3, "a" + " " * 1_200_000 + "<|endoftext|>"] + ["".join(rng.choices(pool, k=rng.randrange(1, 20))) for _ in range(300)]
    for t in texts:
        assert np.frombuffer(enc.encode(t), "<u4").tolist() == ref.encode(t, add_special_tokens=False).ids
    assert np.frombuffer(enc.encode(texts[1]), "<u4").tolist() == [39305, 220, 50256, 825]
    (row,) = packing.pack(spark.createDataFrame([(1, texts[1])], "doc_id long, text string"), FILE).collect()
    assert (row.doc_tokens, row.ids_crc32) == (5, zlib.crc32(np.array([39305, 220, 50256, 825, packing.END_ID], "<u4").tobytes()))


def best_sum(room, lengths):
    reach = {0}
    for x in lengths:
        reach |= {r + x for r in reach if r + x <= room}
    return max(reach)


def test_fill_is_closest_and_bounded():
    rng = random.Random(5)
    for _ in range(300):
        lengths = [rng.randrange(1, 40) for _ in range(rng.randrange(0, 9))]
        counts = {d: lengths.count(d) for d in lengths}
        room = rng.randrange(0, 90)
        got = packing.best_fill(room, sorted(counts, reverse=True), counts)
        assert sum(d * k for d, k in got.items()) == best_sum(room, lengths)
        assert all(0 < k <= counts[d] for d, k in got.items())


def test_every_piece_in_one_sequence():
    rng = random.Random(7)
    lengths = [rng.randrange(1, 2048) for _ in range(3000)] + [1] * 50
    bins = packing.minimum_slack(lengths)
    assert sorted(i for b in bins for i in b) == list(range(len(lengths)))
    fills = [sum(lengths[i] for i in b) for b in bins]
    assert max(fills) <= 2048 and 2048 * len(bins) <= 1.01 * sum(lengths)


def test_pack(spark):
    ref = reference()
    long = "lorem ipsum dolor, " * 2000
    rows = [(1, "hello there", 5), (1, "hello there", 5), (None, None, 6), (2, "", 7), (3, long, 8), (4, long + "x", 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, length int")
    got = packing.pack(docs, FILE).collect()
    bytes_of = lambda t: np.array(ref.encode(t or "", add_special_tokens=False).ids + [1], "<u4").tobytes()
    want, by_doc, by_sequence = defaultdict(list), defaultdict(list), defaultdict(list)
    for i, t, _ in rows:
        ids = bytes_of(t)
        want[i].append(len(ids) // 4)
    for r in got:
        by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id].append(r)
        text = {1: "hello there", None: None, 2: "", 3: long, 4: long + "x"}[r.doc_id]
        assert r.ids_crc32 == zlib.crc32(bytes_of(text)[4 * r.start : 4 * (r.start + r.length)])
        assert r.doc_tokens == len(bytes_of(text)) // 4
    for i, totals in want.items():
        assert sum(r.length for r in by_doc[i]) == sum(totals)
    for rs in by_sequence.values():
        at = 0
        for r in sorted(rs, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 2048
    assert packing.pack(docs.limit(0), FILE).count() == 0
