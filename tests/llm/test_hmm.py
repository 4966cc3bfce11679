import itertools
import math
import zlib
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from paperloom.llm import hmm


def tiny(rng, classes=5, states=3):
    norm = lambda a, axis: a / a.sum(axis=axis, keepdims=True)
    return hmm.Hmm(norm(rng.random(states), 0), norm(rng.random((states, states)), 1), norm(rng.random((classes, states)), 0))


def paths(model, seq):
    for path in itertools.product(range(len(model.start)), repeat=len(seq)):
        p = model.start[path[0]] * model.emit[seq[0], path[0]]
        for t in range(1, len(seq)):
            p *= model.move[path[t - 1], path[t]] * model.emit[seq[t], path[t]]
        yield path, p


def test_forward_and_expected_counts_equal_enumeration():
    rng = np.random.default_rng(1)
    model = tiny(rng)
    seqs = [rng.integers(0, 5, n).astype(np.int32) for n in (4, 1, 6, 4)]
    got = model.log10_likelihood(hmm.Batch(seqs))
    starts, moves, emissions = np.zeros(3), np.zeros((3, 3)), np.zeros((5, 3))
    for k, s in enumerate(seqs):
        total = sum(p for _, p in paths(model, s))
        assert math.isclose(got[k], math.log10(total), rel_tol=1e-10)
        for path, p in paths(model, s):
            starts[path[0]] += p / total
            for t, state in enumerate(path):
                emissions[s[t], state] += p / total
                if t:
                    moves[path[t - 1], state] += p / total
    for segment in (1, 3, 7, hmm.SEGMENT):  # forward values computed again from the start of each segment
        a, b, c = model.expected(hmm.Batch(seqs), segment)
        assert np.allclose(a, starts) and np.allclose(b, moves) and np.allclose(c, emissions)


def test_a_round_does_not_lower_the_likelihood():
    rng = np.random.default_rng(2)
    seqs = [rng.integers(0, 5, 30).astype(np.int32) for _ in range(20)]
    batch, model, mass = hmm.Batch(seqs), tiny(rng), np.ones(5)
    before = model.log10_likelihood(batch).sum()
    for _ in range(5):
        model = hmm.Hmm.from_counts(*model.expected(batch), mass, weight=1e-9)
        after = model.log10_likelihood(batch).sum()
        assert after > before - 0.5
        before = after


def test_base_score_equals_brute_force(spark):
    rng = np.random.default_rng(3)
    vocabulary = [f"w{i}" for i in range(30)]
    rows = [(i, " ".join(rng.choice(vocabulary, rng.integers(1, 40))) + (f" Only{i}" if i % 5 == 0 else "")) for i in range(150)]
    rows += [(900, None), (901, ""), (902, "W1\tw2\nw3\x0bÀ"), (None, "w1 w2"), (903, "w4 " * 20000), (903, "w4")]
    docs = spark.createDataFrame([(i, t, 0.5) for i, t in rows], "doc_id long, text string, score double")
    fold = lambda i: (zlib.crc32(str(i).encode()) if i is not None else 0) % 7
    tokens = lambda t: [*(t or "").encode().lower().split(), b""]
    counts = Counter(w for i, t in rows if fold(i) != 2 for w in tokens(t))
    n, v = sum(counts.values()), len(counts)
    want = sorted(((i, fold(i) == 2, len(tokens(t)), sum(counts[w] > 0 for w in tokens(t)), n, round(sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in tokens(t)), 6)) for i, t in rows), key=str)
    got = hmm.report(docs).collect()
    assert sorted(((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got), key=str) == want
    assert all(r.score < 0 and math.isfinite(r.score) for r in got)


def test_score_is_a_distribution_over_short_texts(spark):
    """All texts of up to two words over known ones have less than all the mass."""
    words = ["a", "b", "c"]
    train = [(i, " ".join(words[(i + j) % 3] for j in range(1 + i % 3))) for i in range(60)]
    ask = [(1000 + k, " ".join(t)) for k, t in enumerate(t for n in range(3) for t in itertools.product(words, repeat=n))]
    docs = spark.createDataFrame(train + ask, "doc_id long, text string")
    got = {r.doc_id: r.score for r in hmm.score(docs, docs["doc_id"] < 1000, states=2, classes=16).collect()}
    mass = sum(10 ** got[i] for i, _ in ask)
    assert 0.2 < mass <= 1 + 1e-9


def test_no_training_rows(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    (r,) = hmm.score(docs, docs["doc_id"] < 0).collect()
    assert (r.n_known, r.train_tokens, r.base_score, r.score) == (0, 0, 0.0, 0.0)
    assert hmm.report(docs.limit(0)).count() == 0


def test_rounds_over_all_texts_are_three_and_sum_doubles(spark, monkeypatch):
    rng = np.random.default_rng(4)
    words = [" ".join(f"w{k}" for k in rng.integers(0, 50, 40)) for _ in range(60)]
    texts = spark.createDataFrame([(i, t.encode()) for i, t in enumerate(words)], "doc_id long, text binary").repartition(3)
    model, counts = tiny(rng, classes=17), hmm.count_tokens(texts)
    want = model.expected(hmm.Batch([hmm.classes_of(t.encode().split(), 16) for t in words]))
    mass = hmm.mass_of(counts, 16)
    for known in ([], [b"w1", b"w2", b"w30"]):
        encoded = hmm.encode(texts.withColumn("learn", F.lit(True)), (known, np.ones(len(known))), mass, 60, 16)
        for got, sums in zip(hmm._round(encoded, model, 16), want, strict=True):
            assert np.allclose(got, sums, rtol=1e-11, atol=1e-12)
    seen, one = [], hmm._round
    monkeypatch.setattr(hmm, "_round", lambda *a: seen.append(a[0]) or one(*a))
    hmm.train(encoded, mass, 3, 16)
    assert len(seen) == 3 and all(t is encoded for t in seen)


def test_any_head_gives_the_same_scores(spark):
    rng = np.random.default_rng(6)
    rows = [(i, " ".join(f"w{int(k)}" for k in rng.zipf(1.6, rng.integers(1, 60)) % 400)) for i in range(80)]
    rows += [(90, "x" * 100 + " w1"), (None, None), (91, "w1 " * 5000), (91, "w1 " * 5000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    learn = docs["doc_id"] % 3 > 0
    told = lambda **k: sorted(((r.doc_id, r.n_tokens, r.n_known, round(r.base_score, 7), round(r.score, 5)) for r in hmm.score(docs, learn, states=3, classes=64, **k).collect()), key=str)
    whole = told()
    assert whole == told(head=20) == told(head=0) and len(whole) == len(rows)


def test_head_is_bounded_and_most_frequent(spark):
    counts = spark.createDataFrame([(f"t{i}".encode(), 1000 // (i + 1)) for i in range(300)] + [(b"", 10**6), (b"y" * 65, 10**6)], "token binary, c long")
    chosen, (tokens, n) = hmm.head_of(counts, 50)
    assert 20 < len(tokens) <= 50 and set(tokens) == {f"t{i}".encode() for i in range(len(tokens))} and n.min() >= 1000 // (len(tokens) + 1)
    assert counts.where(chosen).count() == len(tokens) and hmm.head_of(counts, 0)[1][0] == []


def test_pieces_are_the_words():
    text = b"Aa  bb\tCC\n" * 50 + b"longwordwithoutspaces" * 5
    for size in (1, 3, 10, 1000):
        assert [w for p in hmm.pieces_of(text, size) for w in p] == hmm.words_of(text)
    assert list(hmm.pieces_of(None)) == []
