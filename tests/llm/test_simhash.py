import random

import pytest
import xxhash

from paperloom.llm import simhash
from paperloom.llm.components import connected_components

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa".split()


def brute_fingerprint(text):
    words, w = [], ""
    for ch in (text or "") + " ":
        if ch in " \t\n\x0b\x0c\r":
            if w:
                words.append(w)
            w = ""
        else:
            w += ch.lower() if "A" <= ch <= "Z" else ch
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(rows):
    fps = [brute_fingerprint(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= 2:
                root[find(i)] = find(j)
    least = {}
    for i, (doc, _) in enumerate(rows):
        r = find(i)
        least[r] = min((x for x in (least.get(r), doc) if x is not None), default=None)
    return sorted(((doc, f"{fps[i]:016x}", least[find(i)]) for i, (doc, _) in enumerate(rows)), key=str)


def corpus(seed):
    rng = random.Random(seed)
    base = [" ".join(rng.choices(WORDS, k=rng.randrange(60, 120))) for _ in range(12)]
    texts = []
    for b in base:
        for _ in range(rng.randrange(1, 12)):
            words = b.split()
            if rng.random() < 0.7:
                words[rng.randrange(len(words))] = rng.choice(WORDS)
            texts.append(" ".join(words))
    texts += [None, "", " \n\t", "One", "one", "Two words", "ÀÉ  naïve\x0bx", "hello world " * 3000]
    rows = [(i * 3 + 1, t) for i, t in enumerate(texts)]
    rows += [rows[0], (None, texts[1]), (None, None)]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("bucket", [simhash.BUCKET, 1])
def test_classes_equal_brute_force(spark, monkeypatch, bucket):
    """bucket 1 sends every shared key through the neighbour path."""
    monkeypatch.setattr(simhash.links, "__defaults__", (bucket,))
    rows = corpus(5)
    docs = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id long, text string, fp int, component_id string")
    got = sorted((tuple(r) for r in simhash.near_duplicates(docs).collect()), key=str)
    assert got == brute_components(rows)


def test_empty(spark):
    assert simhash.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_pairs_agree_on_a_block():
    rng = random.Random(1)
    masks = [m & (1 << 64) - 1 for m in simhash.block_masks()]
    assert len(masks) == 10
    for _ in range(2000):
        flips = rng.sample(range(64), rng.randrange(0, 3))
        x = sum(1 << b for b in flips)
        assert any(x & m == 0 for m in masks)


def test_components_of_random_graphs(spark):
    rng = random.Random(9)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(150)] + [(i, i + 1) for i in range(1000, 1200)] + [(-5, 3)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    got = {r.vertex: r.root for r in connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {x: find(x) for e in edges for x in e if find(x) != x}


def test_one_of_each_group_stays(spark):
    rows = [(5, "a b c d"), (2, "a b c d"), (2, "a b c d"), (9, "q r s t u"), (None, "a b c d")]
    kept = simhash.deduplicate(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted((r.doc_id for r in kept.collect()), key=str) == [2, 9, None]
