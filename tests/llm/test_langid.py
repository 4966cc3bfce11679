import math
from collections import Counter, defaultdict

import numpy as np
import pandas as pd

from paperloom.llm import langid


def brute_bits(train, text):
    """Code length by walking the context tree byte by byte."""
    counts = defaultdict(Counter)
    for t in train:
        t = langid.START + t
        for i in range(3, len(t)):
            for k in range(4):
                counts[t[i - k : i]][t[i]] += 1
    total, t = 0.0, langid.START + text
    for i in range(3, len(t)):
        for k in (3, 2, 1, 0):
            c = counts.get(t[i - k : i])
            if not c:
                continue
            n, q = sum(c.values()), len(c)
            if t[i] in c:
                total += math.log2(n + q) - math.log2(c[t[i]])
                break
            total += math.log2(n + q) - math.log2(q)
        else:
            total += 8
    return total


def test_code_lengths_are_exact():
    train = {"a": [b"the cat sat on the mat", b"that hat"], "b": [b"der hund und die katze", "größe".encode()]}
    rows = []
    for lang, texts in train.items():
        g = np.concatenate([langid.grams(langid.START + t) for t in texts])
        rows += [(lang, int(x), int(n)) for x, n in zip(*np.unique(g, return_counts=True), strict=True)]
    model = langid.Model(pd.DataFrame(rows, columns=["lang", "gram", "n"]))
    texts = [b"the hund", b"", b"xyz~~ the", "ßß katze".encode(), b"\n", b"that cat and der hat " * 20]
    got = model.code_lengths(texts)
    for i, t in enumerate(texts):
        for k, lang in enumerate(model.langs):
            assert abs(got[i, k] - brute_bits(train[lang], t)) < 1e-6
    assert np.allclose(model.code_lengths(texts, piece=7), got)  # long texts go in pieces


def test_predictions_and_edges(spark):
    en, fr = "the quick brown fox jumps over the lazy dog and then it sleeps ", "le renard brun saute par dessus le chien paresseux et puis il dort "
    rows = [(i, (en if i % 2 else fr) * (1 + i % 3), "en" if i % 2 else "fr", "x") for i in range(60)]
    rows += [(100, None, "en", None), (101, "", "fr", None), (102, "123 !! ½ ² ①", None, None), (103, en * 500, None, None), (104, fr.upper(), None, None), (None, en, None, None), (103, en * 500, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, score string")
    got = langid.report(docs).collect()
    assert len(got) == len(rows)
    by_id = {r.doc_id: r for r in got}
    assert all(by_id[i].lang_pred == ("en" if i % 2 else "fr") for i in range(60))
    assert [by_id[i].lang_pred for i in (100, 101, 102)] == ["und"] * 3 and by_id[100].score == 0
    assert by_id[103].lang_pred == by_id[None].lang_pred == "en" and by_id[104].lang_pred == "fr"
    assert all(0 <= r.score <= 1 for r in got)


def test_nothing_to_learn_from(spark):
    docs = spark.createDataFrame([(1, "some text", None)], "doc_id long, text string, lang string")
    assert [r.lang_pred for r in langid.report(docs).collect()] == ["und"]
    assert langid.report(docs.limit(0)).count() == 0


def test_all_bytes_of_several_scripts_carry_evidence():
    scripts = {"latin": (0x21, 0x180, 1), "several": (0x390, 0x700, 1), "india": (0x901, 0xE00, 2), "han": (0x4E00, 0x9F00, 61), "hangul": (0xAC00, 0xD700, 53)}
    train = {k: [" ".join(chr(c) for c in range(*r)).lower().encode(), f"{chr(r[0])} abc".encode()] for k, r in scripts.items()}
    assert len(set(b"".join(b"".join(t) for t in train.values()))) > 112
    rows = []
    for lang, texts in train.items():
        g = np.concatenate([langid.grams(langid.START + t) for t in texts])
        rows += [(lang, int(x), int(n)) for x, n in zip(*np.unique(g, return_counts=True), strict=True)]
    model = langid.Model(pd.DataFrame(rows, columns=["lang", "gram", "n"]))
    texts = [t for ts in train.values() for t in ts] + ["δ ж 中 한 q".encode()]
    got = model.code_lengths(texts)
    for i, t in enumerate(texts):
        for k, lang in enumerate(model.langs):
            assert abs(got[i, k] - brute_bits(train[lang], t)) < 1e-6


def test_a_language_of_long_documents_only_is_learnt(spark):
    en, fr = "the quick brown fox jumps over the lazy dog and then it sleeps ", "le renard brun saute par dessus le chien paresseux et puis il dort "
    rows = [(i, en, "en") for i in range(40)] + [(100 + i, fr * 1200, "fr") for i in range(12)] + [(500, fr, None)]
    assert len(fr) * 1200 > langid.DOC_BYTES
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    by_id = {r.doc_id: r.lang_pred for r in langid.report(docs).collect()}
    assert by_id[500] == by_id[100] == "fr" and by_id[0] == "en"


def test_more_values_than_a_broadcast_takes_are_joined_otherwise(spark):
    from paperloom.llm.common import few_rows

    df = spark.range(100).withColumnRenamed("id", "v")
    for most in (10, 100):
        assert few_rows(df, most).count() == 100
