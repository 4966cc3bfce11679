import random

import corpus_pipeline

from paperloom.llm import decontaminate, quality, secrets, simhash


def test_stages_run_on_a_small_corpus(spark, tmp_path):
    rng = random.Random(6)
    words = [f"{a}{b}" for a in "bcdfglmnprst" for b in ("an", "el", "ir", "os", "un")]
    prose = lambda n: " ".join(rng.choices(words, k=n)).capitalize() + "."
    passage = prose(40)
    rows = [(i, prose(rng.randrange(80, 200)), "en", f"s{i % 5}", 0) for i in range(300)]
    rows += [(1000 + i, " ".join([rng.choice(words)] * 150), "en", "s1", 0) for i in range(40)]
    rows += [(2000, rows[3][1], "en", "s1", 0), (2001, passage, "en", "s2", 0), (2002, prose(120) + " password=Zx81kQm29aLp44 " + prose(20), "en", "s3", 0), (None, None, None, None, None)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, 0) for i in range(0, 300, 2)] + [(1000 + i, 0, 0) for i in range(40)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, passage)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    before = docs
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, str(tmp_path))
        if k < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == before.columns, name
            out.write.parquet(f"{tmp_path}/out{k}")
            docs = spark.read.parquet(f"{tmp_path}/out{k}")
        ids = {r.doc_id for r in out.select("doc_id").distinct().collect()}
        if k == 0:
            assert not {i for i in ids if i is not None and 1000 <= i < 1040} and len([i for i in ids if i is not None and i < 300]) > 290
        if k == 1:
            assert 2000 not in ids and (3 in ids)
        if k == 2:
            assert 2001 not in ids and 2002 in ids
        if k == 3:
            assert "Zx81kQm29aLp44" not in {r.doc_id: r.text for r in out.collect()}[2002]
    got = corpus_pipeline.run(spark, str(tmp_path))
    assert {r.doc_id for r in got.select("doc_id").distinct().collect()} == ids
    assert {m.__name__.split(".")[-1] for m in (quality, simhash, decontaminate, secrets)} and got.count() > 290


def test_empty_documents(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, "a b c")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
