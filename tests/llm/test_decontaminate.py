import hashlib
import random
import re

from paperloom.llm import decontaminate

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def brute(text, items):
    words = WORD.findall(lower(text))
    hit, found = set(), set()
    for item_id, item in items:
        w = WORD.findall(lower(item))
        if item_id is None or not w:
            continue
        for k in range(max(1, len(w) - 12)):
            window = w[k : k + 13]
            for i in range(len(words) - len(window) + 1):
                if words[i : i + len(window)] == window:
                    hit.update(range(i, i + len(window)))
                    found.add(str(item_id))
    digest = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
    return len(words), len(hit), len(found), digest, bool(hit) and 20 * len(hit) >= len(words)


def fixture():
    rng = random.Random(2)
    vocabulary = [f"w{i}" for i in range(6)] + ["été", "日本"]
    items = [(i, " ".join(rng.choices(vocabulary, k=rng.choice([1, 5, 12, 13, 14, 30])))) for i in range(25)]
    items += [(100, None), (None, "w1 w2"), (101, ""), (102, "!!"), (103, items[3][1]), (3, "another Text; of-three"), (104, "zzz unique")]
    docs = []
    for i in range(120):
        parts = [" ".join(rng.choices([*vocabulary, "noise", "filler"], k=rng.randrange(0, 200)))]
        if i % 3 == 0:
            parts.insert(rng.randrange(2), rng.choice(items[:25])[1].upper().replace(" ", ", "))
        docs.append((i, "\n".join(parts)))
    docs += [(500, None), (501, ""), (502, "?!"), (500, None), (None, items[0][1]), (503, ("clean words only " * 5000) + items[10][1])]
    return docs, items


def test_report_equals_brute_force(spark):
    docs, items = fixture()
    d = spark.createDataFrame([(i, t, "x") for i, t in docs], "doc_id long, text string, hits string")
    b = spark.createDataFrame(items, "item_id long, text string")
    want = sorted(((i, *brute(t, items)) for i, t in docs), key=str)
    assert sorted((tuple(r) for r in decontaminate.report(d, b).collect()), key=str) == want


def test_blocks_give_the_same(spark):
    docs, items = fixture()
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    key = lambda df: sorted((str(r) for r in df.collect()))
    assert len(list(decontaminate.item_blocks(b, block_bytes=200))) > 2
    assert key(decontaminate.scan(d, b, block_bytes=200)) == key(decontaminate.scan(d, b))


def test_spans_are_offsets_of_the_original(spark):
    text = "Début… AAA  bbb,CCC! fin"
    d, b = spark.createDataFrame([(1, text)], "doc_id long, text string"), spark.createDataFrame([(7, "aaa BBB ccc")], "item_id long, text string")
    row = decontaminate.scan(d, b).first()
    assert [text[s.start : s.end] for s in row.spans] == ["AAA  bbb,CCC"] and row["items"] == ["7"]


def test_stage_drops_and_cuts(spark):
    passage = " ".join(f"k{i}" for i in range(13))
    rows = [(1, passage + " tail", "en"), (2, "word " * 400 + passage + " end", "en"), (3, "clean text", None), (4, None, "fr")]
    d, b = spark.createDataFrame(rows, "doc_id long, text string, lang string"), spark.createDataFrame([(1, passage)], "item_id long, text string")
    got = {r.doc_id: r for r in decontaminate.decontaminate(d, b).collect()}
    assert set(got) == {2, 3, 4} and got[2].text == "word " * 400 + " end" and got[3].text == "clean text" and got[4].text is None


def test_empty_tables(spark):
    d, b = spark.createDataFrame([(1, "a")], "doc_id long, text string"), spark.createDataFrame([], "item_id long, text string")
    assert [r.n_hit for r in decontaminate.report(d, b).collect()] == [0]
    assert decontaminate.report(d.limit(0), b).count() == 0


def test_stage_is_the_same_with_any_block_size(spark):
    """Hits of several blocks add up to one decision, on the original text."""
    one, two = (" ".join(f"{c}{i}" for i in range(13)) for c in "ab")
    shared = " ".join([*(f"c{i}" for i in range(14)), *(f"d{i}" for i in range(13))])
    words = shared.split()
    items = [(1, one), (2, two), (3, " ".join(words[:20])), (4, " ".join(words[7:]))]
    rows = [(1, "word " * 400 + one + " mid " + two + " end", "x"), (2, "word " * 900 + one + " mid " + two + " end", "x"), (3, "word " * 900 + shared + " end", None), (4, None, "x")]
    fix_docs, fix_items = fixture()
    rows += [(1000 + (i or 0), t, "x") for i, t in fix_docs]
    d = spark.createDataFrame(rows, "doc_id long, text string, hits string")
    b = spark.createDataFrame(items + [(i and i + 1000, t) for i, t in fix_items], "item_id long, text string").coalesce(1)
    assert len(list(decontaminate.item_blocks(b, block_bytes=30))) > 3
    key = lambda df: sorted(str(r) for r in df.collect())
    got = decontaminate.decontaminate(d, b, block_bytes=30)
    assert got.columns == d.columns and key(got) == key(decontaminate.decontaminate(d, b))
    by_id = {r.doc_id: r.text for r in got.where("doc_id < 1000").collect()}
    assert by_id == {2: "word " * 900 + " mid  end", 3: "word " * 900 + " end", 4: None}
    assert {r.doc_id for r in decontaminate.report(d, b).where("contaminated and doc_id < 1000").collect()} == {1}


def test_duckdb_twin(spark, tmp_path):
    import duckdb

    docs, items = fixture()
    spark.createDataFrame([r for r in docs if r[0] is not None], "doc_id long, text string").write.parquet(str(tmp_path / "documents"))
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark"))
    con = duckdb.connect()
    for name in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}/*.parquet'")
    got = decontaminate.report(*(spark.read.parquet(str(tmp_path / n)) for n in ("documents", "benchmark")))
    want = con.execute(decontaminate.oracle())
    assert got.columns == [c[0] for c in want.description]
    assert sorted((tuple(r) for r in got.collect()), key=str) == sorted(want.fetchall(), key=str)


def test_null_ids_and_columns_of_any_name(spark):
    passage = " ".join(f"k{i}" for i in range(13))
    rows = [(None, "word " * 400 + passage, 1, "a"), (None, passage, 2, "b"), (1, None, 3, "c")]
    d = spark.createDataFrame(rows, "doc_id long, text string, hits int, items string")
    b = spark.createDataFrame([(1, passage, "x")], "item_id long, text string, doc_id string")
    got = {r.hits: r for r in decontaminate.decontaminate(d, b).collect()}
    assert set(got) == {1, 3} and got[1].text == "word " * 400 and got[1]["items"] == "a"
    assert decontaminate.decontaminate(d.limit(0), b).count() == 0
