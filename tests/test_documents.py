"""Literal cases of page selection, cleaning, tables, sections and chunks."""

import pytest
from pyspark.sql import functions as F

from paperloom.functions import text as T
from paperloom.operators import chunking, cleaning, sections, tables


def test_replacement_ratio_and_guards(spark):
    df = spark.createDataFrame([("abc��",), ("",), (None,), ("a �",)], "t string")
    assert [round(r[0], 4) for r in df.select(T.replacement_ratio(F.col("t"))).collect()] == [0.4, 0.0, 0.0, 0.5]
    with pytest.raises(ValueError):
        T.select_page(1.1)


def test_page_ladder(spark):
    rows = [("# Good\nprose", "prose", None, None), ("�" * 90 + " word", "clean text", None, None), ("", "", "scanned", None), ("", "", None, "E" * 300), ("", "", " ", None), ("�" * 9 + "ab", "", None, None), ("", "only direct", None, None)]
    df = spark.createDataFrame(rows, "markdown_text string, direct_text string, ocr_text string, ocr_error string")
    got = df.select(*[c.alias(n) for n, c in T.select_page().items()]).collect()
    assert [(r.strategy, r.status, r.fallback_reason) for r in got] == [
        ("markdown", "complete", None), ("plain_text", "complete", "markdown_replacement_ratio"), ("ocr", "complete", "no_extractable_text"), ("ocr", "failed", "no_extractable_text"),
        ("ocr", "failed", "ocr_returned_no_text"), ("markdown", "failed", "selected_text_replacement_ratio"), ("plain_text", "complete", "markdown_empty"),
    ]
    assert len(got[3].ocr_error) == 240 and got[3].text == ""


def test_text_helpers(spark):
    row = spark.createDataFrame([("Hello, 世界 A1! Straße",)], "t string").select(
        T.tokens(F.col("t")).alias("tok"), T.language(F.col("t")).alias("l"), T.title_key(F.col("t")).alias("k"), T.line_key(F.col("t")).alias("lk"), T.clean_title(F.lit("  ## A   title ## ")).alias("c"), T.plain(F.lit("<b>a</b>\n b")).alias("p"),
        T.redacted(F.lit("x"), "document").alias("r"), F.length(T.redacted(F.lit("y" * 300), "question")).alias("n"), T.table_tokens(F.lit("ab a AB 12")).alias("tt"), F.size(T.lines(F.lit("a\x0cb\u2028c\r\nd"))).alias("ln"),
    ).first()
    assert row.tok == ["hello", "世", "界", "a1", "stra", "e"] and row.l == "zh" and row.k == "hello世界a1strasse" and row.lk == "helloa1strae"
    assert (row.c, row.p, row.r, row.n, row.tt, row.ln) == ("A title", "a b", "[redacted]", 257, ["ab", "12"], 4)


def picture(*lines):
    return "before <!-- Start of picture text -->" + "<br>".join(lines) + "<!-- End of picture text --> after"


PARSING = "struct<status:string,strategy:string,selected_replacement_ratio:double,ocr_used:boolean>"
FINE = ("complete", "markdown", 0.0, False)


def raw_pages(spark, *rows):
    return spark.createDataFrame([(d, p, t, x, "clash") for d, p, t, x in rows], f"document_id string, page int, text string, parsing {PARSING}, kept string")


def test_repeat_rule_beats_noise_rule(spark):
    pages = raw_pages(spark, *[("D", p, picture(f"Caption {p} long", "Protected by copyright", "x"), FINE) for p in (1, 2, 3)])
    got = cleaning.cleaned_pages(pages).orderBy("page").collect()
    assert [r.text for r in got] == [f"before <!-- Start of picture text -->\nCaption {p} long\n<!-- End of picture text --> after" for p in (1, 2, 3)]
    assert sum(r.watermark_removed for r in got) == 6 and sum(r.image_internal_text_removed for r in got) == 0


def test_page_text_is_kept(spark):
    whole = "# Head\nBody prose.\n" + picture("a caption").removeprefix("before ") + "\nTail. " + picture("copyright", "ab") + picture() + "\n"
    got = {r.page: r for r in cleaning.cleaned_pages(raw_pages(spark, ("D", 1, whole, FINE), ("D", 2, "no block $1 \\ here", FINE), ("D", 3, None, None), (None, None, "loose", FINE))).collect()}
    assert len(got) == 4 and got[2].text == "no block $1 \\ here" and got[3].text == "" and got[None].text == "loose"
    assert got[1].text == "# Head\nBody prose.\n<!-- Start of picture text -->\na caption\n<!-- End of picture text --> after\nTail. before  afterbefore  after\n"
    assert (got[1].watermark_removed, got[1].image_internal_text_removed, got[1].raw_chars) == (1, 1, len(whole))
    assert cleaning.cleaned_pages(raw_pages(spark, ("D", 1, "x", FINE)).limit(0)).count() == 0


def test_noise_digits_and_geometry(spark):
    pages = raw_pages(spark, ("D", 1, picture("ab", "a1", "Rotated mark"), FINE), ("D", 2, picture("Rotated mark"), FINE))
    spans = spark.createDataFrame([("D", 1, "Rotated mark", 1.0, 1.0)] * 20 + [("D", 2, "Level", 1.0, 0.0)] * 30 + [("D", 3, "Few", 1.0, 1.0)] * 19, "document_id string, page int, text string, dx double, dy double")
    keys = cleaning.geometry_keys(spans)
    assert [(r.page, r.line_key) for r in keys.collect()] == [(1, "rotatedmark")]
    assert [(r.pages, r.turned) for r in cleaning.turned_lines(spans).collect()] == [(1, 20)]
    fates = {(r.page, r.line): r.fate for r in cleaning.judged_lines(cleaning.exploded_lines(pages), cleaning.repeated_keys(cleaning.exploded_lines(pages)), keys).collect()}
    assert fates == {(1, "ab"): "image_noise", (1, "a1"): "kept", (1, "Rotated mark"): "geometry_watermark", (2, "Rotated mark"): "kept"}
    got = {r.page: r for r in cleaning.process_pages(pages, keys).collect()}
    assert (got[1].geometry_watermark_removed, got[1].watermark_removed, got[1].image_internal_text_removed, got[1].geometry_watermark_detected) == (1, 1, 1, True)
    assert "Rotated mark" in got[2].text and not got[2].geometry_watermark_detected


def test_gate_and_document_report(spark):
    poor = "| a | b | c |\n|---|---|---|\n| 1 | 2 | 3 |\n"
    rows = [
        ("D", 1, "fine\n" + poor, FINE), ("D", 2, "fine", ("complete", "plain_text", 0.0, False)), ("D", 3, "fine", ("failed", "ocr", 0.5, True)),
        ("D", 4, "protected by COPYRIGHT", FINE), ("D", 5, "t", FINE), ("D", 6, "no provenance", None), ("D", 7, "t", FINE),
    ]
    extracted = spark.createDataFrame([("D", 5, "failed"), ("D", 7, "warning")], "document_id string, page int, selected_status string")
    pages = cleaning.process_pages(raw_pages(spark, *rows), table_pages=extracted)
    got = {r.page: r for r in pages.collect()}
    assert [got[i].rag_text_status for i in range(1, 8)] == ["pass", "warning", "quarantine", "quarantine", "quarantine", "pass", "warning"]
    assert got[3].warnings == ["parser_fallback", "ocr_used", "parser_failed", "corrupted_text"] and got[1].low_quality_tables == got[1].table_count == 1 and got[5].table_detected and not got[1].table_detected
    r = cleaning.document_report(pages).first()
    assert (r.page_count, r.normal_pages, r.warning_pages, r.failed_pages, r.parser_fallback_pages, r.ocr_pages, r.parser_failed_pages, r.watermark_in_text_pages, r.table_count, r.low_quality_tables) == (7, 2, 2, 3, 2, 1, 1, 1, 1, 1)
    assert r.warnings == ["corrupted_text", "failed_table", "low_quality_table", "ocr_used", "parser_failed", "parser_fallback", "watermark_in_text"]


def test_watermark_region(spark):
    rows = [("D", 1, "wm", 45.0, float(i), float(i), float(i + 1), float(i + 1)) for i in range(25)] + [("D", 1, "tiny", 0.0, 5.0, 5.0, 6.0, 6.0), ("D", 1, "long enough", 0.0, 5.0, 5.0, 6.0, 6.0), ("D", 1, "far", 0.0, 99.0, 99.0, 100.0, 100.0)]
    e = spark.createDataFrame(rows, "document_id string, page int, text string, angle double, x0 double, y0 double, x1 double, y1 double")
    assert sorted(r.text for r in cleaning.outside_region(e, cleaning.watermark_region(e)).collect()) == ["far", "long enough"]


def test_page_tables(spark):
    md = "| Name | Value | Unit |\n|---|---|---|\n| Pressure | Twelve | Millibar |\n"
    poor = "| a | b | c |\n|---|---|---|\n| 1 | 2 | 3 |\n"
    html = "<table><tr><td>One <b>thing</b></td></tr></table>"
    pages = spark.createDataFrame([("D", 1, md), ("D", 2, poor + "\n" + html), ("D", 3, "| no separator |\n| so no table |\n")], "document_id string, page int, text string")
    got = {r.table_id: r.check for r in tables.page_tables(pages).collect()}
    assert got["p1_t1"].quality == "good" and got["p1_t1"].columns == 3
    assert len(got) == 3 and got["p1_t1"].rows == 2
    assert got["p2_t1"].reasons == ["fragmented_cells"] and got["p2_t2"].reasons == ["single_column"]


def test_candidate_quality(spark):
    full = [["Name", "Value", "Unit"], ["Pressure", "Twelve", "Millibar"], ["Torque", "Thirty", "Newton"]]
    holed = [["Name", "Value", "Unit"], ["Pressure", None, "Millibar"], ["Torque", " ", "Newton"]]
    words = [c for r in full for c in r]
    df = spark.createDataFrame([(full, words, []), (holed, ["mark"] * 3 + words, ["watermark"]), ([["a"]], ["a"], []), ([[], []], ["a"], [])], "rows array<array<string>>, words array<string>, keys array<string>")
    a, b, c, d = (r[0] for r in df.select(tables.candidate_quality(F.col("rows"), F.col("words"), F.col("keys"))).collect())
    assert a.score >= 0.8 and a.quality == "good" and (a.consistency, a.empty_ratio, a.coverage, a.watermark_rate, a.reasons) == (1.0, 0.0, 1.0, 0.0, [])
    assert b.score < a.score and b.quality in ("warning", "failed") and "watermark_contamination" in b.reasons
    for void, reason in ((c, "fewer_than_two_rows"), (d, "no_columns")):
        assert (void.score, void.quality, void.consistency, void.empty_ratio, void.short_ratio, void.coverage, void.watermark_rate, void.reasons) == (0.0, "failed", 0.0, 1.0, 1.0, 0.0, 0.0, [reason])


def test_meaningful_body(spark):
    cases = [("#### Sub\nSub", True), ("| 12 |", False), ("Page 12", True), ("# Engine\n**Engine**", False), ("chapter", False), ("![x](y) <!-- c -->", False), ("--- \n `7` ", False), ("a body", True), ("", False), (None, None)]
    df = spark.createDataFrame(cases, "t string, want boolean")
    for r in df.select("t", "want", chunking.meaningful(F.col("t"), F.array(F.lit("Engine"), F.lit("Chapter"))).alias("got")).collect():
        assert r.want is None or r.got is r.want, r


def test_redaction_of_traces(spark):
    row = spark.createDataFrame([({"query": "secret question", "Text": "x", "tokens": "12"}, ["a" * 300] * 30)], "m map<string,string>, a array<string>").select(T.redacted_map(F.col("m")).alias("m"), T.redacted_items(F.col("a")).alias("a"), T.redacted(F.lit("v"), "QUERY").alias("q"), T.redacted(F.lit("v"), "query_id").alias("i")).first()
    assert row.m == {"query": "[redacted]", "Text": "[redacted]", "tokens": "12"} and len(row.a) == 20 and row.a[0] == "a" * 256 + "…" and (row.q, row.i) == ("[redacted]", "v")


PAGE = "document_id string, page int, text string, toc_items array<struct<level:int,title:string,page:int>>, post_processing struct<rag_text_status:string,table_quality:string>, title string"


def page(number, text, toc=None, status="pass", document="D", tables=None):
    return (document, number, text, toc, (status, tables), "clashing name")


def split(spark, *pages):
    return sections.split_sections(spark.createDataFrame(list(pages), PAGE)).orderBy("section_id").collect()


def test_sections_span_pages_and_keep_labels(spark):
    (s,) = split(spark, page(1, "# Engine\nFirst."), page(2, "More prose.\n##### Detail\ntext"))
    assert (s.title, s.page_start, s.page_end, s.subheadings, s.boundary.confidence, s.section_id) == ("Engine", 1, 2, ["Detail"], 0.8, "D:s0001")
    assert s.text == "# Engine\n\nFirst.\n\nMore prose.\n\n##### Detail\n\ntext"
    (s,) = split(spark, page(1, "### Injection\nA.\n##### Pump\nB.\n##### Rail\nC."))
    assert s.subheadings == ["Pump", "Rail"] and s.level == 3


def test_toc_gives_paths_and_rebases(spark):
    toc = [(1, "Chapter one", 1), (2, "Cooling system", 1), (1, "Chapter two", 3), (2, "Cooling system", 1), (0, "not a level", 1), (1, " ## ", 2), (1, "no page", None)]
    got = split(spark, page(1, "## Cooling system\nWater.", toc), page(2, "### Pump\nIt pumps."), page(4, "### Pump\nAgain."))
    assert [(s.path, s.boundary.source) for s in got] == [(["Chapter one", "Cooling system"], "pdf_toc+markdown"), (["Chapter one", "Cooling system", "Pump"], "markdown_heading"), (["Chapter two", "Pump"], "markdown_heading")]
    assert got[0].boundary.confidence == 1.0 and got[0].level == 2


def test_similar_titles_match_the_nearest_entry(spark):
    toc = [(1, "Engine control unit", 1), (1, "Engine control units", 3), (2, "Something else", 3)]
    got = split(spark, page(1, "prose", toc), page(3, "## Engine  Control Unit\ntext"), page(9, "## Engine control unit\nfar"))
    assert [(s.title, s.path, s.boundary.source) for s in got[1:2]] == [("Engine Control Unit", ["Engine control unit"], "pdf_toc+markdown")]
    assert len(got) == 2 and got[1].text.endswith("far")  # a running header long after its entry


def test_plain_chapter_quarantine_and_masking(spark):
    toc = [(1, "Brakes", 1)]
    got = split(spark, page(1, "Brakes\nText of it.", toc), page(2, "lost", status="quarantine"), page(3, "<!-- Start of picture text --># No heading<!-- End of picture text -->\nTail"))
    assert [(s.title, s.boundary.confidence, s.boundary.page) for s in got] == [("Brakes", 0.95, 1), ("Document introduction", 0.5, None)]
    assert "No heading" in got[1].text and got[0].page_end == 1 and got[1].page_start == 3
    for bad in (" ", None, "a/b"):
        with pytest.raises(Exception, match="not a document id"):
            split(spark, page(1, "x", document=bad))


def test_same_title_under_two_chapters_and_two_documents(spark):
    toc = [(1, "Part A", 1), (1, "Part B", 2)]
    pages = [page(n, f"# Part {c}\n## Overview of parts\nBody {c}.", toc if n == 1 else None, document=d) for d in ("A", "B") for n, c in ((1, "A"), (2, "B"))]
    got = split(spark, *pages)
    assert [s.section_id for s in got] == [f"{d}:s{i:04d}" for d in "AB" for i in (1, 2, 3, 4)]
    assert [s.path for s in got[:4]] == [["Part A"], ["Part A", "Overview of parts"], ["Part B"], ["Part B", "Overview of parts"]]


def test_section_quality_numbers_and_edges(spark):
    rows = [page(1, "# One here\na", status="warning", tables="ok"), page(None, "b\n# ##\n", status=None, tables="failed"), page(2, None), page(3, "", status="odd")]
    (s,) = split(spark, *rows)
    assert (s.quality.rag_text_status, s.quality.table_quality, s.page_start, s.page_end) == ("warning", "failed", 1, 4) and s.text.endswith("# ##")
    assert sections.split_sections(spark.createDataFrame([], PAGE)).count() == 0
    assert split(spark, page(1, "  \n ")) == []
    (s,) = split(spark, page(1, "#### Notes\nlabel first"))
    assert (s.title, s.subheadings) == ("Document introduction", [])


def test_window_plan_paths(spark):
    rows = [("D", 1, 0, None, "intro"), ("D", 1, 1, 1, "Engine"), ("D", 1, 2, None, "x"), ("D", 1, 3, 3, "Valves"), ("D", 2, 0, 2, "Cooling"), ("D", 2, 1, 2, "Notes"), ("D", 2, 2, 1, "Brakes")]
    got = sections.outlined_sections(spark.createDataFrame(rows, "document_id string, page_id int, pos int, level int, text string")).orderBy("section_id").collect()
    assert [r.path for r in got] == [["Document introduction"], ["Engine"], ["Engine", "Valves"], ["Engine", "Cooling"], ["Brakes"]]
    assert got[3].subheadings == ["Notes"]


SECTION = "document_id string, section_id string, title string, path array<string>, level int, page_start int, page_end int, text string, subheadings array<string>, quality struct<rag_text_status:string,table_quality:string>, boundary struct<source:string,confidence:double,page:int>"


def section(i, title, text, subs=()):
    return ("D", f"D:s{i:04d}", title, [title], 1, 1, 1, text, list(subs), ("pass", None), ("markdown_heading", 0.8, 1))


def test_chunks(spark):
    sentences = " ".join(f"Sentence number {i} is here." for i in range(30))
    rows = [section(1, "One", "# One\n" + sentences), section(2, "Two", "# Two\n" + sentences), section(3, "Contents", "a b c"), section(4, "Empty", "# Empty\n12\n![x](y)"), section(5, "Short", "Small body.")]
    got = chunking.chunk_sections(spark.createDataFrame(rows, SECTION), size=180, overlap=20).collect()
    assert {r.section_id for r in got} == {"D:s0001", "D:s0002", "D:s0005"} and all(len(r.text) <= 180 for r in got)
    assert [r.chunk_index for r in got if r.section_id == "D:s0001"] == list(range(1, 1 + sum(r.section_id == "D:s0001" for r in got)))
    assert got[-1].index_text == "Document content type: other document / 其他文档\nSection: Short\nContent: Small body."


def test_subheadings_are_preferred_and_carried(spark):
    block = "word " * 180
    rows = [section(1, "S", f"{block}\n##### Alpha\n{block}\n##### Beta\n{block}", ["Alpha", "Beta"]), section(2, "T", "##### Gamma\n" + "repeat " * 300, ["Gamma"])]
    got = chunking.chunk_sections(spark.createDataFrame(rows, SECTION), size=1200, overlap=100).orderBy("chunk_id").collect()
    first = [r for r in got if r.section_id == "D:s0001"]
    assert len(first) == 3 and first[1].text.startswith("##### Alpha") and first[2].text.startswith("##### Beta")
    second = [r for r in chunking.chunk_sections(spark.createDataFrame(rows[1:], SECTION), size=500, overlap=50).orderBy("chunk_id").collect()]
    assert len(second) > 2 and all(r.subheading == "Gamma" for r in second) and all(r.subheadings == [] for r in second[1:])


def test_greedy_packer(spark):
    df = spark.createDataFrame([("aaaa\n\nbbbb\n\ncccc", "D", 1, "warning"), ("", "D", 2, None)], "text string, document_id string, page int, table_status string")
    assert df.select(chunking.packed(F.col("text"), 10, 2)).first()[0] == ["aaaa\n\nbbbb", "bb\n\ncccc"]
    got = chunking.chunk_pages(df, 10, 2).collect()
    assert [r.table_fallback for r in got] == ["raw_text_preserved"] * 2
