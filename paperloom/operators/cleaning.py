"""Picture-block cleaning, watermarks and the page quality gate."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperloom.functions.text import line_key, lines, plain
from paperloom.operators.tables import table_check, text_tables

# Marker phrases and limits: fixed values.
PICTURE = r"(?is)<!--\s*Start of picture text\s*-->(.*?)<!--\s*End of picture text\s*-->"
OBVIOUS = ("protected by copyright", "copyright by volkswagen", "volkswagen ag does not", "volkswagenagdoesnot", "copyright")
RESIDUAL = ("protected by copyright", "copyright by volkswagen", "volkswagenagdoesnot", "does not guarantee or accept any liability")
REPEATED_LENGTH, REPEATED_COUNT = 24, 3
ROTATED_DEGREES, ROTATED_COUNT = 8.0, 20
BLOCK = r"(?is)<!--\s*Start of picture text\s*-->.*?<!--\s*End of picture text\s*-->"
BLOCK_BEGIN, BLOCK_END = "<!-- Start of picture text -->\n", "\n<!-- End of picture text -->"
MARKDOWN = "markdown"
WARNINGS = ("corrupted_text", "failed_table", "low_quality_table", "ocr_used", "parser_failed", "parser_fallback", "watermark_in_text")  # in order


def _any_phrase(text: Column, phrases: tuple[str, ...]) -> Column:
    return reduce(lambda a, b: a | b, (F.contains(F.lower(text), F.lit(p)) for p in phrases))


def obvious_watermark(line: Column) -> Column:
    return _any_phrase(line, OBVIOUS)


def residual_watermark(text: Column) -> Column:
    return _any_phrase(text, RESIDUAL)


def picture_blocks(text: Column) -> Column:
    """Plain non-empty lines of each picture block, in order."""
    blocks = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(PICTURE), F.lit(1))
    return F.transform(blocks, lambda b: F.filter(F.transform(lines(F.regexp_replace(b, r"<br/?>", "\n")), plain), lambda x: x != ""))


def picture_lines(text: Column) -> Column:
    """Plain lines of all picture blocks, in order."""
    return F.flatten(picture_blocks(text))


def exploded_lines(pages: DataFrame, key: str = "document_id") -> DataFrame:
    """(document, page, pos, line, key) of picture lines."""
    rows = pages.select(key, "page", F.posexplode(picture_lines(F.col("text"))).alias("pos", "line"))
    return rows.withColumn("line_key", line_key(F.col("line")))


def repeated_keys(rows: DataFrame, key: str = "document_id", least: int = REPEATED_COUNT, longest: int = REPEATED_LENGTH) -> DataFrame:
    """Keys of short lines that occur `least` times in a document."""
    short = rows.where((F.col("line_key") != "") & (F.length("line") <= longest))
    return short.groupBy(key, "line_key").agg(F.count("*").alias("n")).where(F.col("n") >= least)


def rotation(dx: Column, dy: Column) -> Column:
    return F.degrees(F.atan2(dy, dx))


def geometry_keys(spans: DataFrame, key: str = "document_id") -> DataFrame:
    """spans (document, page, text, dx, dy): on pages with twenty or more lines
    turned by more than eight degrees, the distinct keys of those lines."""
    turned = spans.withColumn("line_key", line_key(plain(F.col("text")))).where((F.abs(rotation(F.col("dx"), F.col("dy"))) > ROTATED_DEGREES) & (F.col("line_key") != ""))
    pages = turned.groupBy(key, "page").count().where(F.col("count") >= ROTATED_COUNT).select(key, "page")
    return turned.join(pages, [key, "page"], "left_semi").select(key, "page", "line_key").distinct()


def turned_lines(spans: DataFrame, key: str = "document_id") -> DataFrame:
    """(document, pages, turned): how many pages have turned lines to redact,
    and how many such lines there are."""
    turned = spans.where((F.abs(rotation(F.col("dx"), F.col("dy"))) > ROTATED_DEGREES) & (plain(F.col("text")) != "")).groupBy(key, "page").agg(F.count("*").alias("n"))
    return turned.where(F.col("n") >= ROTATED_COUNT).groupBy(key).agg(F.count("*").alias("pages"), F.sum("n").alias("turned"))


def watermark_region(elements: DataFrame, key: str = "document_id") -> DataFrame:
    """Bounding box of the turned elements of a page that has twenty or more."""
    turned = elements.where(F.abs(F.col("angle")) > ROTATED_DEGREES)
    box = turned.groupBy(key, "page").agg(F.count("*").alias("n"), F.min("x0").alias("rx0"), F.min("y0").alias("ry0"), F.max("x1").alias("rx1"), F.max("y1").alias("ry1"))
    return box.where(F.col("n") >= ROTATED_COUNT)


def outside_region(elements: DataFrame, regions: DataFrame, key: str = "document_id", short: int = 5) -> DataFrame:
    """Elements that are neither turned nor short with their centre in the region."""
    cx, cy = (F.col("x0") + F.col("x1")) / 2, (F.col("y0") + F.col("y1")) / 2
    joined = elements.join(regions.drop("n"), [key, "page"], "left")
    inside = F.coalesce(cx.between(F.col("rx0"), F.col("rx1")) & cy.between(F.col("ry0"), F.col("ry1")), F.lit(False))
    return joined.where((F.abs(F.col("angle")) <= ROTATED_DEGREES) & ~(inside & (F.length("text") <= short))).drop("rx0", "ry0", "rx1", "ry1")


def line_fate(geometry: Column, repeated: Column, line: Column) -> Column:
    """watermark before noise: the first rule that holds decides."""
    return F.when(geometry, "geometry_watermark").when(obvious_watermark(line), "watermark").when(repeated, "repeated_watermark").when((F.length(line) <= 2) & ~line.rlike("[0-9]"), "image_noise").otherwise("kept")


def judged_lines(rows: DataFrame, repeated: DataFrame, geometry: DataFrame | None = None, key: str = "document_id") -> DataFrame:
    """Each picture line with its fate."""
    out = rows.join(repeated.select(key, "line_key", F.lit(True).alias("_r")), [key, "line_key"], "left")
    if geometry is not None:
        out = out.join(geometry.select(key, "page", "line_key", F.lit(True).alias("_g")), [key, "page", "line_key"], "left")
    else:
        out = out.withColumn("_g", F.lit(False))
    fate = line_fate(F.coalesce("_g", F.lit(False)), F.coalesce("_r", F.lit(False)), F.col("line"))
    return out.withColumn("fate", fate).drop("_r", "_g")


def kept_lines(judged: DataFrame, key: str = "document_id") -> DataFrame:
    """Kept lines of each page in order, and counts of what went."""
    kept = F.filter(F.array_sort(F.collect_list(F.struct("pos", "line", "fate"))), lambda x: x["fate"] == "kept")
    return judged.groupBy(key, "page").agg(
        F.array_join(F.transform(kept, lambda x: x["line"]), "\n").alias("text"), F.count_if(F.col("fate").endswith("watermark")).alias("watermark_removed"),
        F.count_if(F.col("fate") == "image_noise").alias("image_internal_text_removed"), F.count_if(F.col("fate") == "kept").alias("kept"),
    )


def cleaned_pages(pages: DataFrame, geometry: DataFrame | None = None, key: str = "document_id") -> DataFrame:
    """Every page with its text, in which only picture blocks are changed: the
    lines that are kept stay in their block, and a block without any goes; plus
    raw_chars and counts of what went.

    Which keys are repeated, or turned on a page, is joined by key to the
    distinct keys of the page's own lines, so a page meets no other page's keys
    and a page without picture blocks takes no part in it.  A (document, page)
    pair stands for one page; null text is empty."""
    pages = pages.withColumn("text", F.coalesce("text", F.lit("")))
    rows = exploded_lines(pages, key)
    own = rows.select(key, "page", "line_key").distinct()
    bad = own.join(repeated_keys(rows, key).select(key, "line_key", F.lit("r").alias("why")), [key, "line_key"]).select(key, "page", "line_key", "why")
    if geometry is not None:
        bad = bad.unionByName(own.join(geometry.select(key, "page", "line_key", F.lit("g").alias("why")), [key, "page", "line_key"]).select(key, "page", "line_key", "why"))
    found = bad.groupBy(key, "page").agg(*[F.collect_set(F.when(F.col("why") == w, F.col("line_key"))).alias(w) for w in "rg"])  # keys of one page's lines
    joined = pages.join(found.select(F.col(key).alias("_d"), F.col("page").alias("_p"), "r", "g"), F.col(key).eqNullSafe(F.col("_d")) & F.col("page").eqNullSafe(F.col("_p")), "left")
    none = F.array().cast("array<string>")
    has = lambda keys, x: F.array_contains(F.coalesce(keys, none), line_key(x))
    fates = F.transform(picture_blocks(F.col("text")), lambda b: F.transform(b, lambda x: F.struct(x.alias("line"), line_fate(has(F.col("g"), x), has(F.col("r"), x), x).alias("fate"))))
    judged = joined.withColumn("_b", fates)
    kept = F.transform("_b", lambda b: F.transform(F.filter(b, lambda x: x["fate"] == "kept"), lambda x: x["line"]))
    again = F.transform(kept, lambda b: F.when(F.size(b) == 0, "").otherwise(F.concat(F.lit(BLOCK_BEGIN), F.array_join(b, "\n"), F.lit(BLOCK_END))))
    text = F.array_join(F.flatten(F.transform(F.arrays_zip(F.split("text", BLOCK, -1).alias("gap"), again.alias("block")), lambda z: F.array(z["gap"], F.coalesce(z["block"], F.lit(""))))), "")
    n = lambda test: F.size(F.filter(F.flatten("_b"), lambda x: test(x["fate"])))
    counted = {"watermark_removed": n(lambda f: f.endswith("watermark")), "geometry_watermark_removed": n(lambda f: f == "geometry_watermark"), "image_internal_text_removed": n(lambda f: f == "image_noise")}
    return judged.withColumns({"raw_chars": F.length("text"), **counted, "text": text}).drop("_b", "_d", "_p", "r", "g")


def page_warnings() -> Column:
    """Over parsing (status, strategy, selected_replacement_ratio, ocr_used),
    text and table_quality."""
    failed = F.col("parsing.status") == "failed"
    rules = [
        (F.col("parsing").isNotNull() & ~F.col("parsing.strategy").eqNullSafe(F.lit(MARKDOWN)), "parser_fallback"), (F.col("parsing.ocr_used"), "ocr_used"), (failed, "parser_failed"), (failed & (F.col("parsing.selected_replacement_ratio") > 0), "corrupted_text"),
        (residual_watermark(F.col("text")), "watermark_in_text"), (F.col("table_quality") == "warning", "low_quality_table"), (F.col("table_quality") == "failed", "failed_table"),
    ]
    return F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), name) for c, name in rules]))


def gate(warnings: Column) -> Column:
    stop = F.array(F.lit("parser_failed"), F.lit("watermark_in_text"), F.lit("failed_table"))
    return F.when(F.arrays_overlap(warnings, stop), "quarantine").when(F.size(warnings) > 0, "warning").otherwise("pass")


def process_pages(pages: DataFrame, geometry: DataFrame | None = None, table_pages: DataFrame | None = None, key: str = "document_id") -> DataFrame:
    """pages (document, page, text, parsing): cleaned, checked and gated, one row
    for each.  geometry: geometry_keys(); table_pages: (document, page,
    selected_status) of the pages where a table was extracted."""
    out = cleaned_pages(pages, geometry, key)
    marked = [(geometry.select(key, "page").distinct() if geometry is not None else None, "geometry_watermark_detected"), (table_pages.select(key, "page").distinct() if table_pages is not None else None, "table_detected")]
    for have, name in marked:
        out = out.withColumn(name, F.lit(False)) if have is None else out.join(have.withColumn(name, F.lit(True)), [key, "page"], "left").withColumn(name, F.coalesce(name, F.lit(False)))
    if table_pages is None:
        out = out.withColumn("table_quality", F.lit(None).cast("string"))
    else:
        out = out.join(table_pages.groupBy(key, "page").agg(F.first("selected_status").alias("table_quality")), [key, "page"], "left")
    checks = F.transform(text_tables(F.col("text")), table_check)
    out = out.withColumns({"_t": checks, "watermark_in_text": residual_watermark(F.col("text")), "image_internal_text_detected": F.col("image_internal_text_removed") > 0, "text_chars": F.length("text"), "warnings": page_warnings()})
    return out.withColumns({"table_count": F.size("_t"), "low_quality_tables": F.size(F.filter("_t", lambda t: t["quality"] == "low")), "rag_text_status": gate(F.col("warnings")), "quality": F.when(F.size("warnings") > 0, "warning").otherwise("ok")}).drop("_t")


def document_report(pages: DataFrame, key: str = "document_id") -> DataFrame:
    """Sums over the rows of process_pages() of each document."""
    status = lambda s: F.count_if(F.col("rag_text_status") == s)
    sums = [F.sum(c).alias(c) for c in ("watermark_removed", "geometry_watermark_removed", "image_internal_text_removed", "table_count", "low_quality_tables")]
    fell_back = F.col("parsing.strategy").isNotNull() & (F.col("parsing.strategy") != MARKDOWN)
    return pages.groupBy(key).agg(
        F.count("*").alias("page_count"), status("pass").alias("normal_pages"), status("warning").alias("warning_pages"), status("quarantine").alias("failed_pages"), status("pass").alias("rag_pass_pages"), status("warning").alias("rag_warning_pages"), status("quarantine").alias("quarantine_pages"),
        F.count_if("geometry_watermark_detected").alias("geometry_watermark_pages"), F.count_if("watermark_in_text").alias("watermark_in_text_pages"), *sums, F.count_if(fell_back).alias("parser_fallback_pages"), F.count_if(F.coalesce("parsing.ocr_used", F.lit(False))).alias("ocr_pages"), F.count_if(F.col("parsing.status") == "failed").alias("parser_failed_pages"),
        *[F.max(F.array_contains("warnings", w)).alias(f"_w{i}") for i, w in enumerate(WARNINGS)],
    ).withColumn("warnings", F.array_compact(F.array(*[F.when(F.col(f"_w{i}"), w) for i, w in enumerate(WARNINGS)]))).drop(*[f"_w{i}" for i in range(len(WARNINGS))])
