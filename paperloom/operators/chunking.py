"""Chunks of sections, and the greedy packer of pages."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType
from pyspark.sql.window import Window

from paperloom.functions.text import lines, loose_key
from paperloom.operators.ranking import chunk_profile
from paperloom.operators.sizing import mapped

SIZE, OVERLAP = 1800, 200
#: Split points in order of preference, and titles that are not indexed: fixed values.
SEPARATORS = (r"\n(?=#{4,6}[ \t]+)", r"\n{2,}", r"\n", "。", r"\. ", " ", "")
NAVIGATION = ("contents", "table of contents", "test your knowledge")
PARSER, SPLITTER = "paperloom", "recursive_character"
HEADING = r"(?mUd)^(#{1,6})\s+(.+?)\s*$"
MARKS = "|*-_`# "


def _pieces(text: str, separator: str) -> list[str]:
    """Text cut before each separator, which begins the next piece."""
    if not separator:
        return list(text)
    cuts = [0, *(m.start() for m in re.finditer(separator, text) if m.start()), len(text)]
    return [text[a:b] for a, b in zip(cuts, cuts[1:], strict=False) if a < b]


def _merged(pieces: list[str], size: int, overlap: int) -> list[str]:
    """Consecutive pieces joined up to size; each chunk begins with up to
    `overlap` characters of the last pieces of the one before."""
    out, held, total = [], [], 0
    for p in pieces:
        if held and total + len(p) > size:
            out.append("".join(held).strip())
            while held and (total > overlap or total + len(p) > size):
                total -= len(held.pop(0))
        held.append(p)
        total += len(p)
    out.append("".join(held).strip())
    return [x for x in out if x]


def recursive_split(text: str, size: int = SIZE, overlap: int = OVERLAP, separators: tuple[str, ...] = SEPARATORS) -> list[str]:
    """The first separator that occurs cuts the text; pieces shorter than size
    are merged, longer ones cut by the separators after it."""
    if size <= 0 or not 0 <= overlap < size:
        raise ValueError("size must be positive and overlap less than it")
    k = next((i for i, s in enumerate(separators) if not s or re.search(s, text)), len(separators) - 1)
    out, small = [], []
    for p in _pieces(text, separators[k]):
        if len(p) < size:
            small.append(p)
            continue
        out += _merged(small, size, overlap) if small else []
        small = []
        out += recursive_split(p, size, overlap, separators[k + 1 :]) if k + 1 < len(separators) else [p]
    return out + (_merged(small, size, overlap) if small else [])


def splitter(size: int = SIZE, overlap: int = OVERLAP):
    @F.arrow_udf(ArrayType(StringType()))
    def run(texts: pa.Array) -> pa.Array:
        return mapped(texts, lambda t: recursive_split(t or "", size, overlap), pa.list_(pa.string()))

    return run


def found_subheadings(text: Column, known: Column) -> Column:
    """Known subheadings that occur as headings of text, in their own spelling."""
    heads = F.transform(F.regexp_extract_all(text, F.lit(HEADING), F.lit(2)), lambda x: F.lower(F.btrim(x)))
    spelt = lambda h: F.filter(known, lambda k: F.lower(k) == h)
    canonical = F.transform(heads, lambda h: F.get(spelt(h), F.size(spelt(h)) - 1))
    return F.array_distinct(F.array_compact(canonical))


def meaningful(text: Column, titles: Column) -> Column:
    """Whether, without headings, images and comments, a line is left that,
    stripped of MARKS, is neither a number nor one of the structural titles (of
    the section and its path), and has a letter or digit."""
    bare = F.regexp_replace(F.regexp_replace(F.regexp_replace(text, HEADING, ""), r"!\[[^\]]*\]\([^)]*\)", ""), r"(?s)<!--.*?-->", "")
    known = F.transform(titles, loose_key)
    inner = F.transform(lines(bare), lambda x: F.btrim(F.regexp_replace(x, r"(?U)^\s+|\s+$", ""), F.lit(MARKS)))
    return F.exists(inner, lambda x: x.rlike(r"[\p{L}\p{N}]") & ~x.rlike(r"(?U)^\s*\d+\s*$") & ~F.array_contains(known, loose_key(x)))


def chunk_sections(sections: DataFrame, profiles: DataFrame | None = None, size: int = SIZE, overlap: int = OVERLAP) -> DataFrame:
    """Chunks of each section; none spans two.  profiles: (document_id,
    content_type, metadata_confidence)."""
    empty = F.array().cast("array<string>")
    s = sections.where(~F.lower(F.btrim("title")).isin(*NAVIGATION) & (F.btrim("text") != ""))
    if profiles is not None:
        s = s.join(profiles.select("document_id", F.col("content_type").alias("_type"), F.col("metadata_confidence").alias("_sure")), "document_id", "left")
        s = s.where(F.assert_true(F.col("_type").isNotNull(), F.concat(F.lit("no profile of the document of "), F.col("section_id"))).isNull())
    else:
        s = s.withColumns({"_type": F.lit("other"), "_sure": F.lit(None).cast("double")})
    cut = s.withColumn("_parts", splitter(size, overlap)(F.btrim("text"))).select("*", F.posexplode("_parts").alias("_pos", "chunk")).drop("_parts")
    cut = cut.withColumn("_subs", found_subheadings(F.col("chunk"), F.coalesce("subheadings", empty)))
    w = Window.partitionBy("section_id").orderBy("_pos")
    cut = cut.withColumn("subheading", F.last(F.when(F.size("_subs") > 0, F.element_at("_subs", -1)), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    kept = cut.where(meaningful(F.col("chunk"), F.filter(F.concat(F.array("title"), F.coalesce("path", empty)), lambda t: F.coalesce(t, F.lit("")) != "")))
    kept = kept.withColumn("chunk_index", F.row_number().over(w))
    shown = F.when(F.size("_subs") > 0, F.col("_subs")).when(F.col("subheading").isNotNull(), F.array("subheading")).otherwise(empty)
    return kept.select(
        F.concat("section_id", F.format_string(":c%03d", "chunk_index")).alias("chunk_id"), "document_id", F.col("_type").alias("document_content_type"), F.col("_sure").alias("metadata_confidence"), "section_id", F.col("title").alias("section_title"), F.col("path").alias("section_path"), F.col("level").alias("section_level"),
        F.col("page_start").alias("section_page_start"), F.col("page_end").alias("section_page_end"), "chunk_index", "subheading", F.col("_subs").alias("subheadings"), F.col("chunk").alias("text"), chunk_profile(F.col("_type"), F.coalesce("path", empty), shown, F.col("chunk")).alias("index_text"),
        "quality", "boundary", F.lit(PARSER).alias("parser"), F.lit(SPLITTER).alias("splitter"),
    )


def packed(text: Column, size: int, overlap: int) -> Column:
    """Paragraphs joined while they fit; a new chunk begins with the end of the
    one before.  Chunks may exceed size, and a long paragraph stays whole."""
    parts = F.filter(F.transform(F.split(text, r"\n{2,}"), F.btrim), lambda p: p != "")
    start = F.struct(F.array().cast("array<string>").alias("out"), F.lit("").alias("now"))

    def step(acc: Column, p: Column) -> Column:
        fits = F.length(acc["now"]) + F.length(p) + 2 <= size
        tail = F.when(F.lit(overlap) > 0, F.concat(F.right(acc["now"], F.lit(overlap)), F.lit("\n\n"), p)).otherwise(p)
        return F.when(acc["now"] == "", F.struct(acc["out"].alias("out"), p.alias("now"))).when(fits, F.struct(acc["out"].alias("out"), F.concat(acc["now"], F.lit("\n\n"), p).alias("now"))).otherwise(F.struct(F.concat(acc["out"], F.array(acc["now"])).alias("out"), tail.alias("now")))

    return F.aggregate(parts, start, step, lambda acc: F.when(acc["now"] == "", acc["out"]).otherwise(F.concat(acc["out"], F.array(acc["now"]))))


def chunk_pages(pages: DataFrame, size: int = 1200, overlap: int = 150) -> DataFrame:
    """Chunks of single pages with the last heading seen and a table flag."""
    cut = pages.select("document_id", "page", "table_status", F.posexplode(packed(F.col("text"), size, overlap)).alias("pos", "text"))
    heads = F.filter(lines(F.col("text")), lambda x: x.rlike(r"^#{1,6}[ \t]+\S"))
    last = F.when(F.size(heads) > 0, F.regexp_replace(F.element_at(heads, -1), r"^#{1,6}[ \t]+", ""))
    w = Window.partitionBy("document_id").orderBy("page", "pos").rowsBetween(Window.unboundedPreceding, 0)
    flag = F.when(F.col("table_status").isin("warning", "failed", "low"), "raw_text_preserved")
    return cut.select("document_id", "page", (F.col("pos") + 1).alias("chunk_index"), "text", F.last(last, ignorenulls=True).over(w).alias("heading"), flag.alias("table_fallback"))
