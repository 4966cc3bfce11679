"""Quality of tables in text and of extracted table candidates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from paperloom.functions.text import plain, table_tokens

ROWS = "array<array<string>>"
#: How tables are found in text: fixed values.
MARKDOWN_TABLE = r"(?ms)(?:^|\n)(\|[^\n]+\|\n\|[-:| ]+\|\n(?:\|[^\n]+\|\n?)+)"
HTML_TABLE, HTML_ROW, HTML_CELL = r"(?is)<table\b.*?</table>", r"(?is)<tr\b.*?</tr>", r"(?is)<t[dh]\b.*?</t[dh]>"


def markdown_cells(table: Column) -> Column:
    """Rows of a Markdown table without its separator rows."""
    rows = F.filter(F.split(table, "\n"), lambda r: F.btrim(r).startswith("|") & ~F.btrim(r).rlike(r"^\| ?---"))
    return F.transform(rows, lambda r: F.transform(F.split(F.btrim(F.btrim(r), F.lit("|")), r"\|"), F.btrim))


def html_cells(table: Column) -> Column:
    rows = F.regexp_extract_all(table, F.lit(HTML_ROW), F.lit(0))
    return F.transform(rows, lambda r: F.transform(F.regexp_extract_all(r, F.lit(HTML_CELL), F.lit(0)), plain))


def markdown_tables(text: Column) -> Column:
    """Blocks of lines between bars whose second line is a separator."""
    return F.regexp_extract_all(text, F.lit(MARKDOWN_TABLE), F.lit(1))


def html_tables(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(HTML_TABLE), F.lit(0))


def clean_rows(rows: Column) -> Column:
    """Nulls empty, cells trimmed."""
    return F.transform(rows, lambda r: F.transform(F.coalesce(r, F.array().cast("array<string>")), lambda c: F.btrim(F.coalesce(c, F.lit("")))))


def _reasons(*rules: tuple[Column, str]) -> Column:
    return F.array_compact(F.array(*[F.when(c, name) for c, name in rules]))


def table_check(rows: Column) -> Column:
    """struct(rows, columns, empty_ratio, fragmented_ratio, consistent, reasons, quality)."""
    widths = F.transform(rows, lambda r: F.size(r))
    cells = F.flatten(rows)
    filled = F.filter(cells, lambda c: c != "")
    columns = F.coalesce(F.array_max(widths), F.lit(0))
    empty = 1 - F.size(filled) / F.greatest(F.size(cells), F.lit(1))
    short = F.size(F.filter(filled, lambda c: F.length(c) <= 3)) / F.greatest(F.size(filled), F.lit(1))
    consistent = F.size(F.array_distinct(F.filter(widths, lambda w: w > 0))) <= 1
    reasons = _reasons((columns < 2, "single_column"), (empty > 0.45, "empty_cells"), (short > 0.45, "fragmented_cells"), (~consistent, "inconsistent_columns"))
    return F.struct(F.size(rows).alias("rows"), columns.alias("columns"), F.round(empty, 3).alias("empty_ratio"), F.round(short, 3).alias("fragmented_ratio"), consistent.alias("consistent"), reasons.alias("reasons"), F.when(F.size(reasons) > 0, "low").otherwise("good").alias("quality"))


def page_tables(pages: DataFrame) -> DataFrame:
    """(document_id, page, table_id, check): Markdown tables first, then HTML."""
    rows = pages.select("document_id", "page", F.posexplode(text_tables(F.col("text"))).alias("i", "rows"))
    return rows.select("document_id", "page", F.format_string("p%d_t%d", "page", F.col("i") + 1).alias("table_id"), table_check(F.col("rows")).alias("check"))


def text_tables(text: Column) -> Column:
    """Cells of the tables of a text, Markdown ones first."""
    return F.concat(F.transform(markdown_tables(text), markdown_cells), F.transform(html_tables(text), html_cells))


def candidate_quality(rows: Column, words: Column, watermark_keys: Column) -> Column:
    """struct(score, quality, columns, consistency, empty_ratio, short_ratio,
    coverage, watermark_rate, reasons) of an extracted grid.  One of fewer than
    two rows or without columns has failed, and is empty in every measure."""
    rows = clean_rows(rows)
    widths = F.transform(rows, lambda r: F.size(r))
    columns, n = F.coalesce(F.array_max(widths), F.lit(0)), F.size(rows)
    cells = F.flatten(rows)
    filled = F.filter(cells, lambda c: c != "")
    total = F.greatest(n * columns, F.lit(1))
    modal = F.coalesce(F.array_max(F.transform(widths, lambda w: F.size(F.filter(widths, lambda x: x == w)))), F.lit(0))
    consistency = modal / F.greatest(n, F.lit(1))
    empty = 1 - F.size(filled) / total
    short = F.size(F.filter(filled, lambda c: F.length(c) <= 2)) / F.greatest(F.size(filled), F.lit(1))
    source, got = table_tokens(F.array_join(words, " ")), table_tokens(F.array_join(cells, " "))
    coverage = F.size(F.array_intersect(source, got)) / F.greatest(F.size(source), F.lit(1))
    key = lambda w: F.regexp_replace(F.lower(w), "[^a-z0-9]+", "")
    marked = F.filter(words, lambda w: (key(w) != "") & F.exists(watermark_keys, lambda k: F.contains(k, key(w))))
    rate = F.size(marked) / F.greatest(F.size(words), F.lit(1))
    bounded = lambda x: F.least(F.greatest(x, F.lit(0.0)), F.lit(1.0))
    score = F.round(bounded(0.35 * consistency + 0.25 * (1 - empty) + 0.15 * (1 - short) + 0.25 * coverage - 0.20 * rate), 3)
    void = (n < 2) | (columns == 0)
    reasons = F.when(n < 2, F.array(F.lit("fewer_than_two_rows"))).when(columns == 0, F.array(F.lit("no_columns"))).otherwise(_reasons((columns < 2, "single_column"), (empty > 0.45, "empty_cells"), (consistency < 0.75, "inconsistent_columns"), (short > 0.45, "fragmented_cells"), (coverage < 0.55, "low_source_coverage"), (rate > 0.10, "watermark_contamination")))
    score = F.when(void, 0.0).otherwise(score)
    quality = F.when(void, "failed").otherwise(graded(score, F.size(reasons) == 0))
    told = lambda x, none: F.when(void, F.lit(none)).otherwise(x)
    return F.struct(
        score.alias("score"), quality.alias("quality"), columns.alias("columns"), told(consistency, 0.0).alias("consistency"), told(empty, 1.0).alias("empty_ratio"), told(short, 1.0).alias("short_ratio"),
        told(coverage, 0.0).alias("coverage"), told(rate, 0.0).alias("watermark_rate"), reasons.alias("reasons"),
    )


def graded(score: Column, clean: Column) -> Column:
    return F.when((score >= 0.80) & clean, "good").when(score >= 0.60, "warning").otherwise("failed")


def fallback_score(score: Column, accuracy: Column) -> Column:
    return F.round(0.7 * score + 0.3 * accuracy / 100, 3)


def native_candidates(candidates: DataFrame) -> DataFrame:
    """Native grids worth keeping: 2 to 30 rows, 12 columns at most, score 0.60 or more."""
    return candidates.where(F.col("n_rows").between(2, 30) & (F.col("columns") <= 12) & F.col("is_grid") & (F.col("score") >= 0.60))


def best_candidates(candidates: DataFrame, by: tuple[str, ...] = ("document_id", "page")) -> DataFrame:
    """candidates (..., ord, origin native|fallback, score, quality): the
    fallback counts where there is no native candidate or the first of them is
    not good; the best score wins, ties the earlier one."""
    page = Window.partitionBy(*by)
    first = F.min_by(F.when(F.col("origin") == "native", F.col("quality")), F.when(F.col("origin") == "native", F.col("ord"))).over(page)
    out = candidates.withColumn("_first", first).where((F.col("origin") == "native") | F.col("_first").isNull() | (F.col("_first") != "good"))
    out = out.withColumn("_k", F.row_number().over(page.orderBy(F.desc("score"), "ord"))).where("_k = 1").drop("_k", "_first")
    return out.withColumn("table_status", F.when(F.col("quality") == "failed", "quarantine_table").otherwise(F.col("quality")))


def grids(words: DataFrame, by: tuple[str, ...] = ("document_id", "page"), least_rows: int = 3) -> DataFrame:
    """words (..., x0, x1, y): pages whose words form a grid.  Words on one line
    (y in steps of four) part where a gap exceeds 18; a grid has three lines of
    several segments, and two start positions (x in steps of 12) that recur."""
    line = words.withColumn("_line", F.bround(F.col("y") / 4))
    w = Window.partitionBy(*by, "_line").orderBy("x0")
    seg = line.withColumn("_new", F.coalesce((F.col("x0") - F.lag("x1").over(w) > 18), F.lit(True)))
    starts = seg.where("_new").select(*by, "_line", F.bround(F.col("x0") / 12).alias("_x"))
    several = starts.groupBy(*by, "_line").agg(F.count("*").alias("_n")).where("_n > 1")
    rows = several.groupBy(*by).agg(F.count("*").alias("rows"))
    columns = starts.join(several, [*by, "_line"], "left_semi").groupBy(*by, "_x").count().where("count >= 3").groupBy(*by).agg(F.count("*").alias("columns"))
    return rows.join(columns, list(by)).where((F.col("rows") >= least_rows) & (F.col("columns") >= 2))
