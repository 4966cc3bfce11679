"""Text predicates and normalisers as Column expressions."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

REPLACEMENT = "�"
TOKEN = r"[A-Za-z0-9]+|[一-鿿]"
#: What str.splitlines splits on.
LINE_BREAK = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]"


def replacement_ratio(text: Column) -> Column:
    """U+FFFD characters over non-white-space characters (one at least)."""
    text = F.coalesce(text, F.lit(""))
    bad = F.length(text) - F.length(F.replace(text, F.lit(REPLACEMENT), F.lit("")))
    return bad / F.greatest(F.length(F.regexp_replace(text, r"(?U)\s", "")), F.lit(1))


def usable(text: Column) -> Column:
    return F.coalesce(text, F.lit("")).rlike(r"[\p{L}\p{N}]")


def parse_guards(threshold: float, dpi: int, language: str) -> None:
    if not 0 <= threshold <= 1:
        raise ValueError("threshold must be between 0 and 1")
    if dpi < 72:
        raise ValueError("dpi must be 72 or more")
    if not language.strip():
        raise ValueError("a language of optical recognition is needed")


def select_page(threshold: float = 0.10, ocr_language: str = "eng") -> dict[str, Column]:
    """Columns of the page representation, over markdown_text, direct_text,
    ocr_text and ocr_error: the first rule that applies decides."""
    parse_guards(threshold, 72, ocr_language)
    md, direct, ocr = (F.coalesce(F.col(c), F.lit("")) for c in ("markdown_text", "direct_text", "ocr_text"))
    md_ratio, direct_ratio = replacement_ratio(md), replacement_ratio(direct)
    damaged = (md_ratio > threshold) & usable(direct) & (direct_ratio < md_ratio)
    empty = ~usable(md) & usable(direct)
    scanned = ~usable(md) & ~usable(direct)
    failed = scanned & (F.col("ocr_error").isNotNull() | ~usable(ocr))
    chosen = F.when(damaged | empty, direct).when(scanned & F.col("ocr_error").isNotNull(), "").when(scanned, ocr).otherwise(md)
    ratio = replacement_ratio(chosen)
    reason = F.when(damaged, "markdown_replacement_ratio").when(empty, "markdown_empty").when(failed & F.col("ocr_error").isNull(), "ocr_returned_no_text").when(scanned, "no_extractable_text")
    return {
        "text": chosen,
        "strategy": F.when(damaged | empty, "plain_text").when(scanned, "ocr").otherwise("markdown"),
        "status": F.when((ratio > threshold) | failed, "failed").otherwise("complete"),
        "fallback_reason": F.when(ratio > threshold, "selected_text_replacement_ratio").otherwise(reason),
        "markdown_replacement_ratio": F.round(md_ratio, 4),
        "direct_replacement_ratio": F.round(direct_ratio, 4),
        "selected_replacement_ratio": F.round(ratio, 4),
        "ocr_used": scanned,
        "ocr_language": F.when(scanned, ocr_language),
        "ocr_error": F.when(scanned, F.substring("ocr_error", 1, 240)),
    }


def plain(text: Column) -> Column:
    """Without tags, white space collapsed."""
    return F.btrim(F.regexp_replace(F.regexp_replace(text, "<[^>]+>", ""), r"(?U)\s+", " "))


def line_key(text: Column) -> Column:
    return F.regexp_replace(F.lower(text), "[^a-z0-9]+", "")


def clean_title(text: Column) -> Column:
    return F.btrim(F.btrim(F.btrim(F.regexp_replace(text, r"(?U)\s+", " ")), F.lit("#")))


def loose_key(text: Column) -> Column:
    """Lower case without non-word characters; no compatibility forms."""
    return F.regexp_replace(F.lower(text), r"(?U)[^\w]+", "")


@F.pandas_udf(StringType())
def title_key(titles: pd.Series) -> pd.Series:
    """NFKC and case folding, without non-word characters (no built-in has either)."""
    import re

    drop = re.compile(r"[^\w]+")
    return titles.map(lambda t: None if t is None else drop.sub("", unicodedata.normalize("NFKC", t).casefold()))


def tokens(text: Column) -> Column:
    """Latin words and single CJK characters, lower-cased."""
    return F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(TOKEN), F.lit(0)), F.lower)


def table_tokens(text: Column) -> Column:
    found = F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit("(?i)[a-z0-9]+"), F.lit(0)), F.lower)
    return F.array_distinct(F.filter(found, lambda t: F.length(t) > 1))


def language(text: Column) -> Column:
    return F.when(text.rlike(r"[一-鿿]"), "zh").otherwise("en")


#: Keys whose values are never shown, and limits of what is: fixed values.
SENSITIVE = ("text", "content", "document", "body", "pdf", "prompt", "output", "input", "query")
SHOWN_CHARACTERS, SHOWN_ITEMS = 256, 20


def _shortened(value: Column) -> Column:
    return F.when(F.length(value) > SHOWN_CHARACTERS, F.concat(F.substring(value, 1, SHOWN_CHARACTERS), F.lit("…"))).otherwise(value)


def redacted(value: Column, key: str = "") -> Column:
    """A string value fit for a trace."""
    return F.lit("[redacted]") if key.casefold() in SENSITIVE else _shortened(value)


def redacted_items(values: Column) -> Column:
    """The first strings of a list, fit for a trace."""
    return F.transform(F.slice(values, 1, SHOWN_ITEMS), _shortened)


def redacted_map(values: Column) -> Column:
    """The first entries of a map of strings, fit for a trace."""
    safe = lambda e: F.when(F.lower(e["key"]).isin(*SENSITIVE), "[redacted]").otherwise(_shortened(e["value"]))
    return F.map_from_entries(F.transform(F.slice(F.map_entries(values), 1, SHOWN_ITEMS), lambda e: F.struct(e["key"], safe(e))))


def lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), LINE_BREAK)
