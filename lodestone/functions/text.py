"""Text and number functions as column expressions."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from .letters import MARKED


def tokens_plain(c: Column) -> Column:
    """Runs of letters and digits, case folded."""
    return F.regexp_extract_all(F.replace(F.lower(c), F.lit("ß"), F.lit("ss")), F.lit(r"[\p{L}\p{N}]+"), 0)


def tokens_codes(c: Column) -> Column:
    """Words and codes joined by / - or . in lower case."""
    return F.regexp_extract_all(F.lower(c), F.lit(r"[À-ỹA-Za-z0-9]+(?:[/\-\.][À-ỹA-Za-z0-9]+)*"), 0)


def tokens_graph(c: Column) -> Column:
    return F.slice(F.filter(tokens_codes(c), lambda t: F.length(t) >= 2), 1, 5)


SPACE = r"[\s\p{Z}\x1c-\x1f\x85]"


def stripped(c: Column) -> Column:
    """Without white space of any kind at the ends."""
    return F.regexp_replace(c, f"^{SPACE}+|{SPACE}+$", "")


@F.pandas_udf(StringType())
def _nfc(texts: pd.Series) -> pd.Series:
    return texts.str.normalize("NFC")


def newlines(c: Column) -> Column:
    return F.regexp_replace(c, "\r\n?", "\n")


def nfc(c: Column) -> Column:
    """Lines ended by one sign, and composed letters.  No built-in function composes, so texts with more than ASCII pass Arrow batches."""
    unix = newlines(c)
    return F.when(unix.rlike(r"[^\x00-\x7f]"), _nfc(F.when(unix.rlike(r"[^\x00-\x7f]"), unix))).otherwise(unix)


def compact_spaces(c: Column) -> Column:
    """Each line with its blanks and tabs in a row as one, and nothing at its ends.  Composition is nfc()'s part."""
    lines = F.split(c, r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]")
    return stripped(F.array_join(F.transform(lines, lambda x: stripped(F.regexp_replace(x, r"[ \t]+", " "))), "\n"))


def slug(c: Column, default: str = "item") -> Column:
    s = F.trim(F.regexp_replace(F.lower(c), "[^a-z0-9]+", "-"), F.lit("-"))
    return F.when(s == "", F.lit(default)).otherwise(s)


def strip_html(c: Column, joiner: str = "\n") -> Column:
    """Text of well-formed markup: scripts and styles dropped, tags to breaks, entities undone, blanks collapsed."""
    t = F.regexp_replace(c, r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->", joiner)
    t = F.regexp_replace(t, r"(?s)<[^>]*>", joiner)
    for entity, sign in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&copy;", "©"), ("&middot;", "·"), ("&amp;", "&")):
        t = F.replace(t, F.lit(entity), F.lit(sign))
    return F.trim(F.regexp_replace(F.regexp_replace(t, r"[ \t\r]+", " "), r"\s*\n\s*", "\n")) if joiner == "\n" else F.trim(F.regexp_replace(t, r"\s+", " "))


# Letters that stand for wrongly decoded ones, and words of wrongly read fonts.
MOJIBAKE = "[ÃÂÄÆÐðþ\x00]"
BROKEN = "CQNG|HOAXA|HQI|NGHiA|DQc|Hqnh|phric|Th6ng|tli6u|ngdn|kh6|nhrlnh|nudc"
FAULTS = (
    "text_layer_empty",
    "replacement_character_found",
    "too_many_control_characters",
    "private_use_font_glyphs_found",
    "too_many_non_printable_characters",
    "too_few_letters_for_text_page",
    "possible_encoding_or_font_error",
    "possible_vietnamese_font_substitution_error",
    "possible_broken_glyph_spacing",
)


def text_faults(c: Column) -> Column:
    """Quality warnings of a page, by shares of its characters without white space at the ends; an empty or null one has the first only."""
    t = F.coalesce(stripped(c), F.lit(""))
    total = F.greatest(F.length(t), F.lit(1))
    count = lambda p: F.regexp_count(t, F.lit(p))
    letters = count(r"\p{L}")
    control = count(r"[\p{Cc}\p{Cf}&&[^\n\t]]")
    unprinted = count(r"[\p{Cc}\p{Cf}\p{Cs}\p{Co}\p{Cn}\p{Z}&&[^\n\t ]]")
    marked = count(f"[{MARKED}{MARKED.upper()}]")
    tokens = F.regexp_extract_all(t, F.lit(r"[\p{L}\p{N}_]+"), 0)
    single = F.size(F.filter(tokens, lambda w: F.length(w) == 1))
    tests = (
        count("\ufffd") > 0,
        control / total > 0.01,
        count(r"\p{Co}") / total > 0.005,
        1 - unprinted / total < 0.95,
        (letters < 20) & (total > 80),
        count(MOJIBAKE) / total > 0.01,
        (count(BROKEN) >= 3) & (marked / F.greatest(letters, F.lit(1)) < 0.02),
        (F.size(tokens) >= 30) & (single / F.size(tokens) > 0.65),
    )
    found = F.array_compact(F.array(*[F.when(x, F.lit(name)) for name, x in zip(FAULTS[1:], tests)]))
    return F.when(t == "", F.array(F.lit(FAULTS[0]))).otherwise(found)


def sigmoid(c: Column) -> Column:
    return 1 / (1 + F.exp(-c))


def cosine(a: Column, b: Column) -> Column:
    """Cosine of double vectors, with a guard against zero length."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return dot(a, b) / F.greatest(F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)), F.lit(1e-12))


def vector_faults(v: Column, dim: int) -> Column:
    return F.array_compact(F.array(F.when(v.isNull() | (F.size(v) != dim), F.lit("dimension")), F.when(F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))), F.lit("not finite")), F.when(~F.exists(v, lambda x: x != 0), F.lit("zero"))))


def legal_refs(c: Column) -> Column:
    return F.array_distinct(F.transform(F.regexp_extract_all(F.lower(c), F.lit(r"(?:điều|khoản|điểm|article|clause|point)\s+\w+|\b(?:19|20)\d{2}\b"), 0), lambda r: F.regexp_replace(r, r"\s+", " ")))


def citation(title: Column, code: Column, article: Column, chunk: Column) -> Column:
    named = F.when(F.contains(title, code), title).otherwise(F.concat(title, F.lit(" ("), code, F.lit(")")))
    short = F.when(F.length(named) > 140, F.concat(F.left(named, F.lit(139)), F.lit("…"))).otherwise(named)
    return F.concat(F.lit("["), F.concat_ws(" | ", short, article, chunk), F.lit("]"))


def result_line(rank: Column, citation_: Column, text: Column, most: int = 200) -> Column:
    """A hit as two lines of a report."""
    snippet = F.replace(F.replace(F.substring(text, 1, most), F.lit("\n"), F.lit(" ")), F.lit("|"), F.lit("/"))
    return F.concat(F.lit("rank="), rank.cast("string"), F.lit("  ["), citation_, F.lit("]\ntext: "), snippet, F.lit("…"))


def markdown_pages(rows: DataFrame, by: str, columns: list[str], order: list[Column | str]) -> DataFrame:
    """(by, page): a heading and a table of the group's rows in order; groups are a report's sections, of a page's size."""
    cells = F.concat(F.lit("| "), F.concat_ws(" | ", *[F.col(c).cast("string") for c in columns]), F.lit(" |"))
    lines = F.transform(F.array_sort(F.collect_list(F.struct(*order, cells.alias("line")))), lambda x: x.line)
    head = f"| {' | '.join(columns)} |\n|{'---|' * len(columns)}\n"
    return rows.groupBy(by).agg(lines.alias("ls")).select(by, F.concat(F.lit("# "), F.col(by).cast("string"), F.lit("\n\n" + head), F.array_join("ls", "\n")).alias("page"))


def json_payload(c: Column) -> Column:
    """The JSON in an answer: all of it, or what a fence holds, or what stands from the first brace to the last; null if none parses.
    What follows a complete object is not looked at."""
    fenced = F.regexp_extract(c, r"(?s)```(?:json)?\s*(.*?)```", 1)
    braced = F.regexp_extract(c, r"(?s)(\{.*\})", 1)
    return F.coalesce(*[F.when(F.get_json_object(x, "$").isNotNull(), F.trim(x)) for x in (c, fenced, braced)])
