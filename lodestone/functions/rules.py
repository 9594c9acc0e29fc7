"""Column rules of the record, entity and citation steps."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def doc_number_ok(code: Column) -> Column:
    """Two parts: the second has a letter; three or more: the third has a letter.  Anything else, and null, is no document number."""
    parts = F.split(code, "/")
    third = F.when(F.size(parts) >= 3, F.get(parts, F.lit(2)).rlike(r"\p{L}")).otherwise(False)
    return F.coalesce(F.when(F.size(parts) == 2, F.get(parts, F.lit(1)).rlike(r"\p{L}")).otherwise(third), F.lit(False))


def confidence(value: Column, default: float = 0.7) -> Column:
    """The value held to [0, 1]; the default where it is null."""
    return F.least(F.greatest(F.coalesce(value, F.lit(default)), F.lit(0.0)), F.lit(1.0))


def relation_confidence(method: Column, value: Column) -> Column:
    """A rule's 0.9, metadata's 1.0; a model's own, held to [0, 1], or 0.75."""
    return F.when(method == "metadata", 1.0).when(method == "rule", 0.9).otherwise(confidence(value, 0.75))


def first_score(*scores: Column) -> Column:
    """The first score that is neither null nor zero, else zero."""
    return F.coalesce(*[F.nullif(s, F.lit(0.0)) for s in scores], F.lit(0.0))


def shortened(text: Column, most: int) -> Column:
    """Blanks in a row as one, and an ellipsis where the text is longer than most code points."""
    flat = F.trim(F.regexp_replace(text, r"[ \t\n\r]+", " "))
    return F.when(F.length(flat) > most, F.concat(F.substring(flat, 1, most - 1), F.lit("…"))).otherwise(flat)


def cited(title: Column, code: Column, article: Column, chunk: Column) -> Column:
    """[title (code) | article | chunk], without the code where the title has it, and without null parts."""
    named = F.when(F.contains(title, code), title).otherwise(F.concat(title, F.lit(" ("), code, F.lit(")")))
    return F.concat(F.lit("["), F.concat_ws(" | ", shortened(named, 140), F.concat(F.lit("Điều "), article.cast("string")), chunk.cast("string")), F.lit("]"))


def numbers(text: Column) -> Column:
    """The different numbers written in a text."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit("[0-9]+"), 0))
