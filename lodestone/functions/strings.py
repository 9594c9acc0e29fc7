"""Further text functions as column expressions: names, headings, codes, references, labels, links and ids."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import rules
from .letters import MARKED, PLAIN

# Kinds of document by the letters in their codes.
KINDS = {"TT": "Thông tư", "NĐ": "Nghị định", "QĐ": "Quyết định", "QH": "Luật"}
CODE = r"\d+/\d{4}/[\p{Lu}Đ0-9-]+"


# Words before which documents are cited, and the form of a document's number.
TRIGGERS = ("Căn cứ", "Sửa đổi, bổ sung", "bãi bỏ", "thay thế")
LETTER = "A-ZÀÁÂÃÈÉÊÌÍÒÓÔÕÙÚÝĂĐĨŨƠƯ"
NUMBER = rf"\d{{1,4}}/(?:\d{{4}}|[{LETTER}][{LETTER}0-9-]{{0,12}})(?:/[{LETTER}][{LETTER}0-9-]{{1,12}})?"
BEFORE, AFTER, AROUND = 200, 400, 80


def occurrences(c: Column, pattern: str) -> Column:
    """(at, found) of each match of a pattern, at from 1."""
    parts, found = F.split(c, pattern, -1), F.regexp_extract_all(c, F.lit(pattern), 0)
    start = F.struct(F.array().cast("array<struct<at: int, found: string>>").alias("out"), F.lit(1).alias("at"))

    def step(a: Column, x: Column) -> Column:
        at = a.at + F.length(x.part)
        return F.struct(F.array_append(a.out, F.struct(at.alias("at"), x.found.alias("found"))).alias("out"), (at + F.length(x.found)).alias("at"))

    return F.aggregate(F.arrays_zip(F.slice(parts, 1, F.size(found)).alias("part"), found.alias("found")), start, step, lambda a: a.out)


def citing(docs: DataFrame) -> DataFrame:
    """(doc_id, own, body) to (doc_id, trigger, code, evidence): numbers within BEFORE and AFTER characters of a trigger, once by trigger,
    the first with what stands AROUND it; its own number, a beginning of that, and what is no document's number are left out."""
    found = lambda t: F.transform(occurrences(F.col("body"), t), lambda x: F.struct(F.lit(t).alias("trigger"), x.at.alias("pos")))
    placed = F.flatten(F.array(*map(found, TRIGGERS)))
    seen = docs.select("doc_id", "own", "body", F.explode(placed).alias("p"))
    low = F.greatest(F.col("p.pos") - BEFORE, F.lit(1))
    windows = seen.select("doc_id", "own", "p.trigger", "p.pos", F.substring("body", low, F.col("p.pos") + AFTER - low).alias("win"))
    codes = windows.select("*", F.posexplode(occurrences(F.col("win"), NUMBER)).alias("i", "c")).where((F.col("c.found") != F.col("own")) & ~F.startswith("own", F.concat("c.found", F.lit("/"))) & rules.doc_number_ok(F.col("c.found")))
    low = F.greatest(F.col("c.at") - AROUND, F.lit(1))
    said = F.trim(F.substring("win", low, F.col("c.at") + F.length("c.found") + AROUND - low))
    first = F.min(F.struct("pos", "i", said.alias("evidence")))
    return codes.groupBy("doc_id", "trigger", F.col("c.found").alias("code")).agg(first.alias("f")).select("doc_id", "trigger", "code", "f.evidence")


def plain_name(c: Column) -> Column:
    """White space in a row as one blank, no punctuation at the end."""
    return F.regexp_replace(F.trim(F.regexp_replace(c, r"[ \t\r\n]+", " ")), r"[ .,;:]+$", "")


def folded(c: Column) -> Column:
    """Marks taken off, then lower case; upper-case letters keep their marks."""
    return F.lower(F.translate(c, MARKED, PLAIN))


def heading(line: Column) -> Column:
    """Kind of heading of a line of at most 220 characters, or null: the first pattern that fits."""
    bare = F.regexp_replace(line, r"^[#*_ ]+|[#*_ ]+$", "")
    kinds = (("chapter", r"^(?iu:chương|chapter|phần) +[0-9IVXLC]+"), ("section", r"^(?iu:mục|section) +[0-9IVXLC]+"), ("article", r"^(?iu:điều|article) +[0-9]+"), ("clause", r"^[0-9]+\. "), ("point", r"^[a-zđ]\) "))
    out = reduce(lambda rest, k: F.when(bare.rlike(k[1]), k[0]).otherwise(rest), reversed(kinds), F.lit(None).cast("string"))
    return F.when(F.length(line) <= 220, out)


def code_of(doc_id: Column) -> Column:
    """kind-number-year-issuer as number/year/kind-issuer; anything else is null."""
    p = F.split(doc_id, "-")
    return F.when(F.size(p) == 4, F.concat(p[1], F.lit("/"), p[2], F.lit("/"), p[0], F.lit("-"), p[3]))


def kind_of(code: Column, title: Column) -> Column:
    """Kind of a document by the letters of its code, else by its title's first words, else null."""
    letters = F.regexp_extract(code, r"^\d+/\d{4}/([\p{Lu}]+)", 1)
    by_title = reduce(lambda rest, k: F.when(folded(title).startswith(folded(F.lit(k))), k).otherwise(rest), KINDS.values(), F.lit(None).cast("string"))
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in KINDS.items() for x in kv]), letters), by_title)


def date_of(c: Column) -> Column:
    """A date written in words, as year-month-day."""
    n = lambda i: F.regexp_extract(c, r"ngày (\d{1,2}) tháng (\d{1,2}) năm (\d{4})", i)
    return F.when(n(3) != "", F.concat(n(3), F.lit("-"), F.lpad(n(2), 2, "0"), F.lit("-"), F.lpad(n(1), 2, "0")))


PREFIXES = ("luat", "nghi dinh", "thong tu", "nghi quyet", "phap lenh", "quyet dinh")  # fixed values: how documents' names begin


def reference_kept(title: Column, code: Column, skip: list[str], longest: int = 220) -> Column:
    """Whether a reference is one: it has a code, begins like a document's name, or is short; and it holds none of the words to skip."""
    plain = F.replace(folded(F.lower(title)), F.lit("đ"), F.lit("d"))
    own = reduce(lambda a, b: a | b, [F.contains(plain, F.replace(folded(F.lit(x)), F.lit("đ"), F.lit("d"))) for x in skip], F.lit(False))
    starts = reduce(lambda a, b: a | b, [F.startswith(plain, F.lit(x)) for x in PREFIXES])
    return ~own & (F.coalesce(code, F.lit("")).cast("string").rlike(".") | starts | (F.length(title) <= longest))


def query_key(c: Column) -> Column:
    """Questions that differ in case, punctuation and blanks only have one key."""
    return F.trim(F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}]+", " "))


def labels_in(answer: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(answer, F.lit(r"\[(E[0-9]+)\]"), 1))


def with_citations(answer: Column, known: Column) -> Column:
    """Labels in brackets as the citations of a map; unknown ones go, with the blanks they leave."""
    put = F.aggregate(labels_in(answer), answer, lambda a, k: F.replace(a, F.concat(F.lit("["), k, F.lit("]")), F.coalesce(F.try_element_at(known, k), F.lit(""))))
    return F.trim(F.regexp_replace(put, " +", " "))


def yaml_scalar(c: Column) -> Column:
    """Quoted where it is empty, has signs with a meaning, or blanks at an end; a quote in it is escaped."""
    odd = (c == "") | c.rlike(r"[:#\[\]{}&*!|>'\"%@`,\\]") | c.rlike("^[ -]| $")
    inner = F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    return F.when(odd, F.concat(F.lit('"'), inner, F.lit('"'))).otherwise(c)


def wikilinks(c: Column) -> Column:
    """Targets of [[target]] and [[target|alias]], in order, once each."""
    return F.array_distinct(F.regexp_extract_all(c, F.lit(r"\[\[([^\]|]+)(?:\|[^\]]*)?\]\]"), 1))


def judged(answer: Column, has_chunks: Column) -> Column:
    """What became of a question, by phrases of the answer in order."""
    low = F.lower(F.coalesce(answer, F.lit("")))
    out = F.when(F.length(low) < 60, "partial").otherwise("answered")
    out = F.when(has_chunks, out).otherwise("no-graph-data")
    # Phrases of answers.
    out = F.when(low.contains("không có thông tin") | low.contains("ngữ cảnh không"), "no-context").otherwise(out)
    return F.when(low.contains("[llm unavailable"), "llm-unavailable").otherwise(out)


def uuid5(name: Column, space: uuid.UUID = uuid.NAMESPACE_URL) -> Column:
    """Name-based UUID, version 5."""
    h = F.sha1(F.concat(F.unhex(F.lit(space.hex)), name.cast("binary")))
    variant = F.substring(F.lit("89ab"), (F.conv(F.substring(h, 17, 1), 16, 10).cast("int") % 4 + 1), F.lit(1))
    part = lambda a, n: F.substring(h, a, n)
    return F.concat_ws("-", part(1, 8), part(9, 4), F.concat(F.lit("5"), part(14, 3)), F.concat(variant, part(18, 3)), part(21, 12))
