"""Chunkers that follow a text's structure, as expressions over its pages: paragraphs, sentences, buffers and legal headings.

Texts are taken as normalised (functions.text.nfc).  Each document is one row with an array of its pages; the sequential rules run
as one fold over its lines or paragraphs, so that a document never leaves its row and nothing is shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X

LEVELS = ("chapter", "section", "article", "clause", "point")

# Headings of legal texts, by level, in the order in which they are tried.
HEADINGS = {
    "chapter": r"(?iu)^chương +([ivxlcdm]+|\d+)\b",
    "section": r"(?iu)^mục +([ivxlcdm]+|\d+)\b",
    "article": r"(?iu)^điều +\d+\b",
    "clause": r"^\d+\. +.+",
    "point": r"(?iu)^[a-zđ]\) +.+",
}
LONGEST_HEADING = 220
GROUPED = 700  # characters from which on lines without blank ones between them are a paragraph

Strings = "array<string>"


def _joined(a: Column, gap: str, b: Column) -> Column:
    return F.when(a == "", b).otherwise(F.concat(a, F.lit(gap), b))


def _unless_empty(out: Column, text: Column) -> Column:
    return F.when(text == "", out).otherwise(F.array_append(out, text))


def _lines(c: Column) -> Column:
    return F.filter(F.transform(F.split(c, "\n"), X.stripped), lambda x: x != "")


def paragraph_blocks(c: Column) -> Column:
    """Paragraphs between blank lines; of a text without any, runs of lines up to one that ends a sentence or to GROUPED characters."""
    whole = X.stripped(c)
    blocks = F.split(whole, r"\n\s*\n+")

    def step(a: Column, x: Column) -> Column:
        now = _joined(a.now, " ", x)
        full = x.rlike("[.!?;:]$") | (F.length(now) > GROUPED)
        return F.struct(F.when(full, F.array_append(a.out, now)).otherwise(a.out).alias("out"), F.when(full, "").otherwise(now).alias("now"))

    start = F.struct(F.array().cast(Strings).alias("out"), F.lit("").alias("now"))
    grouped = F.aggregate(_lines(whole), start, step, lambda a: _unless_empty(a.out, a.now))
    return F.filter(F.transform(F.when(F.size(blocks) > 1, blocks).otherwise(grouped), X.compact_spaces), lambda x: x != "")


def split_large(c: Column, most: int) -> Column:
    """Parts of at most `most` characters: sentences and lines packed in order, a longer one of them cut hard."""
    whole = X.stripped(c)
    units = F.filter(F.transform(F.split(whole, r"(?U)(?<=[.!?;:])\s+|\n+"), X.stripped), lambda x: x != "")

    def step(a: Column, x: Column) -> Column:
        long, now = F.length(x) > most, _joined(a.now, " ", x)
        over = (a.now != "") & (F.length(now) > most)
        last = F.floor((F.length(x) - 1) / most).cast("int")
        pieces = F.transform(F.sequence(F.lit(0), last), lambda i: X.stripped(F.substring(x, i * most + 1, F.lit(most))))
        out = F.when(long, F.concat(_unless_empty(a.out, a.now), pieces)).when(over, F.array_append(a.out, a.now)).otherwise(a.out)
        return F.struct(out.alias("out"), F.when(long, "").when(over, x).otherwise(now).alias("now"))

    start = F.struct(F.array().cast(Strings).alias("out"), F.lit("").alias("now"))
    packed = F.aggregate(units, start, step, lambda a: _unless_empty(a.out, a.now))
    return F.filter(F.when(F.length(whole) <= most, F.array(whole)).otherwise(packed), lambda x: x != "")


CHUNKS = "array<struct<page_start: int, page_end: int, boundary: string, text: string>>"


def semantic_chunks(pages: Column, target: int, most: int) -> Column:
    """Paragraphs gathered until a buffer holds `target` characters or would pass `most`; a paragraph of `most` closes its own buffer."""
    parts = F.flatten(F.transform(pages, lambda p: F.flatten(F.transform(paragraph_blocks(p["text"]), lambda b: F.transform(split_large(b, most), lambda x: F.struct(p.page.alias("page"), x.alias("text")))))))

    def step(a: Column, x: Column) -> Column:
        held = a.now != ""
        full, over = held & (F.length(a.now) >= target), held & (F.length(a.now) + F.length(x["text"]) > most)
        chunk = F.struct(a.first.alias("page_start"), a.last.alias("page_end"), F.when(full, "paragraph_or_blank_line").otherwise("max_size_guard_at_paragraph_boundary").alias("boundary"), a.now.alias("text"))
        out = F.when(full | over, F.array_append(a.out, chunk)).otherwise(a.out)
        now = F.when(full | over, x["text"]).otherwise(_joined(a.now, "\n\n", x["text"]))
        first = F.when(full | over | ~held, x.page).otherwise(a.first)
        large = F.length(x["text"]) >= most
        own = F.struct(first.alias("page_start"), x.page.alias("page_end"), F.lit("single_large_paragraph").alias("boundary"), now.alias("text"))
        return F.struct(F.when(large, F.array_append(out, own)).otherwise(out).alias("out"), F.when(large, "").otherwise(now).alias("now"), first.alias("first"), x.page.alias("last"))

    start = F.struct(F.array().cast(CHUNKS).alias("out"), F.lit("").alias("now"), F.lit(None).cast("int").alias("first"), F.lit(None).cast("int").alias("last"))
    end = lambda a: F.when(a.now == "", a.out).otherwise(F.array_append(a.out, F.struct(a.first.alias("page_start"), a.last.alias("page_end"), F.lit("end_of_document").alias("boundary"), a.now.alias("text"))))
    return F.aggregate(parts, start, step, end)


def heading_of(line: Column) -> Column:
    """(level, title) of a heading line, or null."""
    clean = X.compact_spaces(line)
    title = F.regexp_replace(clean, r"^[#* _]+|[#* _]+$", "")
    level = F.lit(None).cast("string")
    for name, pattern in reversed(HEADINGS.items()):
        level = F.when(title.rlike(pattern), F.lit(name)).otherwise(level)
    level = F.when((clean != "") & (F.length(clean) <= LONGEST_HEADING), level)
    return F.when(level.isNotNull(), F.struct(level.alias("level"), title.alias("title")))


STRUCTURED = "array<struct<page_start: int, page_end: int, boundary: string, level: string, heading: string, path: string, text: string>>"


def hierarchical_chunks(pages: Column, most: int) -> Column:
    """A chunk for each heading and what stands below it, closed early at `most` characters.  A clause needs an article above it, a
    point a clause or an article; a heading clears those of the levels below its own.  path: the headings above, by ` > `."""
    lines = F.flatten(F.transform(pages, lambda p: F.transform(_lines(p["text"]), lambda x: F.struct(p.page.alias("page"), x.alias("text"), heading_of(x).alias("h")))))

    def step(a: Column, x: Column) -> Column:
        at = lambda name: a.path[LEVELS.index(name)]
        allowed = F.when(x.h.level == "clause", at("article") != "").when(x.h.level == "point", (at("clause") != "") | (at("article") != "")).otherwise(True)
        new = F.coalesce(x.h.isNotNull() & allowed, F.lit(False))
        depth = F.array_position(F.array(*map(F.lit, LEVELS)), x.h.level)
        path = F.when(new, F.transform(a.path, lambda v, i: F.when(i + 1 < depth, v).when(i + 1 == depth, x.h.title).otherwise(""))).otherwise(a.path)
        flush = new & (a.now != "")
        chunk = lambda now, first, last, why, level, heading, trail: F.struct(first.alias("page_start"), last.alias("page_end"), why.alias("boundary"), level.alias("level"), heading.alias("heading"), F.array_join(F.filter(trail, lambda v: v != ""), " > ").alias("path"), now.alias("text"))
        out = F.when(flush, F.array_append(a.out, chunk(a.now, a.first, a.last, F.concat(F.lit("new_"), x.h.level), a.level, a.heading, a.path))).otherwise(a.out)
        fresh = new | (a.now == "")
        now, first = F.when(fresh, x["text"]).otherwise(F.concat(a.now, F.lit("\n"), x["text"])), F.when(fresh, x.page).otherwise(a.first)
        level, heading = F.when(new, x.h.level).otherwise(a.level), F.when(new, x.h.title).otherwise(a.heading)
        full = F.length(now) >= most
        none = F.lit(None).cast("string")
        return F.struct(
            F.when(full, F.array_append(out, chunk(now, first, x.page, F.lit("max_size_guard_inside_structure"), level, heading, path))).otherwise(out).alias("out"),
            F.when(full, "").otherwise(now).alias("now"),
            first.alias("first"),
            x.page.alias("last"),
            F.when(full, none).otherwise(level).alias("level"),
            F.when(full, none).otherwise(heading).alias("heading"),
            path.alias("path"),
        )

    none = F.lit(None)
    start = F.struct(F.array().cast(STRUCTURED).alias("out"), F.lit("").alias("now"), none.cast("int").alias("first"), none.cast("int").alias("last"), none.cast("string").alias("level"), none.cast("string").alias("heading"), F.array(*[F.lit("")] * len(LEVELS)).alias("path"))
    last = lambda a: F.struct(a.first.alias("page_start"), a.last.alias("page_end"), F.lit("end_of_document").alias("boundary"), a.level.alias("level"), a.heading.alias("heading"), F.array_join(F.filter(a.path, lambda v: v != ""), " > ").alias("path"), a.now.alias("text"))
    return F.aggregate(lines, start, step, lambda a: F.when(a.now == "", a.out).otherwise(F.array_append(a.out, last(a))))


def page_span(chunk: Column, pages: Column) -> Column:
    """(page_start, page_end) of the pages that the chunk has the first 120 characters of, or that have one of its first three lines;
    of all pages if there is none."""
    starts = F.slice(F.filter(F.split(F.substring(chunk, 1, 300), r"\n+"), lambda x: F.lit(True)), 1, 3)
    sample = lambda p: X.stripped(F.substring(p["text"], 1, 120))
    held = F.filter(pages, lambda p: ((sample(p) != "") & F.contains(chunk, sample(p))) | F.exists(starts, lambda s: (s != "") & F.contains(p["text"], s)))
    found = F.transform(F.when(F.size(held) > 0, held).otherwise(pages), lambda p: p.page)
    return F.struct(F.array_min(found).alias("page_start"), F.array_max(found).alias("page_end"))


def fixed_chunks(pages: Column, size: int, overlap: int) -> Column:
    """Windows over the pages' joined text, with the pages that they seem to stand on; blank ones are left out."""
    whole, step = F.array_join(F.transform(pages, lambda p: p["text"]), "\n\n"), max(size - overlap, 1)
    last = F.ceil(F.greatest(F.length(whole) - size, F.lit(0)) / step).cast("int")
    windows = F.filter(F.transform(F.sequence(F.lit(0), last), lambda i: X.stripped(F.substring(whole, i * step + 1, F.lit(size)))), lambda x: x != "")
    return F.transform(windows, lambda x: F.struct(page_span(x, pages)["page_start"].alias("page_start"), page_span(x, pages)["page_end"].alias("page_end"), F.lit("fixed").alias("boundary"), x.alias("text")))


def numbered(docs: DataFrame, strategy: str, chunks: Column, most: int | None) -> DataFrame:
    """(source, chunks) to (chunk_id, strategy, source, page_start, page_end, boundary, text), split to `most` and numbered per source."""
    parts = chunks if most is None else F.flatten(F.transform(chunks, lambda c: F.transform(split_large(c["text"], most), lambda x: F.struct(c.page_start.alias("page_start"), c.page_end.alias("page_end"), c.boundary.alias("boundary"), x.alias("text")))))
    rows = docs.select("source", F.posexplode(parts).alias("n", "c"))
    tag = {"fixed-size": "fixed"}.get(strategy, strategy)
    return rows.select(F.format_string(f"%s::{tag}::%04d", "source", F.col("n") + 1).alias("chunk_id"), F.lit(strategy).alias("strategy"), "source", "c.page_start", "c.page_end", "c.boundary", "c.text")


def three_strategies(docs: DataFrame, size: int = 1200, overlap: int = 150, target: int = 900, semantic_most: int = 1600, structural_most: int = 1800) -> DataFrame:
    """(source, pages) to the chunks of all three strategies; the rows of a document stay where it is."""
    pages = F.col("pages")
    fixed = numbered(docs, "fixed-size", fixed_chunks(pages, size, overlap), None)
    semantic = numbered(docs, "semantic", semantic_chunks(pages, target, semantic_most), semantic_most)
    return fixed.unionByName(semantic).unionByName(numbered(docs, "hierarchical", hierarchical_chunks(pages, structural_most), structural_most))


