"""Normalisation, paragraphs, sentences, the three chunkers and page spans over documents; HTML structure over pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import strings as S
from ..functions import text as X
from ..operators import html, structure
from ..sources.tables import table
from .registry import query

# Text with letters taken apart, carriage returns, and blanks at the ends of lines.
LOOSE = "replace(replace(text, 'é', 'e' || chr(769)), '. ', '. ' || chr(9) || chr(13) || chr(10) || '  ')"


def _loose(spark: SparkSession, d: str) -> DataFrame:
    text = F.replace(F.replace(F.col("text"), F.lit("é"), F.lit("é")), F.lit(". "), F.lit(". \t\r\n  "))
    return table(spark, d, "documents").select("doc_id", text.alias("text"))


UNIX = r"regexp_replace({}, '\r\n?', chr(10), 'g')"
SPACES = r"trim(array_to_string(list_transform(string_split({}, chr(10)), lambda l: trim(regexp_replace(l, '[ \t]+', ' ', 'g'))), chr(10)), ' ' || chr(10) || chr(9))"


@query(f"SELECT doc_id, md5(nfc_normalize({UNIX.format(LOOSE)})) AS md5 FROM documents")
def x4_normalize_nfc(spark: SparkSession, d: str) -> DataFrame:
    return _loose(spark, d).select("doc_id", F.md5(X.nfc(F.col("text"))).alias("md5"))


@query(f"SELECT doc_id, md5(nfc_normalize({SPACES.format(UNIX.format(LOOSE))})) AS md5 FROM documents")
def x5_compact_spaces(spark: SparkSession, d: str) -> DataFrame:
    """Every line stripped and its blanks collapsed, on composed text."""
    return _loose(spark, d).select("doc_id", F.md5(X.compact_spaces(X.nfc(F.col("text")))).alias("md5"))


@query(rf"SELECT doc_id, md5(regexp_replace(trim(regexp_replace(nfc_normalize({LOOSE}), '[ \t\r\n]+', ' ', 'g')), '[ .,;:]+$', '')) AS md5 FROM documents")
def x6_normalize_text(spark: SparkSession, d: str) -> DataFrame:
    """Composed, blanks in a row as one, nothing after the last word."""
    return _loose(spark, d).select("doc_id", F.md5(S.plain_name(X.nfc(F.col("text")))).alias("md5"))


# Legal headings put before the lines of a text, by their place.
MARKS = ("Chương ", "Mục ", "Điều ", "", "a) ", "", "**Điều ", "", "")
LEGAL = """list_transform(string_split(text, chr(10)), lambda l, i: CASE (i - 1) % 9 WHEN 0 THEN 'Chương ' || i || '. ' || l WHEN 1 THEN 'Mục ' || i || ' ' || l
  WHEN 2 THEN 'Điều ' || i || '. ' || l WHEN 3 THEN i || '. ' || l WHEN 4 THEN 'a) ' || l WHEN 6 THEN '**Điều ' || i || '** ' || l ELSE l END)"""


def legal_lines() -> Column:
    def marked(line: Column, i: Column) -> Column:
        n, k = (i + 1).cast("string"), i % 9
        return F.when(k == 0, F.concat(F.lit("Chương "), n, F.lit(". "), line)).when(k == 1, F.concat(F.lit("Mục "), n, F.lit(" "), line)).when(k == 2, F.concat(F.lit("Điều "), n, F.lit(". "), line)).when(k == 3, F.concat(n, F.lit(". "), line)).when(k == 4, F.concat(F.lit("a) "), line)).when(k == 6, F.concat(F.lit("**Điều "), n, F.lit("** "), line)).otherwise(line)

    return F.transform(F.split("text", "\n"), marked)


def _pages(text: Column) -> Column:
    return F.array(F.struct(F.lit(1).alias("page"), text.alias("text")))


def _fold(items: str, state: str, step: str) -> str:
    """A list of states folded from an empty one; {n} in a step binds a name once."""
    return f"list_reduce(list_prepend({state}, {items}), lambda a, x: {step})"


def _bind(name: str, value: str, body: str) -> str:
    return f"list_transform([{value}], lambda {name}: {body})[1]"


PACK = "{{'out': {out}, 'now': {now}}}"
EMPTY = "{'out': []::VARCHAR[], 'now': ''}"
FLUSHED = "CASE WHEN a.now = '' THEN a.out ELSE list_append(a.out, a.now) END"


def _closed(folded: str) -> str:
    return f"list_transform([{folded}], lambda a: {FLUSHED})[1]"


def sql_paragraphs(t: str) -> str:
    """DuckDB's list of paragraph blocks of a trimmed text."""
    lines = f"list_transform(list_filter(list_transform(string_split({t}, chr(10)), lambda l: trim(l)), lambda l: l <> ''), lambda l: {{'out': []::VARCHAR[], 'now': l}})"
    step = _bind("n", "CASE WHEN a.now = '' THEN x.now ELSE a.now || ' ' || x.now END", "CASE WHEN regexp_matches(n, '[.!?;:]$') OR length(n) > 700 THEN {'out': list_append(a.out, n), 'now': ''} ELSE {'out': a.out, 'now': n} END")
    blocks = rf"regexp_split_to_array({t}, '\n\s*\n+')"
    grouped = _closed(_fold(lines, EMPTY, step))
    return f"list_filter(list_transform(CASE WHEN len({blocks}) > 1 THEN {blocks} ELSE {grouped} END, lambda b: {SPACES.format('b')}), lambda b: b <> '')"


def sql_split(t: str, most: int) -> str:
    """DuckDB's list of parts of at most `most` characters of a trimmed text."""
    units = rf"list_transform(list_filter(list_transform(regexp_split_to_array(regexp_replace({t}, '([.!?;:])\s+', '\1' || chr(1), 'g'), '\n+|\x01'), lambda u: trim(u, ' ' || chr(9) || chr(10))), lambda u: u <> ''), lambda u: {{'out': []::VARCHAR[], 'now': u}})"
    pieces = f"list_transform(range(0, length(x.now), {most}), lambda k: trim(substr(x.now, k + 1, {most})))"
    step = _bind(
        "n",
        "CASE WHEN a.now = '' THEN x.now ELSE a.now || ' ' || x.now END",
        f"CASE WHEN length(x.now) > {most} THEN {{'out': list_concat({FLUSHED}, {pieces}), 'now': ''}} WHEN a.now <> '' AND length(n) > {most} THEN {{'out': list_append(a.out, a.now), 'now': x.now}} ELSE {{'out': a.out, 'now': n}} END",
    )
    return f"list_filter(CASE WHEN length({t}) <= {most} THEN [{t}] ELSE {_closed(_fold(units, EMPTY, step))} END, lambda u: u <> '')"


TRIMMED = "trim(text, ' ' || chr(9) || chr(10) || chr(13))"


@query(f"SELECT doc_id, generate_subscripts(b, 1) - 1 AS chunk, unnest(b) AS text FROM (SELECT doc_id, {sql_paragraphs('t')} AS b FROM (SELECT doc_id, {TRIMMED} AS t FROM documents)) WHERE len(b) > 0")
def x17_paragraph_blocks(spark: SparkSession, d: str) -> DataFrame:
    """Paragraphs; lines without a blank one between them are grouped to sentences' ends."""
    return table(spark, d, "documents").select("doc_id", F.posexplode(structure.paragraph_blocks(F.col("text"))).alias("chunk", "text"))


@query(f"SELECT doc_id, generate_subscripts(b, 1) - 1 AS part, unnest(b) AS text FROM (SELECT doc_id, {sql_split('t', 300)} AS b FROM (SELECT doc_id, {TRIMMED} AS t FROM documents)) WHERE len(b) > 0")
def x16_split_large(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.posexplode(structure.split_large(F.col("text"), 300)).alias("part", "text"))


CHUNK = "{{'boundary': '{why}', 'text': {text}}}"
BUFFERED = _fold(
    "list_transform(parts, lambda v: {'out': []::STRUCT(boundary VARCHAR, \"text\" VARCHAR)[], 'now': v})",
    "{'out': []::STRUCT(boundary VARCHAR, \"text\" VARCHAR)[], 'now': ''}",
    _bind(
        "f",
        "CASE WHEN a.now <> '' AND length(a.now) >= 900 THEN 'paragraph_or_blank_line' WHEN a.now <> '' AND length(a.now) + length(x.now) > 1600 THEN 'max_size_guard_at_paragraph_boundary' ELSE '' END",
        _bind(
            "n",
            "CASE WHEN f <> '' OR a.now = '' THEN x.now ELSE a.now || chr(10) || chr(10) || x.now END",
            _bind(
                "o",
                "CASE WHEN f <> '' THEN list_append(a.out, {'boundary': f, 'text': a.now}) ELSE a.out END",
                "CASE WHEN length(x.now) >= 1600 THEN {'out': list_append(o, {'boundary': 'single_large_paragraph', 'text': n}), 'now': ''} ELSE {'out': o, 'now': n} END",
            ),
        ),
    ),
)
SEMANTIC = f"""p AS (SELECT doc_id, flatten(list_transform({sql_paragraphs('t')}, lambda b: {sql_split('b', 1600)})) AS parts FROM (SELECT doc_id, {TRIMMED} AS t FROM documents)),
s AS (SELECT doc_id, list_transform([{BUFFERED}], lambda a: CASE WHEN a.now = '' THEN a.out ELSE list_append(a.out, {{'boundary': 'end_of_document', 'text': a.now}}) END)[1] AS cs FROM p),
c AS (SELECT doc_id, flatten(list_transform(cs, lambda c: list_transform({sql_split('c.text', 1600)}, lambda u: {{'boundary': c.boundary, 'text': u}}))) AS cs FROM s)"""


@query(f"WITH {SEMANTIC} SELECT source || '::semantic::' || printf('%04d', n) AS chunk_id, source, c.boundary AS boundary, c.text AS text FROM (SELECT doc_id::VARCHAR AS source, generate_subscripts(cs, 1) AS n, unnest(cs) AS c FROM c WHERE len(cs) > 0)")
def w7_buffer_chunks(spark: SparkSession, d: str) -> DataFrame:
    """Paragraphs in buffers of 900 to 1600 characters."""
    docs = table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("source"), _pages(F.col("text")).alias("pages"))
    return structure.numbered(docs, "semantic", structure.semantic_chunks(F.col("pages"), 900, 1600), 1600).select("chunk_id", "source", "boundary", "text")


STATE = "STRUCT(boundary VARCHAR, level VARCHAR, heading VARCHAR, path VARCHAR, \"text\" VARCHAR)[]"
EXTRA = "'h': {h}, 't': {t}, 'level': {level}, 'heading': {heading}, 'path': {path}"
TITLE = r"regexp_replace(trim(regexp_replace(l, '[ \t]+', ' ', 'g')), '^[#* _]+|[#* _]+$', '', 'g')"
LEVEL = r"CASE WHEN length(trim(regexp_replace(l, '[ \t]+', ' ', 'g'))) > 220 THEN NULL WHEN regexp_matches(k, '(?i)^chương +([ivxlcdm]+|\d+)(?:[^\p{L}\p{N}_]|$)') THEN 1 WHEN regexp_matches(k, '(?i)^mục +([ivxlcdm]+|\d+)(?:[^\p{L}\p{N}_]|$)') THEN 2 WHEN regexp_matches(k, '(?i)^điều +\d+(?:[^\p{L}\p{N}_]|$)') THEN 3 WHEN regexp_matches(k, '^\d+\. +.+') THEN 4 WHEN regexp_matches(k, '(?i)^[a-zđ]\) +.+') THEN 5 END"
LINE = "list_transform(list_filter(list_transform(ls, lambda l: trim(l)), lambda l: l <> ''), lambda l: list_transform([" + TITLE + "], lambda k: {'out': []::" + STATE + ", 'now': l, 'h': " + LEVEL + ", 't': k, 'level': NULL::VARCHAR, 'heading': NULL::VARCHAR, 'path': []::VARCHAR[]})[1])"
NAMES = "['chapter', 'section', 'article', 'clause', 'point']"
TRAIL = "array_to_string(list_filter({p}, lambda v: v <> ''), ' > ')"
ONE = "{{'boundary': {why}, 'level': {level}, 'heading': {heading}, 'path': " + TRAIL + ", 'text': {text}}}"
STRUCTURED = _fold(
    LINE,
    "{'out': []::" + STATE + ", 'now': '', 'h': NULL::INTEGER, 't': '', 'level': NULL::VARCHAR, 'heading': NULL::VARCHAR, 'path': ['', '', '', '', '']}",
    _bind(
        "w",
        "CASE WHEN x.h IS NULL OR (x.h = 4 AND a.path[3] = '') OR (x.h = 5 AND a.path[4] = '' AND a.path[3] = '') THEN 0 ELSE x.h END",
        _bind(
            "g",
            "CASE WHEN w = 0 THEN a.path ELSE list_transform(a.path, lambda v, i: CASE WHEN i < w THEN v WHEN i = w THEN x.t ELSE '' END) END",
            _bind(
                "o",
                "CASE WHEN w > 0 AND a.now <> '' THEN list_append(a.out, " + ONE.format(why="'new_' || " + NAMES + "[w]", level="a.level", heading="a.heading", p="a.path", text="a.now") + ") ELSE a.out END",
                _bind(
                    "n",
                    "CASE WHEN w > 0 OR a.now = '' THEN x.now ELSE a.now || chr(10) || x.now END",
                    _bind(
                        "y",
                        "{'l': CASE WHEN w > 0 THEN " + NAMES + "[w] ELSE a.level END, 'd': CASE WHEN w > 0 THEN x.t ELSE a.heading END}",
                        "CASE WHEN length(n) >= 700 THEN {'out': list_append(o, " + ONE.format(why="'max_size_guard_inside_structure'", level="y.l", heading="y.d", p="g", text="n") + "), 'now': '', " + EXTRA.format(h="x.h", t="x.t", level="NULL::VARCHAR", heading="NULL::VARCHAR", path="g") + "} ELSE {'out': o, 'now': n, " + EXTRA.format(h="x.h", t="x.t", level="y.l", heading="y.d", path="g") + "} END",
                    ),
                ),
            ),
        ),
    ),
)
HIERARCHICAL = f"""f AS (SELECT doc_id, list_transform([{STRUCTURED}], lambda a: CASE WHEN a.now = '' THEN a.out ELSE list_append(a.out, {ONE.format(why="'end_of_document'", level="a.level", heading="a.heading", p="a.path", text="a.now")}) END)[1] AS cs
  FROM (SELECT doc_id, {LEGAL} AS ls FROM documents))"""


@query(f"WITH {HIERARCHICAL} SELECT doc_id, n - 1 AS n, c.boundary AS boundary, c.level AS level, c.heading AS heading, c.path AS path, c.text AS text FROM (SELECT doc_id, generate_subscripts(cs, 1) AS n, unnest(cs) AS c FROM f WHERE len(cs) > 0)")
def w8_structural_chunks(spark: SparkSession, d: str) -> DataFrame:
    """Headings made into every text by rule; chunks by heading, closed at 700 characters."""
    text = F.array_join(legal_lines(), "\n")
    rows = table(spark, d, "documents").select("doc_id", F.posexplode(structure.hierarchical_chunks(_pages(text), 700)).alias("n", "c"))
    return rows.select("doc_id", "n", "c.boundary", "c.level", "c.heading", "c.path", "c.text")


@query(f"WITH {SEMANTIC}, x AS (SELECT doc_id, list_filter(list_transform(range(0, 1 + ceil(greatest(length(t) - 1200, 0) / 1050.0)::INT), lambda i: trim(substr(t, i * 1050 + 1, 1200), ' ' || chr(10) || chr(9))), lambda u: u <> '') AS cs FROM (SELECT doc_id, text AS t FROM documents)), r AS (SELECT 'fixed-size' AS strategy, unnest(cs) AS text FROM x UNION ALL SELECT 'semantic', u.text FROM (SELECT unnest(cs) AS u FROM c)) SELECT strategy, count(*) AS n, sum(length(text))::BIGINT AS chars, min(md5(text)) AS least, max(md5(text)) AS most FROM r GROUP BY strategy")
def z1_two_strategies(spark: SparkSession, d: str) -> DataFrame:
    """Of the three strategies' chunks the fixed and the semantic ones, as counts and digests (the third has w8's)."""
    docs = table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("source"), _pages(F.col("text")).alias("pages"))
    chunks = structure.three_strategies(docs).where("strategy <> 'hierarchical'")
    return chunks.groupBy("strategy").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("chars"), F.min(F.md5("text")).alias("least"), F.max(F.md5("text")).alias("most"))


@query()
def z1_three_strategies(spark: SparkSession, d: str) -> DataFrame:
    """All three chunkers over every document, as one table."""
    docs = table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("source"), _pages(F.array_join(legal_lines(), "\n")).alias("pages"))
    return structure.three_strategies(docs)


@query(r"""WITH p AS (SELECT conv_id, list({'page': turn + 1, 'text': coalesce(text, '')} ORDER BY turn) AS ps FROM conversations GROUP BY conv_id),
c AS (SELECT conv_id, ps, substr(array_to_string(list_transform(ps, lambda p: p.text), chr(10)), 41, 400) AS chunk FROM p),
h AS (SELECT conv_id, ps, list_transform(list_filter(ps, lambda p: (trim(substr(p.text, 1, 120)) <> '' AND contains(chunk, trim(substr(p.text, 1, 120)))) OR len(list_filter(regexp_split_to_array(substr(chunk, 1, 300), '\n+')[1:3], lambda s: s <> '' AND contains(p.text, s))) > 0), lambda p: p.page) AS found FROM c)
SELECT conv_id, CASE WHEN len(found) > 0 THEN list_min(found) ELSE list_min(list_transform(ps, lambda p: p.page)) END AS page_start, CASE WHEN len(found) > 0 THEN list_max(found) ELSE list_max(list_transform(ps, lambda p: p.page)) END AS page_end FROM h""")
def x19_page_span(spark: SparkSession, d: str) -> DataFrame:
    """Turns as pages; the span of the stretch of 400 characters from the 41st on."""
    turns = F.array_sort(F.collect_list(F.struct((F.col("turn") + 1).alias("page"), F.coalesce("text", F.lit("")).alias("text"))))
    pages = table(spark, d, "conversations").groupBy("conv_id").agg(turns.alias("ps"))
    chunk = F.substring(F.array_join(F.transform("ps", lambda p: p["text"]), "\n"), 41, 400)
    return pages.select("conv_id", structure.page_span(chunk, F.col("ps")).alias("s")).select("conv_id", "s.page_start", "s.page_end")


ENTITIES = (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&copy;", "©"), ("&middot;", "·"), ("&amp;", "&"))


def sql_bare(joiner: str) -> str:
    t = rf"regexp_replace(regexp_replace(html, '(?is)<script\b.*?</script\s*>|<style\b.*?</style\s*>|<!--.*?-->', {joiner}, 'g'), '(?s)<[^>]*>', {joiner}, 'g')"
    for entity, sign in ENTITIES:
        t = f"replace({t}, '{entity}', '{sign}')"
    return t


@query(rf"SELECT page_id, trim(regexp_replace(regexp_replace({sql_bare('chr(10)')}, '[ \t\r]+', ' ', 'g'), '\s*\n\s*', chr(10), 'g'), ' ') AS text FROM pages")
def x9_html_to_text(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", X.strip_html(F.col("html")).alias("text"))


@query(rf"SELECT page_id, trim(regexp_replace({sql_bare(chr(39) + ' ' + chr(39))}, '\s+', ' ', 'g')) AS text FROM pages")
def x10_html_spaces(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", X.strip_html(F.col("html"), " ").alias("text"))


FAULTY = """CASE doc_id % 10 WHEN 0 THEN '  ' || chr(10) WHEN 1 THEN text || chr(65533) WHEN 2 THEN repeat(chr(2) || 'a b ', 40) WHEN 3 THEN text || repeat(chr(57344), length(text)) WHEN 4 THEN repeat('12 345 ', 30)
  WHEN 5 THEN repeat('Ãa Â', 20) || text WHEN 6 THEN 'CQNG HOAXA HQI ' || replace(text, 'đ', 'd') WHEN 7 THEN repeat('a b c ', 20) WHEN 8 THEN repeat(chr(8232), 20) || 'x' || repeat(chr(8233), 90) || 'y' ELSE text END"""
RATIOS = r"""n AS (SELECT doc_id, t, greatest(length(t), 1)::DOUBLE AS total, len(regexp_extract_all(t, '\p{L}')) AS letters,
  len(regexp_extract_all(replace(replace(t, chr(10), ''), chr(9), ''), '[\p{Cc}\p{Cf}]')) AS control, len(regexp_extract_all(t, '\p{Co}')) AS own,
  len(regexp_extract_all(replace(replace(replace(t, chr(10), ''), chr(9), ''), ' ', ''), '[\p{Cc}\p{Cf}\p{Co}\p{Z}]')) AS unprinted, len(regexp_extract_all(t, '[ÃÂÄÆÐðþ\x00]')) AS odd,
  len(regexp_extract_all(t, 'CQNG|HOAXA|HQI|NGHiA|DQc|Hqnh|phric|Th6ng|tli6u|ngdn|kh6|nhrlnh|nudc')) AS broken, len(regexp_extract_all(t, '[%s]')) AS marked, regexp_extract_all(t, '[\p{L}\p{N}_]+') AS ws
  FROM (SELECT doc_id, regexp_replace(coalesce(%s, ''), '^[\s\p{Z}\x1c-\x1f\x{85}]+|[\s\p{Z}\x1c-\x1f\x{85}]+$', '', 'g') AS t FROM documents))"""


@query("WITH " + RATIOS.replace("%s", X.MARKED + X.MARKED.upper(), 1).replace("%s", FAULTY, 1) + """
SELECT doc_id, CASE WHEN t = '' THEN 'text_layer_empty' ELSE concat_ws(',', CASE WHEN contains(t, chr(65533)) THEN 'replacement_character_found' END, CASE WHEN control / total > 0.01 THEN 'too_many_control_characters' END,
  CASE WHEN own / total > 0.005 THEN 'private_use_font_glyphs_found' END, CASE WHEN 1 - unprinted / total < 0.95 THEN 'too_many_non_printable_characters' END, CASE WHEN letters < 20 AND total > 80 THEN 'too_few_letters_for_text_page' END,
  CASE WHEN odd / total > 0.01 THEN 'possible_encoding_or_font_error' END, CASE WHEN broken >= 3 AND marked::DOUBLE / greatest(letters, 1) < 0.02 THEN 'possible_vietnamese_font_substitution_error' END,
  CASE WHEN len(ws) >= 30 AND len(list_filter(ws, lambda w: length(w) = 1))::DOUBLE / len(ws) > 0.65 THEN 'possible_broken_glyph_spacing' END) END AS faults FROM n""")
def f4_text_quality(spark: SparkSession, d: str) -> DataFrame:
    """All nine warnings, over texts that have each fault by rule and one tenth as they are."""
    doc, text = F.col("doc_id") % 10, F.col("text")
    times = lambda s, n: F.lit(s * n)
    made = (
        F.when(doc == 0, F.lit("  \n")).when(doc == 1, F.concat(text, F.lit("�"))).when(doc == 2, times("\x02a b ", 40)).when(doc == 3, F.concat(text, F.repeat(F.lit(""), F.length(text))))
        .when(doc == 4, times("12 345 ", 30)).when(doc == 5, F.concat(times("Ãa Â", 20), text)).when(doc == 6, F.concat(F.lit("CQNG HOAXA HQI "), F.replace(text, F.lit("đ"), F.lit("d"))))
        .when(doc == 7, times("a b c ", 20)).when(doc == 8, F.lit(" " * 20 + "x" + " " * 90 + "y")).otherwise(text)
    )
    return table(spark, d, "documents").select("doc_id", F.array_join(X.text_faults(made), ",").alias("faults"))


@query()
def x11_html_structure(spark: SparkSession, d: str) -> DataFrame:
    """Pages cleaned to their structural spine, with the number of tags dropped."""
    return html.cleaned(table(spark, d, "pages").select(F.col("page_id").cast("string").alias("source"), "html"))


@query()
def x13_html_chunks(spark: SparkSession, d: str) -> DataFrame:
    """Pages as trees of chunks: document, headings, leaves, breadcrumbs and the reading chain."""
    return html.chunked(table(spark, d, "pages").select(F.col("page_id").cast("string").alias("source"), "html"))


@query()
def x12_markdown_chunks(spark: SparkSession, d: str) -> DataFrame:
    """Texts as Markdown, with headings by rule, rendered and chunked like pages."""
    lines = F.transform(legal_lines(), lambda l, i: F.when(l.startswith("Chương") | l.startswith("Điều"), F.concat(F.lit("\n## "), l, F.lit("\n"))).when(i % 9 == 5, F.concat(F.lit("- "), l)).otherwise(l))
    made = table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("source"), F.array_join(lines, "\n").alias("markdown"))
    return html.chunked(html.rendered(made))
