"""Children, resolution, parent windows and evidence over the lines of documents, with legal headings by rule."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import hierarchy
from ..sources.tables import table
from .registry import query
from .structure import LEGAL, legal_lines

MOST = 400


def _chunks(spark: SparkSession, d: str) -> DataFrame:
    """Each line a hierarchical chunk of its document, some with metadata; every eleventh is of another strategy."""
    lines = table(spark, d, "documents").select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("source"), F.posexplode(legal_lines()).alias("k", "text"))
    i, none = F.col("k") + 1, F.lit(None).cast("string")
    structure = F.struct(
        F.when(i % 5 == 0, F.lit("V")).alias("chapter"),
        F.when(i % 7 == 0, i.cast("string")).alias("article"),
        F.when(i % 7 == 0, F.lit(" ")).otherwise(none).alias("clause"),
        none.alias("point"),
    )
    return lines.select(
        F.format_string("%s::h::%d", "source", i).alias("chunk_id"),
        F.when(i % 11 == 0, "semantic").otherwise("hierarchical").alias("strategy"),
        "source",
        F.floor(F.col("k") / 20).cast("int").alias("page_start"),
        F.floor(F.col("k") / 20).cast("int").alias("page_end"),
        "text",
        structure.alias("structure"),
        i.alias("record_no"),
    )


LINES = f"""l AS (SELECT source, i, ls[i] AS text FROM (SELECT *, unnest(range(1, len(ls) + 1)) AS i FROM (SELECT 'd' || doc_id AS source, {LEGAL} AS ls FROM documents))),
c AS (SELECT source || '::h::' || i AS chunk_id, source, i, (i - 1) // 20 AS page, text, CASE WHEN i % 5 = 0 THEN 'V' END AS mc, CASE WHEN i % 7 = 0 THEN i::VARCHAR END AS ma FROM l WHERE i % 11 <> 0)"""
GOT = r"nullif(regexp_extract(text, '{}', 1), '')"
RESOLVED = LINES + r""",
h AS (SELECT *, mc IS NOT NULL OR ma IS NOT NULL AS said, upper(""" + GOT.format(r"(?i)^\s*#{0,6}\s*Chương\s+([IVXLCDM0-9]+[A-Z]?)\b") + ") AS hc, " + GOT.format(r"(?i)^\s*#{0,6}\s*(?:\*\*)?Điều\s+([0-9]+[a-zA-Z]?)\b") + " AS ha, " + GOT.format(r"^\s*(\d+)\.\s+") + " AS hl, lower(" + GOT.format(r"(?i)^\s*([a-zđ])\)\s+") + r""") AS hp,
  regexp_extract_all(text, '(?i)(?:^|[^\p{L}\p{N}_])Điều\s+([0-9]+[a-zA-Z]?)\b', 1) AS mentions FROM c),
o AS (SELECT *, CASE WHEN said THEN coalesce(mc, hc) ELSE hc END AS oc, CASE WHEN said THEN coalesce(ma, ha) ELSE ha END AS oa FROM h),
p AS (SELECT *, last_value(oc IGNORE NULLS) OVER w AS lc, last_value(oa IGNORE NULLS) OVER w AS la, row_number() OVER (PARTITION BY source ORDER BY i) AS ord FROM o WINDOW w AS (PARTITION BY source ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
m AS (SELECT *, CASE WHEN said THEN 'metadata' WHEN ha IS NOT NULL OR hc IS NOT NULL THEN 'heading_inferred' WHEN la IS NOT NULL THEN 'carried_forward' ELSE 'document_fallback' END AS method FROM p),
r AS (SELECT *, CASE WHEN method IN ('carried_forward', 'document_fallback') THEN lc ELSE oc END AS chapter, CASE WHEN method IN ('carried_forward', 'document_fallback') THEN la ELSE oa END AS article,
  coalesce(said AND ha <> ma, false) AS xa, coalesce(said AND hc <> mc, false) AS xc, ha IS NOT NULL AND len(list_distinct(mentions)) > 1 AS many FROM m),
z AS (SELECT *, CASE WHEN article IS NULL THEN 'document::' || source ELSE 'article::' || lower(article) END AS article_key, xa OR xc OR many AS ambiguous,
  concat_ws(',', CASE WHEN xa THEN 'metadata_heading_conflict' END, CASE WHEN xc THEN 'metadata_heading_conflict' END, CASE WHEN said AND ha IS NOT NULL AND ma IS NULL THEN 'metadata_missing_article_heading_used' END,
    CASE WHEN said AND hc IS NOT NULL AND mc IS NULL THEN 'metadata_missing_chapter_heading_used' END, CASE WHEN NOT said THEN 'missing_structure_metadata' END, CASE method WHEN 'heading_inferred' THEN 'heading_detected_from_text' WHEN 'carried_forward' THEN 'carried_forward_article' WHEN 'document_fallback' THEN 'document_fallback' END,
    CASE WHEN ha IS NULL AND len(mentions) > 0 THEN 'inline_article_reference_ignored' END, CASE WHEN many THEN 'multiple_article_candidates' END) AS warnings,
  CASE WHEN article IS NOT NULL AND trim(text) <> '' THEN substr(regexp_replace(regexp_replace(trim(text), '\s+', ' ', 'g'), '^[ #*]+|[ #*]+$', '', 'g'), 1, 240) ELSE 'Document fallback: ' || source END AS parent_title FROM r)"""


@query(f"WITH {LINES} SELECT chunk_id, source, i AS sequence, row_number() OVER (PARTITION BY source ORDER BY i) AS ord FROM c")
def s11_hierarchy_children(spark: SparkSession, d: str) -> DataFrame:
    return hierarchy.children(_chunks(spark, d)).select("chunk_id", "source", "sequence", "ord")


@query(f"WITH {LINES} SELECT chunk_id, n FROM (SELECT chunk_id, count(*) AS n FROM (SELECT chunk_id FROM c UNION ALL SELECT chunk_id FROM c WHERE i % 13 = 0) GROUP BY chunk_id) WHERE n > 1")
def s11_repeated_ids(spark: SparkSession, d: str) -> DataFrame:
    """What the scan refuses: ids that occur again (here every thirteenth)."""
    rows = hierarchy.children(_chunks(spark, d))
    return hierarchy.repeated(rows.unionByName(rows.where("record_no % 13 = 0")))


@query(f"WITH {RESOLVED} SELECT chunk_id, method, chapter, article, hl AS clause, hp AS point, ambiguous, warnings, article_key, parent_title FROM z")
def z9_resolve_children(spark: SparkSession, d: str) -> DataFrame:
    out = hierarchy.resolved(hierarchy.children(_chunks(spark, d)))
    return out.select("chunk_id", "method", "path.chapter", "path.article", "path.clause", "path.point", "ambiguous", F.array_join("warnings", ",").alias("warnings"), "article_key", "parent_title")


WINDOWED = RESOLVED + f""",
g AS (SELECT source, article_key, list(chunk_id ORDER BY i) AS ids, list(length(text) ORDER BY i) AS ns FROM z GROUP BY ALL),
f AS (SELECT source, article_key, ids, list_reduce(list_prepend({{'w': []::INTEGER[], 'used': 0::BIGINT}}, list_transform(ns, lambda n: {{'w': []::INTEGER[], 'used': n::BIGINT}})),
  lambda a, x: CASE WHEN len(a.w) = 0 THEN {{'w': [1], 'used': x.used}} WHEN a.used + CASE WHEN a.used > 0 THEN 2 ELSE 0 END + x.used > {MOST} THEN {{'w': list_append(a.w, a.w[-1] + 1), 'used': x.used}}
    ELSE {{'w': list_append(a.w, a.w[-1]), 'used': a.used + CASE WHEN a.used > 0 THEN 2 ELSE 0 END + x.used}} END).w AS ws FROM g),
u AS (SELECT source, article_key, unnest(ids) AS chunk_id, unnest(ws) AS window_index FROM f),
pw AS (SELECT z.*, window_index, 'parent::' || substr(sha256(z.source || '|' || z.article_key || '|' || window_index), 1, 16) || '::w' || printf('%04d', window_index) AS parent_id FROM z JOIN u USING (source, article_key, chunk_id))"""


@query(f"WITH {WINDOWED} SELECT parent_id, source, article_key, window_index, min(page) AS page_start, max(page) AS page_end, string_agg(chunk_id, ',' ORDER BY i) AS child_ids, md5(string_agg(text, chr(10) || chr(10) ORDER BY i)) AS md5, length(string_agg(text, chr(10) || chr(10) ORDER BY i)) AS char_count, count(*) FILTER (ambiguous) AS ambiguous_child_count, concat_ws(',', CASE WHEN count(*) = 1 AND max(length(text)) > {MOST} THEN 'oversized_single_child' END, CASE WHEN count(*) FILTER (ambiguous) > 0 THEN 'contains_ambiguous_children' END) AS warnings FROM pw GROUP BY ALL")
def a10_parent_windows(spark: SparkSession, d: str) -> DataFrame:
    """Parents of at most 400 characters; a longer child is one by itself."""
    out = hierarchy.parents(hierarchy.windowed(hierarchy.resolved(hierarchy.children(_chunks(spark, d))), MOST), MOST)
    return out.select("parent_id", "source", "article_key", "window_index", "page_start", "page_end", F.array_join("child_ids", ",").alias("child_ids"), F.md5("text").alias("md5"), "char_count", "ambiguous_child_count", F.array_join("warnings", ",").alias("warnings"))


@query(f"WITH {WINDOWED}, pa AS (SELECT parent_id, count(*) FILTER (ambiguous) AS k, count(*) AS n, max(length(text)) AS most FROM pw GROUP BY parent_id), ws AS (SELECT unnest(string_split(warnings, ',')) AS name FROM z WHERE warnings <> '' UNION ALL SELECT 'contains_ambiguous_children' FROM pa WHERE k > 0 UNION ALL SELECT 'oversized_single_child' FROM pa WHERE n = 1 AND most > {MOST}) SELECT 'method:' || method AS name, count(*) AS n FROM z GROUP BY method UNION ALL SELECT 'warning:' || name, count(*) FROM ws GROUP BY name UNION ALL SELECT 'children', count(*) FROM z UNION ALL SELECT 'parents', count(*) FROM pa UNION ALL SELECT 'sources', count(DISTINCT source) FROM z")
def z8_hierarchy_audit(spark: SparkSession, d: str) -> DataFrame:
    """Counts of children, parents, sources, methods and warnings, without anything written."""
    kids = hierarchy.windowed(hierarchy.resolved(hierarchy.children(_chunks(spark, d))), MOST)
    made = hierarchy.parents(kids, MOST)
    named = lambda df, kind, c: df.select(F.concat(F.lit(kind), c).alias("name"))
    rows = named(kids, "method:", F.col("method")).unionByName(named(kids.select(F.explode("warnings").alias("w")), "warning:", F.col("w"))).unionByName(named(made.select(F.explode("warnings").alias("w")), "warning:", F.col("w")))
    rows = rows.unionByName(kids.select(F.lit("children").alias("name"))).unionByName(made.select(F.lit("parents").alias("name"))).unionByName(kids.select("source").distinct().select(F.lit("sources").alias("name")))
    return rows.groupBy("name").agg(F.count("*").alias("n"))


@query("SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY n NULLS LAST, doc_id) AS ord FROM (SELECT doc_id, source, nullif(regexp_extract(id, '(\\d+)\\D*$', 1), '')::BIGINT AS n FROM (SELECT doc_id, source, CASE WHEN doc_id % 4 = 0 THEN 'none' ELSE 'v' || doc_id % 3 || '-' || n_chars || CASE WHEN doc_id % 2 = 0 THEN '.txt' ELSE '' END END AS id FROM documents))")
def t15_natural_sequence(spark: SparkSession, d: str) -> DataFrame:
    """Order by the last number anywhere in an id; ids without one come last."""
    k = F.col("doc_id")
    made = F.concat(F.lit("v"), (k % 3).cast("string"), F.lit("-"), F.col("n_chars").cast("string"), F.when(k % 2 == 0, ".txt").otherwise(""))
    rows = table(spark, d, "documents").select("doc_id", "source", hierarchy.last_number(F.when(k % 4 == 0, "none").otherwise(made)).alias("n"))
    return rows.select("doc_id", "source", F.row_number().over(Window.partitionBy("source").orderBy(F.col("n").asc_nulls_last(), "doc_id")).alias("ord"))


@query("SELECT * FROM (SELECT source, doc_id, rank, 'P' || row_number() OVER (PARTITION BY source ORDER BY rank) AS evidence_id FROM (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY n_chars, doc_id) AS rank, CASE WHEN n_chars % 5 > 0 THEN (n_chars % 10) / 10.0 END AS score FROM documents) WHERE coalesce(score, -1) >= 0.5)")
def w16_accepted_evidence(spark: SparkSession, d: str) -> DataFrame:
    """Accepted parents numbered anew; one without a score isn't accepted."""
    rank = F.row_number().over(Window.partitionBy("source").orderBy("n_chars", "doc_id"))
    rows = table(spark, d, "documents").select("source", "doc_id", rank.alias("rank"), F.when(F.col("n_chars") % 5 > 0, (F.col("n_chars") % 10) / 10.0).alias("score"))
    return hierarchy.evidence(rows, "source", "score", 0.5, "P").drop("score")
