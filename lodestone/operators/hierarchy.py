"""Children of legal texts resolved to their articles, gathered into parent windows, and kept in a store with a manifest.

Resolution is one window over each source; parents are one fold over each article's children.  The store is three parquet tables
under a version folder that a pointer names, so a reader sees all of a build or none of it.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources import sinks

KEYS = ("chapter", "article", "clause", "point")

# Headings at the start of a child, and mentions of articles anywhere in it.
CHAPTER = r"(?iu)^\s*#{0,6}\s*Chương\s+([IVXLCDM0-9]+[A-Z]?)\b"
ARTICLE = r"(?iu)^\s*#{0,6}\s*(?:\*\*)?Điều\s+([0-9]+[a-zA-Z]?)\b"
CLAUSE = r"^\s*(\d+)\.\s+"
POINT = r"(?iu)^\s*([a-zđ])\)\s+"
MENTION = r"(?iu)(?<![\p{L}\p{N}_])Điều\s+([0-9]+[a-zA-Z]?)\b"
NOT_READY, READY = "hierarchy_not_ready", "ready"
SCHEMA_VERSION = 1


def last_number(c: Column) -> Column:
    """The last number in an id, null without one."""
    found = F.regexp_extract(c, r"(\d+)\D*$", 1)
    return F.when(found != "", found.cast("bigint"))


def children(chunks: DataFrame) -> DataFrame:
    """Hierarchical chunks with their place in the source: by the last number of the id (none: at the end), then by record_no."""
    rows = chunks.where("strategy = 'hierarchical'").withColumn("sequence", last_number(F.col("chunk_id")))
    order = [F.col("sequence").asc_nulls_last(), "record_no"]
    return rows.withColumn("ord", F.row_number().over(Window.partitionBy("source").orderBy(*order)))


def repeated(rows: DataFrame, key: str = "chunk_id") -> DataFrame:
    """Ids that occur more than once."""
    return rows.groupBy(key).agg(F.count("*").alias("n")).where("n > 1")


def headings(text: Column) -> Column:
    """Chapter, article, clause and point named at the start of the first line with words among the first three."""
    lines = F.filter(F.slice(F.split(text, r"\r\n|[\n\r]"), 1, 3), lambda x: F.trim(x) != "")
    first = F.coalesce(F.get(lines, F.lit(0)), F.substring(text, 1, 300))
    got = lambda p: F.nullif(F.regexp_extract(first, p, 1), F.lit(""))
    return F.struct(F.upper(got(CHAPTER)).alias("chapter"), got(ARTICLE).alias("article"), got(CLAUSE).alias("clause"), F.lower(got(POINT)).alias("point"))


def label_key(c: Column) -> Column:
    return F.lower(F.regexp_replace(F.coalesce(c, F.lit("")), r"\s+", ""))


def article_key(source: Column, article: Column) -> Column:
    named = F.lower(F.regexp_replace(F.regexp_replace(source, "[^0-9a-zA-Z]+", "-"), "^-+|-+$", ""))
    return F.when(article.isNotNull(), F.concat(F.lit("article::"), label_key(article))).otherwise(F.concat(F.lit("document::"), F.when(named == "", "document").otherwise(named)))


def resolved(rows: DataFrame) -> DataFrame:
    """(chunk_id, source, ord, text, structure struct of KEYS) with its path, how that was found, warnings and the article's key.

    What the metadata says comes first, with headings for what it leaves out; else the headings; else the last article before;
    else the document.  A child with metadata or a heading but no article inherits none."""
    w = Window.partitionBy("source").orderBy("ord").rowsBetween(Window.unboundedPreceding, -1)
    meta = lambda k: F.nullif(F.trim(F.col(f"structure.{k}")), F.lit(""))
    h = lambda k: F.col(f"h.{k}")
    df = rows.withColumn("h", headings(F.col("text"))).withColumn("said", reduce(lambda a, b: a | b, [meta(k).isNotNull() for k in KEYS]))
    own = lambda k: F.when(F.col("said"), F.coalesce(meta(k), h(k))).otherwise(h(k))
    method = F.when(F.col("said"), "metadata").when(h("article").isNotNull() | h("chapter").isNotNull(), "heading_inferred")
    df = df.withColumn("own_chapter", own("chapter")).withColumn("own_article", own("article")).withColumn("method", method)
    df = df.withColumn("last_chapter", F.last("own_chapter", ignorenulls=True).over(w)).withColumn("last_article", F.last("own_article", ignorenulls=True).over(w))
    df = df.withColumn("method", F.coalesce("method", F.when(F.col("last_article").isNotNull(), "carried_forward"), F.lit("document_fallback")))
    free = F.col("method").isin("carried_forward", "document_fallback")
    path = F.struct(
        F.when(free, F.col("last_chapter")).otherwise(F.col("own_chapter")).alias("chapter"),
        F.when(free, F.col("last_article")).otherwise(F.col("own_article")).alias("article"),
        F.coalesce(F.when(F.col("said"), meta("clause")), h("clause")).alias("clause"),
        F.coalesce(F.when(F.col("said"), meta("point")), h("point")).alias("point"),
    )
    mentions = F.regexp_extract_all("text", F.lit(MENTION), 1)
    unlike = lambda k: F.col("said") & h(k).isNotNull() & meta(k).isNotNull() & (label_key(h(k)) != label_key(meta(k)))
    several = h("article").isNotNull() & (F.size(F.array_distinct(mentions)) > 1)
    inferred, bare = F.col("method") == "heading_inferred", ~F.col("said")
    warnings = F.array_compact(F.array(
        F.when(unlike("article"), F.lit("metadata_heading_conflict")),
        F.when(unlike("chapter"), F.lit("metadata_heading_conflict")),
        F.when(F.col("said") & h("article").isNotNull() & meta("article").isNull(), F.lit("metadata_missing_article_heading_used")),
        F.when(F.col("said") & h("chapter").isNotNull() & meta("chapter").isNull(), F.lit("metadata_missing_chapter_heading_used")),
        F.when(bare, F.lit("missing_structure_metadata")),
        F.when(inferred, F.lit("heading_detected_from_text")),
        F.when(F.col("method") == "carried_forward", F.lit("carried_forward_article")),
        F.when(F.col("method") == "document_fallback", F.lit("document_fallback")),
        F.when(h("article").isNull() & (F.size(mentions) > 0), F.lit("inline_article_reference_ignored")),
        F.when(several, F.lit("multiple_article_candidates")),
    ))
    first = F.get(F.filter(F.transform(F.split("text", r"\r\n|[\n\r]"), lambda x: F.trim(x)), lambda x: x != ""), F.lit(0))
    title = F.substring(F.regexp_replace(F.regexp_replace(first, r"\s+", " "), "^[ #*]+|[ #*]+$", ""), 1, 240)
    out = df.withColumn("path", path).withColumn("ambiguous", unlike("article") | unlike("chapter") | several).withColumn("warnings", warnings)
    out = out.withColumn("article_key", article_key(F.col("source"), F.col("path.article")))
    named = F.when(F.col("path.article").isNotNull(), F.nullif(title, F.lit("")))
    out = out.withColumn("parent_title", F.coalesce(named, F.concat(F.lit("Document fallback: "), "source")))
    return out.drop("h", "said", "own_chapter", "own_article", "last_chapter", "last_article")


def window_numbers(sizes: Column, most: int, gap: int = 2) -> Column:
    """The window, from 1, of each of a list of sizes: one closes where the next size, with a gap, would pass `most`."""
    start = F.struct(F.array().cast("array<int>").alias("out"), F.lit(0).alias("n"), F.lit(0).cast("bigint").alias("used"))

    def step(a: Column, x: Column) -> Column:
        grown = a.used + F.when(a.used > 0, gap).otherwise(0) + x
        new = (F.size(a.out) == 0) | (grown > most)
        n = F.when(new, a.n + 1).otherwise(a.n)
        return F.struct(F.array_append(a.out, n).alias("out"), n.alias("n"), F.when(new, x).otherwise(grown).cast("bigint").alias("used"))

    return F.aggregate(sizes, start, step, lambda a: a.out)


def parent_id(source: Column, key: Column, window: Column) -> Column:
    digest = F.substring(F.sha2(F.concat_ws("|", source, key, window.cast("string")).cast("binary"), 256), 1, 16)
    return F.concat(F.lit("parent::"), digest, F.lit("::w"), F.lpad(window.cast("string"), 4, "0"))


def windowed(rows: DataFrame, most: int) -> DataFrame:
    """Resolved children with their window and parent_id.  The children of one article of one source are gathered, as its windows follow
    each other; no more than one document's."""
    own = F.struct(F.col("sequence").isNull().alias("none"), "sequence", "chunk_id", F.length("text").alias("n"))
    lists = rows.groupBy("source", "article_key").agg(F.array_sort(F.collect_list(own)).alias("xs"))
    numbers = lists.withColumn("w", window_numbers(F.transform("xs", lambda x: x.n), most))
    placed = numbers.select("source", "article_key", F.posexplode(F.arrays_zip(F.transform("xs", lambda x: x.chunk_id).alias("chunk_id"), F.col("w").alias("w"))).alias("at", "z"))
    placed = placed.select("source", "article_key", "at", "z.chunk_id", F.col("z.w").alias("window_index"))
    return rows.join(placed, ["source", "article_key", "chunk_id"]).withColumn("parent_id", parent_id(F.col("source"), F.col("article_key"), F.col("window_index")))


def parents(rows: DataFrame, most: int) -> DataFrame:
    """windowed() children to one row a parent: its children in order, their text, pages and warnings."""
    own = F.struct("at", "chunk_id", "text", "ambiguous", "page_start", "page_end")
    out = rows.groupBy("parent_id", "source", "article_key", "window_index").agg(F.array_sort(F.collect_list(own)).alias("xs"))
    text = F.array_join(F.transform("xs", lambda x: x["text"]), "\n\n")
    doubtful = F.size(F.filter("xs", lambda x: x.ambiguous))
    large = (F.length(text) > most) & (F.size("xs") == 1)
    return out.select(
        "parent_id", "source", "article_key", "window_index",
        F.array_min(F.transform("xs", lambda x: x.page_start)).alias("page_start"),
        F.array_max(F.transform("xs", lambda x: x.page_end)).alias("page_end"),
        F.transform("xs", lambda x: x.chunk_id).alias("child_ids"),
        text.alias("text"),
        F.length(text).alias("char_count"),
        doubtful.alias("ambiguous_child_count"),
        F.array_compact(F.array(F.when(large, F.lit("oversized_single_child")), F.when(doubtful > 0, F.lit("contains_ambiguous_children")))).alias("warnings"),
    )


def build(spark: SparkSession, chunks: DataFrame, path: str, fingerprint: str, most: int) -> None:
    """Resolves, gathers and writes children, parents and manifest under a new version, then points to it.  ValueError for repeated ids."""
    kids = children(chunks)
    twice = repeated(kids).limit(1).collect()
    if twice:
        raise ValueError(f"duplicate chunk_id {twice[0].chunk_id}")
    rows = windowed(resolved(kids), most)
    with sinks.Version(spark, path) as at:
        rows.write.parquet(f"{at}/children")
        written = spark.read.schema(rows.schema).parquet(f"{at}/children")
        parents(written, most).write.parquet(f"{at}/parents")
        made = spark.read.parquet(f"{at}/parents")
        counts = written.agg(F.count("*").alias("n_children"), F.countDistinct("source").alias("n_sources")).crossJoin(made.agg(F.count("*").alias("n_parents")))
        said = written.select(F.explode("warnings").alias("w")).unionByName(made.select(F.explode("warnings").alias("w"))).groupBy("w").agg(F.count("*").alias("n"))
        listed = said.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("w", "n")))).alias("warning_counts"))
        counts.crossJoin(listed).select(F.lit(SCHEMA_VERSION).alias("schema_version"), F.lit(fingerprint).alias("fingerprint"), F.lit(most).alias("parent_max_chars"), "*").write.json(f"{at}/manifest")


def status(spark: SparkSession, path: str, fingerprint: str | None = None, most: int | None = None) -> tuple[str, list[str]]:
    """Whether a store is there, readable and made from this input with this setting; reads the manifest only and writes nothing."""
    at = sinks.current(spark, path)
    if at is None:
        return NOT_READY, ["missing_hierarchy_store_files"]
    missing = [x for x in ("children", "parents", "manifest") if not sinks.exists(spark, f"{at}/{x}/_SUCCESS")]
    if missing:
        return NOT_READY, [f"missing_hierarchy_store_files: {','.join(missing)}"]
    row = spark.read.json(f"{at}/manifest").first()
    if row is None:
        return NOT_READY, ["read_hierarchy_store_failed"]
    found = [
        "stale_hierarchy_schema_version" if row["schema_version"] != SCHEMA_VERSION else "",
        "missing_hierarchy_input_fingerprint" if not row["fingerprint"] else "stale_hierarchy_input_fingerprint" if fingerprint not in (None, row["fingerprint"]) else "",
        "stale_hierarchy_config: parent_max_chars" if most not in (None, row["parent_max_chars"]) else "",
    ]
    found = [x for x in found if x]
    return (NOT_READY if found else READY), found


def store(spark: SparkSession, path: str, **asked) -> dict[str, DataFrame]:
    """children and parents of a ready store; ValueError with its warnings for another."""
    said, found = status(spark, path, **asked)
    if said != READY:
        raise ValueError(f"{said}: {'; '.join(found)}")
    at = sinks.current(spark, path)
    return {x: spark.read.parquet(f"{at}/{x}") for x in ("children", "parents")}


def evidence(rows: DataFrame, by: str, score: str, least: float, letter: str, order: str = "rank") -> DataFrame:
    """Rows of at least a score, with labels numbered over those only."""
    w = Window.partitionBy(by).orderBy(order)
    return rows.where(F.coalesce(F.col(score), F.lit(-1.0)) >= least).withColumn("evidence_id", F.concat(F.lit(letter), F.row_number().over(w)))

