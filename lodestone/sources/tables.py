"""Readers: parquet tables, all-string CSV, strict and loose JSON chunks, whole-text pages, files with fingerprints."""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text as X

CHUNK = T.StructType([T.StructField(n, t) for n, t in (("chunk_id", T.StringType()), ("strategy", T.StringType()), ("source", T.StringType()), ("page_start", T.IntegerType()), ("page_end", T.IntegerType()), ("text", T.StringType()))])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def settled(df: DataFrame) -> DataFrame:
    """df, computed and kept in the folder of spark.checkpoint.dir, so that steps that read it again don't repeat what made it and a lost
    executor doesn't either.  Where the setting is missing, a local session gets a folder of its own; on a cluster that is an error."""
    context = df.sparkSession.sparkContext
    if not context.getCheckpointDir():
        folder = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not folder:
            if context.master != "local" and not context.master.startswith("local["):
                raise ValueError("spark.checkpoint.dir names no shared folder for the steps' results")
            folder = tempfile.mkdtemp(prefix="checkpoint-")
        context.setCheckpointDir(folder)
    return df.checkpoint()


def views(spark: SparkSession, sf_dir: str, *names: str) -> None:
    for name in names:
        table(spark, sf_dir, name).createOrReplaceTempView(name)


def csv_strings(spark: SparkSession, path: str) -> DataFrame:
    """Header, every column a string, quoted newlines, and no byte-order mark in the first name."""
    df = spark.read.csv(path, header=True, inferSchema=False, multiLine=True, escape='"')
    return df.toDF(*[c.removeprefix("﻿") for c in df.columns])


def unique(df: DataFrame, key: str) -> DataFrame:
    """df, or ValueError if a key occurs twice; reads the keys once."""
    twice = df.groupBy(key).count().where("count > 1").limit(1).collect()
    if twice:
        raise ValueError(f"duplicate {key}: {twice[0][0]}")
    return df


def secure_corpus(spark: SparkSession, path: str) -> DataFrame:
    """CSV chunks with allowed_roles as an array; ids must be unique."""
    df = csv_strings(spark, path)
    if "allowed_roles" not in df.columns:
        raise ValueError("allowed_roles is missing")
    return unique(df.withColumn("allowed_roles", F.transform(F.split("allowed_roles", ","), lambda x: F.trim(x))), "chunk_id")


def chunk_faults() -> Column:
    """What is wrong with a record, in order; empty if nothing."""
    need = [F.when(F.col(c).isNull(), F.lit(f"{c} is missing")) for c in CHUNK.names]
    return F.array_compact(F.array(*need, F.when(F.col("page_start") < 1, F.lit("page_start is below 1")), F.when(F.col("page_start") > F.col("page_end"), F.lit("page_start is after page_end"))))


def json_chunks(spark: SparkSession, path: str, strategy: str | None = None) -> DataFrame:
    """Strict scan of a list of chunks or {"chunks": [...]}; blank texts are skipped, faults and repeated ids raise."""
    raw = spark.read.json(path, multiLine=True, schema=T.StructType([*CHUNK.fields, T.StructField("chunks", T.ArrayType(CHUNK))]))
    flat = raw.select(F.inline(F.coalesce("chunks", F.array(F.struct(*CHUNK.names)))))
    flat = flat.where(F.col("strategy") == strategy) if strategy else flat
    bad = flat.select("chunk_id", chunk_faults().alias("faults")).where("size(faults) > 0").limit(1).collect()
    if bad:
        raise ValueError(f"{bad[0].chunk_id}: {'; '.join(bad[0].faults)}")
    return unique(flat.where("trim(text) <> ''"), "chunk_id")


def loose_json(spark: SparkSession, path: str) -> DataFrame:
    """Array, object under chunks, data, documents or items, or a single object; text, source and id by fallback keys."""
    whole = spark.read.text(path, wholetext=True).select(F.col("value").alias("v"))
    many = "array<map<string,string>>"
    wrapped = F.from_json("v", "map<string,string>")
    inner = F.coalesce(*[F.from_json(F.try_element_at(wrapped, F.lit(k)), many) for k in ("chunks", "data", "documents", "items")])
    rows = whole.select(F.explode(F.coalesce(F.when(F.ltrim("v").startswith("["), F.from_json("v", many)), inner, F.array(wrapped))).alias("r"))
    pick = lambda *ks: F.coalesce(*[F.try_element_at("r", F.lit(k)) for k in ks])
    return rows.select(pick("chunk_id", "id", "_id").alias("chunk_id"), pick("document_id", "doc_id", "source").alias("document_id"), pick("source", "file", "filename").alias("source"), pick("text", "content", "page_content", "body").alias("text"))


def pages_of_markdown(docs: DataFrame) -> DataFrame:
    """(source, text) split on lines that mark pages; without a mark all is page 1; an empty text is an empty page with a warning."""
    mark = r"(?im)^[#*\s-]*(?:page|trang)\s+\d+[^\n]*$"
    marked = docs.withColumn("numbers", F.regexp_extract_all("text", F.lit(r"(?im)^[#*\s-]*(?:page|trang)\s+(\d+)[^\n]*$"), 1)).withColumn("parts", F.split("text", mark))
    several = F.transform(F.slice("parts", 2, F.size("parts")), lambda p, i: F.struct(F.get("numbers", i).cast("int").alias("page"), F.trim(p).alias("text")))
    one = F.array(F.struct(F.lit(1).alias("page"), F.trim("text").alias("text")))
    return marked.select("source", F.inline(F.when(F.size("numbers") > 0, several).otherwise(one))).withColumn("warning", F.when(F.coalesce("text", F.lit("")) == "", F.lit("empty page")))


def whole_texts(spark: SparkSession, path: str, pattern: str = "*.md") -> DataFrame:
    return spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", pattern).text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def fingerprints(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path).select("path", F.sha2("content", 256).alias("sha256"), F.md5("content").alias("md5"), "length")


def changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """(path, change) of files whose fingerprints() differ: added, removed or changed; none where a step left its sources as they were."""
    a, b = before.select("path", F.col("sha256").alias("a")), after.select("path", F.col("sha256").alias("b"))
    what = F.when(F.col("a").isNull(), "added").when(F.col("b").isNull(), "removed").when(F.col("a") != F.col("b"), "changed")
    return a.join(b, "path", "full").select("path", what.alias("change")).where("change is not null")


def script_statements(scripts: DataFrame) -> DataFrame:
    """(path, text) to its statements: split on a ; at a line's end, comment lines dropped."""
    bare = F.regexp_replace("text", r"(?m)^\s*//.*$", "")
    return scripts.select("path", F.posexplode(F.filter(F.transform(F.split(bare, r";\s*(?:\n|$)"), X.stripped), lambda s: s != ""))).toDF("path", "n", "statement")


def files(spark: SparkSession, path: str, pattern: str = "*.pdf", only: list[str] | None = None) -> DataFrame:
    """(path, name, length) of the files below a folder, without their contents; only: names to keep."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(path).select("path", "length")
    rows = rows.withColumn("name", F.element_at(F.split("path", "/"), -1))
    return rows.where(F.col("name").isin(only)) if only else rows


def collection_faults(asked: dict[str, str], dim: Column, want: int) -> Column:
    """Names of what a collection's rows say otherwise than asked, and dim."""
    odd = [F.when(~F.col(k).eqNullSafe(F.lit(v)), F.lit(k)) for k, v in asked.items()]
    return F.array_compact(F.array(*odd, F.when(dim != want, F.lit("dim"))))


# Kinds of evaluation questions.
QUESTION_TYPES = ("exact", "paraphrase", "multi_aspect", "hierarchy_context", "out_of_scope")


def question_faults(questions: DataFrame, known: DataFrame, key: str = "doc_id") -> DataFrame:
    """(question_id, question, question_type, ids) with what is wrong with each; known: the ids that there are."""
    said = questions.select("question_id", F.posexplode("ids").alias("at", key))
    stale = said.join(known.select(key).distinct(), key, "left_anti").groupBy("question_id").agg(F.array_sort(F.collect_list(F.struct("at", key))).alias("gone"))
    gone = F.array_join(F.transform("gone", lambda x: x[key].cast("string")), " ")
    found = F.array_compact(F.array(
        F.when(F.col("question").isNull(), F.lit("question is missing")),
        F.when(~F.col("question_type").isin(*QUESTION_TYPES), F.lit("unknown question_type")),
        F.when(F.col("gone").isNotNull(), F.concat(F.lit("stale ids: "), gone)),
    ))
    return questions.join(stale, "question_id", "left").select("question_id", F.array_join(found, ",").alias("faults"))


def questions(spark: SparkSession, path: str, known: DataFrame) -> DataFrame:
    """A JSON list of questions; ValueError for the first with a fault."""
    rows = spark.read.json(path, multiLine=True, schema="question_id string, question string, question_type string, relevant_child_ids array<string>, relevant_parent_ids array<string>, needs_human_review boolean, notes string")
    faults = question_faults(rows.withColumn("ids", F.col("relevant_parent_ids")), known, known.columns[0])
    bad = faults.where("faults <> ''").limit(1).collect()
    if bad:
        raise ValueError(f"{bad[0].question_id}: {bad[0].faults}")
    return rows
