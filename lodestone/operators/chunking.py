"""Chunkers and sequential packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def fixed(docs: DataFrame, size: int = 1200, overlap: int = 150) -> DataFrame:
    """Windows of `size` characters; the one that reaches the end is the last."""
    n, step = F.length("text"), size - overlap
    last = F.ceil(F.greatest(n - size, F.lit(0)) / step).cast("int")
    return docs.where("length(text) > 0").select("doc_id", "text", F.explode(F.sequence(F.lit(0), last)).alias("chunk")).select("doc_id", "chunk", F.substring("text", F.col("chunk") * step + 1, F.lit(size)).alias("text"))


def by_marker(docs: DataFrame, marker: str) -> DataFrame:
    """A chunk for each stretch that begins with a marker, and one for what stands before the first, if any."""
    parts = F.split("text", f"(?m)(?={marker})")
    return docs.select("doc_id", F.posexplode(F.filter(parts, lambda p: F.trim(p) != ""))).toDF("doc_id", "chunk", "text").withColumn("marker", F.regexp_extract("text", f"^({marker})", 1))


def paragraphs(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.posexplode(F.filter(F.transform(F.split("text", r"\n\s*\n|\n"), lambda x: F.trim(x)), lambda p: p != ""))).toDF("doc_id", "chunk", "text")


def packed(items: DataFrame, by: str, order: str, size: str, most: int, gap: int = 2) -> DataFrame:
    """Greedy windows: one closes when the next item, with a gap, would pass `most`.  (by, window, items, chars)"""
    row = items.groupBy(by).agg(F.array_sort(F.collect_list(F.struct(F.col(order).cast("long").alias("o"), F.col(size).cast("long").alias("n")))).alias("xs"))
    start = F.array().cast("array<struct<items: bigint, chars: bigint>>")

    def step(a, x):
        end = F.try_element_at(a, F.lit(-1))
        fits = (F.size(a) > 0) & (end.chars + gap + x.n <= most)
        grown = F.struct((end["items"] + 1).alias("items"), (end.chars + gap + x.n).alias("chars"))
        return F.when(fits, F.array_append(F.slice(a, 1, F.greatest(F.size(a) - 1, F.lit(0))), grown)).otherwise(F.array_append(a, F.struct(F.lit(1).cast("long").alias("items"), x.n.alias("chars"))))

    return row.select(by, F.posexplode(F.aggregate("xs", start, step)).alias("window", "w")).select(by, "window", F.col("w.items").alias("items"), F.col("w.chars").alias("chars"))


def carried(rows: DataFrame, by: str, order: str, column: str) -> DataFrame:
    """The last value that isn't null, so far."""
    w = Window.partitionBy(by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn(f"{column}_carried", F.last(column, ignorenulls=True).over(w))


def chained(rows: DataFrame, by: str, order: str, key: str) -> DataFrame:
    return rows.withColumn("next_id", F.lead(key).over(Window.partitionBy(by).orderBy(order)))
