"""Writers: staged overwrite, versioned stores, keyed upserts, and the merge rules of property graphs on parquet tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _fs(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def exists(spark: SparkSession, path: str) -> bool:
    fs, where = _fs(spark, path)
    return fs.exists(where)


def staged(df: DataFrame, path: str) -> None:
    """Written beside the target, then put in its place.  The old table moves aside first and goes last, so after a crash at any time the
    rows are at the target or beside it; recovered() puts them back."""
    spark = df.sparkSession
    recovered(spark, path)
    fs, target = _fs(spark, path)
    stage, old = (_fs(spark, f"{path}.{x}")[1] for x in (f"stage-{uuid.uuid4().hex}", "old"))
    df.write.parquet(stage.toString())
    if fs.exists(target) and not fs.rename(target, old):
        raise OSError(f"{path} could not be moved aside")
    if not fs.rename(stage, target):
        raise OSError(f"{stage} could not be moved to {target}")
    fs.delete(old, True)


def recovered(spark: SparkSession, path: str) -> bool:
    """Undoes a staged() that was cut off: the old table comes back if no new one stands in its place."""
    fs, target = _fs(spark, path)
    old = _fs(spark, f"{path}.old")[1]
    if not fs.exists(old):
        return False
    if fs.exists(target):
        fs.delete(old, True)
        return False
    return bool(fs.rename(old, target))


class Version:
    """`with Version(spark, path) as at`: several tables written under `at` become current together when the block ends without an error.
    The pointer is one empty file in `path`/current, named like the version; the least-aged name that is complete counts."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        last = current(spark, path)
        self.name = f"v{int(last.rsplit('/v', 1)[1]) + 1 if last else 1:09d}"

    def __enter__(self) -> str:
        fs, where = _fs(self.spark, f"{self.path}/{self.name}")
        fs.delete(where, True)  # of a build that was cut off
        return f"{self.path}/{self.name}"

    def __exit__(self, kind, *_) -> None:
        if kind is None:
            fs, where = _fs(self.spark, f"{self.path}/current/{self.name}")
            fs.create(where, True).close()


def current(spark: SparkSession, path: str) -> str | None:
    """The folder of the newest complete version."""
    fs, where = _fs(spark, f"{path}/current")
    names = sorted(x.getPath().getName() for x in fs.listStatus(where)) if fs.exists(where) else []
    return f"{path}/{names[-1]}" if names else None


def reused(spark: SparkSession, path: str, n: int, make: Callable[[], DataFrame]) -> DataFrame:
    """The rows kept at path if there are n of them, as a set of questions is made once by a model; else made, kept and read back."""
    if exists(spark, f"{path}/_SUCCESS") and spark.read.parquet(path).count() == n:
        return spark.read.parquet(path)
    staged(make(), path)
    return spark.read.parquet(path)


def csv_out(df: DataFrame, columns: list[str], path: str) -> None:
    df.select(*columns).write.mode("overwrite").csv(path, header=True, escape='"')


def json_out(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def upsert(old: DataFrame, new: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The last row of each key by `order`; new rows win ties.  Partial aggregation, no window, so a hot key stays small."""
    rows = old.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    values = [c for c in old.columns if c not in keys]
    best = F.max(F.struct(F.col(order).alias("_o"), F.col("_new"), *[F.col(c).alias(c) for c in values])).alias("b")
    return rows.groupBy(*keys).agg(best).select(*[k for k in keys], *[F.col(f"b.{c}").alias(c) for c in values]).select(*old.columns)


def merge_create_only(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Rows with a new key are added; those there stay as they are."""
    return old.unionByName(new.dropDuplicates([key]).join(old, key, "left_anti").select(*old.columns))


def merge_overwrite(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """New values win where they aren't null."""
    o, n = old.alias("o"), new.alias("n")
    return o.join(n, F.col(f"o.{key}") == F.col(f"n.{key}"), "full").select(*[F.coalesce(F.col(f"n.{c}"), F.col(f"o.{c}")).alias(c) for c in old.columns])


def merge_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(src, type, dst) once each, both ends being nodes."""
    ids = nodes.select("id")
    return edges.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi").dropDuplicates(["src", "type", "dst"])


LEAVES = ("paragraph", "list", "table", "article", "subarticle")  # fixed values: kinds of nodes that have vectors


def vector_edges(nodes: DataFrame, vectors: DataFrame) -> DataFrame:
    """(id, kind) and (id, embedding) to (vector_id, id, kind, embedding): a vector node and its edge for each leaf with a vector."""
    return nodes.where(F.col("kind").isin(*LEAVES)).join(vectors, "id").withColumn("vector_id", F.concat(F.lit("v"), F.col("id").cast("string")))


def wiped(rows: DataFrame, scope: str, value: str | int | None = None) -> DataFrame:
    """Without the rows of a label or session; of all if no value is given."""
    return rows.where(~F.col(scope).eqNullSafe(F.lit(value))) if value is not None else rows.limit(0)


def jdbc_out(df: DataFrame, mode: str = "append", **options) -> None:
    """Rows to a table of a SQL store; with upsert() before it, mode "overwrite" and truncate keep the table's own definition."""
    df.write.format("jdbc").options(**options).mode(mode).save()


def text_out(lines: DataFrame, path: str) -> None:
    """A report or page: one string column, in the order of the rows' single partition."""
    lines.coalesce(1).write.mode("overwrite").text(path)


def embeddings_out(vectors: DataFrame, path: str, model: str, seconds: float) -> None:
    """Vectors with a one-row report of model, dimension, count, milliseconds a chunk and the signature of the ids."""
    spark = vectors.sparkSession
    with Version(spark, path) as at:
        vectors.write.parquet(f"{at}/vectors")
        made = spark.read.parquet(f"{at}/vectors")
        embedding_report(made, model, seconds).write.json(f"{at}/report")


def embedding_report(vectors: DataFrame, model: str, seconds: float) -> DataFrame:
    """The report's row.  The signature is that of all ids in any order: count and sum of their hashes."""
    out = vectors.agg(F.count("*").alias("n"), F.coalesce(F.max(F.size("embedding")), F.lit(0)).alias("dim"), signature("vec_id").alias("signature"))
    per = F.when(F.col("n") > 0, F.round(F.lit(seconds) * 1000 / F.col("n"), 2)).otherwise(F.lit(0.0))
    return out.select(F.lit(model).alias("model"), "n", "dim", "signature", per.alias("ms_per_chunk"))


def signature(key: str):
    """Of a column's values, in any order: md5 of their number and the sum of their md5s' first 15 digits, so that no list is gathered."""
    part = F.conv(F.substring(F.md5(F.col(key).cast("string").cast("binary")), 1, 15), 16, 10).cast("decimal(38,0)")
    return F.md5(F.concat_ws("|", F.count(key).cast("string"), F.coalesce(F.sum(part), F.lit(0)).cast("string")).cast("binary"))


def embeddings_in(spark: SparkSession, path: str, model: str, ids: DataFrame) -> DataFrame | None:
    """The stored vectors if model, number and signature of the ids fit, else None: they have to be made again."""
    at = current(spark, path)
    if at is None:
        return None
    said, want = spark.read.json(f"{at}/report").first(), ids.agg(F.count("vec_id").alias("n"), signature("vec_id").alias("s")).first()
    return spark.read.parquet(f"{at}/vectors") if (said["model"], said["n"], said["signature"]) == (model, want.n, want.s) else None


def jdbc(spark: SparkSession, **options) -> DataFrame:
    """A table of a SQL store."""
    return spark.read.format("jdbc").options(**options).load()
