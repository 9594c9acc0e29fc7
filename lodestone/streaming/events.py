"""Streaming over the event table: windowed counts with late data, sessions, and a keyed upsert sink.  An extension beyond batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import sinks


def event_stream(spark: SparkSession, folder: str, pattern: str = "events*.parquet") -> DataFrame:
    """The files of a folder that match, as a stream."""
    schema = spark.read.option("pathGlobFilter", pattern).parquet(folder).schema
    return spark.readStream.schema(schema).option("pathGlobFilter", pattern).option("maxFilesPerTrigger", 16).parquet(folder)


def windowed(events: DataFrame, width: str = "1 day", late: str = "2 hours") -> DataFrame:
    """Counts and sums by type in tumbling windows; rows later than the watermark are dropped."""
    watched = events.withWatermark("ts", late) if events.isStreaming else events
    return watched.groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("since"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "2 hours") -> DataFrame:
    watched = events.withWatermark("ts", late) if events.isStreaming else events
    return watched.groupBy(F.session_window("ts", gap), "user_id").agg(F.count("*").alias("n")).select("user_id", F.col("session_window.start").alias("since"), F.col("session_window.end").alias("until"), "n")


BUCKETS = 16


def upsert_batches(stream: DataFrame, path: str, keys: list[str], order: str, checkpoint: str, buckets: int = BUCKETS):
    """Each micro-batch is merged into the table at path, which merged() reads; a batch that is run again gives the same rows.

    Rows are dealt to buckets by their keys' hash, and a batch rewrites the buckets that it touches only, under a new version with a list of
    where each bucket now is.  The version counts when all of it is written.  buckets is the table's own and stays as it was made."""

    def merge(batch: DataFrame, _: int) -> None:
        spark = batch.sparkSession
        dealt = batch.withColumn("_bucket", F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int"))
        touched = sorted(r[0] for r in dealt.select("_bucket").distinct().collect())
        if not touched:
            return
        where = _where(spark, path)
        old = _read(spark, {k: where[k] for k in touched if k in where}, batch)
        with sinks.Version(spark, path) as at:
            new = sinks.upsert(old, batch, keys, order).withColumn("_bucket", F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int"))
            new.repartition(len(touched), "_bucket").write.partitionBy("_bucket").parquet(f"{at}/rows")
            now = {**where, **{k: f"{at}/rows/_bucket={k}" for k in touched}}
            spark.createDataFrame(sorted(now.items()), "bucket int, folder string").coalesce(1).write.json(f"{at}/where")

    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _where(spark: SparkSession, path: str) -> dict[int, str]:
    """The folder of each bucket; there are few."""
    at = sinks.current(spark, path)
    return {r.bucket: r.folder for r in spark.read.json(f"{at}/where").collect()} if at else {}


def _read(spark: SparkSession, where: dict[int, str], like: DataFrame) -> DataFrame:
    return spark.read.schema(like.schema).parquet(*where.values()) if where else like.limit(0)


def merged(spark: SparkSession, path: str, like: DataFrame) -> DataFrame:
    """The table as of its last complete version, with the columns of `like`."""
    return _read(spark, _where(spark, path), like)
