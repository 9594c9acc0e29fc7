"""Helpers shared by the training-data operators."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the data folder; only Spark's reader touches the path."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The shared folder named by spark.checkpoint.dir.  Where it is unset, a local session gets one of its own; on a cluster that is
    an error, as no executor sees another's disk."""
    folder = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("spark.checkpoint.dir names no shared folder for the tables between steps")
        folder = "file://" + tempfile.mkdtemp(prefix="checkpoint-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


_open: list[list[str]] = []  # paths written in each open workspace


class Workspace:
    """Tables that cut() writes within a `with` are removed at its end, but for those kept: by then what read them is written too."""

    def __init__(self, spark: SparkSession):
        self.spark, self.kept = spark, set()

    def __enter__(self) -> Workspace:
        _open.append([])
        return self

    def keep(self, df: DataFrame) -> DataFrame:
        """df, of cut(), stays; the workspace around this one removes it."""
        self.kept.add(df.written_at)
        return df

    def keep_last(self) -> None:
        """The last table stays, if there is one."""
        self.kept.update(_open[-1][-1:])

    def __exit__(self, kind, *_) -> None:
        made = _open.pop()
        stay = [x for x in made if kind is not None or x in self.kept]
        for path in made:
            if path not in stay:
                removed(self.spark, path)
        if _open:
            _open[-1] += stay


def removed(spark: SparkSession, path: str) -> None:
    """Deletes a table that cut() wrote."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def cut(df: DataFrame, name: str, light: bool = False) -> DataFrame:
    """Write df to the shared folder and read it back: lineage ends there and no executor's loss repeats it.
    light: a table of ids and counts, much smaller than what it was made from, which is written to fewer files than there are shuffle
    partitions (an eighth, but one for each core at least)."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    (df.coalesce(max(spark.sparkContext.defaultParallelism, parts // 8)) if light else df).write.parquet(path)
    if _open:
        _open[-1].append(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_at = path
    return out


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A well-spread 64-bit hash of 64-bit numbers."""
    x = x + np.uint64((seed * 0x9E3779B97F4A7C15 + 0x9E3779B97F4A7C15) % 2**64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Byte offsets (n + 1) and bytes of a string column; null counts as empty."""
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    data = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None and data.size else np.zeros(0, np.uint8)
    return offsets - offsets[0], data


def batch(schema: pa.Schema, **columns) -> pa.RecordBatch:
    """A record batch of the schema from columns by name."""
    return pa.RecordBatch.from_arrays([x if isinstance(x := columns[f.name], pa.Array) else pa.array(x, f.type) for f in schema], schema=schema)
