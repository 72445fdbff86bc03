"""Written intermediate tables."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


#: A writer's options for texts that are written once and read a few times: a quarter less than by default, in the same time.
DENSE = {"compression": "zstd", "parquet.compression.codec.zstd.level": "1"}


def shared_path(spark: SparkSession, name: str) -> str:
    """A new folder below the shared one of the session (spark.checkpoint.dir); a temporary one for local sessions only."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        shared = tempfile.mkdtemp(prefix="siltstone-")
    return f"{shared}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str = "table", **options) -> DataFrame:
    """df as Parquet in the shared folder, read again: its lineage ends there. options are the writer's."""
    path = shared_path(df.sparkSession, name)
    df.write.options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def small_batches(spark: SparkSession, size: str = "8m") -> Iterator[None]:
    """What runs inside passes Arrow batches of `size` at most, or of one row."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    held = spark.conf.get(name)
    spark.conf.set(name, size)
    try:
        yield
    finally:
        spark.conf.set(name, held)


def parts(spark: SparkSession, size: int, share: int) -> int:
    """Into how many tasks to deal `size` (rows, bytes), so that none gets much more than `share`; the session's number at least."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // share))


def exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def remove(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def names(spark: SparkSession, path: str) -> list[str]:
    """Names of what is in a folder; none if there is no such folder."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    return sorted(f.getPath().getName() for f in fs.listStatus(at)) if fs.exists(at) else []


def listing(spark: SparkSession, path: str) -> tuple[tuple[str, int, int], ...]:
    """(name, bytes, time of change) of the files of a path: what tells whether a table has been written anew."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    return tuple(sorted((f.getPath().getName(), f.getLen(), f.getModificationTime()) for f in fs.listStatus(at)))


def read_text(spark: SparkSession, path: str) -> str:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    stream = at.getFileSystem(spark._jsc.hadoopConfiguration()).open(at)
    try:
        return bytes(stream.readAllBytes()).decode()
    finally:
        stream.close()


def publish_text(spark: SparkSession, path: str, text: str) -> bool:
    """Makes a small file appear at once: written beside its place, then renamed. False if its place is taken."""
    make = spark._jvm.org.apache.hadoop.fs.Path
    at, side = make(path), make(f"{path}.{uuid.uuid4().hex}")
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    stream = fs.create(side, False)
    try:
        stream.write(bytearray(text.encode()))
    finally:
        stream.close()
    if fs.exists(at) or not fs.rename(side, at):
        fs.delete(side, False)
        return False
    return True
