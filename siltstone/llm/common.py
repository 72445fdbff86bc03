"""What the training-data operators share: reading tables, settling intermediate tables, small broadcasts."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The white space of the word contracts, as a regular-expression class body.
WHITE = r"\x20\x09-\x0D"
WORD = rf"[^{WHITE}]+"
#: Measured bytes up to which a table is broadcast; beyond it the join shuffles.
BROADCAST_BYTES = 16 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def arrow_batches(spark: SparkSession, rows: int = 2048, size: str = "8m") -> None:
    """Sets the greatest rows and bytes of an Arrow batch, for all operators alike, so that a batch of long texts stays small."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", size)


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share (spark.checkpoint.dir). A local session, where it is unset, gets a temporary one; a cluster must name it."""
    told = spark.conf.get("spark.checkpoint.dir", None)
    if not told:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        told = tempfile.mkdtemp(prefix="siltstone-")
        spark.conf.set("spark.checkpoint.dir", told)
    return told


def settle(df: DataFrame) -> DataFrame:
    """Writes df as Parquet into the shared folder and reads it back: the lineage ends there and a lost executor loses nothing."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/settled-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.settled_at = path
    return out


def discard(*tables: DataFrame) -> None:
    """Deletes settled tables that no later step reads."""
    for df in tables:
        spark = df.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(df.settled_at)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def fresh(name: str, taken: list[str]) -> str:
    """A column name like `_name` that none of the caller's columns has (names are compared without case)."""
    held = {c.lower() for c in taken}
    own = f"_{name}"
    while own.lower() in held:
        own = f"_{own}"
    return own


def aside(df: DataFrame, reserved: tuple[str, ...]) -> tuple[DataFrame, dict[str, str]]:
    """df with the columns that have reserved names (compared without case) renamed, and how to name them back (withColumnsRenamed)."""
    held = {r.lower() for r in reserved}
    back: dict[str, str] = {}
    for c in (c for c in df.columns if c.lower() in held):
        back[fresh("own", [*df.columns, *reserved, *back])] = c
    return df.withColumnsRenamed({c: n for n, c in back.items()}), back


def _width(field: T.StructField) -> Column:
    """Bytes of a column's value in memory, about."""
    kind, c = field.dataType, F.col(f"`{field.name}`")
    if isinstance(kind, (T.StringType, T.BinaryType)):
        return F.coalesce(F.octet_length(c), F.lit(0)) + 24
    if isinstance(kind, T.ArrayType):
        return F.greatest(F.size(c), F.lit(0)) * 16 + 32
    return F.lit(48 if isinstance(kind, T.StructType) else 16)


def small(df: DataFrame, most: int = BROADCAST_BYTES) -> DataFrame:
    """df (settled or cheap to read) with a broadcast hint if its measured bytes are at most `most`; else as it is, to be shuffled."""
    size = sum((_width(f) for f in df.schema.fields), F.lit(16))
    return F.broadcast(df) if (df.agg(F.sum(size)).first()[0] or 0) <= most else df


def fold(doc_id: Column | str, folds: int) -> Column:
    """crc32 of the id as text, modulo folds: the train/held-out split of the learned operators."""
    return F.pmod(F.crc32(F.col(doc_id).cast("string") if isinstance(doc_id, str) else doc_id.cast("string")), F.lit(folds))


def document_columns(df: DataFrame) -> DataFrame:
    """Adds what is missing of the columns of `documents`, as nulls."""
    kinds = {"doc_id": "bigint", "text": "string", "lang": "string", "source": "string", "n_chars": "bigint"}
    for name, kind in kinds.items():
        if name not in df.columns:
            df = df.withColumn(name, F.lit(None).cast(kind))
    return df
