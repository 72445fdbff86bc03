"""Context-triggered piecewise hashes of whole texts, compared by edit distance."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siltstone.llm import common, words

#: Bytes of the rolling window, least block size, characters of a signature at most, documents of a bucket, buckets at most.
WINDOW, LEAST, LENGTH, BUCKET, MOST_BUCKETS = 7, 3, 64, 1000, 4096
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
_LETTERS = np.frombuffer(ALPHABET.encode(), np.uint8)
_CODE = words.BYTE_CODE
_ROLL = (_CODE >> np.uint64(32)).astype(np.uint32)
_STEP = [np.uint32(pow(0x9E3779B1, k, 1 << 32)) for k in range(WINDOW)]


def fingerprint(text: str) -> str:
    """block:signature:signature at twice the block size.

    A chunk ends where the hash of the last WINDOW bytes is a multiple of the block size; it signs with six bits of its
    own hash. The block size is the largest LEAST * 2**k that gives at least half of LENGTH chunks. A signature has at
    most LENGTH characters: its last one hashes all that is left. An empty text has empty signatures at LEAST.
    """
    data = np.frombuffer(text.encode(), np.uint8)
    n = len(data)
    if not n:
        return f"{LEAST}::"
    code = _ROLL[data]
    roll = code.copy()
    for k in range(1, min(WINDOW, n)):
        roll[k:] += code[:-k] * _STEP[k]
    roll ^= roll >> np.uint32(15)
    roll *= np.uint32(0x2C1B3C6D)
    roll ^= roll >> np.uint32(12)
    block = LEAST
    while block * LENGTH < n:
        block *= 2
    ends = np.flatnonzero(roll % np.uint32(block) == 0)
    while block > LEAST and len(ends) < LENGTH // 2:
        block //= 2
        ends = np.flatnonzero(roll % np.uint32(block) == 0)
    coarse = ends[roll[ends] % np.uint32(2 * block) == 0]
    return f"{block}:{_sign(data, ends, LENGTH)}:{_sign(data, coarse, LENGTH // 2)}"


def _sign(data: np.ndarray, ends: np.ndarray, most: int) -> str:
    starts = np.append(0, ends[: most - 1] + 1)
    starts = starts[starts < len(data)]
    hashes = words.span_hash(data, starts, _CODE)
    return _LETTERS[(hashes >> np.uint64(58)).astype(np.int64)].tobytes().decode()


def edit_distance(a: str, b: str) -> int:
    """Levenshtein distance, a column of the table at a time in the bits of one integer."""
    if not a or not b:
        return max(len(a), len(b))
    where: dict[str, int] = {}
    for i, c in enumerate(a):
        where[c] = where.get(c, 0) | 1 << i
    full, top = (1 << len(a)) - 1, 1 << len(a) - 1
    rise, fall, distance = full, 0, len(a)
    for c in b:
        same = where.get(c, 0)
        keep = (((same & rise) + rise) ^ rise) | same | fall
        up, down = fall | ~(keep | rise) & full, rise & keep
        distance += bool(up & top) - bool(down & top)
        up, down = up << 1 | 1, down << 1
        rise, fall = (down | ~((same | fall) | up)) & full, up & (same | fall) & full
    return distance


def likeness(a: str, b: str) -> float:
    """1 minus the edit distance over the longer length, of the signatures at a block size that both have; else 0. Equal: 1."""
    if a == b:
        return 1.0
    (m, a1, a2), (n, b1, b2) = a.split(":"), b.split(":")
    m, n = int(m), int(n)
    pairs = [(a1, b1), (a2, b2)] if m == n else [(a2, b1)] if 2 * m == n else [(a1, b2)] if m == 2 * n else []
    return max((1 - edit_distance(x, y) / max(len(x), len(y)) for x, y in pairs if x and y), default=0.0)


_OUT = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("n_chars", T.LongType()), T.StructField("edited_sha256", T.StringType()),
    T.StructField("fingerprint", T.StringType()), T.StructField("edited_fingerprint", T.StringType()), T.StructField("near_edited", T.DoubleType()), T.StructField("near_next", T.DoubleType()),
])


def _walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come by bucket and then order; a row's next document is the row after it in the same bucket."""
    import hashlib

    last, rows = None, []

    def flush() -> pa.RecordBatch:
        cols = list(zip(*rows)) or [[]] * len(_OUT)
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
        rows.clear()
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], _OUT.fieldNames())

    for batch in batches:
        for bucket, tail, doc_id, text in zip(*(batch.column(k).to_pylist() for k in ("bucket", "tail", "doc_id", "text"))):
            if tail and (last is None or last[0] != bucket):
                continue
            own = fingerprint(text)
            if last and last[0] == bucket:
                _, left_id, left, left_print = last
                half = len(left) // 2
                edited = left[: len(left) - half] + text[:half]
                other = fingerprint(edited)
                rows.append((left_id, len(left), hashlib.sha256(edited.encode()).hexdigest(), left_print, other, likeness(left_print, other), likeness(left_print, own)))
            last = None if tail else (bucket, doc_id, text, own)
        yield flush()


def fingerprint_chain(docs: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """Each document's fingerprint, that of its edited text, and its likeness to it and to the next document.

    Next: descending doc_id, null ids last, equal ids by text; after the last comes the first. The edited text is the
    text with its last floor(n_chars / 2) code points replaced by the first as many (or all) of the next text. Columns:
    doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next. Null texts are empty; a
    lone document is its own next; an empty table gives an empty table; other columns are ignored.

    Ids are dealt by their order into buckets of about `bucket` documents, MOST_BUCKETS at most (a bucket is streamed,
    never held). A bucket's last row goes on to the first row of the next bucket: that row (and those of the same id)
    is copied. Texts are shuffled once.
    """
    from pyspark.ml.feature import Bucketizer

    spark = docs.sparkSession
    common.arrow_batches(spark)
    ids = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"))
    n = min(MOST_BUCKETS, ids.count() // bucket)
    edges = sorted({float(x) for x in ids.stat.approxQuantile("doc_id", [i / n for i in range(1, n)], 0.1 / n)} if n > 1 else {0.0}) or [0.0]  # no edges: all ids are null
    deal = Bucketizer(splits=[float("-inf"), *edges, float("inf")], inputCol="_id", outputCol="_bucket")

    def dealt(df: DataFrame) -> DataFrame:
        df = deal.transform(df.withColumn("_id", F.coalesce(F.col("doc_id").cast("double"), F.lit(0.0))))
        return df.withColumn("bucket", F.when(F.col("doc_id").isNull(), -1).otherwise(F.col("_bucket")).cast("int")).drop("_id", "_bucket")

    first = sorted(tuple(r) for r in dealt(ids).groupBy("bucket").agg(F.max("doc_id")).collect())  # MOST_BUCKETS + 1 rows at most
    above = [b for b, _ in first[1:]] + [first[0][0]] if first else []
    copies = spark.createDataFrame([(i, b) for (_, i), b in zip(first, above)], "_first bigint, _above int")
    whole = dealt(docs.select(ids.columns[0], F.coalesce("text", F.lit("")).alias("text")).withColumn("doc_id", F.col("doc_id").cast("bigint")))
    whole = whole.join(F.broadcast(copies), F.col("doc_id").eqNullSafe(F.col("_first")), "left")
    place = lambda b, tail: F.struct(b.alias("bucket"), F.lit(tail).alias("tail"))
    places = F.when(F.col("_above").isNull(), F.array(place(F.col("bucket"), False))).otherwise(F.array(place(F.col("bucket"), False), place(F.col("_above"), True)))
    sent = whole.select(F.explode(places).alias("_p"), "doc_id", "text").select("_p.*", "doc_id", "text")
    order = ["bucket", "tail", F.desc_nulls_last("doc_id"), "text"]
    return sent.repartition(max(1, len(first)), "bucket").sortWithinPartitions(*order).mapInArrow(_walk, _OUT)


def op7_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint_chain(common.table(spark, sf_dir, "documents").select("doc_id", "text"))
