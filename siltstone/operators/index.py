"""Index tables: BM25 postings, sparse and dense vectors."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siltstone.functions import text as X
from siltstone.operators import tables
from siltstone.sources.versions import VersionedTables

#: The published defaults of Okapi BM25: saturation, length, and share of the mean idf that a negative idf becomes.
K1, B, EPSILON = 1.5, 0.75, 0.25
#: Bytes of text whose tokens one task counts; postings whose tokens one task counts.
TEXT_BYTES, TASK_ROWS = 4 << 20, 2_000_000


def postings(chunks: DataFrame, size: int | None = None) -> DataFrame:
    """tok, chunk_id, len, tf of chunks (chunk_id, text): each text is tokenised once; len is its number of tokens.

    Texts are dealt by chunk_id, so that counts and lengths need no other shuffle, to as many tasks as their bytes (size, else they are added up) need; tokens are tested row by row, after they are exploded.
    """
    size = chunks.agg(_bytes()).first()[0] if size is None else size
    dealt = chunks.select("chunk_id", "text").repartition(tables.parts(chunks.sparkSession, size or 0, TEXT_BYTES), "chunk_id")
    tokens = dealt.select("chunk_id", F.explode(X.raw_tokens(F.col("text"))).alias("tok")).select("chunk_id", F.lower("tok").alias("tok"))
    counted = tokens.where(X.is_token(F.col("tok"))).groupBy("chunk_id", "tok").agg(F.count("*").alias("tf"))
    return counted.select("tok", "chunk_id", F.sum("tf").over(Window.partitionBy("chunk_id")).alias("len"), "tf")


def _bytes() -> Column:
    return F.sum(F.octet_length("text"))


def raw_idf(n: Column | float, df: Column) -> Column:
    return F.log(n - df + 0.5) - F.log(df + 0.5)


def bm25(tf: Column, length: Column, mean: Column, weight: Column) -> Column:
    return weight * tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / mean))


@dataclass(frozen=True)
class Bm25:
    """A written index: postings (tok, chunk_id, len, tf), idf (tok, df, idf) and the mean length. Postings and df lie in buckets by token."""

    store: VersionedTables
    postings: DataFrame
    idf: DataFrame
    n: int
    mean: float


def _store(spark: SparkSession, path: str, buckets: int) -> VersionedTables:
    return VersionedTables(spark, path, buckets, {"postings": ["tok"], "df": ["tok"], "totals": ["n"]})


def _totals(df: DataFrame, n: int, total: int, updates: int) -> DataFrame:
    """One row: n, total (tokens), mean_raw (of the idf over all tokens of df), updates."""
    mean = df.agg(F.avg(raw_idf(F.lit(float(n)), F.col("df"))).alias("mean_raw"))
    return mean.select(F.lit(n).cast("bigint").alias("n"), F.lit(total).cast("bigint").alias("total"), "mean_raw", F.lit(updates).alias("updates"))


def build_bm25(chunks: DataFrame, path: str, buckets: int = 16) -> Bm25:
    """Writes the index of chunks (chunk_id, text) below path, whatever stood there: each text is tokenised once, whatever is asked later."""
    store = _store(chunks.sparkSession, path, buckets)
    n, size = chunks.agg(F.count("*"), _bytes()).first()

    def df(now) -> DataFrame:
        own = now("postings").select("tok")
        return own.repartition(tables.parts(own.sparkSession, own.count(), TASK_ROWS), "tok").groupBy("tok").agg(F.count("*").alias("df"))

    totals = lambda now: _totals(now("df"), n, now("postings").agg(F.sum("tf")).first()[0] or 0, 0)
    store.change({"postings": postings(chunks, size).withColumn("sign", F.lit(1)), "df": df, "totals": totals}, reset=["postings", "df", "totals"])
    return open_bm25(chunks.sparkSession, path)


def open_bm25(spark: SparkSession, path: str) -> Bm25:
    store = _store(spark, path, 16)
    totals, df = store.table("totals").first(), store.table("df")
    raw = raw_idf(F.lit(float(totals["n"])), F.col("df"))
    idf = df.select("tok", "df", F.when(raw < 0, F.lit(EPSILON * (totals["mean_raw"] or 0.0))).otherwise(raw).alias("idf"))
    posted = store.table("postings")
    if totals["updates"]:
        posted = posted.groupBy("tok", "chunk_id", "len", "tf").agg(F.sum("sign").alias("sign")).where("sign > 0")
    return Bm25(store, posted.drop("sign"), idf, totals["n"], totals["total"] / totals["n"] if totals["n"] else 0.0)


def update_bm25(index: Bm25, before: DataFrame, after: DataFrame) -> Bm25:
    """The index after some chunks changed: `before` are those (chunk_id, text) that go or change, as they were indexed; `after` those that come or
    change, as they are now. Only these texts are read: signed postings are added, signed counts are merged into df, length and number. One version changes all of it.
    """
    store, spark = index.store, before.sparkSession
    signed = postings(after).withColumn("sign", F.lit(1)).unionByName(postings(before).withColumn("sign", F.lit(-1)))
    signed = tables.written(signed, "signed")
    moved = tables.written(signed.groupBy("tok").agg(F.sum("sign").alias("d")).where("d <> 0"), "moved")
    df = moved.join(store.table("df"), "tok", "left").select("tok", (F.coalesce("df", F.lit(0)) + F.col("d")).alias("df")).where("df > 0")
    df = tables.written(df, "df")
    rest = store.table("df").join(moved.select("tok"), "tok", "left_anti").unionByName(df)
    old = store.table("totals").first()
    n, total = old["n"] + after.count() - before.count(), old["total"] + (signed.agg(F.sum(F.col("sign") * F.col("tf"))).first()[0] or 0)
    store.change({"postings": signed, "df": df, "totals": _totals(rest, n, total, old["updates"] + 1)}, {"df": (moved, ["tok"])}, reset=["totals"])
    return open_bm25(spark, store.path)


def compact_bm25(index: Bm25) -> Bm25:
    """The index with its signed postings summed up, as one folder."""
    totals = index.store.table("totals").withColumn("updates", F.lit(0))
    index.store.change({"postings": index.postings.withColumn("sign", F.lit(1)), "totals": totals}, reset=["postings", "totals"])
    return open_bm25(totals.sparkSession, index.store.path)


def changed_chunks(classified: DataFrame, removed: DataFrame, old: DataFrame, new: DataFrame, keys: Sequence[str] = ("collection", "doc_id")) -> tuple[DataFrame, DataFrame]:
    """(before, after) for update_bm25: old and new rows (keys, chunk_id, text) of the documents that classify_changes calls new or updated, and of removed ones."""
    changed = classified.where("status in ('new', 'updated')").select(*keys)
    gone = changed.unionByName(removed.select(*keys)).distinct()
    return old.join(gone, list(keys), "left_semi").select("chunk_id", "text"), new.join(changed, list(keys), "left_semi").select("chunk_id", "text")


def bm25_weights(index: Bm25) -> DataFrame:
    """tok, chunk_id, weight: what one query token adds to a chunk's score."""
    whole = index.postings.join(index.idf, "tok")
    return whole.select("tok", "chunk_id", bm25(F.col("tf"), F.col("len"), F.lit(index.mean), F.col("idf")).alias("weight"))


def hashed_embedding(texts: list[str], dims: int = 64) -> np.ndarray:
    """The default embedder: signed hashed counts of lower-case words, of length 1. No weights, the same everywhere."""
    import xxhash

    words = [text.lower().split() for text in texts]
    row = np.repeat(np.arange(len(texts)), [len(w) for w in words])
    h = np.fromiter((xxhash.xxh64_intdigest(word) for own in words for word in own), np.uint64)
    at = row * dims + (h % np.uint64(dims)).astype(np.int64)
    out = np.bincount(at, np.where(h >> np.uint64(63), 1.0, -1.0), len(texts) * dims).reshape(-1, dims).astype(np.float32)
    return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12)


def embed(chunks: DataFrame, embedder: Callable[[list[str]], np.ndarray] = hashed_embedding, batch: int = 32, most: int | None = None, carried: Sequence[str] = ()) -> DataFrame:
    """chunk_id, *carried, dense of chunks (chunk_id, text, and columns that are carried along): the embedder gets `batch` whole texts at a time (their first `most` characters, if a remote one sets it), made once per task."""
    kept = ("chunk_id", *carried)
    kinds = [f"{c} {chunks.schema[c].dataType.simpleString()}" for c in kept]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            texts = rows.column("text").to_pylist()
            vectors = [v for i in range(0, len(texts), batch) for v in embedder(texts[i : i + batch])]
            yield pa.RecordBatch.from_arrays([*(rows.column(c) for c in kept), pa.array([np.asarray(v, np.float32) for v in vectors], pa.list_(pa.float32()))], [*kept, "dense"])

    text = F.coalesce("text", F.lit(""))
    given = chunks.select(*kept, (text if most is None else F.left(text, F.lit(most))).alias("text"))
    return given.mapInArrow(run, ", ".join([*kinds, "dense array<float>"]))


def to_sparse(weights: DataFrame) -> DataFrame:
    """chunk_id, tok, w of chunk_id and a map token -> weight; weights of 0 or less go."""
    return weights.select("chunk_id", F.explode(F.map_filter("weights", lambda _, w: w > 0)).alias("tok", "w")).select("chunk_id", F.col("tok").cast("bigint").alias("tok"), F.col("w").cast("double").alias("w"))


def validate_dims(index: DataFrame, collections: DataFrame) -> DataFrame:
    """index (collection, chunk_id, dense) with fits: whether the vector has its collection's dense_dim."""
    return index.join(F.broadcast(collections.select("collection", "dense_dim")), "collection", "left").withColumn("fits", F.coalesce(F.size("dense") == F.col("dense_dim"), F.lit(False)))
