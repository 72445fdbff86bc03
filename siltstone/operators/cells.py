"""An approximate vector index: each collection's vectors in cells, of which a question reads the nearest only."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.operators import retrieve, tables

#: Cells of a collection at most, vectors of a collection that their centres are fitted on (about), rounds of fitting.
CELLS, SAMPLE, ROUNDS = 32, 8192, 8
#: Share of its collection's cells that a question reads.
PROBES = 0.625
#: Bytes of centres that one round of writing sends to the tasks.
CENTRE_BYTES = 64 << 20


@dataclass(frozen=True)
class Cells:
    """A written index. vectors: chunk_id, dense and the columns `by`, in a folder for each cell; centres: cell (a number of its own over all collections), `by`, dense, vectors (in it)."""

    vectors: DataFrame
    centres: DataFrame
    by: tuple[str, ...]


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


def _fitted(most: int, by: list[str]):
    """The centres of one collection's sample: spherical k-means from evenly chosen vectors, in the order of their ids."""

    def fit(sample: pd.DataFrame) -> pd.DataFrame:
        sample = sample.sort_values("chunk_id", kind="stable")
        x = _unit(np.stack(sample["dense"].to_numpy()).astype(float))
        k = max(1, min(most, len(x) // 4))
        centre = x[np.linspace(0, len(x) - 1, k).astype(int)].copy()
        for _ in range(ROUNDS):
            near = (x @ centre.T).argmax(axis=1)
            total = np.zeros_like(centre)
            np.add.at(total, near, x)
            used = np.bincount(near, minlength=k) > 0
            centre[used] = _unit(total[used])
        return pd.DataFrame({**{c: [sample[c].iloc[0]] * k for c in by}, "at": np.arange(k), "dense": list(centre)})

    return fit


def build_cells(index: DataFrame, path: str, by: Sequence[str] = (), cells: int = CELLS, sample: int = SAMPLE) -> Cells:
    """Writes the cells of index (chunk_id, dense, the columns `by`) below path.

    The centres of each collection (and number of dimensions) are fitted on about `sample` of its vectors, chosen by a hash of the id: all, if there are fewer.
    Every vector goes to its nearest centre's cell. Centres are sent to the tasks in rounds of 64 MB, each writing the collections it holds. Null
    vectors take no part; zero vectors go to some cell.
    """
    spark, keys = index.sparkSession, ["dims", *by]
    rows = index.where("dense is not null").select("chunk_id", F.col("dense").cast("array<double>").alias("dense"), F.size("dense").alias("dims"), *by)
    counts = rows.groupBy(*keys).agg(F.count("*").alias("rows"))
    same = lambda other: [F.col(c).eqNullSafe(F.col(f"{other}{c}")) for c in keys]
    counts = tables.written(counts.select("rows", *[F.col(c).alias(f"of_{c}") for c in keys]), "counts")
    chance = F.pmod(F.xxhash64("chunk_id", F.lit(7)), F.lit(1 << 20)) * F.col("rows") < F.lit(float(sample) * (1 << 20))
    chosen = rows.join(counts, same("of_")).where(chance).select("chunk_id", "dense", *keys)
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in chosen.select(*keys).schema.fields)
    fitted = chosen.groupBy(*keys).applyInPandas(_fitted(cells, keys), f"{kinds}, at int, dense array<double>")
    centres = tables.written(fitted.withColumn("cell", F.monotonically_increasing_id()), "centres")
    size = centres.agg(F.sum(F.size("dense") * 8 + 64)).first()[0] or 0
    turns = max(1, -(-size // CENTRE_BYTES))
    turn = F.pmod(F.xxhash64(*keys), F.lit(turns))
    for k in range(turns):
        held = centres.where(turn == k).collect()  # CENTRE_BYTES, about
        rows.where(turn == k).withColumn("cell", _nearest(held, keys, rows)).write.mode("append").partitionBy("cell").parquet(f"{path}/vectors")
    schema = spark.createDataFrame([], rows.schema).withColumn("cell", F.lit(0).cast("bigint")).schema
    vectors = spark.read.schema(schema).parquet(f"{path}/vectors") if turns and size else spark.createDataFrame([], schema)
    own = vectors.groupBy("cell").agg(F.count("*").alias("vectors"))
    own = centres.drop("at").join(own, "cell", "left").withColumn("vectors", F.coalesce("vectors", F.lit(0).cast("bigint")))
    own.write.parquet(f"{path}/centres")
    return Cells(vectors, spark.read.schema(own.schema).parquet(f"{path}/centres"), tuple(by))


def _nearest(held: list, keys: list[str], rows: DataFrame) -> Column:
    """The cell of each vector, by the centres (rows of cell, keys, dense) of its collection."""
    by: dict[tuple, tuple[list, list]] = {}
    for r in held:
        cell, dense = by.setdefault(tuple(r[c] for c in keys), ([], []))
        cell.append(r["cell"])
        dense.append(r["dense"])
    known = {key: (np.array(c), np.array(d)) for key, (c, d) in by.items()}

    @F.arrow_udf("bigint")
    def nearest(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
        for dense, *own in batches:
            out = np.zeros(len(dense), np.int64)
            places: dict[tuple, list[int]] = {}
            for i, key in enumerate(zip(*(c.to_pylist() for c in own))):
                places.setdefault(key, []).append(i)
            for key, at in places.items():
                cell, centre = known[key]
                x = dense.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).reshape(len(at), -1)
                out[at] = cell[(x @ centre.T).argmax(axis=1)]
            yield pa.array(out)

    return nearest("dense", *keys)


def cells_topk(queries: DataFrame, index: Cells, k: int, probes: float = PROBES) -> DataFrame:
    """query_id, chunk_id, score, rank by cosine as dense_topk, of the vectors in the nearest cells only; with read (vectors scored for the question) and held (vectors of its collection).

    queries: query_id, dense and the index's columns `by`. A question reads the share `probes` of its collection's cells, rounded up, in the order of its cosine with their centres;
    scores are exact. Folders of cells that no question reads aren't opened.
    """
    by, kinds = list(index.by), ["dims", *index.by]
    asked = queries.where("dense is not null").select("query_id", F.col("dense").cast("array<double>").alias("dense"), F.size("dense").alias("dims"), *by)
    of = index.centres.groupBy(*kinds).agg(F.count("*").alias("cells"), F.sum("vectors").alias("held"))
    most = of.agg(F.max("cells")).first()[0] or 1
    near = retrieve.dense_topk(asked.drop("dims"), index.centres.drop("dims").withColumnRenamed("cell", "chunk_id"), max(1, int(np.ceil(probes * most))), index.by)
    near = near.select("query_id", F.col("chunk_id").alias("cell"), "rank").join(asked, "query_id").join(of, kinds).where(F.col("rank") <= F.ceil(F.col("cells") * probes))
    near = tables.written(near.select("query_id", "cell", "dense", "held"), "near")
    wanted = near.select("cell").distinct()  # cells at most
    rows = index.vectors.select("chunk_id", "dense", "cell").join(wanted, "cell", "left_semi")
    hits = retrieve.dense_topk(near.select("query_id", "cell", "dense"), rows, k, ("cell",))
    read = near.join(index.centres.select("cell", "vectors"), "cell").groupBy("query_id").agg(F.sum("vectors").alias("read"), F.max("held").alias("held"))
    return hits.join(read, "query_id")
