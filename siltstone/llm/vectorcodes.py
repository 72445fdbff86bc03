"""Vector code compression: codebooks for parts of vectors, found by equal-average nearest-neighbour search, in whole numbers."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.llm import common

#: Parts of a vector, entries of a codebook, rounds of training, units of a component.
PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
#: Rows that are searched at once.
ROWS = 16_384
LONG = (1 << 63) - 1

Book = list[list[int]]


def nearest(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index, squared distance) of the nearest entry of the book for each row of x; ties go to the smaller index.

    Entries lie in order of their component sum. From each row's own sum the search expands outward, to both sides. The squared distance is
    at least the squared gap of the sums over the dimension, so a side ends where that strictly exceeds the best
    distance so far. x and book hold integers, as int64 or (of any size) as Python's.
    """
    dims = x.shape[1]
    total = book.sum(axis=1)
    order = np.argsort(total, kind="stable")
    entry, level, own = book[order], total[order], x.sum(axis=1)
    up = np.searchsorted(level, own)
    index, best = np.full(len(x), -1), np.zeros(len(x), x.dtype)
    sides = [(1, up.copy(), np.arange(len(x))), (-1, up - 1, np.arange(len(x)))]
    while any(len(rows) for _, _, rows in sides):
        for s, (step, at, rows) in enumerate(sides):
            rows = rows[(at[rows] >= 0) & (at[rows] < len(entry))]
            place = at[rows]
            gap = level[place] - own[rows]
            on = (index[rows] < 0) | (gap * gap <= best[rows] * dims)
            rows, place = rows[on], place[on]
            far = x[rows] - entry[place]
            far = (far * far).sum(axis=1)
            better = (index[rows] < 0) | (far < best[rows]) | ((far == best[rows]) & (order[place] < index[rows]))
            index[rows[better]], best[rows[better]] = order[place[better]], far[better]
            at[rows] += step
            sides[s] = (step, at, rows)
    return index, best


def whole(components: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x) of each component: int64, or Python's integers where squares of gaps wouldn't fit."""
    dims = max(1, components.shape[1])
    with np.errstate(over="ignore"):
        scaled = np.floor(components * float(scale))
    if float(np.abs(scaled).max(initial=0)) < (1 << 30) / dims:
        return scaled.astype(np.int64)
    exact = [[math.floor(Fraction(v) * scale) for v in row] for row in components.tolist()]
    return np.array(exact, object).reshape(components.shape)


def _assigned(vectors: np.ndarray, books: list[Book], scale: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(part of each vector, index, squared distance) for each part position."""
    width = vectors.shape[1] // len(books)
    for p, book in enumerate(books):
        x = whole(vectors[:, p * width : (p + 1) * width], scale)
        most = max((abs(c) for e in book for c in e), default=0)
        if x.dtype == object or most >= (1 << 30) / max(1, width):
            x = x.astype(object)
            yield x, *nearest(x, np.array(book, object).reshape(len(book), width))
        else:
            yield x, *nearest(x, np.array(book, np.int64).reshape(len(book), width))


def _gathered(batches: Iterator[pa.RecordBatch], column: int = 0) -> Iterator[np.ndarray]:
    """The vectors of several batches at once."""
    held: list[np.ndarray] = []
    for batch in batches:
        if len(batch):
            held.append(batch.column(column).flatten().to_numpy(zero_copy_only=False).reshape(len(batch), -1))
        if sum(map(len, held)) >= ROWS:
            yield np.concatenate(held)
            held = []
    if held:
        yield np.concatenate(held)


def _sums(books: list[Book], scale: int):
    """Arrow function: for each part position and entry, the sum of its parts (decimal integers of any size) and their number, once a task."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = [[[0] * len(e) for e in book] for book in books]
        count = [[0] * len(book) for book in books]
        for vectors in _gathered(batches):
            for p, (x, index, _) in enumerate(_assigned(vectors, books, scale)):
                order = np.argsort(index, kind="stable")
                used, first = np.unique(index[order], return_index=True)
                for e, sums, n in zip(used.tolist(), np.add.reduceat(x[order], first, axis=0).tolist(), np.diff(np.append(first, len(order))).tolist()):
                    total[p][e] = [a + b for a, b in zip(total[p][e], sums)]
                    count[p][e] += n
        rows = [(p, e, [*map(str, total[p][e])], n) for p in range(len(books)) for e, n in enumerate(count[p]) if n]
        cols = list(zip(*rows)) if rows else [[]] * 4
        kinds = (pa.int32(), pa.int32(), pa.list_(pa.string()), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], ["part", "entry", "sums", "n"])

    return add


def _centres(table: pa.Table) -> pa.Table:
    """floor(sum / count) of one entry, over what the tasks have summed."""
    sums = [sum(map(int, c)) for c in zip(*table.column("sums").to_pylist())]
    n = sum(table.column("n").to_pylist())
    return pa.table({"part": table.column("part")[:1], "entry": table.column("entry")[:1], "centre": pa.array([[str(s // n) for s in sums]], pa.list_(pa.string()))})


def usable(vectors: DataFrame, parts: int = PARTS, column: str = "embedding") -> DataFrame:
    """The rows whose vector is complete (no null, finite) and has the commonest number of dimensions that `parts` divides (ties: the greater)."""
    size = F.size(column)
    fit = vectors.where(F.col(column).isNotNull() & (size > 0) & (size % parts == 0))
    fit = fit.where(F.forall(column, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf"))))
    dims = fit.groupBy(size.alias("dims")).count().orderBy(F.desc("count"), F.desc("dims")).first()
    return fit.where(size == (dims["dims"] if dims else -1))


def train_codebooks(vectors: DataFrame, order: str = "vec_id", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE, column: str = "embedding") -> list[Book]:
    """Codebooks of usable vectors: for each part position a list of entries of whole numbers.

    They start as the parts of the first `entries` vectors by `order` (nulls last; ties: by the vector). Each round assigns every part to its nearest
    entry and moves each entry to its parts' componentwise floor(sum / count); unused entries stay. Tasks send one sum an
    entry; what comes to the driver is one centre an entry: its size is parts * entries whatever the rows.
    """
    v = F.col(column).cast("array<double>")
    first = vectors.select(F.col(order).alias("o"), v.alias("v")).orderBy(F.col("o").asc_nulls_last(), "v").limit(entries).collect()
    if not first:
        return [[] for _ in range(parts)]
    width = len(first[0]["v"]) // parts
    start = np.array([r["v"] for r in first], float)
    books = [whole(start[:, p * width : (p + 1) * width], scale).tolist() for p in range(parts)]
    for _ in range(rounds):
        sums = vectors.select(v.alias("v")).mapInArrow(_sums(books, scale), "part int, entry int, sums array<string>, n bigint")
        for r in sums.groupBy("part", "entry").applyInArrow(_centres, "part int, entry int, centre array<string>").collect():  # parts * entries rows at most
            books[r["part"]][r["entry"]] = [int(c) for c in r["centre"]]
    return books


def encode(vectors: DataFrame, books: list[Book], scale: int = SCALE, column: str = "embedding") -> DataFrame:
    """usable vectors with codes (the nearest entry of each part) and error (the squared distances summed; beyond a bigint: its end)."""

    @F.arrow_udf("struct<codes:array<int>,error:bigint>")
    def nearest_entries(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            flat = batch.flatten().to_numpy(zero_copy_only=False)
            found = list(_assigned(flat.reshape(len(batch), -1), books, scale)) if len(batch) else []
            codes = np.stack([index for _, index, _ in found], axis=1).astype(np.int32) if found else np.zeros((0, len(books)), np.int32)
            error = sum(far.astype(object) for _, _, far in found) if found else []
            ends = pa.array(np.arange(len(batch) + 1) * len(books), pa.int32())
            yield pa.StructArray.from_arrays([pa.ListArray.from_arrays(ends, pa.array(codes.ravel())), pa.array([min(LONG, int(e)) for e in error], pa.int64())], ["codes", "error"])

    kept = [c for c in vectors.columns if c not in ("codes", "error")]
    found = common.fresh("found", kept)
    out = vectors.select(*kept).withColumn(found, nearest_entries(F.col(column).cast("array<double>")))
    return out.select(*kept, f"{found}.codes", f"{found}.error")


def with_label_error(coded: DataFrame, label: str = "label") -> DataFrame:
    """coded with label_error: the errors of all rows of its label summed (nulls are one label; beyond a bigint: its end)."""
    own = common.fresh("label", coded.columns)
    by = coded.groupBy(F.col(label).alias(own)).agg(F.least(F.sum(F.col("error").cast("decimal(38,0)")), F.lit(LONG).cast("decimal(38,0)")).cast("bigint").alias("label_error"))
    by = common.small(common.settle(by))
    return coded.join(by, F.col(label).eqNullSafe(F.col(own)), "left").drop(own)


def fingerprint(books: list[Book]) -> str:
    """SHA-256 of all components by part, entry and position, joined by commas."""
    return hashlib.sha256(",".join(str(c) for book in books for entry in book for c in entry).encode()).hexdigest()


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows with a null, broken or odd-sized vector are left out; rows of equal or null vec_id are rows of their own; an empty table gives no rows."""
    common.arrow_batches(spark)
    rows = common.settle(usable(common.table(spark, sf_dir, "embeddings").select("vec_id", "label", "embedding")))
    books = train_codebooks(rows)
    out = with_label_error(common.settle(encode(rows, books).select("vec_id", "label", "codes", "error")))
    code = F.array_join(F.transform("codes", lambda c: F.lower(F.lpad(F.hex(c), 2, "0"))), "")
    return out.select("vec_id", code.alias("code"), "error", "label_error", F.lit(fingerprint(books)).alias("codebooks_sha256"))


def _sql() -> str:
    steps = []
    for k in range(ROUNDS + 1):
        steps.append(
            f"far{k} AS (SELECT id, p.part, entry, x, list_sum(list_transform(list_zip(x, c), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS far FROM parts p JOIN book{k} b ON b.part = p.part), "
            f"near{k} AS (SELECT id, part, x, min({{'far': far, 'entry': entry}}) AS m FROM far{k} GROUP BY ALL)"
        )
        if k < ROUNDS:
            steps.append(
                f"sums{k} AS (SELECT part, m.entry AS entry, unnest(generate_series(1, len(x))) AS j, unnest(x) AS v FROM near{k}), "
                f"mean{k} AS (SELECT part, entry, j, sum(v) AS s, count(*) AS n FROM sums{k} GROUP BY ALL), "
                f"new{k} AS (SELECT part, entry, list(((s - ((s % n) + n) % n) // n)::BIGINT ORDER BY j) AS c FROM mean{k} GROUP BY ALL), "
                f"book{k + 1} AS (SELECT b.part, b.entry, coalesce(n.c, b.c) AS c FROM book{k} b LEFT JOIN new{k} n USING (part, entry))"
            )
    return f"""
WITH v AS (
  SELECT row_number() OVER (ORDER BY vec_id NULLS LAST, embedding) AS id, vec_id, label, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS e
  FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), parts AS (
  SELECT id, p AS part, e[p * (len(e) // 4) + 1:(p + 1) * (len(e) // 4)] AS x FROM v, (SELECT unnest(range(4)) AS p)
), book0 AS (
  SELECT part, id - 1 AS entry, x AS c FROM parts WHERE id <= 256
), {", ".join(steps)}, coded AS (
  SELECT id, string_agg(right('0' || lower(to_hex(m.entry)), 2), '' ORDER BY part) AS code, sum(m.far)::BIGINT AS error FROM near{ROUNDS} GROUP BY id
), sha AS (
  SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY part, entry)) AS codebooks_sha256 FROM book{ROUNDS}
)
SELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error, codebooks_sha256 FROM v JOIN coded USING (id), sha
"""


SQL = _sql()
