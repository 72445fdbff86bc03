"""Exact top-k inner products by no-random-access aggregation of sorted lists, in blocks of vectors."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siltstone.llm import common

#: Vectors of a candidate block and queries of a query block; queries that read a block's lists together.
CANDIDATES, QUERIES, TOGETHER = 8192, 8192, 256
#: Shares of each list at which the bounds are compared; share of a block that may be left when a query stops.
DEPTHS = (1 / 8, 5 / 16, 7 / 16, 1 / 2, 9 / 16, 5 / 8, 11 / 16, 3 / 4, 7 / 8, 1)
FEW = 1 / 16
LONG = (1 << 63) - 1


class Lists:
    """The sorted lists of a block of vectors, one for each dimension, walked from both ends.

    Many queries read them together: a step walks each list on from where the last one stopped, once for all of them, and adds what it
    shows to `shown`, whose first half holds what was read from the greatest values on and whose second half what was read from the least (0:
    not read). A dimension in which a query is positive is read from the greatest value on, else from the least.
    Bounds are computed in single precision and widened by its greatest rounding error, which grows with the dimensions.
    """

    def __init__(self, vectors: np.ndarray):
        n, dims = vectors.shape
        self.exact, self.unit = vectors, _unit(vectors)
        x = vectors / self.unit
        order = np.argsort(-x, axis=0, kind="stable")
        self.order, self.sorted = order, np.take_along_axis(x, order, axis=0)
        self.length = np.sqrt((x * x).sum(axis=1))
        self.most = np.abs(x).max(axis=0, initial=0)
        self.error = (2 * dims + 32) * 2.0**-23

    def walk(self, end: int) -> None:
        """Reads entries self.end to end of each list, from either end."""
        dims = self.exact.shape[1]
        n, new = len(self.exact), slice(self.end, end)
        for first, at in ((0, new), (dims, slice(n - end, n - self.end))):
            rows, cols = self.order[at], np.arange(first, first + dims)
            self.shown[rows, cols] = self.sorted[at]
            self.left[rows, cols] = 0
        self.end = end

    def frontier(self, sides: np.ndarray, end: int) -> np.ndarray:
        """For each query and list the greatest product that an entry not read can have; sides: queries split by sign."""
        n = len(self.exact)
        return sides * np.append(self.sorted[end - 1], self.sorted[n - end])

    def search(self, queries: np.ndarray, k: int, own: np.ndarray, bars: np.ndarray) -> list[tuple[np.ndarray, int]]:
        """For each query (the vectors that may be among its k best, entries read of its lists).

        What no list has shown of a vector lies between the lists' worst ends and their frontiers, and (Cauchy-Schwarz)
        within the product of what is left of both lengths. Vectors whose upper bound misses the k-th lower bound (or the query's
        bar, a score that is known to be reached) are dropped. A query stops once a vector that no list has shown can't
        qualify and few others can; their scores are then resolved. own: the vector that is the query itself, or -1.
        """
        n, dims = self.exact.shape
        self.shown, self.left, self.end = np.zeros((n, 2 * dims), np.float32), np.ones((n, 2 * dims), np.float32), 0
        unit = np.array([_unit(q) for q in queries])
        q = queries / unit[:, None]
        sides = np.concatenate([np.maximum(q, 0), np.minimum(q, 0)], axis=1)
        used, size = np.count_nonzero(q, axis=1), np.sqrt((q * q).sum(axis=1))
        bar = bars / unit / self.unit
        bar = bar - np.abs(bar) * 2.0**-50
        worst = self.frontier(sides, n)
        out: list[tuple[np.ndarray, int]] = [(np.arange(n)[np.arange(n) != own[i]], 0) for i in range(len(q))]
        live, end = np.flatnonzero(used), 0
        loose = self.error * np.abs(q) @ self.most + 1e-30
        for share in DEPTHS:
            end = n if share == 1 else max(end + 1, int(n * share))
            if not len(live) or not n:
                break
            front = self.frontier(sides[live], min(end, n))
            outside = front.sum(axis=1) + loose[live]
            now = (bar[live] == -np.inf) | (outside < bar[live]) | (end >= n)  # the frontiers alone tell which can't stop here
            if not now.any():
                continue
            self.walk(min(end, n))
            mine, front, outside = live[now], front[now], outside[now]
            s = sides[mine]
            total = s.astype(np.float32) @ self.shown.T
            up, down, rest = ((m.astype(np.float32)) @ self.left.T for m in (front, worst[mine], s * s))
            square = (s != 0).astype(np.float32) @ (self.shown * self.shown).T
            e, wide = self.error, size[mine][:, None] * self.length
            reach = np.sqrt(np.maximum(rest, 0) + e * size[mine][:, None] ** 2) * np.sqrt(np.maximum(self.length**2 - square, 0) + e * self.length**2)
            slack = e * wide + 1e-30
            high = total + slack + np.minimum(up + loose[mine][:, None], reach)
            low = total - slack + np.maximum(down - loose[mine][:, None], -reach)
            there = np.flatnonzero(own[mine] >= 0)
            high[there, own[mine][there]] = low[there, own[mine][there]] = -np.inf
            if n > k:
                bar[mine] = np.maximum(bar[mine], np.partition(low, n - k, axis=1)[:, n - k])
            still = high >= bar[mine][:, None]
            done = (end >= n) | ((outside < bar[mine]) & (still.sum(axis=1) <= max(4 * k, n * FEW)))
            for i in np.flatnonzero(done):
                rows = np.flatnonzero(still[i])
                out[mine[i]] = (rows[rows != own[mine[i]]], min(end, n) * int(used[mine[i]]))
            live = np.setdiff1d(live, mine[done])
        return out

    def scores(self, rows: np.ndarray, query: np.ndarray) -> list[int]:
        """Exact integer inner products, of any size."""
        if float(np.abs(query).max(initial=0)) * self.unit * max(1, len(query)) < 2**53:
            return (self.exact[rows] @ query).astype(np.int64).tolist()
        q = [int(x) for x in query.tolist()]
        return [sum(int(a) * b for a, b in zip(v, q)) for v in self.exact[rows].tolist()]


def _unit(x: np.ndarray) -> float:
    """The power of two from the greatest absolute value on: dividing by it is exact."""
    most = float(np.abs(x).max(initial=0))
    return 2.0 ** min(1023, int(np.frexp(most)[1])) if most else 1.0


def _matrix(table: pa.Table) -> np.ndarray:
    return table.column("v").combine_chunks().flatten().to_numpy().reshape(len(table), -1)


FOUND = "asker bigint, query_id bigint, vec_id bigint, score bigint, wide string, read bigint, held bigint"


def _block(k: int):
    """The k best of one query block in one candidate block; a row without vec_id tells how many entries were read of how many."""

    def search(left: pa.Table, right: pa.Table) -> pa.Table:
        cols: list[list] = [[] for _ in range(7)]
        if len(left) and len(right):
            lists, ids = Lists(_matrix(left)), left.column("vec_id").to_numpy()
            place = {row: i for i, row in enumerate(left.column("row").to_pylist())}
            for lo in range(0, len(right), TOGETHER):
                part = right.slice(lo, TOGETHER)
                queries, bars, askers = _matrix(part), part.column("bar").to_pylist(), part.column("row").to_pylist()
                own = np.array([place.get(a, -1) for a in askers])
                found = lists.search(queries, k, own, np.array([-np.inf if b is None else float(b) for b in bars]))
                for asker, query, bar, q, (rows, read) in zip(askers, part.column("query_id").to_pylist(), bars, queries, found):
                    best = sorted(zip((-s for s in lists.scores(rows, q)), ids[rows].tolist()))[:k]
                    best = [b for b in best if bar is None or -b[0] >= bar]
                    cols[0] += [asker] * (len(best) + 1)
                    cols[1] += [query] * (len(best) + 1)
                    cols[2] += [*(i for _, i in best), None]
                    cols[3] += [*(max(-LONG, min(LONG, -s)) for s, _ in best), None]
                    cols[4] += [*(str(-s + 10**640).zfill(641) if abs(s) >= LONG else None for s, _ in best), None]
                    cols[5] += [0] * len(best) + [read]
                    cols[6] += [0] * len(best) + [q.size * len(ids)]
        kinds = [pa.int64()] * 4 + [pa.string(), pa.int64(), pa.int64()]
        return pa.table({n: pa.array(c, t) for n, c, t in zip((x.split()[0] for x in FOUND.split(", ")), cols, kinds)})

    return search


def exact_top_k(vectors: DataFrame, k: int = 20, scale: int = 64, query: str = "vec_id % 20 = 0", block: int = CANDIDATES, queries: int = QUERIES) -> DataFrame:
    """The k best vectors of each query by integer inner product: query_id, rank (from 1), vec_id, score, read_share.

    vectors: vec_id and embedding; each component x counts as floor(scale * x). Every row that fulfils
    `query` is a query, and every other row of the same number of dimensions is its candidate: repeated rows and rows of one id are rows of their own, and a repeated
    query has its ranks twice. Ties go to the smaller vec_id.
    Rows whose vec_id or vector is null or whose components hold a null or non-finite value take no part; an empty table gives no
    rows; other columns are ignored. Products are exact at any size (components from
    2.6e306 on count as that); a score beyond the range of a bigint is shown as its end, its rank is that of the true score. read_share: entries of sorted lists read for
    the query over all entries there are.

    Vectors are dealt into blocks of about `block` by hash. A query first searches its own block; the k-th
    score found there is a bound that lets the other blocks stop sooner, and they return nothing below it.
    Candidates are copied once for each `queries` queries.
    """
    v = vectors.select(F.col("vec_id").cast("bigint").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    v = v.where(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & (F.size("v") > 0) & finite)
    whole = F.transform("v", lambda x: F.when(F.abs(x) < 2.0**52, F.floor(x * scale).cast("double")).otherwise(F.least(F.greatest(x * scale, F.lit(-1.7e308)), F.lit(1.7e308))))
    v = common.settle(v.select("vec_id", whole.alias("v"), F.size("v").alias("dims"), F.monotonically_increasing_id().alias("row")))
    n, asked = v.agg(F.count("*"), F.count_if(F.expr(query))).first()
    blocks, asks = max(1, -(-n // block)), max(1, -(-asked // queries))
    place = lambda c: F.pmod(F.xxhash64(c), F.lit(blocks)).cast("int")
    turn = lambda c: F.pmod(F.xxhash64(c, F.lit(1)), F.lit(asks)).cast("int")
    left = v.select("row", "vec_id", "v", "dims", place("row").alias("block"), F.explode(F.sequence(F.lit(0), F.lit(asks - 1))).alias("ask"))
    asker = common.settle(v.where(query).select("row", F.col("vec_id").alias("query_id"), "v", "dims", place("row").alias("home"), turn("row").alias("ask")))

    def met(right: DataFrame) -> DataFrame:
        keys = ("dims", "block", "ask")
        return common.settle(left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(_block(k), FOUND))

    best = met(asker.withColumn("block", F.col("home")).withColumn("bar", F.lit(None).cast("bigint")))
    if blocks > 1:
        sure = F.when((F.count("score") >= k) & (F.min("score") > -LONG), F.min("score"))
        bars = best.groupBy(F.col("asker").alias("row")).agg(sure.alias("bar"))
        other = asker.join(bars, "row", "left").withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).where("block <> home")
        best = best.unionByName(met(other))
    mine = Window.partitionBy("asker")
    order = mine.orderBy(F.desc_nulls_last("score"), F.desc("wide"), "vec_id")
    best = best.withColumn("read_share", F.sum("read").over(mine) / F.sum("held").over(mine)).withColumn("rank", F.row_number().over(order))
    return best.where((F.col("rank") <= k) & F.col("vec_id").isNotNull()).select("query_id", "rank", "vec_id", "score", "read_share")


def op9_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = exact_top_k(common.table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))
    return out.select("query_id", "rank", "vec_id", "score")


SQL = """
WITH v AS (
  SELECT row_number() OVER () AS row, vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS e
  FROM embeddings
  WHERE embedding IS NOT NULL AND vec_id IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.row, q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score
  FROM v q JOIN v c ON q.row <> c.row WHERE q.vec_id % 20 = 0
), r AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY row ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""
