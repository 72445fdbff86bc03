"""Retrieval for whole tables of questions: top-k search, fusion, diversification, reranking and context."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltstone.functions import text as X
from siltstone.operators.index import Bm25, bm25
from siltstone.operators.tables import parts

#: Constant of reciprocal-rank fusion; hits of a document before others come first; queries of a block; bytes of queries that are sent to every task.
RRF, PER_DOC, QUERY_BLOCK, QUERY_BYTES = 60, 4, 4096, 64 << 20
#: Scores that a task holds at once; tokens of sparse vectors that are multiplied at once.
TILE, TOKEN_SLICE = 1 << 21, 256
#: Pairs of a question and a chunk that one task scores, at most.
TASK_PAIRS = 2_000_000


def top_k(scored: DataFrame, k: int, *ties: str, by: str = "query_id") -> DataFrame:
    """scored with rank (1 to k) by descending score, then the tie columns; only k rows of a query leave each task."""
    w = Window.partitionBy(by).orderBy(F.desc("score"), *ties)
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def top_k_column(scored: DataFrame, bound: str, most: int, *ties: str) -> DataFrame:
    """As top_k with the bound of each row's own column; `most` bounds all, so that it reaches the window."""
    return top_k(scored, most, *ties).where(F.col("rank") <= F.col(bound))


def bm25_topk(questions: DataFrame, index: Bm25, k: int) -> DataFrame:
    """query_id, chunk_id, score, rank of questions (query_id, text): tokens count as often as they stand, scores above 0, ties by chunk_id.

    Only postings of the questions' tokens are weighed; statistics come from the written index. Questions' tokens go to all tasks if their measured number allows it, else they are joined. The postings
    found are dealt by chunk_id, to as many tasks as the pairs of questions and chunks need, and scored there.
    """
    asked = questions.select("query_id", F.explode(X.tokenize(F.col("text"))).alias("tok")).groupBy("query_id", "tok").agg(F.count("*").alias("times"))
    rows, n = asked.agg(F.count("*"), F.count_distinct("query_id")).first()
    whole = rows * 64 <= QUERY_BYTES
    sent = F.broadcast if whole else lambda df: df
    idf = index.idf.join(sent(asked.select("tok").distinct()), "tok", "left_semi").select("tok", "idf")
    held = index.postings.join(sent(asked.select("tok").distinct()), "tok", "left_semi")
    dealt = held.select("tok", "chunk_id", "tf", "len").repartition(parts(held.sparkSession, index.n * n, TASK_PAIRS), "chunk_id") if whole else held
    weight = bm25(F.col("tf"), F.col("len"), F.lit(index.mean), F.col("idf"))
    scored = dealt.join(sent(asked.join(idf, "tok")), "tok").groupBy("query_id", "chunk_id").agg(F.sum(weight * F.col("times")).alias("score"))
    return top_k(scored.where("score > 0"), k, "chunk_id")


def sparse_topk(queries: DataFrame, sparse: DataFrame, k: int, by: tuple[str, ...] = (), digits: int | None = None, block: int = QUERY_BLOCK) -> DataFrame:
    """query_id, chunk_id, score, rank: dot product of query (query_id, tok, w) and chunk vectors (chunk_id, tok, w) over shared tokens; pairs without one are no hits.

    by: columns of both, such as the collection, that a query shares with the chunks it may find. digits: decimals that scores are rounded to before they are ranked. As in dense_topk, vectors meet in
    blocks, so that pairs of tokens are never rows: a batch of chunks is multiplied with each query block, by slices of its tokens, and hands on its k best of each query. Ids are bigints.
    """
    kinds = [*[f"{c} {sparse.schema[c].dataType.simpleString()}" for c in by], "every int"]
    by = (*by, "every")  # one key at least
    kind = f"array<struct<tok:{sparse.schema['tok'].dataType.simpleString()},w:double>>"
    whole = lambda df, key: df.where("tok is not null and w is not null").withColumn("every", F.lit(0)).groupBy(F.col(key).cast("bigint").alias("id"), *by).agg(F.collect_list(F.struct("tok", F.col("w").cast("double").alias("w"))).alias("v"))
    asked = whole(queries, "query_id")
    blocks, size = _blocks(asked, list(by), F.size("v") * 16 + 64, block)
    packed = asked.groupBy(F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int").alias("block"), *by).agg(F.collect_list(F.struct(F.col("id").alias("qid"), F.col("v").alias("qv"))).alias("qs"))  # at most about `block` queries a row
    chunks = whole(sparse, "chunk_id").select(*by, F.col("id").alias("chunk_id"), "v").mapInArrow(_packed(list(by), "chunk_id"), ", ".join([*kinds, "ids array<bigint>", f"vs array<{kind}>"]))
    chunks = chunks.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    pairs = chunks.join(F.broadcast(packed) if size <= QUERY_BYTES else packed, ["block", *by]).select("ids", "vs", "qs")
    near = 1e-12 if digits is None else 10.0**-digits

    def entries(rows: pa.Array, of: pa.Array | None) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
        """The distinct tokens (`of`, if given), and row, number of the token and weight of each entry that has one of them, by token."""
        flat = rows.flatten()
        row, (tok, w) = np.repeat(np.arange(len(rows)), rows.value_lengths().to_numpy()), flat.flatten()
        of = pc.unique(tok) if of is None else of
        at = pc.fill_null(pc.index_in(tok, of), -1).to_numpy(zero_copy_only=False)
        order = np.argsort(at, kind="stable")[np.count_nonzero(at < 0) :]
        return of, row[order], at[order], w.to_numpy(zero_copy_only=False)[order]

    def product(q: tuple, c: tuple, rows: int, cols: int, n: int) -> np.ndarray:
        out = np.zeros((rows, cols))
        for begin in range(0, n, TOKEN_SLICE):
            wide, sides = min(TOKEN_SLICE, n - begin), []
            for (row, at, w), length in ((q, rows), (c, cols)):
                i, j = np.searchsorted(at, [begin, begin + wide])
                sides.append(np.bincount(row[i:j] * wide + at[i:j] - begin, w[i:j], length * wide).reshape(length, wide))
            out += sides[0] @ sides[1].T
        return out

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, vs, qs in zip(*(batch.column(c) for c in ("ids", "vs", "qs"))):
                ids, (asked_ids, qv), vs = ids.values.to_numpy(), qs.values.flatten(), vs.values
                asked_ids, step = asked_ids.to_numpy(), max(1, TILE // len(ids))
                for begin in range(0, len(asked_ids), step):
                    some = qv.slice(begin, step)
                    of, *q = entries(some, None)
                    _, *c = entries(vs, of)
                    score = product(q, c, len(some), len(ids), len(of))
                    if min(q[2].min(initial=1.0), c[2].min(initial=1.0)) <= 0:  # else what shares a token has a score above 0
                        shared = product((*q[:2], np.ones(len(q[2]))), (*c[:2], np.ones(len(c[2]))), len(some), len(ids), len(of)) > 0
                    else:
                        shared = score > 0
                    score[~shared] = -np.inf
                    n = min(k, len(ids))
                    bar = np.partition(score, len(ids) - n, axis=1)[:, len(ids) - n]
                    i, j = np.nonzero(shared & (score >= (bar - near * np.maximum(1, np.abs(np.where(np.isfinite(bar), bar, 0))))[:, None]))
                    yield pa.RecordBatch.from_arrays([pa.array(asked_ids[begin + i]), pa.array(ids[j]), pa.array(score[i, j])], ["query_id", "chunk_id", "score"])

    hits = pairs.mapInArrow(search, "query_id bigint, chunk_id bigint, score double")
    return top_k(hits if digits is None else hits.withColumn("score", F.round("score", digits)), k, "chunk_id")


def _blocks(queries: DataFrame, by: list[str], size: Column, block: int) -> tuple[int, int]:
    """Into how many blocks queries go, so that those that agree in `by` are about `block` in each; the bytes of all."""
    most, size = queries.groupBy(*by).agg(F.count("*").alias("n"), F.sum(size).alias("size")).agg(F.max("n"), F.sum("size")).first()
    return max(1, -(-(most or 0) // block)), size or 0


def _packed(by: list[str], ids: str):
    """Packs the rows of each batch that agree in `by` into one row of ids and vectors; nothing is shuffled."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(batch):
                continue
            numbered = pa.table({**{c: batch.column(c) for c in by}, "row": pa.array(np.arange(len(batch)))})
            groups = numbered.group_by(by).aggregate([("row", "list")]).combine_chunks()
            rows = groups.column("row_list").chunk(0)
            at = pa.array(rows.offsets.to_numpy() - rows.offsets[0].as_py(), pa.int32())
            lists = [pa.ListArray.from_arrays(at, batch.column(c).take(rows.flatten())) for c in (ids, "v")]
            yield pa.RecordBatch.from_arrays([*(groups.column(c).chunk(0) for c in by), *lists], [*by, "ids", "vs"])

    return pack


def dense_topk(queries: DataFrame, index: DataFrame, k: int, by: tuple[str, ...] = (), block: int = QUERY_BLOCK) -> DataFrame:
    """query_id, chunk_id, score, rank by cosine of queries (query_id, dense) and index (chunk_id, dense); a zero vector scores 0, null vectors take no part.

    by: columns of both, such as the collection, that a query shares with the chunks it may find. Queries are packed
    into blocks of about `block` of one collection; the index is read where it lies, a batch at a time, and each batch is multiplied with each query
    block of its collection (sent to all tasks if their measured bytes allow it, else joined). A batch hands on its k best
    of each query. Ids are bigints; vectors of another length than the query's are another `by`.
    """
    queries, index = queries.where("dense is not null"), index.where("dense is not null")
    kinds = [f"{c} {index.schema[c].dataType.simpleString()}" for c in by]
    blocks, size = _blocks(queries.withColumn("dims", F.size("dense")), ["dims", *by], F.size("dense") * 8 + 64, block)
    asked = queries.select(F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("int").alias("block"), *by, F.size("dense").alias("dims"), F.col("query_id").cast("bigint").alias("qid"), F.col("dense").cast("array<double>").alias("qv"))
    packed = asked.groupBy("block", "dims", *by).agg(F.collect_list(F.struct("qid", "qv")).alias("qs"))  # at most about `block` queries a row
    rows = index.select(*by, F.size("dense").alias("dims"), F.col("chunk_id").cast("bigint").alias("chunk_id"), F.col("dense").cast("array<double>").alias("v"))
    chunks = rows.mapInArrow(_packed([*by, "dims"], "chunk_id"), ", ".join([*kinds, "dims int", "ids array<bigint>", "vs array<array<double>>"]))
    chunks = chunks.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    pairs = chunks.join(F.broadcast(packed) if size <= QUERY_BYTES else packed, ["block", "dims", *by]).select("ids", "vs", "qs")

    def unit(vectors: pa.Array, rows: int) -> np.ndarray:
        v = vectors.flatten().to_numpy(zero_copy_only=False).reshape(rows, -1)
        return v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, vs, qs in zip(*(batch.column(c) for c in ("ids", "vs", "qs"))):
                ids, (asked_ids, qv) = ids.values.to_numpy(), qs.values.flatten()
                asked_ids, v, step = asked_ids.to_numpy(), unit(vs.values, len(ids)), max(1, TILE // len(ids))
                for begin in range(0, len(asked_ids), step):
                    some = qv.slice(begin, step)
                    score = unit(some, len(some)) @ v.T
                    n = min(k, len(ids))
                    bar = np.partition(score, len(ids) - n, axis=1)[:, len(ids) - n]
                    i, j = np.nonzero(score >= bar[:, None] - 1e-12)
                    yield pa.RecordBatch.from_arrays([pa.array(asked_ids[begin + i]), pa.array(ids[j]), pa.array(score[i, j])], ["query_id", "chunk_id", "score"])

    return top_k(pairs.mapInArrow(search, "query_id bigint, chunk_id bigint, score double"), k, "chunk_id")


def rrf_fuse(lists: list[DataFrame], k: int = RRF) -> DataFrame:
    """query_id, chunk_id, score, rank: the sum of 1 / (k + rank) over the lists (query_id, chunk_id, rank from 1); ties by first appearance."""
    every = reduce(DataFrame.unionByName, [x.select("query_id", "chunk_id", "rank", F.lit(i).alias("list")) for i, x in enumerate(lists)])
    fused = every.groupBy("query_id", "chunk_id").agg(F.sum(1.0 / (k + F.col("rank"))).alias("score"), F.min(F.struct("list", "rank")).alias("first"))
    w = Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 12)), "first")
    return fused.withColumn("rank", F.row_number().over(w)).drop("first")


def hybrid_search(dense: DataFrame, sparse: DataFrame, limit: int, k: int = RRF) -> DataFrame:
    """The fusion of both sides' first `limit`, cut at `limit`: query_id, chunk_id, score, rank, and the score of each side that found the hit (dense_score, sparse_score).

    Queries without sparse hits keep the dense ranking and scores.
    """
    dense, sparse = dense.where(F.col("rank") <= limit), sparse.where(F.col("rank") <= limit)
    asked = sparse.select("query_id").distinct()
    fused = rrf_fuse([dense.join(asked, "query_id", "left_semi"), sparse], k).where(F.col("rank") <= limit)
    hits = fused.unionByName(dense.join(asked, "query_id", "left_anti").select(*fused.columns))
    for side, name in ((dense, "dense_score"), (sparse, "sparse_score")):
        hits = hits.join(side.select("query_id", "chunk_id", F.col("score").alias(name)), ["query_id", "chunk_id"], "left")
    return hits


def multi_query_search(rankings: DataFrame, k: int = RRF) -> DataFrame:
    """Fuses the lists of each sub-query, then the sub-queries: rankings (query_id, sub, list, chunk_id, rank); ties by first appearance."""
    key = F.struct("query_id", "sub")
    inner = rankings.withColumn("q", key)
    fused = inner.groupBy("q", "chunk_id").agg(F.sum(1.0 / (k + F.col("rank"))).alias("score"), F.min(F.struct("list", "rank")).alias("first"))
    w = Window.partitionBy("q").orderBy(F.desc(F.round("score", 12)), "first")
    ranked = fused.withColumn("rank", F.row_number().over(w)).select("q.query_id", F.col("q.sub").alias("list"), "chunk_id", "rank")
    outer = ranked.groupBy("query_id", "chunk_id").agg(F.sum(1.0 / (k + F.col("rank"))).alias("score"), F.min(F.struct("list", "rank")).alias("first"))
    return outer.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 12)), "first"))).drop("first")


def backfill_payload(hits: DataFrame, index: DataFrame) -> DataFrame:
    """hits with the index's columns; hits whose chunk isn't there go."""
    return hits.join(index, "chunk_id")


def diversify(hits: DataFrame, most: int = PER_DOC) -> DataFrame:
    """hits (query_id, rank, doc_id, …) with place: documents in the order of their first hit, dealt round by round; ranks beyond `most` in a document follow after."""
    hits = hits.withColumn("in_doc", F.row_number().over(Window.partitionBy("query_id", "doc_id").orderBy("rank")))
    hits = hits.withColumn("doc_pos", F.min("rank").over(Window.partitionBy("query_id", "doc_id")))
    order = Window.partitionBy("query_id").orderBy(F.col("in_doc") > most, "in_doc", "doc_pos")
    return hits.withColumn("place", F.row_number().over(order)).drop("in_doc", "doc_pos")


def rerank(hits: DataFrame, scores: DataFrame, top: int, sort_few: bool = False) -> DataFrame:
    """hits (query_id, chunk_id, rank, score) sorted by scores (query_id, chunk_id, rerank_score), cut at `top`.

    A query with no more than `top` hits keeps its scores, and its order or, with sort_few, that of its scores (ties: by rank); a query of whose hits any lacks a score
    keeps its order and scores (cut at `top`).
    """
    hits = hits.join(scores.select("query_id", "chunk_id", "rerank_score"), ["query_id", "chunk_id"], "left")
    whole = Window.partitionBy("query_id")
    few = F.count("*").over(whole) <= top
    apply = ~few & (F.count("rerank_score").over(whole) == F.count("*").over(whole))
    hits = hits.withColumns({"apply": apply, "few": few})
    first = F.when(F.col("apply"), -F.col("rerank_score"))
    order = whole.orderBy(first.when(F.col("few"), -F.col("score")) if sort_few else first, "rank")
    out = hits.withColumn("place", F.row_number().over(order)).where(F.col("place") <= top)
    return out.select("query_id", "chunk_id", F.col("place").alias("rank"), F.when(F.col("apply"), F.col("rerank_score")).otherwise(F.col("score")).alias("score"))


def score_pairs(pairs: DataFrame, scorer: Callable[[list[tuple[str, str]]], Sequence[float]], batch: int = 32) -> DataFrame:
    """query_id, chunk_id, rerank_score of pairs (query_id, chunk_id, question, text): the scorer, such as a cross-encoder, gets `batch` pairs at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            both = list(zip(rows.column(2).to_pylist(), rows.column(3).to_pylist()))
            scores = [float(x) for i in range(0, len(both), batch) for x in scorer(both[i : i + batch])]
            yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(1), pa.array(scores, pa.float64())], ["query_id", "chunk_id", "rerank_score"])

    kinds = [f"{c} {pairs.schema[c].dataType.simpleString()}" for c in ("query_id", "chunk_id")]
    text = [F.coalesce(c, F.lit("")).alias(c) for c in ("question", "text")]
    return pairs.select("query_id", "chunk_id", *text).mapInArrow(run, ", ".join([*kinds, "rerank_score double"]))


def sources(hits: DataFrame) -> DataFrame:
    """query_id, n, chunk_id, score (4 decimals), excerpt (300 characters), images (8 at most) of hits with rank and text."""
    return hits.select("query_id", F.col("rank").alias("n"), "chunk_id", F.round("score", 4).alias("score"), X.truncate_text(F.col("text"), 300).alias("excerpt"), X.chunk_images(F.col("text")).alias("images"))


def context_block(n: Column, name: Column, section: Column, text: Column) -> Column:
    head = F.concat(F.lit("["), n.cast("string"), F.lit("] (source : "), F.when(F.coalesce(F.length(name), F.lit(0)) == 0, "?").otherwise(name))
    return F.concat(head, F.when(F.coalesce(F.length(section), F.lit(0)) > 0, F.concat(F.lit(" — "), section)).otherwise(""), F.lit(")\n"), text)


def titled_block(n: Column, metadata: Column, text: Column) -> Column:
    """A block headed `[Source n] (type) title — source`, each the first of several keys of the metadata (a map) that isn't empty, with fallbacks."""
    first = lambda *keys: F.coalesce(*[F.nullif(F.try_element_at(metadata, F.lit(k)), F.lit("")) for k in keys])
    kind, title = F.coalesce(first("doc_type", "type"), F.lit("document")), F.coalesce(first("doc_title", "title", "filename"), F.lit("document"))
    source = F.coalesce(F.concat(F.lit(" — "), first("source", "filepath", "url")), F.lit(""))
    return F.concat(F.lit("[Source "), n.cast("string"), F.lit("] ("), kind, F.lit(") "), title, source, F.lit("\n"), text)


def build_context(hits: DataFrame) -> DataFrame:
    """query_id, context of hits (query_id, rank, source_name, page_or_section, text)."""
    block = context_block(F.col("rank"), F.col("source_name"), F.col("page_or_section"), F.col("text"))
    by = hits.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", block.alias("b")))).alias("blocks"))
    return by.select("query_id", F.array_join("blocks.b", "\n\n---\n\n").alias("context"))


def build_prompt(question: Column, context: Column, lead: str = "Context:", ask: str = "Question:") -> Column:
    return F.concat(F.lit(lead + "\n\n"), context, F.lit("\n\n---\n\n" + ask + " "), question)


def drop_deleted(index: DataFrame, deleted: DataFrame) -> DataFrame:
    """The one snapshot that both sides of a search derive from, without deleted documents."""
    return index.join(deleted.select("doc_id"), "doc_id", "left_anti")
