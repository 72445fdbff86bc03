"""BM25 search that reads part of the postings: blocks by greatest weight, and look-ups for what the common words add."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siltstone.functions import text as X
from siltstone.operators import assemble, tables
from siltstone.operators.index import TASK_ROWS, Bm25, bm25
from siltstone.operators.retrieve import bm25_topk, top_k
from siltstone.sources.versions import VersionedTables

#: Postings of a block; blocks of each token that set a question's bound.
BLOCK, FIRST = 128, 1


@dataclass(frozen=True)
class Blocks:
    """A written form of a Bm25 index. blocks: tok, block (from 0, by falling weight), top (the greatest weight in it), ids, weights, both in order; terms: chunk_id, tok, weight, the index's postings as they lie. block: postings of a full one. Weights are without idf."""

    index: Bm25
    blocks: DataFrame
    terms: DataFrame
    block: int


def build_blocks(index: Bm25, path: str, block: int = BLOCK, buckets: int = 16) -> Blocks:
    """Writes the postings of index by token in blocks of falling weight.

    Postings are shuffled once, by ranges of (bucket, token), and written where they lie. The index knows each token's df: one that is more than a task's work is range-sorted by weight
    too (assemble.positions), so a token that stands everywhere spans many tasks.
    """
    spark = index.idf.sparkSession
    store = VersionedTables(spark, path, buckets, {"blocks": ["tok"]})
    weight = bm25(F.col("tf"), F.col("len"), F.lit(index.mean), F.lit(1.0))
    terms = index.postings.select("chunk_id", "tok", weight.alias("weight"))
    order, n, most = [F.desc("weight"), F.col("chunk_id")], *index.idf.agg(F.sum("df"), F.max("df")).first()
    large = F.broadcast(index.idf.where(F.col("df") > TASK_ROWS).select("tok"))  # a row for TASK_ROWS postings at most

    def packed(placed: DataFrame) -> DataFrame:
        by = placed.groupBy("bucket", "tok", F.floor((F.col("position") - 1) / block).cast("int").alias("block"))
        return by.agg(F.max("weight").alias("top"), F.array_sort(F.collect_list(F.struct("position", "chunk_id", "weight"))).alias("p"))  # `block` postings a row

    dealt = terms.join(large, "tok", "left_anti").withColumn("bucket", store.bucket("blocks")).repartitionByRange(tables.parts(spark, n or 0, TASK_ROWS), "bucket", "tok")
    rows = packed(dealt.withColumn("position", F.row_number().over(Window.partitionBy("bucket", "tok").orderBy(*order))))
    if (most or 0) > TASK_ROWS:
        placed = assemble.positions(terms.join(large, "tok", "left_semi"), "tok", order).withColumn("bucket", store.bucket("blocks"))
        rows = rows.unionByName(packed(placed).repartitionByRange("bucket", "tok", "block"))
    store.change({"blocks": rows.select("tok", "block", "top", F.col("p.chunk_id").alias("ids"), F.col("p.weight").alias("weights"))}, reset=["blocks"], dealt=["blocks"])
    return Blocks(index, store.table("blocks"), terms, block)


def blocks_topk(questions: DataFrame, held: Blocks, k: int, first: int = FIRST) -> DataFrame:
    """query_id, chunk_id, score, rank as bm25_topk, exactly, with read (postings read or looked up for the question) and postings (of its tokens in all).

    1. The first blocks of a question's tokens give partial scores; the k-th of these is a bound that the k-th best score reaches. 2. Tokens are taken in the order of the most that they can
    add; the least of them, which together stay below the bound, can't carry a chunk into the result on their own (tokens whose postings the first blocks hold are read anyway). Blocks of the others are read where
    their greatest weight and the most that all other tokens add reach the bound. 3. Chunks found there that can still reach the bound get what
    the least tokens add by a look-up of (chunk, token): what is found and the least tokens' postings are dealt by chunk, so that what they add is no row. Weights are never negative here: with a negative mean idf the whole postings are read.
    """
    index = held.index
    asked = questions.select("query_id", F.explode(X.raw_tokens(F.col("text"))).alias("tok")).select("query_id", F.lower("tok").alias("tok")).where(X.is_token(F.col("tok")))
    asked = asked.groupBy("query_id", "tok").agg(F.count("*").alias("times")).join(index.idf, "tok").withColumn("w", F.col("times") * F.col("idf"))
    asked = tables.written(asked.select("query_id", "tok", "df", "w"), "asked")
    every = asked.groupBy("query_id").agg(F.sum("df").alias("postings"))
    if not asked.where("w < 0").isEmpty():
        return bm25_topk(questions, index, k).join(every, "query_id").withColumn("read", F.col("postings"))
    opened = lambda rows: rows.select("query_id", "tok", "block", "w", F.explode(F.arrays_zip("ids", "weights")).alias("p")).select("query_id", "tok", F.col("p.ids").alias("chunk_id"), (F.col("w") * F.col("p.weights")).alias("add"))
    slack = 1 - 1e-9  # sums in another order

    head = tables.written(asked.join(held.blocks.where(F.col("block") < first), "tok"), "head")
    partial = top_k(opened(head).groupBy("query_id", "chunk_id").agg(F.sum("add").alias("score")), k, "chunk_id")
    bounds = partial.where(F.col("rank") == k).select("query_id", (F.col("score") * slack).alias("bar"))
    most = head.where("block = 0").select("query_id", "tok", (F.col("w") * F.col("top")).alias("most"))
    mine = Window.partitionBy("query_id")
    tokens = asked.join(most, ["query_id", "tok"]).join(bounds, "query_id", "left").withColumn("bar", F.coalesce("bar", F.lit(0.0)))
    tokens = tokens.withColumns({"below": F.sum("most").over(mine.orderBy("most", "tok").rowsBetween(Window.unboundedPreceding, 0)), "total": F.sum("most").over(mine)})
    tokens = tables.written(tokens.withColumn("least", (F.col("below") < F.col("bar")) & (F.col("df") > first * held.block)), "tokens")

    carrying = tokens.where("not least").join(held.blocks, "tok").where(F.col("w") * F.col("top") + F.col("total") - F.col("most") >= F.col("bar") * slack)
    carrying = tables.written(carrying.select("query_id", "tok", "block", "w", "ids", "weights"), "carrying")
    least = F.collect_list(F.when(F.col("least"), F.struct("tok", "w"))).alias("least")
    rest = tokens.groupBy("query_id").agg(F.max("bar").alias("bar"), F.coalesce(F.sum(F.when(F.col("least"), F.col("most"))), F.lit(0.0)).alias("rest"), least)
    common = tokens.where("least").select("tok", "df").distinct()
    parts = tables.parts(questions.sparkSession, max(carrying.count() * held.block, common.agg(F.sum("df")).first()[0] or 0), TASK_ROWS)
    found = opened(carrying).repartition(parts, "chunk_id").groupBy("query_id", "chunk_id").agg(F.sum("add").alias("score"))
    found = found.join(rest, "query_id").where(F.col("score") + F.col("rest") >= F.col("bar") * slack)
    stored = held.terms.join(common, "tok", "left_semi").repartition(parts, "chunk_id").groupBy("chunk_id").agg(F.map_from_entries(F.collect_list(F.struct("tok", "weight"))).alias("terms"))
    adds = F.filter(F.transform("least", lambda t: t["w"] * F.try_element_at("terms", t["tok"])), lambda x: x.isNotNull())
    whole = found.join(stored, "chunk_id", "left").select("query_id", "chunk_id", "score", adds.alias("adds"))
    whole = tables.written(whole.select("query_id", "chunk_id", F.aggregate("adds", F.col("score"), lambda a, x: a + x).alias("score"), F.size("adds").alias("n")), "whole")

    size = F.size("ids")
    tail = head.join(carrying.select("query_id", "tok", "block"), ["query_id", "tok", "block"], "left_anti")
    read = carrying.select("query_id", size.alias("n")).unionByName(tail.select("query_id", size.alias("n"))).unionByName(whole.select("query_id", "n"))
    read = read.groupBy("query_id").agg(F.sum("n").alias("read"))
    return top_k(whole.drop("n").where("score > 0"), k, "chunk_id").join(read, "query_id").join(every, "query_id")
