"""Retrieval evaluation and reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DONE = ("succeeded", "failed", "skipped")


def first_rank(hits: DataFrame, golden: DataFrame, k: int = 5) -> DataFrame:
    """golden (query_id, expected_doc) with first_rank: the rank, up to k, of the first hit (query_id, rank, source_name) of the expected source."""
    found = hits.where(F.col("rank") <= k).join(golden.select("query_id", "expected_doc"), "query_id").where("source_name = expected_doc")
    return golden.join(found.groupBy("query_id").agg(F.min("rank").alias("first_rank")), "query_id", "left")


def recall(rank: Column) -> Column:
    return F.when(rank.isNotNull(), 1.0).otherwise(0.0)


def reciprocal(rank: Column) -> Column:
    return F.coalesce(1.0 / rank, F.lit(0.0))


def keyword_rate(answer: Column, keywords: Column) -> Column:
    """The share of keywords that the answer holds, case ignored; null without an answer or keywords."""
    held = F.filter(keywords, lambda k: F.contains(F.lower(answer), F.lower(k)))
    return F.when(answer.isNotNull() & (F.size(keywords) > 0), F.size(held) / F.size(keywords))


def eval_summary(items: DataFrame) -> DataFrame:
    """n, recall_at_5, mrr, keyword_rate: means over the items (keyword_rate over those that have one), 4 decimals."""
    return items.agg(F.count("*").alias("n"), F.round(F.avg("recall_at_5"), 4).alias("recall_at_5"), F.round(F.avg("mrr"), 4).alias("mrr"), F.round(F.avg("keyword_rate"), 4).alias("keyword_rate"))


def collection_stats(collections: DataFrame, documents: DataFrame, chunks: DataFrame) -> DataFrame:
    """collection, model, documents (indexed ones only), chunks; zeros where there are none."""
    docs = documents.groupBy("collection").agg(F.count_if(F.col("status") == "indexed").alias("documents"))
    out = collections.select("collection", "model").join(docs, "collection", "left").join(chunks.groupBy("collection").agg(F.count("*").alias("chunks")), "collection", "left")
    return out.select("collection", "model", F.coalesce("documents", F.lit(0)).alias("documents"), F.coalesce("chunks", F.lit(0)).alias("chunks"))


def recent_jobs(jobs: DataFrame, n: int = 50) -> DataFrame:
    """The n latest jobs (greatest id) of each collection."""
    w = Window.partitionBy("collection").orderBy(F.desc("job_id"))
    return jobs.withColumn("nth", F.row_number().over(w)).where(F.col("nth") <= n).drop("nth")


def doc_type_listing(docs: DataFrame, chunks: DataFrame) -> DataFrame:
    """doc_type, title (55 characters and `...` beyond 58), n_chunks."""
    n = chunks.groupBy("doc_id").agg(F.count("*").alias("n_chunks"))
    title = F.when(F.length("title") > 58, F.concat(F.left("title", F.lit(55)), F.lit("..."))).otherwise(F.col("title"))
    return docs.join(n, "doc_id", "left").select("doc_type", title.alias("title"), F.coalesce("n_chunks", F.lit(0)).alias("n_chunks"))


def record_feedback(feedback: DataFrame) -> DataFrame:
    """Valid feedback (rating up or down) with an excerpt of 2000 characters; chunk_ids is a list by commas."""
    return feedback.where(F.col("rating").isin("up", "down")).withColumn("excerpt", F.left("excerpt", F.lit(2000)))


def chunk_votes(feedback: DataFrame) -> DataFrame:
    """chunk_id, up, down of valid feedback."""
    votes = record_feedback(feedback).select("rating", F.explode(F.filter(F.split("chunk_ids", ","), lambda c: c != "")).alias("chunk_id"))
    return votes.groupBy("chunk_id").agg(F.count_if(F.col("rating") == "up").alias("up"), F.count_if(F.col("rating") == "down").alias("down"))


def active_jobs(jobs: DataFrame) -> DataFrame:
    return jobs.where(~F.col("status").isin(*DONE)).groupBy("collection").agg(F.count("*").alias("active"))


def quota_stats(calls: DataFrame, at: Column) -> DataFrame:
    """model, last_minute, today, seconds_to_reset of calls (model, ts) as of a time; days begin at 08:00 UTC."""
    day = F.date_trunc("day", at - F.expr("interval 8 hours")) + F.expr("interval 8 hours")
    age = F.unix_micros(at) - F.unix_micros("ts")
    own = calls.groupBy("model").agg(F.count_if((age >= 0) & (age <= 60_000_000)).alias("last_minute"), F.count_if((age >= 0) & (F.col("ts") >= day)).alias("today"))
    return own.withColumn("seconds_to_reset", F.unix_seconds(day + F.expr("interval 1 day")) - F.unix_seconds(at))


def list_collections(collections: DataFrame, name: str = "collection") -> DataFrame:
    """collections, one row of each name, with position (from 1) by name."""
    once = collections.dropDuplicates([name]).withColumn("_every", F.lit(0))
    return _positions(once, "_every", name).drop("_every")


def list_documents(documents: DataFrame, by: str | Column, collection: str = "collection") -> DataFrame:
    """documents with position (from 1) in their collection by the column `by`."""
    return _positions(documents, collection, by)


def _positions(rows: DataFrame, group: str, by: str | Column) -> DataFrame:
    """rows with position (from 1) in each group by plain order; the rows are range-sorted, so a large group spans several tasks."""
    from siltstone.operators.assemble import positions

    return positions(rows, group, [F.col(by) if isinstance(by, str) else by])


def answered_keyword_rate(answers: DataFrame, items: DataFrame) -> DataFrame:
    """question_id, keyword_rate of items (question_id, keywords) by a table of answers (question_id, answer), null for a question without one."""
    both = items.join(answers.select("question_id", "answer"), "question_id", "left")
    return both.select("question_id", keyword_rate(F.col("answer"), F.col("keywords")).alias("keyword_rate"))
