"""Queries of incremental maintenance: two snapshots of documents; and of reports and evaluation."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.functions import text as X
from siltstone.operators import evaluate as E
from siltstone.operators import incremental as I
from siltstone.operators import index as N
from siltstone.plans.base import read, scratch
from siltstone.plans.chunks import BM25_SQL
from siltstone.plans.retrieval import LEX_SQL, lexical
from siltstone.sources.versions import VersionedTables

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return put


def state(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "documents").select(F.col("source").alias("collection"), "doc_id", F.sha2("text", 256).alias("content_hash"), F.floor(F.col("n_chars") / 500).alias("n_chunks"))


def incoming(spark: SparkSession, d: str) -> DataFrame:
    """The second snapshot: every tenth document gone, the next changed, the next copied under a new id; every fiftieth converts to nothing."""
    docs = read(spark, d, "documents").where("doc_id % 10 > 0")
    text = F.when(F.col("doc_id") % 10 == 1, F.concat("text", F.lit(" v2"))).when(F.col("doc_id") % 50 == 7, F.lit("")).otherwise(F.col("text"))
    both = docs.unionByName(docs.where("doc_id % 10 = 2").withColumn("doc_id", F.col("doc_id") + 1_000_000))
    both = both.select(F.col("source").alias("collection"), "doc_id", text.alias("markdown"), F.floor(F.col("n_chars") / 500).alias("n_chunks"))
    return both.withColumn("content_hash", F.sha2("markdown", 256)).withColumn("n_chunks", F.when(F.col("markdown") == "", 0).otherwise(F.col("n_chunks") + 1))


_STATE = "st AS (SELECT source AS collection, doc_id, sha256(text) AS content_hash, n_chars // 500 AS n_chunks FROM documents)"
_IN = (
    "r2 AS (SELECT source, doc_id, text, n_chars FROM documents WHERE doc_id % 10 > 0 UNION ALL SELECT source, doc_id + 1000000, text, n_chars FROM documents WHERE doc_id % 10 = 2), "
    "m2 AS (SELECT source AS collection, doc_id, CASE WHEN doc_id % 10 = 1 THEN text || ' v2' WHEN doc_id % 50 = 7 THEN '' ELSE text END AS markdown, n_chars FROM r2), "
    "inc AS (SELECT collection, doc_id, markdown, sha256(markdown) AS content_hash, CASE WHEN markdown = '' THEN 0 ELSE n_chars // 500 + 1 END AS n_chunks FROM m2)"
)
_CLASS = f"{_STATE}, {_IN}, cl AS (SELECT i.*, CASE WHEN markdown = '' OR i.n_chunks = 0 THEN 'failed' WHEN s.doc_id IS NULL THEN 'new' WHEN s.content_hash = i.content_hash THEN 'skipped' ELSE 'updated' END AS status FROM inc i LEFT JOIN st s USING (collection, doc_id))"


def classified(spark: SparkSession, d: str) -> DataFrame:
    return I.classify_changes(incoming(spark, d), state(spark, d))


@query(f"WITH {_CLASS} SELECT collection, doc_id, status FROM cl")
def inc1_classify_changes(spark: SparkSession, d: str) -> DataFrame:
    return classified(spark, d).select("collection", "doc_id", "status")


@query("SELECT doc_id FROM documents WHERE doc_id % 10 = 0")
def inc2_find_removed(spark: SparkSession, d: str) -> DataFrame:
    return I.find_removed(state(spark, d), incoming(spark, d)).select("doc_id")


def index(spark: SparkSession, d: str) -> DataFrame:
    rows = read(spark, d, "documents").select(F.col("source").alias("collection"), "doc_id", F.sha2("text", 256).alias("content_hash"), F.posexplode(F.split("text", "\n")).alias("chunk_index", "text"))
    return rows


_INDEX = "ix AS (SELECT source AS collection, doc_id, sha256(text) AS content_hash, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS chunk_index, unnest(string_split(text, chr(10))) AS text FROM documents)"


def stored(spark: SparkSession, d: str) -> VersionedTables:
    """An index of all documents: chunks, images of every third document and the documents themselves, as one version."""
    held, docs = VersionedTables(spark, scratch(spark, "index"), 8), state(spark, d)
    held.change({"chunks": index(spark, d), "images": docs.where("doc_id % 3 = 0").select("collection", "doc_id", "content_hash"), "documents": docs})
    return held


@query(f"WITH {_INDEX} SELECT doc_id, CAST(chunk_index AS INTEGER) AS chunk_index, md5(text) AS text FROM ix WHERE doc_id % 10 <> 1 UNION ALL SELECT doc_id, 0, md5('v2') FROM documents WHERE doc_id % 10 = 1")
def inc3_replace_document_chunks(spark: SparkSession, d: str) -> DataFrame:
    held = stored(spark, d)
    fresh = index(spark, d).where("doc_id % 10 = 1 and chunk_index = 0").withColumn("text", F.lit("v2"))
    held.replace_documents({"chunks": fresh}, fresh)
    return held.table("chunks").select("doc_id", "chunk_index", F.md5("text").alias("text"))


@query(f"WITH {_INDEX} SELECT collection, count(*) AS chunks FROM ix WHERE doc_id % 4 > 0 GROUP BY collection")
def inc4_delete_document(spark: SparkSession, d: str) -> DataFrame:
    held = stored(spark, d)
    held.delete_documents(state(spark, d).where("doc_id % 4 = 0"))
    return held.table("chunks").groupBy("collection").agg(F.count("*").alias("chunks"))


@query(
    f"WITH {_INDEX} SELECT 'chunks' AS kind, (SELECT count(*) FROM ix WHERE doc_id % 4 = 0) AS deleted, (SELECT count(*) FROM ix WHERE doc_id % 4 > 0) AS kept UNION ALL "
    "SELECT 'images', count(*) FILTER (WHERE doc_id % 4 = 0), count(*) FILTER (WHERE doc_id % 4 > 0) FROM documents WHERE doc_id % 3 = 0 UNION ALL "
    "SELECT 'documents', count(*) FILTER (WHERE doc_id % 4 = 0), count(*) FILTER (WHERE doc_id % 4 > 0) FROM documents"
)
def inc4_deleted_rows(spark: SparkSession, d: str) -> DataFrame:
    """How many rows a deletion took from each table, and how many it left."""
    held = stored(spark, d)
    gone = held.delete_documents(state(spark, d).where("doc_id % 4 = 0"))
    rows = [held.table(kind).agg(F.lit(kind).alias("kind"), F.lit(n).cast("bigint").alias("deleted"), F.count("*").alias("kept")) for kind, n in gone.items()]
    return reduce(DataFrame.unionByName, rows)


@query(
    f"WITH {_CLASS} SELECT collection, doc_id, CASE WHEN c.status IN ('new', 'updated') THEN 'indexed' WHEN c.status = 'failed' THEN 'failed' ELSE 'indexed' END AS status, "
    "CASE WHEN c.status IN ('new', 'updated') THEN c.n_chunks ELSE s.n_chunks END AS n_chunks, CASE WHEN c.status = 'failed' THEN 'empty' END AS error FROM st s FULL JOIN cl c USING (collection, doc_id)"
)
def inc5_document_projection(spark: SparkSession, d: str) -> DataFrame:
    documents = state(spark, d).withColumns({"status": F.lit("indexed"), "error": F.lit(None).cast("string")})
    results = classified(spark, d).select("collection", "doc_id", "status", "n_chunks", "content_hash", F.when(F.col("status") == "failed", "empty").alias("error"), F.lit(1).alias("seq"))
    return I.document_projection(documents, results).select("collection", "doc_id", "status", "n_chunks", "error")


@query("SELECT event_id, CASE event_id % 5 WHEN 0 THEN 'succeeded' WHEN 1 THEN 'succeeded' WHEN 2 THEN 'skipped' ELSE 'failed' END AS status FROM events")
def inc6_job_status(spark: SparkSession, d: str) -> DataFrame:
    result = F.element_at(F.array(*map(F.lit, ("new", "updated", "skipped", "failed", "strange"))), (F.col("event_id") % 5 + 1).cast("int"))
    return read(spark, d, "events").select("event_id", I.job_status(result).alias("status"))


@query(f"WITH {_CLASS}, documents AS (SELECT doc_id, markdown AS text FROM cl WHERE status <> 'failed' UNION ALL SELECT s.doc_id, t.text FROM st s JOIN main.documents t USING (doc_id) WHERE s.doc_id IN (SELECT doc_id FROM cl WHERE status = 'failed')), {BM25_SQL} SELECT tok, df, round(idf, 6) AS idf FROM i")
def idx2_bm25_update(spark: SparkSession, d: str) -> DataFrame:
    """The statistics after the second snapshot, from those of the first and the documents that changed. A document that failed stays as it was."""
    text = lambda df, c: df.select("collection", "doc_id", F.col("doc_id").alias("chunk_id"), F.col(c).alias("text"))
    old = text(read(spark, d, "documents").withColumn("collection", F.col("source")), "text")
    index = N.build_bm25(old, scratch(spark, "bm25"))
    before, after = N.changed_chunks(classified(spark, d), I.find_removed(state(spark, d), incoming(spark, d)), old, text(incoming(spark, d), "markdown"))
    return N.update_bm25(index, before, after).idf.select("tok", "df", F.round("idf", 6).alias("idf"))


@query(f"WITH {_CLASS} SELECT doc_id, n_chunks FROM inc WHERE n_chunks > 0")
def inc7_reset_index(spark: SparkSession, d: str) -> DataFrame:
    """A full rebuild classifies against an empty state and overwrites the index: what stood there before is gone, everything that converts is new."""
    held = stored(spark, d)
    fresh = I.classify_changes(incoming(spark, d), state(spark, d).limit(0)).where("status = 'new'")
    I.reset_index(held, {"documents": fresh.select("collection", "doc_id", "content_hash", "n_chunks")})
    left = held.table("documents").select("doc_id", "n_chunks")
    return left.join(held.table("chunks").select("doc_id"), "doc_id", "left_anti")


@query(f"WITH {_CLASS} SELECT count(*) AS sources, count(*) FILTER (WHERE status = 'new') AS \"new\", count(*) FILTER (WHERE status = 'updated') AS updated, count(*) FILTER (WHERE status = 'skipped') AS unchanged, count(*) FILTER (WHERE status = 'failed') AS failed, CAST(sum(n_chunks) FILTER (WHERE status IN ('new', 'updated')) AS BIGINT) AS chunks, (SELECT count(*) FROM documents WHERE doc_id % 10 = 0) AS deleted FROM cl")
def inc8_ingest_report(spark: SparkSession, d: str) -> DataFrame:
    return I.ingest_report(classified(spark, d), I.find_removed(state(spark, d), incoming(spark, d)))


@query(
    "SELECT kind, collection, count(*) AS n FROM (SELECT 'documents' AS kind, source AS collection FROM documents UNION ALL SELECT 'jobs', source FROM documents WHERE doc_id % 5 = 0 "
    "UNION ALL SELECT 'chunks', source FROM (SELECT source, unnest(string_split(text, chr(10))) FROM documents) UNION ALL SELECT 'images', source FROM documents WHERE doc_id % 3 = 0) WHERE collection NOT IN ('src1', 'src2') GROUP BY ALL"
)
def inc9_drop_collection(spark: SparkSession, d: str) -> DataFrame:
    docs = read(spark, d, "documents").select(F.col("source").alias("collection"), "doc_id", "text")
    held = VersionedTables(spark, scratch(spark, "index"), 8)
    held.change({"documents": docs, "jobs": docs.where("doc_id % 5 = 0"), "chunks": docs.select("collection", "doc_id", F.explode(F.split("text", "\n")).alias("text")), "images": docs.where("doc_id % 3 = 0")})
    held.drop_collections(docs.where("collection in ('src1', 'src2')"))
    rows = [held.table(kind).groupBy("collection").agg(F.count("*").alias("n")).select(F.lit(kind).alias("kind"), "collection", "n") for kind in ("documents", "jobs", "chunks", "images")]
    return reduce(DataFrame.unionByName, rows)


@query(f"WITH {_INDEX} SELECT collection, doc_id, count(*) AS chunks, min(content_hash) AS doc_hash FROM ix GROUP BY ALL")
def inc10_ids(spark: SparkSession, d: str) -> DataFrame:
    return I.index_ids(index(spark, d))


@query("SELECT CAST(n_nationkey AS VARCHAR) AS collection, CASE WHEN n_nationkey % 2 = 0 THEN CAST(n_regionkey AS INTEGER) ELSE 5 END AS top_k, 10 AS rerank_k FROM nation")
def inc11_effective_settings(spark: SparkSession, d: str) -> DataFrame:
    own = read(spark, d, "nation").select(F.col("n_nationkey").cast("string").alias("collection"), F.when(F.col("n_nationkey") % 2 == 0, F.col("n_regionkey").cast("int")).alias("top_k"))
    return I.effective_settings(own, {"top_k": 5, "rerank_k": 10})


@query("SELECT CASE WHEN c_custkey % 5 = 3 THEN 'update' ELSE 'create' END AS op, CASE WHEN c_custkey % 5 = 0 THEN c_name || ' x' WHEN c_custkey % 5 = 4 THEN 'n_' || CAST(c_custkey AS VARCHAR) WHEN c_custkey % 5 IN (1, 3) THEN 'k' || CAST(c_nationkey AS VARCHAR) ELSE repeat('x', 65) END AS name, CASE c_custkey % 5 WHEN 0 THEN 'invalid name' WHEN 2 THEN 'invalid name' WHEN 1 THEN 'duplicate' ELSE 'frozen' END AS error FROM customer WHERE c_custkey % 5 < 4")
def inc12_validate_collections(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("c_custkey") % 5
    name = F.when(k == 0, F.concat("c_name", F.lit(" x"))).when(k == 4, F.concat(F.lit("n_"), F.col("c_custkey").cast("string"))).when(k.isin(1, 3), F.concat(F.lit("k"), F.col("c_nationkey").cast("string"))).otherwise("x" * 65)
    changes = read(spark, d, "customer").select(F.when(k == 3, "update").otherwise("create").alias("op"), name.alias("name"), F.lit(None).cast("string").alias("embedder"), F.lit(None).cast("string").alias("embedding_model"), F.when(k == 3, 32).alias("dense_dim"), F.lit(None).cast("boolean").alias("supports_sparse"))
    existing = read(spark, d, "nation").select(F.concat(F.lit("k"), F.col("n_nationkey").cast("string")).alias("name"), F.lit("hash").alias("embedder"), F.lit("m").alias("embedding_model"), F.lit(64).alias("dense_dim"), F.lit(True).alias("supports_sparse"))
    return I.validate_collections(existing, changes)


@query("SELECT source, count(*) AS n FROM (SELECT source FROM documents WHERE doc_id % 2 = 0 UNION ALL SELECT source FROM documents) GROUP BY source")
def inc13_union_sources(spark: SparkSession, d: str) -> DataFrame:
    docs = read(spark, d, "documents").select("doc_id", "source")
    return I.union_sources(docs.where("doc_id % 2 = 0").select("source", "doc_id"), docs).groupBy("source").agg(F.count("*").alias("n"))


def _golden(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.concat(F.lit("src"), (F.col("item_id") % 20).cast("string")).alias("expected_doc"), "text")


def ranked(spark: SparkSession, d: str) -> DataFrame:
    hits = lexical(spark, d).join(read(spark, d, "documents").select(F.col("doc_id").alias("chunk_id"), F.col("source").alias("source_name")), "chunk_id")
    return E.first_rank(hits, _golden(spark, d))


_RANK = LEX_SQL + ", fr AS (SELECT b.item_id AS query_id, (SELECT CAST(min(rank) AS INTEGER) FROM lex JOIN documents ON doc_id = chunk_id WHERE query_id = b.item_id AND rank <= 5 AND source = 'src' || CAST(b.item_id % 20 AS VARCHAR)) AS first_rank FROM benchmark b) "
_ITEMS = ", ev AS (SELECT query_id, first_rank, CASE WHEN first_rank IS NULL THEN 0.0::DOUBLE ELSE 1.0 END AS recall_at_5, coalesce(1.0::DOUBLE / first_rank, 0) AS mrr FROM fr) "


@query(f"WITH {_RANK} SELECT query_id, first_rank FROM fr")
def eva1_first_rank(spark: SparkSession, d: str) -> DataFrame:
    return ranked(spark, d).select("query_id", "first_rank")


@query(f"WITH {_RANK} {_ITEMS} SELECT query_id, recall_at_5, round(mrr, 6) AS mrr FROM ev")
def eva2_recall_mrr(spark: SparkSession, d: str) -> DataFrame:
    r = F.col("first_rank")
    return ranked(spark, d).select("query_id", E.recall(r).alias("recall_at_5"), F.round(E.reciprocal(r), 6).alias("mrr"))


_KEYS = "['the', 'and', 'Una', left(text, 4)]"
_RATE = f"CASE WHEN role = 'assistant' THEN len(list_filter({_KEYS}, lambda k: contains(lower(text), lower(k)))) / len({_KEYS})::DOUBLE END"


def _rate():
    answer = F.when(F.col("role") == "assistant", F.col("text"))
    return E.keyword_rate(answer, F.array(F.lit("the"), F.lit("and"), F.lit("Una"), F.left("text", F.lit(4))))


@query(f"SELECT conv_id, turn, round({_RATE}, 6) AS keyword_rate FROM conversations")
def eva3_keyword_rate(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "conversations").select("conv_id", "turn", F.round(_rate(), 6).alias("keyword_rate"))


@query("SELECT item_id AS question_id, CASE WHEN item_id % 3 > 0 THEN CASE WHEN contains(lower(d.text), lower(left(b.text, 3))) THEN 0.5 ELSE 0 END + CASE WHEN contains(lower(d.text), 'the') THEN 0.5 ELSE 0 END END::DOUBLE AS keyword_rate FROM benchmark b LEFT JOIN documents d ON d.doc_id = item_id")
def eva3_answers_table(spark: SparkSession, d: str) -> DataFrame:
    """Answers from a table of their own; every third question has none."""
    asked = read(spark, d, "benchmark").select(F.col("item_id").alias("question_id"), F.array(F.left("text", F.lit(3)), F.lit("the")).alias("keywords"))
    answers = read(spark, d, "documents").where("doc_id % 3 > 0").select(F.col("doc_id").alias("question_id"), F.col("text").alias("answer"))
    return E.answered_keyword_rate(answers, asked)


@query(f"SELECT count(*) AS n, round(avg(CASE WHEN quality = 1 THEN 1.0 ELSE 0.0 END), 4) AS recall_at_5, round(avg(CASE WHEN quality = 1 THEN 1.0::DOUBLE / (1 + doc_id % 5) ELSE 0 END), 4) AS mrr, round(avg(CASE WHEN doc_id % 2 = 0 THEN (doc_id % 5) / 4.0::DOUBLE END), 4) AS keyword_rate FROM labels")
def eva4_eval_summary(spark: SparkSession, d: str) -> DataFrame:
    rank = F.when(F.col("quality") == 1, 1 + F.col("doc_id") % 5)
    items = read(spark, d, "labels").select(E.recall(rank).alias("recall_at_5"), E.reciprocal(rank).alias("mrr"), F.when(F.col("doc_id") % 2 == 0, F.col("doc_id") % 5 / 4).alias("keyword_rate"))
    return E.eval_summary(items)


def _collections(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "nation").select(F.concat(F.lit("src"), F.col("n_nationkey").cast("string")).alias("collection"), F.col("n_name").alias("model"))


@query("SELECT 'src' || CAST(n_nationkey AS VARCHAR) AS collection, n_name AS model, count(doc_id) FILTER (WHERE doc_id % 3 > 0) AS documents, CAST(coalesce(sum(len(string_split(text, chr(10)))), 0) AS BIGINT) AS chunks FROM nation LEFT JOIN documents ON source = 'src' || CAST(n_nationkey AS VARCHAR) GROUP BY ALL")
def rep1_collection_stats(spark: SparkSession, d: str) -> DataFrame:
    docs = state(spark, d).withColumn("status", F.when(F.col("doc_id") % 3 > 0, "indexed").otherwise("failed"))
    return E.collection_stats(_collections(spark, d), docs, index(spark, d))


@query("SELECT 'src' || CAST(n_nationkey AS VARCHAR) AS collection, row_number() OVER (ORDER BY 'src' || CAST(n_nationkey AS VARCHAR))::INTEGER AS position FROM nation")
def rep2_list_collections(spark: SparkSession, d: str) -> DataFrame:
    return E.list_collections(_collections(spark, d)).select("collection", F.col("position").cast("int").alias("position"))


@query("SELECT source AS collection, doc_id, row_number() OVER (PARTITION BY source ORDER BY lang || '/' || CAST(doc_id AS VARCHAR))::INTEGER AS position FROM documents")
def rep3_list_documents(spark: SparkSession, d: str) -> DataFrame:
    docs = read(spark, d, "documents").select(F.col("source").alias("collection"), "doc_id", F.concat("lang", F.lit("/"), F.col("doc_id").cast("string")).alias("name"))
    return E.list_documents(docs, "name").select("collection", "doc_id", F.col("position").cast("int").alias("position"))


_JOBS = "jb AS (SELECT event_id AS job_id, event_type AS collection, CASE user_id % 4 WHEN 0 THEN 'succeeded' WHEN 1 THEN 'failed' WHEN 2 THEN 'running' ELSE 'pending' END AS status FROM events)"


def jobs(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("user_id") % 4
    return read(spark, d, "events").select(F.col("event_id").alias("job_id"), F.col("event_type").alias("collection"), F.when(k == 0, "succeeded").when(k == 1, "failed").when(k == 2, "running").otherwise("pending").alias("status"))


@query(f"WITH {_JOBS} SELECT * FROM jb QUALIFY row_number() OVER (PARTITION BY collection ORDER BY job_id DESC) <= 50")
def rep4_recent_jobs(spark: SparkSession, d: str) -> DataFrame:
    return E.recent_jobs(jobs(spark, d))


@query("SELECT lang AS doc_type, CASE WHEN length(t) > 58 THEN left(t, 55) || '...' ELSE t END AS title, len(string_split(text, chr(10)))::BIGINT AS n_chunks FROM (SELECT lang, text, text AS t FROM documents)")
def rep5_doc_type_listing(spark: SparkSession, d: str) -> DataFrame:
    docs = read(spark, d, "documents").select("doc_id", F.col("lang").alias("doc_type"), F.col("text").alias("title"))
    return E.doc_type_listing(docs, index(spark, d))


@query("SELECT chunk AS chunk_id, count(*) FILTER (WHERE user_id % 3 = 0) AS up, count(*) FILTER (WHERE user_id % 3 = 1) AS down FROM (SELECT user_id, unnest([user_id % 10, user_id % 7 + 20]) AS c FROM events WHERE user_id % 3 < 2), LATERAL (SELECT 'c' || CAST(c AS VARCHAR) AS chunk) GROUP BY chunk")
def rep6_feedback_votes(spark: SparkSession, d: str) -> DataFrame:
    k, n = F.col("user_id") % 3, lambda x: F.concat(F.lit("c"), x.cast("string"))
    rows = read(spark, d, "events").select(F.when(k == 0, "up").when(k == 1, "down").otherwise("so so").alias("rating"), F.col("props").alias("excerpt"), F.concat_ws(",", n(F.col("user_id") % 10), n(F.col("user_id") % 7 + 20)).alias("chunk_ids"))
    return E.chunk_votes(rows)


def calls(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "events").select("event_id", F.col("event_type").alias("model"), F.col("ts").cast("timestamp").alias("ts"), "user_id")


@query(
    "SELECT event_type AS model, count(*) FILTER (WHERE ts <= TIMESTAMP '2024-01-15 12:00:00' AND ts >= TIMESTAMP '2024-01-15 11:59:00') AS last_minute, "
    "count(*) FILTER (WHERE ts <= TIMESTAMP '2024-01-15 12:00:00' AND ts >= TIMESTAMP '2024-01-15 08:00:00') AS today, 72000::BIGINT AS seconds_to_reset FROM events GROUP BY 1"
)
def rep7_quota_stats(spark: SparkSession, d: str) -> DataFrame:
    return E.quota_stats(calls(spark, d), F.lit("2024-01-15 12:00:00").cast("timestamp"))


@query("SELECT doc_id, CASE WHEN length(s) > 70 THEN '...' || right(s, 67) ELSE s END AS source FROM (SELECT doc_id, text AS s FROM documents)")
def rep8_shorten_source(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "documents").select("doc_id", X.shorten_source(F.col("text")).alias("source"))


@query(f"WITH {_JOBS} SELECT collection, count(*) AS active FROM jb WHERE status IN ('running', 'pending') GROUP BY collection")
def rep9_active_jobs(spark: SparkSession, d: str) -> DataFrame:
    return E.active_jobs(jobs(spark, d))
