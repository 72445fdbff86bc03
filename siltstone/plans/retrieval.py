"""Queries of retrieval: benchmark texts, and vectors whose id is divisible by 20, are the questions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.functions import text as X
from siltstone.operators import index as N
from siltstone.operators import retrieve as R
from siltstone.operators.blocks import blocks_topk, build_blocks
from siltstone.operators.cells import build_cells, cells_topk
from siltstone.operators.tables import written
from siltstone.plans.base import MARKDOWN_SQL, markdown, read, scratch
from siltstone.plans.chunks import BM25_SQL, TOKENS_SQL, bm25_index

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return put


def questions(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), "text")


def lexical(spark: SparkSession, d: str, k: int = 20) -> DataFrame:
    hits = R.bm25_topk(questions(spark, d), bm25_index(spark, d), k * 2)
    return R.top_k(hits.drop("rank").withColumn("score", F.round("score", 6)), k, "chunk_id")


def collections(spark: SparkSession, d: str) -> DataFrame:
    """The collections of the vectors, by label, with their settings."""
    label = F.col("label")
    return read(spark, d, "embeddings").select(label.alias("collection"), (3 + label % 5).alias("top_k"), (label % 2 == 0).alias("supports_sparse")).distinct()


def vectors(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Every vector whose id is divisible by 20 as a question, and all vectors, by collection."""
    e = read(spark, d, "embeddings").select("vec_id", F.col("label").alias("collection"), F.transform("embedding", lambda x: x.cast("double")).alias("dense"))
    return e.where("vec_id % 20 = 0").withColumnRenamed("vec_id", "query_id"), e.withColumnRenamed("vec_id", "chunk_id")


def dense(spark: SparkSession, d: str, k: int = 10) -> DataFrame:
    hits = R.dense_topk(*vectors(spark, d), k * 2, ("collection",))
    return R.top_k(hits.drop("rank").withColumn("score", F.round("score", 6)), k, "chunk_id")


def sparse(spark: SparkSession, d: str, k: int = 10) -> DataFrame:
    e = read(spark, d, "embeddings")
    weights = e.select(F.col("vec_id").alias("chunk_id"), F.map_from_arrays(F.sequence(F.lit(1), F.size("embedding")), "embedding").alias("weights"))
    rows = N.to_sparse(weights).join(e.select(F.col("vec_id").alias("chunk_id"), F.col("label").alias("collection")), "chunk_id")
    return R.sparse_topk(rows.where("chunk_id % 20 = 0").withColumnRenamed("chunk_id", "query_id"), rows, k, ("collection",), 6)


LEX_SQL = (
    BM25_SQL
    + f", q AS (SELECT query_id, tok, count(*) AS times FROM (SELECT item_id AS query_id, unnest({TOKENS_SQL}) AS tok FROM benchmark) GROUP BY ALL), "
    "z AS (SELECT query_id, chunk_id, round(sum(weight * times), 6) AS score FROM q JOIN g USING (tok) GROUP BY ALL HAVING sum(weight * times) > 0), "
    "lex AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM z QUALIFY rank <= 20) "
)
DENSE_SQL = (
    "dx AS (SELECT a.vec_id AS query_id, b.vec_id AS chunk_id, a.label AS collection, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS score FROM embeddings a JOIN embeddings b USING (label) WHERE a.vec_id % 20 = 0), "
    "den AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM dx QUALIFY rank <= 10) "
)
SPARSE_SQL = (
    "sv AS (SELECT vec_id, label, unnest(embedding) AS w, generate_subscripts(embedding, 1) AS tok FROM embeddings), "
    "sx AS (SELECT a.vec_id AS query_id, b.vec_id AS chunk_id, a.label AS collection, round(sum(a.w::DOUBLE * b.w::DOUBLE), 6) AS score FROM sv a JOIN sv b USING (tok, label) WHERE a.w > 0 AND b.w > 0 AND a.vec_id % 20 = 0 GROUP BY ALL), "
    "spa AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM sx QUALIFY rank <= 10) "
)
FUSE_SQL = (
    "fu AS (SELECT query_id, chunk_id, sum(1.0::DOUBLE / (60 + rank)) AS score, min({'list': list, 'rank': rank}) AS first FROM (SELECT query_id, chunk_id, rank, 0 AS list FROM den UNION ALL SELECT query_id, chunk_id, rank, 1 FROM spa) GROUP BY ALL), "
    "fus AS (SELECT query_id, chunk_id, round(score, 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 12) DESC, first) AS rank FROM fu) "
)
_COLS = "SELECT query_id, chunk_id, score, CAST(rank AS INTEGER) AS rank FROM "


@query(f"WITH {DENSE_SQL} {_COLS} den")
def ret1_dense_topk(spark: SparkSession, d: str) -> DataFrame:
    return dense(spark, d)


@query()
def ret2_dense_topk_ann(spark: SparkSession, d: str) -> DataFrame:
    """By cells, with the vectors that each question read (read) of those of its collection (held)."""
    asked, every = vectors(spark, d)
    return cells_topk(asked, build_cells(every, scratch(spark, "cells"), ("collection",)), 10)


@query(f"WITH {DENSE_SQL}, n AS (SELECT count(*) AS n, count(*) FILTER (WHERE vec_id % 20 = 0) AS asked FROM embeddings), per AS (SELECT label, count(*) AS held, count(*) FILTER (WHERE vec_id % 20 = 0) AS asked FROM embeddings GROUP BY label) SELECT (SELECT count(*) FROM den) AS wanted, true AS recall_fits, true AS share_fits, (SELECT n FROM n) AS vectors, CAST((SELECT sum(held * asked) FROM per) AS BIGINT) AS exact_pairs")
def ret2_ann_quality(spark: SparkSession, d: str) -> DataFrame:
    """The index against the exact search: whether recall at 10 is 0.9 or more with less than 10 per cent of all vectors read for a question."""
    asked, every = vectors(spark, d)
    hits = written(ret2_dense_topk_ann(spark, d), "ann")
    exact = dense(spark, d).select("query_id", "chunk_id", F.lit(True).alias("right"))
    found = exact.join(hits.select("query_id", "chunk_id", F.lit(True).alias("found")), ["query_id", "chunk_id"], "left").agg(F.count("*").alias("wanted"), F.count("found").alias("met"))
    read = hits.select("query_id", "read", "held").distinct().agg(F.avg("read").alias("read"), F.sum("held").alias("exact_pairs"))
    n = every.agg(F.count("*").alias("vectors"))
    one = found.crossJoin(read).crossJoin(n)  # one row each
    return one.select("wanted", (F.col("met") >= 0.9 * F.col("wanted")).alias("recall_fits"), (F.col("read") < 0.1 * F.col("vectors")).alias("share_fits"), "vectors", "exact_pairs")


@query(f"WITH {SPARSE_SQL} {_COLS} spa")
def ret3_sparse_topk(spark: SparkSession, d: str) -> DataFrame:
    return sparse(spark, d)


@query(f"WITH {LEX_SQL} {_COLS} lex")
def ret4_bm25_topk(spark: SparkSession, d: str) -> DataFrame:
    return lexical(spark, d)


@query(f"WITH {LEX_SQL}, sz AS (SELECT query_id, CAST(sum(df) AS BIGINT) AS postings FROM (SELECT DISTINCT query_id, tok FROM q) JOIN i USING (tok) GROUP BY query_id) SELECT query_id, chunk_id, score, CAST(rank AS INTEGER) AS rank, postings FROM lex JOIN sz USING (query_id)")
def ret4_bm25_blocks(spark: SparkSession, d: str) -> DataFrame:
    """The same hits from blocks of postings, with the number of postings that a search without them would read."""
    held = build_blocks(bm25_index(spark, d), scratch(spark, "blocks"))
    hits = blocks_topk(questions(spark, d), held, 40).withColumn("score", F.round("score", 6)).drop("rank")
    return R.top_k(hits, 20, "chunk_id").select("query_id", "chunk_id", "score", "rank", "postings")


@query(f"WITH {DENSE_SQL}, {SPARSE_SQL}, {FUSE_SQL} {_COLS} fus")
def ret5_rrf_fuse(spark: SparkSession, d: str) -> DataFrame:
    return R.rrf_fuse([dense(spark, d), sparse(spark, d)]).withColumn("score", F.round("score", 6))


@query(
    f"WITH {DENSE_SQL}, {SPARSE_SQL}, {FUSE_SQL}, hy AS ({_COLS} fus WHERE rank <= 10 AND query_id IN (SELECT query_id FROM spa) UNION ALL {_COLS} den WHERE query_id NOT IN (SELECT query_id FROM spa)) "
    "SELECT hy.*, den.score AS dense_score, spa.score AS sparse_score FROM hy LEFT JOIN den USING (query_id, chunk_id) LEFT JOIN spa USING (query_id, chunk_id)"
)
def ret6_hybrid_search(spark: SparkSession, d: str) -> DataFrame:
    return R.hybrid_search(dense(spark, d), sparse(spark, d), 10).withColumn("score", F.round("score", 6))


_MULTI = (
    "mq AS (SELECT collection + 10 * (query_id // 400) AS query_id, query_id AS sub, 0 AS list, chunk_id, rank FROM den UNION ALL SELECT collection + 10 * (query_id // 400), query_id, 1, chunk_id, rank FROM spa), "
    "m1 AS (SELECT query_id, sub, chunk_id, sum(1.0::DOUBLE / (60 + rank)) AS score, min({'list': list, 'rank': rank}) AS first FROM mq GROUP BY ALL), "
    "m2 AS (SELECT query_id, sub, chunk_id, row_number() OVER (PARTITION BY query_id, sub ORDER BY round(score, 12) DESC, first) AS rank FROM m1), "
    "m3 AS (SELECT query_id, chunk_id, sum(1.0::DOUBLE / (60 + rank)) AS score, min({'list': sub, 'rank': rank}) AS first FROM m2 GROUP BY ALL) "
)


@query(f"WITH {DENSE_SQL}, {SPARSE_SQL}, {_MULTI} SELECT query_id, chunk_id, round(score, 6) AS score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY round(score, 12) DESC, first) AS INTEGER) AS rank FROM m3")
def ret7_multi_query_search(spark: SparkSession, d: str) -> DataFrame:
    """The questions of a collection in twenties, each twenty as the sub-queries of one."""
    of = vectors(spark, d)[0].select("query_id", "collection")
    lists = [x.join(of, "query_id").select((F.col("collection") + 10 * F.floor(F.col("query_id") / 400)).alias("query_id"), F.col("query_id").alias("sub"), F.lit(i).alias("list"), "chunk_id", "rank") for i, x in enumerate((dense(spark, d), sparse(spark, d)))]
    return R.multi_query_search(lists[0].unionByName(lists[1])).withColumn("score", F.round("score", 6))


@query(f"WITH {LEX_SQL} SELECT query_id, chunk_id, CAST(rank AS INTEGER) AS rank, source, text FROM lex JOIN documents ON doc_id = chunk_id WHERE chunk_id % 2 = 0")
def ret8_backfill_payload(spark: SparkSession, d: str) -> DataFrame:
    index = read(spark, d, "documents").where("doc_id % 2 = 0").select(F.col("doc_id").alias("chunk_id"), "source", "text")
    return R.backfill_payload(lexical(spark, d), index).select("query_id", "chunk_id", "rank", "source", "text")


@query(
    f"WITH {LEX_SQL}, dv AS (SELECT query_id, chunk_id, rank, chunk_id % 4 AS doc, row_number() OVER (PARTITION BY query_id, chunk_id % 4 ORDER BY rank) AS r, min(rank) OVER (PARTITION BY query_id, chunk_id % 4) AS pos FROM lex) "
    "SELECT query_id, chunk_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY r > 4, r, pos) AS INTEGER) AS place FROM dv"
)
def ret9_diversify(spark: SparkSession, d: str) -> DataFrame:
    return R.diversify(lexical(spark, d).withColumn("doc_id", F.col("chunk_id") % 4)).select("query_id", "chunk_id", "place")


_SCORE = "CAST((query_id * 31 + chunk_id * 17) % 11 AS DOUBLE)"


def _scores(hits: DataFrame) -> DataFrame:
    return hits.select("query_id", "chunk_id", F.pmod(F.col("query_id") * 31 + F.col("chunk_id") * 17, F.lit(11)).cast("double").alias("rerank_score"))


@query(f"WITH {LEX_SQL}, rr AS (SELECT query_id, chunk_id, rank, score, {_SCORE} AS s, count(*) OVER (PARTITION BY query_id) AS n FROM lex), o AS (SELECT query_id, chunk_id, CASE WHEN n > 5 THEN s ELSE score END AS score, row_number() OVER (PARTITION BY query_id ORDER BY CASE WHEN n > 5 THEN -s END, rank) AS rank FROM rr) {_COLS} o WHERE rank <= 5")
def ret10_rerank(spark: SparkSession, d: str) -> DataFrame:
    hits = lexical(spark, d)
    return R.rerank(hits, _scores(hits), 5).select("query_id", "chunk_id", "score", "rank")


@query(f"WITH {LEX_SQL}, rr AS (SELECT query_id, chunk_id, rank, score, {_SCORE} AS s, count(*) OVER (PARTITION BY query_id) > 5 AND bool_and(query_id % 2 = 0 OR chunk_id % 7 > 0) OVER (PARTITION BY query_id) AS a FROM lex), o AS (SELECT query_id, chunk_id, CASE WHEN a THEN s ELSE score END AS score, row_number() OVER (PARTITION BY query_id ORDER BY CASE WHEN a THEN -s END, rank) AS rank FROM rr) {_COLS} o WHERE rank <= 5")
def ret11_rerank_fallback(spark: SparkSession, d: str) -> DataFrame:
    hits = lexical(spark, d)
    return R.rerank(hits, _scores(hits).where("query_id % 2 = 0 or chunk_id % 7 > 0"), 5).select("query_id", "chunk_id", "score", "rank")


@query(f"WITH {LEX_SQL} SELECT query_id, chunk_id, round(0.8::DOUBLE * CASE WHEN chunk_id % 5 = 0 THEN 0 ELSE {_SCORE} END / 10 + 0.2::DOUBLE * least(10 * 1.0::DOUBLE / (60 + rank), 1), 6) AS score FROM lex")
def ret12_blend_scores(spark: SparkSession, d: str) -> DataFrame:
    hits = lexical(spark, d).drop("score")
    both = hits.join(_scores(hits).where("chunk_id % 5 > 0"), ["query_id", "chunk_id"], "left")
    return both.select("query_id", "chunk_id", F.round(X.blend_scores(F.col("rerank_score"), 1 / (60 + F.col("rank"))), 6).alias("score"))


#: Replies as models give them, by item_id % 8, and what each must give; N stands for item_id % 13, T for the item's text.
_REPLIES = (
    ('```json\n[{"id": 0, "score": 3}, {"id": 1, "score": -4}, {"id": 9, "score": 1}, {"id": "x", "score": 2}, {"id": 0, "score": N}]\n```', "[(0, least(10, n)), (1, 0)]"),
    ('Scores: [{"id": 0, "score": N, "tags": ["a", "b"]}, {"id": 1, "score": 7}] done', "[(0, least(10, n)), (1, 7)]"),
    ("no scores for T", "[]"),
    ('[{"id": 1}, {"id": "0", "score": "8"}, {"score": 5}, 4, [1], null]', "[(0, 8), (1, 0)]"),
    ('Here ```json [{"id": 0, "score": 7.9}, {"id": 1, "score": "7.5"}]``` it is', "[(0, 7)]"),
    ('{"id": 0, "score": N}', "[]"),
    ('[{"id": 0, "score": N}] or [{"id": 1, "score": 2}]', "[]"),
    ('[{"id": 1, "score": null}, {"id": 0, "score": true, "why": "it says \\"[x]\\" N"}]', "[(0, 1)]"),
)
_N = "CAST(item_id % 13 AS INTEGER)"
_WANT = " ".join(f"WHEN {k} THEN [{', '.join('{' + chr(39) + 'id' + chr(39) + ': ' + x.split(', ', 1)[0] + ', ' + chr(39) + 'score' + chr(39) + ': CAST(' + x.split(', ', 1)[1].replace('least(10, n)', f'least(10, {_N})') + ' AS INTEGER)}' for x in want[2:-2].split('), ('))}]" for k, (_, want) in enumerate(_REPLIES) if want != "[]")


@query(f"SELECT item_id, x.id AS id, x.score AS score FROM (SELECT item_id, unnest(CASE item_id % 8 {_WANT} ELSE [] END) AS x FROM benchmark)")
def ret13_parse_rerank_reply(spark: SparkSession, d: str) -> DataFrame:
    reply = F.lit("")
    for k, (text, _) in enumerate(_REPLIES):
        own = F.replace(F.replace(F.lit(text), F.lit("N"), (F.col("item_id") % 13).cast("string")), F.lit("T"), F.col("text"))
        reply = F.when(F.col("item_id") % 8 == k, own).otherwise(reply)
    return read(spark, d, "benchmark").select("item_id", F.explode(X.parse_rerank_reply(reply, F.lit(2))).alias("id", "score"))


_LINES = "string_split(chr(10) || '1. ' || text || chr(10) || '2024-2025 ' || text || chr(10) || ' - \" spaced ' || item_id || ' \" ' || chr(10) || '12 x' || chr(10) || '* last ' || text, chr(10))"


@query(
    "SELECT item_id, text || '|' || array_to_string(list_filter(list_transform("
    + _LINES
    + ", lambda x: trim(regexp_replace(trim(x), '^[0-9.*)-]+\\s*', ''), ' \"' || chr(39))), lambda x: length(x) >= 3)[1:3], '|') AS queries FROM benchmark"
)
def ret14_parse_expansions(spark: SparkSession, d: str) -> DataFrame:
    text, item = F.col("text"), F.col("item_id").cast("string")
    reply = F.concat(F.lit("\n1. "), text, F.lit("\n2024-2025 "), text, F.lit('\n - " spaced '), item, F.lit(' " \n12 x\n* last '), text)
    return read(spark, d, "benchmark").select("item_id", F.array_join(X.parse_expansions(text, reply), "|").alias("queries"))


@query(f"WITH {DENSE_SQL} {_COLS} den WHERE rank <= 3 + collection % 5")
def ret15_top_k(spark: SparkSession, d: str) -> DataFrame:
    asked = vectors(spark, d)[0].select("query_id", "collection").join(F.broadcast(collections(spark, d)), "collection")  # one row a collection
    hits = dense(spark, d).drop("rank").join(asked.select("query_id", "top_k"), "query_id")
    return R.top_k_column(hits, "top_k", 10, "chunk_id").select("query_id", "chunk_id", "score", "rank")


def sourced(spark: SparkSession, d: str) -> DataFrame:
    index = read(spark, d, "documents").select(F.col("doc_id").alias("chunk_id"), markdown().alias("text"), F.when(F.col("doc_id") % 4 > 0, F.col("source")).alias("source_name"), F.when(F.col("doc_id") % 3 > 0, F.col("lang")).otherwise("").alias("page_or_section"))
    return R.backfill_payload(lexical(spark, d, 5), index)


_SOURCED = LEX_SQL.replace("rank <= 20", "rank <= 5") + f", so AS (SELECT query_id, rank, score, chunk_id, {MARKDOWN_SQL} AS text, doc_id, CASE WHEN doc_id % 4 > 0 THEN source ELSE '?' END AS source_name, CASE WHEN doc_id % 3 > 0 THEN ' — ' || lang ELSE '' END AS section FROM lex JOIN documents ON doc_id = chunk_id) "


@query(f"WITH {_SOURCED} SELECT query_id, CAST(rank AS INTEGER) AS n, chunk_id, round(score, 4) AS score, left(text, 300) AS excerpt, CASE WHEN doc_id % 3 = 0 THEN 'rag-image://c/doc_' || CAST(doc_id AS VARCHAR) || '/x.png' ELSE '' END AS images FROM so")
def ret16_sources(spark: SparkSession, d: str) -> DataFrame:
    return R.sources(sourced(spark, d)).withColumn("images", F.array_join("images", "|"))


_CONTEXT = f"WITH {_SOURCED}, cx AS (SELECT query_id, string_agg('[' || CAST(rank AS VARCHAR) || '] (source : ' || source_name || section || ')' || chr(10) || text, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY rank) AS context FROM so GROUP BY query_id) "


@query(_CONTEXT + "SELECT query_id, md5(context) AS context FROM cx")
def ret17_build_context(spark: SparkSession, d: str) -> DataFrame:
    return R.build_context(sourced(spark, d)).select("query_id", F.md5("context").alias("context"))


@query(_CONTEXT + "SELECT query_id, md5('Context:' || chr(10) || chr(10) || context || chr(10) || chr(10) || '---' || chr(10) || chr(10) || 'Question: ' || text) AS prompt FROM cx JOIN benchmark ON item_id = query_id")
def ret18_build_prompt(spark: SparkSession, d: str) -> DataFrame:
    both = R.build_context(sourced(spark, d)).join(questions(spark, d), "query_id")
    return both.select("query_id", F.md5(R.build_prompt(F.col("text"), F.col("context"))).alias("prompt"))


@query(
    _CONTEXT.split(", cx AS")[0] + " SELECT query_id, md5(string_agg('[Source ' || rank || '] (' || CASE WHEN doc_id % 5 > 0 THEN d.lang ELSE 'document' END || ') ' || CASE doc_id % 3 WHEN 0 THEN d.source WHEN 1 THEN 'file' || doc_id ELSE 'document' END "
    "|| CASE WHEN doc_id % 2 = 0 THEN ' — https://ex.com/' || doc_id ELSE '' END || chr(10) || so.text, chr(10) ORDER BY rank)) AS context FROM so JOIN documents d USING (doc_id) GROUP BY query_id"
)
def ret18_titled_context(spark: SparkSession, d: str) -> DataFrame:
    """Blocks headed by type, title and source of the metadata, whose keys are missing or empty in turn."""
    docs, n = read(spark, d, "documents"), F.col("doc_id")
    values = {"doc_type": F.when(n % 5 > 0, F.col("lang")), "doc_title": F.when(n % 3 == 0, F.col("source")).otherwise(""), "filename": F.when(n % 3 == 1, F.concat(F.lit("file"), n.cast("string"))), "url": F.when(n % 2 == 0, F.concat(F.lit("https://ex.com/"), n.cast("string")))}
    meta = docs.select(n.alias("chunk_id"), F.create_map(*[x for k, v in values.items() for x in (F.lit(k), v)]).alias("metadata"), markdown().alias("text"))
    hits = R.backfill_payload(lexical(spark, d, 5), meta).select("query_id", "rank", R.titled_block(F.col("rank"), F.col("metadata"), F.col("text")).alias("b"))
    blocks = F.array_sort(F.collect_list(F.struct("rank", "b")))
    return hits.groupBy("query_id").agg(F.md5(F.array_join(blocks["b"], "\n")).alias("context"))


@query(f"WITH {LEX_SQL} SELECT query_id, chunk_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, 4 - rank) AS INTEGER) AS rank, score FROM lex WHERE rank <= 3")
def ret10_rerank_few(spark: SparkSession, d: str) -> DataFrame:
    """Three hits at most, given in reverse: too few to rerank, sorted by their scores."""
    hits = lexical(spark, d, 3).withColumn("rank", 4 - F.col("rank"))
    return R.rerank(hits, hits.select("query_id", "chunk_id", F.lit(0.0).alias("rerank_score")), 5, sort_few=True)


@query(f"WITH {DENSE_SQL}, {SPARSE_SQL}, {FUSE_SQL}, su AS (SELECT vec_id FROM embeddings WHERE label % 2 = 0) {_COLS} fus WHERE rank <= 10 AND query_id IN (FROM su) UNION ALL {_COLS} den WHERE query_id NOT IN (FROM su)")
def ret19_dense_only(spark: SparkSession, d: str) -> DataFrame:
    """Questions of a collection without a sparse side take the dense ranking."""
    supports = vectors(spark, d)[0].select("query_id", "collection").join(F.broadcast(collections(spark, d).where("supports_sparse")), "collection")  # one row a collection
    return R.hybrid_search(dense(spark, d), sparse(spark, d).join(supports.select("query_id"), "query_id", "left_semi"), 10).select("query_id", "chunk_id", F.round("score", 6).alias("score"), "rank")


@query(f"WITH {DENSE_SQL.split(', den AS')[0].replace('a.vec_id % 20 = 0', 'a.vec_id % 20 = 0 AND b.vec_id % 3 > 0')}, den AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM dx QUALIFY rank <= 10) {_COLS} den")
def ret20_drop_deleted(spark: SparkSession, d: str) -> DataFrame:
    asked, index = vectors(spark, d)
    live = R.drop_deleted(index.withColumn("doc_id", F.col("chunk_id")), index.where("chunk_id % 3 = 0").select(F.col("chunk_id").alias("doc_id")))
    hits = R.dense_topk(asked, live.drop("doc_id"), 20, ("collection",))
    return R.top_k(hits.drop("rank").withColumn("score", F.round("score", 6)), 10, "chunk_id")


def _shared_words(pairs: list[tuple[str, str]]) -> list[float]:
    """The share of the question's distinct words that the text holds."""
    words = [(set(q.split(" ")), set(t.split(" "))) for q, t in pairs]
    return [len(q & t) / len(q) for q, t in words]


@query(
    f"WITH {LEX_SQL}, pw AS (SELECT query_id, chunk_id, score, rank, list_distinct(string_split(b.text, ' ')) AS q, string_split(d.text, ' ') AS t FROM lex JOIN benchmark b ON item_id = query_id JOIN documents d ON d.doc_id = chunk_id), "
    "ps AS (SELECT *, len(list_intersect(q, t)) / len(q) AS s, count(*) OVER (PARTITION BY query_id) > 5 AS a FROM pw), "
    f"o AS (SELECT query_id, chunk_id, round(CASE WHEN a THEN s ELSE score END, 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY CASE WHEN a THEN -s END, rank) AS rank FROM ps) {_COLS} o WHERE rank <= 5"
)
def udf3_rerank_by_scorer(spark: SparkSession, d: str) -> DataFrame:
    """Hits reranked by a scorer of (question, text) pairs that runs on the workers."""
    hits = lexical(spark, d)
    texts = read(spark, d, "documents").select(F.col("doc_id").alias("chunk_id"), "text")
    pairs = hits.join(questions(spark, d).withColumnRenamed("text", "question"), "query_id").join(texts, "chunk_id")
    out = R.rerank(hits, R.score_pairs(pairs, _shared_words), 5)
    return out.select("query_id", "chunk_id", F.round("score", 6).alias("score"), "rank")
