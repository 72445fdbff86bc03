"""Queries of chunking and of index building over documents and embeddings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.functions import text as X
from siltstone.operators import chunk as C
from siltstone.operators import index as N
from siltstone.operators.tables import listing
from siltstone.plans.base import MARKDOWN_SQL, exists, flat, markdown, read, scratch

QUERIES, SQL = {}, {}
SMALL = 600


def query(sql: str | None = None):
    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return put


def titled(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "documents").select("doc_id", F.col("source").alias("title"), markdown().alias("markdown"))


_TRIM = "regexp_replace({}, '^\\s+|\\s+$', '', 'g')"
_SECTIONS = (
    f"WITH m AS (SELECT doc_id, string_split({MARKDOWN_SQL}, chr(10)) AS l FROM documents), "
    "r AS (SELECT doc_id, unnest(l) AS line, generate_subscripts(l, 1) AS ln FROM m), "
    "h AS (SELECT *, length(regexp_extract(line, '^(#{1,6})\\s+(.+?)\\s*$', 1)) AS level, regexp_extract(line, '^(#{1,6})\\s+(.+?)\\s*$', 2) AS title FROM r), "
    "w AS (SELECT *, sum(CASE WHEN level > 0 THEN 1 ELSE 0 END) OVER q AS sec, " + ", ".join(f"max(CASE WHEN level = {k} THEN {{'ln': ln, 'title': title}} END) OVER q AS h{k}" for k in (1, 2, 3)) + " FROM h WINDOW q AS (PARTITION BY doc_id ORDER BY ln)), "
    "p AS (SELECT *, array_to_string([x FOR x IN [h1.title, CASE WHEN h2.ln > coalesce(h1.ln, -1) THEN h2.title END, CASE WHEN h3.ln > greatest(coalesce(h1.ln, -1), coalesce(h2.ln, -1)) THEN h3.title END] IF x IS NOT NULL], ' > ') AS path FROM w), "
    f"s AS (SELECT doc_id, CAST(sec AS BIGINT) AS sec, max_by(path, ln) AS path, {_TRIM.format('string_agg(line, chr(10) ORDER BY ln) FILTER (WHERE level = 0)')} AS body FROM p GROUP BY doc_id, sec) "
)


@query(_SECTIONS + "SELECT doc_id, sec, path, md5(body) AS body FROM s WHERE body <> ''")
def chk1_split_sections(spark: SparkSession, d: str) -> DataFrame:
    return C.split_sections(titled(spark, d)).select("doc_id", "sec", F.array_join("heading_path", " > ").alias("path"), F.md5("body").alias("body"))


def _blank(x: str) -> str:
    return f"{_TRIM.format(x)} = ''"


def pieces_sql(target: int, overlap: int) -> str:
    """CTEs from b (id, body) to pieces (id, pos, piece). Each fold is a recursion that emits what is done at a step and keeps the open piece only."""
    url = r"""(?s)^(.*?)(https?://[^\s)\]"''<>]+)$"""
    image = f"(?s)^(.*?)\\]\\({X.IMAGE_SCHEME}://[^)]+\\)"
    own = "CASE WHEN cur <> '' THEN [" + _TRIM.format("cur") + "] ELSE [] END"
    return (
        "para AS MATERIALIZED (SELECT id, p, row_number() OVER (PARTITION BY id ORDER BY j) AS i FROM (SELECT id, j, " + _TRIM.format("x") + r" AS p FROM (SELECT id, unnest(l) AS x, generate_subscripts(l, 1) AS j FROM "
        f"(SELECT id, string_split_regex(body, '\\n\\s*\\n') AS l FROM b WHERE length(body) > {target}))) WHERE p <> ''), "
        "sent AS MATERIALIZED (SELECT id, i, unnest(l) AS s, generate_subscripts(l, 1) AS j FROM (SELECT id, i, string_split(regexp_replace(p, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)) AS l FROM para "
        f"WHERE length(p) > {target})), "
        "hard AS (SELECT DISTINCT id, i, CAST(0 AS BIGINT) AS j, '' AS cur, CAST([] AS VARCHAR[]) AS out FROM sent UNION ALL "
        f"SELECT id, i, j, CASE WHEN length(longer) <= {target} THEN longer WHEN length(s) > {target} THEN '' ELSE s END, CASE WHEN length(longer) <= {target} THEN [] "
        f"WHEN length(s) > {target} THEN list_concat({own}, list_transform(range(0, length(s), {target - overlap}), lambda x: substr(s, x + 1, {target}))) ELSE {own} END "
        "FROM (SELECT sent.*, cur, CASE WHEN cur <> '' THEN cur || ' ' ELSE '' END || s AS longer FROM hard JOIN sent ON sent.id = hard.id AND sent.i = hard.i AND sent.j = hard.j + 1)), "
        "cut AS MATERIALIZED (SELECT id, i, list(x ORDER BY j, k) AS slices FROM (SELECT id, i, j, unnest(out) AS x, generate_subscripts(out, 1) AS k FROM hard "
        f"UNION ALL SELECT id, i, j + 1, {_TRIM.format('cur')}, 1 FROM (SELECT *, max(j) OVER (PARTITION BY id, i) AS last FROM hard) WHERE j = last AND NOT {_blank('cur')}) GROUP BY ALL), "
        "whole AS MATERIALIZED (SELECT para.*, coalesce(slices, []) AS slices FROM para LEFT JOIN cut USING (id, i)), "
        "pack AS (SELECT DISTINCT id, CAST(0 AS BIGINT) AS i, '' AS cur, CAST([] AS VARCHAR[]) AS out FROM para UNION ALL "
        f"SELECT id, i, CASE WHEN length(p) > {target} THEN '' WHEN length(longer) <= {target} THEN longer ELSE CASE WHEN lap <> '' THEN lap || chr(10) || chr(10) ELSE '' END || p END, "
        f"CASE WHEN length(p) > {target} THEN list_concat({own}, slices) WHEN length(longer) <= {target} THEN [] ELSE {own} END "
        "FROM (SELECT *, CASE WHEN broken <> '' AND NOT contains(before, '![') THEN ltrim(substr(lapped, length(broken) + 1), ' ' || chr(10)) ELSE lapped END AS lap "
        f"FROM (SELECT *, regexp_extract(lapped, '{image}', 0) AS broken, regexp_extract(lapped, '{image}', 1) AS before "
        f"FROM (SELECT *, {_TRIM.format(f'CASE WHEN head <> chr(0) THEN substr(rest, length(head) + 1) ELSE right(tail, {overlap}) END')} AS lapped "
        "FROM (SELECT *, CASE WHEN regexp_matches(rest, '(?s)^.*?[.!?]\\s+') THEN regexp_extract(rest, '(?s)^(.*?[.!?]\\s+)', 1) ELSE chr(0) END AS head "
        f"FROM (SELECT *, substr(tail, length(tail) // 2 + 1) AS rest FROM (SELECT whole.*, cur, right(cur, {2 * overlap}) AS tail, CASE WHEN cur <> '' THEN cur || chr(10) || chr(10) ELSE '' END || p AS longer "
        "FROM pack JOIN whole ON whole.id = pack.id AND whole.i = pack.i + 1))))))), "
        "packed AS MATERIALIZED (SELECT id, x, row_number() OVER (PARTITION BY id ORDER BY i, k) AS n FROM (SELECT id, i, unnest(out) AS x, generate_subscripts(out, 1) AS k FROM pack "
        f"UNION ALL SELECT id, i + 1, {_TRIM.format('cur')}, 1 FROM (SELECT *, max(i) OVER (PARTITION BY id) AS last FROM pack) WHERE i = last AND NOT {_blank('cur')})), "
        "mend AS (SELECT id, CAST(0 AS BIGINT) AS n, '' AS cur, '' AS done FROM packed WHERE n = 1 UNION ALL "
        f"SELECT id, n, CASE WHEN moves THEN regexp_extract(cur, '{url}', 2) || x ELSE x END, CASE WHEN moves THEN rtrim(regexp_extract(cur, '{url}', 1), ' ' || chr(10)) ELSE cur END "
        f"FROM (SELECT packed.*, cur, regexp_matches(cur, '{url}') AND x <> '' AND contains('{C.URL_GOES_ON}', left(x, 1)) AS moves FROM mend JOIN packed ON packed.id = mend.id AND packed.n = mend.n + 1)), "
        "pieces AS MATERIALIZED (SELECT id, pos, piece FROM (SELECT id, n AS pos, done AS piece FROM mend UNION ALL SELECT id, n + 1, cur FROM (SELECT *, max(n) OVER (PARTITION BY id) AS last FROM mend) WHERE n = last) "
        f"WHERE NOT {_blank('piece')} UNION ALL SELECT id, 1, body FROM b WHERE length(body) <= {target}) "
    )


@query(f"WITH RECURSIVE b AS (SELECT doc_id AS id, replace(text, chr(10), chr(10) || chr(10)) AS body FROM documents), {pieces_sql(SMALL, 60)}SELECT id AS doc_id, CAST(row_number() OVER (PARTITION BY id ORDER BY pos) - 1 AS INTEGER) AS k, piece FROM pieces")
def chk2_split_by_size(spark: SparkSession, d: str) -> DataFrame:
    body = F.replace("text", F.lit("\n"), F.lit("\n\n"))
    return read(spark, d, "documents").select("doc_id", F.posexplode(C.split_by_size(body, SMALL, 60)).alias("k", "piece"))


_SENTENCES = "string_split(regexp_replace(text, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1))"


@query(
    f"WITH RECURSIVE s AS (SELECT doc_id, {_SENTENCES} AS l FROM documents), "
    "w AS (SELECT doc_id, l, 1 AS i, CAST([] AS VARCHAR[]) AS out, '' AS cur FROM s UNION ALL "
    f"SELECT doc_id, l, i + 1, CASE WHEN length(CASE WHEN cur <> '' THEN cur || ' ' ELSE '' END || l[i]) <= {SMALL} THEN out "
    f"ELSE list_concat(CASE WHEN cur <> '' THEN list_append(out, trim(cur, ' ' || chr(10))) ELSE out END, CASE WHEN length(l[i]) > {SMALL} THEN list_transform(range(0, length(l[i]), {SMALL - 60}), lambda x: substr(l[i], x + 1, {SMALL})) ELSE [] END) END, "
    f"CASE WHEN length(CASE WHEN cur <> '' THEN cur || ' ' ELSE '' END || l[i]) <= {SMALL} THEN CASE WHEN cur <> '' THEN cur || ' ' ELSE '' END || l[i] WHEN length(l[i]) > {SMALL} THEN '' ELSE l[i] END FROM w WHERE i <= len(l)) "
    "SELECT doc_id, md5(array_to_string(CASE WHEN trim(cur, ' ' || chr(10)) <> '' THEN list_append(out, trim(cur, ' ' || chr(10))) ELSE out END, '|')) AS pieces FROM w WHERE i = len(l) + 1"
)
def chk3_hard_split(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "documents").select("doc_id", F.md5(flat(C.hard_split(F.col("text"), SMALL, 60))).alias("pieces"))


@query(
    "WITH t AS (SELECT doc_id, right(text, 200) AS tail FROM documents), r AS (SELECT *, substr(tail, length(tail) // 2 + 1) AS rest FROM t), h AS (SELECT *, regexp_extract(rest, '(?s)^(.*?[.!?]\\s+)', 1) AS head FROM r) "
    "SELECT doc_id, regexp_replace(CASE WHEN head <> '' THEN substr(rest, length(head) + 1) ELSE right(tail, 100) END, '^\\s+|\\s+$', '', 'g') AS tail FROM h"
)
def chk4_overlap_tail(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "documents").select("doc_id", C.overlap_tail(F.col("text"), 100).alias("tail"))


@query("SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'see|https://ex.com/a/b/' || CAST(doc_id AS VARCHAR) || ' x|last' WHEN 1 THEN 'see https://ex.com/a|next|last' ELSE 'https://ex.com/a/b?c=1 x|last' END AS pieces FROM documents")
def chk5_repair_urls(spark: SparkSession, d: str) -> DataFrame:
    k, n = F.col("doc_id") % 3, F.col("doc_id").cast("string")
    pieces = F.when(k == 0, F.array(F.lit("see https://ex.com/a"), F.concat(F.lit("/b/"), n, F.lit(" x")), F.lit("last")))
    pieces = pieces.when(k == 1, F.array(F.lit("see https://ex.com/a"), F.lit("next"), F.lit("last"))).otherwise(F.array(F.lit("https://ex.com/a"), F.lit("/b"), F.lit("?c=1 x"), F.lit(" "), F.lit("last")))
    return read(spark, d, "documents").select("doc_id", flat(C.repair_urls(pieces)).alias("pieces"))


@query("SELECT doc_id, CASE WHEN doc_id % 3 = 2 THEN text ELSE '[' || CASE WHEN doc_id % 3 = 0 THEN source || ' > ' ELSE '' END || lang || ' > x]' || chr(10) || chr(10) || text END AS text FROM documents")
def chk6_context_prefix(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("doc_id") % 3
    path = F.when(k < 2, F.array(F.col("lang"), F.lit("x"))).otherwise(F.array().cast("array<string>"))
    return read(spark, d, "documents").select("doc_id", X.context_prefix(F.when(k == 0, F.col("source")), path, F.col("text")).alias("text"))


@query(
    "WITH RECURSIVE s AS (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents), "
    "w AS (SELECT doc_id, l, 2 AS i, CAST([] AS VARCHAR[]) AS out, l[1] AS cur FROM s UNION ALL "
    "SELECT doc_id, l, i + 1, CASE WHEN length(cur) < 200 AND length(cur) + length(l[i]) <= 900 THEN out ELSE list_append(out, cur) END, CASE WHEN length(cur) < 200 AND length(cur) + length(l[i]) <= 900 THEN cur || chr(10) || chr(10) || l[i] ELSE l[i] END FROM w WHERE i <= len(l)) "
    "SELECT doc_id, md5(array_to_string(list_append(out, cur), '|')) AS chunks, CAST(len(out) + 1 AS INTEGER) AS n FROM w WHERE i = len(l) + 1"
)
def chk7_merge_tiny(spark: SparkSession, d: str) -> DataFrame:
    chunks = F.transform(F.split("text", "\n"), lambda x: F.struct(x.alias("text"), F.array().cast("array<string>").alias("path")))
    merged = read(spark, d, "documents").select("doc_id", C.merge_tiny(chunks, 200, SMALL).alias("m"))
    return merged.select("doc_id", F.md5(flat(F.col("m.text"))).alias("chunks"), F.size("m").alias("n"))


@query("WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, CAST(generate_subscripts(string_split(text, chr(10)), 1) - 1 AS INTEGER) AS chunk_index FROM documents) SELECT doc_id, chunk_index, length(line) AS char_count FROM l")
def chk8_renumber(spark: SparkSession, d: str) -> DataFrame:
    """Chunks with gaps in their numbers (as merging leaves them) get numbers without."""
    rows = read(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("at", "line")).withColumn("chunk_index", F.col("at") * 3 + 7)
    return C.renumber(rows, "chunk_index").select("doc_id", "chunk_index", F.length("line").cast("bigint").alias("char_count"))


_LONG = C.TARGET * C.CHARS


@query(
    _SECTIONS.replace("WITH m", "WITH RECURSIVE m", 1)
    + ", t AS MATERIALIZED (SELECT * FROM s WHERE body <> '' UNION ALL "
    f"SELECT doc_id, CAST(0 AS BIGINT), '', {_TRIM.format('array_to_string(l, chr(10))')} FROM m WHERE doc_id NOT IN (SELECT doc_id FROM s WHERE body <> '') AND {_TRIM.format('array_to_string(l, chr(10))')} <> ''), "
    f"b AS MATERIALIZED (SELECT {{'d': doc_id, 's': sec}} AS id, body FROM t), {pieces_sql(_LONG, C.OVERLAP * C.CHARS)}, "
    "c AS MATERIALIZED (SELECT doc_id, path, row_number() OVER (PARTITION BY doc_id ORDER BY sec, pos) AS n, '[' || source || CASE WHEN path <> '' THEN ' > ' || path ELSE '' END || ']' || chr(10) || chr(10) || "
    + _TRIM.format("piece")
    + " AS text FROM pieces JOIN t ON t.doc_id = id.d AND t.sec = id.s JOIN (SELECT doc_id, source FROM documents) USING (doc_id)), "
    "g AS (SELECT doc_id, n, CAST(0 AS INTEGER) AS chunk_index, length(text) AS held FROM c WHERE n = 1 UNION ALL "
    f"SELECT doc_id, n, CASE WHEN fits THEN chunk_index ELSE chunk_index + 1 END, CASE WHEN fits THEN held + 2 + size ELSE size END FROM (SELECT c.doc_id, c.n, chunk_index, held, length(text) AS size, held < {C.LEAST} AND held + length(text) <= {1.5 * _LONG} AS fits "
    "FROM g JOIN c ON c.doc_id = g.doc_id AND c.n = g.n + 1)) "
    "SELECT doc_id, chunk_index, min_by(path, n) AS page_or_section, string_agg(text, chr(10) || chr(10) ORDER BY n) AS text, CAST(length(string_agg(text, chr(10) || chr(10) ORDER BY n)) AS INTEGER) AS char_count FROM g JOIN c USING (doc_id, n) GROUP BY doc_id, chunk_index"
)
def chk9_chunk_documents(spark: SparkSession, d: str) -> DataFrame:
    out = C.chunk_documents(titled(spark, d))
    return out.select("doc_id", "chunk_index", "page_or_section", "text", "char_count")


STOP_SQL = "[" + ", ".join(f"'{w}'" for w in X.STOPWORDS) + "]"
TOKENS_SQL = f"list_filter(list_transform(regexp_extract_all(text, '{X.TOKEN}'), lambda t: lower(t)), lambda t: length(t) > 1 AND NOT list_contains({STOP_SQL}, t))"
BM25_SQL = (
    f"w AS (SELECT doc_id AS chunk_id, unnest(regexp_extract_all(text, '{X.TOKEN}')) AS word FROM documents), "
    f"p AS MATERIALIZED (SELECT chunk_id, tok, sum(n)::BIGINT AS tf FROM (SELECT chunk_id, lower(word) AS tok, count(*) AS n FROM w GROUP BY ALL) WHERE length(tok) > 1 AND tok NOT IN ({STOP_SQL[1:-1]}) GROUP BY ALL), "
    "k AS MATERIALIZED (SELECT chunk_id, sum(tf)::BIGINT AS len FROM p GROUP BY chunk_id), "
    "t AS MATERIALIZED (SELECT (SELECT count(*) FROM documents) AS n, (SELECT sum(tf) FROM p) / (SELECT count(*) FROM documents) AS mean), "
    "f AS MATERIALIZED (SELECT tok, count(*) AS df, ln(any_value(n) - count(*) + 0.5) - ln(count(*) + 0.5) AS raw FROM p, t GROUP BY tok), "
    "u AS MATERIALIZED (SELECT avg(raw) AS mean_raw FROM f), "
    "i AS MATERIALIZED (SELECT tok, df, CASE WHEN raw < 0 THEN 0.25 * mean_raw ELSE raw END AS idf FROM f, u), "
    "g AS (SELECT p.tok, p.chunk_id, idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len / mean)) AS weight FROM p JOIN i USING (tok) JOIN k USING (chunk_id), t) "
)
_built: dict[tuple, str] = {}


def bm25_index(spark: SparkSession, d: str) -> N.Bm25:
    """The index of the documents of d, written once a session and read by every later query; other files of documents get an index of their own."""
    key = (spark.sparkContext.applicationId, d, listing(spark, f"{d}/documents.parquet"))
    if key not in _built or not exists(spark, _built[key]):
        path = scratch(spark, "bm25")
        N.build_bm25(chunks(spark, d), path)
        _built[key] = path
    return N.open_bm25(spark, _built[key])


def chunks(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "documents").select(F.col("doc_id").alias("chunk_id"), "text")


@query(f"SELECT doc_id AS chunk_id, array_to_string({TOKENS_SQL}, '|') AS tokens FROM documents")
def idx1_tokenize(spark: SparkSession, d: str) -> DataFrame:
    return chunks(spark, d).select("chunk_id", flat(X.tokenize(F.col("text"))).alias("tokens"))


@query(f"WITH {BM25_SQL} SELECT tok, df, round(idf, 6) AS idf FROM i")
def idx2_bm25_stats(spark: SparkSession, d: str) -> DataFrame:
    return bm25_index(spark, d).idf.select("tok", "df", F.round("idf", 6).alias("idf"))


@query(f"WITH {BM25_SQL} SELECT tok, chunk_id, round(weight, 6) AS weight FROM g")
def idx3_bm25_weight(spark: SparkSession, d: str) -> DataFrame:
    return N.bm25_weights(bm25_index(spark, d)).select("tok", "chunk_id", F.round("weight", 6).alias("weight"))


@query()
def idx4_embed(spark: SparkSession, d: str) -> DataFrame:
    return N.embed(chunks(spark, d))


@query("SELECT vec_id, round(embedding[1] * 3.0 / sqrt(list_sum(list_transform(embedding, lambda x: 9.0 * x::DOUBLE * x::DOUBLE))), 4) AS first, round(embedding[64] * 3.0 / sqrt(list_sum(list_transform(embedding, lambda x: 9.0 * x::DOUBLE * x::DOUBLE))), 4) AS last FROM embeddings")
def idx5_l2_normalize(spark: SparkSession, d: str) -> DataFrame:
    v = X.l2_normalize(F.transform("embedding", lambda x: x.cast("double") * 3))
    return read(spark, d, "embeddings").select("vec_id", F.round(v[0], 4).alias("first"), F.round(v[63], 4).alias("last"))


@query("WITH v AS (SELECT vec_id AS chunk_id, unnest(embedding) AS w, generate_subscripts(embedding, 1) AS tok FROM embeddings) SELECT chunk_id, CAST(tok AS BIGINT) AS tok, CAST(w AS DOUBLE) AS w FROM v WHERE w > 0")
def idx6_to_sparse(spark: SparkSession, d: str) -> DataFrame:
    weights = F.map_from_arrays(F.sequence(F.lit(1), F.size("embedding")), "embedding")
    return N.to_sparse(read(spark, d, "embeddings").select(F.col("vec_id").alias("chunk_id"), weights.alias("weights")))


@query("SELECT vec_id AS chunk_id, label % 3 = 0 AS fits FROM embeddings")
def idx7_validate_dims(spark: SparkSession, d: str) -> DataFrame:
    index = read(spark, d, "embeddings").select((F.col("label") % 3).cast("string").alias("collection"), F.col("vec_id").alias("chunk_id"), F.col("embedding").alias("dense"))
    collections = spark.createDataFrame([("0", 64), ("1", 32)], "collection string, dense_dim int")
    return N.validate_dims(index, collections).select("chunk_id", "fits")


@query("SELECT doc_id, left(text, 512) AS passage, CASE WHEN length(text) > 1200 THEN left(text, 1200) || ' [...]' ELSE text END AS judged FROM documents")
def idx8_truncate_text(spark: SparkSession, d: str) -> DataFrame:
    t = F.col("text")
    return read(spark, d, "documents").select("doc_id", X.truncate_text(t, 512).alias("passage"), X.truncate_text(t, 1200, " [...]").alias("judged"))
