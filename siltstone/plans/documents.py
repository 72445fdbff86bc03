"""Queries of document identities and assembly over documents, pages, conversations and nations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.functions import text as X
from siltstone.operators import assemble as A
from siltstone.operators.html import html_to_markdown
from siltstone.plans.base import MARKDOWN_SQL, SOURCE_SQL, markdown, read, source_name

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return put


@query(f"SELECT doc_id AS id, 'doc_' || left(sha256({SOURCE_SQL}), 16) AS doc_id FROM documents")
def doc1_doc_id(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "documents").select(F.col("doc_id").alias("id"), X.doc_id(source_name()).alias("doc_id"))


@query(
    f"SELECT doc_id AS id, 'file_' || left(sha256('/data/' || {SOURCE_SQL}), 16) AS file_id, 'video_' || left(sha256('/data/' || {SOURCE_SQL}), 16) AS video_id, "
    "CASE WHEN doc_id % 4 > 0 THEN 'yt_' || lpad(CAST(doc_id AS VARCHAR), 11, 'v') END AS yt_id FROM documents"
)
def doc2_doc_id_path(spark: SparkSession, d: str) -> DataFrame:
    path = F.concat(F.lit("/data/"), source_name())
    url = F.concat(F.when(F.col("doc_id") % 4 > 0, "https://www.youtube.com/watch?v=").otherwise("https://example.com/"), F.lpad(F.col("doc_id").cast("string"), 11, "v"), F.lit("&t=4"))
    return read(spark, d, "documents").select(F.col("doc_id").alias("id"), X.doc_id(path, "file_").alias("file_id"), X.doc_id(path, "video_").alias("video_id"), X.video_doc_id(url).alias("yt_id"))


@query("SELECT doc_id AS id, sha256(text) AS content_hash FROM documents")
def doc3_content_hash(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "documents").select(F.col("doc_id").alias("id"), X.content_hash(F.col("text")).alias("content_hash"))


@query(f"SELECT doc_id AS id, left(sha256({SOURCE_SQL} || ':' || CAST(n_chars AS VARCHAR) || ':' || CAST(1700000000 + doc_id AS VARCHAR)), 8) AS office, left(sha256({SOURCE_SQL} || ':' || CAST(n_chars AS VARCHAR) || ':' || CAST(1700000000 + doc_id AS VARCHAR)), 20) AS video FROM documents")
def doc4_file_fingerprint(spark: SparkSession, d: str) -> DataFrame:
    own = [X.file_fingerprint(source_name(), F.col("n_chars"), F.col("doc_id") + 1700000000.25, n).alias(name) for n, name in ((8, "office"), (20, "video"))]
    return read(spark, d, "documents").select(F.col("doc_id").alias("id"), *own)


@query(
    "WITH h AS (SELECT doc_id, sha1('\\x6f\\x96\\x19\\xff\\x8b\\x86\\xd0\\x11\\xb4\\x2d\\x00\\xc0\\x4f\\xc9\\x64\\xff'::BLOB || encode('doc_' || CAST(doc_id AS VARCHAR) || '#' || CAST(n_chars % 7 AS VARCHAR))) AS h FROM documents) "
    "SELECT doc_id AS id, substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-5' || substr(h, 14, 3) || '-' || substr('89ab', CAST('0x' || substr(h, 17, 1) AS INTEGER) % 4 + 1, 1) || substr(h, 18, 3) || '-' || substr(h, 21, 12) AS point_id FROM h"
)
def doc5_point_id(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "documents").select(F.col("doc_id").alias("id"), X.point_id(F.concat(F.lit("doc_"), F.col("doc_id").cast("string")), F.col("n_chars") % 7).alias("point_id"))


@query("SELECT doc_id AS id, 'd_c' || CASE WHEN length(CAST(n_chars AS VARCHAR)) < 4 THEN lpad(CAST(n_chars AS VARCHAR), 4, '0') ELSE CAST(n_chars AS VARCHAR) END AS chunk_id FROM documents")
def doc6_chunk_id(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "documents").select(F.col("doc_id").alias("id"), X.chunk_id(F.lit("d"), F.col("n_chars")).alias("chunk_id"))


@query(r"SELECT doc_id AS id, regexp_replace(text, '[^\p{L}\p{N}_\-. ]', '_', 'g') AS name FROM documents")
def doc7_safe_cache_name(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "documents").select(F.col("doc_id").alias("id"), X.safe_cache_name(F.col("text")).alias("name"))


_HTML_SQL = "html"
_HTML_SQL = f"regexp_replace({_HTML_SQL}, '(?is)<!--.*?-->|<script\\b.*?</script\\s*>|<style\\b.*?</style\\s*>|<head\\b.*?</head\\s*>', '', 'g')"
_HTML_SQL = f"regexp_replace({_HTML_SQL}, '\\s+', ' ', 'g')"
for _k in range(1, 7):
    _HTML_SQL = f"regexp_replace({_HTML_SQL}, '(?i)<h{_k}\\b[^>]*>', chr(10) || chr(10) || '{'#' * _k} ', 'g')"
_HTML_SQL = f"regexp_replace({_HTML_SQL}, '(?i)<li\\b[^>]*>', chr(10) || '- ', 'g')"
_HTML_SQL = f"""regexp_replace({_HTML_SQL}, '(?i)<a\\b[^>]*href=["'']([^"'']*)["''][^>]*>(.*?)</a\\s*>', '[\\2](\\1)', 'g')"""
_HTML_SQL = f"regexp_replace({_HTML_SQL}, '(?i)</?(p|div|h[1-6]|ul|ol|table|tr|section|article)\\b[^>]*>|<br\\b[^>]*>', chr(10) || chr(10), 'g')"
_HTML_SQL = f"regexp_replace({_HTML_SQL}, '<[^>]*>', '', 'g')"
for _e, _c in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&middot;", "·"), ("&copy;", "©"), ("&amp;", "&")):
    _HTML_SQL = f"replace({_HTML_SQL}, '{_e}', '{_c}')"
_HTML_SQL = f"regexp_replace(regexp_replace(regexp_replace({_HTML_SQL}, ' *\\n *', chr(10), 'g'), '\\n{{3,}}', chr(10) || chr(10), 'g'), '^\\s+|\\s+$', '', 'g')"


@query(f"SELECT page_id, {_HTML_SQL} AS markdown, regexp_replace(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title', 1), '^\\s+|\\s+$', '', 'g') AS title FROM pages")
def doc8_html_to_markdown(spark: SparkSession, d: str) -> DataFrame:
    stem = F.concat(F.lit("page_"), F.col("page_id").cast("string"))
    pages = read(spark, d, "pages").select("page_id", "html")
    return html_to_markdown(pages, "page_id").join(pages.select("page_id", X.html_title(F.col("html"), stem).alias("title")), "page_id")


@query(f"SELECT doc_id AS id, CASE WHEN doc_id % 2 = 0 THEN source ELSE 'stem' END AS title FROM documents")
def doc9_title_from_h1(spark: SparkSession, d: str) -> DataFrame:
    text = F.when(F.col("doc_id") % 2 == 0, markdown()).otherwise(F.regexp_replace("text", "#", ""))
    return read(spark, d, "documents").select(F.col("doc_id").alias("id"), X.title_from_h1(text, F.lit("stem")).alias("title"))


@query(
    "WITH t AS (SELECT doc_id AS id, CASE doc_id % 5 WHEN 0 THEN 'Document ' || text WHEN 1 THEN 'Untitled' ELSE regexp_replace(text, '\\S*\\s*\\z', '') END AS title, regexp_extract(text, '(\\S*)\\s*\\z', 1) AS stem FROM documents), "
    "c AS (SELECT id, lower(trim(title)) AS low, list_distinct(regexp_extract_all(lower(title), '[\\p{L}\\p{N}_]{4,}')) AS a, list_distinct(regexp_extract_all(lower(stem), '[\\p{L}\\p{N}_]{4,}')) AS b FROM t) "
    "SELECT id, low NOT IN ('ethan frome', 'document', 'document1', 'untitled', 'microsoft word', 'presentation1', 'book1', 'classeur1') AND NOT (starts_with(low, 'microsoft word') OR starts_with(low, 'untitled') OR starts_with(low, 'document')) AND list_has_any(a, b) AS legit FROM c"
)
def doc10_legit_title(spark: SparkSession, d: str) -> DataFrame:
    """The text without its last word as the title, its last word as the file's name."""
    k = F.col("doc_id") % 5
    title = F.when(k == 0, F.concat(F.lit("Document "), F.col("text"))).when(k == 1, "Untitled").otherwise(F.regexp_replace("text", r"\S*\s*\z", ""))
    return read(spark, d, "documents").select(F.col("doc_id").alias("id"), X.legit_title(title, F.regexp_extract("text", r"(\S*)\s*\z", 1)).alias("legit"))


def _pages(spark: SparkSession, d: str) -> DataFrame:
    docs = read(spark, d, "documents").select("doc_id", "text", "source")
    pages = A.split_lines_into_pages(docs).join(docs.select("doc_id", F.col("source").alias("title")), "doc_id")
    return pages.withColumn("text", F.when((F.col("page") + F.col("doc_id")) % 4 == 0, "").otherwise(F.col("text")))


_PAGES_SQL = (
    "WITH l AS (SELECT doc_id, source AS title, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS ix FROM documents), "
    "g AS (SELECT doc_id, any_value(title) AS title, CAST(ix // 5 + 1 AS INTEGER) AS page, string_agg(line, chr(10) ORDER BY ix) AS text FROM l GROUP BY doc_id, ix // 5), "
    "p AS (SELECT doc_id, title, page, CASE WHEN (page + doc_id) % 4 = 0 THEN '' ELSE text END AS text FROM g) "
)


@query(_PAGES_SQL + "SELECT doc_id, trim('# ' || any_value(title) || chr(10) || coalesce(string_agg(chr(10) || '## Page ' || CAST(page AS VARCHAR) || chr(10) || chr(10) || regexp_replace(text, '^\\s+|\\s+$', '', 'g') || chr(10), '' ORDER BY page) FILTER (WHERE regexp_replace(text, '^\\s+|\\s+$', '', 'g') <> ''), ''), chr(10) || ' ') AS markdown FROM p GROUP BY doc_id")
def doc11_assemble_pages(spark: SparkSession, d: str) -> DataFrame:
    return A.assemble_pages(_pages(spark, d))


@query(_PAGES_SQL + "SELECT doc_id, count(*) AS pages, coalesce(string_agg(CAST(page AS VARCHAR), '|' ORDER BY page) FILTER (WHERE trim(text, ' ' || chr(10)) = ''), '') AS empty_text_pages, count(*) FILTER (WHERE trim(text, ' ' || chr(10)) = '') / count(*) > 0.30 AS scanned_suspect FROM p GROUP BY doc_id")
def doc12_scanned_suspect(spark: SparkSession, d: str) -> DataFrame:
    return A.scanned_suspect(_pages(spark, d)).withColumn("empty_text_pages", F.array_join(F.col("empty_text_pages").cast("array<string>"), "|"))


_TOPICS_SQL = (
    "WITH RECURSIVE t AS (SELECT r_regionkey AS m, 'r' AS id, NULL AS up, 0 AS ord, r_name AS title, 'https://ex.com/' || r_name AS link, '' AS note FROM region "
    "UNION ALL SELECT n_regionkey, 'n' || CAST(n_nationkey AS VARCHAR), 'r', n_nationkey, n_name, NULL, lower(n_name) FROM nation "
    "UNION ALL SELECT n_regionkey, 's' || CAST(s_suppkey AS VARCHAR), 'n' || CAST(n_nationkey AS VARCHAR), s_suppkey, s_name, 'ftp://x', '' FROM supplier JOIN nation ON s_nationkey = n_nationkey), "
)


def _topics(spark: SparkSession, d: str) -> DataFrame:
    urls = lambda c: F.array(c).cast("array<string>")
    nation = read(spark, d, "nation")
    root = read(spark, d, "region").select(F.col("r_regionkey").alias("map_id"), F.lit("r").alias("topic_id"), F.lit(None).cast("string").alias("parent_id"), F.lit(0).cast("bigint").alias("ord"), F.col("r_name").alias("title"), urls(F.concat(F.lit("https://ex.com/"), F.col("r_name"))).alias("links"), F.lit("").alias("note"))
    mid = nation.select(F.col("n_regionkey").alias("map_id"), F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("topic_id"), F.lit("r").alias("parent_id"), F.col("n_nationkey").cast("bigint").alias("ord"), F.col("n_name").alias("title"), F.array().cast("array<string>").alias("links"), F.lower("n_name").alias("note"))
    leaf = read(spark, d, "supplier").join(F.broadcast(nation), F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("n_regionkey").alias("map_id"), F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("topic_id"), F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("parent_id"), F.col("s_suppkey").cast("bigint").alias("ord"), F.col("s_name").alias("title"), urls(F.lit("ftp://x")).alias("links"), F.lit("").alias("note"))
    return root.unionByName(mid).unionByName(leaf).withColumn("note_links", F.array(F.lit("https://ex.com/note")))


@query(
    _TOPICS_SQL + "w AS (SELECT m, id, 1 AS level, [lpad(CAST(ord AS VARCHAR), 8, '0')] AS path, title, link, note FROM t WHERE up IS NULL "
    "UNION ALL SELECT t.m, t.id, level + 1, list_append(path, lpad(CAST(t.ord AS VARCHAR), 8, '0')), t.title, t.link, t.note FROM t JOIN w ON t.m = w.m AND t.up = w.id), "
    "b AS (SELECT m, level, path, repeat('#', CAST(least(level + 1, 6) AS BIGINT)) || ' ' || title || CASE WHEN link LIKE 'http%' THEN chr(10) || chr(10) || '_Lien : ' || link || '_' ELSE '' END || CASE WHEN coalesce(note, '') <> '' THEN chr(10) || chr(10) || note ELSE '' END || chr(10) || chr(10) || '_Lien : https://ex.com/note_' AS md, title FROM w) "
    "SELECT m AS map_id, '# ' || max(title) FILTER (WHERE level = 1) || chr(10) || chr(10) || string_agg(md, chr(10) || chr(10) ORDER BY path) AS markdown FROM b GROUP BY m"
)
def doc13_topics_to_markdown(spark: SparkSession, d: str) -> DataFrame:
    return A.topics_to_markdown(_topics(spark, d))


@query("SELECT page_id, array_to_string(list_distinct([u FOR u IN [url, 'ftp://x', url || '#a'] IF u LIKE 'http://%' OR u LIKE 'https://%']).list_sort(), '|') AS links FROM pages")
def doc14_clean_links(spark: SparkSession, d: str) -> DataFrame:
    links = X.clean_links(F.array(F.concat(F.lit(" "), F.col("url")), F.lit("ftp://x"), F.concat(F.col("url"), F.lit("#a")), F.col("url")))
    return read(spark, d, "pages").select("page_id", F.array_join(F.array_sort(links), "|").alias("links"))


_NOTE_SQL = "html"
for _p, _r in (("(?i)</(p|div|li|tr|h[1-6]|blockquote|pre)\\s*>|<br\\s*/?>(?:</br>)?", "chr(10)"), ("(?i)</t[dh]\\s*>", "' | '"), ("<[^>]*>", "''"), ("mmarch://bin/[A-Fa-f0-9-]+\\.bin", "''"), ("[ \\t]+", "' '"), ("\\n{3,}", "chr(10) || chr(10)")):
    _NOTE_SQL = f"regexp_replace({_NOTE_SQL}, '{_p}', {_r}, 'g')"


@query(f"SELECT page_id, regexp_replace(array_to_string(list_transform(string_split({_NOTE_SQL}, chr(10)), lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g')), chr(10)), '^\\s+|\\s+$', '', 'g') AS note FROM pages")
def doc15_flatten_note(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "pages").select("page_id", X.flatten_note(F.col("html")).alias("note"))


def segments(spark: SparkSession, d: str) -> DataFrame:
    c = read(spark, d, "conversations")
    return c.select(F.col("conv_id").cast("string").alias("video_id"), (F.col("turn") * 20.0 + F.col("conv_id") % 7).alias("start"), F.lit(20.0).alias("duration"), "text")


@query(
    "WITH RECURSIVE s AS (SELECT conv_id, turn * 20.0 + conv_id % 7 AS start, regexp_replace(text, '^\\s+|\\s+$', '', 'g') AS text FROM conversations), "
    "r AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY start, text) AS k FROM s WHERE text <> ''), "
    "w AS (SELECT conv_id, k, start, start AS anchor, 0 AS g FROM r WHERE k = 1 UNION ALL SELECT r.conv_id, r.k, r.start, CASE WHEN r.start - w.anchor >= 60 THEN r.start ELSE w.anchor END, CASE WHEN r.start - w.anchor >= 60 THEN w.g + 1 ELSE w.g END FROM w JOIN r ON r.conv_id = w.conv_id AND r.k = w.k + 1) "
    "SELECT CAST(w.conv_id AS VARCHAR) AS video_id, w.g AS group_no, CAST(min(w.anchor) AS DOUBLE) AS start, CAST(max(w.start) + 20 AS DOUBLE) AS \"end\", string_agg(r.text, ' ' ORDER BY w.k) AS text FROM w JOIN r USING (conv_id, k) GROUP BY w.conv_id, w.g"
)
def doc16_group_segments(spark: SparkSession, d: str) -> DataFrame:
    return A.group_segments(segments(spark, d)).select("video_id", "group_no", "start", "end", "text")


@query("SELECT doc_id AS id, CASE WHEN n_chars >= 3600 THEN lpad(CAST(n_chars // 3600 AS VARCHAR), 2, '0') || ':' ELSE '' END || lpad(CAST(n_chars % 3600 // 60 AS VARCHAR), 2, '0') || ':' || lpad(CAST(n_chars % 60 AS VARCHAR), 2, '0') AS stamp FROM documents")
def doc17_format_timestamp(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "documents").select(F.col("doc_id").alias("id"), X.format_timestamp(F.col("n_chars") + 0.5).alias("stamp"))


@query(
    "WITH p AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS part, generate_subscripts(string_split(text, chr(10)), 1) AS k, len(string_split(text, chr(10))) AS n FROM documents), "
    "b AS (SELECT doc_id, any_value(n) AS n, string_agg(CASE WHEN k > 1 AND k - 1 <= doc_id % 4 AND k - 1 <> 2 THEN 'ref' || CAST(k - 1 AS VARCHAR) ELSE '' END || part, '' ORDER BY k) AS md FROM p GROUP BY doc_id) "
    "SELECT doc_id, md || CASE WHEN len(list_filter(range(n, doc_id % 4 + 1), lambda x: x <> 2)) > 0 THEN chr(10) || chr(10) || '## Autres images du document' || chr(10) || chr(10) || array_to_string(list_transform(list_filter(range(n, doc_id % 4 + 1), lambda x: x <> 2), lambda x: 'ref' || CAST(x AS VARCHAR)), chr(10) || chr(10)) ELSE '' END AS markdown FROM b"
)
def doc18_inject_ordered(spark: SparkSession, d: str) -> DataFrame:
    docs = read(spark, d, "documents").select("doc_id", F.replace("text", F.lit("\n"), F.lit("<!-- image -->")).alias("markdown"))
    refs = docs.where("doc_id % 4 > 0").select("doc_id", F.explode(F.sequence(F.lit(1), (F.col("doc_id") % 4).cast("int"))).alias("k"))
    return A.inject_ordered(docs, refs.withColumn("ref", F.when(F.col("k") == 2, "").otherwise(F.concat(F.lit("ref"), F.col("k").cast("string")))))


@query(
    "SELECT doc_id, array_to_string(list_transform(string_split(text, chr(10)), lambda x, i: '<!-- Slide number: ' || CAST(i AS VARCHAR) || ' -->' || CASE WHEN i <= 3 AND i % 2 = 1 THEN chr(10) || chr(10) || 'note ' || CAST(i AS VARCHAR) || chr(10) ELSE '' END || x), chr(10)) AS markdown FROM documents"
)
def doc19_inject_by_number(spark: SparkSession, d: str) -> DataFrame:
    slide = F.transform(F.split("text", "\n"), lambda x, i: F.concat(F.lit("<!-- Slide number: "), (i + 1).cast("string"), F.lit(" -->"), x))
    docs = read(spark, d, "documents").select("doc_id", F.array_join(slide, "\n").alias("markdown"))
    notes = docs.select("doc_id", F.explode(F.array(F.lit(1), F.lit(3))).alias("number")).withColumn("note", F.concat(F.lit("note "), F.col("number").cast("string")))
    return A.inject_by_number(docs, notes)


@query("WITH f AS (SELECT source, 'img/' || lang || CASE WHEN doc_id % 5 = 0 THEN '' ELSE CAST(doc_id AS VARCHAR) END || '.png' AS name, CASE WHEN doc_id % 5 = 0 THEN 0 ELSE doc_id END AS n FROM documents) SELECT source, name, row_number() OVER (PARTITION BY source ORDER BY n, name) AS position FROM f")
def doc20_natural_sort_images(spark: SparkSession, d: str) -> DataFrame:
    name = F.concat(F.lit("img/"), F.col("lang"), F.when(F.col("doc_id") % 5 == 0, "").otherwise(F.col("doc_id").cast("string")), F.lit(".png"))
    return A.natural_positions(read(spark, d, "documents").select("source", name.alias("name")), "source")


@query(
    f"WITH m AS (SELECT doc_id AS id, 'doc_' || CAST(doc_id AS VARCHAR) AS old, {SOURCE_SQL} AS name, {MARKDOWN_SQL} AS md FROM documents), "
    "n AS (SELECT id, CASE WHEN id % 2 = 0 THEN 'doc_' || left(sha256('up/' || name), 16) ELSE old END AS doc_id, CASE WHEN id % 2 = 0 THEN 'up/' || name ELSE name END AS source_name, CASE WHEN id % 2 = 0 THEN replace(md, 'rag-image://c/' || old || '/', 'rag-image://c/doc_' || left(sha256('up/' || name), 16) || '/') ELSE md END AS md FROM m) "
    "SELECT doc_id, source_name, sha256(md) AS content_hash FROM n"
)
def doc21_rebase_identity(spark: SparkSession, d: str) -> DataFrame:
    docs = read(spark, d, "documents").select(F.concat(F.lit("doc_"), F.col("doc_id").cast("string")).alias("doc_id"), source_name().alias("source_name"), markdown().alias("markdown"), F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("up/"), source_name())).alias("upload_name"))
    return A.rebase_identity(docs).select("doc_id", "source_name", "content_hash")


@query("SELECT doc_id AS id, md5(CASE WHEN starts_with(b, '#') THEN b ELSE '# ' || source || chr(10) || chr(10) || b END) AS md FROM (SELECT doc_id, source, regexp_replace(regexp_replace(CASE WHEN doc_id % 2 = 0 THEN '# x' || chr(10) ELSE '' END || replace(text, chr(10), repeat(chr(10), CAST(doc_id % 5 + 1 AS BIGINT))), '\\n{3,}', chr(10) || chr(10), 'g'), '^\\s+|\\s+$', '', 'g') AS b FROM documents)")
def doc22_collapse_blank_lines(spark: SparkSession, d: str) -> DataFrame:
    raw = F.concat(F.when(F.col("doc_id") % 2 == 0, "# x\n").otherwise(""), F.replace("text", F.lit("\n"), F.repeat(F.lit("\n"), (F.col("doc_id") % 5 + 1).cast("int"))))
    return read(spark, d, "documents").select(F.col("doc_id").alias("id"), F.md5(X.collapse_blank_lines(raw, F.col("source"))).alias("md"))


@query("SELECT doc_id AS id, 'lang=' || lang || ';n=' || CAST(n_chars AS VARCHAR) || ', ' || source AS meta FROM documents")
def doc23_flatten_metadata(spark: SparkSession, d: str) -> DataFrame:
    meta = F.create_map(F.lit("lang"), F.array("lang"), F.lit("n"), F.array(F.col("n_chars").cast("string"), F.col("source")), F.lit("none"), F.lit(None).cast("array<string>"))
    flat = F.array_join(F.transform(F.map_entries(A.flatten_metadata(meta)), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ";")
    return read(spark, d, "documents").select(F.col("doc_id").alias("id"), flat.alias("meta"))


@query(f"SELECT doc_id, {SOURCE_SQL} AS source_name, lang AS doc_type, '' AS page_or_section, CAST(0 AS INTEGER) AS chunk_index, text, sha256(text) AS content_hash, 'md' AS kind FROM documents")
def doc24_payload(spark: SparkSession, d: str) -> DataFrame:
    docs = read(spark, d, "documents")
    meta = docs.select("doc_id", source_name().alias("source_name"), F.col("lang").alias("doc_type"), X.content_hash(F.col("text")).alias("content_hash"), F.create_map(F.lit("kind"), F.lit("md"), F.lit("doc_type"), F.lit("x")).alias("extras"))
    chunks = docs.select("doc_id", F.lit(0).alias("chunk_index"), F.array().cast("array<string>").alias("heading_path"), F.lit("").alias("page_or_section"), "text")
    return A.payload(meta, chunks, "extras").select("doc_id", "source_name", "doc_type", "page_or_section", "chunk_index", "text", "content_hash", F.col("metadata")["kind"].alias("kind"))
