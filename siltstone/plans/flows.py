"""Queries of sources, sinks and drained streams; files are written from the tables first."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.functions import text as X
from siltstone.sources import files as S
from siltstone.streaming import streams as T
from siltstone.streaming.ingest import Ingestion, single_chunks
from siltstone.plans.base import SOURCE_SQL, read, scratch, source_name
from siltstone.plans.maintenance import calls

QUERIES, SQL = {}, {}
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def query(sql: str | None = None):
    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return put


def landed(spark: SparkSession, d: str) -> str:
    """A landing folder with the documents as text files, a folder for each source."""
    path = scratch(spark, "landing")
    read(spark, d, "documents").select("text", "source").write.partitionBy("source").text(path)
    return path


_LANDED = "SELECT source, CAST(sum(octet_length(encode(text)) + 1) AS BIGINT) AS bytes FROM documents GROUP BY source"


def _by_source(files: DataFrame, path: str = "path") -> DataFrame:
    return files.groupBy(F.regexp_extract(path, r"source=([^/]+)/", 1).alias("source")).agg(F.sum("length").alias("bytes"))


@query(_LANDED)
def src1_scan_sources(spark: SparkSession, d: str) -> DataFrame:
    return _by_source(S.scan_sources(spark, landed(spark, d)).where("ext = '.txt'"))


@query(
    f"SELECT {SOURCE_SQL} AS path, url FROM documents, LATERAL (SELECT unnest(['https://youtu.be/abcdefghij' || CAST(doc_id % 10 AS VARCHAR), 'see https://www.youtube.com/watch?v=ABCDEFGHIJK&t=' || CAST(doc_id AS VARCHAR)]) AS url) WHERE doc_id % 3 = 0 UNION ALL SELECT {SOURCE_SQL}, NULL FROM documents WHERE doc_id % 3 > 0"
)
def src2_scan_url_lists(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("doc_id")
    urls = F.array(F.lit("# https://youtu.be/abcdefghijk"), F.concat(F.lit(" https://youtu.be/abcdefghij"), (n % 10).cast("string")), F.lit(""), F.concat(F.lit("see https://www.youtube.com/watch?v=ABCDEFGHIJK&t="), n.cast("string")))
    lines = read(spark, d, "documents").select(source_name().alias("path"), F.explode(F.when(n % 3 == 0, urls).otherwise(F.split("text", "\n"))).alias("line"))
    return S.scan_url_lists(lines)


@query("SELECT page_id, CASE page_id % 4 WHEN 0 THEN 'abcDEF-_' || lpad(CAST(page_id % 1000 AS VARCHAR), 3, '0') WHEN 1 THEN 'AAAAAAAAAAA' WHEN 2 THEN 'BBBBBBBBBBB' END AS video FROM pages")
def src3_youtube_id(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("page_id") % 4
    url = F.when(k == 0, F.concat(F.lit("HTTPS://WWW.YouTube.com/watch?v=abcDEF-_"), F.lpad((F.col("page_id") % 1000).cast("string"), 3, "0"))).when(k == 1, "youtu.be/AAAAAAAAAAAx").when(k == 2, "https://youtube.com/shorts/BBBBBBBBBBB").otherwise(F.col("url"))
    return read(spark, d, "pages").select("page_id", X.youtube_id(url).alias("video"))


_EXTS = ("pdf", "DOC", "html", "mmap", "xyz", "")


@query("SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN 'pdf' WHEN 1 THEN 'doc' WHEN 2 THEN 'html' WHEN 3 THEN 'mmap' WHEN 4 THEN 'xyz' END AS doc_type, CASE doc_id % 6 WHEN 0 THEN 'pdf' WHEN 1 THEN 'legacy_office' WHEN 2 THEN 'generic' WHEN 3 THEN 'mindmap' END AS handler FROM documents")
def src4_route_by_type(spark: SparkSession, d: str) -> DataFrame:
    ext = F.element_at(F.array(*[F.lit("." + e if e else "") for e in _EXTS]), (F.col("doc_id") % 6 + 1).cast("int"))
    return S.route_by_type(read(spark, d, "documents").select("doc_id", F.concat(F.lit("a/b"), ext).alias("source_name"))).select("doc_id", "doc_type", "handler")


def _entries(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("doc_id") % 8
    name = F.when(k == 0, "__MACOSX/a.md").when(k == 1, "x\\.hidden.md").when(k == 2, "a/b.exe").when(k == 3, "../up.md").when(k == 4, "/root.md").otherwise(F.concat(F.lit("docs/"), F.col("doc_id").cast("string"), F.lit(".md")))
    return read(spark, d, "documents").select(F.col("source").alias("archive"), name.alias("entry"), F.col("n_chars").alias("size"), (k == 7).alias("is_dir"), F.encode("text", "UTF-8").alias("bytes"), F.col("doc_id").alias("position"))


_ARCHIVE = (
    "en AS (SELECT source AS archive, doc_id, doc_id % 8 AS k, n_chars AS size FROM documents WHERE doc_id % 8 NOT IN (0, 1, 7)), "
    "ea AS (SELECT *, CASE WHEN k = 2 THEN 'unsupported' WHEN size > 5000 THEN 'too_big' END AS early FROM en), "
    "ef AS (SELECT *, coalesce(sum(CASE WHEN early IS NULL AND k <> 3 THEN 1 ELSE 0 END) OVER (PARTITION BY archive ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS kept FROM ea), "
    "eo AS (SELECT *, bool_or(early IS NULL AND kept >= 12) OVER (PARTITION BY archive ORDER BY doc_id) AS over FROM ef), "
    "ex AS (SELECT archive, doc_id, CASE WHEN k = 2 THEN 'a/b.exe' WHEN k = 3 THEN '../up.md' WHEN k = 4 THEN 'root.md' ELSE 'docs/' || CAST(doc_id AS VARCHAR) || '.md' END AS source_name, CASE WHEN over THEN 'over_limit' WHEN early IS NOT NULL THEN early WHEN k = 3 THEN 'unsafe' END AS skip_reason FROM eo) "
)


@query(f"WITH {_ARCHIVE} SELECT archive, doc_id AS position, source_name, skip_reason FROM ex")
def src5_expand_archives(spark: SparkSession, d: str) -> DataFrame:
    return S.expand_archives(_entries(spark, d), 5000, 12).select("archive", "position", "source_name", "skip_reason")


@query(f"WITH {_ARCHIVE} SELECT archive, count(*) FILTER (WHERE skip_reason IS NULL) AS kept, count(*) FILTER (WHERE skip_reason = 'unsupported') AS unsupported, count(*) FILTER (WHERE skip_reason = 'too_big') AS too_big, count(*) FILTER (WHERE skip_reason = 'unsafe') AS unsafe FROM ex GROUP BY archive")
def src6_archive_report(spark: SparkSession, d: str) -> DataFrame:
    return S.archive_report(S.expand_archives(_entries(spark, d), 5000, 12))


@query("SELECT text AS question, 'c' AS collection, 'src' || CAST(item_id % 20 AS VARCHAR) AS expected_doc, left(text, 4) AS keywords FROM benchmark WHERE item_id % 4 > 1")
def src7_read_jsonl(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("item_id") % 4
    row = F.to_json(F.struct(F.col("text").alias("question"), F.lit("c").alias("collection"), F.concat(F.lit("src"), (F.col("item_id") % 20).cast("string")).alias("expected_doc"), F.array(F.left("text", F.lit(4))).alias("expected_keywords")))
    lines = read(spark, d, "benchmark").select(F.when(k == 0, "  ").when(k == 1, F.concat(F.lit("# "), row)).otherwise(row).alias("value"))
    return S.read_jsonl(lines).select("question", "collection", "expected_doc", F.array_join("expected_keywords", "|").alias("keywords"))


@query("SELECT doc_id, n_chars * 1024 <= 5 * 1048576 AS accepted FROM documents")
def src8_enforce_size_limit(spark: SparkSession, d: str) -> DataFrame:
    files = read(spark, d, "documents").select("doc_id", (F.col("n_chars") * 1024).alias("length"))
    good, bad = S.enforce_size_limit(files, 5)
    return good.select("doc_id", F.lit(True).alias("accepted")).unionByName(bad.select("doc_id", F.lit(False).alias("accepted")))


def _chunks(spark: SparkSession, d: str) -> DataFrame:
    docs = read(spark, d, "documents")
    return docs.select(F.col("source").alias("collection"), "doc_id", F.concat(F.lit("doc_"), F.col("doc_id").cast("string")).alias("chunk_id"), F.col("source").alias("doc_title"), F.lit("").alias("heading_path"), F.length("text").alias("char_count"), "text")


@query("SELECT source AS collection, 'doc_' || CAST(doc_id AS VARCHAR) AS chunk_id, CASE WHEN doc_id % 10 = 1 THEN md5('v2') ELSE md5(text) END AS text FROM documents")
def snk1_write_index(spark: SparkSession, d: str) -> DataFrame:
    path, chunks = scratch(spark, "index"), _chunks(spark, d)
    S.write_index(chunks.where("doc_id % 10 <> 2"), path, 4)
    index = S.write_index(chunks.where("doc_id % 10 in (1, 2)").withColumn("text", F.when(F.col("doc_id") % 10 == 1, "v2").otherwise(F.col("text"))), path, 4)
    return index.table("chunks").select("collection", "chunk_id", F.md5("text").alias("text"))


@query("SELECT 'doc_' || CAST(doc_id AS VARCHAR) AS chunk_id, source AS doc_title, length(text) AS char_count, left(text, 200) AS preview FROM documents")
def snk2_write_preview(spark: SparkSession, d: str) -> DataFrame:
    path = scratch(spark, "preview")
    S.write_preview(_chunks(spark, d), path)
    return spark.read.schema("chunk_id string, doc_title string, char_count bigint, preview string").json(path)


@query("SELECT 'item' AS kind, doc_id, quality, NULL::BIGINT AS n FROM labels UNION ALL SELECT 'summary', NULL, sum(quality)::BIGINT, count(*) FROM labels")
def snk3_write_eval_report(spark: SparkSession, d: str) -> DataFrame:
    """Summary and items, both read back."""
    path = scratch(spark, "report")
    labels = read(spark, d, "labels")
    S.write_eval_report(labels.agg(F.count("*").alias("n"), F.sum("quality").alias("good")), labels.select("doc_id", "quality"), path)
    summary, items = S.read_eval_report(spark, path, "n bigint, good bigint", "doc_id bigint, quality bigint")
    return items.select(F.lit("item").alias("kind"), "doc_id", "quality", F.lit(None).cast("bigint").alias("n")).unionByName(summary.select(F.lit("summary").alias("kind"), F.lit(None).cast("bigint").alias("doc_id"), F.col("good").alias("quality"), "n"))


def _inbox(spark: SparkSession, d: str) -> str:
    """A landing folder with one text file a source, in a folder of its name, and one file in Latin-1 that isn't UTF-8."""
    path, docs = scratch(spark, "inbox"), read(spark, d, "documents").select("text", "source")
    docs.repartition("source").sortWithinPartitions("source").write.partitionBy("source").text(path)
    docs.limit(1).select(F.lit("caf\u00e9").alias("v")).coalesce(1).write.option("encoding", "ISO-8859-1").csv(f"{path}/source=broken")
    return path


@query("SELECT source AS collection, CAST(sum(octet_length(encode(text)) + 1) AS BIGINT) AS bytes, 'indexed' AS status, CAST(NULL AS VARCHAR) AS error, true AS agrees FROM documents GROUP BY source UNION ALL SELECT 'broken', 5, 'failed', 'not decoded, blank or without a chunk', true")
def str1_ingest_stream(spark: SparkSession, d: str) -> DataFrame:
    """The documents of an index after a drained run over files in batches of twelve; agrees: chunks and vectors are as many as the document says."""
    ingestion = Ingestion(scratch(spark, "ingested"), buckets=8)
    ingestion.run(T.landing_stream(spark, _inbox(spark, d), 12), scratch(spark, "offsets")).awaitTermination()
    held = ingestion.tables(spark)
    counted = [held.table(t).groupBy("collection", "doc_id").agg(F.count("*").alias(t)) for t in ("chunks", "dense")]
    docs = held.table("documents")
    for n in counted:
        docs = docs.join(n, ["collection", "doc_id"], "left")
    n = lambda c: F.coalesce(c, F.lit(0))
    return docs.select("collection", "bytes", "status", "error", ((n("chunks") == F.col("n_chunks")) & (n("dense") == F.col("n_chunks")) & ((F.col("n_chunks") > 0) == (F.col("status") == "indexed"))).alias("agrees"))


@query(
    "WITH f AS (SELECT count(DISTINCT source) + 1 AS files FROM documents), c AS (SELECT count(*) AS chunks FROM (SELECT unnest(string_split(text, chr(10))) AS line FROM documents) WHERE regexp_matches(line, '\\S')) "
    "SELECT stage, CAST(CASE WHEN stage IN ('parsing', 'done') THEN files ELSE chunks END AS BIGINT) AS rows FROM f, c, (SELECT unnest(['parsing', 'embedding', 'indexing', 'done']) AS stage)"
)
def str2_job_progress(spark: SparkSession, d: str) -> DataFrame:
    """The rows that each stage of a drained ingestion reported; chunks are the lines."""
    ingestion = Ingestion(scratch(spark, "ingested"), chunker=single_chunks, buckets=8)
    ingestion.run(T.landing_stream(spark, _inbox(spark, d), 12), scratch(spark, "offsets")).awaitTermination()
    return ingestion.progress(spark).groupBy("stage").agg(F.sum("rows").alias("rows"))


def _limits(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([("click", 2, 100), ("view", 3, 0), ("purchase", 1, 50)], "model string, rpm int, rpd int")


_LIMITS = "lm AS (SELECT * FROM (VALUES ('click', 2, 100), ('view', 3, 0), ('purchase', 1, 50)) AS t(model, rpm, rpd)) "


@query(
    f"WITH {_LIMITS}, w AS (SELECT event_id, event_type AS model, ts, count(*) OVER v AS n, min(ts) OVER v AS oldest FROM events WINDOW v AS (PARTITION BY event_type ORDER BY ts RANGE BETWEEN INTERVAL 60 SECONDS PRECEDING AND CURRENT ROW)) "
    "SELECT event_id, n AS in_window, round(CASE WHEN rpm > 0 AND n >= rpm THEN 60 - (epoch_us(ts) - epoch_us(oldest)) / 1e6 + 0.2 ELSE 0 END, 4) AS wait FROM w LEFT JOIN lm USING (model)"
)
def str3_rpm_window(spark: SparkSession, d: str) -> DataFrame:
    return T.rpm_window(calls(spark, d), _limits(spark)).select("event_id", "in_window", F.round("wait", 4).alias("wait"))


def _drained(stream: DataFrame, spark: SparkSession) -> DataFrame:
    out = scratch(spark, "drained")
    stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", scratch(spark, "offsets")).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


def _events(spark: SparkSession, d: str) -> DataFrame:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    schema = read(spark, d, "events").schema
    return spark.readStream.schema(schema).parquet(f"{d}/events.parquet*").withColumn("ts", F.col("ts").cast("timestamp"))


#: What a drained stream has passed: the latest event less ten minutes, in ms.
_MARK = "(SELECT max(epoch_us(ts)) // 1000 - 600000 FROM events)"


@query(
    "WITH w AS (SELECT event_type AS model, epoch_us(ts) AS us, count(*) OVER (PARTITION BY event_type ORDER BY ts RANGE BETWEEN INTERVAL 60 SECONDS PRECEDING AND CURRENT ROW) AS in_window FROM events) "
    f"SELECT * FROM w WHERE (us // 60000000 + 1) * 60000 <= {_MARK}"
)
def str3_rpm_stream(spark: SparkSession, d: str) -> DataFrame:
    """The minutes that the watermark has passed when the stream is drained."""
    return _drained(T.rpm_stream(_events(spark, d).select(F.col("event_type").alias("model"), "ts")), spark)


@query(f"WITH {_LIMITS}, q AS (SELECT event_type AS model, date_trunc('day', ts - INTERVAL 8 HOURS) + INTERVAL 8 HOURS AS day, count(*) AS calls FROM events GROUP BY ALL) SELECT model, CAST(day AS VARCHAR) AS day, calls, coalesce(rpd, 0) > 0 AND calls >= coalesce(rpd, 0) AS exhausted FROM q LEFT JOIN lm USING (model)")
def str4_daily_quota(spark: SparkSession, d: str) -> DataFrame:
    return T.daily_quota(calls(spark, d), _limits(spark)).withColumn("day", F.date_format("day", "yyyy-MM-dd HH:mm:ss"))


@query("SELECT model, CASE model WHEN 'click' THEN 9 WHEN 'view' THEN 3 ELSE 7 END AS rpm, CASE model WHEN 'view' THEN 30 WHEN 'click' THEN 10 ELSE 70 END AS rpd FROM (SELECT DISTINCT event_type AS model FROM events)")
def str5_limits(spark: SparkSession, d: str) -> DataFrame:
    kind = "model string, rpm int, rpd int"
    defaults = spark.createDataFrame([("_default", 7, 70), ("click", 1, 10), ("view", 3, 30)], kind)
    return T.effective_limits(read(spark, d, "events").select(F.col("event_type").alias("model")).distinct(), defaults, spark.createDataFrame([("click", 9, None)], kind))


@query("SELECT event_id, event_id % 4 < 3 AS is_quota, CASE event_id % 4 WHEN 0 THEN CAST(event_id % 50 AS DOUBLE) WHEN 1 THEN 30.0 * (user_id % 3 + 1) WHEN 2 THEN 30.0 * (user_id % 3 + 1) END AS retry_after FROM events")
def str6_classify_errors(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("event_id") % 4
    message = F.when(k == 0, F.concat(F.lit("429 {'retryDelay': '"), (F.col("event_id") % 50).cast("string"), F.lit("s'}"))).when(k == 1, "Resource_Exhausted").when(k == 2, "Rate Limit reached").otherwise("timeout")
    log = read(spark, d, "events").select("event_id", message.alias("message"), (F.col("user_id") % 3 + 1).alias("attempt"))
    return T.classify_errors(log).select("event_id", "is_quota", "retry_after")


@query(
    f"WITH RECURSIVE e AS (SELECT user_id, epoch_us(ts) / 1e6 AS start, epoch_us(ts) // 1000 AS ms FROM events WHERE epoch_us(ts) // 1000 < {_MARK}), "
    "o AS (SELECT *, coalesce(ms - lag(ms) OVER (PARTITION BY user_id ORDER BY ms, start) > 172800000, false) AS idle FROM e), "
    "v AS (SELECT *, sum(idle::INT) OVER (PARTITION BY user_id ORDER BY ms, start ROWS UNBOUNDED PRECEDING) AS part FROM o), "
    "s AS (SELECT *, row_number() OVER (PARTITION BY user_id, part ORDER BY ms, start) AS k FROM v), "
    "w AS (SELECT user_id, part, k, ms, start, start AS anchor, 0 AS g FROM s WHERE k = 1 UNION ALL SELECT s.user_id, s.part, s.k, s.ms, s.start, CASE WHEN s.start - w.anchor >= 86400 THEN s.start ELSE w.anchor END, CASE WHEN s.start - w.anchor >= 86400 THEN w.g + 1 ELSE w.g END FROM w JOIN s ON s.user_id = w.user_id AND s.part = w.part AND s.k = w.k + 1), "
    "c AS (SELECT user_id, part, g, min(anchor) AS start, count(*) AS segments, max(ms) AS last FROM w GROUP BY ALL) "
    f"SELECT CAST(user_id AS VARCHAR) AS video_id, g AS group_no, start, segments FROM c QUALIFY (part, g) < max((part, g)) OVER (PARTITION BY user_id) OR last + 172800000 < {_MARK}"
)
def str7_segment_stream(spark: SparkSession, d: str) -> DataFrame:
    """Groups of a day; a video is over after two days without a segment."""
    rows = _events(spark, d).select(F.col("user_id").cast("string").alias("video_id"), "ts", (F.unix_micros("ts") / 1e6).alias("start"), F.lit(1.0).alias("duration"), F.lit("x").alias("text"))
    out = _drained(T.segment_stream(rows, 86400.0, idle=172_800), spark)
    return out.select("video_id", "group_no", "start", F.size(F.split("text", " ")).cast("bigint").alias("segments"))


def _first_line(name: str, raw: bytes) -> list[dict[str, str]]:
    text = raw.decode()
    return [{"title": text.split("\n")[0], "markdown": text}]


def _two_parts(name: str, raw: bytes) -> list[dict[str, str]]:
    text = raw.decode()
    half = len(text) // 2
    return [{"title": name, "markdown": text[:half]}, {"title": name, "markdown": text[half:]}]


def _refused(name: str, raw: bytes) -> list[dict[str, str]]:
    raise ValueError("not readable")


_NAMED = "SELECT source || '/doc_' || CAST(doc_id AS VARCHAR) || CASE doc_id % 4 WHEN 0 THEN '.md' WHEN 1 THEN '.TXT' WHEN 2 THEN '.pdf' ELSE '' END AS source_name, doc_id % 4 AS k, text FROM documents"


@query(
    f"WITH f AS ({_NAMED}) SELECT source_name, string_split(text, chr(10))[1] AS title, md5(text) AS markdown, NULL AS error FROM f WHERE k = 0 "
    "UNION ALL SELECT source_name, source_name, md5(unnest([left(text, length(text) // 2), substr(text, length(text) // 2 + 1)])), NULL FROM f WHERE k = 1 "
    "UNION ALL SELECT source_name, NULL, NULL, 'ValueError: not readable' FROM f WHERE k = 2 UNION ALL SELECT source_name, NULL, NULL, 'no converter' FROM f WHERE k = 3"
)
def udf1_convert(spark: SparkSession, d: str) -> DataFrame:
    """Files of four kinds through a registry: one document each, two documents each, one that fails, one unknown."""
    ext = F.element_at(F.array(*map(F.lit, (".md", ".TXT", ".pdf", ""))), (F.col("doc_id") % 4 + 1).cast("int"))
    name = F.concat("source", F.lit("/doc_"), F.col("doc_id").cast("string"), ext)
    files = read(spark, d, "documents").select(name.alias("source_name"), F.encode("text", "UTF-8").alias("content"))
    out = S.convert(files, {".md": _first_line, ".txt": _two_parts, ".pdf": _refused})
    return out.withColumn("markdown", F.md5("markdown"))
