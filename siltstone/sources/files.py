"""Files in and out: landing folders, URL lists, archives, JSON lines and the index tables."""

from __future__ import annotations

import io
import zipfile
import zlib
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siltstone import schemas
from siltstone.functions import text as X
from siltstone.operators import tables
from siltstone.operators.chunk import begins_section
from siltstone.sources.versions import VersionedTables

# Which extension goes to which handler, in the order in which handlers are asked.
ROUTES = {
    "mindmap": (".mmap",),
    "pdf": (".pdf",),
    "legacy_office": (".doc", ".xls", ".ppt"),
    "generic": (".docx", ".xlsx", ".pptx", ".html", ".htm", ".md", ".txt", ".csv", ".json", ".xml", ".rtf", ".epub"),
}
UPLOAD_MB, ENTRIES = 100, 2000
#: Bytes after which a file's next line begins a new part, and bytes of parts that are handed on at once.
PART_BYTES, BATCH_BYTES = 64 << 10, 4 << 20
#: How parts are written: a reader holds up to 4,096 of one row group at once, so these are small.
_SMALL = {"parquet.block.size": str(8 << 20), **tables.DENSE}
_PART = "file string, size bigint, part bigint, bytes bigint, text binary"


def extension(name: Column) -> Column:
    return F.lower(F.regexp_extract(name, r"(\.[^./\\]+)$", 1))


def scan_sources(spark: SparkSession, path: str) -> DataFrame:
    """path, name, ext, length, mtime, content of all files below path, hidden ones left out; sort by path to list them.

    Spark's own lister also leaves out names that begin with an underscore: rename such files when they land.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    name = F.regexp_extract("path", r"([^/]*)$", 1)
    return files.select("path", name.alias("name"), extension(name).alias("ext"), "length", F.col("modificationTime").alias("mtime"), "content").where(~F.startswith("name", F.lit(".")))


def _parts_of_lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Parts of lines (file, size, start, line), which come block by block; each line gets back the end that the reader took from it."""
    out: list[tuple] = []
    held: list[bytes] = []
    at, place, bytes_ = None, 0, 0

    def put() -> None:
        nonlocal place, bytes_
        if held:
            text = b"\n".join([*held, b""])
            out.append((*at[:2], place, len(text), text))
            held.clear()
            place, bytes_ = place + len(text), 0

    for rows in batches:
        for *block, line in zip(*(rows.column(n).to_pylist() for n in ("file", "size", "start", "line"))):
            if block != at:
                put()
                at, place = block, block[2] + (block[2] > 0)  # a block's first line begins beyond its first byte, but for the first block's
            elif bytes_ >= PART_BYTES or begins_section(line):
                put()
            held.append(line)
            bytes_ += len(line) + 1
        if out:
            yield from _batches(out)
            out.clear()
    put()
    yield from _batches(out)


def _parts_of_files(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Parts of whole files (file, text)."""
    for rows in batches:
        for file, text in zip(rows.column("file").to_pylist(), rows.column("text").to_pylist()):
            if text is None:
                continue
            out, begun, at = [], 0, 0
            while at < len(text):
                if at > begun and (at - begun >= PART_BYTES or begins_section(text[at : at + 16])):
                    out.append((file, len(text), begun, at - begun, text[begun:at]))
                    begun = at
                at = text.find(b"\n", at) + 1 or len(text)
            yield from _batches([*out, (file, len(text), begun, len(text) - begun, text[begun:])])


def _batches(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
    kinds = (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
    batch: list[tuple] = []
    size = 0
    for i, row in enumerate(rows):
        batch.append(row)
        size += row[3]
        if size >= BATCH_BYTES or i == len(rows) - 1:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*batch), kinds)], ["file", "size", "part", "bytes", "text"])
            batch, size = [], 0


def text_parts(files: DataFrame) -> DataFrame:
    """path, size (of the file), part, text (binary) of files (path, length, or path, content), a path once: a file's texts in the order of part are its bytes. Parts are cut at ends of lines, before
    each heading and where one has PART_BYTES, so that a file of any size is read by many tasks, and no row holds more than a part or one line.

    Files whose content is given, and those that Spark's reader of lines would change (it unpacks archives by their names, and an empty text behind a mark of UTF-8 has no line) are cut from a whole row.
    """
    spark = files.sparkSession
    with tables.small_batches(spark):
        if "content" in files.columns:
            return tables.written(files.select(F.col("path").alias("file"), F.col("content").alias("text")).mapInArrow(_parts_of_files, _PART), "parts", **_SMALL).select(F.col("file").alias("path"), "size", "part", "text")
        exact = {"recursiveFileLookup": "true", "__globPaths__": "false"}  # the paths as they are
        make = spark._jvm.org.apache.hadoop.fs.Path
        codecs = spark._jvm.org.apache.hadoop.io.compress.CompressionCodecFactory(spark._jsc.hadoopConfiguration())
        found = {r["path"]: r["length"] <= 3 or codecs.getCodec(make(r["path"])) is not None for r in files.select("path", "length").collect()}  # a batch's files
        names = spark.createDataFrame([(make(p).toUri().toString(), p) for p in found] or [("", "")], "file string, path string")
        parts = spark.createDataFrame([], _PART)
        if lines := [p for p, whole in found.items() if not whole]:
            m = F.col("_metadata")
            read = spark.read.schema("line string").option("lineSep", "\n").options(**exact).format("text").load(lines)
            read = read.select(m["file_path"].alias("file"), m["file_size"].alias("size"), m["file_block_start"].alias("start"), F.col("line").cast("binary").alias("line"))
            parts = parts.unionByName(read.mapInArrow(_parts_of_lines, _PART))
        if whole := [p for p, whole in found.items() if whole]:
            read = spark.read.options(**exact).format("binaryFile").load(whole)
            read = read.select(F.col("_metadata.file_path").alias("file"), F.col("content").alias("text"))
            parts = parts.unionByName(read.mapInArrow(_parts_of_files, _PART))
        parts = tables.written(parts, "parts", **_SMALL)
        # Every line has got an end: the last one's is taken back where the file has none. A mark of UTF-8 before the first line, which the reader left out, comes back.
        ends = parts.groupBy("file").agg(F.max("part").alias("_last"), (F.sum("bytes") - F.max("size")).alias("_more"))
        ends = tables.written(ends.join(F.broadcast(names), "file"), "ends")
    marked = F.when((F.col("part") == 0) & F.col("_more").isin(-2, -3), F.concat(F.lit(b"\xef\xbb\xbf"), F.col("text"))).otherwise(F.col("text"))
    bare = F.when((F.col("part") == F.col("_last")) & F.col("_more").isin(1, -2), F.substring(marked, F.lit(1), F.octet_length(marked) - 1)).otherwise(marked)
    return parts.join(F.broadcast(ends), "file").select("path", "size", "part", bare.alias("text"))


def scan_url_lists(lines: DataFrame) -> DataFrame:
    """path, url of text files given by line (path, line): a file with a video URL gives its URLs, any other one row with a null url."""
    line = X.strip(F.col("line"))
    rows = lines.select("path", F.when(~F.startswith(line, F.lit("#")) & X.youtube_id(line).isNotNull(), line).alias("url"))
    some = F.max(F.col("url").isNotNull()).over(Window.partitionBy("path"))
    rows = rows.withColumn("listed", some)
    return rows.where("listed and url is not null").select("path", "url").unionByName(rows.where("not listed").select("path", F.lit(None).cast("string").alias("url")).distinct())


def route_by_type(docs: DataFrame, name: str = "source_name") -> DataFrame:
    """docs with doc_type (the extension) and handler (the first that takes it, null if none does)."""
    spark = docs.sparkSession
    table = spark.createDataFrame([(ext, h, i) for i, (h, exts) in enumerate(ROUTES.items()) for ext in exts], "_ext string, handler string, priority int")
    first = table.groupBy("_ext").agg(F.min_by("handler", "priority").alias("handler"))
    out = docs.withColumn("_e", extension(F.col(name))).join(F.broadcast(first), F.col("_e") == F.col("_ext"), "left")
    return out.withColumn("doc_type", F.nullif(F.regexp_replace("_e", r"^\.", ""), F.lit(""))).drop("_e", "_ext")


def archive_entries(archives: DataFrame, max_bytes: int = UPLOAD_MB << 20) -> DataFrame:
    """The manifest of archives (path, content): archive, entry, size, is_dir, bytes, position; one zip file is opened at a time.

    An entry is unpacked only if expand_archives can keep it: its handler is known, and its size as the archive tells it, and as
    it comes out, is at most max_bytes; else bytes are null. An archive that can't be read gives one row with a null entry.
    """
    known = {e for exts in ROUTES.values() for e in exts}

    def manifest(path: str, content: bytes) -> Iterator[dict]:
        try:
            with zipfile.ZipFile(io.BytesIO(content)) as z:
                for i, e in enumerate(z.infolist()):
                    name = e.filename.replace("\\", "/").rsplit("/", 1)[-1].lower()
                    wanted = not e.is_dir() and e.file_size <= max_bytes and "." in name and "." + name.rsplit(".", 1)[1] in known
                    size, raw = e.file_size, None
                    if wanted:
                        with z.open(e) as f:
                            raw = f.read(max_bytes + 1)
                        size, raw = (len(raw), None) if len(raw) > max_bytes else (size, raw)
                    yield {"archive": path, "entry": e.filename, "size": size, "is_dir": e.is_dir(), "bytes": raw, "position": i}
        except (zipfile.BadZipFile, zlib.error, EOFError, RuntimeError, NotImplementedError, OSError):
            yield {"archive": path, "entry": None, "size": 0, "is_dir": False, "bytes": None, "position": -1}

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, content in zip(batch["path"], batch["content"]):
                rows, held = [], 0
                for row in manifest(path, content):
                    rows.append(row)
                    held += len(row["bytes"] or b"")
                    if held > 64 << 20:
                        yield pd.DataFrame(rows)
                        rows, held = [], 0
                if rows:
                    yield pd.DataFrame(rows)

    return archives.select("path", "content").mapInPandas(read, schemas.ENTRIES)


def expand_archives(entries: DataFrame, max_bytes: int = UPLOAD_MB << 20, max_entries: int = ENTRIES) -> DataFrame:
    """entries with source_name and skip_reason (null: kept), by these rules in order: corrupt (an unreadable archive, null entry); folders and hidden or __MACOSX names are
    left out silently; over_limit (all that follows once max_entries are kept); unsupported; too_big; unsafe (leaves the archive)."""
    path = F.replace(F.coalesce("entry", F.lit("")), F.lit("\\"), F.lit("/"))
    name = F.regexp_extract(path, r"([^/]*)$", 1)
    rows = entries.withColumn("entry", path).where(~F.col("is_dir") & ~path.contains("__MACOSX") & ~F.startswith(name, F.lit(".")))
    known = [e for exts in ROUTES.values() for e in exts]
    early = F.when(F.col("entry") == "", "corrupt").when(~extension(F.col("entry")).isin(*known), "unsupported").when(F.col("size") > max_bytes, "too_big")
    unsafe = F.exists(F.split("entry", "/"), lambda p: p == "..")
    rows = rows.withColumn("early", early).withColumn("fits", F.col("early").isNull() & ~unsafe)
    order = Window.partitionBy("archive").orderBy("position")
    kept = F.coalesce(F.sum(F.col("fits").cast("int")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = rows.withColumn("stop", F.col("early").isNull() & (kept >= max_entries))
    over = F.max("stop").over(order.rowsBetween(Window.unboundedPreceding, 0))
    reason = F.when(over, "over_limit").when(F.col("early").isNotNull(), F.col("early")).when(~F.col("fits"), "unsafe")
    rows = rows.withColumn("skip_reason", reason)
    return rows.withColumn("source_name", F.regexp_replace("entry", "^/+", "")).drop("early", "fits", "stop")


def archive_report(expanded: DataFrame) -> DataFrame:
    n = lambda r: F.count_if(F.col("skip_reason") == r).alias(r)
    return expanded.groupBy("archive").agg(F.count_if(F.col("skip_reason").isNull()).alias("kept"), n("unsupported"), n("too_big"), n("unsafe"))


def read_jsonl(lines: DataFrame, schema: str = schemas.GOLDEN) -> DataFrame:
    """The rows of JSON lines (a column value); blank lines and those that begin with # are left out."""
    bare = lines.select(X.strip(F.col("value")).alias("v")).where("v <> '' and v not like '#%'")
    return bare.select(F.from_json("v", schema).alias("r")).select("r.*")


def enforce_size_limit(files: DataFrame, max_mb: int = UPLOAD_MB) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected) by length."""
    return files.where(F.col("length") <= max_mb << 20), files.where(F.col("length") > max_mb << 20)


def write_index(chunks: DataFrame, path: str, buckets: int = 64) -> VersionedTables:
    """Upserts chunks (collection, doc_id, chunk_id, …) by chunk_id into the table `chunks` of the versioned tables below path.

    Only the touched buckets are written anew. Of equal ids in chunks the greatest row by all columns wins; an id that moves to another document leaves no row behind.
    """
    index = VersionedTables(chunks.sparkSession, path, buckets)
    index.upsert("chunks", chunks, ["collection", "chunk_id"])
    return index


def preview(chunks: DataFrame) -> DataFrame:
    """chunk_id, doc_title, heading_path, char_count and the first 200 characters."""
    return chunks.select("chunk_id", "doc_title", "heading_path", "char_count", F.left("text", F.lit(200)).alias("preview"))


def write_preview(chunks: DataFrame, path: str) -> None:
    preview(chunks).write.mode("overwrite").json(path)


def write_eval_report(summary: DataFrame, items: DataFrame, path: str) -> None:
    summary.write.mode("overwrite").json(f"{path}/summary")
    items.write.mode("overwrite").json(f"{path}/items")


def read_eval_report(spark: SparkSession, path: str, summary: str, items: str) -> tuple[DataFrame, DataFrame]:
    """(summary, items) of a written report, by their schemas."""
    return spark.read.schema(summary).json(f"{path}/summary"), spark.read.schema(items).json(f"{path}/items")


def convert(files: DataFrame, converters: dict[str, Callable[[str, bytes], list[dict[str, str]]]]) -> DataFrame:
    """source_name, title, markdown, error of files (source_name, content), by a registry from extension to converter.

    A converter gets a name and bytes and gives documents with title and markdown. A file that no converter takes, or whose converter
    raises, gives one row with an error and no markdown. Converters are sent to the workers and run on one file at a time.
    """
    kinds = {ext.lower(): f for ext, f in converters.items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["source_name", "title", "markdown", "error"]
        for batch in batches:
            rows: list[tuple] = []
            for name, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                base = (name or "").rsplit("/", 1)[-1]
                own = kinds.get("." + base.rsplit(".", 1)[1].lower() if "." in base else "")
                try:
                    made = own(name, raw) if own else None
                    rows += [(name, d.get("title"), d["markdown"], None) for d in made] if made is not None else [(name, None, None, "no converter")]
                except Exception as e:  # any converter's own failure is that file's report
                    rows.append((name, None, None, f"{type(e).__name__}: {e}"))
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in (zip(*rows) if rows else [[]] * 4)], names)

    return files.select("source_name", "content").mapInArrow(run, "source_name string, title string, markdown string, error string")
