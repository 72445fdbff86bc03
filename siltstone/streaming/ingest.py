"""Ingestion that ends in an index: each micro-batch of files is classified, chunked, embedded and published as one version."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from siltstone.functions import text as X
from siltstone.operators import chunk, incremental, index, tables
from siltstone.sources import files as S
from siltstone.sources.versions import DOCUMENT, VersionedTables
from siltstone.streaming import streams

#: What a job reports, in order: files read, vectors made, chunk rows written, documents settled.
STAGES = ("parsing", "embedding", "indexing", "done")
PROGRESS = "stream string, batch bigint, stage string, rows bigint"
#: As X.title_from_h1: a line's `#` and what follows the white space after it, on its line or a later one.
_TITLE = re.compile(r"(?m)^#\s+(?:(\S.*)|\Z)", re.ASCII)


def folder_of(path: Column) -> Column:
    """The name of a file's folder, without `name=` of a partition folder: the collection where no rule is given."""
    return F.regexp_extract(path, r"([^/=]*)/[^/]*$", 1)


def single_chunks(docs: DataFrame) -> DataFrame:
    """A chunker that makes each non-blank line a chunk. Lines are dealt by place, so that a giant document's go to many tasks. With a column `part` a document may be many rows, cut at ends of lines."""
    own, before = docs.select("doc_id", *(["part"] if "part" in docs.columns else []), F.filter(F.split("markdown", "\n"), X.has_text).alias("lines")), F.lit(0)
    if "part" in docs.columns:
        key, so_far = F.struct("doc_id", "part").alias("_key"), Window.partitionBy("doc_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
        counts = own.select("doc_id", "part", F.size("lines").alias("n"))
        counts = tables.written(counts.select(key, F.coalesce(F.sum("n").over(so_far), F.lit(0)).cast("int").alias("before")), "counts")
        own, before = own.withColumn("_key", key).join(counts, "_key"), F.col("before")
    lines = own.select("doc_id", before.alias("_before"), F.posexplode("lines").alias("_at", "text")).select("doc_id", (F.col("_before") + F.col("_at")).alias("chunk_index"), "text").repartition("doc_id", "chunk_index")
    return lines.select("doc_id", "chunk_index", F.array().cast("array<string>").alias("heading_path"), F.lit("").alias("page_or_section"), "text", F.length("text").alias("char_count"))


def _read_through(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """path, size, h1, content_hash of texts (path, size, text) in order of path and part: what must be read from the first byte to the last. Texts that can't be decoded or are blank have no hash."""
    at, out = None, []

    def put() -> None:
        if at is not None:
            good = valid and filled
            out.append((*at, title.strip(chunk.SPACE) if good and title else None, own.hexdigest() if good else None))

    def batch() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.string(), pa.int64(), pa.string(), pa.string()))], ["path", "size", "h1", "content_hash"])

    for rows in batches:
        out = []
        for path, size, raw in zip(*(rows.column(n).to_pylist() for n in ("path", "size", "text"))):
            if (path, size) != at:
                put()
                at, own, valid, filled, title, awaited = (path, size), hashlib.sha256(), True, False, None, False
            own.update(raw)
            try:
                text = raw.decode() if valid else ""
            except UnicodeDecodeError:
                text, valid = "", False
            filled = filled or text.strip(chunk.SPACE) != ""
            if awaited and (rest := text.lstrip(" \t\n\x0b\x0c\r")):
                title, awaited = rest.split("\n", 1)[0], False
            elif not awaited and title is None and "#" in text and (found := _TITLE.search(text)):
                title, awaited = found[1], found[1] is None
        if out:
            yield batch()
    out = []
    put()
    if out:
        yield batch()


class Ingestion:
    """Takes micro-batches of files (path, name, content) into versioned tables: documents, chunks, dense and progress.

    A batch is published at once under its number, so one that comes again after a restart changes nothing, and one that broke off before leaves nothing to see. A file
    that can't be decoded, is blank or gives no chunk is a failed row of `documents` with an error, and what was indexed of it before
    stays; a file whose content is what the index holds is skipped; of files of one name in a batch the last by path counts. progress holds the rows of each stage of each batch.

    A file is read by its path, in parts (text_parts), unless `content` is given: no task holds the text of a large one. The chunker gets documents as parts: doc_id, title, part, markdown.
    """

    def __init__(
        self, path: str, name: str = "ingest", collection: Callable[[Column], Column] = folder_of, chunker: Callable[[DataFrame], DataFrame] = chunk.chunk_documents,
        embedder: Callable[[list[str]], np.ndarray] = index.hashed_embedding, buckets: int = 64, step: Callable[[str], None] | None = None,
    ):
        self.path, self.name, self.collection, self.chunker, self.embedder, self.buckets, self.step = path, name, collection, chunker, embedder, buckets, step

    def tables(self, spark: SparkSession) -> VersionedTables:
        return VersionedTables(spark, self.path, self.buckets, {"progress": ["stream"]})

    def _documents(self, files: DataFrame) -> DataFrame:
        """files with collection, doc_id and source_name, one row a document."""
        docs = files.withColumns({"collection": self.collection(F.col("path")), "doc_id": X.doc_id(F.col("path")), "source_name": F.col("name")})
        last = F.row_number().over(Window.partitionBy(*DOCUMENT).orderBy(F.desc("path")))
        return docs.withColumn("last", last).where("last = 1").drop("last")

    def _parsed(self, docs: DataFrame, parts: DataFrame) -> DataFrame:
        """collection, doc_id, source_name, path, bytes, title, content_hash (null if the file can't be decoded or is blank), one row a document."""
        dealt = parts.repartition("path").sortWithinPartitions("path", "part").select("path", "size", "text")
        read = dealt.mapInArrow(_read_through, "path string, size bigint, h1 string, content_hash string")
        docs = docs.select(*DOCUMENT, "source_name", "path").join(read, "path", "left")
        title = F.coalesce(F.nullif("h1", F.lit("")), F.regexp_replace("source_name", r"\.[^.]*$", ""))
        return docs.select(*DOCUMENT, "source_name", "path", F.col("size").alias("bytes"), title.alias("title"), "content_hash")

    def batch(self, files: DataFrame, number: int) -> None:
        """Takes one batch in: the function of foreachBatch."""
        own = self.tables(files.sparkSession)
        if own.applied((self.name, number)):
            return
        seen = {stage: Observation(f"{self.name}_{stage}") for stage in STAGES}

        def observed(df: DataFrame, stage: str) -> DataFrame:
            return tables.written(df.observe(seen[stage], F.count(F.lit(1)).alias("rows")), stage, **tables.DENSE)

        docs = self._documents(files)
        parts = S.text_parts(docs)
        with tables.small_batches(files.sparkSession):
            parsed = observed(self._parsed(docs, parts), "parsing")
        held = own.table("documents")
        state = parsed.select(*DOCUMENT, "content_hash").limit(0) if held is None else held.where("content_hash is not null").select(*DOCUMENT, "content_hash")
        found = incremental.classify_changes(parsed.withColumns({"n_chunks": F.lit(1), "markdown": F.col("content_hash")}), state)  # a hash stands for a text
        found = tables.written(found.drop("markdown", "n_chunks"), "found")
        fresh = found.where("status in ('new', 'updated')")
        going = fresh.select(*DOCUMENT)
        named = fresh.select("path", F.to_json(F.struct(*DOCUMENT)).alias("doc_id"), "title")
        chunks = self.chunker(parts.join(F.broadcast(named), "path").select("doc_id", "title", "part", F.col("text").cast("string").alias("markdown")))
        key = F.from_json("doc_id", "collection string, doc_id string").alias("key")
        chunks = chunks.select(key, "*").select(*[f"key.{c}" for c in DOCUMENT], *[c for c in chunks.columns if c != "doc_id"])
        rows = observed(chunks.withColumn("chunk_id", X.chunk_id(F.concat_ws("/", *DOCUMENT), F.col("chunk_index"))), "indexing")
        dense = observed(index.embed(rows, self.embedder, carried=DOCUMENT), "embedding")
        n = rows.groupBy(*DOCUMENT).agg(F.count("*").alias("n_chunks"))
        old = parsed.select(*DOCUMENT).limit(0).withColumns({"n_chunks": F.lit(0).cast("bigint"), "content_hash": F.lit("")}) if held is None else held.select(*DOCUMENT, "n_chunks", "content_hash")
        done = found.join(n, list(DOCUMENT), "left")
        done = done.withColumn("status", F.when(F.col("status").isin("new", "updated") & F.col("n_chunks").isNull(), "failed").otherwise(F.col("status")))
        was = old.select(*DOCUMENT, F.col("n_chunks").alias("_n"), F.col("content_hash").alias("_hash"))
        done = done.join(was, list(DOCUMENT), "left")
        stays = ~F.col("status").isin("new", "updated")
        done = observed(done.select(
            *DOCUMENT, "source_name", "path", "bytes", "title", F.when(F.col("status") == "failed", "failed").otherwise("indexed").alias("status"),
            F.when(stays, F.coalesce("_n", F.lit(0).cast("bigint"))).otherwise(F.col("n_chunks")).alias("n_chunks"), F.when(stays, F.col("_hash")).otherwise(F.col("content_hash")).alias("content_hash"),
            F.when(F.col("status") == "failed", "not decoded, blank or without a chunk").alias("error"), F.lit(number).cast("bigint").alias("batch"),
        ), "done")
        told = [(self.name, number, stage, int(seen[stage].get["rows"])) for stage in STAGES]
        changed = done.where("status = 'indexed'").join(going, list(DOCUMENT), "left_semi")
        changed = tables.written(changed.select(*DOCUMENT), "changed")
        own.change(
            {"documents": done, "chunks": rows, "dense": dense, "progress": files.sparkSession.createDataFrame(told, PROGRESS)},
            {"documents": (done, DOCUMENT), "chunks": (changed, DOCUMENT), "dense": (changed, DOCUMENT)}, mark=(self.name, number), step=self.step,
        )

    def run(self, files: DataFrame, checkpoint: str) -> StreamingQuery:
        """Drains a stream of files (landing_stream)."""
        return streams.ingest_stream(files.drop("content"), self.batch, checkpoint)

    def progress(self, spark: SparkSession) -> DataFrame:
        """stream, batch, stage, rows of all batches."""
        found = self.tables(spark).table("progress")
        return spark.createDataFrame([], PROGRESS) if found is None else found
