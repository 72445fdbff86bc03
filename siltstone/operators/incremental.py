"""Keeping the index up to date: what changed, what went, what is replaced, and what was reported."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce
from typing import TYPE_CHECKING

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.functions import text as X

if TYPE_CHECKING:
    from siltstone.sources.versions import VersionedTables

KEY = ["collection", "doc_id"]
NAME = r"^[A-Za-z0-9_-]{1,64}\z"
FROZEN = ("embedder", "embedding_model", "dense_dim", "supports_sparse")


def classify_changes(incoming: DataFrame, state: DataFrame) -> DataFrame:
    """incoming (collection, doc_id, markdown, content_hash, n_chunks) with status: failed (no markdown or no chunk), skipped (same hash), new or updated."""
    old = state.select(*KEY, F.col("content_hash").alias("old_hash"))
    status = F.when(~X.has_text(F.col("markdown")) | (F.coalesce("n_chunks", F.lit(0)) == 0), "failed")
    status = status.when(F.col("old_hash").isNull(), "new").when(F.col("old_hash") == F.col("content_hash"), "skipped").otherwise("updated")
    return incoming.join(old, KEY, "left").withColumn("status", status).drop("old_hash")


def find_removed(state: DataFrame, scanned: DataFrame) -> DataFrame:
    """Documents of the state that the scan doesn't hold. A failed conversion is still in the scan and removes nothing."""
    return state.join(scanned.select(*KEY), KEY, "left_anti")


def replace_document_chunks(index: DataFrame, fresh: DataFrame) -> DataFrame:
    """index with all chunks of the documents in fresh replaced by theirs."""
    return index.join(fresh.select(*KEY).distinct(), KEY, "left_anti").unionByName(fresh)


def delete_documents(table: DataFrame, gone: DataFrame) -> DataFrame:
    return table.join(gone.select(*KEY).distinct(), KEY, "left_anti")


def upsert(table: DataFrame, fresh: DataFrame, keys: list[str]) -> DataFrame:
    """table with the rows of fresh in place of those with the same keys."""
    return table.join(fresh.select(*keys), keys, "left_anti").unionByName(fresh)


def reset_index(index: VersionedTables, fresh: Mapping[str, DataFrame]) -> dict[str, int]:
    """Every table of the index is emptied and those of fresh are filled, as one version; returns how many rows each lost."""
    return index.change(dict(fresh), reset=list(index.manifest().get("tables", {})))


def union_sources(*sources: DataFrame) -> DataFrame:
    """The documents of several sources (files, URLs, archives, tables) in one table: columns by name, null where a source lacks one; no row is dropped."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), sources)


def document_projection(documents: DataFrame, results: DataFrame) -> DataFrame:
    """documents (collection, doc_id, status, n_chunks, content_hash, error) after the last result (… seq) of each: skipped ones keep counts."""
    last = results.groupBy(*KEY).agg(F.max_by(F.struct("status", "n_chunks", "content_hash", "error"), "seq").alias("r"))
    both = documents.join(last, KEY, "full_outer")
    status = F.col("r.status")
    fresh = status.isin("new", "updated")
    pick = lambda name: F.when(fresh, F.col(f"r.{name}")).otherwise(F.col(name)).alias(name)
    shown = F.when(fresh, "indexed").when(status == "skipped", F.coalesce(F.col("status"), F.lit("indexed"))).when(status.isNotNull(), "failed").otherwise(F.col("status"))
    error = F.when(status.isin("new", "updated", "skipped"), F.lit(None).cast("string")).when(status.isNotNull(), F.col("r.error")).otherwise(F.col("error"))
    return both.select(*KEY, shown.alias("status"), pick("n_chunks"), pick("content_hash"), error.alias("error"))


def job_status(result: Column) -> Column:
    return F.when(result.isin("new", "updated"), "succeeded").when(result == "skipped", "skipped").otherwise("failed")


def ingest_report(statuses: DataFrame, removed: DataFrame) -> DataFrame:
    """One row of totals of statuses (status, n_chunks) and removed documents."""
    n = lambda s: F.count_if(F.col("status") == s)
    fresh = F.sum(F.when(F.col("status").isin("new", "updated"), F.col("n_chunks")).otherwise(0))
    own = statuses.agg(F.count("*").alias("sources"), n("new").alias("new"), n("updated").alias("updated"), n("skipped").alias("unchanged"), n("failed").alias("failed"), F.coalesce(fresh, F.lit(0)).cast("bigint").alias("chunks"))
    return own.crossJoin(removed.agg(F.count("*").alias("deleted")))  # one row each


def drop_collections(tables: dict[str, DataFrame], gone: DataFrame) -> dict[str, DataFrame]:
    """Every table (documents, jobs, chunks, images, …) without the rows of the collections in gone: the delete goes through all that hang on a collection."""
    return {name: drop_collection(table, gone) for name, table in tables.items()}


def drop_collection(table: DataFrame, gone: DataFrame) -> DataFrame:
    return table.join(gone.select("collection").distinct(), "collection", "left_anti")


def index_ids(index: DataFrame) -> DataFrame:
    """collection, doc_id, chunks, doc_hash (the first chunk's) of the index, one row a document."""
    return index.groupBy(*KEY).agg(F.count("*").alias("chunks"), F.min_by("content_hash", "chunk_index").alias("doc_hash"))


def effective_settings(collections: DataFrame, defaults: dict) -> DataFrame:
    """collections with every default in place of a null setting."""
    own = [F.coalesce(F.col(k) if k in collections.columns else F.lit(None), F.lit(v)).alias(k) for k, v in defaults.items()]
    return collections.select(*[c for c in collections.columns if c not in defaults], *own)


def validate_collections(existing: DataFrame, changes: DataFrame) -> DataFrame:
    """name, error for each change (op: create or update, name, FROZEN columns, null: unchanged) that isn't allowed."""
    old = existing.select(F.col("name"), *[F.col(c).alias(f"old_{c}") for c in FROZEN], F.lit(True).alias("there"))
    both = changes.join(old, "name", "left")
    moved = F.lit(False)
    for c in FROZEN:
        moved = moved | F.coalesce(F.col(c) != F.col(f"old_{c}"), F.lit(False))
    error = F.when(~F.coalesce(F.col("name").rlike(NAME), F.lit(False)), "invalid name").when((F.col("op") == "create") & F.col("there"), "duplicate")
    error = error.when((F.col("op") == "update") & F.col("there").isNull(), "unknown").when((F.col("op") == "update") & moved, "frozen")
    return both.select("op", "name", error.alias("error")).where("error is not null")
