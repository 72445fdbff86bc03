"""The registered queries over the reference tables and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from siltstone.plans import chunks, documents, flows, images, maintenance, retrieval


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every benchmark text as a question: its five best documents by BM25, with citation-ready sources."""
    return retrieval.ret16_sources(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
for _module in (documents, images, chunks, retrieval, maintenance, flows):
    QUERIES |= _module.QUERIES
    SQL |= _module.SQL
