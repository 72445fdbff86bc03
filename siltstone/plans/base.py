"""What the registered queries share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.operators.tables import exists, shared_path as scratch  # noqa: F401


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def source_name() -> Column:
    """A file name for a row of documents."""
    return F.concat(F.col("source"), F.lit("/doc_"), F.col("doc_id").cast("string"), F.lit(".md"))


SOURCE_SQL = "source || '/doc_' || CAST(doc_id AS VARCHAR) || '.md'"


def markdown() -> Column:
    """The text of documents with a title, headings by line number, blank lines and, for every third id, an image and a link."""
    line = lambda x, i: F.concat(
        F.when(i % 7 == 3, F.concat(F.lit("## "), F.col("lang"), F.lit(" "), i.cast("string"), F.lit("\n\n"))).when(i % 7 == 5, F.concat(F.lit("### part "), i.cast("string"), F.lit("\n\n"))).otherwise(""), x
    )
    body = F.array_join(F.transform(F.split("text", "\n"), line), "\n\n")
    tail = F.concat(F.lit("\n\n![alt "), F.col("source"), F.lit("](rag-image://c/doc_"), F.col("doc_id").cast("string"), F.lit("/x.png) https://ex.com/"), F.col("doc_id").cast("string"))
    return F.concat(F.lit("# "), F.col("source"), F.lit("\n\n"), body, F.when(F.col("doc_id") % 3 == 0, tail).otherwise(""))


MARKDOWN_SQL = (
    "'# ' || source || chr(10) || chr(10) || array_to_string(list_transform(string_split(text, chr(10)), lambda x, i: "
    "CASE WHEN (i - 1) % 7 = 3 THEN '## ' || lang || ' ' || CAST(i - 1 AS VARCHAR) || chr(10) || chr(10) "
    "WHEN (i - 1) % 7 = 5 THEN '### part ' || CAST(i - 1 AS VARCHAR) || chr(10) || chr(10) ELSE '' END || x), chr(10) || chr(10)) "
    "|| CASE WHEN doc_id % 3 = 0 THEN chr(10) || chr(10) || '![alt ' || source || '](rag-image://c/doc_' || CAST(doc_id AS VARCHAR) || '/x.png) https://ex.com/' || CAST(doc_id AS VARCHAR) ELSE '' END"
)


def flat(c: Column) -> Column:
    return F.array_join(c, "|")
