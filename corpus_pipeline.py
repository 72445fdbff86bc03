"""The corpus pipeline: five stages over documents, each written as Parquet and reread.

Every stage takes nulls in any column, empty and very long texts, repeated rows, ties and empty tables (they give empty
tables), and drops columns other than those of documents, whatever their names.

Toxic documents go; later repeats of line runs go; one document of each group of near duplicates stays (documents that share an
id, or have none, are told apart by their text); sources are mixed
to their targets (a document taken twice is two rows); what is left is packed into sequences.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.llm import common, jaccard, linededup, mixing, packing, toxicity

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that op1's model, trained on the labels of its training rows, predicts to be toxic."""
    docs = docs.select(*COLUMNS)
    cost = toxicity.train_characters(docs)
    learn = F.coalesce(common.fold("doc_id", 3) != 1, F.lit(False))
    lexicon = toxicity.train_lexicon(docs.where(learn), common.table(spark, sf_dir, "labels").where(learn), cost)
    return toxicity.score_toxicity(docs, cost, lexicon).where("predicted = 0").select(*COLUMNS)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without later repeats of runs of lines; no document goes, n_chars follows the text."""
    return linededup.dedup_lines(docs.select(*COLUMNS)).withColumn("n_chars", F.length("text").cast("bigint")).select(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of the smallest doc_id of each component (null ids last, then by a hash of the row).

    Where an id is null or repeated, each distinct text is a document of its own, of which one row stays. Texts without
    words link with nothing: all their rows stay.
    """
    return jaccard.one_of_each(docs.select(*COLUMNS))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix takes, as often as it takes them, range-sorted by their virtual finish time.

    Null and empty texts and those of white space alone have no words and are never taken; null sources are a source.
    """
    return mixing.mixed(docs.select(*COLUMNS).withColumn("size", mixing.word_count())).select(*COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their place in sequences."""
    import public_tokenizers

    return packing.pack(packing.token_pieces(docs, public_tokenizers.path("byte_bpe_50k.json")))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_repeated_lines),
    ("ngram_jaccard", drop_near_duplicates),
    ("mix_sources", mix),
    ("best_fit_packing", pack),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.document_columns(common.table(spark, sf_dir, "documents"))
    for _, stage in STAGES:
        docs = common.settle(stage(spark, docs, sf_dir))
    return docs
