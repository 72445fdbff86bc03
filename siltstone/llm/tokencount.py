"""Token counts of whole texts: Arrow functions that return lengths only."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.llm import common

#: Tokens beyond which a text is over the limit.
LIMIT = 1024


def count_tokens(docs: DataFrame, tokenizer: str, text: str = "text", limit: int = LIMIT) -> DataFrame:
    """docs with n_bytes (UTF-8), n_tokens (no special tokens added) and over_limit (n_tokens > limit).

    tokenizer: path of a byte-level BPE file on every worker. Arrow batches are bounded by bytes
    (8 MB) and encoded in runs of about 1 MB; within one, texts are split at safe boundaries and each distinct piece is encoded once
    (encode.py). Only lengths go back to Spark. There is no shuffle.

    Null and empty texts have 0 bytes and 0 tokens. Repeated rows get the same figures. Columns of docs stay; those
    named n_bytes, n_tokens or over_limit are replaced. An empty table gives an empty table.
    """

    @F.arrow_udf("bigint")
    def lengths(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        from siltstone.llm.encode import encoder

        own = encoder(tokenizer)
        for batch in batches:
            yield pa.array(own.encode(batch, want_ids=False)[0], pa.int64())

    common.arrow_batches(docs.sparkSession)
    whole = F.coalesce(F.col(text), F.lit(""))
    kept = docs.select(*[c for c in docs.columns if c not in ("n_bytes", "n_tokens", "over_limit")])
    counted = kept.withColumn("n_bytes", F.octet_length(whole).cast("bigint")).withColumn("n_tokens", lengths(whole))
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    return count_tokens(docs, public_tokenizers.path("byte_bpe_50k.json")).select("doc_id", "n_bytes", "n_tokens", "over_limit")
