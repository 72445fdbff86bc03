"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from siltstone.llm import collocate, jaccard, linededup, mixing, rules, topk, vectorcodes
from siltstone.llm.collocate import op13_collocations
from siltstone.llm.fingerprint import op7_fingerprints
from siltstone.llm.jaccard import op3_ngram_jaccard
from siltstone.llm.langid import op8_language_id
from siltstone.llm.linededup import op5_line_dedup
from siltstone.llm.mixing import op4_mix_sources
from siltstone.llm.packing import op10_best_fit_packing
from siltstone.llm.quality import op6_quality
from siltstone.llm.rules import op11_quality_rules
from siltstone.llm.tokencount import op2_token_counts
from siltstone.llm.topk import op9_exact_top_k
from siltstone.llm.toxicity import op1_toxicity
from siltstone.llm.vectorcodes import op12_vector_codes

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_toxicity": op1_toxicity,
    "op2_token_counts": op2_token_counts,
    "op3_ngram_jaccard": op3_ngram_jaccard,
    "op4_mix_sources": op4_mix_sources,
    "op5_line_dedup": op5_line_dedup,
    "op6_quality": op6_quality,
    "op7_fingerprints": op7_fingerprints,
    "op8_language_id": op8_language_id,
    "op9_exact_top_k": op9_exact_top_k,
    "op10_best_fit_packing": op10_best_fit_packing,
    "op11_quality_rules": op11_quality_rules,
    "op12_vector_codes": op12_vector_codes,
    "op13_collocations": op13_collocations,
}

SQL: dict[str, str] = {
    "op3_ngram_jaccard": jaccard.SQL,
    "op4_mix_sources": mixing.SQL,
    "op5_line_dedup": linededup.SQL,
    "op9_exact_top_k": topk.SQL,
    "op11_quality_rules": rules.SQL,
    "op12_vector_codes": vectorcodes.SQL,
    "op13_collocations": collocate.SQL,
}
