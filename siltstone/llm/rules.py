"""Quality rules as a ledger of failure bits, in DataFrame functions only: measured once, judged by policies, ablated by bitwise aggregation."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.llm import common

#: Words of the windows that count as repeated.
WINDOW = 3


class Rule(NamedTuple):
    """A rule's name and when a document fails it, as a condition over the measurements. Its bit is its place among the rules."""

    name: str
    fails: str


RULES = (
    Rule("few_words", "n_words < 50"),
    Rule("repeated_words", "100 * n_repeat_words > 50 * n_words"),
    Rule("symbols", "10 * n_symbols > n_words"),
    Rule("repeated_lines", "100 * n_dup_lines > 30 * n_lines"),
    Rule("short_words", "word_chars < 2 * n_words"),
    Rule("long_words", "word_chars > 20 * n_words"),
    Rule("many_words", "n_words > 1000000"),
)
#: Versioned policies: which rules reject. A version is never changed, only followed by another.
BASE = ("few_words", "repeated_words")
POLICIES: dict[str, Sequence[str]] = {
    "base": BASE,
    "v1": (*BASE, "symbols"),
    "v2": (*BASE, "symbols", "repeated_lines", "short_words", "long_words"),
}
CURRENT = "v1"
MEASURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")


def let(value: Column, then: Callable[[Column], Column]) -> Column:
    """then(value), with value evaluated once however often `then` names it."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def repeat_words(words: Column, window: int = WINDOW) -> Column:
    """How many of the words lie in a window of `window` words that stands twice or more among them (compared by 64-bit hashes).

    Windows are sorted by hash, so that equal ones are neighbours; the places of these are sorted again, and each place covers the words
    up to the next one, `window` at most: n log n in the words, however often a window repeats.
    """

    def covered(hashes: Column) -> Column:
        placed = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        twice = lambda s: F.filter(s, lambda x, i: (x["h"] == F.get(s, i - 1)["h"]) | (x["h"] == F.get(s, i + 1)["h"]))
        places = let(placed, lambda s: F.sort_array(F.transform(twice(s), lambda x: x["i"])))
        steps = let(places, lambda p: F.transform(p, lambda x, i: F.least(F.lit(window), F.coalesce(F.get(p, i + 1) - x, F.lit(window)))))
        return F.aggregate(steps, F.lit(0).cast("bigint"), lambda a, x: a + x)

    own = F.transform(words, lambda w: F.xxhash64(w))
    several = lambda w: F.transform(F.slice(w, 1, F.size(w) - (window - 1)), lambda h, i: F.xxhash64(h, *[F.get(w, i + j) for j in range(1, window)]))
    some = lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("bigint")).otherwise(covered(h))
    return F.when(F.size(words) < window + 1, F.lit(0).cast("bigint")).otherwise(let(let(own, several), some))


def measured(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with the MEASURES of its whole texts (null: empty), which replace columns of these names.

    Words are runs without space or \\t to \\r. word_chars: their code points; n_symbols: characters of `#*$%&|<>`; n_lines: \\n-split lines with a word; n_dup_lines:
    those equal to an earlier one; n_repeat_words: words in windows of three that stand twice or more.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    lines = F.filter(F.split(t, "\n", -1), lambda x: F.regexp_like(x, F.lit(common.WORD)))
    names = [c for c in docs.columns if c.lower() not in MEASURES]
    hold = {n: common.fresh(n, docs.columns) for n in ("words", "lines")}
    held = docs.select(*names, F.col(text).alias(common.fresh("text", docs.columns)) if text not in names else F.col(text), F.regexp_extract_all(t, F.lit(common.WORD), F.lit(0)).alias(hold["words"]), lines.alias(hold["lines"]))
    words, own = F.col(hold["words"]), F.col(hold["lines"])
    long = lambda c: c.cast("bigint")
    measures = {
        "n_words": long(F.size(words)),
        "word_chars": long(F.length(F.array_join(words, ""))),
        "n_symbols": long(F.regexp_count(t, F.lit(r"[#*$%&|<>]"))),
        "n_lines": long(F.size(own)),
        "n_dup_lines": long(F.size(own) - F.size(F.array_distinct(own))),
        "n_repeat_words": repeat_words(words),
    }
    return held.select(*names, *[c.alias(n) for n, c in measures.items()])


def ledger(measures: DataFrame, rules: Sequence[Rule] = RULES) -> DataFrame:
    """measures with `failed`: bit i is set where rules[i] fails. Every rule is evaluated once; a condition that is null is no failure."""
    if len(rules) > 63 or len({r.name for r in rules}) < len(rules):
        raise ValueError("at most 63 rules of different names")
    bits = F.lit(0).cast("bigint")
    for i, rule in enumerate(rules):
        bits = bits.bitwiseOR(F.when(F.expr(rule.fails), F.lit(1 << i)).otherwise(F.lit(0)).cast("bigint"))
    return measures.select(*[c for c in measures.columns if c.lower() != "failed"], bits.alias("failed"))


def mask(names: Sequence[str], rules: Sequence[Rule] = RULES) -> int:
    """The bits of the rules with these names."""
    bit = {r.name: 1 << i for i, r in enumerate(rules)}
    return sum(bit[n] for n in set(names))


def keeps(names: Sequence[str], rules: Sequence[Rule] = RULES, failed: str = "failed") -> Column:
    """Whether a document of a ledger passes a policy: it fails none of its rules."""
    return F.col(failed).bitwiseAND(F.lit(mask(names, rules)).cast("bigint")) == 0


def ablations(kept: DataFrame, policies: Mapping[str, Sequence[str]] = POLICIES, rules: Sequence[Rule] = RULES, weight: str | None = None) -> DataFrame:
    """For each policy and each of its rules over a ledger: policy, rule, docs, kept (by the policy), fails (documents that fail the rule),
    alone (those it alone rejects: what leaving it out would keep besides), and the same of `weight` (a column, summed) as *_weight.

    Documents are first counted by their failure bits, of which there are few; policies are then judged on the counts.
    """
    w = F.lit(0).cast("bigint") if weight is None else F.coalesce(F.col(weight), F.lit(0)).cast("bigint")
    by = kept.groupBy("failed").agg(F.count("*").alias("n"), F.sum(w).alias("w"))
    every = [F.struct(F.lit(p).alias("policy"), F.lit(name).alias("rule"), F.lit(mask(names, rules)).cast("bigint").alias("all"), F.lit(mask([name], rules)).cast("bigint").alias("bit")) for p, names in policies.items() for name in names]
    if not every:
        raise ValueError("no policy has a rule")
    rows = by.select("failed", "n", "w", F.explode(F.array(*every)).alias("r")).select("failed", "n", "w", "r.*")
    hit = F.col("failed").bitwiseAND(F.col("all"))
    cases = {"docs": F.lit(True), "kept": hit == 0, "fails": F.col("failed").bitwiseAND(F.col("bit")) != 0, "alone": hit == F.col("bit")}
    total = lambda case, c: F.coalesce(F.sum(F.when(case, F.col(c))), F.lit(0)).cast("bigint")
    return rows.groupBy("policy", "rule").agg(*[total(c, "n").alias(k) for k, c in cases.items()], *[total(c, "w").alias(f"{k}_weight") for k, c in cases.items()])


def op11_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """kept by the CURRENT policy. Rows of null or equal ids are rows of their own; an empty table gives no rows."""
    rows = ledger(measured(common.table(spark, sf_dir, "documents").select("doc_id", "text")))
    rows = rows.withColumns({"base_failed": ~keeps(BASE), "kept": keeps(POLICIES[CURRENT])})
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "failed")


SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS k, doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM documents
), win AS (
  SELECT k, unnest(range(1, len(w) - 1)) AS i, unnest(list_transform(range(1, len(w) - 1), lambda j: w[j:j + 2])) AS g FROM d WHERE len(w) > 2
), twice AS (
  SELECT k, i, count(*) OVER (PARTITION BY k, g) AS c FROM win
), covered AS (
  SELECT k, count(DISTINCT i + o) AS n FROM twice, (SELECT unnest(range(3)) AS o) WHERE c > 1 GROUP BY k
), m AS (
  SELECT doc_id, len(w) AS n_words, length(t) - len(regexp_extract_all(t, '[\x20\x09-\x0D]')) AS word_chars, len(regexp_extract_all(t, '[#*$%&|<>]')) AS n_symbols,
    len(lines) AS n_lines, len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(n, 0) AS n_repeat_words
  FROM d LEFT JOIN covered USING (k)
), b AS (
  SELECT *, (n_words < 50)::BIGINT + 2 * (100 * n_repeat_words > 50 * n_words)::BIGINT + 4 * (10 * n_symbols > n_words)::BIGINT + 8 * (100 * n_dup_lines > 30 * n_lines)::BIGINT
    + 16 * (word_chars < 2 * n_words)::BIGINT + 32 * (word_chars > 20 * n_words)::BIGINT + 64 * (n_words > 1000000)::BIGINT AS failed FROM m
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (failed & 3) <> 0 AS base_failed, (failed & 7) = 0 AS kept, failed FROM b
"""
