"""Phrase collocations by Rabin-Karp fingerprints: hash every n-gram, count fingerprints, materialise the frequent phrases."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siltstone.llm import common, words

#: Occurrences of a frequent phrase, words of the longest one, phrases reported for a language.
LEAST, MOST_WORDS, TOP = 100, 5, 2000
#: Bytes of text hashed at once; fingerprints a task gathers before it counts them.
RUN, HELD = 2 << 20, 4 << 20
#: Bits of a filter for one frequent fingerprint, and of the whole filter at most (32 MB): a full filter lets more through and loses nothing.
BITS_EACH, MOST_BITS = 16, 28
#: Parts in which the phrases of a language are ranked first.
SALTS = 32
UNKNOWN = "und"

WORD, BLANK, BREAK = 0, 1, 2
KIND = np.zeros(256, np.uint8)
KIND[[0x20, 0x09]] = BLANK
KIND[[*b".,;:!?", *range(0x0A, 0x0E)]] = BREAK
BASE = 0x9E3779B97F4A7C15
_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """The first n powers of base modulo 2**64."""
    if len(_powers.get(base, ())) < n:
        table = np.full(max(n, RUN + 1), base, np.uint64)
        table[0] = 1
        _powers[base] = np.multiply.accumulate(table)
    return _powers[base][:n]


def prefix_hashes(values: np.ndarray) -> np.ndarray:
    """P with P[b] - P[a] = sum of values[j] * BASE**j over a <= j < b."""
    out = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * powers(BASE, len(values)), out=out[1:])
    return out


def span_hashes(prefix: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The polynomial hash of each span [a, b), wherever it stands: shifted to power 0 by the inverse of BASE."""
    return (prefix[b] - prefix[a]) * powers(pow(BASE, -1, 1 << 64), len(prefix))[a]


def cuts(text: np.ndarray, most: int, keep: int) -> Iterator[tuple[int, int, int]]:
    """(start, end, skip): parts of one text of about `most` bytes, cut after breaks, or else between words.

    A part that was cut between words is followed by one that begins with its last `keep` words; windows that lie within these
    (whose last word is one of the first `skip`) are counted already. A word is never cut.
    """
    at, skip, size = 0, 0, most
    while at + size < len(text):
        kind = KIND[text[at : at + size]]
        breaks, blank = np.flatnonzero(kind == BREAK), kind == BLANK
        if len(breaks):
            yield at, at + int(breaks[-1]) + 1, skip
            at, skip, size = at + int(breaks[-1]) + 1, 0, most
            continue
        first = np.flatnonzero(~blank & np.append(True, blank[:-1]))
        end = int(np.flatnonzero(blank)[-1]) if blank.any() else 0
        first = first[first < end]
        if len(first) > keep + skip:
            yield at, at + end, skip
            at, skip, size = at + int(first[-keep]), keep, most
        else:
            size *= 2
    yield at, len(text), skip


class Spans:
    """The words of some texts (lower-cased bytes, offsets of rows): where they stand, their piece, their hashes."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, lang: np.ndarray, skip: int = 0, bits: int = 64):
        self.low, self.skip, self.bits = words.LOWER[data], skip, np.uint64(64 - bits)
        kind = KIND[data]
        inside = kind == WORD
        first, last = inside.copy(), inside.copy()
        first[1:] &= ~inside[:-1]
        last[:-1] &= ~inside[1:]
        begins, ends = offsets[:-1][offsets[:-1] < len(data)], offsets[1:][offsets[1:] > 0] - 1
        first[begins], last[ends] = inside[begins], inside[ends]
        self.start, self.end = np.flatnonzero(first), np.flatnonzero(last) + 1
        row = np.searchsorted(offsets, self.start, "right") - 1
        self.piece = np.cumsum(kind == BREAK)[self.start] + row
        self.lang = lang[row]
        self.hash = words.mix(span_hashes(prefix_hashes(self.low + np.uint64(1)), self.start, self.end))
        self.prefix = prefix_hashes(self.hash)

    def windows(self, n: int) -> np.ndarray:
        """The first words of all windows of n words within a piece that aren't counted already."""
        m = max(0, len(self.start) - n + 1)
        found = np.flatnonzero(self.piece[n - 1 :][:m] == self.piece[:m])
        return found[found + n - 1 >= self.skip] if self.skip else found

    def keys(self, n: int, at: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """64-bit fingerprints of language, n and words."""
        return words.mix(span_hashes(self.prefix, at, at + n) + codes[self.lang[at]] + np.uint64(n)) >> self.bits

    def survivors(self, n: int, codes: np.ndarray, filters: dict[int, Filter]) -> np.ndarray:
        """Windows of n words of which every shorter window with a filter (1 and 2 words) may be frequent."""
        at = self.windows(n)
        for m in (m for m in filters if m < min(n, 3)):
            every = np.zeros(len(self.start), bool)
            if n > 1 and len(self.start) >= m:
                own = np.arange(len(self.start) - m + 1)
                every[own] = filters[m].may_hold(self.keys(m, own, codes))
            for j in range(n - m + 1):
                at = at[every[at + j]]
        return at

    def ids(self, spans: np.ndarray) -> np.ndarray:
        """Numbers of the words `spans`: equal for equal words only. Hashes tell words apart, bytes confirm it."""
        _, rep, number = np.unique(self.hash[spans], return_index=True, return_inverse=True)
        length = self.end[spans] - self.start[spans]
        own, other = spans, spans[rep][number]
        same = length == self.end[other] - self.start[other]
        if same.all():
            step = np.arange(int(length.sum())) - np.repeat(np.cumsum(length) - length, length)
            wrong = self.low[np.repeat(self.start[own], length) + step] != self.low[np.repeat(self.start[other], length) + step]
            if not wrong.any():
                return number
        known: dict[bytes, int] = {}
        return np.array([known.setdefault(self.low[self.start[i] : self.end[i]].tobytes(), len(known)) for i in spans], np.int64)

    def phrase(self, at: int, n: int) -> bytes:
        return b" ".join(self.low[self.start[i] : self.end[i]].tobytes() for i in range(at, at + n))

    def counted(self, n: int, at: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(first occurrence, count) of each phrase among the windows `at`.

        Windows of equal fingerprint are compared, word for word, with the occurrence that their fingerprint points to; those that differ
        are collisions and are counted among themselves.
        """
        if not len(at):
            return at, at
        _, rep, group = np.unique(np.append(keys, 0), return_index=True, return_inverse=True)
        group = group[:-1]
        touched = np.zeros(len(self.start) + 1, np.int64)
        np.add.at(touched, at, 1)
        np.add.at(touched, at + n, -1)
        spans = np.flatnonzero(np.cumsum(touched)[:-1] > 0)
        number = np.zeros(len(self.start), np.int64)
        number[spans] = self.ids(spans)
        pointer = at[np.minimum(rep, len(at) - 1)][group]
        same = (self.lang[at] == self.lang[pointer]) & np.all([number[at + j] == number[pointer + j] for j in range(n)], axis=0)
        good = np.bincount(pointer[same], minlength=len(self.start))
        first = np.flatnonzero(good)
        odd: dict[tuple, list[int]] = {}
        for i in at[~same].tolist():
            odd.setdefault((int(self.lang[i]), *number[i : i + n].tolist()), []).append(i)
        return np.append(first, [v[0] for v in odd.values()]).astype(np.int64), np.append(good[first], [len(v) for v in odd.values()]).astype(np.int64)


class Filter:
    """A set of fingerprints as bits addressed by their leading bits; it may hold others too."""

    def __init__(self, table: np.ndarray, bits: int, key_bits: int = 64):
        self.table, self.shift = table, np.uint64(key_bits - bits)

    def may_hold(self, keys: np.ndarray) -> np.ndarray:
        at = keys >> self.shift
        return (self.table[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8) & 1).astype(bool)


def _texts(batches: Iterator[pa.RecordBatch], bits: int) -> Iterator[tuple[Spans, np.ndarray, list[str]]]:
    """The words of each run of texts (lang, text), with a code for each language of the run and its names."""
    for batch in batches:
        names, row = np.unique(np.array(batch.column(0).to_pylist(), object), return_inverse=True)
        codes = np.array([int.from_bytes(hashlib.md5(x.encode()).digest()[:8], "little") for x in names], np.uint64)
        data, offsets = words.utf8(batch.column(1))
        for lo, hi in words.runs(offsets, RUN):
            own, at = data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
            if len(own) <= RUN:
                yield Spans(own, at, row[lo:hi], 0, bits), codes, list(names)
            else:
                for a, b, skip in cuts(own, RUN, MOST_WORDS - 1):
                    yield Spans(own[a:b], np.array([0, b - a]), row[lo:hi], skip, bits), codes, list(names)


def _count_keys(sizes: Sequence[int], filters: Callable[[], dict[int, Filter]], bits: int):
    """Arrow function: the fingerprints of windows of these sizes that survive the filters, with counts."""

    def flush(held: list[np.ndarray]) -> pa.RecordBatch:
        keys, n = np.unique(np.concatenate(held), return_counts=True)
        held.clear()
        return pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(n)], ["key", "n"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows, known = [], 0, filters()
        for spans, codes, _ in _texts(batches, bits):
            for n in sizes:
                held.append(spans.keys(n, spans.survivors(n, codes, known), codes))
                rows += len(held[-1])
            if rows > HELD:
                yield flush(held)
                rows = 0
        if rows:
            yield flush(held)

    return count


def _materialise(sizes: Sequence[int], filters: Callable[[], dict[int, Filter]], bits: int):
    """Arrow function: lang, size, phrase, n of the windows that their filter holds; size 0 counts a language's words."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = filters()
        for spans, codes, names in _texts(batches, bits):
            lang: list[str] = []
            size: list[int] = []
            phrase: list[bytes] = []
            found: list[int] = []
            own = np.bincount(spans.lang[spans.windows(1)], minlength=len(names))
            for i in np.flatnonzero(own).tolist():
                lang, size, phrase, found = [*lang, names[i]], [*size, 0], [*phrase, b""], [*found, int(own[i])]
            for n in sizes:
                at = spans.survivors(n, codes, known)
                keys = spans.keys(n, at, codes)
                held = known[min(n, 3)].may_hold(keys)
                first, k = spans.counted(n, at[held], keys[held])
                lang += [names[i] for i in spans.lang[first].tolist()]
                size += [n] * len(first)
                phrase += [spans.phrase(i, n) for i in first.tolist()]
                found += k.tolist()
            cols = [pa.array(lang, pa.string()), pa.array(size, pa.int32()), pa.array(phrase, pa.binary()).cast(pa.string()), pa.array(found, pa.int64())]
            yield pa.RecordBatch.from_arrays(cols, ["lang", "size", "phrase", "n"])

    return read


def _filter(keys: DataFrame, least: int, bits: int) -> Callable[[], Filter]:
    """A filter of the fingerprints (key, n) that occur `least` times, sent to the tasks as bits: its size is bounded by MOST_BITS."""
    frequent = common.settle(keys.groupBy("key").agg(F.sum("n").alias("n")).where(F.col("n") >= least).select("key"))
    size = min(bits, MOST_BITS, max(15, math.ceil(math.log2(BITS_EACH * max(1, frequent.count())))))
    place = F.shiftrightunsigned("key", bits - size) if bits > size else F.col("key")
    by = frequent.groupBy(F.shiftright(place, 15).alias("slice")).agg(F.bitmap_construct_agg(place.bitwiseAND(F.lit(32767))).alias("bits"))
    table = np.zeros((1 << max(size, 15)) // 8, np.uint8)
    for r in by.toLocalIterator():  # 4 KB each, 32 MB in all at most
        table[r.slice * 4096 : (r.slice + 1) * 4096] = np.frombuffer(r.bits, np.uint8)
    common.discard(frequent)
    sent = keys.sparkSession.sparkContext.broadcast(table)
    return lambda: Filter(sent.value, size, bits)


def frequent_phrases(docs: DataFrame, least: int = LEAST, most_words: int = MOST_WORDS, text: str = "text", lang: str = "lang", bits: int = 64) -> DataFrame:
    """lang, size (words), phrase, n (occurrences, at least `least`) of all phrases of 1 to most_words words; size 0: a language's words.

    Texts are lower-cased (A-Z), split at `[.,;:!?\\n-\\r]` into pieces and these at spaces and tabs into words; windows stay within a piece.
    Prefix polynomials hash every n-gram modulo 2**64. First single words, then pairs of frequent words, then longer windows of frequent
    pairs are counted by fingerprint: tasks count what they hold, the shuffle sums it, and the frequent ones become a filter of
    at most 32 MB for the next pass. The last pass compares every occurrence whose fingerprint is frequent with the text its
    fingerprint points to and sums phrases by their words, so that the result doesn't rest on hashes: these only ever let too much through.

    Null texts are empty; a null lang is `und`; repeated rows count as often as they stand; texts beyond 2 MB are hashed in parts; an empty table gives no
    rows; other columns are ignored. bits: of a fingerprint (fewer make collisions, for tests).
    """
    if most_words > MOST_WORDS:
        raise ValueError(f"phrases of at most {MOST_WORDS} words")
    own = docs.select(F.coalesce(F.col(lang), F.lit(UNKNOWN)).alias("lang"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    common.arrow_batches(docs.sparkSession)
    sent: dict[int, Callable[[], Filter]] = {}
    for step in (1, 2, 3):
        sizes = [n for n in range(1, most_words + 1) if min(n, 3) == step]
        if sizes:
            known = dict(sent)
            keys = own.mapInArrow(_count_keys(sizes, lambda known=known: {n: f() for n, f in known.items()}, bits), "key bigint, n bigint")
            sent[step] = _filter(keys, least, bits)
    rows = own.mapInArrow(_materialise(range(1, most_words + 1), lambda: {n: f() for n, f in sent.items()}, bits), "lang string, size int, phrase string, n bigint")
    return rows.groupBy("lang", "size", "phrase").agg(F.sum("n").alias("n")).where((F.col("n") >= least) | (F.col("size") == 0))


def _joined(w: Column, at: Column, n: Column) -> Column:
    return F.array_join(F.slice(w, at, n), " ")


def collocations(phrases: DataFrame, top: int | None = TOP, cover: int = 100) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score of the phrases (frequent_phrases, settled) of two or more words.

    A phrase cut after its first k words has the parts' counts l and r and the score floor(1000 * a * n / (l * r)), exact up to 38 digits; its
    lowest-scoring cut counts (ties: smallest k). Phrases that stand within a longer one of at least `cover` percent of their count go. Ranks by score and a
    (greatest first), then phrase (by bytes); top: how many of each language, None for all.
    """
    f = phrases.where("size > 0").select("lang", "phrase", "size", F.col("n").alias("a"))
    words_of = F.split("phrase", " ")
    long = f.where("size > 1").withColumn("w", words_of)
    inner = F.flatten(F.transform(F.sequence(F.lit(2), F.col("size") - 1), lambda m: F.transform(F.sequence(F.lit(1), F.col("size") - m + 1), lambda i: _joined(F.col("w"), i, m))))
    covered = long.where("size > 2").select("lang", F.explode(F.array_distinct(inner)).alias("phrase"), "a").groupBy("lang", "phrase").agg(F.max("a").alias("over"))
    left = long.join(common.small(covered), ["lang", "phrase"], "left").where(F.col("over").isNull() | (100 * F.col("over") < cover * F.col("a"))).drop("over")
    cut = left.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("size") - 1)))
    cut = cut.select("lang", "phrase", "a", "k", _joined(F.col("w"), F.lit(1), F.col("k")).alias("_l"), _joined(F.col("w"), F.col("k") + 1, F.col("size") - F.col("k")).alias("_r"))
    counts = common.small(f.select("lang", F.col("phrase").alias("_part"), F.col("a").alias("_n")))
    for side, name in (("_l", "l"), ("_r", "r")):
        cut = cut.join(counts.select("lang", F.col("_part").alias(side), F.col("_n").alias(name)), ["lang", side])
    total = common.small(phrases.where("size = 0").select("lang", F.col("n").alias("_total")))
    cut = cut.join(total, "lang")
    wide = lambda c: F.col(c).cast("decimal(20,0)")
    score = F.call_function("div", F.lit(1000).cast("decimal(4,0)") * wide("a") * wide("_total"), wide("l") * wide("r"))
    best = cut.select("lang", "phrase", "a", F.col("_total").alias("n"), F.struct(score.alias("score"), "k", "l", "r").alias("c")).groupBy("lang", "phrase", "a", "n").agg(F.min("c").alias("c"))
    out = best.select("lang", "phrase", "a", "c.l", "c.r", "n", "c.score")
    order = (F.desc("score"), F.desc("a"), F.col("phrase"))
    if top is not None:  # the first of each part of a language, then the first of these
        part = Window.partitionBy("lang", F.pmod(F.xxhash64("phrase"), F.lit(SALTS))).orderBy(*order)
        out = out.withColumn("rank", F.row_number().over(part)).where(F.col("rank") <= top).drop("rank")
    out = out.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("bigint"))
    return (out if top is None else out.where(F.col("rank") <= top)).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(common.settle(frequent_phrases(common.table(spark, sf_dir, "documents").select("text", "lang"))))


SQL = r"""
WITH src AS (
  SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents
), pieces AS (
  SELECT lang, unnest(regexp_split_to_array(t, '[.,;:!?\x0A-\x0D]')) AS piece FROM src
), toks AS (
  SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces
), totals AS (
  SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM toks GROUP BY lang
), grams AS (
  SELECT lang, m, unnest(list_transform(range(1, len(w) - m + 2), lambda i: array_to_string(w[i:i + m - 1], ' '))) AS phrase
  FROM toks, (SELECT unnest(range(1, 6)) AS m) WHERE len(w) >= m
), f AS (
  SELECT lang, m, phrase, count(*) AS a FROM grams GROUP BY ALL HAVING count(*) >= 100
), cand AS (
  SELECT *, string_split(phrase, ' ') AS w FROM f WHERE m > 1
), inside AS (
  SELECT lang, a, unnest(flatten(list_transform(range(2, m), lambda s: list_transform(range(1, m - s + 2), lambda i: array_to_string(w[i:i + s - 1], ' '))))) AS phrase
  FROM cand WHERE m > 2
), covered AS (
  SELECT lang, phrase, max(a) AS over FROM inside GROUP BY ALL
), cut AS (
  SELECT lang, phrase, a, w, unnest(range(1, m)) AS k FROM cand LEFT JOIN covered USING (lang, phrase) WHERE over IS NULL OR 100 * over < 100 * a
), scored AS (
  SELECT c.lang, c.phrase, c.a, k, x.a AS l, y.a AS r, n, CAST((1000::HUGEINT * c.a * n) // (x.a::HUGEINT * y.a) AS BIGINT) AS score
  FROM cut c JOIN totals USING (lang)
  JOIN f x ON x.lang = c.lang AND x.phrase = array_to_string(w[1:k], ' ')
  JOIN f y ON y.lang = c.lang AND y.phrase = array_to_string(w[k + 1:], ' ')
), best AS (
  SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1
)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
FROM best QUALIFY row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) <= 2000
"""
