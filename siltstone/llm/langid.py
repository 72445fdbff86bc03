"""Language identification: script ranges narrow the candidates, Viterbi over word scores labels spans."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.llm import chars, common, words

#: Bits of the trigram hash; letters of the background (all languages) mixed into each; what a switch of language costs (in nats); share of a language's letters from which it uses a script.
BITS, SMOOTH, SWITCH, SCRIPT_SHARE = 18, 1000.0, 8.0, 0.01
UNKNOWN = "und"
#: Score of a word in a language that doesn't use its script: no word is long enough to make up for it.
BARRED = -1e9


def _trigrams(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hashed trigram around each letter, first letter of each word, row of each word, script of each word)."""
    letter, lower, script = chars.tables()
    own, at = chars.points(data, offsets)
    is_letter = _in_words(letter[own], chars.marks()[own], at)
    place = np.flatnonzero(is_letter)
    row = np.searchsorted(at, place, side="right") - 1
    low = lower[own[place]]
    follows = np.append(False, (place[1:] == place[:-1] + 1) & (row[1:] == row[:-1]))
    before = np.where(follows, np.append(0, low[:-1]), 0).astype(np.uint32)
    goes_on = np.append(follows[1:], False)[: len(place)]
    after = np.where(goes_on, np.append(low[1:], 0)[: len(place)], 0).astype(np.uint32)
    follows = follows[: len(place)]
    before = before[: len(place)]
    mixed = before * np.uint32(0x9E3779B1) ^ low * np.uint32(0x85EBCA77) ^ after * np.uint32(0xC2B2AE3D)
    mixed ^= mixed >> np.uint32(15)
    mixed *= np.uint32(0x2C1B3C6D)
    first = np.flatnonzero(~follows)
    return (mixed >> np.uint32(32 - BITS)).astype(np.int32), first, row[first], script[own[place[first]]]


def _in_words(letter: np.ndarray, mark: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Letters and the combining marks (vowel signs and accents) in a run that begins with a letter."""
    if not mark.any():
        return letter
    run = letter | mark
    first = run & ~np.append(False, run[:-1])
    edge = at[:-1][at[:-1] < len(run)]
    first[edge] = run[edge]
    led = letter[np.flatnonzero(first)]
    return run & np.append(False, led)[np.cumsum(first)]


class Model:
    """Languages, log probability of each hashed trigram by language, and the languages that a script allows."""

    def __init__(self, langs: list[str], counts: np.ndarray, scripts: np.ndarray):
        self.langs = langs
        total = counts.sum(axis=1, keepdims=True)
        every = counts.sum(axis=0)
        used = max(1, int((every > 0).sum()))
        background = (every + 0.5) / (every.sum() + 0.5 * used)
        self.log = np.log((counts + SMOOTH * background) / (total + SMOOTH)).astype(np.float32).T.copy()
        share = scripts / np.maximum(1, scripts.sum(axis=1, keepdims=True))
        allowed = (share >= SCRIPT_SHARE).T
        allowed[~allowed.any(axis=1)] = True
        self.barred = np.where(allowed, 0, BARRED).astype(np.float32)

    def label(self, data: np.ndarray, offsets: np.ndarray, switch: float = SWITCH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(language number of each word, its letters, its row) by the best path of each row."""
        gram, first, row, script = _trigrams(data, offsets)
        if not len(first):
            return np.zeros(0, np.int64), np.zeros(0, np.int64), row
        score = np.add.reduceat(self.log[gram], first, axis=0) + self.barred[script]
        return viterbi(score, row, len(offsets) - 1, switch), np.diff(np.append(first, len(gram))), row


def viterbi(score: np.ndarray, row: np.ndarray, n: int, switch: float) -> np.ndarray:
    """The state of each word on its row's best path: the sum of scores less `switch` for each change of state. All rows step together."""
    begin = np.searchsorted(row, np.arange(n + 1))
    length = np.diff(begin)
    order = np.argsort(-length, kind="stable")
    order = order[length[order] > 0]
    begin, length = begin[order], length[order]
    active = np.searchsorted(-length, -np.arange(length[0] + 1), side="left")  # rows with more than t words
    best = score[begin].astype(np.float64)
    stays, tops = [], []
    for t in range(1, length[0]):
        k = active[t]
        best_k = best[:k]
        top = best_k.argmax(axis=1)
        jump = best_k[np.arange(k), top] - switch
        stay = best_k >= jump[:, None]
        best[:k] = np.maximum(best_k, jump[:, None]) + score[begin[:k] + t]
        stays.append(stay)
        tops.append(top)
    path = np.zeros(len(score), np.int64)
    state = best.argmax(axis=1)
    for t in range(length[0] - 1, 0, -1):
        k = active[t]
        own = state[:k]
        path[begin[:k] + t] = own
        state[:k] = np.where(stays[t - 1][np.arange(k), own], own, tops[t - 1])
    path[begin] = state
    return path


def train(docs: DataFrame) -> Model:
    """Counts the trigrams and scripts of all docs that have a lang, by lang; what comes to the driver is bounded by langs * 2**BITS."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams: dict[str, np.ndarray] = {}
        for batch in batches:
            data, offsets = words.utf8(batch.column(1))
            lang = np.array(batch.column(0).to_pylist(), object)
            for lo, hi in words.runs(offsets, 1 << 21):
                gram, first, row, script = _trigrams(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
                letters = np.diff(np.append(first, len(gram)))
                by_gram = np.repeat(row, letters)
                own = lang[lo:hi]
                for name in set(own.tolist()):
                    mine = own == name
                    total = grams.setdefault(name, np.zeros((1 << BITS) + 256, np.int64))
                    total[: 1 << BITS] += np.bincount(gram[mine[by_gram]], minlength=1 << BITS)
                    total[1 << BITS :] += np.bincount(script[mine[row]], letters[mine[row]], 256).astype(np.int64)
        for name, total in grams.items():
            there = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(there), pa.string()), pa.array(there.astype(np.int32)), pa.array(total[there])], ["lang", "gram", "k"])

    common.arrow_batches(docs.sparkSession)
    known = docs.where("lang is not null and text is not null").select("lang", "text").mapInArrow(count, "lang string, gram int, k bigint")
    got = known.groupBy("lang", "gram").agg(F.sum("k").alias("k")).toPandas()
    langs = sorted(got["lang"].unique())
    table = np.zeros((max(1, len(langs)), (1 << BITS) + 256))
    for i, name in enumerate(langs):
        own = got[got["lang"] == name]
        table[i, own["gram"].to_numpy(int)] = own["k"]
    return Model(langs or [UNKNOWN], table[:, : 1 << BITS], table[:, 1 << BITS :])


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """docs with lang_pred, score and lang_spans.

    Words are runs of letters with their combining marks. A word's score for a language is the log probability of its character trigrams; a
    language that doesn't use the word's script is barred unless none does. The best path with a penalty for each
    switch gives each word a language; lang_spans holds the runs (lang, words, letters) in order. lang_pred is the
    language of the most letters (ties: the first by name), score its share of the letters. Texts that are null or
    have no letter get `und`, 0 and no spans. An empty table gives an empty table; columns with the new names are replaced.
    """
    @F.arrow_udf("struct<lang_pred:string,score:double,lang_spans:array<struct<lang:string,words:int,letters:int>>>")
    def predict(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            data, offsets = words.utf8(batch)
            parts = [_predicted(model, data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]) for a, b in words.runs(offsets, 1 << 23)]
            yield pa.concat_arrays(parts) if parts else _predicted(model, data, offsets)

    common.arrow_batches(docs.sparkSession)
    kept = docs.select(*[c for c in docs.columns if c not in ("lang_pred", "score", "lang_spans")])
    own = common.fresh("found", kept.columns)
    found = kept.withColumn(own, predict(F.coalesce("text", F.lit(""))))
    return found.select(*kept.columns, f"{own}.lang_pred", f"{own}.score", f"{own}.lang_spans")


def _predicted(model: Model, data: np.ndarray, offsets: np.ndarray) -> pa.Array:
    n, k = len(offsets) - 1, len(model.langs)
    path, letters, row = model.label(data, offsets)
    by = np.bincount(row * k + path, letters, n * k).reshape(n, k) if n else np.zeros((0, k))
    total = by.sum(axis=1)
    best = by.argmax(axis=1)
    names = np.array([*model.langs, UNKNOWN], object)
    pred = pa.array(names[np.where(total > 0, best, k)], pa.string())
    score = pa.array(by[np.arange(n), best] / np.maximum(total, 1), pa.float64())
    new = np.append(True, (path[1:] != path[:-1]) | (row[1:] != row[:-1]))[: len(path)]
    at = np.flatnonzero(new)
    spans = pa.StructArray.from_arrays([
        pa.array(names[path[at]], pa.string()), pa.array(np.diff(np.append(at, len(path))), pa.int32()),
        pa.array(np.add.reduceat(letters, at) if len(at) else letters, pa.int32()),
    ], ["lang", "words", "letters"])
    ends = pa.array(np.searchsorted(row[at], np.arange(n + 1)), pa.int32())
    return pa.StructArray.from_arrays([pred, score, pa.ListArray.from_arrays(ends, spans)], ["lang_pred", "score", "lang_spans"])


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held = F.coalesce(common.fold("doc_id", 4) == 2, F.lit(False))
    model = train(docs.where(~held & F.col("doc_id").isNotNull()))
    return identify(docs.drop("lang"), model).withColumn("held_out", held).select("doc_id", "held_out", "lang_pred", "score")
