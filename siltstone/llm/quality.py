"""Quality by positive-unlabelled learning: a linear model that minimises the non-negative unbiased risk."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.llm import common, words

#: Bounds of the training sample: trusted positives and unlabelled documents. Score from which a document is predicted good.
TRUSTED, UNLABELLED, GOOD = 8000, 8000, 0.3
#: Rows whose figures are made together.
ROWS = 1 << 13
_MARKS = np.array([c for c in range(33, 127) if not chr(c).isalnum()])
FIGURES = 13 + len(_MARKS)
_PUNCT = np.zeros(256, bool)
_PUNCT[_MARKS] = True


def _distinct(hashes: np.ndarray, row: np.ndarray, n: int) -> np.ndarray:
    """Distinct hashes of each row; there are at most ROWS rows, so a row's number fits in 14 bits."""
    both = np.sort(row.astype(np.uint64) << np.uint64(50) | hashes >> np.uint64(14))
    if not len(both):
        return np.zeros(n)
    new = np.append(True, both[1:] != both[:-1])
    return np.bincount((both[new] >> np.uint64(50)).astype(np.int64), minlength=n)


def features(column: pa.Array) -> np.ndarray:
    """A row of figures for each text: shares of character classes and marks, doubled marks, repetition of words and lines, words that follow themselves, lengths."""
    data, offsets = words.utf8(column)
    parts = ((c, min(b, c + ROWS)) for a, b in words.runs(offsets, 1 << 21) for c in range(a, b, ROWS))
    return np.concatenate([_features(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]) for a, b in parts] or [np.zeros((0, FIGURES))])


def _features(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    n = len(offsets) - 1
    size = np.diff(offsets)
    row = np.repeat(np.arange(n), size)
    count = np.bincount(row * 256 + data, minlength=n * 256).reshape(n, 256).astype(float)
    upper, lower, digit, beyond = (count[:, a:b].sum(axis=1) for a, b in ((65, 91), (97, 123), (48, 58), (128, 256)))
    hashes, starts, first = words.word_hashes(data, offsets)
    n_words = np.diff(first)
    word_row = np.repeat(np.arange(n), n_words)
    breaks = np.flatnonzero(data == 10) + 1
    edges = np.unique(np.concatenate([offsets[:-1][size > 0], breaks[breaks < len(data)]]))
    line_row = np.searchsorted(offsets, edges, side="right") - 1
    lines = np.bincount(line_row, minlength=n)
    same = np.zeros(n)
    if len(data) > 1:
        twice = (data[1:] == data[:-1]) & _PUNCT[data[1:]] & (row[1:] == row[:-1])
        same = np.bincount(row[1:][twice], minlength=n)
    w, l, z = np.maximum(n_words, 1), np.maximum(lines, 1), np.maximum(size, 1)
    again = np.bincount(word_row[1:][(hashes[1:] == hashes[:-1]) & (word_row[1:] == word_row[:-1])], minlength=n)
    letters = np.maximum(upper + lower + beyond, 1)
    own = [
        np.log1p(size), upper / letters, digit / z, beyond / letters, letters / z, np.log1p(same), same / w,
        _distinct(hashes, word_row, n) / w, _distinct(words.span_hash(data, edges, words.BYTE_CODE), line_row, n) / l,
        np.log(w / l + 1), letters / w, np.sqrt(again / w), np.log1p(again),
    ]
    return np.column_stack([*own, np.sqrt(np.minimum(count[:, _MARKS] / w[:, None], 4))])


class Model:
    """score(x) = logistic(weights . standardised x + bias)."""

    def __init__(self, mean: np.ndarray, scale: np.ndarray, weights: np.ndarray):
        self.mean, self.scale, self.weights = mean, scale, weights

    def score(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -6, 6) @ self.weights[:-1] + self.weights[-1]
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def fit(positive: np.ndarray, unlabelled: np.ndarray, prior: float, steps: int = 4000, rate: float = 0.02, decay: float = 1e-5, contrast: bool = False) -> Model:
    """Minimises prior * E_P[loss(+)] + max(0, E_U[loss(-)] - prior * E_P[loss(-)]) of the logistic loss, by Adam.

    Where the second term would be negative (the model has learned the sample), its gradient is followed upwards.
    With contrast all unlabelled count as negative instead: prior * E_P[loss(+)] + (1 - prior) * E_U[loss(-)].
    """
    mean, scale = unlabelled.mean(axis=0), unlabelled.std(axis=0) + 1e-6
    add = lambda x: np.column_stack([np.clip((x - mean) / scale, -6, 6), np.ones(len(x))])
    p, u = add(positive), add(unlabelled)
    w, m, v = np.zeros(p.shape[1]), np.zeros(p.shape[1]), np.zeros(p.shape[1])
    w[-1] = np.log(prior / (1 - prior))
    for step in range(1, steps + 1):
        zp, zu = p @ w, u @ w
        sp, su = 1 / (1 + np.exp(-zp)), 1 / (1 + np.exp(-zu))
        if contrast:
            rest, negative = 0, (1 - prior) * u.T @ su / len(u)
        else:
            rest = np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean()
            negative = u.T @ su / len(u) - prior * (p.T @ sp) / len(p)
        grad = (prior * (p.T @ (sp - 1)) / len(p) + negative if rest >= 0 else -negative) + decay * w
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        w -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return Model(mean, scale, w)


def estimate_prior(positive: np.ndarray, unlabelled: np.ndarray, least: float = 0.02, most: float = 0.98, sure: float = 0.1) -> float:
    """The share of positives among the unlabelled, from positives and unlabelled alone.

    Half of each trains a model that tells positives from unlabelled. Of the other half, the scores from some
    threshold on are nearly all positive: there the share of unlabelled over the share of positives is the prior. The
    threshold is the one with the least upper confidence bound of that ratio (at chance `sure`).
    """
    if min(len(positive), len(unlabelled)) < 4:
        return 0.5
    model = fit(positive[::2], unlabelled[::2], 0.5, steps=600, contrast=True)
    p, u = np.sort(model.score(positive[1::2])), np.sort(model.score(unlabelled[1::2]))
    cut = np.unique(np.concatenate([p, u]))
    above_p, above_u = 1 - np.searchsorted(p, cut) / len(p), 1 - np.searchsorted(u, cut) / len(u)
    slack = np.sqrt(np.log(4 / sure) / 2) * (1 / np.sqrt(len(p)) + 1 / np.sqrt(len(u)))
    there = above_p > 0
    best = np.argmin((above_u[there] + slack) / above_p[there])
    return float(np.clip(above_u[there][best] / above_p[there][best], least, most))


def _sampled(ids: DataFrame, most: int) -> DataFrame:
    return ids.select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)


def train(docs: DataFrame, labels: DataFrame, trusted: int = TRUSTED, unlabelled: int = UNLABELLED) -> Model:
    """Fits the model on at most `trusted` documents with quality 1 and `unlabelled` documents of any kind.

    docs and labels hold training rows only. Negative labels are not used: the class prior is estimated from positives and
    unlabelled (estimate_prior). Without positives or documents the model scores 0.5.
    """
    spark = docs.sparkSession
    ids = _sampled(labels.where("quality = 1 and doc_id is not null"), trusted).withColumn("known", F.lit(True))
    ids = ids.unionByName(_sampled(docs.where("doc_id is not null"), unlabelled).withColumn("known", F.lit(False)))
    sample = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(ids), "doc_id")  # trusted + unlabelled ids at most

    common.arrow_batches(spark)

    def figures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = features(batch.column(1)).astype(np.float32)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(list(x), pa.list_(pa.float32()))], ["known", "x"])

    got = sample.select("known", "text").mapInArrow(figures, "known boolean, x array<float>").toArrow()
    x = np.array(got.column("x").to_pylist(), float).reshape(len(got), FIGURES)
    known = np.array(got.column("known").to_pylist(), bool)
    order = np.lexsort([*x.T, known])  # whatever order the rows came in
    x, known = x[order], known[order]
    mixed = np.random.default_rng(1).permutation(len(x))
    x, known = x[mixed], known[mixed]
    if not known.any() or known.all():
        return Model(np.zeros(FIGURES), np.ones(FIGURES), np.zeros(FIGURES + 1))
    return fit(x[known], x[~known], estimate_prior(x[known], x[~known]))


def score_quality(docs: DataFrame, model: Model, threshold: float = GOOD) -> DataFrame:
    """docs with score (0 to 1, higher: better) and predicted (1 from `threshold` on).

    Null and empty texts are scored like any other text, by figures that are all zero. Equal texts score alike. An
    empty table gives an empty table; columns with the new names are replaced.
    """

    @F.arrow_udf("double")
    def scored(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield pa.array(model.score(features(batch)), pa.float64())

    common.arrow_batches(docs.sparkSession)
    kept = docs.select(*[c for c in docs.columns if c not in ("score", "predicted")])
    return kept.withColumn("score", scored(F.coalesce("text", F.lit("")))).withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    held = common.fold("doc_id", 5) == 0
    model = train(docs.where(~held), common.table(spark, sf_dir, "labels").where(~held))
    out = score_quality(docs, model).withColumn("held_out", F.coalesce(held, F.lit(False)))
    return out.select("doc_id", "held_out", "score", "predicted")
