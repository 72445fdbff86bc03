"""Quality rules, vector codes and collocations against plain restatements, and their edge cases."""

import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from siltstone.llm import collocate, rules, vectorcodes

WORD = re.compile(r"[^\x20\x09-\x0d]+")


def measured_by_hand(text):
    text = text or ""
    words = WORD.findall(text)
    windows = Counter(zip(words, words[1:], words[2:]))
    covered = {i + o for i, w in enumerate(zip(words, words[1:], words[2:])) if windows[w] > 1 for o in range(3)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines), len(lines) - len(set(lines)), len(covered)


def texts():
    rng = random.Random(5)
    out = [None, "", " \n\t\x0b ", "a", "a a", "a a a", "a a a a", "a b c a b c", "x y z\nx y z\n\nx y z\r\n", "é漢 # $ é漢 # $ é漢", "a\x00b c\x1fd a\x00b c\x1fd a\x00b", "same " * 5000, "a b " * 3000 + "c"]
    for _ in range(60):
        out.append("".join(rng.choice(["a", "b", "cc", "#", "ü"]) + rng.choice([" ", "  ", "\n", "\t", " \n"]) for _ in range(rng.randint(1, 80))))
    return out + [" ".join(f"w{i}" for i in range(20_000)) + " w5 w6 w7"]


def test_measures(spark):
    rows = list(enumerate(texts()))
    out = {r.doc_id: r for r in rules.measured(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    for i, t in rows:
        assert tuple(out[i][m] for m in rules.MEASURES) == measured_by_hand(t), t and t[:60]


def test_measures_keep_the_callers_columns(spark):
    names = ("_words", "_lines", "words", "failed", "n_words", "N_LINES", "kept", "h", "i", "x")
    df = spark.createDataFrame([(1, "a b c"), (1, "a b c"), (None, None)], "doc_id bigint, text string").select("*", *[F.lit("x").alias(n) for n in names])
    out = rules.ledger(rules.measured(df)).collect()
    assert len(out) == 3 and all(r["_words"] == r["_lines"] == r.words == r.kept == r.h == r.x == "x" for r in out)
    assert sorted((r.text or "", r.n_words, r.n_lines, r.failed) for r in out) == [("", 0, 0, 1), ("a b c", 3, 1, 17), ("a b c", 3, 1, 17)]
    assert rules.ledger(rules.measured(df.limit(0))).count() == 0
    assert [r.n_words for r in rules.measured(df.withColumnRenamed("text", "Body"), "Body").collect()].count(3) == 2


def test_policies_and_ablations(spark):
    own = (rules.Rule("short", "n < 3"), rules.Rule("odd", "n % 2 = 1"), rules.Rule("unknown", "missing > 1"), rules.Rule("big", "n >= 8"))
    kept = rules.ledger(spark.range(10).select(F.col("id").alias("n"), F.lit(None).cast("int").alias("missing")), own)
    bits = {r.n: r.failed for r in kept.collect()}
    assert bits == {n: (n < 3) + 2 * (n % 2) + 8 * (n >= 8) for n in range(10)}
    policies = {"a": ("short", "odd"), "b": ("short", "odd", "unknown", "big")}
    assert {r.n for r in kept.where(rules.keeps(policies["b"], own)).collect()} == {4, 6}
    out = {(r.policy, r.rule): r for r in rules.ablations(kept, policies, own, "n").collect()}
    for policy, names in policies.items():
        for name in names:
            every, bit = rules.mask(names, own), rules.mask([name], own)
            r = out[policy, name]
            for case, good in (("docs", lambda f: True), ("kept", lambda f: not f & every), ("fails", lambda f: f & bit), ("alone", lambda f: f & every == bit)):
                hit = [n for n, f in bits.items() if good(f)]
                assert (r[case], r[f"{case}_weight"]) == (len(hit), sum(hit)), (policy, name, case)
    assert len(out) == 6 and rules.ablations(kept.limit(0), policies, own).count() == 0
    with pytest.raises(ValueError):
        rules.ledger(kept, (own[0], own[0]))


def nearest_by_hand(x, book):
    return min((sum((a - b) ** 2 for a, b in zip(x, c)), e) for e, c in enumerate(book))


def compressed_by_hand(rows, parts=4, entries=256, rounds=4, scale=1024):
    own = sorted(((i is None, i if i is not None else 0, v, label) for i, v, label in rows), key=lambda r: r[:3])
    cut = [[[math.floor(vectorcodes.Fraction(x) * scale) for x in v[p * len(v) // parts : (p + 1) * len(v) // parts]] for p in range(parts)] for _, _, v, _ in own]
    books = [[c[p] for c in cut[:entries]] for p in range(parts)]
    for _ in range(rounds):
        for p in range(parts):
            met = defaultdict(list)
            for c in cut:
                met[nearest_by_hand(c[p], books[p])[1]].append(c[p])
            for e, members in met.items():
                books[p][e] = [sum(x) // len(members) for x in zip(*members)]
    out = []
    for (none, i, _, label), c in zip(own, cut):
        best = [nearest_by_hand(c[p], books[p]) for p in range(parts)]
        out.append((None if none else i, label, tuple(e for _, e in best), sum(d for d, _ in best)))
    return out, books


@pytest.mark.parametrize("size", [1.0, 40.0, 1e5, 1e15, 3e38, 1e300])
def test_vector_codes(spark, size):
    rng = np.random.default_rng(3)
    rows = [(int(i), [float(x) for x in rng.choice([-1.5, -1, 0, 0.25, 1, 3], 8) * size * rng.choice([1, 1, 0.01])], int(i) % 3 if i % 4 else None) for i in rng.permutation(90)]
    rows += [(5, rows[0][1], 1), (None, rows[1][1], 2), (None, [0.0] * 8, None)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, label int")
    books = vectorcodes.train_codebooks(df, entries=12)
    out = vectorcodes.with_label_error(vectorcodes.encode(df, books)).collect()
    want, held = compressed_by_hand(rows, entries=12)
    clip = lambda e: min(e, 2**63 - 1)
    assert books == held
    key = lambda r: repr(r)
    assert sorted(((r.vec_id, r.label, tuple(r.codes), r.error) for r in out), key=key) == sorted(((i, x, c, clip(e)) for i, x, c, e in want), key=key)
    by = defaultdict(int)
    for _, label, _, e in want:
        by[label] += clip(e)
    assert all(r.label_error == clip(by[r.label]) for r in out)


def test_equal_average_search():
    rng = np.random.default_rng(1)
    for dims, entries in ((1, 5), (4, 1), (4, 40), (16, 256)):
        book, x = rng.integers(-9, 9, (entries, dims)), rng.integers(-9, 9, (300, dims))
        index, far = vectorcodes.nearest(x, book)
        every = ((x[:, None] - book) ** 2).sum(axis=2)
        assert (index == every.argmin(axis=1)).all() and (far == every.min(axis=1)).all()
        index, _ = vectorcodes.nearest(x.astype(object), book.astype(object))
        assert (index == every.argmin(axis=1)).all()


def test_vector_codes_edge_cases(spark, tmp_path):
    kind = "vec_id bigint, embedding array<float>, label int, codes string, error string, _found string, _label string"
    odd = [(1, None), (2, []), (3, [1.0, None, 0.0, 1.0]), (4, [float("nan")] * 4), (5, [float("inf"), 0.0, 0.0, 0.0]), (6, [1.0, 2.0, 3.0]), (7, [1.0] * 8), (8, [1.0, 2.0, 3.0, 4.0]), (8, [1.0, 2.0, 3.0, 4.0]), (9, [0.5, 2.0, 3.0, 4.0]), (None, [0.0] * 4)]
    df = spark.createDataFrame([(i, v, None, "x", "y", "z", "w") for i, v in odd], kind)
    good = vectorcodes.usable(df)
    assert sorted((r.vec_id or 0) for r in good.collect()) == [0, 8, 8, 9]
    books = vectorcodes.train_codebooks(good)
    out = vectorcodes.with_label_error(vectorcodes.encode(good, books)).collect()
    assert [len(b) for b in books] == [4] * 4 and all(r.error == r.label_error == 0 and r["_found"] == "z" and r["_label"] == "w" for r in out)
    assert [r.codes for r in out if r.vec_id == 8] == [[0, 0, 0, 0]] * 2  # equal entries: the first
    none = vectorcodes.usable(df.limit(0))
    assert vectorcodes.train_codebooks(none) == [[]] * 4 and vectorcodes.encode(none, [[]] * 4).count() == 0
    df.limit(0).select("vec_id", "embedding", "label").write.parquet(f"{tmp_path}/embeddings.parquet")
    assert vectorcodes.op12_vector_codes(spark, str(tmp_path)).count() == 0


def phrases_by_hand(rows, least, most=5):
    f, n = Counter(), Counter()
    for text, lang in rows:
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0a-\x0d]", low):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang if lang is not None else "und"] += len(words)
            for m in range(1, most + 1):
                for i in range(len(words) - m + 1):
                    f[(lang if lang is not None else "und", tuple(words[i : i + m]))] += 1
    return {k: c for k, c in f.items() if c >= least}, n


def collocations_by_hand(rows, least, top, cover=100):
    f, n = phrases_by_hand(rows, least)
    over = Counter()
    for (lang, w), c in f.items():
        for m in range(2, len(w)):
            for i in range(len(w) - m + 1):
                over[lang, w[i : i + m]] = max(over[lang, w[i : i + m]], c)
    by = defaultdict(list)
    for (lang, w), a in f.items():
        if len(w) > 1 and not (over[lang, w] and 100 * over[lang, w] >= cover * a):
            score, _, l, r = min((1000 * a * n[lang] // (f[lang, w[:k]] * f[lang, w[k:]]), k, f[lang, w[:k]], f[lang, w[k:]]) for k in range(1, len(w)))
            by[lang].append((-score, -a, " ".join(w).encode(), l, r))
    return {(lang, i, p.decode(), -a, l, r, n[lang], -s) for lang, x in by.items() for i, (s, a, p, l, r) in enumerate(sorted(x)[:top], 1)}


def phrase_rows():
    rng = random.Random(11)
    words = ["The", "the", "of", "é", "漢字", "a", "zz", "\x00", "B-c"]
    rows = [(None, "en"), ("", None), (" \t\n", "en"), ("...;;", "fr"), ("the end", "und"), ("a " * 400, "en"), ("of the a.of the a\nof the a", None)]
    for _ in range(120):
        text = "".join(rng.choice(words[: rng.choice((3, 9))]) + rng.choice([" ", " ", " ", "  ", "\t", ", ", "\r\n", "\x0b", "!"]) for _ in range(rng.randint(1, 60)))
        rows += [(text, rng.choice(["en", "en", "fr", None, ""]))] * rng.choice((1, 1, 3))
    return rows


@pytest.mark.parametrize("bits", [64, 20, 6])
def test_collocations(spark, bits):
    """Few bits of a fingerprint make most phrases collide; the text decides."""
    rows = phrase_rows()
    df = spark.createDataFrame(rows, "text string, lang string").select("*", F.lit("x").alias("size"), F.lit("y").alias("phrase"), F.lit("z").alias("n"))
    found = collocate.frequent_phrases(df, 12, bits=bits).cache()
    f, n = phrases_by_hand(rows, 12)
    assert {(r.lang, r.phrase): r.n for r in found.where("size > 0").collect()} == {(lang, " ".join(w)): c for (lang, w), c in f.items()}
    assert {r.lang: r.n for r in found.where("size = 0").collect()} == {lang: c for lang, c in n.items() if c}
    for top, cover in ((5, 100), (None, 100), (7, 60)):
        got = {tuple(r) for r in collocate.collocations(found, top, cover).collect()}
        assert got == collocations_by_hand(rows, 12, top if top is not None else 10**9, cover)


def test_collocations_of_parts(spark, monkeypatch):
    """Long texts are cut; windows across a cut count once."""
    rng = random.Random(2)
    rows = [(" ".join(rng.choice("ab") for _ in range(700)), "en"), ("x" * 3000 + " a b", "en"), (" " * 900 + "a b c", "en"), ("".join(rng.choice(["a ", "b ", "cc ", "a.", "b\n"]) for _ in range(900)), "fr")]
    for size in (7, 16, 50, 333):
        texts = [np.frombuffer(t.encode(), np.uint8) for t, _ in rows]
        found = Counter()
        for (t, lang), data in zip(rows, texts):
            for a, b, skip in collocate.cuts(data, size, 4):
                spans = collocate.Spans(data[a:b], np.array([0, b - a]), np.zeros(1, np.int64), skip)
                for m in range(1, 6):
                    for i in spans.windows(m).tolist():
                        found[lang, tuple(spans.phrase(i, m).decode().split(" "))] += 1
        assert dict(found) == phrases_by_hand(rows, 1)[0], size


def test_collocations_of_nothing(spark):
    df = spark.createDataFrame([(None, None), ("", "en"), (" . ", "en")], "text string, lang string")
    for own in (df, df.limit(0)):
        found = collocate.frequent_phrases(own, 1).cache()
        assert found.count() == 0 and collocate.collocations(found).count() == 0


def test_scores_beyond_64_bits(spark):
    n = 9 * 10**14
    rows = [("en", 0, "", n), ("en", 1, "a", 2 * 10**12), ("en", 1, "b", 10**12 + 1), ("en", 2, "a b", 9 * 10**11)]
    out = collocate.collocations(spark.createDataFrame(rows, "lang string, size int, phrase string, n bigint")).collect()
    assert [(r.phrase, r.score) for r in out] == [("a b", 1000 * 9 * 10**11 * n // (2 * 10**12 * (10**12 + 1)))]
