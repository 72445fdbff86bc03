"""Nulls, empty and long texts, repeated rows, empty tables and clashing column names, for every operator."""

import public_tokenizers
import pytest
from pyspark.sql import functions as F

from siltstone.llm import fingerprint, jaccard, langid, linededup, mixing, packing, quality, tokencount, topk, toxicity

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
LONG = " ".join(f"word{i} and more. " for i in range(30_000))
ROWS = [
    (1, "The quick brown fox jumps over the lazy dog, twice.", "en", "a"),
    (1, "The quick brown fox jumps over the lazy dog, twice.", "en", "a"),
    (2, None, None, None),
    (3, "", "en", "a"),
    (4, " \n\t ", "fr", None),
    (5, LONG, "en", "b"),
    (None, "nobody's text", "en", "a"),
    (6, "1d10t 5tup1d $%& 漢字 é x <|endoftext|>", "xx", "b"),
    (7, "The quick brown fox jumps over the lazy dog, twice.", None, "a"),
]
CLASH = ("_near_key", "_near_n", "_found", "_mix_key", "_mix_times", "_dedup_gone", "_dedup_d", "score", "predicted", "n_tokens", "node", "key", "h", "d", "label", "size", "target", "taken", "n_deleted", "component_id", "held_out", "restored", "piece", "length", "offset", "lang_pred", "source_rows", "fingerprint")


@pytest.fixture(scope="module")
def docs(spark):
    df = spark.createDataFrame(ROWS, "doc_id bigint, text string, lang string, source string").withColumn("n_chars", F.length("text").cast("bigint"))
    return df.select("*", *[F.lit("x").alias(c) for c in CLASH])


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (5, 1, 0), (6, 0, 1), (7, None, None), (None, 1, 1)], "doc_id bigint, quality int, toxic int")


def test_token_counts(docs):
    rows = {(r.doc_id, r.text): (r.n_bytes, r.n_tokens, r.over_limit, r.score) for r in tokencount.count_tokens(docs, TOKENIZER).collect()}
    assert rows[(2, None)] == (0, 0, False, "x") and rows[(3, "")][:3] == (0, 0, False) and rows[(5, LONG)][2]
    assert tokencount.count_tokens(docs.limit(0), TOKENIZER).count() == 0


def test_toxicity(docs, labels):
    cost = toxicity.train_characters(docs)
    lexicon = toxicity.train_lexicon(docs, labels, cost)
    rows = toxicity.score_toxicity(docs, cost, lexicon).collect()
    assert len(rows) == len(ROWS) and all(0 <= r.score <= 1 and r.predicted in (0, 1) and r.node == "x" for r in rows)
    none = toxicity.train_lexicon(docs.limit(0), labels.limit(0), toxicity.train_characters(docs.limit(0)))
    assert all(r.predicted == 0 for r in toxicity.score_toxicity(docs, cost, none).collect())
    assert toxicity.score_toxicity(docs.limit(0), cost, none).count() == 0


def test_quality(docs, labels):
    model = quality.train(docs, labels, 10, 10)
    rows = quality.score_quality(docs, model).collect()
    assert len(rows) == len(ROWS) and all(0 <= r.score <= 1 for r in rows)
    assert rows[0].score == rows[1].score
    flat = quality.train(docs.limit(0), labels.limit(0))
    assert quality.score_quality(docs.limit(0), flat).count() == 0 and all(r.score == 0.5 for r in quality.score_quality(docs, flat).collect())


def test_language(docs):
    rows = {(r.doc_id, r.text): r for r in langid.identify(docs, langid.train(docs)).collect()}
    assert rows[(2, None)].lang_pred == rows[(3, "")].lang_pred == rows[(4, " \n\t ")].lang_pred == "und"
    assert rows[(2, None)].score == 0 and rows[(5, LONG)].lang_pred == "en" and rows[(5, LONG)].lang_spans
    assert langid.identify(docs.limit(0), langid.train(docs.limit(0))).count() == 0


def test_callers_columns_stay(docs, labels):
    """Names that the operators once used for themselves."""
    cost = toxicity.train_characters(docs)
    made = {
        "dedup": linededup.dedup_lines(docs), "near": jaccard.near_duplicates(docs), "one": jaccard.one_of_each(docs), "mix": mixing.mix_sources(docs.withColumn("size", mixing.word_count())),
        "mixed": mixing.mixed(docs.withColumn("size", mixing.word_count())), "lang": langid.identify(docs, langid.train(docs)), "toxic": toxicity.score_toxicity(docs, cost, toxicity.train_lexicon(docs, labels, cost)),
    }
    for name, out in made.items():
        own = [c for c in CLASH if c.startswith("_")]
        assert set(own) <= set(out.columns), name
        assert all(r[c] == "x" for r in out.collect() for c in own), name


def test_fingerprints_of_null_ids_alone(spark):
    rows = spark.range(2100).select(F.lit(None).cast("bigint").alias("doc_id"), F.concat(F.lit("text "), F.col("id").cast("string")).alias("text"))
    out = fingerprint.fingerprint_chain(rows).collect()
    assert len(out) == 2100 and all(r.doc_id is None for r in out)


def test_line_dedup(docs):
    rows = linededup.dedup_lines(docs).collect()
    assert len(rows) == len(ROWS) and {r.doc_id: r.text for r in rows if r.doc_id in (2, 3)} == {2: None, 3: ""}
    assert linededup.dedup_lines(docs.limit(0)).count() == 0


def test_near_duplicates(docs):
    rows = {(r.doc_id, r.text): (r.n_shingles, r.component_id) for r in jaccard.near_duplicates(docs).collect()}
    assert rows[(7, ROWS[0][1])] == (6, 1) and rows[(2, None)] == (0, 2) and rows[(4, " \n\t ")] == (0, 4) and rows[(None, "nobody's text")] == (1, None)
    assert sum(r.leads for r in jaccard.near_duplicates(docs).collect()) == 9 and jaccard.one_of_each(docs).count() == 7
    assert jaccard.near_duplicates(docs).count() == len(ROWS) and jaccard.near_duplicates(docs.limit(0)).count() == 0


def test_near_duplicates_judge_rows_not_ids(spark):
    some = lambda tag: " ".join(f"{tag}{k}" for k in range(30))
    most = 2**63 - 1
    rows = [(None, some("a")), (None, some("b") + " x y"), (3, some("c")), (3, some("d")), (9, some("a") + " end"), (most, some("e")), (None, some("e") + " end"), (None, some("f")), (None, some("f")), (3, None), (None, "")]
    out = {(r.doc_id, r.text): (r.n_shingles, r.component_id) for r in jaccard.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert out == {
        (None, some("a")): (26, 9), (None, some("b") + " x y"): (28, None), (3, some("c")): (26, 3), (3, some("d")): (26, 3), (9, some("a") + " end"): (27, 9),
        (most, some("e")): (26, most), (None, some("e") + " end"): (27, most), (None, some("f")): (26, None), (3, None): (0, 3), (None, ""): (0, None),
    }
    kept = jaccard.one_of_each(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert sorted(map(repr, map(tuple, kept))) == sorted(map(repr, [rows[k] for k in (1, 2, 3, 4, 5, 7, 9, 10)]))
    plain = [r for r in rows if r[0] in (9, most)]
    kept = jaccard.one_of_each(spark.createDataFrame(plain, "doc_id bigint, text string")).collect()
    assert sorted(map(tuple, kept)) == sorted(plain)


def test_mixing(docs):
    sized = docs.withColumn("size", mixing.word_count())
    rows = mixing.mix_sources(sized).collect()
    assert len(rows) == len(ROWS) and all(r.taken <= 2 * r.size and r.label == "x" for r in rows)
    assert mixing.mix_sources(sized.limit(0)).count() == 0 and mixing.mix_sources(sized.where("size = 0")).agg(F.sum("taken")).first()[0] == 0


def test_fingerprints(docs):
    rows = fingerprint.fingerprint_chain(docs).collect()
    assert len(rows) == len(ROWS)
    by = {r.doc_id: r.fingerprint for r in rows}
    assert by[1] == by[7] and by[3] == by[2]
    assert fingerprint.fingerprint_chain(docs.limit(0)).count() == 0
    lone = fingerprint.fingerprint_chain(docs.where("doc_id = 7")).first()
    assert lone.near_next == 1.0


def test_packing(docs):
    out = packing.pack(packing.token_pieces(docs, TOKENIZER)).toPandas()
    assert set(out["doc_id"].dropna()) == {1, 2, 3, 4, 5, 6, 7} and out["doc_id"].isna().sum() == 1
    assert (out[out["doc_id"] == 2]["length"] == 1).all()
    assert packing.pack(packing.token_pieces(docs.limit(0), TOKENIZER)).count() == 0


def test_pipeline_stages(spark, docs, labels, tmp_path):
    import corpus_pipeline

    labels.write.parquet(f"{tmp_path}/labels.parquet")
    own = docs.select("*", *[F.lit("x").alias(c) for c in ("_mix_key", "_near_key", "finish", "_dedup_gone", "h2")])
    for name, stage in corpus_pipeline.STAGES:
        rows = stage(spark, own, str(tmp_path)).collect()
        if name == "best_fit_packing":
            assert {r.doc_id for r in rows} == {None, 1, 2, 3, 4, 5, 6, 7}
            continue
        assert all(set(r.asDict()) == set(corpus_pipeline.COLUMNS) for r in rows), name
        ids = {r.doc_id for r in rows}
        assert ids >= {1, 5} and (name == "mix_sources" or {2, 3, 4, None} <= ids), name
        assert stage(spark, own.limit(0), str(tmp_path)).count() == 0, name


def test_top_k(spark):
    rows = [(i, [float(i % 5) / 5, 0.5, -0.25], "x") for i in range(60)] + [(20, None, "x"), (40, [1.0, None, 0.0], "x"), (None, [1.0, 1.0, 1.0], "x"), (80, [float("nan"), 1.0, 1.0], "x"), (21, [0.2, 0.5, -0.25], "x"), (100, [0.5, 0.5], "x")]
    v = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, score string")
    out = topk.exact_top_k(v, 5).toPandas()
    assert set(out["query_id"]) == {0, 20, 40} and len(out) == 15
    first = out[out["query_id"] == 0].sort_values("rank")
    assert first["vec_id"].tolist() == sorted(first["vec_id"]) and not (first["vec_id"] == 0).any()
    assert topk.exact_top_k(v.limit(0)).count() == 0


def test_equal_pieces_spread_and_full_ones_are_sequences(spark):
    one = spark.range(60_000).select(F.lit(7).cast("bigint").alias("doc_id"), F.when(F.col("id") % 4 == 0, 1024).otherwise(300).cast("bigint").alias("length"))
    out = packing.pack(one, items=5000, rounds=1).toPandas()
    by = out.groupby("sequence_id").length.agg(["sum", "size"])
    assert len(out) == 60_000 and by["sum"].max() <= 1024 and (by["sum"] == 1024).sum() == 15_000 and len(by) - 15_000 == 15_000
    dealt = out[out.length < 1024].groupby(out.sequence_id // (1 << 24)).size()
    assert len(dealt) > 5 and dealt.max() < 5 * dealt.median()
    assert packing.pack(one.where("length = 1024")).where("offset = 0").count() == 15_000
