"""Literal cases of identities, images, retrieval, maintenance, archives and streams."""

import io
import random
import time
import uuid
import zipfile
from datetime import datetime, timedelta, timezone

import numpy as np
import pandas as pd
import pytest
import xxhash
from pyspark.sql import functions as F

from siltstone.functions import text as X
from siltstone.operators import assemble as A
from siltstone.operators import blocks as B
from siltstone.operators import cells as K
from siltstone.operators import evaluate as E
from siltstone.operators import html as H
from siltstone.operators import images as I
from siltstone.operators import incremental as M
from siltstone.operators import index as N
from siltstone.operators import retrieve as R
from siltstone.sources import files as S
from siltstone.sources.versions import VersionedTables
from siltstone.streaming import streams as T


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_point_ids_are_uuid5(spark):
    space = uuid.UUID("6f9619ff-8b86-d011-b42d-00c04fc964ff")
    for i in range(20):
        assert one(spark, X.point_id(F.lit("doc_é"), F.lit(i))) == str(uuid.uuid5(space, f"doc_é#{i}"))


def test_names_and_titles(spark):
    assert one(spark, X.chunk_id(F.lit("d"), F.lit(12345))) == "d_c12345"
    assert one(spark, X.safe_cache_name(F.lit("é/a:b-c.d e"))) == "é_a_b-c.d e"
    assert one(spark, X.title_from_h1(F.lit("x\n# a\rb\n# c"), F.lit("s"))) == "a\rb"
    assert one(spark, X.legit_title(F.lit("Réinitialiser le mot"), F.lit("reset_réinitialiser"))) is False
    assert one(spark, X.legit_title(F.lit("Réinitialiser le mot"), F.lit("reset réinitialiser"))) is True
    assert one(spark, X.format_timestamp(F.lit(3725.9))) == "01:02:05" and one(spark, X.format_timestamp(F.lit(65))) == "01:05"


def test_alt_texts(spark):
    assert one(spark, X.sanitize_alt(F.lit("**bold** *it* # h `c` [x] d'a \"q\"\nline"))) == "bold it h c (x) d’a «q« line"
    long = one(spark, X.sanitize_alt(F.lit("word " * 60)))
    assert len(long) <= 150 and long.endswith("word...")
    assert one(spark, X.image_block(F.lit(""), F.lit("r"))) == "" and one(spark, X.is_decorative(F.lit(None).cast("string"))) is False


def test_safe_ids_and_urls(spark):
    assert [one(spark, X.safe_id(F.lit(x))) for x in ("a.b-_1", "..", ".", "a/b", "", "a\n")] == [True, False, False, False, False, False]
    assert one(spark, X.publish_images(F.lit("![a](rag-image://c/d/f.png)"), "http://h")) == "![a](http://h/collections/c/images/d/f.png)"
    assert one(spark, X.publish_images(F.lit("![a](rag-image://c/d/f.png)"), None)) == "![a](rag-image://c/d/f.png)"
    assert one(spark, X.remote_docid(F.lit("not a url"), "http://h")) is None


def test_relative_images_stay_below_the_root(spark):
    at = lambda src: one(spark, I.resolve_relative(F.lit(src), F.lit("/data/in"), "/data"))
    assert at("a/../b.PNG") == "/data/in/b.PNG" and at("../../etc/x.png") is None and at("//h/x.png") is None and at("x.svg") is None and at("data:x.png") is None


def test_image_cap_and_tiny_images(spark):
    refs = " ".join(f"![picture {i}](p{i}.png)" for i in range(5)) + " ![tiny](t.png)"
    docs = spark.createDataFrame([("c", "d", "/in", refs)], "collection string, doc_id string, base string, markdown string")
    files = spark.createDataFrame([(f"/in/p{i}.png", bytes(3000) + bytes([i])) for i in range(5)] + [("/in/t.png", b"x")], "path string, bytes binary")
    none = spark.createDataFrame([], "url string, bytes binary, ext string"), spark.createDataFrame([], "hash string, text string")
    out = I.rewrite_images(docs, files, *none, root="/in", most=3).first().markdown
    assert out.count("rag-image://c/d/") == 3 and out.endswith("picture 3 picture 4 tiny")


def lists(spark, *rankings):
    return [spark.createDataFrame([(1, c, i + 1) for i, c in enumerate(r)], "query_id int, chunk_id string, rank int") for r in rankings]


def test_fusion(spark):
    out = R.rrf_fuse(lists(spark, "xyz", "yxw")).orderBy("rank").collect()
    assert [r.chunk_id for r in out] == ["x", "y", "z", "w"] and out[0].score == pytest.approx(1 / 61 + 1 / 62)
    assert [r.chunk_id for r in R.rrf_fuse(lists(spark, "abc")).orderBy("rank").collect()] == ["a", "b", "c"]


def test_hybrid_and_deletion(spark):
    unit = lambda i: [1.0 if j == i else 0.0 for j in range(4)]
    index = spark.createDataFrame([(0, "A", unit(0)), (1, "A", unit(1)), (2, "B", unit(2)), (3, "B", unit(3))], "chunk_id bigint, doc_id string, dense array<float>")
    asked = spark.createDataFrame([(7, [0.95, 0.05, 0.0, 0.0])], "query_id bigint, dense array<float>")
    sparse = spark.createDataFrame([(0, 10, 1.0), (1, 20, 1.0), (2, 30, 1.0)], "chunk_id bigint, tok bigint, w double")
    q = spark.createDataFrame([(7, 10, 1.0), (7, 20, 0.5)], "query_id bigint, tok bigint, w double")
    dense, lexical = R.dense_topk(asked, index.drop("doc_id"), 4), R.sparse_topk(q, sparse, 4)
    assert R.hybrid_search(dense, lexical, 4).orderBy("rank").first().chunk_id == 0
    alone = R.hybrid_search(dense, lexical.limit(0), 4).orderBy("rank").collect()
    assert [r.chunk_id for r in alone][:2] == [0, 1] and alone[0].score > 0.99
    live = R.drop_deleted(index, spark.createDataFrame([("A",)], "doc_id string")).drop("doc_id")
    assert {r.chunk_id for r in R.dense_topk(asked, live, 4).collect()} == {2, 3}


def test_approximate_search_finds_neighbours(spark, tmp_path):
    """All questions of the largest table, by collection: vectors that are spread evenly, the hardest case."""
    e = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").select(F.col("vec_id").alias("chunk_id"), F.col("label").alias("collection"), F.transform("embedding", lambda x: x.cast("double")).alias("dense"))
    asked = e.where("chunk_id % 20 = 0").withColumnRenamed("chunk_id", "query_id")
    exact, near = R.dense_topk(asked, e, 10, ("collection",)), K.cells_topk(asked, K.build_cells(e, f"{tmp_path}/cells", ("collection",)), 10).cache()
    assert near.count() == exact.count() == 1000 and exact.join(near, ["query_id", "chunk_id"]).count() >= 900
    assert near.agg(F.max("read")).first()[0] < 0.1 * e.count()


def test_cells_of_clustered_vectors(spark, tmp_path):
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(12, 8))
    rows = [(i, "007" if i % 3 else "7", [float(x) for x in centres[i % 12] + rng.normal(size=8) / 20]) for i in range(900)] + [(900, "7", None), (901, "7", [0.0] * 8), (902, None, [1.0] * 8), (903, "007", [1.0, 2.0])]
    e = spark.createDataFrame(rows, "chunk_id bigint, collection string, dense array<double>")
    cells = K.build_cells(e, f"{tmp_path}/cells", ("collection",), 8)
    assert cells.vectors.count() == 903 and cells.centres.agg(F.sum("vectors")).first()[0] == 903
    asked = e.where("chunk_id % 20 = 0").withColumnRenamed("chunk_id", "query_id")
    exact = {(r.query_id, r.chunk_id): r.score for r in R.dense_topk(asked, e, 5, ("collection",)).collect()}
    near = K.cells_topk(asked, cells, 5, 0.25).collect()
    met = [r for r in near if (r.query_id, r.chunk_id) in exact]
    assert len(met) >= 0.95 * len(exact) and all(r.score == pytest.approx(exact[r.query_id, r.chunk_id]) for r in met)
    assert sum(r.read for r in near) < 0.5 * sum(r.held for r in near)
    every = {(r.query_id, r.chunk_id) for r in K.cells_topk(asked, cells, 5, 1.0).collect()}
    assert every == set(exact)
    none = K.build_cells(e.limit(0), f"{tmp_path}/none", ("collection",))
    assert K.cells_topk(asked, none, 5).count() == 0


def test_blocks_of_postings_give_the_same_hits(spark, tmp_path):
    """Rare words beside words that stand in every chunk: few of the common words' postings are read."""
    rng = random.Random(3)
    texts = [" ".join(["common", "usual"] * rng.randint(1, 4) + [f"name{rng.randrange(60)}" for _ in range(rng.randint(0, 6))] + ["filler"] * rng.randint(0, 9)) for _ in range(1500)]
    index = N.build_bm25(spark.createDataFrame(list(enumerate(texts)), "chunk_id bigint, text string"), f"{tmp_path}/index", 2)
    held = B.build_blocks(index, f"{tmp_path}/blocks", 16, 2)
    assert held.blocks.agg(F.sum(F.size("ids"))).first()[0] == held.terms.count() == index.postings.count()
    asked = spark.createDataFrame([(0, "common usual name3"), (1, "name1 name2 name2 filler"), (2, "common"), (3, "nothing"), (4, ""), (5, "name7 common filler usual name9")], "query_id bigint, text string")
    for k in (1, 5, 2000):
        shown = lambda df: {(r.query_id, r.chunk_id): (round(r.score, 9), r["rank"]) for r in df.collect()}
        rows = B.blocks_topk(asked, held, k).cache()
        assert {q: v[0] for q, v in shown(rows).items()} == {q: v[0] for q, v in shown(R.bm25_topk(asked, index, k)).items()}
        share = {r.query_id: r.read / r.postings for r in rows.collect()}
        assert all(x <= 1 for x in share.values()) and (k > 5 or max(share[0], share[2], share[5]) < 0.5), share


def test_a_chain_of_topics(spark):
    """5,000 levels deep, numbers of any size."""
    chain = [("deep", f"t{i}", f"t{i - 1}" if i else None, 10**12 - i, f"T{i}", None, None, None) for i in range(5000)]
    wide = [("wide", "r", None, 0, "Root", None, None, None)] + [("wide", f"c{k}", "r", k, f"C{k}", None, None, None) for k in (100_000_000, 99_999_999, 5, -3)]
    wide += [("wide", "c5b", "c5", 1, "Under", None, None, None), ("wide", "lost", "nobody", 1, "Lost", None, None, None), ("wide", "x", "y", 1, "X", None, None, None), ("wide", "y", "x", 1, "Y", None, None, None), ("wide", "c5", "r", 6, "Twin", None, None, None), ("wide", "n", "r", None, "Last", None, None, None)]
    df = spark.createDataFrame(chain + wide, "map_id string, topic_id string, parent_id string, ord bigint, title string, links array<string>, note string, note_links array<string>")
    out = {r.map_id: r.markdown for r in A.topics_to_markdown(df).collect()}
    assert out["wide"].split("\n\n") == ["# Root", "## Root", "### C-3", "### C5", "#### Under", "### Twin", "### C99999999", "### C100000000", "### Last"]
    lines = out["deep"].split("\n\n")
    assert len(lines) == 5001 and lines[1:8] == [f"{'#' * min(i + 2, 6)} T{i}" for i in range(7)] and lines[-1] == "###### T4999"
    assert A.topics_to_markdown(df.limit(0)).count() == 0


PAGES = {
    "<a href='u'><h2>t</h2></a>": "## [t](u)",
    "<h1>A</h1><p>x <a href=\"/b\">y</a> z</p>": "# A\n\nx [y](/b) z",
    "<table><tr><td>a</td><td>b</td></tr><tr><th>c</th><td>d</td></tr></table>": "a | b\n\nc | d",
    "<ol><li>one</li><li>two<ul><li>in</li></ul></li><li>three</li></ol><ul><li>x</li></ul>": "1. one\n2. two\n\n  - in\n\n3. three\n\n- x",
    "it&#8217;s &eacute;t&#xE9; &amp;lt; &lt;b&gt; &nope; &#0; a &amp b": "it\u2019s \u00e9t\u00e9 &lt; <b> &nope; &#0; a &amp b",
    "<p>a</p><pre>  two  spaces\n\n\n  and lines </pre>b": "a\n\n```\n  two  spaces\n\n\n  and lines \n```\n\nb",
    "<a href='x'>never closed <b>bold</b>": "never closed bold",
    "<a>no target</a> and <a href=\"1\">p</a><a href='2'>q</a>": "no target and [p](1)[q](2)",
    "<a href='u'>before<h3>one</h3><h4>two</h4></a> after": "before\n\n### [one](u)\n\n#### [two](u)\n\nafter",
    "<!-- <p>no</p> --><script>var a = '<p>';</script><style>p{}</style><head><title>t</title></head>": None,
    "a < b &": "a < b &",
    "line<br>next<br/>third": "line\n\nnext\n\nthird",
    "": None,
}


def test_html(spark):
    rows = [(i, h) for i, h in enumerate(PAGES)] + [(99, None)]
    out = {r.id: r.markdown for r in H.html_to_markdown(spark.createDataFrame(rows, "id int, html string"), "id").collect()}
    for i, h in rows:
        assert out[i] == PAGES.get(h), h


def test_notes_by_number(spark):
    docs = spark.createDataFrame([("a", "<!-- Slide number:3-->x<!-- Slide number:   3   -->y<!-- Slide number: 4 -->"), ("b", "no mark"), ("c", None)], "doc_id string, markdown string")
    notes = spark.createDataFrame([("a", 3, "first", 1), ("a", 3, "again", 2), ("a", 4, "", 1), ("a", 9, "nowhere", 1), ("a", None, "none", 1), ("b", 1, "x", 1)], "doc_id string, number int, note string, seq int")
    out = {r.doc_id: r.markdown for r in A.inject_by_number(docs, notes, "seq").collect()}
    assert out == {"a": "<!-- Slide number:3-->\n\nagain\nx<!-- Slide number:   3   -->\n\nagain\ny<!-- Slide number: 4 -->", "b": "no mark", "c": None}
    assert "first" in A.inject_by_number(docs, notes).where("doc_id = 'a'").first().markdown  # the greatest


def test_few_hits_by_score_and_side_scores(spark):
    hits = spark.createDataFrame([(1, 10, 1, 0.2), (1, 11, 2, 0.9), (2, 20, 1, 0.5), (2, 21, 2, 0.5), (2, 22, 3, 0.7)], "query_id bigint, chunk_id bigint, rank int, score double")
    scores = hits.select("query_id", "chunk_id", F.col("chunk_id").cast("double").alias("rerank_score"))
    order = lambda df: [(r.query_id, r.chunk_id) for r in df.orderBy("query_id", "rank").collect()]
    assert order(R.rerank(hits, scores, 2)) == [(1, 10), (1, 11), (2, 22), (2, 21)] and order(R.rerank(hits, scores, 2, sort_few=True)) == [(1, 11), (1, 10), (2, 22), (2, 21)]
    sparse = spark.createDataFrame([(1, 11, 1, 4.0), (1, 12, 2, 3.0)], "query_id bigint, chunk_id bigint, rank int, score double")
    got = {(r.query_id, r.chunk_id): (r.dense_score, r.sparse_score) for r in R.hybrid_search(hits, sparse, 3).collect()}
    assert got == {(1, 10): (0.2, None), (1, 11): (0.9, 4.0), (1, 12): (None, 3.0), (2, 20): (0.5, None), (2, 21): (0.5, None), (2, 22): (0.7, None)}


def test_bm25_follows_changes(spark, tmp_path):
    frame = lambda rows: spark.createDataFrame(rows, "chunk_id bigint, text string")
    old = {i: " ".join(f"word{j % (i + 2)} term{j}" for j in range(i + 1)) for i in range(30)} | {30: "", 31: None}
    new = {i: t for i, t in old.items() if i % 5} | {3: "quite other words", 6: old[6], 50: "word0 word0 fresh", 30: "no longer empty"}
    changed = {i for i in old.keys() | new.keys() if old.get(i) != new.get(i) or (i in old) != (i in new)}
    index = N.build_bm25(frame(list(old.items())), f"{tmp_path}/index", 3)
    index = N.update_bm25(index, frame([(i, old[i]) for i in changed if i in old]), frame([(i, new[i]) for i in changed if i in new]))
    index = N.update_bm25(index, frame([(50, new[50])]), frame([(50, "word1")]))
    want = N.build_bm25(frame(list((new | {50: "word1"}).items())), f"{tmp_path}/whole", 3)
    shown = lambda x: (x.n, x.mean, {(r.tok, r.df): round(r.idf, 9) for r in x.idf.collect()}, sorted((r.tok, r.chunk_id, r.len, r.tf) for r in x.postings.collect()), {(r.tok, r.chunk_id): round(r.weight, 9) for r in N.bm25_weights(x).collect()})
    assert shown(index) == shown(want)
    small = N.compact_bm25(index)
    assert shown(small) == shown(want) and small.store.table("postings").count() == want.store.table("postings").count()
    assert N.build_bm25(frame([]), f"{tmp_path}/index", 3).postings.count() == 0


def test_search_stays_in_its_collection(spark):
    rows = [(i, "ab"[i % 2], [float(i + 1), 1.0] if i < 8 else [1.0, 2.0, 3.0]) for i in range(12)]
    e = spark.createDataFrame(rows, "chunk_id bigint, collection string, dense array<double>")
    hits = R.dense_topk(e.withColumnRenamed("chunk_id", "query_id"), e, 3, ("collection",), block=2).collect()
    assert all(h.query_id % 2 == h.chunk_id % 2 and (h.query_id < 8) == (h.chunk_id < 8) for h in hits) and len(hits) == 8 * 3 + 4 * 2
    sparse = spark.createDataFrame([(i, 5, 1.0 + i, "ab"[i % 2]) for i in range(4)], "chunk_id bigint, tok bigint, w double, collection string")
    hits = R.sparse_topk(sparse.withColumnRenamed("chunk_id", "query_id"), sparse, 5, ("collection",)).collect()
    assert {(h.query_id, h.chunk_id) for h in hits} == {(i, j) for i in range(4) for j in range(4) if i % 2 == j % 2}


REPLIES = [
    ('[{"id":0,"score":5,"tags":["a"]},{"id":1,"score":7}]', {0: 5, 1: 7}),
    ('Well: [{"id":0,"score":5,"tags":["a"]},{"id":1,"score":7}] so', {0: 5, 1: 7}),
    ('[{"id": 1}]', {1: 0}), ('[{"id": 0, "score": "7.5"}, {"id": 1, "score": "7"}]', {1: 7}), ('[{"id": 0, "score": 7.9}, {"id": -1, "score": 3}]', {0: 7}),
    ('here ```json\n[{"id": 0, "score": 2}]\n``` ok', {0: 2}), ('[{"id": 0, "score": null}]', {}), ("[1, 2]", {}), ('{"id": 0}', {}), ("", {}), ("[", {}), ('[{"id": 0, "score": 99}, {"id": 0, "score": 1}]', {0: 1}),
]


@pytest.mark.parametrize("reply,want", REPLIES)
def test_rerank_replies(spark, reply, want):
    assert spark.range(1).select(X.parse_rerank_reply(F.lit(reply), F.lit(2)).alias("m")).first().m == want


def test_expansions(spark):
    reply = '1. first one\n2024-2025 budget\n12 monkeys film\n" spaced "\nfour'
    assert spark.range(1).select(X.parse_expansions(F.lit("q"), F.lit(reply)).alias("m")).first().m == ["q", "first one", "budget", "monkeys film"]
    assert spark.range(1).select(X.parse_expansions(F.lit("q"), F.lit('" spaced "\n- «kept»\n• dot\nab')).alias("m")).first().m == ["q", "spaced", "«kept»", "• dot"]


def test_approximate_search_asks_every_twentieth_vector(spark):
    from siltstone.plans import catalog

    sf = "/root/testdata/sf0.001"
    asked = {r.query_id for r in catalog.QUERIES["ret2_dense_topk_ann"](spark, sf).select("query_id").distinct().collect()}
    assert asked == {r.vec_id for r in spark.read.parquet(f"{sf}/embeddings.parquet").where("vec_id % 20 = 0").collect()}


def test_embeddings_read_whole_texts(spark):
    texts = ["word " * 7_000 + "last", "word " * 7_000]
    out = {r.chunk_id: r.dense for r in N.embed(spark.createDataFrame(list(enumerate(texts)), "chunk_id bigint, text string")).collect()}
    assert out[0] != out[1] and [out[i] for i in range(2)] == [pytest.approx(v.tolist()) for v in N.hashed_embedding(texts)]


def test_decorative_reads_whole_texts(spark, tmp_path):
    from siltstone.plans import catalog

    rows = [(2, "x" * 60 + " page de garde"), (6, "x" * 60)]
    spark.createDataFrame(rows, "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert {r.doc_id: r.decorative for r in catalog.QUERIES["img3_is_decorative"](spark, str(tmp_path)).collect()} == {2: True, 6: False}


def test_diversify_and_rerank(spark):
    hits = spark.createDataFrame([(1, i + 1, d, f"c{i}", 1.0 - i / 10) for i, d in enumerate("aaabab")], "query_id int, rank int, doc_id string, chunk_id string, score double")
    assert [r.chunk_id for r in R.diversify(hits, 2).orderBy("place").collect()] == ["c0", "c3", "c1", "c5", "c2", "c4"]
    scores = spark.createDataFrame([(1, f"c{i}", float(i % 3)) for i in range(6)], "query_id int, chunk_id string, rerank_score double")
    top = R.rerank(hits.drop("doc_id"), scores, 3).orderBy("rank").collect()
    assert [(r.chunk_id, r.score) for r in top] == [("c2", 2.0), ("c5", 2.0), ("c1", 1.0)]
    assert [r.chunk_id for r in R.rerank(hits.drop("doc_id"), scores.limit(5), 3).orderBy("rank").collect()] == ["c0", "c1", "c2"]
    assert [r.score for r in R.rerank(hits.drop("doc_id"), scores, 6).orderBy("rank").collect()][0] == 1.0


def test_bm25_is_okapi(spark, tmp_path):
    import math

    texts = ["alpha beta beta", "alpha gamma", "alpha delta epsilon zeta"]
    w = {(r.tok, r.chunk_id): r.weight for r in N.bm25_weights(N.build_bm25(spark.createDataFrame(list(enumerate(texts)), "chunk_id bigint, text string"), f"{tmp_path}/bm25")).collect()}
    idf = {t: math.log(3 - n + 0.5) - math.log(n + 0.5) for t, n in {"alpha": 3, "beta": 1, "gamma": 1, "delta": 1, "epsilon": 1, "zeta": 1}.items()}
    assert w["beta", 0] == pytest.approx(idf["beta"] * 2 * 2.5 / (2 + 1.5 * (0.25 + 0.75 * 3 / 3)))
    assert w["alpha", 1] == pytest.approx(0.25 * sum(idf.values()) / 6 * 2.5 / (1 + 1.5 * (0.25 + 0.75 * 2 / 3)))


def test_reingest_is_a_no_op_and_a_shrunk_document_leaves_no_orphans(spark):
    docs = spark.createDataFrame([("c", "A", "text", "h1", 2), ("c", "B", "", "h2", 0)], "collection string, doc_id string, markdown string, content_hash string, n_chunks int")
    state = docs.where("n_chunks > 0").drop("markdown")
    assert {r.doc_id: r.status for r in M.classify_changes(docs, state).collect()} == {"A": "skipped", "B": "failed"}
    index = spark.createDataFrame([("c", "A", 0), ("c", "A", 1), ("c", "B", 0)], "collection string, doc_id string, chunk_index int")
    out = M.replace_document_chunks(index, index.where("doc_id = 'A' and chunk_index = 0"))
    assert out.count() == 2
    assert M.find_removed(state, docs).count() == 0  # a failed document is still there


def test_collection_rules(spark):
    kind = "op string, name string, embedder string, embedding_model string, dense_dim int, supports_sparse boolean"
    names = ["", "a b", "é", "a/b", "x" * 65, "x" * 64]
    changes = spark.createDataFrame([("create", n, "e", "m", 4, True) for n in names] + [("create", "old", "e", "m", 4, True), ("update", "old", None, None, None, None), ("update", "old", None, None, 8, None)], kind)
    existing = spark.createDataFrame([("old", "e", "m", 4, True)], "name string, embedder string, embedding_model string, dense_dim int, supports_sparse boolean")
    out = [(r.name, r.error) for r in M.validate_collections(existing, changes).collect()]
    assert sorted(out) == sorted([(n, "invalid name") for n in names[:5]] + [("old", "duplicate"), ("old", "frozen")])


def test_archives(spark):
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as z:
        for name, body in (("docs/a.md", "a"), ("docs/", ""), ("b.exe", "x"), ("__MACOSX/a.md", "m"), (".hidden.md", "h"), ("../evil.html", "e"), ("big.txt", "y" * 500), ("/c.txt", "c"), ("d.txt", "d")):
            z.writestr(name, body)
    entries = S.archive_entries(spark.createDataFrame([("z.zip", data.getvalue())], "path string, content binary"))
    out = {r.entry: (r.source_name, r.skip_reason) for r in S.expand_archives(entries, 100, 2).collect()}
    assert out == {"docs/a.md": ("docs/a.md", None), "b.exe": ("b.exe", "unsupported"), "../evil.html": ("../evil.html", "unsafe"), "big.txt": ("big.txt", "too_big"), "/c.txt": ("c.txt", None), "d.txt": ("d.txt", "over_limit")}
    report = S.archive_report(S.expand_archives(entries, 100)).first()
    assert (report.kept, report.unsupported, report.too_big, report.unsafe) == (3, 1, 1, 1)


def test_index_upsert_is_idempotent(spark, tmp_path):
    rows = spark.createDataFrame([("c", f"d{i}", f"d{i}#0", "x") for i in range(20)], "collection string, doc_id string, chunk_id string, text string")
    for _ in range(2):
        S.write_index(rows, str(tmp_path / "index"), 4)
    S.write_index(rows.limit(3).withColumn("text", F.lit("y")), str(tmp_path / "index"), 4)
    out = VersionedTables(spark, str(tmp_path / "index")).table("chunks")
    assert out.count() == 20 and out.where("text = 'y'").count() == 3


def test_hidden_files_are_not_scanned(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    for name in ("a.md", ".b.md", "sub/c.PDF"):
        (tmp_path / name).write_text("x")
    assert sorted((r.name, r.ext) for r in S.scan_sources(spark, str(tmp_path)).collect()) == [("a.md", ".md"), ("c.PDF", ".pdf")]


def test_evaluation(spark):
    items = spark.createDataFrame([(1.0, 0.5, 0.5), (0.0, 0.0, None)], "recall_at_5 double, mrr double, keyword_rate double")
    r = E.eval_summary(items).first()
    assert (r.n, r.recall_at_5, r.mrr, r.keyword_rate) == (2, 0.5, 0.25, 0.5)


def test_minute_window_includes_its_boundary(spark):
    t = datetime(2024, 1, 1)
    calls = spark.createDataFrame([("m", t), ("m", t + timedelta(seconds=60)), ("m", t + timedelta(seconds=121))], "model string, ts timestamp")
    limits = spark.createDataFrame([("m", 2)], "model string, rpm int")
    assert [(r.in_window, r.wait) for r in T.rpm_window(calls, limits).orderBy("ts").collect()] == [(1, 0.0), (2, pytest.approx(0.2)), (1, 0.0)]


def test_a_bad_file_stops_nothing(spark):
    files = spark.createDataFrame([("a", b"good"), ("b", b"\xff\xfe\xff"), ("c", b"  ")], "name string, content binary")
    assert {r.name: r.status for r in T.convert_batch(files).collect()} == {"a": "done", "b": "failed", "c": "failed"}


def test_segments_are_anchored(spark):
    rows = [("v", float(s), 5.0, t) for s, t in ((0, ""), (10, "a"), (69, "b"), (70, "c"), (131, "d"))]
    out = A.group_segments(spark.createDataFrame(rows, "video_id string, start double, duration double, text string")).orderBy("group_no").collect()
    assert [(r.start, r.end, r.text) for r in out] == [(10.0, 74.0, "a b"), (70.0, 75.0, "c"), (131.0, 136.0, "d")]


def test_long_videos_span_ranges(spark):
    rng = random.Random(6)
    rows = [("long", rng.randrange(400_000) / 10, rng.randrange(50) / 10, f"w{i}") for i in range(4000)]
    rows += [(None, 5.0, 1.0, "x"), (None, 64.9, 1.0, "y"), (None, 65.0, None, "z"), ("one", 7.0, 1.0, " a "), ("none", 1.0, 1.0, " "), ("same", 3.0, 1.0, "b"), ("same", 3.0, 1.0, "b"), ("same", None, 1.0, "c")]
    out = A.group_segments(spark.createDataFrame(rows, "video_id string, start double, duration double, text string").repartition(5)).collect()
    want = []
    for v in {r[0] for r in rows}:
        anchor, n = None, -1
        for s, d, t in sorted((s, d or 0.0, t.strip()) for x, s, d, t in rows if x == v and t.strip() and s is not None):
            if anchor is None or s - anchor >= 60:
                anchor, n = s, n + 1
                want.append([v, n, s, s + d, t])
            else:
                want[-1][3:] = [s + d, want[-1][4] + " " + t]
    shown = lambda x: sorted(map(repr, x))
    assert shown([r.video_id, r.group_no, r.start, r.end, r.text] for r in out) == shown(want)


def drained(stream, spark, tmp_path, name):
    out = str(tmp_path / name)
    stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", f"{out}-offsets").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


def landed_files(spark, tmp_path, parts, schema):
    """Each part as a file of its own, read one file a batch in the order written."""
    for i, rows in enumerate(parts):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        time.sleep(1.1 if i + 1 < len(parts) else 0)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))


def test_streamed_minutes_from_unordered_files(spark, tmp_path):
    t = datetime(2024, 1, 1)
    seconds = [0, 30, 59, 60, 60, 61, 100, 119, 121, 179, 200, 200]
    rows = [("m", t + timedelta(seconds=s)) for s in seconds]
    parts = [rows[1::3], rows[0::3], rows[2::3], [("m", t + timedelta(hours=2)), ("m", None)]]
    calls = landed_files(spark, tmp_path, parts, "model string, ts timestamp")
    got = drained(T.rpm_stream(calls), spark, tmp_path, "out").collect()
    at = int(t.replace(tzinfo=timezone.utc).timestamp())
    want = [(at + s, sum(s - 60 <= x <= s for x in seconds)) for s in seconds]
    assert sorted((r.us // 1_000_000, r.in_window) for r in got) == sorted(want)


def test_streamed_segments_from_unordered_files(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    t = datetime(2024, 1, 1)
    row = lambda v, s, text: (v, t + timedelta(seconds=s), float(s), 5.0, text)
    rows = [row("v", s, x) for s, x in ((0, " "), (10, "a"), (69, "b"), (70, "c"), (131, "d"), (140, "e"))]
    parts = [[rows[4], rows[2]], [rows[5], rows[0], rows[3]], [rows[1], row("w", 50, "x")], [row("v", 7200, "f")], [row("y", 90_000, "end")]]
    segments = landed_files(spark, tmp_path, parts, "video_id string, ts timestamp, start double, duration double, text string")
    got = drained(T.segment_stream(segments, 60.0, idle=3600), spark, tmp_path, "out").collect()
    want = [("v", 0, 10.0, 74.0, "a b"), ("v", 0, 7200.0, 7205.0, "f"), ("v", 1, 70.0, 75.0, "c"), ("v", 2, 131.0, 145.0, "d e"), ("w", 0, 50.0, 55.0, "x")]
    assert sorted((r.video_id, r.group_no, r.start, r.end, r.text) for r in got) == want


def test_natural_positions_of_a_hot_group(spark):
    rows = [("hot", f"d/p{i % 700}.png") for i in range(3000)] + [("cold", "b.png"), ("cold", "a10.png"), ("cold", "a9.png"), (None, "z1")]
    got = A.natural_positions(spark.createDataFrame(rows, "g string, name string").repartition(7), "g").collect()
    for g in ("hot", "cold", None):
        names = sorted((n for x, n in rows if x == g), key=lambda n: (int("".join(filter(str.isdigit, n)) or 0), n))
        assert [r.name for r in sorted((r for r in got if r.g == g), key=lambda r: r.position)] == names
        assert sorted(r.position for r in got if r.g == g) == list(range(1, len(names) + 1))


def test_minutes_of_calls_without_a_time(spark):
    calls = spark.createDataFrame([("m", None), ("m", None), ("m", datetime(2024, 1, 1))], "model string, ts timestamp")
    limits = spark.createDataFrame([("m", 9)], "model string, rpm int")
    assert sorted((r.ts is None, r.in_window) for r in T.rpm_window(calls, limits).collect()) == [(False, 1), (True, 2), (True, 2)]


def test_sparse_search_in_blocks(spark, monkeypatch, capsys):
    """Weights of any sign, repeated and null tokens, several blocks and tiles: as the join over tokens, without a row for each pair of tokens."""
    monkeypatch.setattr(R, "TILE", 64)
    monkeypatch.setattr(R, "TOKEN_SLICE", 3)
    rows = spark.range(60).select(F.col("id").alias("chunk_id"), (F.col("id") % 2).alias("c"), F.explode(F.sequence(F.lit(0), F.col("id") % 7)).alias("j"))
    rows = rows.select("chunk_id", "c", F.concat(F.lit("t"), F.pmod(F.hash("chunk_id", "j"), F.lit(11)).cast("string")).alias("tok"), (F.pmod(F.hash("j", "chunk_id"), F.lit(9)) - 3).cast("double").alias("w"))
    rows = rows.unionByName(spark.createDataFrame([(1, 1, None, 5.0)], rows.schema))
    asked = rows.where("chunk_id % 3 = 0").withColumnRenamed("chunk_id", "query_id")
    plain = rows.join(asked.withColumnRenamed("w", "qw"), ["tok", "c"]).groupBy("query_id", "chunk_id").agg(F.sum(F.col("w") * F.col("qw")).alias("score"))
    for by, want in ((("c",), plain), ((), rows.drop("c").join(asked.drop("c").withColumnRenamed("w", "qw"), "tok").groupBy("query_id", "chunk_id").agg(F.sum(F.col("w") * F.col("qw")).alias("score")))):
        found = R.sparse_topk(asked, rows, 4, by, digits=6, block=5)
        assert sorted(map(tuple, found.select("query_id", "chunk_id", "score", "rank").collect())) == sorted(map(tuple, R.top_k(want, 4, "chunk_id").collect()))
    capsys.readouterr()
    found.explain()
    assert "tok#" not in " ".join(x for x in capsys.readouterr().out.split("\n") if "Join" in x)


def test_images_of_odd_texts(spark, tmp_path):
    """Null, empty and short texts, and texts that begin as an image does, as img5_sniff_format's SQL says."""
    from siltstone.plans import images

    texts = [None, "", "a", "BM of it, not an image", "GIF89a, it says here"]
    spark.createDataFrame([(6 * i + k, t, 0) for i, t in enumerate(texts) for k in range(6)], "doc_id bigint, text string, n_chars bigint").write.parquet(f"{tmp_path}/documents.parquet")
    want = {k: ext for k, ext in enumerate((".png", ".jpg", ".gif", ".bmp", "", ".webp"))}
    found = images.img5_sniff_format(spark, str(tmp_path)).collect()
    assert len(found) == 30 and all(r.ext == want[r.doc_id % 6] for r in found)


def test_large_texts_are_dealt_to_more_tasks(spark, tmp_path, monkeypatch):
    """Counting tokens and scoring pairs take as many tasks as texts and pairs need, whatever the session's number of partitions; the hits are the same."""
    chunks = spark.range(40).select(F.col("id").alias("chunk_id"), F.concat(F.lit("common word"), (F.col("id") % 5).cast("string"), F.lit(" term"), F.col("id").cast("string")).alias("text"))
    asked = spark.createDataFrame([(0, "common word3"), (1, "term7 word2 word2")], "query_id bigint, text string")
    index = N.build_bm25(chunks, f"{tmp_path}/index", 3)
    want = sorted(map(tuple, R.bm25_topk(asked, index, 5).collect()))
    monkeypatch.setattr(N, "TEXT_BYTES", 100)
    assert N.postings(chunks).rdd.getNumPartitions() >= 7
    monkeypatch.setattr(N, "TASK_ROWS", 10)
    monkeypatch.setattr(R, "TASK_PAIRS", 10)
    assert sorted(map(tuple, R.bm25_topk(asked, N.build_bm25(chunks, f"{tmp_path}/again", 3), 5).collect())) == want and len(want) == 10
    monkeypatch.setattr(R, "QUERY_BYTES", 0)
    assert sorted(map(tuple, R.bm25_topk(asked, index, 5).collect())) == want


def test_notes_after_marks_of_any_width(spark):
    """Marks with more white space than a look-behind can hold get their notes; numbers beyond an int get none."""
    md = "a <!-- Slide number:" + " " * 150 + "1 --> b <!-- Slide number: 12345678901 --> c <!-- Slide number: 2 -->"
    docs = spark.createDataFrame([("d", md), ("e", "no marks"), ("f", None)], "doc_id string, markdown string")
    notes = spark.createDataFrame([("d", 1, "one"), ("d", 2, "two"), ("e", 1, "x")], "doc_id string, number int, note string")
    found = {r.doc_id: r.markdown for r in A.inject_by_number(docs, notes).collect()}
    assert found == {"d": md.replace("1 --> b", "1 -->\n\none\n b") + "\n\ntwo\n", "e": "no marks", "f": None}


def test_pages_are_dealt_by_bytes(spark, monkeypatch):
    pages = spark.range(30).select(F.col("id").alias("page_id"), F.concat(F.lit("<h1>T"), F.col("id").cast("string"), F.lit("</h1><p>x</p>")).alias("html"))
    want = sorted(map(tuple, H.html_to_markdown(pages, "page_id").collect()))
    monkeypatch.setattr(H, "PAGE_BYTES", 50)
    found = H.html_to_markdown(pages, "page_id")
    assert found.rdd.getNumPartitions() >= 10 and sorted(map(tuple, found.collect())) == want


def test_queries_of_many_collections_are_one_block(spark, monkeypatch):
    """Blocks follow the largest collection, not the number of all queries; tiles of scores change nothing."""
    e = spark.range(120).select(F.col("id").alias("chunk_id"), (F.col("id") % 12).alias("collection"), F.array(*[F.pmod(F.hash("id", F.lit(i)), F.lit(17)).cast("double") for i in range(4)]).alias("dense"))
    asked = e.withColumnRenamed("chunk_id", "query_id")
    assert R._blocks(asked, ["collection"], F.lit(8), 10) == (1, 960) and R._blocks(asked, ["collection"], F.lit(8), 4)[0] == 3
    shown = lambda: sorted((r.query_id, r.chunk_id, round(r.score, 9), r["rank"]) for r in R.dense_topk(asked, e, 3, ("collection",)).collect())
    want = shown()
    monkeypatch.setattr(R, "TILE", 8)
    assert shown() == want and len(want) == 360


def _shuffled(spark) -> int:
    """Rows that all stages so far have shuffled."""
    sc = spark.sparkContext
    sc._jsc.sc().listenerBus().waitUntilEmpty()
    stages = sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(sc._gateway.jvm.double, 0), sc._gateway.jvm.java.util.ArrayList())
    return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()))


@pytest.mark.parametrize("most", [10**6, 200])
def test_blocks_shuffle_each_posting_once(spark, tmp_path, monkeypatch, most):
    """Tokens beyond a task's work (here: of more than 200 postings) are range-sorted too; blocks are the same."""
    monkeypatch.setattr(B, "TASK_ROWS", most)
    rng = random.Random(4)
    texts = [" ".join(["common"] * rng.randint(1, 4) + [f"name{rng.randrange(60)}" for _ in range(rng.randint(20, 40))] + ["filler"] * rng.randint(0, 9)) for _ in range(900)]
    index = N.build_bm25(spark.createDataFrame(list(enumerate(texts)), "chunk_id bigint, text string"), f"{tmp_path}/index", 2)
    n, before = index.postings.count(), _shuffled(spark)
    held = B.build_blocks(index, f"{tmp_path}/blocks", 16, 2)
    assert most == 200 or _shuffled(spark) - before < 1.2 * n  # rows of counts beside them
    weights = {}
    for r in held.terms.collect():
        weights.setdefault(r.tok, []).append((-r.weight, r.chunk_id))
    want = {(t, i // 16): sorted(w)[i : i + 16] for t, w in weights.items() for i in range(0, len(w), 16)}
    got = {(r.tok, r.block): r for r in held.blocks.collect()}
    assert got.keys() == want.keys() and all(list(zip((-w for w in got[k].weights), got[k].ids)) == v and got[k].top == -v[0][0] for k, v in want.items())
    asked = spark.createDataFrame([(0, "common filler name3"), (1, "name1 name2 filler")], "query_id bigint, text string")
    shown = lambda df: {(r.query_id, r["rank"]): round(r.score, 9) for r in df.collect()}
    assert shown(B.blocks_topk(asked, held, 7)) == shown(R.bm25_topk(asked, index, 7))


def test_texts_of_white_space_are_no_texts(spark):
    """has_text says what strip leaves, at a text's first character that is no white space."""
    texts = ["", " ", "\n", "\r\n", "a", " a", "a\n", "  \x85", " x ", "​", "\x1c", "\x00", " \n\t.\n ", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", X.has_text(F.col("t")).alias("got"), F.coalesce(F.length(X.strip(F.col("t"))) > 0, F.lit(False)).alias("want"))
    assert all(r.got == r.want for r in df.collect())
    given = spark.createDataFrame([(7, "A b a", "x"), (8, "", "y")], "chunk_id int, text string, c string")
    out = {r.chunk_id: r for r in N.embed(given, carried=("c",)).collect()}
    assert out[7].c == "x" and out[8].dense == [0.0] * 64
    texts = ["A b a", "", "one two three two", "  é ß  "]
    plain = np.zeros((len(texts), 64), np.float32)
    for i, text in enumerate(texts):
        for word in text.lower().split():
            h = xxhash.xxh64_intdigest(word)
            plain[i, h % 64] += 1 if h >> 63 else -1
    plain /= np.maximum(np.linalg.norm(plain, axis=1, keepdims=True), 1e-12)
    assert np.array_equal(N.hashed_embedding(texts), plain) and N.hashed_embedding([]).shape == (0, 64) and out[7].dense == plain[0].tolist()


def test_segments_of_a_batch_are_one_piece_of_state():
    """Whatever a video's segments of a batch are in number: each call on the state goes to the JVM."""
    calls = []

    class State:
        def __init__(self):
            self.held = []

        def __getattr__(self, name):
            def call(*given):
                calls.append(name)
                own, self.held = self.held, {"appendValue": lambda: [*self.held, *given], "put": lambda: list(given[0]), "update": lambda: list(given), "clear": list}.get(name, lambda: self.held)()
                return (iter(own) if self is waiting else own[0] if own else None) if name == "get" else None

            return call

    class Handle:
        getListState = getValueState = lambda self, name, schema: {"waiting": waiting, "open": opened}[name]  # noqa: N815
        registerTimer = lambda self, at: calls.append("registerTimer")  # noqa: E731, N815

    class Now:
        getCurrentWatermarkInMs = lambda self: 500_500  # noqa: E731, N815

    waiting, opened = State(), State()
    anchor = T._Anchor(60.0, 3_600_000)
    anchor.init(Handle())
    rows = pd.DataFrame({"ms": range(0, 1_000_000, 1000), "start": [float(i) for i in range(1000)], "duration": 1.0, "text": ["x", " ", None, "y"] * 250})
    assert list(anchor.handleInputRows(("v",), iter([rows[500:], rows[:500]]), Now())) == [] and calls == ["appendValue", "registerTimer"]
    (out,) = anchor.handleExpiredTimer(("v",), Now(), None)
    assert list(out.group_no) == list(range(8)) and list(out.start) == [60.0 * i for i in range(8)] and out.text[0].split(" ") == ["x", "y"] * 15
    assert len(calls) < 10 and sum(len(p[0]) for p in waiting.held) == 249 and opened.held[0][3] == 8
