"""Chunking: literal cases, and what must hold of the chunks of all fixture documents."""

import os
import random
import time

import pytest
from pyspark.sql import functions as F

from siltstone.operators import chunk as C
from siltstone.plans.base import markdown

SF = "/root/testdata/sf0.001"


def chunked(spark, md, title=None, **sizes):
    df = spark.createDataFrame([("d", title, md)], "doc_id string, title string, markdown string")
    return C.chunk_documents(df, **sizes).orderBy("chunk_index").collect()


def test_blank_documents_give_nothing(spark):
    assert chunked(spark, "") == [] and chunked(spark, " \n\n ") == [] and chunked(spark, None) == []


def test_prefix_holds_title_and_headings(spark):
    rows = chunked(spark, "# Guide\n\nintro\n\n## Section A\n\nbody of the section", "Doc", min_chars=0)
    assert [r.text for r in rows] == ["[Doc > Guide]\n\nintro", "[Doc > Guide > Section A]\n\nbody of the section"]
    assert rows[1].heading_path == ["Guide", "Section A"] and rows[1].page_or_section == "Guide > Section A" and rows[1].char_count == len(rows[1].text)


def test_a_heading_ends_deeper_ones(spark):
    rows = chunked(spark, "# One\na\n### Deep\nb\n## Two\nc\n# Last\nd", min_chars=0)
    assert [r.heading_path for r in rows] == [["One"], ["One", "Deep"], ["One", "Two"], ["Last"]]


def test_long_sections_are_split_with_overlap(spark):
    md = "\n\n".join(" ".join(f"Sentence {i} of paragraph {p}." for i in range(20)) for p in range(20))
    rows = chunked(spark, md, target_tokens=100, overlap_tokens=20)
    assert len(rows) > 5 and all(r.char_count <= 1.5 * 400 + 90 for r in rows) and [r.chunk_index for r in rows] == list(range(len(rows)))


def test_tiny_chunks_merge_forward(spark):
    rows = chunked(spark, "# A\nx\n# B\ny\n# C\n" + "z" * 60, min_chars=40)
    assert len(rows) == 1 or rows[0].text.startswith("[A]\n\nx\n\n[B]") and rows[0].heading_path == ["A"]


def test_headings_alone_are_one_section(spark):
    rows = chunked(spark, "# Only\n## Headings", min_chars=0)
    assert [(r.text, r.heading_path) for r in rows] == [("# Only\n## Headings", [])]


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_a_cut_url_is_mended(spark):
    pieces = F.array(F.lit("mirror: http://pkg.test/v2"), F.lit("?arch=arm64 then install"), F.lit("done"))
    assert one(spark, C.repair_urls(pieces)) == ["mirror:", "http://pkg.test/v2?arch=arm64 then install", "done"]


def test_a_broken_image_leaves_the_overlap(spark):
    assert one(spark, C.overlap_tail(F.lit("q" * 30 + "](rag-image://maps/7/north.png) below it"), 40)) == "below it"
    assert "![m](rag-image" in one(spark, C.overlap_tail(F.lit("![m](rag-image://maps/7/north.png) below it"), 60))


def test_a_long_paragraph_is_cut_at_sentences_and_long_sentences_by_length(spark):
    text = "One two. Three four! " + "x" * 25 + ". Five."
    assert one(spark, C.hard_split(F.lit(text), 20, 5)) == ["One two. Three four!", "x" * 20, "x" * 10 + ".", "Five."]
    assert one(spark, C.hard_split(F.lit("abcdefghij"), 4, 1)) == ["abcd", "defg", "ghij", "j"]


def test_paragraphs_are_packed_and_overlap(spark):
    body = F.lit("First one here.\n\nSecond.\n\n\nThird is a bit longer. End.\n\nFour")
    assert one(spark, C.split_by_size(body, 30, 0)) == ["First one here.\n\nSecond.", "Third is a bit longer. End.", "Four"]
    assert one(spark, C.split_by_size(body, 30, 8)) == ["First one here.\n\nSecond.", "Second.\n\nThird is a bit longer. End.", "End.\n\nFour"]
    assert one(spark, C.split_by_size(F.lit("short"), 30, 8)) == ["short"]


@pytest.fixture(scope="module")
def corpus(spark):
    if not os.path.isdir(SF):
        pytest.skip("no test tables")
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", F.col("source").alias("title"), markdown().alias("markdown"))
    return docs, {r.doc_id: r for r in docs.collect()}


def bodies(rows, title):
    """(heading path, body) of chunks whose prefix is known."""
    for r in rows:
        prefix = "[" + " > ".join([title, *r.heading_path]) + "]\n\n"
        assert r.text.startswith(prefix) and r.char_count == len(r.text) and r.page_or_section == " > ".join(r.heading_path)
        yield r.heading_path, r.text[len(prefix) :]


def by_doc(df):
    out = {}
    for r in df.orderBy("doc_id", "chunk_index").collect():
        out.setdefault(r.doc_id, []).append(r)
    return out


def test_chunks_hold_all_text_once_and_stay_below_the_target(corpus):
    docs, known = corpus
    for tokens in (60, 500):
        out = by_doc(C.chunk_documents(docs, tokens, 0, 0))
        assert set(out) == set(known)
        for i, rows in out.items():
            assert [r.chunk_index for r in rows] == list(range(len(rows)))
            parts = list(bodies(rows, known[i].title))
            assert all(0 < len(b) <= 4 * tokens for _, b in parts)
            kept = "".join("".join(b.split()) for _, b in parts)
            assert kept == "".join("".join(line.split()) for line in known[i].markdown.split("\n") if not line.startswith("#"))


def test_pieces_are_as_large_as_they_can_be(corpus):
    docs, known = corpus
    for i, rows in by_doc(C.chunk_documents(docs, 100, 0, 0)).items():
        parts = list(bodies(rows, known[i].title))
        paragraphs = {p.strip() for p in known[i].markdown.split("\n\n")}
        for (path, a), (next_path, b) in zip(parts, parts[1:]):
            first = b.split("\n\n")[0]
            if path == next_path and first in paragraphs and a.split("\n\n")[-1] in paragraphs:
                assert len(a) + 2 + len(first) > 400


def test_the_path_ends_with_the_nearest_heading(corpus):
    docs, known = corpus
    for i, rows in by_doc(C.chunk_documents(docs, 500, 0, 0)).items():
        at = 0
        for path, body in bodies(rows, known[i].title):
            at = known[i].markdown.index(body.split("\n\n")[0], at)
            headings = [line.lstrip("#").strip() for line in known[i].markdown[:at].split("\n") if line.startswith("#")]
            assert path[-1] == headings[-1] and len(path) <= 3
            at += len(body)


def test_a_tiny_chunk_takes_in_the_next(corpus):
    docs, known = corpus
    apart, merged = (by_doc(C.chunk_documents(docs, 60, 0, least)) for least in (0, 80))
    for i, rows in merged.items():
        assert "\n\n".join(r.text for r in rows) == "\n\n".join(r.text for r in apart[i])
        for a, b in zip(rows, rows[1:]):
            assert len(a.text) >= 80 or len(a.text) + len(b.text) > 360 or any(len(a.text) + len(x.text) > 360 for x in apart[i] if b.text.startswith(x.text))


def test_overlap_repeats_the_end_of_the_piece_before(corpus):
    docs, known = corpus
    plain, lapped = (by_doc(C.chunk_documents(docs, 60, overlap, 0)) for overlap in (0, 15))
    for i, rows in lapped.items():
        assert all(len(b) <= 240 + 60 + 2 for _, b in bodies(rows, known[i].title)) and len(rows) >= len({tuple(r.heading_path) for r in plain[i]})


def test_sections_of_documents_that_are_odd(spark):
    rows = [("a", "# A\n## B\n\n#  \n"), ("b", "####### x\n#\n\n#  y \nbody\r\n## z\r\nmore"), (None, "intro\n# h\nb"), ("c", None), ("d", ""), ("e", "# a\nx\n### b\ny\n## c\n\n# d\nz\n#\t \nq\n")]
    got = C.split_sections(spark.createDataFrame(rows, "doc_id string, markdown string")).collect()
    assert sorted(((r.doc_id or "-", r.sec, r.heading_path, r.body) for r in got), key=str) == sorted([
        ("a", 0, [], "# A\n## B\n\n#"), ("b", 0, [], "####### x\n#"), ("b", 1, ["y"], "body"), ("b", 2, ["y", "z"], "more"), ("-", 0, [], "intro"), ("-", 1, ["h"], "b"),
        ("e", 1, ["a"], "x"), ("e", 2, ["a", "b"], "y"), ("e", 4, ["d"], "z"), ("e", 5, [""], "q"),
    ], key=str)


def test_a_giant_document_spreads_and_is_merged_as_one_fold_does(spark):
    sizes = [(i * 7919) % 97 * (1 + 20 * (i % 11 == 0)) + 1 for i in range(6000)]
    docs = spark.createDataFrame([("big", None, "\n".join(f"# s{i}\n" + "w" * n for i, n in enumerate(sizes))), ("small", None, "# a\nb")], "doc_id string, title string, markdown string")
    sections = C._sections(docs.select("doc_id", "markdown"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # so small a document would be gathered again
    held = [r["n"] for r in sections.where("doc_id = 'big'").groupBy(F.spark_partition_id()).agg(F.count("*").alias("n")).collect()]
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(held) > 1 and max(held) < 6000 * 0.6
    apart = C.chunk_documents(docs, 100, 0, 0).select("doc_id", "chunk_index", F.struct("text", F.col("heading_path").alias("path")).alias("c"))
    fold = apart.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("chunk_index", "c"))).alias("c")).select("doc_id", F.posexplode(C.merge_tiny(F.col("c.c"), 60, 400)).alias("chunk_index", "m"))
    want = [tuple(r) for r in fold.select("doc_id", "chunk_index", "m.text", "m.path").orderBy("doc_id", "chunk_index").collect()]
    got = [tuple(r) for r in C.chunk_documents(docs, 100, 0, 60).select("doc_id", "chunk_index", "text", "heading_path").orderBy("doc_id", "chunk_index").collect()]
    assert got == want and 1000 < len(got) < 6000


def test_null_documents_and_empty_tables_are_chunked(spark):
    schema = "doc_id string, title string, markdown string"
    assert C.chunk_documents(spark.createDataFrame([], schema)).count() == 0
    assert [r.text for r in C.chunk_documents(spark.createDataFrame([(None, "T", "x")], schema)).collect()] == ["[T]\n\nx"]


def test_pieces_as_the_fold_over_columns(spark):
    """The Arrow function and split_by_size agree on made texts of sentences, blank lines, odd spaces, URLs, images and long words."""
    rng = random.Random(11)
    parts = ["Word of it. ", "no end ", "\n", "\n\n", "\n  \n", " ", "\x1c", "\u0001", "x" * 70, "See https://ex.com/a/b", "/c?d=1 ", "![a](rag-image://c/d/e.png)", "é! ", "? ", "\r\n", "\x85"]
    rows = [(i, "".join(rng.choice(parts) for _ in range(rng.randrange(1, 60)))) for i in range(600)]
    df = spark.createDataFrame(rows, "id bigint, body string").repartition(4)
    for target, overlap in ((60, 10), (90, 0), (40, 15)):
        both = df.select("body", C._pieces(target, overlap)("body").alias("got"), C.split_by_size(F.col("body"), target, overlap).alias("want"))
        assert [(r.body, r.got) for r in both.collect()] == [(r.body, r.want) for r in both.collect()]


def test_giant_sections_in_linear_time(spark):
    """A section of 20 MB without a heading, 10,000 pieces and more, is cut in seconds."""
    body = F.repeat(F.lit("Some words of a line that ends here. "), 550_000)
    begun = time.time()
    n = spark.range(1).select(F.lit("d").alias("doc_id"), F.lit("t").alias("title"), body.alias("markdown"))
    assert C.chunk_documents(n).count() > 10_000 and time.time() - begun < 60


def test_a_section_comes_in_runs_of_lines():
    """Whatever runs of whole lines a text comes in, its pieces are those of the whole text."""
    rng = random.Random(5)
    parts = ["Word of it. ", "no end ", "\n", "\n", "\n\n", "\n  \n", " ", "\u0001", "x" * 70, "y" * 200, "See https://ex.com/a/b", "/c?d=1 ", "![a](rag-image://c/d/e.png)", "é! ", "? ", "\r\n", "\x85\n", "end.\n", "\n" * 40]
    for _ in range(3000):
        text = "".join(rng.choice(parts) for _ in range(rng.randrange(1, 80)))
        for target, overlap in ((60, 10), (90, 0), (40, 15)):
            body = text.strip(C.SPACE)
            fold = C.Fold(target, overlap)
            want = ([body] if body else []) if len(body) <= target else [*fold.feed(body), *fold.end()]
            fold, got, held = C.Fold(target, overlap, ""), [], ""
            for line in text.split("\n"):
                held += line + "\n"
                if rng.random() < 0.4:
                    got, held = got + fold.feed(held), ""
            assert [*got, *fold.feed(held), *fold.end()] == want
            assert max(map(len, (fold.cur, fold.open, fold.packed, fold.tail))) <= target + 2 * overlap + 2


def test_documents_in_parts(spark, corpus):
    """Documents in parts give the chunks of whole ones."""
    rng = random.Random(3)
    odd = ["# A\n## B\n\n#  \n", "####### x\n#\n\n#  y \nbody\r\n## z\r\nmore", "intro\n# h\nb", " \n\n", "# a\nx\n### b\ny\n## c\n\n# d\nz\n#\t \nq\n", "# T\n\n\n" + "w. " * 900 + "\n\n\n \nend", "# Only\n## Headings", "\n \n" * 50 + "late"]
    known = {f"o{i}": t for i, t in enumerate(odd)} | {f"c{i}": r.markdown for i, r in corpus[1].items()}
    rows = []
    for i, text in known.items():
        lines, held = text.split("\n"), []
        for n, line in enumerate(lines):
            if held and (C.begins_section(line.encode()) or rng.random() < 0.2):
                rows.append((i, "t", n * 3 - 1, "".join(held)))
                held = []
            held.append(line + "\n" * (n < len(lines) - 1))
        rows.append((i, "t", len(lines) * 3, "".join(held)))
    parts = spark.createDataFrame(rows, "doc_id string, title string, part bigint, markdown string").repartition(5)
    whole = spark.createDataFrame([(i, "t", text) for i, text in known.items()], "doc_id string, title string, markdown string")
    for tokens, overlap, least in ((60, 15, 80), (500, 60, 100)):
        got, want = ([tuple(r) for r in C.chunk_documents(d, tokens, overlap, least).orderBy("doc_id", "chunk_index").collect()] for d in (parts, whole))
        assert got == want and len({r[0] for r in got}) == len(known) - 1
