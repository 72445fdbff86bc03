"""Versioned tables and the ingestion that writes them: nothing half done, nothing twice."""

import hashlib

import pytest
from pyspark.sql import functions as F

from siltstone.operators.chunk import chunk_documents
from siltstone.sources import files as S
from siltstone.sources.versions import Conflict, VersionedTables
from siltstone.streaming import streams as T
from siltstone.streaming.ingest import STAGES, Ingestion, single_chunks

KIND = "collection string, doc_id string, chunk_id string, text string"


def chunks(spark, docs, n=3, tag="x", collection="c"):
    return spark.createDataFrame([(collection, f"d{d}", f"d{d}#{k}", f"{tag}{d}.{k}") for d in docs for k in range(n)], KIND)


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_collections_named_like_numbers(spark, tmp_path):
    path = str(tmp_path / "index")
    S.write_index(chunks(spark, range(6), 1, collection="007"), path, 4)
    index = S.write_index(chunks(spark, range(2), 1, "y", "007"), path, 4)
    out = index.table("chunks")
    assert out.count() == 6 and {r.collection for r in out.collect()} == {"007"} and out.where("text like 'y%'").count() == 2


def test_an_id_that_moves_leaves_nothing(spark, tmp_path):
    index = S.write_index(chunks(spark, range(20)), str(tmp_path / "index"), 4)
    moved = spark.createDataFrame([("c", "other", "d3#1", "new"), ("c", "other", "d3#1", "newer")], KIND)
    S.write_index(moved, str(tmp_path / "index"), 4)
    out = index.table("chunks")
    assert out.count() == 60 and rows(out.where("chunk_id = 'd3#1'")) == [("c", "other", "d3#1", "newer")]


@pytest.fixture
def held(spark, tmp_path):
    own = VersionedTables(spark, str(tmp_path / "tables"), 4)
    docs = spark.createDataFrame([("c", f"d{i}", i) for i in range(12)] + [(None, None, 99)], "collection string, doc_id string, n int")
    own.change({"chunks": chunks(spark, range(12)), "documents": docs, "images": docs.where("n % 3 = 0").select("collection", "doc_id")})
    return own


def test_deletes_count_what_goes(spark, held):
    gone = spark.createDataFrame([("c", "d0"), ("c", "d1"), ("c", "nobody"), ("x", "d2"), (None, None)], "collection string, doc_id string")
    assert held.delete_documents(gone) == {"chunks": 6, "documents": 3, "images": 2}
    assert [held.table(t).count() for t in ("chunks", "documents", "images")] == [30, 10, 3]
    assert held.table("chunks", 0).count() == 36  # older versions stay until they are cleared
    assert held.drop_collections(spark.createDataFrame([("c",)], "collection string")) == {"chunks": 30, "documents": 10, "images": 3}
    assert all(held.table(t).isEmpty() for t in ("chunks", "documents", "images"))
    assert held.delete_documents(gone) == {"chunks": 0, "documents": 0, "images": 0}


def test_columns_are_added_and_kept(spark, held):
    fresh = chunks(spark, [0], 1, "v2").withColumn("extra", F.lit(1))
    held.replace_documents({"chunks": fresh}, fresh)
    held.replace_documents({"chunks": chunks(spark, [50], 1)}, chunks(spark, [50], 1))
    out = held.table("chunks")
    assert out.columns == [*KIND.replace(" string", "").split(", "), "extra"] and out.count() == 36 - 3 + 2
    assert out.where("extra = 1").count() == 1 and held.table("documents").where("doc_id = 'd0'").count() == 0


@pytest.mark.parametrize("at", ["plan chunks", "plan documents", "write chunks", "write documents", "publish"])
def test_a_failure_between_any_two_steps_changes_nothing(spark, held, at):
    before = {t: rows(held.table(t)) for t in ("chunks", "documents", "images")}
    docs = spark.createDataFrame([("c", "d1", 1), ("c", "d5", 5)], "collection string, doc_id string, n int")
    fresh = {"chunks": chunks(spark, [1, 5], 2, "new"), "documents": docs.withColumn("n", F.lit(-1))}

    def fail(step):
        if step == at:
            raise OSError(at)

    with pytest.raises(OSError, match=at):
        held.replace_documents(fresh, docs, step=fail)
    assert {t: rows(held.table(t)) for t in before} == before and held.versions() == [0]
    held.replace_documents(fresh, docs)
    assert held.table("chunks").count() == 34 and held.table("documents").where("n = -1").count() == 2 and held.versions() == [0, 1]


def test_a_mark_counts_once_and_versions_conflict(spark, held, monkeypatch):
    held.change({"log": chunks(spark, [1], 1)}, mark=("s", 3))
    held.change({"log": chunks(spark, [1], 1)}, mark=("s", 3))
    held.change({"log": chunks(spark, [1], 1)}, mark=("s", 2))
    held.change({"log": chunks(spark, [1], 1)}, mark=("other", 0))
    assert held.table("log").count() == 2 and held.applied(("s", 3)) and not held.applied(("s", 4))
    old = held.manifest(0)
    monkeypatch.setattr(held, "manifest", lambda version=None: old)
    with pytest.raises(Conflict):
        held.change({"log": chunks(spark, [2], 1)})


def test_compacting_and_clearing(spark, held, tmp_path):
    held.change({"chunks": chunks(spark, range(12, 15))})
    held.change({"chunks": chunks(spark, range(15, 18))})
    want = rows(held.table("chunks"))
    held.compact("chunks")
    assert rows(held.table("chunks")) == want and all(len(f) == 1 for f in held.manifest()["tables"]["chunks"]["buckets"].values())
    assert held.vacuum() == 3 and held.versions() == [3] and rows(held.table("chunks")) == want and held.table("images").count() == 5


def land(folder, **files):
    folder.mkdir(exist_ok=True, parents=True)
    for name, body in files.items():
        (folder / f"{name}.md").write_bytes(body if isinstance(body, bytes) else body.encode())


def state(spark, ingestion):
    held = ingestion.tables(spark)
    return [rows(held.table(t).drop("batch")) for t in ("documents", "chunks", "dense")]


def test_ingestion_ends_in_an_index(spark, tmp_path):
    body = "# Title\n\n" + "\n\n".join(f"## Part {i}\n\n" + "words of a part. " * 30 for i in range(4))
    land(tmp_path / "in" / "c=one", a=body, b="plain text that is long enough", bad=b"\xff\xfe\xff", blank=" \n ")
    ingestion = Ingestion(str(tmp_path / "index"), buckets=4)
    go = lambda: ingestion.run(T.landing_stream(spark, str(tmp_path / "in"), 2), str(tmp_path / "offsets")).awaitTermination()
    go()
    held = ingestion.tables(spark)
    docs = {r.source_name: r for r in held.table("documents").collect()}
    assert {n: (r.collection, r.status, r.title) for n, r in docs.items()} == {"a.md": ("one", "indexed", "Title"), "b.md": ("one", "indexed", "b"), "bad.md": ("one", "failed", "bad"), "blank.md": ("one", "failed", "blank")}
    assert docs["a.md"].n_chunks == held.table("chunks").where(F.col("doc_id") == docs["a.md"].doc_id).count() > 1
    assert held.table("dense").count() == held.table("chunks").count() and held.table("dense").where("size(dense) = 64").count() == held.table("dense").count()
    first = state(spark, ingestion)
    land(tmp_path / "in" / "c=two", c="another file of text")
    go()
    now = state(spark, ingestion)
    assert all(set(map(repr, a)) < set(map(repr, b)) for a, b in zip(first, now))
    counts = {r.stage: r.rows for r in ingestion.progress(spark).groupBy("stage").agg(F.sum("rows").alias("rows")).collect()}
    assert counts == {"parsing": 5, "done": 5, "embedding": held.table("chunks").count(), "indexing": held.table("chunks").count()} and set(counts) == set(STAGES)


def test_changed_unchanged_and_failing_files(spark, tmp_path):
    ingestion = Ingestion(str(tmp_path / "index"), chunker=single_chunks, buckets=4)
    files = lambda **f: spark.createDataFrame([(f"/c/{n}.md", f"{n}.md", x) for n, x in f.items()], "path string, name string, content binary")
    ingestion.batch(files(a=b"one\ntwo", b=b"three", c=b"four"), 0)
    ingestion.batch(files(a=b"one\ntwo", b=b"five\nsix\n\n", c=b"\xff"), 1)
    held = ingestion.tables(spark)
    docs = {r.source_name: (r.status, r.n_chunks, r.batch, r.error is None) for r in held.table("documents").collect()}
    assert docs == {"a.md": ("indexed", 2, 1, True), "b.md": ("indexed", 2, 1, True), "c.md": ("failed", 1, 1, False)}
    assert sorted(r.text for r in held.table("chunks").collect()) == ["five", "four", "one", "six", "two"]
    assert {(r.batch, r.stage): r.rows for r in ingestion.progress(spark).collect()} == {(0, "parsing"): 3, (0, "embedding"): 4, (0, "indexing"): 4, (0, "done"): 3, (1, "parsing"): 3, (1, "embedding"): 2, (1, "indexing"): 2, (1, "done"): 3}
    ingestion.batch(files(c=b"four"), 2)  # as the index holds it
    assert {r.source_name: (r.status, r.error) for r in held.table("documents").collect()}["c.md"] == ("indexed", None) and held.table("chunks").count() == 5


@pytest.mark.parametrize("at", ["write chunks", "publish", "published"])
def test_a_run_that_breaks_off_and_starts_again_equals_one_undisturbed(spark, tmp_path, at):
    land(tmp_path / "in" / "c=one", **{f"f{i}": f"text number {i}\nand more" for i in range(5)})
    left = [2]

    def fail(step):
        if step == at:
            left[0] -= 1
            if not left[0]:
                raise OSError("lost")

    broken, whole = (Ingestion(str(tmp_path / n), chunker=single_chunks, buckets=2, step=s) for n, s in (("broken", fail), ("whole", None)))
    stream = lambda: T.landing_stream(spark, str(tmp_path / "in"), 2)
    with pytest.raises(Exception, match="lost"):
        broken.run(stream(), str(tmp_path / "o1")).awaitTermination()
    broken.run(stream(), str(tmp_path / "o1")).awaitTermination()
    whole.run(stream(), str(tmp_path / "o2")).awaitTermination()
    assert state(spark, broken) == state(spark, whole) and len(state(spark, whole)[0]) == 5
    assert rows(broken.progress(spark)) == rows(whole.progress(spark))


def test_lines_of_a_giant_document_go_to_many_tasks(spark, tmp_path):
    """One row of 8 MB: its lines, and so what is embedded and written of them, aren't one task's."""
    lines = spark.range(200_000).select(F.sort_array(F.collect_list(F.sha2(F.col("id").cast("string"), 256).substr(1, 40))).alias("x"))
    docs = lines.select(F.lit("d").alias("doc_id"), F.array_join("x", "\n \n").alias("markdown"))
    single_chunks(docs).write.parquet(f"{tmp_path}/lines")
    by = spark.read.parquet(f"{tmp_path}/lines").groupBy(F.input_file_name()).agg(F.count("*").alias("n"), F.max("chunk_index").alias("last")).collect()
    assert len(by) > 1 and max(r.n for r in by) < 150_000 and sum(r.n for r in by) == 200_000 and max(r["last"] for r in by) == 199_999


ODD = {
    "x [1]{a}*?": b"one\ntwo\r\nthree", "mark": b"\xef\xbb\xbf# T\nbody\n", "mark_alone": b"\xef\xbb\xbf", "mark_open": b"\xef\xbb\xbfab", "a b%20+": b"# Name \xc2\xa0\nx", "line": b"\n", "bad": b"good\n\xff\xfe\nab\x00\n", "cr": b"a\rb\r\n\nc",
    "late": b"text\n#\n \n\n  Title of it\nmore", "none": b"#   \n\n", "lines": b"\n" * 300, "long": b"a line of it.\n" * 40_000 + b"# H\n" + b"w" * 600_000 + b"\n## I\n### J\nend", "parts": ("é words of a part " * 20 + "\n").encode() * 3000 + b"#\n" + b"\n" * 300_000 + b"Last",
}


def test_files_are_read_in_parts(spark, tmp_path):
    """The parts of a file are its bytes, and the index over files by path is the one over rows of content."""
    land(tmp_path / "in" / "c=one two", **ODD)
    (tmp_path / "in" / "c=one two" / "text.gz").write_bytes(b"no archive")
    files = S.scan_sources(spark, str(tmp_path / "in")).select("path", "name", "length", "content")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1000000")  # blocks end within lines
    try:
        for given in (files.select("path", "length"), files.select("path", "content")):
            by = {}
            for r in S.text_parts(given).orderBy("path", "part").collect():
                by.setdefault(r.path, []).append(r)
            assert {p: b"".join(bytes(r.text) for r in rows) for p, rows in by.items()} == {r.path: bytes(r.content) for r in files.collect()}
            assert all(len({r.part for r in rows}) == len(rows) and {r.size for r in rows} == {sum(len(r.text) for r in rows)} for rows in by.values())
            assert max(len(r.text) for rows in by.values() for r in rows) < 700_000
        paths, rows_ = (Ingestion(str(tmp_path / n), buckets=2) for n in ("paths", "rows"))
        paths.run(T.landing_stream(spark, str(tmp_path / "in")), str(tmp_path / "offsets")).awaitTermination()
        rows_.batch(files, 0)
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert state(spark, paths) == state(spark, rows_)
    docs = {r.source_name.removesuffix(".md"): r for r in paths.tables(spark).table("documents").collect()}
    assert {n: r.title for n, r in docs.items()} == {n: n for n in ODD} | {"text.gz": "text", "a b%20+": "Name", "late": "Title of it", "long": "H", "parts": "Last"}
    assert {n for n, r in docs.items() if r.status == "failed"} == {"bad", "line", "lines"} and {n: r.bytes for n, r in docs.items() if n in ODD} == {n: len(b) for n, b in ODD.items()}
    assert all(r.content_hash == hashlib.sha256(ODD[n]).hexdigest() for n, r in docs.items() if n in ODD and r.status == "indexed")


@pytest.mark.parametrize("chunker", [chunk_documents, single_chunks])
def test_a_file_beyond_what_a_row_may_hold_is_ingested(spark, tmp_path, chunker):
    """A file that Spark refuses to read as one row (here: of more than 1 MB)."""
    text = "".join(f"Line {i} has some words. And more.\n" + "## Part\n" * (i % 20_000 == 7) for i in range(100_000))
    land(tmp_path / "in" / "c=one", big=text, small="words")
    ingestion = Ingestion(str(tmp_path / "index"), chunker=chunker, buckets=2)
    spark.conf.set("spark.sql.sources.binaryFile.maxLength", str(1 << 20))
    try:
        ingestion.run(T.landing_stream(spark, str(tmp_path / "in")), str(tmp_path / "offsets")).awaitTermination()
    finally:
        spark.conf.unset("spark.sql.sources.binaryFile.maxLength")
    held = ingestion.tables(spark)
    docs = {r.source_name: r for r in held.table("documents").collect()}
    assert (docs["big.md"].status, docs["big.md"].bytes, docs["big.md"].content_hash) == ("indexed", len(text), hashlib.sha256(text.encode()).hexdigest())
    got = [r.text for r in held.table("chunks").where(F.col("doc_id") == docs["big.md"].doc_id).orderBy("chunk_index").collect()]
    assert len(got) == docs["big.md"].n_chunks == held.table("dense").where(F.col("doc_id") == docs["big.md"].doc_id).count()
    if chunker is single_chunks:
        assert got == text.split("\n")[:-1]
    else:
        whole = spark.createDataFrame([("d", "big", text)], "doc_id string, title string, markdown string")
        assert got == [r.text for r in chunk_documents(whole).orderBy("chunk_index").collect()]
