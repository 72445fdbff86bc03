"""Markdown documents to chunks: sections by headings, pieces by size, prefixes, merging of tiny chunks."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltstone.functions import text as X
from siltstone.operators import tables

#: Tokens of a chunk and of the overlap (a token counts as 4 characters), and characters below which a chunk is merged.
TARGET, OVERLAP, LEAST, CHARS = 500, 60, 100, 4
HEADING = r"(?dU)^(#{1,6})\s+(.+?)\s*$"
#: The same by its first characters: where a text is cut, whether it begins with one, each one's line.
_BEGIN = r"#{1,6}[\s&&[^\n]][^\n]"
AT_HEADING, FIRST_HEADING, EACH_HEADING = rf"(?mdU)(?=^{_BEGIN})", rf"(?dU)\A{_BEGIN}", rf"(?mdU)^{_BEGIN}[^\n]*"
URL_AT_END = r"(?s)^(.*?)(https?://[^\s)\]\"'<>]+)$"
URL_GOES_ON = "/:?&=#%+~,;_-"
_STRINGS = "array<string>"
#: White space as Java's (?U)\\s has it: a class of regular expressions, and its characters.
WHITE = "[\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000]"
SPACE = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
_BLANK, _SENTENCE, _LAP = re.compile(rf"\n{WHITE}*\n"), re.compile(rf"([.!?]){WHITE}+"), re.compile(rf"(?s)(.*?[.!?]{WHITE}+)")
_BROKEN = re.compile(rf"(?s)(.*?)\]\({X.IMAGE_SCHEME}://[^)]+\)")
_URL = re.compile(r"""(?s)(.*?)(https?://[^ \t\n\x0b\f\r)\]"'<>]+)(?=(?:\r\n|[\n\r\x85\u2028\u2029])?\Z)""")
_HEAD = re.compile(rf"#{{1,6}}(?!\n){WHITE}[^\n]")


def begins_section(line: bytes) -> bool:
    """Whether a line of UTF-8 is a heading, as FIRST_HEADING says."""
    return line[:1] == b"#" and _HEAD.match(line[:16].decode("utf-8", "ignore")) is not None


def _sections(docs: DataFrame, *carried: str) -> DataFrame:
    """doc_id, sec, *carried, heading_path, body. Texts are cut at headings where they are read and dealt by (doc_id, sec), so that a
    document's sections spread over tasks; only its headings meet in one task, to find the paths. A doc_id names one document.
    """
    whole = docs.select("doc_id", *carried, "markdown", F.split("markdown", AT_HEADING, -1).alias("_blocks"))
    bare = F.forall("_blocks", lambda b: _body(b) == "")
    cut = whole.select("doc_id", *carried, bare.alias("_bare"), F.rlike("markdown", F.lit(FIRST_HEADING)).alias("_titled"), F.posexplode(F.when(bare, F.array("markdown")).otherwise(F.col("_blocks"))).alias("_at", "_block"))
    sec = F.when(F.col("_bare"), 0).otherwise(F.col("_at") + F.col("_titled").cast("int")).cast("bigint")
    body = F.when(F.col("_bare"), X.strip(F.col("_block"))).otherwise(_body(F.col("_block")))
    bodies = cut.select(F.struct("doc_id", sec.alias("sec")).alias("_key"), *carried, "_bare", body.alias("body")).where("body <> ''").repartition("_key")

    heads = docs.select("doc_id", F.posexplode(F.regexp_extract_all("markdown", F.lit(EACH_HEADING), 0)).alias("_at", "line"))
    heads = heads.select("doc_id", (F.col("_at") + 1).cast("bigint").alias("sec"), F.length(F.regexp_extract("line", HEADING, 1)).alias("level"), X.strip(F.regexp_extract("line", HEADING, 2)).alias("title"))
    paths = _paths(heads.withColumn("part", F.col("sec"))).select(F.struct("doc_id", "sec").alias("_key"), "_path")
    held = F.when(~F.col("_bare") & F.col("_path").isNotNull(), F.col("_path")).otherwise(F.array().cast(_STRINGS))
    return bodies.join(paths, "_key", "left").select("_key.doc_id", "_key.sec", *carried, held.alias("heading_path"), "body")


def _below(block: Column) -> Column:
    """What stands below the heading that a block begins with, or all of it."""
    return F.when(F.rlike(block, F.lit(FIRST_HEADING)), F.regexp_replace(block, r"^[^\n]*\n?", "")).otherwise(block)


def _body(block: Column) -> Column:
    return X.strip(_below(block))


def _paths(heads: DataFrame) -> DataFrame:
    """heads (doc_id, sec, part, level, title; rows that are no headings have neither) with the titles that hold at each row."""
    w = Window.partitionBy("doc_id").orderBy("part").rowsBetween(Window.unboundedPreceding, 0)
    heads = heads.select("*", *[F.max(F.when(F.col("level") == k, F.struct("sec", "title"))).over(w).alias(f"h{k}") for k in range(1, 7)])
    path, above = [], F.lit(0)
    for k in range(1, 7):
        own = F.coalesce(F.col(f"h{k}.sec"), F.lit(0))
        path.append(F.when(own > above, F.col(f"h{k}.title")))
        above = F.greatest(above, own)
    return heads.withColumn("_path", F.filter(F.array(*path), lambda t: t.isNotNull())).drop(*[f"h{k}" for k in range(1, 7)])


def _fragments(docs: DataFrame) -> DataFrame:
    """doc_id, sec, part, doc_title, heading_path, body of docs (doc_id, part, doc_title, markdown): as _sections, of texts in parts. A section has a row for each of its parts; what the headings
    and their order say is found without the texts, which are dealt by (doc_id, sec) only.
    """
    docs = docs.where("markdown is not null")
    line, first, below = F.substring_index("markdown", "\n", 1), F.rlike("markdown", F.lit(FIRST_HEADING)), _below(F.col("markdown"))
    level, title = F.when(first, F.length(F.regexp_extract(line, HEADING, 1))), F.when(first, X.strip(F.regexp_extract(line, HEADING, 2)))
    places = docs.select("doc_id", "part", level.alias("level"), title.alias("title"), X.has_text(below).alias("_filled"))
    every = Window.partitionBy("doc_id").orderBy("part").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    so_far = Window.partitionBy("doc_id").orderBy("part").rowsBetween(Window.unboundedPreceding, 0)
    places = _paths(places.select("*", F.count("level").over(so_far).alias("sec"), (~F.max("_filled").over(every)).alias("_bare")))
    places = tables.written(places.select(F.struct("doc_id", "part").alias("_key"), "sec", "_bare", "_path"), "places")
    whole = docs.withColumn("_key", F.struct("doc_id", "part")).join(places, "_key")
    bare = F.col("_bare")
    return whole.select(
        "doc_id", F.when(bare, 0).otherwise(F.col("sec")).cast("bigint").alias("sec"), "part", "doc_title", F.when(bare, F.array().cast(_STRINGS)).otherwise(F.col("_path")).alias("heading_path"),
        F.when(bare, F.col("markdown")).otherwise(below).alias("body"),
    )


def split_sections(docs: DataFrame) -> DataFrame:
    """doc_id, sec, heading_path, body of docs (doc_id, markdown): one row for each section with a body.

    A heading ends all headings of its level or deeper ones. A document whose sections have no body is one section
    without path; blank documents give none.
    """
    return _sections(docs.select("doc_id", "markdown"))


def hard_split(text: Column, target: int, overlap: int) -> Column:
    """Pieces of a paragraph: sentences packed by a space; a sentence beyond target is sliced with an overlap."""
    sentences = F.split(F.regexp_replace(text, r"(?U)([.!?])\s+", "$1\u0001"), "\u0001")
    step = target - overlap

    def put(a: Column, s: Column) -> Column:
        longer = F.when(a["cur"] != "", F.concat(a["cur"], F.lit(" "), s)).otherwise(s)
        done = F.when(a["cur"] != "", F.concat(a["out"], F.array(X.strip(a["cur"])))).otherwise(a["out"])
        slices = F.transform(F.sequence(F.lit(0), F.greatest(F.length(s) - 1, F.lit(0)), F.lit(step)), lambda i: F.substring(s, i + 1, F.lit(target)))
        state = lambda out, cur: F.struct(out.alias("out"), cur.alias("cur"))
        return F.when(F.length(longer) <= target, state(a["out"], longer)).when(F.length(s) > target, state(F.concat(done, slices), F.lit(""))).otherwise(state(done, s))

    empty = F.struct(F.array().cast(_STRINGS).alias("out"), F.lit("").alias("cur"))
    return F.aggregate(sentences, empty, put, lambda a: F.when(X.strip(a["cur"]) != "", F.concat(a["out"], F.array(X.strip(a["cur"])))).otherwise(a["out"]))


def overlap_tail(text: Column, overlap: int) -> Column:
    """What a piece hands to the next: from the first sentence end in the last `overlap` characters' window, or these; no broken image reference."""
    tail = F.right(text, F.lit(2 * overlap))
    rest = F.substring(tail, F.floor(F.length(tail) / 2).cast("int") + 1, F.length(tail))
    head = F.regexp_extract(rest, r"(?sU)^(.*?[.!?]\s+)", 1)
    own = X.strip(F.when(head != "", F.substring(rest, F.length(head) + 1, F.length(rest))).otherwise(F.right(tail, F.lit(overlap))))
    broken = F.regexp_extract(own, rf"(?s)^(.*?)\]\({X.IMAGE_SCHEME}://[^)]+\)", 0)
    before = F.regexp_extract(own, rf"(?s)^(.*?)\]\({X.IMAGE_SCHEME}://[^)]+\)", 1)
    fixed = F.regexp_replace(F.substring(own, F.length(broken) + 1, F.length(own)), r"(?U)^\s+", "")
    return F.when((broken != "") & ~F.contains(before, F.lit("![")), fixed).otherwise(own) if overlap > 0 else F.lit("")


def repair_urls(pieces: Column) -> Column:
    """Pieces with a URL that ends one moved to the next if that goes on with it; blank pieces go."""

    def put(a: Column, p: Column) -> Column:
        head, url = F.regexp_extract(a["cur"], URL_AT_END, 1), F.regexp_extract(a["cur"], URL_AT_END, 2)
        cut = (url != "") & (F.length(p) > 0) & F.contains(F.lit(URL_GOES_ON), F.left(p, F.lit(1)))
        own = F.when(cut, F.regexp_replace(head, r"(?U)\s+$", "")).otherwise(a["cur"])
        out = F.when(X.strip(own) != "", F.concat(a["out"], F.array(own))).otherwise(a["out"])
        return F.struct(out.alias("out"), F.when(cut, F.concat(url, p)).otherwise(p).alias("cur"))

    empty = F.struct(F.array().cast(_STRINGS).alias("out"), F.lit("").alias("cur"))
    return F.aggregate(pieces, empty, put, lambda a: F.when(X.strip(a["cur"]) != "", F.concat(a["out"], F.array(a["cur"]))).otherwise(a["out"]))


def split_by_size(body: Column, target: int, overlap: int) -> Column:
    """Pieces of a section: paragraphs packed by a blank line; on overflow the next piece begins with the overlap."""
    paragraphs = F.filter(F.transform(F.split(body, r"(?U)\n\s*\n"), X.strip), lambda p: p != "")
    state = lambda out, cur: F.struct(out.alias("out"), cur.alias("cur"))

    def put(a: Column, p: Column) -> Column:
        done = F.when(a["cur"] != "", F.concat(a["out"], F.array(X.strip(a["cur"])))).otherwise(a["out"])
        longer = F.when(a["cur"] != "", F.concat(a["cur"], F.lit("\n\n"), p)).otherwise(p)
        tail = overlap_tail(a["cur"], overlap)
        begun = F.when(tail != "", F.concat(tail, F.lit("\n\n"), p)).otherwise(p)
        return F.when(F.length(p) > target, state(F.concat(done, hard_split(p, target, overlap)), F.lit(""))).when(F.length(longer) <= target, state(a["out"], longer)).otherwise(state(done, begun))

    empty = F.struct(F.array().cast(_STRINGS).alias("out"), F.lit("").alias("cur"))
    packed = F.aggregate(paragraphs, empty, put, lambda a: F.when(X.strip(a["cur"]) != "", F.concat(a["out"], F.array(X.strip(a["cur"])))).otherwise(a["out"]))
    return F.when(F.length(body) <= target, F.array(body)).otherwise(repair_urls(packed))


class Fold:
    """The pieces of one section, as split_by_size, from its text as it comes in runs of whole lines. A piece is given as soon as it is known, and of what came before no more than
    the next ones need is kept: however long a section is, a few pieces. With short="" a text that is no longer than the target without white space at its ends is one piece.
    """

    def __init__(self, target: int, overlap: int, short: str | None = None):
        self.target, self.overlap, self.short = target, overlap, short
        self.cur, self.open, self.space, self.last = "", "", "", ""  # paragraphs packed, the one whose end hasn't come, white space after it, the piece that may lose a URL to the next
        self.long = self.sliced = False  # whether the open paragraph is beyond the target, and its last sentence too
        self.packed, self.tail = "", ""  # of a long one: sentences packed, the one whose end hasn't come

    def feed(self, text: str) -> list[str]:
        if self.short is not None:
            own = (self.short + text).lstrip(SPACE)
            self.short = None if len(own.rstrip(SPACE)) > self.target else own[: 2 * self.target + 1]
        text = self.space + text
        bare = text.rstrip(SPACE)
        self.space = text[len(bare) :]
        if _BLANK.search(self.space):
            self.space = "\n\n"
        out: list[str] = []
        if bare:
            *closed, last = _BLANK.split(bare)
            for p in closed:
                self._more(p.rstrip(SPACE), out)
                self._close(out)
            self._more(last, out)
        return self._mended(out)

    def end(self) -> list[str]:
        if self.short is not None:
            return [self.short.strip(SPACE)] if self.short.strip(SPACE) else []
        out: list[str] = []
        self._close(out)
        self._put(self.cur, out)
        pieces = self._mended(out)
        return [*pieces, self.last] if self.last.strip(SPACE) else pieces

    @staticmethod
    def _put(cur: str, out: list[str]) -> None:
        if cur.strip(SPACE):
            out.append(cur.strip(SPACE))

    def _more(self, p: str, out: list[str]) -> None:
        """p goes on with the open paragraph, or begins it."""
        if not self.long:
            self.open = self.open + p if self.open else p.lstrip(SPACE)
            if len(self.open) <= self.target:
                return
            if self.cur:
                out.append(self.cur.strip(SPACE))
            p, self.cur, self.open, self.long = self.open, "", "", True
        *whole, self.tail = _SENTENCE.sub("\\1\x01", self.tail + p).split("\x01")
        for s in whole:
            self._sentence(s, out)
        if self.sliced or len(self.tail) > self.target:
            if self.packed:
                out.append(self.packed.strip(SPACE))
            at, self.packed, self.sliced = 0, "", True
            while at + self.target < len(self.tail):
                out.append(self.tail[at : at + self.target])
                at += self.target - self.overlap
            self.tail = self.tail[at:]

    def _sentence(self, s: str, out: list[str]) -> None:
        longer = f"{self.packed} {s}" if self.packed else s
        if not self.sliced and len(longer) <= self.target:
            self.packed = longer
            return
        if self.packed:
            out.append(self.packed.strip(SPACE))
        self.packed = s
        if self.sliced or len(s) > self.target:
            out += [s[i : i + self.target] for i in range(0, len(s), self.target - self.overlap)]
            self.packed, self.sliced = "", False

    def _close(self, out: list[str]) -> None:
        """The open paragraph ends."""
        if self.long:
            self._sentence(self.tail, out)
            self._put(self.packed, out)
            self.packed, self.tail, self.long = "", "", False
        elif self.open:
            p, self.open = self.open, ""
            longer = f"{self.cur}\n\n{p}" if self.cur else p
            if len(longer) > self.target:
                out.append(self.cur.strip(SPACE))
                tail = self._lap(self.cur)
                longer = f"{tail}\n\n{p}" if tail else p
            self.cur = longer

    def _lap(self, cur: str) -> str:
        if self.overlap <= 0:
            return ""
        tail = cur[-2 * self.overlap :]
        rest = tail[len(tail) // 2 :]
        first = _LAP.match(rest)
        own = (rest[first.end() :] if first else tail[-self.overlap :]).strip(SPACE)
        cut = _BROKEN.match(own)
        return own[cut.end() :].lstrip(SPACE) if cut and "![" not in cut[1] else own

    def _mended(self, pieces: list[str]) -> list[str]:
        out = []
        for p in pieces:
            ends = _URL.match(self.last) if p and p[0] in URL_GOES_ON and "://" in self.last else None
            own = ends[1].rstrip(SPACE) if ends else self.last
            if own.strip(SPACE):
                out.append(own)
            self.last = ends[2] + p if ends else p
        return out


def _pieces(target: int, overlap: int):
    """split_by_size as an Arrow function: a fold whose time grows with a section's length, however many pieces it has (one over arrays copies what is done at each step)."""

    def fold(body: str) -> list[str]:
        if len(body) <= target:
            return [body]
        own = Fold(target, overlap)
        return [*own.feed(body), *own.end()]

    @F.arrow_udf(_STRINGS)
    def pieces(bodies: pa.Array) -> pa.Array:
        return pa.array([None if b is None else fold(b) for b in bodies.to_pylist()], pa.list_(pa.string()))

    return pieces


def _streamed(target: int, overlap: int):
    """Streams fragments in order of document, section and part: the pieces of each section, k in order. A section passes one task, which holds a few of its parts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = at = fold = None
        k = 0
        for rows in batches:
            out: list[tuple] = []
            kind = rows.schema.field("doc_id").type

            def put(pieces: list[str]) -> None:
                nonlocal k
                for p in filter(None, (x.strip(SPACE) for x in pieces)):
                    out.append((*own, k, p))
                    k += 1

            for doc, sec, title, path, body in zip(*(rows.column(n).to_pylist() for n in ("doc_id", "sec", "doc_title", "heading_path", "body"))):
                if (doc, sec) != at:
                    if fold is not None:
                        put(fold.end())
                    own, at, fold, k = (doc, sec, title, path), (doc, sec), Fold(target, overlap, ""), 0
                put(fold.feed(body))
            if out:
                yield _batch(out, kind)
        if fold is not None:
            out = []
            put(fold.end())
            if out:
                yield _batch(out, kind)

    return run


def _batch(rows: list[tuple], kind: pa.DataType) -> pa.RecordBatch:
    kinds = (kind, pa.int64(), pa.string(), pa.list_(pa.string()), pa.int32(), pa.string())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], ["doc_id", "sec", "doc_title", "heading_path", "k", "piece"])


def merge_tiny(chunks: Column, least: int, target: int) -> Column:
    """array<struct<text, path>> where a chunk under `least` characters takes in the next, up to 1.5 targets; it keeps its path."""
    none = F.lit(None).cast("struct<text:string,path:array<string>>")

    def put(a: Column, c: Column) -> Column:
        text = a["cur"]["text"]
        fits = (F.length(text) < least) & (F.length(text) + F.length(c["text"]) <= 1.5 * target)
        joined = F.struct(F.concat(text, F.lit("\n\n"), c["text"]).alias("text"), a["cur"]["path"].alias("path"))
        out = F.when(a["cur"].isNull() | fits, a["out"]).otherwise(F.concat(a["out"], F.array(a["cur"])))
        return F.struct(out.alias("out"), F.when(a["cur"].isNotNull() & fits, joined).otherwise(F.struct(c["text"].alias("text"), c["path"].alias("path"))).alias("cur"))

    empty = F.struct(F.array().cast("array<struct<text:string,path:array<string>>>").alias("out"), none.alias("cur"))
    return F.aggregate(chunks, empty, put, lambda a: F.when(a["cur"].isNull(), a["out"]).otherwise(F.concat(a["out"], F.array(a["cur"]))))


def _heads(least: int, target: int):
    """Streams pieces in order of document and place: which of them begin a chunk, by the rule of merge_tiny on their sizes alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = at = 0
        for rows in batches:
            index, alone = [], []
            for first, size in zip(rows.column("first").to_pylist(), rows.column("size").to_pylist()):
                if not first and held < least and held + size <= 1.5 * target:
                    held += 2 + size
                    alone.append(False)
                else:
                    held, at = size, 0 if first else at + 1
                    alone.append(size >= least)
                index.append(at)
            kept = [rows.column(n) for n in ("doc_id", "sec", "k")]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(index, pa.int32()), pa.array(alone, pa.bool_())], ["doc_id", "sec", "k", "chunk_index", "alone"])

    return run


def chunk_documents(docs: DataFrame, target_tokens: int = TARGET, overlap_tokens: int = OVERLAP, min_chars: int = LEAST) -> DataFrame:
    """The chunks table of docs (doc_id, title, markdown): doc_id, chunk_index, heading_path, page_or_section, text, char_count.

    A giant document spreads over tasks: its sections are split each on its own, and merging is decided on the sizes of
    the pieces, which alone pass one task in order. A chunk of min_chars or more never takes in the next, so its text
    goes straight on; only what begins below that is grouped. The pieces are a written table.

    With a column `part` a document may be many rows (what _fragments says): its parts in that order, cut at ends of lines, and before each heading. No task holds the text of one then.
    """
    target, overlap = target_tokens * CHARS, overlap_tokens * CHARS
    kind = docs.schema["doc_id"].dataType.simpleString()
    named = docs.withColumnRenamed("title", "doc_title")
    if "part" in docs.columns:
        dealt = _fragments(named.select("doc_id", "part", "doc_title", "markdown")).withColumn("_key", F.struct("doc_id", "sec")).repartition("_key").sortWithinPartitions("_key", "part")
        pieces = dealt.select("doc_id", "sec", "doc_title", "heading_path", "body").mapInArrow(_streamed(target, overlap), f"doc_id {kind}, sec bigint, doc_title string, heading_path {_STRINGS}, k int, piece string")
    else:
        sections = _sections(named.select("doc_id", "doc_title", "markdown"), "doc_title")
        pieces = sections.select("doc_id", "sec", "doc_title", "heading_path", F.posexplode(_pieces(target, overlap)("body")).alias("k", "piece")).withColumn("piece", X.strip(F.col("piece"))).where("piece <> ''")
    text = X.context_prefix(F.col("doc_title"), F.col("heading_path"), F.col("piece"))
    with tables.small_batches(docs.sparkSession):
        pieces = tables.written(pieces.select("doc_id", "sec", "k", "heading_path", text.alias("text")).withColumn("size", F.length("text")), "pieces", **tables.DENSE)

    w = Window.partitionBy("doc_id").orderBy("sec", "k")
    sizes = pieces.select("doc_id", "sec", "k", "size", (F.row_number().over(w) == 1).alias("first"))
    placed = sizes.mapInArrow(_heads(min_chars, target), f"doc_id {kind}, sec bigint, k int, chunk_index int, alone boolean")
    key = F.struct("doc_id", "sec", "k").alias("_key")
    whole = pieces.select(key, "heading_path", "text").join(placed.select(key, "chunk_index", "alone"), "_key").select("_key.*", "chunk_index", "alone", "heading_path", "text")
    parts = F.array_sort(F.collect_list(F.struct("sec", "k", "text", F.col("heading_path").alias("path"))))
    grouped = whole.where("not alone").groupBy("doc_id", "chunk_index").agg(parts.alias("p"))
    grouped = grouped.select("doc_id", "chunk_index", F.col("p")[0]["path"].alias("heading_path"), F.array_join("p.text", "\n\n").alias("text"))
    out = whole.where("alone").select("doc_id", "chunk_index", "heading_path", "text").unionByName(grouped)
    return out.select("doc_id", "chunk_index", "heading_path", F.array_join("heading_path", " > ").alias("page_or_section"), "text", F.length("text").alias("char_count"))


def renumber(chunks: DataFrame, order: str) -> DataFrame:
    """chunks (doc_id, …) with chunk_index from 0 in each document by the column `order`, without gaps, in place of what stood there."""
    place = F.row_number().over(Window.partitionBy("doc_id").orderBy(order)) - 1
    return chunks.select("*", place.alias("_place")).withColumn("chunk_index", F.col("_place")).drop("_place")
