"""Documents put together from pages, topics, segments and placeholders."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltstone.functions import text as X
from siltstone.operators.tables import written


def assemble_pages(pages: DataFrame) -> DataFrame:
    """doc_id, markdown: `# title`, then `## Page n` and the text of each page that has any, in order. Needs doc_id, title, page, text."""
    body = F.when(X.strip(F.col("text")) != "", F.concat(F.lit("## Page "), F.col("page").cast("string"), F.lit("\n\n"), X.strip(F.col("text")), F.lit("\n")))
    parts = F.array_sort(F.collect_list(F.when(body.isNotNull(), F.struct("page", body.alias("md")))))
    by = pages.groupBy("doc_id").agg(F.first("title").alias("title"), parts.alias("parts"))
    lines = F.concat(F.array(F.concat(F.lit("# "), F.col("title"), F.lit("\n"))), F.col("parts.md"))
    return by.select("doc_id", X.strip(F.array_join(lines, "\n")).alias("markdown"))


def scanned_suspect(pages: DataFrame, most: float = 0.30) -> DataFrame:
    """doc_id, pages, empty_text_pages (in order), scanned_suspect: more than `most` of the pages have no text."""
    empty = X.strip(F.coalesce("text", F.lit(""))) == ""
    by = pages.groupBy("doc_id").agg(F.count("*").alias("pages"), F.array_sort(F.collect_list(F.when(empty, F.col("page")))).alias("empty_text_pages"))
    return by.withColumn("scanned_suspect", F.size("empty_text_pages") / F.col("pages") > most)


def topic_order(topics: DataFrame) -> DataFrame:
    """topics (map_id, topic_id, parent_id, ord) that a root reaches, with root (its root's ord), root_no, level (1: a root) and place: greater places come first in pre-order.

    The walk through a map is a list: a topic is entered, then its children in the order of ord (nulls last) and topic_id, then it is left. Each step knows the next one;
    pointer doubling joins the list with itself, so that after k rounds a step knows how many follow within 2**k and what they add to the depth:
    rounds grow with the logarithm of the largest map, whatever its depth. Of rows of one topic_id the first holds the children. Topics that aren't reached (a parent is missing, or they
    are a circle of their own) are left out.
    """
    order = (F.asc_nulls_last("ord"), "topic_id", "node")
    nodes = written(topics.withColumn("node", F.monotonically_increasing_id()), "topics")
    first = F.row_number().over(Window.partitionBy("map_id", "topic_id").orderBy(*order))
    holders = nodes.withColumn("_k", first).where("_k = 1 and topic_id is not null").select("map_id", F.col("topic_id").alias("parent_id"), F.col("node").alias("up"))
    linked = nodes.select("map_id", "topic_id", "parent_id", "ord", "node").join(holders, ["map_id", "parent_id"], "left")
    among = Window.partitionBy("up").orderBy(*order)
    linked = linked.withColumn("after", F.when(F.col("up").isNotNull(), F.lead("node").over(among)))
    child = linked.where("up is not null").groupBy("up").agg(F.min_by("node", F.struct(F.col("ord").isNull(), "ord", "topic_id", "node")).alias("child")).withColumnRenamed("up", "node")
    linked = linked.join(child, "node", "left")
    enter, leave = F.col("node") * 2, F.col("node") * 2 + 1
    step = lambda at, to, d: F.struct(at.alias("at"), to.alias("to"), F.lit(1).cast("bigint").alias("n"), F.lit(d).cast("bigint").alias("d"))
    steps = linked.select(F.explode(F.array(step(enter, F.coalesce(F.col("child") * 2, leave), 1), step(leave, F.coalesce(F.col("after") * 2, F.col("up") * 2 + 1), -1))).alias("s")).select("s.*")
    steps = written(steps.withColumn("last", F.coalesce("to", "at")), "steps")
    for _ in range(max(1, (2 * nodes.count()).bit_length())):
        if steps.where("to is not null").isEmpty():
            break
        ahead = steps.select(F.col("at").alias("_at"), F.col("to").alias("_to"), F.col("n").alias("_n"), F.col("d").alias("_d"), F.col("last").alias("_last"))
        both = steps.join(ahead, F.col("to") == F.col("_at"), "left")
        more = lambda c: F.col(c) + F.coalesce(F.col(f"_{c}"), F.lit(0))
        steps = written(both.select("at", F.col("_to").alias("to"), more("n").alias("n"), more("d").alias("d"), F.coalesce("_last", "last").alias("last")), "steps")
    roots = nodes.where("parent_id is null").select((F.col("node") * 2 + 1).alias("last"), F.col("ord").alias("root"), F.col("node").alias("root_no"))
    found = steps.where("to is null and at % 2 = 0").join(roots, "last").select((F.col("at") / 2).cast("bigint").alias("node"), "root", "root_no", (1 - F.col("d")).cast("int").alias("level"), F.col("n").alias("place"))
    return nodes.join(found, "node").drop("node")


def topics_to_markdown(topics: DataFrame) -> DataFrame:
    """map_id, markdown of topic trees (map_id, topic_id, parent_id, ord, title, links, note, note_links), in pre-order (topic_order).

    The root's title is the document's; a topic d levels below it has a heading of level least(d + 1, 6). Links follow the
    title, then the note, then its links that weren't listed. A topic that no root reaches is left out.
    """
    nodes = topic_order(topics)
    link = lambda urls: F.transform(urls, lambda u: F.concat(F.lit("_Lien : "), u, F.lit("_")))
    head = F.when(F.coalesce(F.length("title"), F.lit(0)) > 0, F.concat(F.repeat(F.lit("#"), F.least(F.col("level") + 1, F.lit(6))), F.lit(" "), F.col("title")))
    own, more = X.clean_links(F.coalesce("links", F.array())), X.clean_links(F.coalesce("note_links", F.array()))
    parts = F.concat(F.array(head), link(own), F.array(F.nullif("note", F.lit(""))), link(F.array_except(more, own)))
    block = F.array_join(F.filter(parts, lambda x: x.isNotNull()), "\n\n")
    place = F.struct(F.col("root").isNull().alias("late"), "root", "root_no", (-F.col("place")).alias("place"), block.alias("md"))
    by = nodes.groupBy("map_id").agg(F.max(F.when(F.col("level") == 1, F.col("title"))).alias("t"), F.array_sort(F.collect_list(place)).alias("parts"))
    return by.select("map_id", F.concat(F.lit("# "), F.col("t"), F.lit("\n\n"), F.array_join(F.filter("parts.md", lambda m: m != ""), "\n\n")).alias("markdown"))


def next_at(rows: DataFrame, group: str, at: str, number: str, gap: float) -> DataFrame:
    """group, number, next: for each row (group, at, number) the least number of its group whose `at` is `gap` or more after its own, null if there is none.

    number rises with at. Rows and the times they ask for are range-sorted together, so a large group spans several tasks: each range answers what it can, and takes the first row of a later range of the
    group for the rest.
    """
    seen = rows.select(F.col(group).alias("g"), F.col(at).alias("at"), F.lit(1).alias("kind"), F.col(number).alias("no"))
    asks = rows.select(F.col(group).alias("g"), (F.col(at) + gap).alias("at"), F.lit(0).alias("kind"), F.col(number).alias("no"))
    ranged = written(seen.unionByName(asks).repartitionByRange("g", "at", "kind").withColumn("_range", F.spark_partition_id()), "ranges")
    later = Window.partitionBy("_range", "g").orderBy(F.desc("at"), F.desc("kind"), F.desc("no")).rowsBetween(Window.unboundedPreceding, 0)
    own = ranged.withColumn("here", F.last(F.when(F.col("kind") == 1, F.col("no")), True).over(later)).where("kind = 0")
    firsts = ranged.groupBy("g", "_range").agg(F.min(F.when(F.col("kind") == 1, F.col("no"))).alias("first"))
    beyond = Window.partitionBy("g").orderBy(F.desc("_range")).rowsBetween(Window.unboundedPreceding, -1)  # one row a range
    firsts = firsts.select(F.col("g").alias("_g"), F.col("_range").alias("_r"), F.last("first", True).over(beyond).alias("beyond"))
    found = own.join(firsts, F.col("g").eqNullSafe(F.col("_g")) & (F.col("_range") == F.col("_r")))
    return found.select(F.col("g").alias(group), F.col("no").alias(number), F.coalesce("here", "beyond").alias("next"))


def group_segments(segments: DataFrame, seconds: float = 60.0) -> DataFrame:
    """video_id, group_no, start, end, text, heading: a new group begins at a segment `seconds` or more after its group's start.

    Needs video_id, start, duration, text; segments without text or start are dropped first; they are taken by start, duration and text. Each segment knows the one that would begin the next group if it
    began one (next_at); those that do are reached from a video's first by pointer doubling, in rounds that grow with the logarithm of its groups. A video of any length spans several tasks.
    """
    number = lambda c: F.col(c).cast("double").alias(c)
    clean = segments.select("video_id", number("start"), F.coalesce(F.col("duration").cast("double"), F.lit(0.0)).alias("duration"), X.strip(F.col("text")).alias("text")).where("text <> '' and start is not null")
    placed = written(positions(clean, "video_id", [F.col("start"), F.col("duration"), F.col("text")]).withColumnRenamed("position", "no"), "segments")
    jump = step = written(next_at(placed, "video_id", "start", "no", seconds), "next")
    reached = placed.where("no = 1").select("video_id", "no")
    side = lambda df: df.select(F.col("video_id").alias("_v"), F.col("no").alias("_no"), F.col("next").alias("_next"))
    same = lambda c: F.col("video_id").eqNullSafe(F.col("_v")) & (F.col(c) == F.col("_no"))
    while True:
        more = reached.join(side(jump.where("next is not null")), same("no")).select("video_id", F.col("_next").alias("no"))
        more = written(more, "reached")
        if more.isEmpty():
            break
        reached = written(reached.unionByName(more), "reached")
        jump = written(jump.where("next is not null").join(side(jump), same("next")).select("video_id", "no", F.col("_next").alias("next")), "jump")
    most = placed.groupBy(F.col("video_id").alias("_m")).agg(F.max("no").alias("most"))
    begins = reached.join(side(step), same("no")).join(most, F.col("video_id").eqNullSafe(F.col("_m")))
    begins = positions(begins.select("video_id", "no", F.coalesce("_next", F.col("most") + 1).alias("until")), "video_id", [F.col("no")])
    member = begins.select(F.col("video_id").alias("_v"), (F.col("position") - 1).cast("int").alias("group_no"), F.explode(F.sequence(F.col("no"), F.col("until") - 1)).alias("_no"))
    parts = F.array_sort(F.collect_list(F.struct("no", "start", "duration", "text")))
    by = placed.join(member, same("no")).groupBy("video_id", "group_no").agg(parts.alias("s"))
    last = F.element_at("s", -1)
    by = by.select("video_id", "group_no", F.col("s")[0]["start"].alias("start"), (last["start"] + last["duration"]).alias("end"), F.array_join("s.text", " ").alias("text"))
    heading = F.concat(F.lit("## ["), X.format_timestamp(F.col("start")), F.lit("] Segment à "), X.format_timestamp(F.col("start")))
    return by.withColumn("heading", heading)


def inject_ordered(docs: DataFrame, refs: DataFrame, placeholder: str = "<!-- image -->", title: str = "## Autres images du document") -> DataFrame:
    """docs (doc_id, markdown) with the k-th placeholder replaced by the k-th ref (doc_id, k from 1, ref).

    An empty or missing ref deletes its placeholder; refs without a placeholder that aren't empty follow under `title`.
    """
    by = refs.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("k", F.coalesce("ref", F.lit("")).alias("ref")))).alias("r")).select("doc_id", F.col("r.ref").alias("refs"))
    out = docs.join(by, "doc_id", "left").withColumn("refs", F.coalesce("refs", F.array().cast("array<string>")))
    parts = F.split("markdown", F.regexp_replace(F.lit(placeholder), r"([\\.\[\]{}()*+?^$|])", r"\\$1"))
    body = F.array_join(F.transform(parts, lambda p, i: F.concat(F.when(i > 0, F.coalesce(F.get("refs", i - 1), F.lit(""))).otherwise(""), p)), "")
    rest = F.filter(F.slice("refs", F.size(parts), F.greatest(F.size("refs") - F.size(parts) + 1, F.lit(0))), lambda r: r != "")
    tail = F.when(F.size(rest) > 0, F.concat(F.lit(f"\n\n{title}\n\n"), F.array_join(rest, "\n\n"))).otherwise("")
    return out.withColumn("markdown", F.concat(body, tail)).drop("refs")


def inject_by_number(docs: DataFrame, notes: DataFrame, order: str | None = None) -> DataFrame:
    """docs (doc_id, markdown) with note n (doc_id, number, note) after `<!-- Slide number: n -->`, with any white space around n.

    Of several notes of one number the last by the column `order` counts (without one: the greatest). Null and empty notes and notes without a mark are left out.
    """
    some = notes.where("number is not null and note <> ''")
    one = some.groupBy("doc_id", "number").agg((F.max("note") if order is None else F.max_by("note", F.struct(order, "note"))).alias("note"))
    by = one.groupBy("doc_id").agg(F.map_from_entries(F.collect_list(F.struct("number", "note"))).alias("notes"))
    out = docs.join(by, "doc_id", "left")
    mark = r"<!-- Slide number:\s*([0-9]+)\s*-->"
    note = lambda m: F.try_element_at("notes", F.regexp_extract(m, mark, 1).try_cast("int"))
    after = lambda p, m: F.concat(p, F.coalesce(m, F.lit("")), F.coalesce(F.concat(F.lit("\n\n"), note(m), F.lit("\n")), F.lit("")))
    body = F.array_join(F.zip_with(F.split("markdown", mark), F.regexp_extract_all("markdown", F.lit(mark), F.lit(0)), after), "")  # one part more than marks
    return out.withColumn("markdown", body).drop("notes")


def natural_order(name: Column) -> list[Column]:
    """Sort keys: the first number of the base name (0 without), then the whole name."""
    base = F.regexp_extract(name, r"([^/\\]*)$", 1)
    return [F.coalesce(F.regexp_extract(base, r"(\d+)", 1).try_cast("bigint"), F.lit(0)), name]


def natural_positions(files: DataFrame, group: str, name: str = "name") -> DataFrame:
    """files with position: from 1 in each group, by natural order; equal names take following positions."""
    return positions(files, group, natural_order(F.col(name)))


def positions(rows: DataFrame, group: str, order: list[Column]) -> DataFrame:
    """rows with position: from 1 in each group, in this order; equal rows take following positions.

    The rows are range-sorted by group and order, so a large group spans several tasks; each (range, group) then counts on from those before it.
    """
    ranged = written(rows.repartitionByRange(F.col(group), *order).withColumn("_range", F.spark_partition_id()), "positions")
    before = Window.partitionBy(group).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = ranged.groupBy(group, "_range").agg(F.count("*").alias("_n")).select(F.col(group).alias("_g"), F.col("_range").alias("_r"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    own = F.row_number().over(Window.partitionBy("_range", group).orderBy(*order))
    out = ranged.withColumn("_own", own).join(starts, F.col(group).eqNullSafe(F.col("_g")) & (F.col("_range") == F.col("_r")))
    return out.withColumn("position", F.col("_before") + F.col("_own")).drop("_range", "_own", "_g", "_r", "_before")


def rebase_identity(docs: DataFrame) -> DataFrame:
    """docs (doc_id, source_name, markdown, upload_name) renamed to their upload's name where it has one: new doc_id, image references and hash."""
    new = X.doc_id(F.col("upload_name"))
    moved = F.regexp_replace("markdown", F.concat(F.lit(rf"({X.IMAGE_SCHEME}://[^/\s)]+/)"), F.col("doc_id"), F.lit("/")), F.concat(F.lit("$1"), new, F.lit("/")))
    named = F.coalesce(F.length("upload_name"), F.lit(0)) > 0
    out = docs.withColumns({"markdown": F.when(named, moved).otherwise(F.col("markdown")), "doc_id": F.when(named, new).otherwise(F.col("doc_id")), "source_name": F.when(named, F.col("upload_name")).otherwise(F.col("source_name"))})
    return out.withColumn("content_hash", X.content_hash(F.col("markdown")))


def flatten_metadata(metadata: Column) -> Column:
    """map<string, array<string>> to map<string, string>: nulls go, lists are joined by a comma and a space."""
    return F.transform_values(F.map_filter(metadata, lambda _, v: v.isNotNull()), lambda _, v: F.array_join(v, ", "))


def payload(docs: DataFrame, chunks: DataFrame, extras: str | None = None) -> DataFrame:
    """The eight payload fields of each chunk (doc_id, chunk_index, heading_path, page_or_section, text); a map column `extras` of docs adds keys without overriding."""
    meta = docs.select("doc_id", "source_name", "doc_type", "content_hash", *([extras] if extras else []))
    out = chunks.join(meta, "doc_id")
    fields = ["doc_id", "source_name", "doc_type", "page_or_section", "chunk_index", F.col("heading_path").alias("headers"), "text", "content_hash"]
    if not extras:
        return out.select(*fields)
    base = F.create_map(*[x for name in ("doc_id", "source_name", "doc_type") for x in (F.lit(name), F.col(name).cast("string"))])
    own = F.map_concat(F.map_filter(extras, lambda k, _: ~F.array_contains(F.map_keys(base), k)), base)
    return out.select(*fields, own.alias("metadata"))


def split_lines_into_pages(docs: DataFrame, lines: int = 5) -> DataFrame:
    """doc_id, page, text: pages of `lines` lines of a text column."""
    rows = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("at", "line"))
    by = rows.groupBy("doc_id", (F.floor(F.col("at") / lines) + 1).cast("int").alias("page"))
    return by.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "line"))), lambda x: x["line"]), "\n").alias("text"))
