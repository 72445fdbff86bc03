"""Pages to markdown from one stream of tags, texts and entities."""

from __future__ import annotations

from html.entities import name2codepoint

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltstone.operators.tables import parts

DROPPED = r"(?is)<!--.*?-->|<script\b.*?</script\s*>|<style\b.*?</style\s*>|<head\b.*?</head\s*>"
TOKEN = r"(<[^>]*>|&#?[A-Za-z0-9]{1,31};|[^<&]+|[<&])"
BLOCKS = ("p", "div", "ul", "ol", "table", "section", "article", "br")
HEADINGS = tuple(f"h{k}" for k in range(1, 7))
#: Bytes of pages that one task takes.
PAGE_BYTES = 2 << 20
#: Stand for the line ends and spaces of preformatted text until all others are tidied.
KEPT = (("\n", "\u0001"), (" ", "\u0002"))


def decoded(entity: Column) -> Column:
    """The character of a numeric entity, null for other texts and numbers without a character."""
    digits = F.regexp_extract(entity, r"^&#([0-9]{1,7});$", 1)
    hexes = F.regexp_extract(entity, r"^&#[xX]([0-9A-Fa-f]{1,6});$", 1)
    number = F.coalesce(digits.try_cast("bigint"), F.conv(F.nullif(hexes, F.lit("")), 16, 10).try_cast("bigint"))
    fits = (number > 0) & (number < 0x110000) & ~number.between(0xD800, 0xDFFF)
    return F.when(fits, F.decode(F.unhex(F.lpad(F.hex(number), 8, "0")), "UTF-32"))


def html_to_markdown(pages: DataFrame, key: str, html: str = "html") -> DataFrame:
    """key, markdown of pages (key, unique; html); null for a page without text.

    Headings, paragraphs, items of nested and numbered lists, links, rows of tables (cells parted by ` | `), preformatted text and entities (numeric and named); scripts, styles, comments and other tags go.
    A link that holds headings goes into each of them; a link without a closing tag is text. The page is split into tokens once; what a token
    means follows from running counts over those before it (open lists, cells of the row, the last link). All windows use one shuffle, by key, to as many tasks as the bytes of the pages need.
    """
    spark = pages.sparkSession
    size = pages.agg(F.sum(F.octet_length(html))).first()[0] or 0
    clean = F.regexp_replace(html, DROPPED, "")
    dealt = pages.select(F.col(key).alias("k"), clean.alias("t")).repartition(parts(spark, size, PAGE_BYTES), "k")
    rows = dealt.select("k", F.posexplode_outer(F.regexp_extract_all("t", F.lit(TOKEN), F.lit(1))).alias("pos", "tok"))
    tag = F.lower(F.regexp_extract("tok", r"^</?([A-Za-z][A-Za-z0-9]*)\b[^>]*>$", 1))
    rows = rows.select("*", tag.alias("tag"), F.startswith("tok", F.lit("</")).alias("shut"), F.col("tok").rlike(r"^<[^>]*>$").alias("markup"))
    names = {n: " " if n == "nbsp" else chr(c) for n, c in name2codepoint.items()} | {"apos": "'"}
    known = spark.createDataFrame([(f"&{n};", c) for n, c in names.items()], "tok string, char string")
    rows = rows.join(F.broadcast(known), "tok", "left")  # one row a name

    opens = lambda *tags: F.col("tag").isin(*tags) & ~F.col("shut")
    shuts = lambda *tags: F.col("tag").isin(*tags) & F.col("shut")
    page = Window.partitionBy("k").orderBy("pos")
    so_far, behind = page.rowsBetween(Window.unboundedPreceding, 0), page.rowsBetween(Window.unboundedPreceding, -1)
    ahead = Window.partitionBy("k").orderBy(F.desc("pos")).rowsBetween(Window.unboundedPreceding, -1)
    nested = lambda *tags: F.sum(F.when(opens(*tags), 1).when(shuts(*tags), -1).otherwise(0)).over(so_far)
    href = F.when(opens("a") & F.col("tok").rlike(r"""(?i)\bhref=["']"""), F.regexp_extract("tok", r"""(?i)\bhref=["']([^"']*)["']""", 1))
    link = F.when(F.col("tag") == "a", F.struct(F.col("shut").alias("shut"), href.alias("href")))
    rows = rows.withColumns({"link": link, "lists": nested("ul", "ol"), "pre": nested("pre"), "row": F.count(F.when(opens("tr"), 1)).over(so_far)})
    rows = rows.withColumns({"last": F.last("link", True).over(behind), "next": F.last("link", True).over(ahead)})
    starts = opens("a") & F.col("link.href").isNotNull() & F.coalesce(F.col("next.shut"), F.lit(False))
    ends = shuts("a") & F.col("last.href").isNotNull()
    rows = rows.withColumns({"starts": starts, "ends": ends, "link_no": F.count(F.when(starts, 1)).over(so_far)})
    held = Window.partitionBy("k", "link_no").orderBy("pos")
    rows = rows.withColumns({"over": F.count(F.when(F.col("ends"), 1)).over(held.rowsBetween(Window.unboundedPreceding, -1)), "url": F.first(F.when(F.col("starts"), F.col("link.href")), True).over(held.rowsBetween(Window.unboundedPreceding, 0))})
    rows = rows.withColumn("inside", (F.col("link_no") > 0) & (F.col("over") == 0))
    whole = Window.partitionBy("k", "link_no")
    rows = rows.withColumn("headed", F.max(F.when(F.col("inside") & opens(*HEADINGS), 1).otherwise(0)).over(whole) == 1)
    level = Window.partitionBy("k", "lists").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("list", F.last(F.when(opens("ul", "ol"), F.struct("pos", "tag")), True).over(level))
    item = Window.partitionBy("k", "lists", "list.pos").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    cell = Window.partitionBy("k", "row").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumns({"item": F.count(F.when(opens("li"), 1)).over(item), "cell": F.count(F.when(opens("td", "th"), 1)).over(cell)})

    text = F.coalesce("char", decoded(F.col("tok")), F.col("tok"))
    raw = text
    for plain, kept in KEPT:
        raw = F.replace(raw, F.lit(plain), F.lit(kept))
    text = F.when(F.col("pre") > 0, raw).when(F.col("char").isNotNull() | F.startswith("tok", F.lit("&")), text).otherwise(F.regexp_replace(text, r"\s+", " "))
    linked = F.col("inside") & F.col("headed")
    mark = F.concat(F.repeat(F.lit("#"), F.substring("tag", 2, 1).cast("int")), F.lit(" "))
    bullet = F.when(F.col("list.tag") == "ol", F.concat(F.col("item").cast("string"), F.lit(". "))).otherwise("- ")
    target = F.concat(F.lit("]("), F.col("url"), F.lit(")"))
    out = F.when(~F.col("markup"), text).when(opens(*HEADINGS), F.concat(F.lit("\n\n"), mark, F.when(linked, "[").otherwise("")))
    out = out.when(shuts(*HEADINGS), F.concat(F.when(linked, target).otherwise(""), F.lit("\n\n"))).when(opens("li"), F.concat(F.lit("\n"), F.repeat(F.lit("\u0002\u0002"), F.greatest(F.col("lists") - 1, F.lit(0)).cast("int")), bullet))
    out = out.when(F.col("starts"), F.when(F.col("headed"), "").otherwise("[")).when(F.col("ends"), F.when(F.col("headed"), "").otherwise(target))
    out = out.when(opens("td", "th") & (F.col("cell") > 1), " | ").when(opens("pre"), "\n\n```\n").when(shuts("pre"), "\n```\n\n").when(F.col("tag").isin("tr"), "\n").when(F.col("tag").isin(*BLOCKS), "\n\n").otherwise("")
    pieces = F.array_sort(F.collect_list(F.struct(F.coalesce("pos", F.lit(0)).alias("pos"), F.coalesce(out, F.lit("")).alias("out"))))
    by = rows.groupBy("k").agg(F.array_join(F.transform(pieces, lambda x: x["out"]), "").alias("t"))
    tidy = F.regexp_replace(F.regexp_replace("t", r" *\n *", "\n"), r"\n{3,}", "\n\n")
    tidy = F.nullif(F.regexp_replace(tidy, r"^\s+|\s+$", ""), F.lit(""))
    for plain, kept in KEPT:
        tidy = F.replace(tidy, F.lit(kept), F.lit(plain))
    return by.select(F.col("k").alias(key), tidy.alias("markdown"))
