"""Exact n-gram Jaccard self-join by grouped prefixes, down to the components of its links."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siltstone.llm import common, words
from siltstone.llm.components import components

#: Words of a shingle; per cent of the union that two documents must share; further tokens of a first prefix, per cent.
SHINGLE, PERCENT, FURTHER = 5, 75, 10
#: Texts of one batch in which a shingle stands to be counted as frequent; hot shingles at most; tasks that a hot shingle's rows go to; bands of size for each step of the ratio that links allow.
OFTEN, HOT, SPREAD, BANDS = 16, 50_000, 1024, 4
OWN = ("_near_key", "_near_n", "_near_row")
_PLACE = [np.uint64(2 * pow(0x9E3779B97F4A7C15, k + 2, 1 << 63) + 1) for k in range(64)]


def shingle_sets(column: pa.Array, shingle: int) -> list[np.ndarray]:
    """The sorted distinct 64-bit shingle hashes of each text: words lower-cased in A to Z; a text of fewer words is one shingle."""
    data, offsets = words.utf8(column)
    out: list[np.ndarray] = []
    for lo, hi in words.runs(offsets, 1 << 20):
        at = offsets[lo : hi + 1] - offsets[lo]
        hashes, _, first = words.word_hashes(data[offsets[lo] : offsets[hi]], at)
        full = max(0, len(hashes) - shingle + 1)
        grams = np.zeros(full, np.uint64)
        for k in range(shingle):
            grams += hashes[k : k + full] * _PLACE[k]
        grams = words.mix(grams).view(np.int64)
        for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
            if b - a >= shingle:
                out.append(np.unique(grams[a : b - shingle + 1]))
            elif b > a:
                few = (hashes[a:b] * np.array(_PLACE[shingle : shingle + b - a])).sum(keepdims=True) + np.uint64(b - a)
                out.append(words.mix(few).view(np.int64))
            else:
                out.append(np.zeros(0, np.int64))
    return out


def _sizes(docs: DataFrame, shingle: int) -> DataFrame:
    """node, n of each text (h null), and h, n of shingles that stand in OFTEN or more texts of one batch (node null)."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = shingle_sets(batch.column(1), shingle)
            h, k = np.unique(np.concatenate([np.zeros(0, np.int64), *sets]), return_counts=True)
            h, k = h[k >= OFTEN], k[k >= OFTEN]
            nodes = pa.concat_arrays([batch.column(0), pa.nulls(len(h), pa.int64())])
            n = np.concatenate([np.fromiter(map(len, sets), np.int64, len(sets)), k])
            yield pa.RecordBatch.from_arrays([nodes, pa.array(n), pa.concat_arrays([pa.nulls(len(sets), pa.int64()), pa.array(h, pa.int64())])], ["node", "n", "h"])

    return docs.select("node", "text").mapInArrow(emit, "node bigint, n bigint, h bigint")


def _tokens(docs: DataFrame, shingle: int, share: tuple[int, int]) -> DataFrame:
    """h, node, n: the tokens of each text in the order of their hash, up to n - share[0] % of n + share[1] % of n + 1 of them."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = shingle_sets(batch.column(1), shingle)
            full = np.array([len(s) for s in sets], np.int64)
            taken = np.minimum(full, full + (-share[0] * full // 100) + 1 - (-share[1] * full // 100))
            h = np.concatenate([s[:k] for s, k in zip(sets, taken.tolist())]) if sets else np.zeros(0, np.int64)
            ids = np.repeat(batch.column(0).to_numpy(), taken)
            yield pa.RecordBatch.from_arrays([pa.array(h), pa.array(ids), pa.array(np.repeat(full, taken).astype(np.int32))], ["h", "node", "n"])

    return docs.select("node", "text").mapInArrow(emit, "h bigint, node bigint, n int")


def _linked(inter: Column, na: Column, nb: Column, percent: int) -> Column:
    return 100 * inter >= percent * (na + nb - inter)


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Those pairs (a, b) of nodes that link."""
    left = sets.select(F.col("node").alias("a"), F.col("n").alias("na"), F.col("shared").alias("sa"))
    right = sets.select(F.col("node").alias("b"), F.col("n").alias("nb"), F.col("shared").alias("sb"))
    both = pairs.join(left, "a").join(right, "b")
    return both.where(_linked(F.size(F.array_intersect("sa", "sb")), F.col("na"), F.col("nb"), percent)).select("a", "b")


def _counted(tokens: DataFrame, hot: DataFrame) -> DataFrame:
    """tokens with df, the number of rows of their h. Rows of a hot shingle are spread over SPREAD tasks; all of them get the count in hot."""
    tokens = tokens.join(common.small(hot), "h", "left")
    salt = F.when(F.col("often").isNotNull(), F.pmod("node", F.lit(SPREAD))).otherwise(-1)
    df = F.coalesce("often", F.count("*").over(Window.partitionBy("h", "salt")))
    return tokens.withColumn("salt", salt).withColumn("df", df).drop("salt", "often")


def _nodes(docs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, bool]:
    """Each distinct text as a node: (node, text of one row of each), (key of a row, rep: its node), (node, least: its smallest doc_id), are ids distinct.

    Where all ids are set and distinct, a node is the smallest doc_id of its text and the key is doc_id. Else nodes are numbered in
    the order of their smallest doc_id (null last) and the key is the MD5 of the text: rows of one id with different
    texts, and rows without an id, are documents of their own.
    """
    own = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    keyed = common.settle(own.select("doc_id", F.md5("text").alias("key")))
    if not keyed.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1 or doc_id is null").limit(1).count():
        least = common.settle(keyed.groupBy("key").agg(F.min("doc_id").alias("rep")))
        rows = common.settle(keyed.join(least, "key").select(F.col("doc_id").alias("key"), "rep"))
        copies = common.small(common.settle(rows.where("key <> rep").select("key")))
        texts = own.join(copies, F.col("doc_id") == F.col("key"), "left_anti").select(F.col("doc_id").alias("node"), "text")
        return texts, rows, rows.where("key = rep").select(F.col("rep").alias("node"), F.col("rep").alias("least")), True
    least = keyed.groupBy("key").agg(F.min("doc_id").alias("least")).orderBy(F.asc_nulls_last("least"), "key")
    least = common.settle(least.select("key", "least", F.monotonically_increasing_id().alias("rep")))
    once = own.groupBy(F.md5("text").alias("key")).agg(F.first("text").alias("text"))
    return once.join(least, "key").select(F.col("rep").alias("node"), "text"), least.select("key", "rep"), least.select(F.col("rep").alias("node"), "least"), False


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT, further: int = FURTHER) -> DataFrame:
    """docs with n_shingles, component_id (the smallest doc_id that links reach from the document, its own included) and leads.

    Two documents link when their sets of distinct shingles share at least `percent` per cent of their union. A text
    without words (or null) has no shingles and no links. Every row is judged by its own text, whether its id is null
    or stands in several rows; a component_id is null if no row of the component has an id. leads marks the rows of one text of
    each component, and rows without words: where ids are distinct, one row. An empty table gives an empty
    table; columns with the new names are replaced, all others stay.

    1. Equal texts become one node. 2. First prefix, in the order of the hashes: whoever shares too few of its tokens
    with anyone can't link and leaves. 3. Those left get their exact document frequencies; rare tokens come first, and
    whoever shares less than `percent` of its tokens leaves. 4. Equal prefixes and sizes become one group. 5. Each group is
    verified against the least group of its prefix tokens, which joins large groups of copies by as many pairs as
    they have members. 6. Then all group pairs that meet in a prefix token, pass the size and position filters and stand in
    different components are expanded to members and verified. A pair within one component can't change it.

    Shingles that stand in many texts (OFTEN of one batch and a HOT part of all tokens: at most HOT of them) are known
    after the first pass; their rows are spread over many tasks.
    """
    docs, back = common.aside(docs, OWN)
    return _classified(docs, shingle, percent, further)[0].withColumnsRenamed(back)


def _classified(docs: DataFrame, shingle: int, percent: int, further: int) -> tuple[DataFrame, bool]:
    """The rows of near_duplicates, and whether ids are set and distinct."""
    new = ("n_shingles", "component_id", "leads")
    docs = docs.select(*[c for c in docs.columns if c not in new])
    common.arrow_batches(docs.sparkSession)
    texts, rows, nodes, distinct = _nodes(docs)
    key = F.col("doc_id") if distinct else F.md5(F.coalesce("text", F.lit("")))
    seen = common.settle(_sizes(texts, shingle))
    sizes = seen.where("h is null").select("node", "n")
    hot = seen.where("h is not null").groupBy("h").agg(F.sum("n").alias("often"))
    every = sizes.agg(F.sum("n")).first()[0] or 0
    hot = common.settle(hot.where(F.col("often") >= max(every / HOT, OFTEN * 16)))

    first = _counted(_tokens(texts, shingle, (percent, further)), hot)
    need = F.ceil(F.col("n") * (percent * further / 10000) - 1e-9)
    left = first.where("df > 1").groupBy("node", "n").agg(F.count("*").alias("met")).where(F.col("met") >= F.greatest(need, F.lit(1)))
    left = common.settle(left.select("node").distinct())

    some = texts.join(common.small(left), "node", "left_semi")
    full = _counted(_tokens(some, shingle, (0, 0)), hot).where("df > 1")
    by = full.groupBy("node", "n").agg(F.sort_array(F.collect_list(F.struct("df", "h"))).alias("t"))
    least_shared = F.ceil(F.col("n") * percent / 100).cast("int")
    by = by.where(F.size("t") >= least_shared).withColumn("shared", F.col("t.h"))
    alone = F.col("n") - F.size("shared")
    length = F.greatest(F.col("n") - least_shared + 1 - alone, F.lit(0))
    sets = common.settle(by.select("node", "n", "shared", F.slice("shared", F.lit(1), length).alias("prefix"), alone.alias("alone")))

    groups = common.settle(sets.groupBy("n", "alone", "prefix").agg(F.min("node").alias("group"), F.count("*").alias("members")))
    member = common.settle(sets.join(groups.where("members > 1").drop("members"), ["n", "alone", "prefix"]).select("node", "group"))
    tokens = groups.select("group", "n", "alone", F.posexplode("prefix").alias("at", "h")).select("h", "group", F.col("n").cast("bigint").alias("n"), (F.col("at") + F.col("alone")).alias("pos"))
    tokens = common.settle(tokens)

    least_of = tokens.groupBy("h").agg(F.min("group").alias("head"), F.max("group").alias("tail")).where("head < tail").select("h", "head")
    least_of = common.settle(least_of)
    star = tokens.select("h", "group").join(common.small(least_of), "h").where("head < group").groupBy("group").agg(F.min("head").alias("b"))
    star = star.select(F.col("group").alias("a"), "b").unionByName(member.where("node <> group").select(F.col("node").alias("a"), F.col("group").alias("b")))
    links = common.settle(_verified(star, sets, percent))

    labels = components(links)
    members = sets.select("node").join(member, "node", "left").select("node", F.coalesce("group", "node").alias("group"))
    members = common.settle(members.join(labels.withColumnRenamed("id", "node"), "node", "left").select("node", "group", F.coalesce("label", "node").alias("label")))
    more = _apart(tokens, members, percent)
    common.discard(labels, left, groups, member, tokens, least_of)
    links = common.settle(links.unionByName(_verified(more, sets, percent)))
    labels = components(links)
    common.discard(sets, members, more, links, hot)

    placed = nodes.join(sizes, "node").join(labels.withColumnRenamed("id", "node"), "node", "left").withColumn("label", F.coalesce("label", "node"))
    named = nodes.select(F.col("node").alias("label"), F.col("least").alias("component_id"))
    found = rows.join(placed.join(named, "label").select(F.col("node").alias("rep"), "n", "label", "component_id"), "rep")
    found = found.select(F.col("key").alias("_near_key"), F.col("n").alias("n_shingles"), "component_id", (F.col("rep") == F.col("label")).alias("leads"))
    found = common.settle(found)
    common.discard(labels, seen)
    out = docs.join(found, key == F.col("_near_key")).drop("_near_key")
    few = F.col("n_shingles") == 0
    out = out.withColumn("component_id", F.when(few, F.col("doc_id")).otherwise(F.col("component_id")))
    # Where ids are distinct, a copy of the leading text has an id of its own, which is not the component's.
    return out.withColumn("leads", few | (F.col("doc_id") == F.col("component_id") if distinct else F.col("leads"))), distinct


def one_of_each(docs: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT, further: int = FURTHER) -> DataFrame:
    """The document of the smallest doc_id of each component (null ids last), and every row without words.

    Rows of one id with different texts and rows without an id are documents of their own; of rows of equal text one stays.
    """
    docs, back = common.aside(docs, (*OWN, "n_shingles", "component_id", "leads"))
    found, distinct = _classified(docs, shingle, percent, further)
    led = found.where("leads").select(*docs.columns, F.col("n_shingles").alias("_near_n"))
    if distinct:
        return led.drop("_near_n").withColumnsRenamed(back)
    led = common.settle(led)
    order = F.struct(F.col("doc_id").isNull(), "doc_id", F.xxhash64(*docs.columns))
    least = led.where("_near_n > 0").groupBy(F.md5("text").alias("_near_key")).agg(F.min_by(F.struct(*docs.columns), order).alias("_near_row"))
    return led.where("_near_n = 0").select(*docs.columns).unionByName(least.select("_near_row.*")).withColumnsRenamed(back)


def _apart(tokens: DataFrame, members: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of nodes in different components whose groups meet in a prefix token and pass the filters.

    A pair meets from the larger set to the smaller. What is left of a set after the token bounds the overlap: the
    smaller needs 2 * percent / (100 + percent) of its tokens left, the larger bounds how large its partner can be. Sizes fall into narrow
    bands, and the larger is sent only to the bands of sizes that it can link with. In each token's bucket the rows of its most
    frequent label are never paired with one another. A group whose members have different labels meets itself.
    """
    rows = tokens.join(members.select("group", "label").distinct(), "group").withColumn("rest", F.col("n") - F.col("pos"))
    labels = rows.groupBy("h", "label").agg(F.count("*").alias("k")).groupBy("h").agg(F.count("*").alias("labels"), F.max_by("label", F.struct("k", "label")).alias("most"))
    labels = common.settle(labels.where("labels > 1").select("h", "most"))
    rows = rows.join(common.small(labels), "h").withColumn("main", (F.col("label") == F.col("most")).cast("int"))
    rows = common.settle(rows.select("h", "group", "n", "rest", "label", "main"))
    width = math.log(100 / percent) / BANDS
    band = lambda n: F.floor(F.log(n.cast("double")) / width + 1e-9)
    side = lambda x: rows.select("h", *[F.col(c).alias(c + x) for c in ("group", "n", "rest", "label", "main")])
    low = F.greatest(F.ceil(F.col("n1") * percent / 100).cast("bigint"), F.lit(1))
    high = F.least("n1", F.floor(F.col("rest1") * (100 + percent) / percent + 1e-9).cast("bigint") - F.col("n1"))
    left = side("1").where(low <= high).withColumn("band", F.explode(F.sequence(band(low), band(high))))
    left = left.withColumn("main2", F.explode(F.when(F.col("main1") == 1, F.array(F.lit(0))).otherwise(F.array(F.lit(0), F.lit(1)))))
    right = side("2").where((100 + percent) * F.col("rest2") >= 2 * percent * F.col("n2")).withColumn("band", band(F.col("n2")))
    met = left.join(right, ["h", "band", "main2"]).where((F.col("label1") != F.col("label2")) & ((F.col("n1") > F.col("n2")) | (F.col("n1") == F.col("n2")) & ((F.col("main1") < F.col("main2")) | (F.col("main1") == F.col("main2")) & (F.col("group1") <= F.col("group2")))))
    met = met.where((100 * F.col("n2") >= percent * F.col("n1")) & ((100 + percent) * F.least("rest1", "rest2") >= percent * (F.col("n1") + F.col("n2"))))
    pairs = met.select(F.least("group1", "group2").alias("group1"), F.greatest("group1", "group2").alias("group2")).distinct()
    a = members.select(F.col("group").alias("group1"), F.col("node").alias("a"), F.col("label").alias("la"))
    b = members.select(F.col("group").alias("group2"), F.col("node").alias("b"), F.col("label").alias("lb"))
    found = pairs.join(a, "group1").join(b, "group2").where("la <> lb and (group1 <> group2 or a < b)").select("a", "b").distinct()
    found = common.settle(found)
    common.discard(labels, rows)
    return found


def op3_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = near_duplicates(common.table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_shingles", "component_id")


SQL = r"""
WITH RECURSIVE w AS (
  SELECT DISTINCT doc_id, list_transform(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'), lambda x: translate(x, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS l FROM documents
), s AS (
  SELECT doc_id, list_distinct(CASE WHEN len(l) >= 5 THEN list_transform(range(1, len(l) - 3), lambda i: array_to_string(l[i : i + 4], ' ')) WHEN len(l) > 0 THEN [array_to_string(l, ' ')] ELSE [] END) AS g FROM w
), n AS (
  SELECT doc_id, len(g) AS n_shingles FROM s
), e AS (
  SELECT doc_id, unnest(g) AS gram FROM s
), p AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS met FROM e a JOIN e b ON a.gram = b.gram AND a.doc_id <> b.doc_id GROUP BY ALL
), k AS (
  SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * met >= 75 * (x.n_shingles + y.n_shingles - met)
), r AS (
  SELECT doc_id AS a, doc_id AS b FROM n UNION SELECT r.a, k.b FROM r JOIN k ON r.b = k.a
), c AS (
  SELECT a AS doc_id, min(b) AS component_id FROM r GROUP BY a
)
SELECT d.doc_id, n.n_shingles, c.component_id FROM documents d JOIN n USING (doc_id) JOIN c USING (doc_id)
"""
