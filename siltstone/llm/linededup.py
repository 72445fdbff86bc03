"""Line dedup by winnowing over line hashes, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siltstone.llm import common

#: Words of a gram (shorter repeats are never deleted) and words of a repeat that is certain to be found.
GRAM, CERTAIN = 25, 50


def hash60(text: Column) -> Column:
    """The first 60 bits of the MD5, as a bigint."""
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("bigint")


def dedup_lines(docs: DataFrame, gram: int = GRAM, certain: int = CERTAIN, text: str = "text") -> DataFrame:
    """docs without the later repeats of runs of lines, with n_lines (before) and n_deleted.

    Lines end at a newline and are compared whole. The gram of a line is the hash of the fewest lines from it on that
    hold `gram` words; from all grams that begin within certain - gram words the least is a fingerprint, so every run of `certain`
    words that stands in two places has a fingerprint in both. Each fingerprint is matched with its place before it in
    the same document, or else with its first place in the corpus (by doc_id, nulls last). Where a window of a fingerprint doesn't stand at that place
    too, it is also matched with the first place where it stands in that window: so every window (the fewest lines from one on that hold `certain` words)
    that stands at an earlier place goes, whoever quotes a part of it first. Lines after a run's last window go if a matched place goes on alike.
    Matches are extended line by
    line both ways, and runs of at least `gram` words are deleted. Blank lines count for nothing and stay.

    Null texts stay null; a document that repeats wholly keeps an empty text; rows of the same id and text are one
    document and get the same result; an empty table gives an empty table; columns n_lines and n_deleted are replaced, all others stay.
    """
    kept = docs.select(*[c for c in docs.columns if c not in ("n_lines", "n_deleted")])
    own = [F.coalesce(F.col("doc_id"), F.lit((1 << 63) - 1)).alias("d"), hash60(F.col(text)).alias("h")]
    rows = kept.where(F.length(text) > 0).select(*own, F.posexplode(F.split(text, "\n")).alias("pos", "line"))
    rows = rows.select("d", "h", "pos", hash60(F.col("line")).alias("lh"), F.regexp_count("line", F.lit(common.WORD)).cast("bigint").alias("w")).where("w > 0")
    doc = Window.partitionBy("d", "h")
    rows = rows.dropDuplicates(["d", "h", "pos"])
    up = doc.orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    lines = rows.select("*", F.row_number().over(doc.orderBy("pos")).alias("i"), (F.sum("w").over(up) - F.col("w")).alias("s"), F.sum("w").over(doc).alias("total"))
    lines = common.settle(lines)

    by_word = doc.orderBy("s")
    joined_hash = lambda words: hash60(F.array_join(F.collect_list("lh").over(by_word.rangeBetween(0, words - 1)).cast("array<string>"), ","))
    grams = lines.select("d", "h", "i", "s", "total", joined_hash(gram).alias("g"), joined_hash(certain).alias("window"))
    grams = grams.where(F.col("s") + gram <= F.col("total"))
    least = grams.select("d", "h", "window", F.min(F.struct("g", "i")).over(by_word.rangeBetween(0, certain - gram)).alias("m"), (F.col("s") + certain <= F.col("total")).alias("whole"))
    prints = common.settle(least.where("whole").groupBy("d", "h", "m").agg(F.collect_set("window").alias("windows")).select("d", "h", "m.g", "m.i", "windows"))

    first = prints.groupBy("g").agg(F.min(F.struct("d", "h", "i", "windows")).alias("f"), F.count("*").alias("n")).where("n > 1").select(F.col("g").alias("fg"), "f")
    first = common.settle(first)
    ahead = Window.partitionBy("d", "h", "g").orderBy("i")
    met = prints.withColumns({"before": F.lag("i").over(ahead), "old": F.lag("windows").over(ahead)}).join(common.small(first), F.col("g") == F.col("fg")).drop("g", "fg")
    met = common.settle(met)
    here, own_first = F.col("before").isNotNull(), F.struct("d", "h", "i") == F.struct("f.d", "f.h", "f.i")
    fresh = F.array_except("windows", F.coalesce("old", F.array().cast("array<bigint>")))
    near = met.where(here).select("d", "h", F.col("d").alias("sd"), F.col("h").alias("sh"), (F.col("i") - F.col("before")).alias("shift"))
    far = met.where(~own_first & (~here | F.arrays_overlap(fresh, "f.windows"))).select("d", "h", F.col("f.d").alias("sd"), F.col("f.h").alias("sh"), (F.col("i") - F.col("f.i")).alias("shift"))
    rest = common.settle(met.where(~own_first).select("d", "h", "i", F.explode(F.array_except(fresh, "f.windows")).alias("window")))
    also = rest.groupBy("window").agg(F.min(F.struct("d", "h", "i")).alias("f"), F.count("*").alias("n")).where("n > 1").select(F.col("window").alias("first_window"), "f")
    also = common.settle(also)
    other = rest.join(common.small(also), F.col("window") == F.col("first_window")).where(F.struct("d", "h", "i") != F.col("f")).select("d", "h", F.col("f.d").alias("sd"), F.col("f.h").alias("sh"), (F.col("i") - F.col("f.i")).alias("shift"))
    pair = near.unionByName(far).unionByName(other).distinct()

    later = pair.join(lines.select("d", "h", "i", "pos", "lh", "w"), ["d", "h"]).withColumn("si", F.col("i") - F.col("shift"))
    source = lines.select(F.col("d").alias("sd"), F.col("h").alias("sh"), F.col("i").alias("si"), "lh")
    equal = later.join(source, ["sd", "sh", "si", "lh"])
    track = Window.partitionBy("d", "h", "sd", "sh", "shift")
    equal = equal.withColumn("island", F.col("i") - F.row_number().over(track.orderBy("i")))
    runs = equal.withColumn("words", F.sum("w").over(Window.partitionBy("d", "h", "sd", "sh", "shift", "island")))
    gone = common.settle(runs.where(F.col("words") >= gram).select("d", "h", "pos").distinct())
    key_d, key_h, at = (common.fresh(n, docs.columns) for n in ("dedup_d", "dedup_h", "dedup_gone"))
    gone_by = gone.groupBy("d", "h").agg(F.collect_list("pos").alias(at)).withColumnsRenamed({"d": key_d, "h": key_h})
    common.discard(lines, prints, first, met, rest, also)
    gone_by = common.small(gone_by)

    joined = kept.join(gone_by, (F.coalesce(F.col("doc_id"), F.lit((1 << 63) - 1)) == F.col(key_d)) & (hash60(F.col(text)) == F.col(key_h)), "left")
    cleaned = F.when(F.col(at).isNull(), F.col(text)).otherwise(F.array_join(F.filter(F.split(text, "\n"), lambda x, k: ~F.array_contains(at, k)), "\n"))
    n_lines = F.when(F.length(text) > 0, F.size(F.split(text, "\n"))).otherwise(0).cast("bigint")
    names = [cleaned.alias(c) if c == text else F.col(c) for c in kept.columns]
    return joined.select(*names, n_lines.alias("n_lines"), F.coalesce(F.size(at), F.lit(0)).cast("bigint").alias("n_deleted"))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup_lines(common.table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_deleted", F.length("text").cast("bigint").alias("kept_chars"), F.md5("text").alias("kept_md5"))


SQL = r"""
WITH src AS (
  SELECT DISTINCT coalesce(doc_id, 9223372036854775807) AS d, CAST('0x' || substr(md5(text), 1, 15) AS BIGINT) AS h, text
  FROM documents WHERE length(text) > 0
), raw AS (
  SELECT d, h, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos FROM src
), cnt AS (
  SELECT d, h, pos, CAST('0x' || substr(md5(line), 1, 15) AS BIGINT) AS lh, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS w FROM raw
), lines AS (
  SELECT *, row_number() OVER (PARTITION BY d, h ORDER BY pos) AS i,
    CAST(sum(w) OVER (PARTITION BY d, h ORDER BY pos) - w AS BIGINT) AS s, sum(w) OVER (PARTITION BY d, h) AS total
  FROM cnt WHERE w > 0
), grams AS (
  SELECT d, h, i, s, total, CAST('0x' || substr(md5(array_to_string(list(lh) OVER (PARTITION BY d, h ORDER BY s RANGE BETWEEN CURRENT ROW AND 24 FOLLOWING), ',')), 1, 15) AS BIGINT) AS g,
    CAST('0x' || substr(md5(array_to_string(list(lh) OVER (PARTITION BY d, h ORDER BY s RANGE BETWEEN CURRENT ROW AND 49 FOLLOWING), ',')), 1, 15) AS BIGINT) AS win
  FROM lines
), least AS (
  SELECT d, h, win, min({'g': g, 'i': i}) OVER (PARTITION BY d, h ORDER BY s RANGE BETWEEN CURRENT ROW AND 25 FOLLOWING) AS m, s + 50 <= total AS whole
  FROM grams WHERE s + 25 <= total
), prints AS (
  SELECT d, h, m.g AS g, m.i AS i, list(DISTINCT win) AS wins FROM least WHERE whole GROUP BY ALL
), firsts AS (
  SELECT g, min({'d': d, 'h': h, 'i': i}) AS f FROM prints GROUP BY g HAVING count(*) > 1
), met AS (
  SELECT p.*, lag(p.i) OVER w AS before, lag(p.wins) OVER w AS old, f, q.wins AS fwins
  FROM prints p JOIN firsts USING (g) JOIN prints q ON q.d = f.d AND q.h = f.h AND q.i = f.i AND q.g = p.g WINDOW w AS (PARTITION BY p.d, p.h, p.g ORDER BY p.i)
), new AS (
  SELECT *, list_filter(wins, lambda x: NOT list_contains(coalesce(old, []), x)) AS fresh, d = f.d AND h = f.h AND i = f.i AS own FROM met
), rest AS (
  SELECT d, h, i, unnest(list_filter(fresh, lambda x: NOT list_contains(fwins, x))) AS win FROM new WHERE NOT own
), also AS (
  SELECT win, min({'d': d, 'h': h, 'i': i}) AS f FROM rest GROUP BY win
), pair AS (
  SELECT d, h, d AS sd, h AS sh, i - before AS shift FROM new WHERE before IS NOT NULL
  UNION SELECT d, h, f.d, f.h, i - f.i FROM new WHERE NOT own AND (before IS NULL OR list_has_any(fresh, fwins))
  UNION SELECT d, h, f.d, f.h, i - f.i FROM rest JOIN also USING (win) WHERE NOT (d = f.d AND h = f.h AND i = f.i)
), equal AS (
  SELECT p.*, l.i, l.pos, l.w, l.i - row_number() OVER (PARTITION BY p.d, p.h, p.sd, p.sh, p.shift ORDER BY l.i) AS island
  FROM pair p JOIN lines l ON l.d = p.d AND l.h = p.h
  JOIN lines q ON q.d = p.sd AND q.h = p.sh AND q.i = l.i - p.shift AND q.lh = l.lh
), runs AS (
  SELECT *, sum(w) OVER (PARTITION BY d, h, sd, sh, shift, island) AS words FROM equal
), gone AS (
  SELECT d, h, list(DISTINCT pos) AS gone FROM runs WHERE words >= 25 GROUP BY d, h
), fin AS (
  SELECT x.doc_id, CASE WHEN length(x.text) > 0 THEN len(string_split(x.text, chr(10))) ELSE 0 END AS n_lines, coalesce(len(gone), 0) AS n_deleted,
    CASE WHEN gone IS NULL THEN x.text ELSE array_to_string(list_filter(string_split(x.text, chr(10)), lambda y, k: NOT list_contains(gone, k - 1)), chr(10)) END AS kept
  FROM documents x LEFT JOIN gone g ON g.d = coalesce(x.doc_id, 9223372036854775807) AND g.h = CAST('0x' || substr(md5(x.text), 1, 15) AS BIGINT)
)
SELECT doc_id, CAST(n_lines AS BIGINT) AS n_lines, CAST(n_deleted AS BIGINT) AS n_deleted, length(kept) AS kept_chars, md5(kept) AS kept_md5 FROM fin
"""
