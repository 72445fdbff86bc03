"""Mixing sources to target weights by weighted fair queueing, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siltstone.llm import common

#: Weights by rank of the source, repeating; share of all words that the mix takes; copies of a source at most.
WEIGHTS, SHARE, COPIES = (5, 2, 1), 1.5, 2
#: Documents whose running sum one task makes; ticks of a virtual time of 1.
RUN, TICKS = 2000, 1 << 40
OWN = tuple(f"_mix_{x}" for x in ("key", "run", "sum", "times", "source", "rows", "before", "r", "size"))


def in_order(df: DataFrame, order: list[Column], *sums: str) -> DataFrame:
    """df (slim rows) globally range-sorted, with nth (rows before) and for each column x of sums x_before (its sum over the rows before).

    Partitions hold ranges of the order; each makes its own running sums, shifted by the totals of the partitions before it.
    """
    ranged = common.settle(df.repartitionByRange(*order).withColumn("_mix_part", F.spark_partition_id()))
    ahead = Window.orderBy("_mix_part").rowsBetween(Window.unboundedPreceding, -1)
    totals = ranged.groupBy("_mix_part").agg(F.count("*").alias("nth"), *[F.sum(x).alias(f"{x}_before") for x in sums])  # one row a partition
    names = ["nth", *[f"{x}_before" for x in sums]]
    shift = totals.select("_mix_part", *[F.coalesce(F.sum(n).over(ahead), F.lit(0)).alias(f"_mix_{n}") for n in names])
    within = Window.partitionBy("_mix_part").orderBy(*order)
    before = within.rowsBetween(Window.unboundedPreceding, -1)
    out = ranged.withColumn("nth", (F.row_number().over(within) - 1).cast("bigint"))
    for x in sums:
        out = out.withColumn(f"{x}_before", F.coalesce(F.sum(x).over(before), F.lit(0)))
    out = out.join(F.broadcast(shift), "_mix_part")  # one row a partition
    return out.select(*df.columns, *[(F.col(n) + F.col(f"_mix_{n}")).alias(n) for n in names])


def source_targets(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, copies: int = COPIES) -> DataFrame:
    """source, source_size, source_rows, target: `share` of all sizes dealt to the sources by weight.

    Sources rank by code point, null last. No target is above copies times its source's size: the excess goes to the
    others by weight. That is one level t with the sum of least(copies * size, t * weight) equal to the budget; t is
    the largest of the levels that capping the sources in the order of size / weight gives. One row for each source; there
    may be many sources: ranks and sums are made by range-sorted partitions.
    """
    by = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("source_rows"))
    by = in_order(by, [F.col("source").asc_nulls_last()])
    by = by.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (F.col("nth") % len(weights) + 1).cast("int"))).drop("nth")
    by = by.withColumn("most", (F.col("source_size") * copies).cast("double")).withColumn("ratio", F.col("most") / F.col("weight"))
    by = common.settle(in_order(by, [F.col("ratio"), F.col("source").asc_nulls_last()], "most", "weight"))
    every = by.agg(F.sum("source_size").alias("size"), F.sum("weight").alias("weight")).first()
    rest = F.lit(every["weight"]) - F.col("weight_before")
    level = by.agg(F.max((F.lit((every["size"] or 0) * share) - F.col("most_before")) / rest)).first()[0]
    return by.select("source", "source_size", "source_rows", F.least("most", F.lit(level).cast("double") * F.col("weight")).alias("target"))


def word_count(text: str = "text") -> Column:
    """Words of a text; 0 for a null."""
    return F.regexp_count(F.coalesce(F.col(text), F.lit("")), F.lit(common.WORD)).cast("bigint")


def _timed(whole: DataFrame, weights: tuple[int, ...], share: float, copies: int, seed: int) -> tuple[DataFrame, int]:
    """whole with source_size, target and _mix_times (finish of each copy in ticks), and the first tick that the mix leaves out."""
    targets = common.settle(source_targets(whole.select("source", "size"), weights, share, copies))
    key = F.md5(F.concat_ws(":", F.lit(str(seed)), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))))
    runs = F.ceil(F.col("_mix_rows") / RUN)
    keyed = whole.withColumn("_mix_key", key).join(common.small(targets.withColumnsRenamed({"source": "_mix_source", "source_rows": "_mix_rows"})), F.col("source").eqNullSafe(F.col("_mix_source"))).drop("_mix_source")
    keyed = keyed.withColumn("_mix_run", F.floor(F.conv(F.substring("_mix_key", 1, 8), 16, 10).cast("bigint") * runs / F.lit(2.0**32)))
    run = Window.partitionBy("source", "_mix_run")
    keyed = keyed.withColumn("_mix_sum", F.sum("size").over(run.orderBy("_mix_key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)))
    keyed = common.settle(keyed)

    sums = keyed.groupBy("source", "_mix_run").agg(F.sum("size").alias("_mix_size"))
    before = F.coalesce(F.sum("_mix_size").over(Window.partitionBy("source").orderBy("_mix_run").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sums = common.settle(sums.select(F.col("source").alias("_mix_source"), F.col("_mix_run").alias("_mix_r"), before.alias("_mix_before")))
    timed = keyed.join(common.small(sums), F.col("source").eqNullSafe(F.col("_mix_source")) & (F.col("_mix_run") == F.col("_mix_r")))
    tick = lambda k: F.floor(F.least((F.col("_mix_before") + F.col("_mix_sum") + F.col("source_size") * k) / F.col("target"), F.lit(float(1 << 22))) * TICKS)
    times = F.when((F.col("size") > 0) & (F.col("target") > 0), F.array(*[tick(k) for k in range(copies)])).otherwise(F.array().cast("array<bigint>"))
    timed = timed.withColumn("_mix_times", times)

    budget = (targets.agg(F.sum("source_size")).first()[0] or 0) * share
    ticks = timed.select("size", F.explode("_mix_times").alias("t")).groupBy("t").agg(F.sum("size").alias("size"))  # copies of one tick are taken or left together
    cut = in_order(ticks, [F.col("t")], "size").where(F.col("size_before") + F.col("size") > budget).agg(F.min("t")).first()[0]
    return timed, (1 << 62) + 1 if cut is None else cut


def mix_sources(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, copies: int = COPIES, seed: int = 17) -> DataFrame:
    """docs (with a bigint column size, see word_count) with source_size, target (its source's words in the mix) and taken
    (words the mix takes of the document, copies included).

    Each source's documents are shuffled by a hash of the id. Document i's k-th copy finishes at the virtual time
    (words of its source up to it, earlier copies included) / target. All copies of all sources, range-sorted by these
    times, are the mix; it is truncated where its words would pass `share` of all words. Running sums within a source are made for
    about RUN documents a task and shifted by the sums of the runs before, so a source of any size is spread; those of
    the mix are made by range-sorted partitions.

    Null or empty texts have size 0 and are never taken. A null source is a source. Null and repeated ids are ordered
    by their size too; equal rows are exchangeable. Copies at the very tick of the cut are left out. An empty table
    gives an empty table; columns named like the new ones are replaced.
    """
    new = ("source_size", "target", "taken")
    whole, back = common.aside(docs.select(*[c for c in docs.columns if c not in new]), OWN)
    timed, cut = _timed(whole, weights, share, copies, seed)
    taken = F.col("size") * F.size(F.filter("_mix_times", lambda t: t < cut))
    return timed.select(*whole.columns, "source_size", "target", taken.cast("bigint").alias("taken")).withColumnsRenamed(back)


def mixed(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, copies: int = COPIES, seed: int = 17) -> DataFrame:
    """The mix itself: a row for each copy that mix_sources takes, with finish (its virtual time), range-sorted by it.

    Partition i holds earlier times than partition i + 1 and is sorted, so files written from it are in the mix's order.
    """
    whole, back = common.aside(docs.select(*[c for c in docs.columns if c != "finish"]), (*OWN, "source_size", "target"))
    timed, cut = _timed(whole, weights, share, copies, seed)
    rows = timed.select(*whole.columns, F.explode(F.filter("_mix_times", lambda t: t < cut)).alias("finish"))
    rows = rows.withColumn("finish", F.col("finish") / TICKS).withColumnsRenamed(back)
    return rows.repartitionByRange("finish", "doc_id").sortWithinPartitions("finish", "doc_id")


def op4_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    sized = common.settle(common.table(spark, sf_dir, "documents").select("doc_id", "source", word_count().alias("size")))
    return mix_sources(sized).select("doc_id", "size", "source_size", "target", "taken")


SQL = r"""
WITH s AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM documents
), b AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM s GROUP BY source
), w AS (
  SELECT *, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight,
    CAST(source_size * 2 AS DOUBLE) AS most
  FROM b
), l AS (
  SELECT *, (CAST(1.5 AS DOUBLE) * sum(source_size) OVER ()
      - coalesce(sum(most) OVER (ORDER BY most / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / sum(weight) OVER (ORDER BY most / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM w
), t AS (
  SELECT source, source_size, least(most, max(level) OVER () * weight) AS target FROM l
), c AS (
  SELECT row_number() OVER () AS row_no, s.doc_id, s.size, t.source_size, t.target,
    sum(s.size) OVER (PARTITION BY s.source ORDER BY md5('17:' || coalesce(CAST(doc_id AS VARCHAR), 'null')), doc_id, size ROWS UNBOUNDED PRECEDING) AS done
  FROM s JOIN t ON s.source IS NOT DISTINCT FROM t.source
), k AS (
  SELECT row_no, size, CAST(floor(CAST(done + source_size * copy AS DOUBLE) / target * 1099511627776) AS BIGINT) AS tick
  FROM c, (VALUES (0), (1)) AS v(copy) WHERE size > 0 AND target > 0
), g AS (
  SELECT row_no, size, sum(size) OVER (ORDER BY tick RANGE UNBOUNDED PRECEDING) AS words FROM k
), y AS (
  SELECT row_no, CAST(sum(size) AS BIGINT) AS taken FROM g
  WHERE words <= (SELECT CAST(1.5 AS DOUBLE) * sum(source_size) FROM b) GROUP BY row_no
)
SELECT doc_id, size, source_size, target, coalesce(taken, 0) AS taken FROM c LEFT JOIN y USING (row_no)
"""
