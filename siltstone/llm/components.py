"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.llm import common


def components(links: DataFrame) -> DataFrame:
    """id, label: for each id in links (bigint columns a and b) the smallest id that it reaches.

    Each round every id and its label take the least label of their neighbours, then labels jump to their own label;
    rounds are few (about the logarithm of the longest path) and each is a written table, so that the joins on labels
    are plain shuffles that adaptive execution splits where one label is hot. No links give no rows.
    """
    both = links.select("a", "b").where("a <> b")
    both = common.settle(both.unionByName(both.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    new = common.settle(both.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("id"), F.lit(-1).cast("bigint").alias("old"), F.least("a", "b").alias("label")))
    moved = True
    while moved:
        last, labels = new, new.select("id", "label")
        near = both.join(labels.select(F.col("id").alias("b"), F.col("label").alias("theirs")), "b").groupBy("a").agg(F.min("theirs").alias("least"))
        own = labels.join(near.withColumnRenamed("a", "id"), "id")
        told = own.select(F.col("id").alias("to"), "least").unionByName(own.select(F.col("label").alias("to"), "least"))
        told = told.groupBy("to").agg(F.min("least").alias("least"))
        hooked = common.settle(labels.join(told, F.col("id") == F.col("to"), "left").select("id", "label", F.least("label", F.coalesce("least", "label")).alias("mid")))
        jumped = hooked.join(hooked.select(F.col("id").alias("at"), F.col("mid").alias("next")), F.col("mid") == F.col("at"), "left")
        new = common.settle(jumped.select("id", F.col("label").alias("old"), F.least("mid", F.coalesce("next", "mid")).alias("label")))
        common.discard(last, hooked)
        moved = new.where("label <> old").limit(1).count() > 0
    common.discard(both)
    labels = new.select("id", "label")
    labels.settled_at = new.settled_at
    return labels
