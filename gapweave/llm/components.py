"""Connected components of a link table, by alternating large and small stars.

Each round points every node at the smallest node it knows of; rounds are written
to the shared folder, the one before is deleted, and they end when the links no
longer change. Links never come to the driver; minima are combined before the
shuffle. A hub is one row on its side of a join, so its links may be split over
tasks by the adaptive skew join.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from gapweave.llm.common import discard, stage


def star(links: DataFrame, large: bool) -> DataFrame:
    """One star: links (a, b) with a > b again."""
    if large:
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("u"), F.least("a", "m").alias("m"))
        out = links.join(least, links.b == least.u).select("a", F.col("m").alias("b"))
    else:
        least = links.groupBy("a").agg(F.min("b").alias("m"))
        out = links.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
    return out.filter(F.col("a") > F.col("b")).distinct()


def components(links: DataFrame) -> DataFrame:
    """Rows (node, root) for every node of links (a, b) that isn't the smallest of its component."""
    now = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter(F.col("a") > F.col("b")).distinct()
    now = stage(now, "links")
    seen = None
    while True:
        before, now = now, stage(star(star(now, True), False), "links")
        discard(before)
        # decimals: sums of hashes outgrow a long
        mark = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).collect()[0]
        if mark == seen:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
        seen = mark
