"""Connected components of a link table by alternating large and small stars.

Every round is two joins of the links with an aggregate of themselves; a hot
node's links are aggregated before the shuffle and its side of the join can be
split. Each round is written as a table, so a lost executor repeats one round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prefspark.llm.tables import materialize


def _star(links: DataFrame, larger: bool) -> DataFrame:
    """Point the (larger, or else not larger) neighbours of each node at its smallest neighbour."""
    both = links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    if not larger:
        both = both.where("b <= a")
    least = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("n"), F.least("a", "m").alias("m"))
    near = both.where("b > a") if larger else both
    out = near.join(least, near.a == least.n).select(F.col("b").alias("a"), F.col("m").alias("b"))
    if not larger:
        out = out.union(least.select(F.col("n").alias("a"), F.col("m").alias("b")))
    return out.where("a <> b").distinct()


def components(links: DataFrame) -> DataFrame:
    """node, root (its component's smallest node) of every node of links (a, b) but the roots themselves."""
    links = materialize(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    state = None
    while True:
        links = materialize(_star(_star(links, True), False), "links")
        now = links.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == state:
            return links.select(F.col("a").alias("node"), F.col("b").alias("root"))
        state = now
