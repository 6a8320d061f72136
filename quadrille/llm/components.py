"""Connected components of a table of links, by alternating large-star and small-star rounds.

Every round is two minimum-by-key aggregations and joins, so no task gathers a node's neighbours; Spark
splits skewed joins. Each round's links are written to the shared folder and the former round's deleted.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize


def _star(links: DataFrame, to_larger: bool) -> DataFrame:
    """Large star: larger neighbours of each node link to the least of it and its neighbours.
    Small star: a node and its smaller neighbours link to the least of them."""
    down = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    if to_larger:
        both = down.unionByName(down.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        out = both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        least = down.groupBy("a").agg(F.min("b").alias("m"))
        rest = down.join(least, "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        out = rest.unionByName(least.select("a", F.col("m").alias("b")))
    return out.filter("a <> b").distinct()


def components(links: DataFrame) -> DataFrame:
    """links: a long, b long, in any order, repeats and self-links allowed; rows with a null are no links.
    Returns node, root (the least node of its component) for each node that has a link to another."""
    now = materialize(links.filter("a <> b").select(F.col("a").cast("long"), F.col("b").cast("long")).distinct(), "links")
    state = None
    while True:
        after = materialize(_star(_star(now, True), False), "links")
        discard(now)
        now = after
        seen = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).head()
        if tuple(seen) == state:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
        state = tuple(seen)
