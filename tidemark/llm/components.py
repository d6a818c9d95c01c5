"""Connected components of a link table, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import Workspace


def components(links: DataFrame, space: Workspace | None = None) -> DataFrame:
    """node and component (the smallest node reachable) of every node of links (columns a, b: long, any direction).

    Each step keeps at most as many links as there were, groups only by sums and minima (so a hub is pre-aggregated and
    its join can be split), and is written; the table of the step before is deleted. The number of steps grows with the
    logarithm of the longest path. Null nodes, links of a node to itself and repeated links count for nothing; no links
    give no rows.
    """
    space = space or Workspace(links.sparkSession)
    edges = space.keep(_directed(links))
    seen = None
    while True:
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == seen:
            return edges.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("component")).union(edges.select(F.col("b"), F.col("b")).distinct())
        seen = now
        both = edges.union(edges.select("b", "a"))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = _directed(both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")))
        small = large.join(large.groupBy("a").agg(F.min("b").alias("m")), "a")
        before = space.mark() - 1
        edges = space.keep(_directed(small.select("b", "m").union(small.select("a", "m")).toDF("a", "b")))
        space.drop(before, before + 1)


def _directed(links: DataFrame) -> DataFrame:
    """Distinct links from the larger to the smaller node, none to itself."""
    return links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct()
