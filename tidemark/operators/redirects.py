"""Where chains of redirects end, by doubling of pointers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions import urls
from tidemark.operators import skew
from tidemark.sources.tables import kept


def chain_ends(redirects: DataFrame, few: int = skew.FEW) -> DataFrame:
    """url, final, hops and looped of every url that redirects (columns url, to; of several targets the smallest counts).

    Each round joins what is still on its way with where its target leads by now, so that 2^r hops are known after r rounds. If
    a round brings nothing to an end, no longer way has one either: what is left leads into a loop (final and hops null).
    Null urls and targets don't count; a url that leads to itself is a loop. Many urls may lead to the same one."""
    first = redirects.dropna(subset=["url", "to"]).groupBy("url").agg(F.min("to").alias("to"))
    targets = kept(first)
    on = targets.select(F.col("url").alias("to"), F.lit(False).alias("ends"))
    now = kept(skew.looked_up(targets, on, ["to"], few).select("url", "to", F.lit(1).cast("long").alias("hops"), F.coalesce("ends", F.lit(True)).alias("ends")))
    left = None
    while True:
        way = kept(now.where(~F.col("ends")).drop("ends"))
        before, left = left, way.count()
        if left in (0, before):
            break
        known = now.select(F.col("url").alias("to"), F.col("to").alias("next"), F.col("hops").alias("more"), "ends")
        step = skew.looked_up(way, known, ["to"], few).select("url", F.col("next").alias("to"), (F.col("hops") + F.col("more")).alias("hops"), "ends")
        now = kept(now.where("ends").unionByName(step))
    end = lambda c: F.when(F.col("ends"), F.col(c))
    return now.select("url", end("to").alias("final"), end("hops").alias("hops"), (~F.col("ends")).alias("looped"))


def followed(results: DataFrame, redirects: DataFrame) -> DataFrame:
    """Crawl results (url, and others) with final_url, the canonical end of the redirects that start at url (itself without
    any; null in a loop)."""
    rows = redirects.select(urls.canonical(F.col("url")).alias("url"), urls.canonical(F.col("to")).alias("to"))
    ends = chain_ends(rows.where(F.col("url") != F.col("to")))
    own = urls.canonical(F.col("url"))
    rows = kept(results.withColumn("_own", own))
    found = skew.looked_up(rows, ends.select(F.col("url").alias("_own"), "final", "looped"), ["_own"])
    return found.withColumn("final_url", F.when(F.coalesce("looped", F.lit(False)), F.lit(None)).otherwise(F.coalesce("final", "_own"))).drop("_own", "final", "looped")
