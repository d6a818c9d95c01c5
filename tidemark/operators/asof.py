"""Facts joined with what was in force at their time: versions as intervals, and the newest version not after a fact."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.numeric import half_up, ratio, weighted_position
from tidemark.operators import skew


def version_history(crawls: DataFrame, keys: list[str], at: str, content: str) -> DataFrame:
    """Versions (keys, version_no, at, content) from crawls: a new one only where the content differs from the crawl before."""
    order = Window.partitionBy(*keys).orderBy(at)
    changed = crawls.withColumn("_before", F.lag(content).over(order)).withColumn("_first", F.row_number().over(order) == 1)
    rows = changed.where(F.col("_first") | ~F.col(content).eqNullSafe(F.col("_before"))).drop("_before", "_first")
    return rows.withColumn("version_no", F.row_number().over(order))


def validity(versions: DataFrame, keys: list[str], at: str) -> DataFrame:
    """versions with valid_from and valid_to, the time of the next one (null: still in force)."""
    order = Window.partitionBy(*keys).orderBy(at)
    return versions.withColumns({"valid_from": F.col(at), "valid_to": F.lead(at).over(order)})


def as_of(facts: DataFrame, versions: DataFrame, keys: list[str], at: str, since: str, days: int = 32, few: int = skew.FEW) -> DataFrame:
    """facts, each with the fields of the newest version of its keys whose since isn't after its at; null without one.

    No row of facts meets a row of versions by a join: both are sorted together and the last version seen is carried on. Time
    is cut into periods of days, so that a key with a long history is many small groups; what is in force when a period
    begins comes from a table of one row for each key and period. Within a period the facts of a hot key are dealt to parts,
    each with the versions of that period. Of versions of one key and time the largest by its fields counts. Facts with
    a null key or time have no version; facts is read twice, so give a written table."""
    fields = [c for c in versions.columns if c not in keys]
    version = F.struct(F.col(since).alias("_since"), *fields)
    group = [*keys, "_period"]
    period = lambda c: F.floor(F.unix_date(F.col(c).cast("date")) / days)
    changes = versions.dropna(subset=[*keys, since]).select(*keys, period(since).alias("_period"), version.alias("_version"))
    own = facts.withColumn("_period", period(at))

    needed = own.groupBy(*group).agg(F.count("*").alias("n"))
    fans_ = skew.fans(needed, few)
    line = needed.select(*group).unionByName(changes, allowMissingColumns=True).groupBy(*group).agg(F.max("_version").alias("_last"))
    before = Window.partitionBy(*keys).orderBy("_period").rowsBetween(Window.unboundedPreceding, -1)
    begun = line.select(*group, F.last("_last", ignorenulls=True).over(before).alias("_version")).where("_version is not null")

    marks = changes.withColumn("_at", F.col(f"_version.{since}")).unionByName(begun.withColumn("_at", F.lit(None).cast(versions.schema[since].dataType)))
    marks = skew.sent(marks, group, fans_)
    rows = skew.dealt(own, group, fans_, at, *[c for c in facts.columns if c not in keys and c != at]).withColumns({"_at": F.col(at), "_is_fact": F.lit(True)})
    both = rows.unionByName(marks.withColumn("_is_fact", F.lit(False)), allowMissingColumns=True)
    order = Window.partitionBy(*group, "_part").orderBy(F.col("_at").asc_nulls_first(), "_is_fact", "_version").rowsBetween(Window.unboundedPreceding, 0)
    found = both.withColumn("_found", F.last("_version", ignorenulls=True).over(order)).where("_is_fact")
    whole = F.lit(True)
    for c in (*keys, at):
        whole &= F.col(c).isNotNull()
    return found.select(*[F.col(c) for c in facts.columns], *[F.when(whole, F.col(f"_found.{c}")).alias(c if c not in facts.columns else f"version_{c}") for c in fields])


def by_version(facts: DataFrame, keys: list[str]) -> DataFrame:
    """Totals of each key and version in force (version_no; null before the first), with the first and last day of facts."""
    clicks, impressions = F.sum("clicks"), F.sum("impressions")
    totals: list[Column] = [F.min("date").alias("first_day"), F.max("date").alias("last_day"), F.count_distinct("date").alias("days"), clicks.alias("clicks"), impressions.alias("impressions")]
    totals += [ratio(clicks, impressions).alias("ctr"), half_up(weighted_position(F.col("position"), F.col("impressions")), 2).alias("position")]
    return facts.groupBy(*keys, "version_no").agg(*totals)
