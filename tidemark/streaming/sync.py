"""Fetched days from a stream into the fact store: each micro-batch replaces its days, however often and late they come."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.sources import sinks, store, tables

ROWS = "property_id string, date date, fetched_at timestamp, page string, query string, clicks long, impressions long, position double"
_DAYS = "property_id string, date date, fetched_at timestamp"


def stored_days(spark: SparkSession, path: str) -> DataFrame:
    """When each day that the store holds was fetched; none before the first batch."""
    try:
        return sinks.snapshot(spark, f"{path}/days")
    except FileNotFoundError:
        return spark.createDataFrame([], _DAYS)


def stored_facts(spark: SparkSession, path: str) -> DataFrame:
    return store.read(spark, f"{path}/facts")


def day_writer(path: str, org_id: str = tables.ORG, project_id: str = tables.PROJECT) -> Callable[[DataFrame, int], None]:
    """What foreachBatch() calls with rows (see ROWS) of fetched days: the newest fetch of each day replaces what the store has,
    unless that was fetched later. A day that brought nothing is one row without a page.

    A batch that is run again, a day that is sent twice and days that come in another order leave the same store: facts are
    replaced first, then the times of fetching are swapped, and an equal time replaces again. Two batches never run at once."""

    def write(rows: DataFrame, epoch: int) -> None:
        spark = rows.sparkSession
        rows, known = tables.kept(rows), stored_days(spark, path)
        newest = rows.groupBy("property_id", "date").agg(F.max("fetched_at").alias("fetched_at"))
        had = known.withColumnRenamed("fetched_at", "had")
        fresh = tables.kept(newest.join(had, ["property_id", "date"], "left").where(F.col("had").isNull() | (F.col("fetched_at") >= F.col("had"))).drop("had"))
        if fresh.isEmpty():
            return
        own = rows.join(fresh, ["property_id", "date", "fetched_at"], "left_semi").withColumn("query", F.coalesce("query", F.lit("")))
        facts = tables.merged_variants(own, "property_id", "date").withColumns({"org_id": F.lit(org_id), "project_id": F.lit(project_id)})
        store.replace(facts, f"{path}/facts", fresh)
        sinks.swap_snapshot(known.join(fresh, ["property_id", "date"], "left_anti").unionByName(fresh), f"{path}/days")

    return write


def run_sync(rows: DataFrame, path: str, checkpoint: str) -> None:
    """Reads all that has come since the last run, and ends."""
    from tidemark.streaming.daily import sync_stream

    sync_stream(rows, day_writer(path), checkpoint).awaitTermination()
