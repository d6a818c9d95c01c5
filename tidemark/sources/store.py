"""The fact store: facts in folders by grain, property and date, so that a query reads the days and the grain that it asks for."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.sources import sinks, tables

BY = ("grain", "property_id", "date")


def _named(rows: DataFrame) -> DataFrame:
    grain = F.when(tables.of_grain("page"), "page").otherwise("query")
    return rows.withColumn("grain", grain)


def write(facts: DataFrame, path: str) -> None:
    """A new store of facts: each property's day is one file of each grain, in the order of queries and pages."""
    _written(_named(facts), path)


def _written(rows: DataFrame, path: str) -> None:
    rows = rows.repartition(*BY).sortWithinPartitions(*BY, "query", "page")
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*BY).parquet(path)


def read(spark: SparkSession, path: str, property_id: str | None = None, start=None, end=None, grain: str | None = None) -> DataFrame:
    """Facts of the store; property, first and last day and grain, if given, choose folders."""
    rows = spark.read.schema(SCHEMA).parquet(path)
    for name, value in (("property_id", property_id), ("grain", grain)):
        if value is not None:
            rows = rows.where(F.col(name) == value)
    if start is not None:
        rows = rows.where(F.col("date") >= F.lit(start).cast("date"))
    if end is not None:
        rows = rows.where(F.col("date") <= F.lit(end).cast("date"))
    return rows


SCHEMA = "org_id string, project_id string, page string, query string, clicks long, impressions long, ctr double, position double, grain string, property_id string, date date"


def replace(facts: DataFrame, path: str, days: DataFrame | None = None) -> None:
    """Replaces exactly the days that facts bring, both grains of each; days (property_id, date) that were fetched and brought no
    rows, or rows of one grain only, lose what they had. The same days written again leave the store as it is."""
    spark = facts.sparkSession
    rows = tables.kept(_named(facts))
    _written(rows, path)
    fetched = rows.select("property_id", "date") if days is None else days.select("property_id", F.col("date").cast("date").alias("date")).union(rows.select("property_id", "date"))
    asked = fetched.distinct().withColumn("grain", F.explode(F.array(F.lit("page"), F.lit("query"))))
    empty = asked.join(rows.select(*BY).distinct(), list(BY), "left_anti").select(*[F.col(c).cast("string") for c in BY])
    for r in empty.toLocalIterator():  # one small row for each day and grain without rows
        sinks.delete(spark, sinks.partition_folder(spark, path, grain=r.grain, property_id=r.property_id, date=r.date))


def append(facts: DataFrame, path: str) -> None:
    """Adds files to days that have some already: cheap, for compact() to put in order later."""
    _named(facts).write.mode("append").partitionBy(*BY).parquet(path)


def files_by_day(spark: SparkSession, path: str) -> DataFrame:
    """grain, property_id, date, files and rows of each day; no column of the files is read."""
    rows = read(spark, path).select(*BY, F.col("_metadata.file_path").alias("file"))
    return rows.groupBy(*BY).agg(F.count_distinct("file").alias("files"), F.count("*").alias("rows"))


def compact(spark: SparkSession, path: str, most_files: int = 1) -> int:
    """Writes days of more than most_files files anew, each as one; returns how many there were. Other days stay as they are."""
    many = tables.kept(files_by_day(spark, path).where(F.col("files") > most_files))
    n = many.count()
    if n:
        span = many.agg(F.min("date").alias("lo"), F.max("date").alias("hi")).first()
        rows = read(spark, path, start=span.lo, end=span.hi).join(many.select(*BY), list(BY), "left_semi")
        _written(tables.kept(rows), path)
    return n


def temporary(facts: DataFrame) -> DataFrame:
    """facts written as a store of this session, which ends with it."""
    path = tables.own_folder(facts.sparkSession, "store")
    write(facts, path)
    return read(facts.sparkSession, path)
