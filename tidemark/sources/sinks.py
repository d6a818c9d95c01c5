"""Idempotent writes: days of facts, snapshots, append-only logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.sources.tables import kept


def replace_days(facts: DataFrame, path: str, days: DataFrame | None = None) -> None:
    """Writes facts by property and date, replacing exactly those days; days (property_id, date) that were fetched and brought
    no rows are deleted, which dynamic overwrite alone would leave as they were. Facts are computed once."""
    spark = facts.sparkSession
    facts = kept(facts)
    facts.repartition("property_id", "date").sortWithinPartitions("query", "page").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("property_id", "date").parquet(path)
    if days is None:
        return
    name = lambda rows: rows.select("property_id", F.col("date").cast("string").alias("date")).distinct()
    for r in name(days).join(name(facts), ["property_id", "date"], "left_anti").toLocalIterator():  # one small row for each empty day
        delete(spark, partition_folder(spark, path, property_id=r.property_id, date=r.date))


def partition_folder(spark: SparkSession, path: str, **values: str) -> str:
    """The folder of a partition below path, its values written as Spark writes them (a colon as %3A)."""
    escape = spark.sparkContext._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.escapePathName
    return "/".join([path, *(f"{k}={escape(v)}" for k, v in values.items())])


def delete(spark: SparkSession, path: str) -> None:
    """Deletes a file or folder with all below it; one that isn't there is none."""
    at = _path(spark, path)
    _files(spark, at).delete(at, True)


def _path(spark: SparkSession, path: str):
    return spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)


def _files(spark: SparkSession, at):
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def swap_snapshot(rows: DataFrame, path: str) -> str:
    """Writes rows as a new version below path, then makes a pointer name it; gives the version's folder.

    The pointer is an empty file whose name holds the version's number: it appears at once, so that readers (see
    snapshot()) find the old or the new version, whole. The version before stays for those who still read it; older ones
    and their pointers are deleted. One writer at a time."""
    spark = rows.sparkSession
    last = _versions(spark, path)
    number = (last[-1] if last else 0) + 1
    rows.write.mode("overwrite").parquet(f"{path}/v={number:09d}")
    at = _path(spark, f"{path}/_current-{number:09d}")
    _files(spark, at).create(at, True).close()
    for old in last[:-1]:
        for name in (f"_current-{old:09d}", f"v={old:09d}"):
            delete(spark, f"{path}/{name}")
    return f"{path}/v={number:09d}"


def snapshot(spark: SparkSession, path: str) -> DataFrame:
    """The newest whole version that swap_snapshot() wrote."""
    found = _versions(spark, path)
    if not found:
        raise FileNotFoundError(f"no snapshot at {path}")
    return spark.read.parquet(f"{path}/v={found[-1]:09d}")


def _versions(spark: SparkSession, path: str) -> list[int]:
    at = _path(spark, path)
    files = _files(spark, at)
    names = [f.getPath().getName() for f in files.listStatus(at)] if files.exists(at) else []
    return sorted(int(n.removeprefix("_current-")) for n in names if n.startswith("_current-"))


def append_log(spark: SparkSession, path: str, rows: DataFrame) -> None:
    """Appends to an audit log."""
    rows.write.mode("append").parquet(path)


def newest(log: DataFrame, limit: int = 200) -> DataFrame:
    return log.orderBy(F.desc("at"), "id").limit(limit)
