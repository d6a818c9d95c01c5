"""The fact store: folders that are read, days that are replaced, files that are put together."""

import datetime as dt

from pyspark.sql import functions as F

from tests.test_history import FACTS, fact
from tidemark.config import DetectionConfig
from tidemark.operators import performance
from tidemark.sources import store, tables


def rows_of(df):
    return sorted((r.property_id, r.date.isoformat(), r.page, r.query, r.clicks) for r in df.collect())


def files_read(df):
    df.collect()
    leaves = df._jdf.queryExecution().executedPlan().collectLeaves()
    return sum(leaves.apply(k).metrics().apply("numFiles").value() for k in range(leaves.size()))


def test_detection_reads_its_days_only(spark, tmp_path):
    """Of 480 days, both windows together read 56, and only page totals; queries 28."""
    days = spark.range(480).select(F.date_add(F.lit("2025-01-01"), F.col("id").cast("int")).alias("date"))
    row = days.crossJoin(spark.createDataFrame([("",), ("q",)], "query string"))
    facts = row.select(F.lit("o").alias("org_id"), F.lit("j").alias("project_id"), F.lit("p").alias("property_id"), "date", F.lit("https://s.com/a").alias("page"), "query", F.lit(1).cast("long").alias("clicks"), F.lit(10).cast("long").alias("impressions"), F.lit(0.1).alias("ctr"), F.lit(3.0).alias("position"))
    store.write(facts, str(tmp_path / "s"))
    stored = store.read(spark, str(tmp_path / "s"))
    windows = tables.property_windows(stored, DetectionConfig().window_days)
    assert files_read(performance.within(tables.only(stored, "page"), windows, "prev_start")) == 56
    assert files_read(performance.within(tables.only(stored, "query"), windows, "cur_start")) == 28
    plan = performance.window_pair(stored, windows)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(grain" in plan and "(date" in plan.split("PartitionFilters")[1].split("PushedFilters")[0]
    assert performance.window_pair(stored, windows).first().c_impressions == 280
    assert files_read(store.read(spark, str(tmp_path / "s"), "p", "2025-02-01", "2025-02-03", "query")) == 3
    assert "query" not in str(windows._jdf.queryExecution().executedPlan()).split("ReadSchema")[1].split("\n")[0]


def test_replaced_days(spark, tmp_path):
    path, name = str(tmp_path / "s"), "sc-domain:a.com"
    make = lambda *rows: spark.createDataFrame([fact(*r, prop=name) for r in rows], FACTS)
    store.replace(make((0, "a", "", 1, 9), (0, "a", "q", 1, 9), (1, "a", "", 2, 9), (1, "a", "q", 2, 9), (2, "a", "", 3, 9)), path)
    fetched = spark.createDataFrame([(name, "2026-01-01"), (name, "2026-01-02"), (name, "2026-01-03")], "property_id string, date string")
    new = make((0, "a", "", 7, 9), (2, "a", "", 3, 9))
    for _ in range(2):  # the same days again leave the same
        store.replace(new, path, fetched)
        assert rows_of(store.read(spark, path)) == [(name, "2026-01-01", "a", "", 7), (name, "2026-01-03", "a", "", 3)]


def test_compaction(spark, tmp_path):
    path = str(tmp_path / "s")
    store.write(spark.createDataFrame([fact(d, "a", "", d, 9) for d in range(4)], FACTS), path)
    for n in range(3):
        store.append(spark.createDataFrame([fact(1, f"b{n}", "", 50 + n, 9), fact(1, "b", f"q{n}", n, 9)], FACTS), path)
    before = rows_of(store.read(spark, path))
    kept = {r.file for r in store.read(spark, path, end=dt.date(2026, 1, 1)).select(F.col("_metadata.file_path").alias("file")).collect()}
    assert store.compact(spark, path) == 2  # both grains of one day
    assert rows_of(store.read(spark, path)) == before
    assert {r.files for r in store.files_by_day(spark, path).collect()} == {1}
    assert kept == {r.file for r in store.read(spark, path, end=dt.date(2026, 1, 1)).select(F.col("_metadata.file_path").alias("file")).collect()}
    assert store.compact(spark, path) == 0
