"""Queries of streams and of the store: days that are fetched, sent again and late; the life of opportunities."""

from __future__ import annotations

import datetime as dt
import json

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.config import TYPES
from tidemark.plans.performance import FACTS
from tidemark.sources import store, tables
from tidemark.sources.paged import PagedSearch
from tidemark.streaming import detections, sync

QUERIES, ORACLES = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


# ---- days

_CHANGED = "SELECT property_id, date, page, query, CASE WHEN day(date) = 4 THEN clicks + 1 ELSE clicks END AS clicks, impressions FROM facts"


@query(f"WITH {FACTS} {_CHANGED} WHERE day(date) <> 6")
def replaced_days(spark, sf):
    """A store of all facts in which the fourth day was replaced and the sixth fetched again without rows."""
    facts, path = tables.kept(tables.facts(spark, sf)), tables.own_folder(spark, "store")
    store.write(facts, path)
    days = facts.select("property_id", "date").distinct()
    store.replace(facts.where(F.day("date") == 4).withColumn("clicks", F.col("clicks") + 1), path, days.where(F.day("date").isin(4, 6)))
    return store.read(spark, path).select("property_id", "date", "page", "query", "clicks", "impressions")


def fetched(spark: SparkSession, sf: str) -> list[DataFrame]:
    """Rows as four fetches bring them: most days; the rest with some again; an old fetch of one day, and a new one in which each
    page and query of the fourth day has a click more and the sixth has nothing."""
    raw = tables.kept(tables.raw_rows(spark, sf))
    at = lambda day: F.lit(dt.datetime(2024, 3, day)).alias("fetched_at")
    names = [x.split()[0] for x in sync.ROWS.split(", ")]
    day = F.day("date")
    first = F.row_number().over(Window.partitionBy("property_id", "date", tables.urls.canonical(F.col("page")), "query").orderBy("page"))
    again = raw.where(day == 4).withColumn("clicks", F.col("clicks") + F.when(first == 1, 1).otherwise(0)).select("*", at(4))
    nothing = raw.where(day == 6).select("property_id", "date").distinct().select("property_id", "date", at(4))
    out = [raw.where(day <= 20).select("*", at(2)), raw.where(day >= 15).select("*", at(3)), raw.where(day == 9).withColumn("clicks", F.lit(99).cast("long")).select("*", at(1)), again.unionByName(nothing, allowMissingColumns=True)]
    return [x.select(*names) for x in out]


@query(f"WITH {FACTS} {_CHANGED} WHERE day(date) <> 6")
def late_days_synced(spark, sf):
    """The store after a stream of fetches, each read by a run of its own that goes on where the last one ended; the first is
    there twice."""
    folder = tables.own_folder(spark, "sync")
    waves = fetched(spark, sf)
    for rows in [waves[0], *waves]:
        rows.write.mode("append").parquet(f"{folder}/in")
        sync.run_sync(spark.readStream.schema(sync.ROWS).parquet(f"{folder}/in"), f"{folder}/out", f"{folder}/checkpoint")
    return sync.stored_facts(spark, f"{folder}/out").select("property_id", "date", "page", "query", "clicks", "impressions")


# ---- opportunities

_KINDS = "['" + "', '".join(TYPES) + "']"


def detection_events(spark: SparkSession, sf: str) -> DataFrame:
    """Views and clicks as detections of the day's run at midnight, some errors as a user's dismissals at noon."""
    n = tables.table(spark, sf, "pages").agg(F.count("*").alias("n_pages"))
    # one row of one count: broadcast by construction
    events = tables.table(spark, sf, "events").join(F.broadcast(n)).withColumn("k", F.get_json_object("props", "$.k").cast("int"))
    day = F.to_date("ts")
    rows = events.select((F.col("user_id") % F.col("n_pages")).alias("page_id"), F.get(F.array(*map(F.lit, TYPES)), F.col("k") % 5).alias("type"), day.alias("day"), "k", "event_type")
    seen = rows.where("event_type in ('view', 'click')").groupBy("page_id", "type", "day").agg(F.max("k").cast("double").alias("score"))
    seen = seen.select(F.col("day").cast("timestamp").alias("at"), "page_id", "type", F.lit("detected").alias("kind"), F.concat(F.lit("run-"), F.col("day").cast("string")).alias("run_id"), "score")
    gone = rows.where("event_type = 'error' and k < 30").select("page_id", "type", "day").distinct()
    gone = gone.select((F.col("day").cast("timestamp") + F.expr("INTERVAL 12 HOURS")).alias("at"), "page_id", "type", F.lit("dismissed").alias("kind"), F.lit("user-1").alias("user_id"), F.lit("NOT_RELEVANT").alias("reason"))
    names = [x.split()[0] for x in detections.EVENTS.split(", ")]
    return seen.unionByName(gone, allowMissingColumns=True).select(*names)


@query(f"""WITH RECURSIVE n AS (SELECT count(*) AS c FROM pages),
ev AS (SELECT user_id % n.c AS page_id, {_KINDS}[CAST(json_extract_string(props, '$.k') AS INTEGER) % 5 + 1] AS type, CAST(ts AS DATE) - DATE '2024-01-01' + 1 AS d, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k, event_type FROM events, n),
det AS (SELECT page_id, type, d, max(k)::DOUBLE AS score FROM ev WHERE event_type IN ('view', 'click') GROUP BY ALL),
dis AS (SELECT DISTINCT page_id, type, d FROM ev WHERE event_type = 'error' AND k < 30), ends AS (SELECT max(d) AS d FROM (SELECT d FROM det UNION SELECT d FROM dis)),
walk AS (
  SELECT page_id, type, 0::BIGINT AS d, NULL::VARCHAR AS status, NULL::DOUBLE AS score, -1::BIGINT AS barred, 0::BIGINT AS n_created, 0::BIGINT AS n_cleared, 0::BIGINT AS n_dismissed FROM det GROUP BY ALL
  UNION ALL
  SELECT page_id, type, d, CASE WHEN hit AND s = 'DETECTED' THEN 'DISMISSED' ELSE s END, CASE WHEN fresh OR again THEN ds ELSE score END, CASE WHEN hit AND s = 'DETECTED' THEN d + 7 ELSE barred END,
    n_created + fresh::BIGINT, n_cleared + gone::BIGINT, n_dismissed + coalesce(hit AND s = 'DETECTED', false)::BIGINT
  FROM (SELECT *, CASE WHEN fresh THEN 'DETECTED' WHEN gone THEN 'DISMISSED' ELSE status END AS s
    FROM (SELECT w.page_id, w.type, w.d + 1 AS d, w.status, w.score, w.barred, w.n_created, w.n_cleared, w.n_dismissed, det.score AS ds, dis.d IS NOT NULL AS hit,
        coalesce(w.status = 'DETECTED', false) AND det.d IS NOT NULL AS again, coalesce(w.status = 'DETECTED', false) AND det.d IS NULL AS gone,
        det.d IS NOT NULL AND coalesce(w.status <> 'DETECTED', true) AND w.d + 1 > w.barred AS fresh
      FROM walk w CROSS JOIN ends LEFT JOIN det ON det.page_id = w.page_id AND det.type = w.type AND det.d = w.d + 1 LEFT JOIN dis ON dis.page_id = w.page_id AND dis.type = w.type AND dis.d = w.d + 1 WHERE w.d < ends.d) x) y)
SELECT page_id, type, status, score, n_created, n_cleared, n_dismissed FROM walk SEMI JOIN ends USING (d) WHERE status IS NOT NULL""")
def detection_stream(spark, sf):
    """The state of every page and type after a stream of a month, read in three runs."""
    folder, events = tables.own_folder(spark, "detections"), tables.kept(detection_events(spark, sf))
    for lo, hi in ((1, 9), (10, 20), (21, 31)):
        events.where(F.day("at").between(lo, hi)).write.mode("append").parquet(f"{folder}/in")
        detections.run_changes(spark.readStream.schema(detections.EVENTS).parquet(f"{folder}/in"), f"{folder}/out", f"{folder}/checkpoint", snooze_days=7)
    found = spark.read.schema(detections.CHANGES).parquet(f"{folder}/out")
    noon = events.agg(F.date_trunc("day", F.max("at")) + F.expr("INTERVAL 12 HOURS")).first()[0]
    return detections.current(detections.closed(found, noon)).select("page_id", "type", "status", "score", "n_created", "n_cleared", "n_dismissed")


# ---- the paged source


@query(f"WITH {FACTS} SELECT property_id, date, page, query, clicks, impressions, floor(position * 1000 + 0.5) / 1000 AS position FROM facts WHERE date BETWEEN DATE '2024-01-12' AND DATE '2024-01-13'")
def paged_days(spark, sf):
    """Two days of facts through the paged source, in pages of 100 rows; a filter on date asks for these days only."""
    path = tables.own_folder(spark, "api")
    rows = tables.raw_rows(spark, sf).withColumn("dimensions", F.when(F.col("query") == "", 1).otherwise(2))
    rows.repartition("dimensions", "date").write.mode("overwrite").partitionBy("dimensions", "date").parquet(path)
    found = paged_reader(spark, path, 100).where("date between '2024-01-12' and '2024-01-13'")
    facts = tables.merged_variants(found.withColumn("property_id", tables.property_of(F.col("page"))), "property_id", "date")
    return facts.select("property_id", "date", "page", "query", "clicks", "impressions", (F.floor(F.col("position") * 1000 + 0.5) / 1000).alias("position"))


def paged_reader(spark: SparkSession, path: str, size: int) -> DataFrame:
    spark.dataSource.register(PagedSearch)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    reader = spark.read.format("paged_search").option("client", "tidemark.sources.paged:folder_client").option("start", "2024-01-01").option("end", "2024-01-31").option("filters", "true")
    return reader.option("rowsPerPage", str(size)).option("arguments", json.dumps({"path": path})).load()
