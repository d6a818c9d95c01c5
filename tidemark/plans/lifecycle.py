"""Queries of lifecycles, verification, baselines and streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.config import TYPES
from tidemark.functions.numeric import half_up
from tidemark.operators import lifecycle, measure
from tidemark.plans.performance import FACTS, ROUND, SUMS
from tidemark.sources import tables
from tidemark.sources.tables import table
from tidemark.streaming.daily import append_final_days

QUERIES, ORACLES = {}, {}
NOW = "2024-02-01 00:00:00"


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


_KINDS = "['" + "', '".join(TYPES) + "']"
_STATES = ("DETECTED", "REVIEWED", "PROPOSED", "APPLYING", "DISMISSED", "DISMISSED", "REJECTED")
_STATE_SQL = "['" + "', '".join(_STATES) + "']"
#: A snapshot and a run's detections made from pages: states by page_id % 7, types by page_id % 5; two of three pages detected.
SNAP = f"""
snap AS (SELECT page_id, {_KINDS}[page_id % 5 + 1] AS type, {_STATE_SQL}[page_id % 7 + 1] AS status, 50.0::DOUBLE AS score, CASE page_id % 7 WHEN 4 THEN 'user-1' END AS dismissed_by,
  CASE WHEN page_id % 7 IN (4, 5) THEN TIMESTAMP '2024-01-20' + to_days(-CAST(page_id % 30 AS INTEGER)) END AS dismissed_at, 'run-0' AS run_id FROM pages WHERE page_id % 11 <> 0),
det AS (SELECT page_id, {_KINDS}[page_id % 5 + 1] AS type, 10.0 + page_id % 90 AS score FROM pages WHERE page_id % 3 <> 1),
j AS (SELECT s.*, d.score AS new_score, s.status NOT IN ('DISMISSED', 'APPLIED', 'REJECTED') AS is_open FROM snap s LEFT JOIN det d USING (page_id, type)),
kept AS (SELECT page_id, type, status, CASE WHEN new_score IS NOT NULL AND status IN ('DETECTED', 'REVIEWED') THEN new_score ELSE score END AS score,
  CASE WHEN is_open AND new_score IS NOT NULL AND status IN ('DETECTED', 'REVIEWED') THEN 'updated' WHEN is_open AND new_score IS NOT NULL THEN 'skipped' ELSE 'kept' END AS action FROM j),
barred AS (SELECT page_id, type FROM j WHERE is_open OR (status = 'DISMISSED' AND dismissed_by IS NOT NULL AND dismissed_at >= TIMESTAMP '{NOW}' - INTERVAL 28 DAY)),
fresh AS (SELECT page_id, type, 'DETECTED' AS status, score, 'created' AS action FROM det ANTI JOIN barred USING (page_id, type)),
nxt AS (SELECT * FROM kept UNION ALL SELECT * FROM fresh)"""


def snapshot(spark, sf):
    i = F.col("page_id")
    pick = lambda values, n: F.get(F.array(*map(F.lit, values)), (i % n).cast("int"))
    rows = table(spark, sf, "pages").where("page_id % 11 <> 0")
    return rows.select(
        lifecycle.opportunity_id("page_id").alias("id"), "page_id", pick(TYPES, 5).alias("type"), pick(_STATES, 7).alias("status"), F.lit(50.0).alias("score"), F.lit(1).cast("long").alias("clicks"), F.lit(9).cast("long").alias("impressions"),
        F.lit(0.1).alias("ctr"), F.lit(5.0).alias("position"), F.lit("2024-01-01").cast("date").alias("date_start"), F.lit("2024-01-14").cast("date").alias("date_end"), F.when(i % 7 == 4, "user-1").alias("dismissed_by"),
        F.when((i % 7).isin(4, 5), F.lit("2024-01-20").cast("timestamp") - F.make_interval(days=(i % 30).cast("int"))).alias("dismissed_at"), F.lit(None).cast("string").alias("dismiss_reason"), F.lit("run-0").alias("run_id"), F.lit(NOW).cast("timestamp").alias("last_detected_at"),
    )


def detections(spark, sf):
    i = F.col("page_id")
    rows = table(spark, sf, "pages").where("page_id % 3 <> 1")
    return rows.select("page_id", F.get(F.array(*map(F.lit, TYPES)), (i % 5).cast("int")).alias("type"), (10.0 + i % 90).cast("double").alias("score"), F.lit(2).cast("long").alias("clicks"), F.lit(8).cast("long").alias("impressions"), F.lit(0.2).alias("ctr"), F.lit(None).cast("double").alias("position"), F.lit("2024-01-15").cast("date").alias("date_start"), F.lit("2024-01-28").cast("date").alias("date_end"))


def after_run(spark, sf):
    return lifecycle.upsert_detected(snapshot(spark, sf), detections(spark, sf), "run-1", NOW)


@query(f"WITH {SNAP} SELECT page_id, type, status, score, action FROM nxt")
def lifecycle_upsert(spark, sf):
    return after_run(spark, sf).select("page_id", "type", "status", "score", "action")


@query(f"WITH {SNAP} SELECT page_id, type, CASE WHEN status = 'DETECTED' AND action = 'kept' THEN 'DISMISSED' ELSE status END AS status, CASE WHEN status = 'DETECTED' AND action = 'kept' THEN 'SIGNAL_CLEARED' END AS dismiss_reason FROM nxt")
def lifecycle_clear_stale(spark, sf):
    return lifecycle.clear_stale(after_run(spark, sf), "run-1", NOW).select("page_id", "type", "status", "dismiss_reason")


@query(f"WITH {SNAP} SELECT count(*) FILTER (action = 'created') AS created, count(*) FILTER (action = 'updated') AS updated, count(*) FILTER (action = 'skipped') AS skipped, count(*) FILTER (action = 'cleared') AS cleared, count(*) FILTER (action = 'kept') AS kept FROM nxt")
def lifecycle_run_totals(spark, sf):
    return lifecycle.run_totals(after_run(spark, sf))


@query(f"WITH {SNAP} SELECT page_id, type, CASE WHEN page_id % 2 = 0 AND status IN ('DETECTED', 'REVIEWED') THEN 'DISMISSED' ELSE status END AS status FROM snap")
def lifecycle_dismiss(spark, sf):
    rows = snapshot(spark, sf)
    asked = rows.where("page_id % 2 = 0").select("id", F.lit("user-2").alias("user_id"), F.lit("not useful").alias("reason"))
    return lifecycle.dismissed(rows, asked, NOW).select("page_id", "type", "status")


RUNS = "SELECT o_orderkey, CASE o_orderstatus WHEN 'O' THEN 'RUNNING' WHEN 'F' THEN 'COMPLETED' ELSE 'FAILED' END AS status, CAST(o_orderdate AS TIMESTAMP) AS started_at FROM orders"


@query(f"WITH r AS ({RUNS}) SELECT o_orderkey, CASE WHEN status = 'RUNNING' AND started_at < TIMESTAMP '1996-06-01' THEN 'FAILED' ELSE status END AS status FROM r")
def lifecycle_sweep(spark, sf):
    status = F.when(F.col("o_orderstatus") == "O", "RUNNING").when(F.col("o_orderstatus") == "F", "COMPLETED").otherwise("FAILED")
    runs = table(spark, sf, "orders").select("o_orderkey", status.alias("status"), F.col("o_orderdate").cast("timestamp").alias("started_at"), F.lit(None).cast("string").alias("error"))
    return lifecycle.swept(runs, "1996-06-01 00:00:00").select("o_orderkey", "status")


@query("""WITH p AS (SELECT o_custkey AS review_id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS revision, CASE o_orderstatus WHEN 'O' THEN 'AWAITING_APPROVAL' WHEN 'F' THEN 'APPROVED' ELSE 'REJECTED' END AS status FROM orders)
SELECT review_id, CAST(revision AS INTEGER) AS revision, CASE WHEN status <> 'REJECTED' AND revision < max(revision) OVER (PARTITION BY review_id) THEN 'SUPERSEDED' ELSE status END AS status FROM p""")
def proposals_superseded(spark, sf):
    return lifecycle.superseded(proposals(spark, sf)).select("review_id", "revision", "status")


def proposals(spark, sf):
    from pyspark.sql import Window

    status = F.when(F.col("o_orderstatus") == "O", "AWAITING_APPROVAL").when(F.col("o_orderstatus") == "F", "APPROVED").otherwise("REJECTED")
    number = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey"))
    return table(spark, sf, "orders").select(F.col("o_custkey").alias("review_id"), number.alias("revision"), status.alias("status"))


@query("""WITH t AS (SELECT o_custkey AS review_id, count(*) AS top FROM orders GROUP BY 1), r AS (SELECT c_custkey AS review_id, c_name AS value FROM customer)
SELECT review_id, CAST(coalesce(top, 0) + 1 AS INTEGER) AS revision, value, 'AWAITING_APPROVAL' AS status FROM r LEFT JOIN t USING (review_id)""")
def proposal_revisions(spark, sf):
    asked = table(spark, sf, "customer").select(F.col("c_custkey").alias("review_id"), F.col("c_name").alias("value"))
    return lifecycle.next_revisions(proposals(spark, sf), asked)


@query("""WITH r AS (SELECT o_custkey AS opp, CASE o_orderstatus WHEN 'O' THEN 'APPLIED' WHEN 'P' THEN 'APPLYING' ELSE 'FAILED' END AS status FROM orders),
s AS (SELECT opp, bool_or(status = 'APPLYING') AS pending, bool_or(status = 'APPLIED') AS applied FROM r GROUP BY opp)
SELECT c_custkey AS id, CASE WHEN pending THEN 'APPLYING' WHEN applied THEN 'APPLIED' ELSE 'PROPOSED' END AS status FROM customer LEFT JOIN s ON opp = c_custkey""")
def opportunities_follow_runs(spark, sf):
    status = F.when(F.col("o_orderstatus") == "O", "APPLIED").when(F.col("o_orderstatus") == "P", "APPLYING").otherwise("FAILED")
    runs = table(spark, sf, "orders").select(F.col("o_custkey").alias("opportunity_id"), status.alias("status"))
    return lifecycle.following_runs(table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.lit("PROPOSED").alias("status")), runs)


@query("""SELECT o_orderkey AS run_id, 2 AS attempt, CASE WHEN o_orderkey % 3 = 0 THEN 'APPLIED' WHEN o_orderkey % 3 = 1 THEN 'AWAITING_CHANGE' ELSE 'APPLYING' END AS status FROM orders""")
def apply_runs(spark, sf):
    k = F.col("o_orderkey")
    runs = table(spark, sf, "orders").select(k.alias("run_id"), F.lit(2).alias("attempt"), F.lit("APPLYING").alias("status"))
    got = table(spark, sf, "orders").select(k.alias("run_id"), F.when(k % 3 == 2, 1).otherwise(2).alias("attempt"), F.when(k % 3 == 0, "MATCH").otherwise("UNCHANGED").alias("result"))
    return lifecycle.applied_runs(runs, got)


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 10 = 0 THEN 'PAGE_VERSION_CHANGED' WHEN o_orderkey % 10 = 1 THEN NULL
  WHEN abs(o_custkey - (100 + o_orderkey % 200))::DOUBLE / (100 + o_orderkey % 200) >= 0.3 OR (o_orderkey % 50 >= 20 AND abs(10 - o_orderkey % 50)::DOUBLE / (o_orderkey % 50) >= 0.3) OR o_orderkey % 5 >= 2 THEN 'EVIDENCE_CHANGED' END AS reason FROM orders""")
def analysis_staleness(spark, sf):
    k = F.col("o_orderkey")
    rows = table(spark, sf, "orders").select(
        "o_orderkey", F.lit("v1").alias("analysis_version"), F.when(k % 10 == 0, "v2").otherwise("v1").alias("current_version"), F.when(k % 10 != 1, 100 + k % 200).alias("s_impressions"), (k % 50).alias("s_clicks"), F.lit(5.0).alias("s_position"),
        F.col("o_custkey").alias("o_impressions"), F.lit(10).alias("o_clicks"), (F.lit(5.0) + k % 5).alias("o_position"),
    )
    return rows.select("o_orderkey", lifecycle.stale_reason().alias("reason"))


@query("SELECT l_orderkey, max(l_linenumber) AS l_linenumber, max_by(l_quantity, l_linenumber * 1000 + l_quantity) AS l_quantity FROM lineitem GROUP BY l_orderkey")
def latest_per_key(spark, sf):
    rows = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity")
    return lifecycle.latest(rows, "l_orderkey", at="l_linenumber")


@query("SELECT c_custkey, CAST(d AS DATE) AS day FROM (SELECT c_custkey, unnest(generate_series(DATE '2024-01-20' - CAST(3 + c_custkey % 5 AS INTEGER), DATE '2024-01-27', INTERVAL 1 DAY)) AS d FROM customer)")
def sync_window_days(spark, sf):
    last = F.date_sub(F.lit("2024-01-20").cast("date"), (F.col("c_custkey") % 5).cast("int"))
    return table(spark, sf, "customer").select("c_custkey", F.explode(lifecycle.sync_days(last, F.lit("2024-01-30").cast("date"))).alias("day"))


@query(f"""WITH {FACTS}, p AS (SELECT DISTINCT property_id, page FROM facts),
w AS (SELECT property_id, DATE '2024-01-27' AS e, min(date) AS first_day FROM facts WHERE query = '' GROUP BY property_id)
SELECT p.property_id, p.page, e - 13 AS window_start, e AS window_end, CAST(coalesce(sum(clicks), 0) AS BIGINT) AS clicks, CAST(coalesce(sum(impressions), 0) AS BIGINT) AS impressions,
 {ROUND.format("(sum(position * impressions) / nullif(sum(impressions), 0))")} AS position, count(f.date) AS days_with_data, coalesce(sum(clicks)::DOUBLE / nullif(sum(impressions), 0), 0) AS ctr, first_day <= e - 13 AS data_complete
FROM p JOIN w USING (property_id) LEFT JOIN facts f ON f.property_id = p.property_id AND f.page = p.page AND f.query = '' AND f.date BETWEEN e - 13 AND e GROUP BY ALL""")
def baseline(spark, sf):
    facts = tables.kept(tables.facts(spark, sf))
    asked = facts.select("property_id", "page").distinct().select("*", F.lit("2024-01-30").cast("date").alias("last_synced"), F.lit("2024-01-30").cast("date").alias("as_of"))
    return measure.baselines(facts, asked, 14).drop("limitation")


@query(f"""WITH {FACTS}, q AS (SELECT property_id, page, query, {SUMS} FROM facts WHERE query <> '' AND date BETWEEN DATE '2024-01-14' AND DATE '2024-01-27' GROUP BY ALL)
SELECT *, CAST(row_number() OVER (PARTITION BY property_id, page ORDER BY impressions DESC, query) AS INTEGER) AS rn FROM q QUALIFY rn <= 20""")
def baseline_top_queries(spark, sf):
    facts = tables.kept(tables.facts(spark, sf))
    windows = facts.select("property_id", "page").distinct().select("*", F.lit("2024-01-14").cast("date").alias("window_start"), F.lit("2024-01-27").cast("date").alias("window_end"))
    return measure.baseline_queries(facts, windows)


@query(f"""WITH {FACTS}, p AS (SELECT DISTINCT property_id, page FROM facts)
SELECT p.property_id, p.page, CAST(coalesce(sum(clicks) FILTER (date >= DATE '2024-01-17'), 0) - coalesce(sum(clicks) FILTER (date <= DATE '2024-01-14'), 0) AS BIGINT) AS clicks_change,
 CAST(coalesce(sum(impressions) FILTER (date >= DATE '2024-01-17'), 0) - coalesce(sum(impressions) FILTER (date <= DATE '2024-01-14'), 0) AS BIGINT) AS impressions_change
FROM p LEFT JOIN facts f ON f.property_id = p.property_id AND f.page = p.page AND f.query = '' AND (f.date BETWEEN DATE '2024-01-01' AND DATE '2024-01-14' OR f.date BETWEEN DATE '2024-01-17' AND DATE '2024-01-30') GROUP BY ALL""")
def post_change_measurement(spark, sf):
    """An extension: totals of two weeks after a change against those of the two weeks before it."""
    facts = tables.kept(tables.facts(spark, sf))
    day = lambda d: F.lit(d).cast("date")
    asked = lambda last, as_of: facts.select("property_id", "page").distinct().select("*", day(last).alias("last_synced"), day(as_of).alias("as_of"))
    before, after = measure.baselines(facts, asked("2024-01-14", "2024-01-30"), 14), measure.baselines(facts, asked("2024-01-30", "2024-02-10"), 14)
    return measure.measured_change(before, after).select("property_id", "page", "clicks_change", "impressions_change")


@query("""SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN 'MATCH' WHEN 1 THEN 'UNCHANGED' WHEN 2 THEN 'CONFLICT' ELSE 'TARGET_MISSING' END AS result, CASE WHEN c_custkey % 4 < 3 THEN trim(CASE c_custkey % 4 WHEN 0 THEN 'New ' || c_name WHEN 1 THEN c_name ELSE 'Other' END) END AS live_value FROM customer""")
def verify_change(spark, sf):
    k = F.col("c_custkey") % 4
    section = "array<struct<key:string,order:int,level:int,heading:string,text:string>>"
    version = lambda title: F.struct(title.alias("title"), F.lit(None).cast("string").alias("meta_description"), F.lit(None).cast("string").alias("h1"), F.array().cast(section).alias("sections"))
    live = F.when(k == 0, F.concat(F.lit("  New  "), F.col("c_name"))).when(k == 1, F.col("c_name")).otherwise(F.lit("Other"))
    rows = table(spark, sf, "customer").select("c_custkey", F.when(k == 3, "SECTION_CONTENT").otherwise("TITLE").alias("change_type"), F.lit("s9-none").alias("target_section"), F.col("c_name").alias("current_value"), F.concat(F.lit("New "), F.col("c_name")).alias("proposed_value"), version(F.col("c_name")).alias("approved"), version(live).alias("live"))
    return measure.verified(rows).select("c_custkey", "result", "live_value")


@query("""WITH s AS (SELECT conv_id AS page_id, turn, least(length(text), 200) AS own FROM conversations), r AS (SELECT *, sum(own) OVER (PARTITION BY page_id ORDER BY turn) AS upto FROM s)
SELECT page_id, turn AS "order", CAST(least(upto, 500) - least(upto - own, 500) AS INTEGER) AS kept FROM r""")
def section_budget(spark, sf):
    sections = table(spark, sf, "conversations").select(F.col("conv_id").alias("page_id"), F.col("turn").alias("order"), "text")
    return measure.clipped_sections(sections, 200, 500).select("page_id", "order", "kept")


@query("SELECT CAST(ts AS DATE) AS date, event_type, count(*) AS n, floor(sum(value) * 100 + 0.5) / 100 AS value FROM events WHERE CAST(ts AS DATE) + 1 <= (SELECT max(ts) FROM events) - INTERVAL 3 DAY GROUP BY ALL")
def stream_daily(spark, sf):
    """An extension: the days that are final when the stream of events has been read."""
    folder = tables.own_folder(spark, "daily")
    events = spark.readStream.schema(table(spark, sf, "events").schema).parquet(f"{sf}/events.parquet*").withColumn("ts", F.col("ts").cast("timestamp"))
    append_final_days(events, f"{folder}/days", f"{folder}/checkpoint")
    days = spark.read.schema("date date, event_type string, n long, value double").parquet(f"{folder}/days")
    return days.withColumn("value", half_up(F.col("value"), 2))
