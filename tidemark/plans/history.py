"""Queries over history: versions in force, sketches of days, rollups at all levels, chains of redirects, trend breaks."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.operators import asof, performance, redirects, sketches
from tidemark.plans.performance import CANON, FACTS, SUMS, TLD
from tidemark.sources import tables

QUERIES, ORACLES = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


# ---- versions in force

KEYS = ["property_id", "page"]
VERSIONS = f"""
cr AS (SELECT {TLD.format("p.url")} AS property_id, {CANON.format("p.url")} AS page, CAST(e.ts AS DATE) AS date, CAST(json_extract_string(e.props, '$.k') AS INTEGER) % 3 AS content
  FROM events e CROSS JOIN n JOIN pages p ON p.page_id = e.user_id % n.c WHERE e.event_type = 'signup'
  QUALIFY row_number() OVER (PARTITION BY {CANON.format("p.url")}, {TLD.format("p.url")}, CAST(e.ts AS DATE) ORDER BY e.ts DESC, e.event_id DESC) = 1),
vers AS (SELECT property_id, page, date, content, CAST(row_number() OVER (PARTITION BY property_id, page ORDER BY date) AS INTEGER) AS version_no
  FROM (SELECT *, lag(content) OVER (PARTITION BY property_id, page ORDER BY date) AS b FROM cr) WHERE b IS NULL OR b <> content)"""
IN_FORCE = f"""WITH {FACTS}, {VERSIONS},
held AS (SELECT f.property_id, f.page, f.date, f.query, f.clicks, f.impressions, f.position, v.version_no, v.content, v.date AS valid_from
  FROM facts f ASOF LEFT JOIN vers v ON f.property_id = v.property_id AND f.page = v.page AND f.date >= v.date)"""


def page_versions(spark: SparkSession, sf: str, addresses: DataFrame | None = None) -> DataFrame:
    """Versions of pages from crawls: a signup stands for a crawl, k % 3 for what it found; the last crawl of a day counts."""
    events = tables.table(spark, sf, "events").where("event_type = 'signup'")
    crawls = tables.of_pages(events, addresses or tables.page_addresses(spark, sf))
    found = F.get_json_object("props", "$.k").cast("int") % 3
    rows = crawls.select(*KEYS, F.to_date("ts").alias("date"), found.alias("content"), F.struct("ts", "event_id").alias("at"))
    last = rows.where("page is not null").groupBy(*KEYS, "date").agg(F.max_by("content", "at").alias("content"))
    return asof.version_history(last, KEYS, "date", "content")


@query(f"WITH n AS (SELECT count(*) AS c FROM pages), {VERSIONS} SELECT property_id, page, version_no, content, date AS valid_from, lead(date) OVER (PARTITION BY property_id, page ORDER BY date) AS valid_to FROM vers")
def version_intervals(spark, sf):
    return asof.validity(page_versions(spark, sf), KEYS, "date").select(*KEYS, "version_no", "content", "valid_from", "valid_to")


def held_facts(spark, sf, grain=None):
    """Facts, of one grain if it is given, with the version in force."""
    addresses = tables.page_addresses(spark, sf)
    facts = tables.facts(spark, sf, addresses)
    facts = tables.kept((facts if grain is None else tables.only(facts, grain)).select(*KEYS, "date", "query", "clicks", "impressions", "position"))
    versions = page_versions(spark, sf, addresses).withColumnRenamed("date", "valid_from")
    return asof.as_of(facts, tables.kept(versions), KEYS, "date", "valid_from", days=8)


@query(f"{IN_FORCE} SELECT property_id, page, date, query, clicks, impressions, coalesce(version_no, 0) AS version_no, coalesce(content, -1) AS content, valid_from FROM held")
def facts_by_version_in_force(spark, sf):
    """Each fact day with the version in force on that day, by the keys of the page and the newest version not after it."""
    return held_facts(spark, sf).drop("position").fillna({"version_no": 0, "content": -1})


@query(f"{IN_FORCE} SELECT property_id, page, coalesce(version_no, 0) AS version_no, min(date) AS first_day, max(date) AS last_day, count(DISTINCT date) AS days, {SUMS} FROM held WHERE query = '' GROUP BY ALL")
def version_performance(spark, sf):
    return asof.by_version(held_facts(spark, sf, "page"), KEYS).fillna(0, "version_no")


# ---- sketches

_BUCKET = f"CAST(ceil(round(ln(impressions) / {math.log((1 + sketches.ERROR) / (1 - sketches.ERROR))!r}::DOUBLE, 9)) AS INTEGER)"
_GROWTH = (1 + sketches.ERROR) / (1 - sketches.ERROR)
_WEEKS = "CAST(date_trunc('week', date) AS DATE)"


def day_histogram(spark, sf):
    facts = tables.only(tables.facts(spark, sf), "page")
    return tables.kept(sketches.histogram(facts, ["property_id", "date"], "impressions"))


@query(f"WITH {FACTS} SELECT property_id, date, {_BUCKET} AS bucket, count(*) AS n FROM facts WHERE query = '' GROUP BY ALL")
def impression_sketch(spark, sf):
    return day_histogram(spark, sf)


@query(f"""WITH {FACTS}, q AS (SELECT unnest([0.0, 0.25, 0.5, 0.9, 0.99, 1.0]::DOUBLE[]) AS q),
v AS (SELECT property_id, {_WEEKS} AS week, impressions, row_number() OVER (PARTITION BY property_id, {_WEEKS} ORDER BY impressions) AS rn, count(*) OVER (PARTITION BY property_id, {_WEEKS}) AS n FROM facts WHERE query = '')
SELECT property_id, week, q, impressions AS exact, floor(2 * pow({_GROWTH!r}::DOUBLE, {_BUCKET}) / ({_GROWTH!r}::DOUBLE + 1) * 1000 + 0.5) / 1000 AS value, true AS within FROM v, q WHERE rn = greatest(1, ceil(round(q * n, 6)))""")
def impression_quantiles(spark, sf):
    """Quantiles of page impressions by week from sketches of days, beside the exact ones, and whether the stated error holds."""
    at = [0.0, 0.25, 0.5, 0.9, 0.99, 1.0]
    week = F.to_date(F.date_trunc("week", "date"))
    found = sketches.quantiles(day_histogram(spark, sf).withColumn("week", week), ["property_id", "week"], at)
    facts = tables.only(tables.facts(spark, sf), "page").select("property_id", week.alias("week"), "impressions")
    group = Window.partitionBy("property_id", "week")
    ranked = facts.withColumns({"rn": F.row_number().over(group.orderBy("impressions")), "n": F.count("*").over(group)})
    exact = ranked.withColumn("q", F.explode(F.array(*[F.lit(x) for x in at]))).where(F.col("rn") == F.greatest(F.lit(1), F.ceil(F.round(F.col("q") * F.col("n"), 6))))
    both = found.join(exact.select("property_id", "week", "q", F.col("impressions").alias("exact")), ["property_id", "week", "q"])
    within = F.abs(F.col("value") - F.col("exact")) <= F.col("exact") * (sketches.ERROR + 1e-9)
    return both.withColumns({"within": within, "value": F.floor(F.col("value") * 1000 + 0.5) / 1000})


_HASH = "('0x' || substr(md5(page || chr(31) || query), 1, 15))::BIGINT"
_K = 256


@query(f"""WITH {FACTS}, h AS (SELECT DISTINCT property_id, {_WEEKS} AS week, {_HASH} AS hash FROM facts WHERE query <> ''),
r AS (SELECT *, row_number() OVER (PARTITION BY property_id, week ORDER BY hash) AS rn, count(*) OVER (PARTITION BY property_id, week) AS exact FROM h)
SELECT property_id, week, max(exact) AS exact, floor(CASE WHEN count(*) < {_K} THEN count(*)::DOUBLE ELSE {_K - 1} / ((max(hash) + 1) / {sketches.SPACE}::DOUBLE) END + 0.5) AS estimate FROM r WHERE rn <= {_K} GROUP BY ALL""")
def distinct_page_queries(spark, sf):
    """How many pairs of page and query a week had, from the smallest hashes of its days, beside the exact number."""
    facts = tables.kept(tables.only(tables.facts(spark, sf), "query").select("property_id", "date", sketches.hashed("page", "query").alias("hash")))
    days = tables.kept(sketches.smallest(facts, ["property_id", "date"], _K))
    week = F.to_date(F.date_trunc("week", "date")).alias("week")
    found = sketches.distinct_counts(days.select("property_id", week, "hash"), ["property_id", "week"], _K)
    exact = facts.select("property_id", week, "hash").groupBy("property_id", "week").agg(F.count_distinct("hash").alias("exact"))
    return found.join(exact, ["property_id", "week"]).withColumn("estimate", F.floor(F.col("estimate") + 0.5).cast("double"))


# ---- levels, weekdays, trend breaks


@query(f"""WITH {FACTS}, f AS (SELECT *, CASE WHEN query = '' THEN 'page' ELSE 'query' END AS grain, '{tables.ORG}' AS org_id, '{tables.PROJECT}' AS project_id FROM facts)
SELECT grain, org_id, project_id, property_id, page, query, CAST(CASE GROUPING(org_id, project_id, property_id, page, query) WHEN 31 THEN 0 WHEN 7 THEN 1 WHEN 3 THEN 2 WHEN 1 THEN 3 WHEN 2 THEN 4 ELSE 5 END AS INTEGER) AS level, {SUMS}
FROM f GROUP BY GROUPING SETS ((grain), (grain, org_id, project_id), (grain, org_id, project_id, property_id), (grain, org_id, project_id, property_id, page), (grain, org_id, project_id, property_id, query), (grain, org_id, project_id, property_id, page, query))
HAVING grain = 'query' OR GROUPING(query) = 1""")
def rollup_levels(spark, sf):
    return performance.levels(tables.facts(spark, sf))


@query(f"WITH {FACTS} SELECT property_id, " + ", ".join(f"CAST(coalesce(sum(impressions) FILTER (isodow(date) = {k + 1}), 0) AS BIGINT) AS {d}" for k, d in enumerate(("mon", "tue", "wed", "thu", "fri", "sat", "sun"))) + " FROM facts WHERE query = '' GROUP BY property_id")
def weekday_impressions(spark, sf):
    return performance.by_weekday(tables.facts(spark, sf)).drop("org_id", "project_id")


@query(f"""WITH {FACTS}, d AS (SELECT property_id, page, date, sum(impressions) AS i FROM facts WHERE query = '' GROUP BY ALL), s AS (SELECT property_id, page, min(date) AS lo, max(date) AS hi FROM d GROUP BY ALL),
c AS (SELECT property_id, page, lo, hi, CAST(unnest(generate_series(lo, hi, INTERVAL 1 DAY)) AS DATE) AS date FROM s), x AS (SELECT c.*, coalesce(i, 0) AS i FROM c LEFT JOIN d USING (property_id, page, date)),
w AS (SELECT *, sum(i) OVER (PARTITION BY property_id, page ORDER BY date RANGE BETWEEN INTERVAL 7 DAY PRECEDING AND INTERVAL 1 DAY PRECEDING) AS before, sum(i) OVER (PARTITION BY property_id, page ORDER BY date RANGE BETWEEN CURRENT ROW AND INTERVAL 6 DAY FOLLOWING) AS after FROM x)
SELECT property_id, page, date, CAST(before AS BIGINT) AS before, CAST(after AS BIGINT) AS after FROM w WHERE date - 7 >= lo AND date + 6 <= hi AND greatest(before, after) >= 5 AND abs(after - before) >= 0.5::DOUBLE * greatest(before, after)""")
def page_trend_breaks(spark, sf):
    return performance.trend_breaks(tables.facts(spark, sf)).drop("org_id", "project_id")


# ---- chains of redirects

_NEXT = "CASE WHEN page_id % 97 IN (3, 4) THEN page_id + 1 WHEN page_id % 97 = 5 THEN page_id - 2 WHEN page_id % 11 <> 10 THEN page_id + 1 END"
CHAINS = f"""WITH RECURSIVE p AS (SELECT page_id, {CANON.format("url")} AS url, {_NEXT} AS next FROM pages),
edges AS (SELECT p.url, min(q.url) AS "to" FROM p JOIN p q ON q.page_id = p.next WHERE p.url <> q.url GROUP BY p.url),
reach AS (SELECT url, "to" AS spot FROM edges UNION SELECT r.url, e."to" FROM reach r JOIN edges e ON e.url = r.spot),
ends AS (SELECT url, max(CASE WHEN spot NOT IN (SELECT url FROM edges) THEN spot END) AS final, count(*) AS hops FROM reach GROUP BY url)"""


def page_redirects(spark, sf):
    """Pages that redirect to the next one in chains of up to ten, some of which lead into loops of three."""
    i = F.col("page_id")
    step = F.when((i % 97).isin(3, 4), i + 1).when(i % 97 == 5, i - 2).when(i % 11 != 10, i + 1)
    pages = tables.table(spark, sf, "pages").select("page_id", tables.urls.canonical(F.col("url")).alias("url"), step.alias("next"))
    return pages.join(pages.select(F.col("page_id").alias("next"), F.col("url").alias("to")), "next").where(F.col("url") != F.col("to")).select("url", "to")


@query(f"{CHAINS} SELECT url, final, CASE WHEN final IS NOT NULL THEN hops ELSE 0 END AS hops, final IS NULL AS looped FROM ends")
def redirect_chains(spark, sf):
    return redirects.chain_ends(page_redirects(spark, sf)).fillna(0, "hops")


@query(f"{CHAINS} SELECT page_id, CASE WHEN e.url IS NULL THEN p.url ELSE final END AS final_url FROM p LEFT JOIN ends e ON e.url = p.url")
def redirected_pages(spark, sf):
    return redirects.followed(tables.table(spark, sf, "pages").select("page_id", "url"), page_redirects(spark, sf)).select("page_id", "final_url")
