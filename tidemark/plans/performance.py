"""Queries of rollups and detection over facts, each with the same in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.config import CTR_CURVE, WEIGHTS, DetectionConfig
from tidemark.functions import terms, urls
from tidemark.functions.numeric import expected_ctr, half_up
from tidemark.operators import content, detect, lifecycle, performance
from tidemark.operators.performance import TENANT
from tidemark.sources import store, tables

CFG = DetectionConfig().scaled()

QUERIES, ORACLES = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


CANON = "regexp_replace(replace(replace(regexp_replace({0}, '#.*$', ''), '?utm_source=feed', ''), '&ref=x', ''), '/+$', '')"
TLD = r"regexp_extract({0}, '://[^/?#]*\.([a-z]+)(?:[/?#]|$)', 1)"
ROUND = "floor({0} * 100 + 0.5) / 100"
FACTS = f"""
n AS (SELECT count(*) AS c FROM pages),
ev AS (SELECT p.url, CAST(e.ts AS DATE) AS date, CAST(json_extract_string(e.props, '$.k') AS INTEGER) AS k, e.event_type
       FROM events e CROSS JOIN n JOIN pages p ON p.page_id = e.user_id % n.c),
grains AS (SELECT *, '' AS query FROM ev UNION ALL SELECT *, 'k' || CAST(k % 7 AS VARCHAR) FROM ev WHERE event_type <> 'error'),
raw_rows AS (SELECT url, date, query, sum(CASE WHEN event_type = 'purchase' AND k < 20 THEN 1 ELSE 0 END) AS clicks, count(*) AS impressions,
             CAST(min(1 + k % 20) AS DOUBLE) AS position FROM grains GROUP BY ALL),
facts AS (SELECT {TLD.format("url")} AS property_id, date, {CANON.format("url")} AS page, query, CAST(sum(clicks) AS BIGINT) AS clicks,
          CAST(sum(impressions) AS BIGINT) AS impressions, sum(clicks)::DOUBLE / sum(impressions) AS ctr,
          sum(position * greatest(impressions, 1)) / greatest(sum(impressions), 1) AS position FROM raw_rows GROUP BY ALL)"""
SUMS = f"""CAST(coalesce(sum(clicks), 0) AS BIGINT) AS clicks, CAST(coalesce(sum(impressions), 0) AS BIGINT) AS impressions,
  coalesce(sum(clicks)::DOUBLE / nullif(sum(impressions), 0), 0) AS ctr, {ROUND.format("(sum(position * impressions) / nullif(sum(impressions), 0))")} AS position"""
WINDOWS = """
windows AS (SELECT property_id, max(date) AS cur_end, max(date) - 13 AS cur_start, max(date) - 14 AS prev_end, max(date) - 27 AS prev_start
            FROM facts WHERE query = '' GROUP BY property_id)"""
PAIR = f"""
pair AS (SELECT f.property_id, f.page, w.prev_start, w.prev_end, w.cur_start, w.cur_end,
  CAST(coalesce(sum(clicks) FILTER (date >= cur_start), 0) AS BIGINT) AS c_clicks,
  CAST(coalesce(sum(impressions) FILTER (date >= cur_start), 0) AS BIGINT) AS c_impressions,
  {ROUND.format("(sum(position * impressions) FILTER (date >= cur_start) / nullif(sum(impressions) FILTER (date >= cur_start), 0))")} AS c_position,
  CAST(coalesce(sum(clicks) FILTER (date <= prev_end), 0) AS BIGINT) AS p_clicks,
  CAST(coalesce(sum(impressions) FILTER (date <= prev_end), 0) AS BIGINT) AS p_impressions,
  {ROUND.format("(sum(position * impressions) FILTER (date <= prev_end) / nullif(sum(impressions) FILTER (date <= prev_end), 0))")} AS p_position
  FROM facts f JOIN windows w USING (property_id) WHERE query = '' AND date BETWEEN prev_start AND cur_end GROUP BY ALL)"""
DIM = f"""
dim AS (SELECT page_id, {TLD.format("url")} AS property_id, {CANON.format("url")} AS url, CASE WHEN page_id % 10 = 3 THEN 'GONE' WHEN page_id % 20 = 7 THEN 'EXCLUDED' ELSE 'ACTIVE' END AS status FROM pages)"""
CAND = """
cand AS (SELECT d.page_id, p.*, coalesce(c_clicks::DOUBLE / nullif(c_impressions, 0), 0) AS c_ctr, coalesce(p_clicks::DOUBLE / nullif(p_impressions, 0), 0) AS p_ctr
  FROM pair p JOIN dim d ON d.url = p.page AND d.property_id = p.property_id AND d.status = 'ACTIVE' WHERE c_impressions >= 10 OR p_impressions >= 10)"""
RANKED = f"""
by_query AS (SELECT f.property_id, page, query, {SUMS} FROM facts f JOIN windows w USING (property_id) WHERE query <> '' AND date BETWEEN cur_start AND cur_end GROUP BY ALL),
ranked AS (SELECT *, count(*) OVER (PARTITION BY property_id, page) AS query_count,
  row_number() OVER (PARTITION BY property_id, page ORDER BY impressions DESC, clicks DESC, query) AS rn FROM by_query)"""
SHARES = """
shares AS (SELECT property_id, page, max(query_count) AS query_count, CAST(sum(impressions) AS BIGINT) AS query_impressions,
  coalesce(sum(impressions) FILTER (position BETWEEN 4 AND 20), 0)::DOUBLE / sum(impressions) AS improvable_share,
  max(impressions)::DOUBLE / sum(impressions) AS top_share FROM ranked WHERE rn <= 25 GROUP BY ALL)"""
#: One page in four has a current version whose title has the term of one of its queries.
GAPS = """
gaps AS (SELECT c.page_id, r.query, r.impressions, r.clicks, r.position FROM cand c JOIN ranked r ON r.page = c.page AND r.property_id = c.property_id
  WHERE rn <= 5 AND r.impressions >= 4 AND NOT (c.page_id % 4 = 0 AND r.query = 'k3')),
lacks AS (SELECT page_id, sum(impressions) AS gap_impressions, count(*) AS n_gaps FROM gaps GROUP BY page_id)"""


def curve_sql(p: str) -> str:
    lines = [f"WHEN {p} <= {CTR_CURVE[0][0]} THEN {CTR_CURVE[0][1]}::DOUBLE"]
    for (p0, c0), (p1, c1) in zip(CTR_CURVE, CTR_CURVE[1:], strict=False):
        lines.append(f"WHEN {p} <= {p1} THEN {c0}::DOUBLE + ({p} - {p0}) / {float(p1 - p0)}::DOUBLE * ({c1}::DOUBLE - {c0}::DOUBLE)")
    return f"CASE {' '.join(lines)} WHEN {p} IS NOT NULL THEN {CTR_CURVE[-1][1]}::DOUBLE END"


UNIT = "least(1.0::DOUBLE, greatest(0.0::DOUBLE, {0}))"
SCORES = f"""
base AS (SELECT c.*, {curve_sql("c_position")} AS expected_ctr, coalesce(query_count, 0) AS query_count, coalesce(improvable_share, 0) AS improvable_share,
  coalesce(top_share, 0) AS top_share, coalesce(gap_impressions::DOUBLE / query_impressions, 0) AS uncovered_share, coalesce(n_gaps, 0) AS n_gaps,
  CASE WHEN p_clicks > 0 THEN (c_clicks - p_clicks)::DOUBLE / p_clicks * 100 END AS click_change,
  CASE WHEN p_ctr > 0 THEN (c_ctr - p_ctr) / p_ctr * 100 END AS ctr_change
  FROM cand c LEFT JOIN shares s ON s.page = c.page AND s.property_id = c.property_id LEFT JOIN lacks USING (page_id)),
parts AS (SELECT *, {UNIT.format("ln(greatest(c_impressions, 1)::DOUBLE / 10) / ln(1000.0::DOUBLE / 10)")} AS s_impressions,
  CASE WHEN expected_ctr > 0 THEN {UNIT.format("(expected_ctr - c_ctr) / expected_ctr")} ELSE 0 END AS s_ctr,
  CASE WHEN c_position < 4 THEN 0.3 WHEN c_position <= 10 THEN 1 - (c_position - 4) * 0.3::DOUBLE / 6 WHEN c_position < 20 THEN (20 - c_position) * 0.7::DOUBLE / 10 ELSE 0 END::DOUBLE AS s_position,
  {UNIT.format("greatest(-coalesce(click_change, 0), -coalesce(ctr_change, 0), 0) / 60")} AS s_trend,
  {UNIT.format("improvable_share")} AS s_query, {UNIT.format("uncovered_share / 0.5::DOUBLE")} AS s_coverage FROM base)"""
FIRES = {
    "LOW_CTR": "c_impressions >= 15 AND c_position <= 20 AND c_ctr < expected_ctr * 0.6::DOUBLE",
    "PAGE_ONE_NEAR_TOP": "c_position BETWEEN 4 AND 10 AND c_impressions >= 12",
    "HIGH_IMPRESSIONS_LOW_CLICKS": "c_impressions >= 30 AND c_ctr < 0.05",
    "PERFORMANCE_DECLINE": "(p_clicks >= 1 AND click_change <= -25) OR (p_impressions >= 10 AND c_impressions >= 10 AND ctr_change <= -25)",
    "CONTENT_COVERAGE_SIGNAL": "n_gaps > 0",
}


def points_sql(kind: str) -> str:
    order = sorted((x for x in WEIGHTS[kind] if WEIGHTS[kind][x]), key=lambda x: -WEIGHTS[kind][x])
    total = " + ".join(f"floor(s_{x} * {WEIGHTS[kind][x]} * 10 + 0.5) / 10" for x in order)
    return f"floor(least(100, {total}) * 10 + 0.5) / 10"


FOUND = "found AS (" + " UNION ALL ".join(f"SELECT property_id, page_id, page AS url, '{k}' AS type, {points_sql(k)} AS score, c_clicks AS clicks, c_impressions AS impressions, c_ctr AS ctr, c_position AS position, cur_start, cur_end FROM parts WHERE {FIRES[k]}" for k in FIRES) + ")"
ALL = f"WITH {FACTS}, {WINDOWS}, {PAIR}, {DIM}, {CAND}, {RANKED}, {SHARES}, {GAPS}, {SCORES}, {FOUND}"


def inputs(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Facts, written once by grain, property and day as they are read for windows, pairs and queries, and the windows of each
    property, which come from the names of folders."""
    facts = store.temporary(tables.facts(spark, sf))
    return facts, tables.kept(tables.property_windows(facts, CFG.window_days))


@query(f"WITH {FACTS} SELECT property_id, date, page, query, clicks, impressions, ctr, position FROM facts")
def fact_variant_merge(spark, sf):
    return tables.facts(spark, sf).drop("org_id", "project_id")


@query(f"WITH {FACTS} SELECT {SUMS} FROM facts WHERE query = ''")
def perf_totals(spark, sf):
    return performance.totals(tables.facts(spark, sf))


@query(f"WITH {FACTS} SELECT date, {SUMS} FROM facts WHERE query = '' GROUP BY date")
def perf_daily(spark, sf):
    return performance.daily(tables.facts(spark, sf))


@query(f"WITH {FACTS} SELECT query, {SUMS} FROM facts WHERE query <> '' GROUP BY query ORDER BY impressions DESC, query LIMIT 50")
def perf_top_queries(spark, sf):
    return performance.top(tables.facts(spark, sf), "query")


@query(f"WITH {FACTS} SELECT page, {SUMS} FROM facts WHERE query = '' GROUP BY page ORDER BY impressions DESC, page LIMIT 50")
def perf_top_pages(spark, sf):
    return performance.top(tables.facts(spark, sf), "page")


@query(f"WITH {FACTS} SELECT {SUMS} FROM facts WHERE query = '' AND property_id = 'net' AND date BETWEEN DATE '2024-01-05' AND DATE '2024-01-20'")
def perf_scoped_totals(spark, sf):
    return performance.totals(tables.scoped(tables.facts(spark, sf), tables.ORG, tables.PROJECT, "net", start="2024-01-05", end="2024-01-20"))


@query(f"WITH {FACTS}, {WINDOWS} SELECT * FROM windows")
def evaluation_windows(spark, sf):
    return inputs(spark, sf)[1].drop("org_id", "project_id")


@query(f"WITH {FACTS}, {WINDOWS}, {PAIR} SELECT * FROM pair")
def perf_page_window_pair(spark, sf):
    return performance.window_pair(*inputs(spark, sf)).drop("org_id", "project_id")


def page_dimension(spark: SparkSession, sf: str) -> DataFrame:
    """Pages with status, and title, h1 and headings of their current versions. Each page has two: the first has another title;
    one page in four still points to it. One in ten is gone, one in twenty isn't to be indexed."""
    i = F.col("page_id")
    found = tables.content_pages(spark, sf)
    old = found.select("page_id", F.concat_ws("-", "page_id", F.lit(1)).alias("version_id"), F.lit("All about k3").alias("title"), "h1", "headings")
    new = found.select("page_id", F.concat_ws("-", "page_id", F.lit(2)).alias("version_id"), "title", "h1", "headings")
    status = content.page_status(F.when(i % 10 == 3, 404).otherwise(200), i % 20 == 7, F.lit(False))
    pages = found.drop("title", "h1", "headings", "status").withColumns({"status": status, "current_version_id": F.concat_ws("-", "page_id", F.when(i % 4 == 0, 1).otherwise(2))})
    return content.page_contents(pages, old.unionByName(new))


def candidates(spark, sf, given=None):
    facts, windows = given or inputs(spark, sf)
    return performance.page_candidates(facts, windows, page_dimension(spark, sf), CFG.min_impressions)


@query(f"WITH {FACTS}, {WINDOWS}, {PAIR}, {DIM}, {CAND} SELECT property_id, page_id, page AS url, c_clicks, c_impressions, c_position, c_ctr, p_clicks, p_impressions, p_position, p_ctr FROM cand")
def detect_page_aggregates(spark, sf):
    return candidates(spark, sf).select("property_id", "page_id", "url", *[f"{w}_{x}" for w in "cp" for x in ("clicks", "impressions", "position", "ctr")])


@query(f"WITH {FACTS}, {WINDOWS}, {RANKED} SELECT property_id, page, query, clicks, impressions, ctr, position, query_count, CAST(rn AS INTEGER) AS rn FROM ranked WHERE rn <= 25")
def page_top_queries(spark, sf):
    return performance.ranked_queries(*inputs(spark, sf), CFG.top_queries_limit).drop("org_id", "project_id")


@query(f"WITH {FACTS}, {WINDOWS}, {RANKED}, {SHARES} SELECT property_id, page AS url, query_count, query_impressions, improvable_share, top_share FROM shares")
def page_query_shares(spark, sf):
    lists = performance.query_lists(performance.ranked_queries(*inputs(spark, sf), CFG.top_queries_limit))
    return performance.query_shares(lists).drop("org_id", "project_id", "queries")


@query(f"WITH p AS (SELECT DISTINCT l_quantity::DOUBLE AS position FROM lineitem) SELECT position, {curve_sql('position')} AS expected_ctr FROM p")
def expected_ctr_curve(spark, sf):
    rows = tables.table(spark, sf, "lineitem").select(F.col("l_quantity").cast("double").alias("position")).distinct()
    return rows.select("position", expected_ctr(F.col("position")).alias("expected_ctr"))


@query("WITH x AS (SELECT DISTINCT l_extendedprice / 1000 AS x FROM lineitem) SELECT x, floor(x * 100 + 0.5) / 100 AS r2, floor(-x * 10 + 0.5) / 10 AS r1 FROM x")
def half_up_rounding(spark, sf):
    rows = tables.table(spark, sf, "lineitem").select((F.col("l_extendedprice") / 1000).alias("x")).distinct()
    return rows.select("x", half_up(F.col("x"), 2).alias("r2"), half_up(-F.col("x"), 1).alias("r1"))


def scored(spark, sf):
    facts, windows = inputs(spark, sf)
    return detect.opportunities(candidates(spark, sf, (facts, windows)), performance.ranked_queries(facts, windows, CFG.top_queries_limit), CFG)


@query(f"{ALL} SELECT property_id, page_id, {', '.join(f'floor(s_{x} * 1000 + 0.5) / 1000 AS s_{x}' for x in ('impressions', 'ctr', 'position', 'trend', 'query', 'coverage'))} FROM parts")
def score_components(spark, sf):
    facts, windows = inputs(spark, sf)
    lists = performance.query_lists(performance.ranked_queries(facts, windows, CFG.top_queries_limit))
    rows = detect.with_components(detect.with_facts(candidates(spark, sf, (facts, windows)).join(lists, [*TENANT, "url"], "left"), CFG), CFG)
    return rows.select("property_id", "page_id", *[half_up(F.col(f"s_{x}"), 3).alias(f"s_{x}") for x in ("impressions", "ctr", "position", "trend", "query", "coverage")])


@query(f"{ALL} SELECT property_id, page_id, url, type, score, clicks, impressions, ctr, position, cur_start AS date_start, cur_end AS date_end FROM found")
def opportunities(spark, sf):
    return scored(spark, sf).select("property_id", "page_id", "url", "type", "score", "clicks", "impressions", "ctr", "position", "date_start", "date_end")


@query(f"{ALL} SELECT page_id, type, score, impressions, clicks FROM found ORDER BY score DESC, impressions DESC, clicks DESC, page_id, type LIMIT 20 OFFSET 10")
def opportunities_list(spark, sf):
    return detect.listed(scored(spark, sf), 20, 10).select("page_id", "type", "score", "impressions", "clicks")


@query(f"{ALL} SELECT type, count(*) AS n, CAST(sum(impressions) AS BIGINT) AS impressions FROM found GROUP BY type")
def opportunities_by_type(spark, sf):
    return scored(spark, sf).groupBy("type").agg(F.count("*").alias("n"), F.sum("impressions").alias("impressions"))


@query(f"{ALL} SELECT * FROM gaps")
def coverage_gaps(spark, sf):
    facts, windows = inputs(spark, sf)
    lists = performance.query_lists(performance.ranked_queries(facts, windows, CFG.top_queries_limit))
    rows = detect.with_facts(candidates(spark, sf, (facts, windows)).join(lists, [*TENANT, "url"], "left"), CFG)
    return rows.select("page_id", F.explode("gaps").alias("g")).select("page_id", "g.query", "g.impressions", "g.clicks", "g.position")


@query(f"SELECT page_id, url, {CANON.format('url')} AS canonical FROM pages")
def url_normalize(spark, sf):
    return tables.table(spark, sf, "pages").select("page_id", "url", urls.canonical(F.col("url")).alias("canonical"))


@query("""WITH h AS (SELECT page_id, lower(regexp_extract(url, '://([^/?#]+)', 1)) AS host FROM pages), props AS (SELECT unnest(['example.com', 'example.org', 'blog.tionble.example.com']) AS domain)
SELECT page_id, host, domain FROM h JOIN props ON host = domain OR host LIKE '%.' || domain""")
def property_covers_host(spark, sf):
    hosts = tables.table(spark, sf, "pages").select("page_id", urls.host(F.col("url")).alias("host"))
    props = spark.createDataFrame([("example.com",), ("example.org",), ("blog.tionble.example.com",)], "domain string")
    return hosts.withColumn("domain", F.explode(urls.host_suffixes(F.col("host")))).join(props, "domain").select("page_id", "host", "domain")


@query("SELECT page_id, regexp_replace(lower(regexp_extract(url, '://([^/?#]+)', 1)), '^www\\.', '') = 'blog.tionsh.example.net' AS same_site, regexp_replace(lower(regexp_extract(url, '://([^/?#]+)', 1)), '^www\\.', '') = 'blog.tionsh.example.net' AND regexp_extract(url, '://[^/]+([^?#]*)', 1) LIKE '/es/%' AS crawlable FROM pages")
def crawl_candidates(spark, sf):
    url, site = F.col("url"), F.lit("blog.tionsh.example.net")
    return tables.table(spark, sf, "pages").select("page_id", urls.same_site(url, site).alias("same_site"), urls.crawlable(url, site, F.lit("/es/")).alias("crawlable"))


@query(f"WITH {DIM} SELECT status, count(*) AS n FROM dim GROUP BY status")
def pages_by_status(spark, sf):
    return page_dimension(spark, sf).groupBy("status").agg(F.count("*").alias("n"))


@query("""WITH d AS (SELECT page_id, """ + CANON.format("url") + """ AS url, trim(regexp_extract(html, '<title>(.*?)</title>', 1)) AS title FROM pages)
SELECT page_id, url FROM d WHERE contains(lower(url), 'tion') OR contains(lower(title), 'tion')""")
def page_search(spark, sf):
    needle = "TION".lower()
    return tables.content_pages(spark, sf).where(F.lower("url").contains(needle) | F.lower("title").contains(needle)).select("page_id", "url")


# Evidence as SQL: facts of a page with their texts, primary ones by type, and the facts that no primary one stands for.
_N = "printf('%d', CAST({0} AS BIGINT))"
_PCT = "printf('%.1f%%', floor({0} * 1000 + 0.5) / 10)"
_POS = "printf('%.1f', floor({0} * 10 + 0.5) / 10)"
_R2 = "floor({0} * 10000 + 0.5) / 100"


def _fact(name: str, when: str, kind: str, metric: str, value: str, threshold: str, text: str, query: str = "NULL") -> str:
    return f"SELECT page_id, '{name}' AS fact, '{kind}' AS e_type, '{metric}' AS metric, CAST({value} AS DOUBLE) AS value, CAST({threshold} AS DOUBLE) AS threshold, CAST({query} AS VARCHAR) AS query, {text} AS text FROM told WHERE {when}"


_FACTS = " UNION ALL ".join([
    _fact("high", "c_impressions >= 30", "HIGH_IMPRESSIONS", "impressions", "c_impressions", "30", f"'The page received ' || {_N.format('c_impressions')} || ' impressions between ' || cur_start || ' and ' || cur_end || ' (threshold: 30).'"),
    _fact("low", "c_impressions >= 15 AND c_position <= 20 AND c_ctr < lim", "LOW_CTR", "ctr", _R2.format("c_ctr"), _R2.format("lim"), f"'CTR was ' || {_PCT.format('c_ctr')} || ' at an average position of ' || {_POS.format('c_position')} || ', below the ' || {_PCT.format('lim')} || ' threshold (60% of the ≈' || {_PCT.format('expected_ctr')} || ' typical for that position).'"),
    _fact("one", "c_position BETWEEN 4 AND 10", "PAGE_ONE_RANKING", "position", "c_position", "4", f"'Average position was ' || {_POS.format('c_position')} || ', within the 4–10 range on page one.'"),
    _fact("clicks", "p_clicks >= 1 AND click_change <= -25", "CLICK_DECLINE", "clicks", "c_clicks", "-25", f"'Clicks went from ' || p_clicks || ' (' || prev_start || ' to ' || prev_end || ') to ' || c_clicks || ' (' || cur_start || ' to ' || cur_end || '), a ' || {_POS.format('abs(click_change)')} || '% decrease (threshold: 25%).'"),
    _fact("ctr", "p_impressions >= 10 AND c_impressions >= 10 AND ctr_change <= -25", "CTR_DECLINE", "ctr", _R2.format("c_ctr"), "-25", f"'CTR went from ' || {_PCT.format('p_ctr')} || ' to ' || {_PCT.format('c_ctr')} || ' between the two periods, a ' || {_POS.format('abs(ctr_change)')} || '% relative decrease.'"),
    _fact("moved", "p_impressions > 0 AND c_position - p_position >= 1", "POSITION_CHANGE", "position", "c_position", "1", f"'Average position moved from ' || {_POS.format('p_position')} || ' to ' || {_POS.format('c_position')} || ' (a higher number is further down the results).'"),
    _fact("top", "t_impressions >= 4", "HIGH_QUERY_IMPRESSIONS", "impressions", "t_impressions", "4", f"'Top query \"' || t_query || '\": ' || t_impressions || ' impressions, ' || t_clicks || ' clicks, CTR ' || {_PCT.format('t_ctr')} || ', average position ' || {_POS.format('t_position')} || '.'", "t_query"),
    _fact("share", "t_query IS NOT NULL AND top_share >= 0.5 AND query_count > 1", "QUERY_CONCENTRATION", "top_query_share", _R2.format("top_share"), "50", f"'\"' || t_query || '\" accounts for ' || {_PCT.format('top_share')} || ' of the impressions attributed to individual queries.'", "t_query"),
    "SELECT page_id, 'gap', 'CONTENT_COVERAGE_SIGNAL', 'covered_term_ratio', 0.0, 50.0, r.query, 'The query \"' || r.query || '\" had ' || r.impressions || ' impressions, but the page title, H1 and headings do not contain \"' || r.query || '\". The page may not cover this query in a dedicated section.' FROM told t JOIN gaps r USING (page_id)",
])
_PRIMARY = {"LOW_CTR": "fact = 'low'", "PAGE_ONE_NEAR_TOP": "fact = 'one'", "HIGH_IMPRESSIONS_LOW_CLICKS": "fact = 'high'", "PERFORMANCE_DECLINE": "fact IN ('clicks', 'ctr')", "CONTENT_COVERAGE_SIGNAL": "fact = 'gap'"}
EVIDENCE = f"""{ALL}, told AS (SELECT p.*, expected_ctr * 0.6::DOUBLE AS lim, r.query AS t_query, r.impressions AS t_impressions, r.clicks AS t_clicks, r.ctr AS t_ctr, r.position AS t_position
  FROM parts p LEFT JOIN ranked r ON r.page = p.page AND r.property_id = p.property_id AND r.rn = 1),
known AS ({_FACTS}),
prim AS ({" UNION ALL ".join(f"SELECT f.type, k.* FROM found f JOIN known k ON k.page_id = f.page_id WHERE f.type = '{t}' AND {w}" for t, w in _PRIMARY.items())}
  UNION ALL SELECT f.type, t.page_id, 'absolute', 'LOW_CTR', 'ctr', {_R2.format("t.c_ctr")}, 5.0, NULL, 'Only ' || c_clicks || ' clicks from ' || c_impressions || ' impressions: a CTR of ' || {_PCT.format("t.c_ctr")} || ', below 5.0%.' FROM found f JOIN told t ON t.page_id = f.page_id WHERE f.type = 'HIGH_IMPRESSIONS_LOW_CLICKS'),
evidence AS (SELECT *, true AS is_primary FROM prim UNION ALL SELECT f.type, k.*, false FROM found f JOIN known k ON k.page_id = f.page_id
  WHERE NOT EXISTS (SELECT 1 FROM prim p WHERE p.type = f.type AND p.page_id = f.page_id AND p.e_type = k.e_type AND p.metric = k.metric AND coalesce(p.query, '') = coalesce(k.query, '')))"""


@query(f"{EVIDENCE} SELECT page_id, type, e_type AS evidence_type, is_primary, metric, value, threshold, query, text FROM evidence")
def opportunity_evidence(spark, sf):
    rows = scored(spark, sf).select("page_id", "type", F.explode("evidence").alias("e"))
    return rows.select("page_id", "type", F.col("e.type").alias("evidence_type"), F.col("e.primary").alias("is_primary"), "e.metric", "e.value", "e.threshold", "e.query", "e.text")


@query(f"{EVIDENCE} SELECT page_id, type, string_agg(text, ' | ' ORDER BY text) AS texts FROM evidence WHERE is_primary GROUP BY ALL")
def opportunity_primary_texts(spark, sf):
    rows = detect.primary_texts(scored(spark, sf))
    return rows.select("page_id", "type", F.array_join(F.array_sort("evidence_texts"), " | ").alias("texts"))


_POINTS = " UNION ALL ".join(
    f"SELECT page_id, '{k}' AS type, CAST({n} AS INTEGER) AS place, '{x}' AS component, floor(s_{x} * 1000 + 0.5) / 1000 AS value, {WEIGHTS[k][x]} AS weight, floor(s_{x} * {WEIGHTS[k][x]} * 10 + 0.5) / 10 AS points FROM parts WHERE {FIRES[k]}"
    for k in FIRES for n, x in enumerate(sorted((x for x in WEIGHTS[k] if WEIGHTS[k][x]), key=lambda x: -WEIGHTS[k][x]))
)


@query(f"{ALL} {_POINTS}")
def score_breakdown(spark, sf):
    rows = scored(spark, sf).select("page_id", "type", F.posexplode("score_breakdown").alias("place", "b"))
    return rows.select("page_id", "type", "place", "b.component", "b.value", "b.weight", "b.points")


_ORDER = "CASE type " + " ".join(f"WHEN '{k}' THEN {n}" for n, k in enumerate(FIRES)) + " END"


@query(f"{ALL} SELECT page_id, string_agg(type, ',' ORDER BY score DESC, {_ORDER}) AS types FROM found GROUP BY page_id")
def opportunities_per_page(spark, sf):
    return detect.per_page(scored(spark, sf)).select("page_id", F.array_join("types", ",").alias("types"))


@query(f"{ALL} SELECT page_id, type, score, count(*) OVER () AS total FROM found ORDER BY score DESC, impressions DESC, clicks DESC, page_id, type LIMIT 20")
def opportunities_page_total(spark, sf):
    return detect.listed_with_total(scored(spark, sf), 20).select("page_id", "type", "score", "total")


@query(f"WITH {FACTS}, {WINDOWS}, {PAIR}, {DIM}, {CAND} SELECT page_id, c_impressions FROM cand ORDER BY coalesce(c_impressions, 0) DESC, page_id LIMIT 10 OFFSET 10")
def detection_batch(spark, sf):
    return detect.batch(candidates(spark, sf), 1, 10).select("page_id", "c_impressions")


@query(f"WITH {FACTS}, {WINDOWS}, {RANKED}, {PAIR}, {DIM}, {CAND} SELECT r.property_id, r.page, query, r.impressions, CAST(rn AS INTEGER) AS rn FROM ranked r SEMI JOIN cand c ON c.page = r.page AND c.property_id = r.property_id WHERE rn <= 25")
def selected_page_queries(spark, sf):
    """Queries of the pages that are candidates only: other pages go before any rank is taken."""
    facts, windows = inputs(spark, sf)
    chosen = performance.page_candidates(facts, windows, page_dimension(spark, sf), CFG.min_impressions).withColumnRenamed("url", "page")
    return performance.ranked_queries(performance.of_pages(facts, chosen), windows, CFG.top_queries_limit).select("property_id", "page", "query", "impressions", "rn")


@query(f"WITH {FACTS}, {WINDOWS}, {PAIR} SELECT property_id, page, c_clicks, c_impressions, c_position, p_clicks, p_impressions, p_position FROM pair WHERE page = (SELECT max(page) FROM facts WHERE query = '')")
def one_page_window_pair(spark, sf):
    facts, windows = inputs(spark, sf)
    page = facts.where("query = ''").agg(F.max("page")).first()[0]
    rows = performance.window_pair(tables.scoped(facts, tables.ORG, tables.PROJECT, page=page), windows)
    return rows.select("property_id", "page", *[f"{w}_{x}" for w in "cp" for x in ("clicks", "impressions", "position")])


@query(f"WITH {FACTS} SELECT property_id, count(*) AS n FROM facts GROUP BY property_id")
def property_row_counts(spark, sf):
    return tables.row_counts(tables.facts(spark, sf))


@query(f"WITH {FACTS} SELECT page, {SUMS} FROM facts WHERE query = '' GROUP BY page")
def row_level_totals(spark, sf):
    """Each page's totals by a walk over its rows, against which the rollups are held in tests."""
    rows = tables.facts(spark, sf).where("query = ''").groupBy("page").agg(F.collect_list(F.struct("clicks", "impressions", "position")).alias("rows"))
    return rows.select("page", performance.walked(F.col("rows")).alias("t")).select("page", "t.*")


@query(f"WITH {FACTS} SELECT date, property_id, query, impressions FROM facts WHERE property_id <> 'net'")
def property_switch(spark, sf):
    """Another site is chosen for a website: the facts of its old property go, and its sync state starts anew."""
    rows, _ = lifecycle.property_switched(tables.facts(spark, sf), property_states(spark, sf), "net")
    return rows.select("date", "property_id", "query", "impressions")


def property_states(spark, sf):
    rows = tables.facts(spark, sf).where("query = ''").groupBy("property_id").agg(F.max("date").alias("last_synced"))
    return rows.withColumns({"sync_status": F.lit("DONE"), "sync_error": F.lit(None).cast("string")})


@query(f"WITH {FACTS} SELECT property_id, CASE WHEN property_id <> 'net' THEN max(date) END AS last_synced, CASE WHEN property_id = 'net' THEN 'IDLE' ELSE 'DONE' END AS sync_status FROM facts WHERE query = '' GROUP BY property_id")
def property_switch_state(spark, sf):
    return lifecycle.property_switched(tables.facts(spark, sf), property_states(spark, sf), "net")[1].select("property_id", "last_synced", "sync_status")


@query("SELECT page_id, count(*) OVER () > 20 AS has_more FROM (SELECT page_id FROM pages WHERE page_id > 10 ORDER BY page_id LIMIT 21) LIMIT 20")
def page_keyset(spark, sf):
    return performance.keyset(tables.table(spark, sf, "pages").select("page_id"), "page_id", 10, 20)


_STEM = """CASE WHEN length(t) <= 4 THEN t WHEN regexp_matches(t, 'ations?$') THEN regexp_replace(t, 'ations?$', '') WHEN regexp_matches(t, 'ings?$') THEN regexp_replace(t, 'ings?$', '')
 WHEN regexp_matches(t, 'ies$') THEN regexp_replace(t, 'ies$', 'y') WHEN regexp_matches(t, '(ch|sh|ss|x|z)es$') THEN regexp_replace(t, 'es$', '') WHEN regexp_matches(t, 'ed$') THEN regexp_replace(t, 'ed$', '')
 WHEN regexp_matches(t, '[^s]s$') THEN regexp_replace(t, 's$', '') ELSE t END"""
_STOPS = "['" + "', '".join(sorted(terms.STOP_WORDS)) + "']"
_TOKENS = "list_filter(regexp_extract_all(strip_accents(lower({0})), '[\\p{{L}}\\p{{N}}]+'), lambda x: length(x) >= 2 AND NOT list_contains(" + _STOPS + ", x))"
_TOKENS = "list_filter(" + _TOKENS + ", lambda t: NOT list_contains(" + _STOPS + ", " + _STEM + "))"


@query(f"WITH w AS (SELECT DISTINCT unnest({_TOKENS.format('text')}) AS t FROM conversations), s AS (SELECT t AS term, {_STEM} AS stem FROM w) SELECT * FROM s WHERE NOT list_contains({_STOPS}, stem)")
def query_terms(spark, sf):
    words = tables.table(spark, sf, "conversations").select(F.explode(terms.tokens_column(F.col("text"))).alias("term")).distinct()
    return words.select("term", terms.stem_column(F.col("term")).alias("stem"))


@query(f"""WITH p AS (SELECT page_id, trim(regexp_extract(html, '<title>(.*?)</title>', 1)) AS title FROM pages),
q AS (SELECT page_id, title, list_transform({_TOKENS.format("title")}, lambda w: CASE page_id % 4 WHEN 0 THEN w || 's' WHEN 1 THEN w || 'ing' WHEN 2 THEN substr(w, 1, 5) || 'xx' ELSE 'zz' || w END) AS asked FROM p),
a AS (SELECT page_id, unnest(list_distinct(asked)) AS t FROM q), ast AS (SELECT page_id, t, {_STEM} AS stem FROM a WHERE NOT list_contains({_STOPS}, t)),
b AS (SELECT page_id, unnest({_TOKENS.format("title")}) AS t FROM p), bst AS (SELECT page_id, {_STEM} AS stem FROM b),
f AS (SELECT page_id, t, bool_or(a.stem = b.stem OR (length(a.stem) >= 5 AND length(b.stem) >= 5 AND substr(a.stem, 1, 5) = substr(b.stem, 1, 5))) AS known FROM ast a LEFT JOIN bst b USING (page_id) WHERE NOT list_contains({_STOPS}, a.stem) GROUP BY ALL)
SELECT page_id, t AS term, coalesce(known, false) AS covered FROM f""")
def fuzzy_terms(spark, sf):
    """Whether a page's title covers terms made from its own words: with other endings, cut and lengthened, or with a new beginning."""
    rows = tables.content_pages(spark, sf).select("page_id", "title", terms.tokens_column(F.col("title")).alias("own"))
    kind = F.col("page_id") % 4
    asked = F.transform("own", lambda w: F.when(kind == 0, F.concat(w, F.lit("s"))).when(kind == 1, F.concat(w, F.lit("ing"))).when(kind == 2, F.concat(F.substring(w, 1, 5), F.lit("xx"))).otherwise(F.concat(F.lit("zz"), w)))
    rows = rows.select("page_id", "title", terms.tokens_column(F.array_join(asked, " ")).alias("asked"))
    rows = rows.select("page_id", F.array_distinct("asked").alias("asked"), terms.lacking_column(F.col("asked"), F.col("title")).alias("lacking"))
    return rows.select("page_id", F.explode("asked").alias("term"), "lacking").select("page_id", "term", (~F.array_contains("lacking", F.col("term"))).alias("covered"))


_BASES = ("https://Example.com/x", "http://example.com:80/", "https://example.com:8443/", "https://user:pw@example.com/", "https://localhost/", "https://10.0.0.1/", "ftp://example.com/", "https://shop.example.co.uk/a?b", "https://intranet.local/", "nonsense")


@query("SELECT page_id, ['https://example.com', 'http://example.com', NULL, NULL, NULL, NULL, NULL, 'https://shop.example.co.uk', NULL, NULL][page_id % 10 + 1] AS base FROM pages")
def base_urls(spark, sf):
    given = F.element_at(F.array(*map(F.lit, _BASES)), (F.col("page_id") % 10 + 1).cast("int"))
    return tables.table(spark, sf, "pages").select("page_id", urls.base_url(given).alias("base"))


@query("""WITH u AS (SELECT page_id, 'https://www.site.com' || regexp_extract(url, '://[^/?#]+(.*)', 1) AS url FROM pages),
c AS (SELECT page_id AS place, url FROM u UNION ALL SELECT page_id + 1000000, url FROM u UNION ALL SELECT 2000000 + page_id, 'mailto:a@b.c' FROM u UNION ALL SELECT page_id, 'https://www.site.com/' || page_id || '.pdf' FROM u UNION ALL SELECT page_id, 'https://other.com/' FROM u),
n AS (SELECT """ + CANON.format("url") + """ AS url, place FROM c WHERE url LIKE 'https://www.site.com/%' AND url NOT LIKE '%.pdf') SELECT url, min(place) AS place FROM n GROUP BY url""")
def first_seen_urls(spark, sf):
    """Candidates of a crawl of one site in the order they were met first: each is there twice, and some are no pages of it."""
    rest = F.regexp_extract("url", "://[^/?#]+(.*)", 1)
    rows = tables.table(spark, sf, "pages").select(F.col("page_id").cast("long").alias("at"), F.concat(F.lit("https://www.site.com"), rest).alias("url"))
    odd = [rows.select((F.col("at") + 2_000_000).alias("at"), F.lit("mailto:a@b.c").alias("url")), rows.select("at", F.concat(F.lit("https://www.site.com/"), "at", F.lit(".pdf")).alias("url")), rows.select("at", F.lit("https://other.com/").alias("url"))]
    found = rows.unionByName(rows.withColumn("at", F.col("at") + 1_000_000))
    for more in odd:
        found = found.unionByName(more)
    return urls.first_seen(found, F.lit("site.com")).withColumnRenamed("at", "place")
