"""Opportunity detection: facts with evidence, rules, scores. One row in per page, one out per page and type."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.config import COMPONENTS, TYPES, WEIGHTS, DetectionConfig
from tidemark.functions.numeric import expected_ctr, half_up, log_scaled, percent_change, ratio, unit_interval
from tidemark.functions.terms import coverage_gaps
from tidemark.operators.performance import TENANT, query_lists, query_shares

EVIDENCE = "type string, primary boolean, metric string, unit string, value double, threshold double, comparison string, threshold_max double, previous_value double, query string, missing_terms array<string>, text string"
_FIELDS = [x.split() for x in EVIDENCE.split(", ")]


def count_text(x: Column) -> Column:
    return F.format_number(half_up(x.cast("double")).cast("long"), 0)


def percent_text(x: Column) -> Column:
    return F.format_string("%.1f%%", F.floor(x * 1000.0 + 0.5) / 10.0)  # scaled once: a second product could round again


def place_text(x: Column) -> Column:
    return F.format_string("%.1f", half_up(x, 1))


def as_percent(x: Column) -> Column:
    """A ratio as a percentage with two digits."""
    return F.floor(x * 10_000.0 + 0.5).cast("double") / 100.0


def evidence(when: Column, text: Column, **fields: Column | str | float) -> Column:
    """An evidence struct where the condition holds, else null; absent fields are null."""
    values = {"primary": False, **fields}
    cells = []
    for name, kind in _FIELDS:
        v = text if name == "text" else values.get(name)
        cells.append((v if isinstance(v, Column) else F.lit(v)).cast(kind).alias(name))
    return F.when(when, F.struct(*cells))


def with_facts(rows: DataFrame, cfg: DetectionConfig) -> DataFrame:
    """Adds expected_ctr, changes, shares and gaps, and one array of all facts that hold."""
    c = F.col
    rows = rows.withColumn("queries", F.coalesce("queries", F.array().cast("array<struct<rn:int,query:string,clicks:bigint,impressions:bigint,ctr:double,position:double>>"))).withColumn("query_count", F.coalesce("query_count", F.lit(0)))
    rows = query_shares(rows, cfg.page_one_min_position, cfg.low_ctr_max_position)
    rows = rows.withColumns({
        "expected_ctr": expected_ctr(c("c_position")),
        "click_change": percent_change(c("p_clicks"), c("c_clicks")), "ctr_change": percent_change(c("p_ctr"), c("c_ctr")),
        "top_query": F.get("queries", F.lit(0)),
        "gaps": coverage_gaps(c("queries"), c("title"), c("h1"), c("headings"), cfg.min_query_impressions, cfg.coverage_max_queries, cfg.coverage_min_term_ratio),
    })
    rows = rows.withColumn("uncovered_share", ratio(F.aggregate("gaps", F.lit(0).cast("long"), lambda s, g: s + g["impressions"]), c("query_impressions")))
    found = {
        "high_impressions": high_impressions(cfg), "low_ctr": low_ctr(cfg), "page_one": page_one(cfg), "click_decline": click_decline(cfg), "ctr_decline": ctr_decline(cfg),
        "position_change": position_change(cfg), "top_query_fact": top_query(cfg), "concentration": concentration(cfg),
    }
    rows = rows.withColumns(found).withColumn("gap_facts", F.transform("gaps", lambda g: gap_fact(g, cfg)))
    return rows.withColumn("facts", F.concat(F.filter(F.array(*found), lambda e: e.isNotNull()), "gap_facts"))


def said(*parts: Column | str) -> Column:
    """A text of literal and computed parts."""
    return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])


def high_impressions(cfg: DetectionConfig) -> Column:
    n = F.col("c_impressions")
    text = said("The page received ", count_text(n), " impressions between ", F.col("cur_start"), " and ", F.col("cur_end"), " (threshold: ", count_text(F.lit(cfg.high_impressions)), ").")
    return evidence(n >= cfg.high_impressions, text, type="HIGH_IMPRESSIONS", metric="impressions", unit="count", value=n, threshold=cfg.high_impressions, comparison=">=")


def low_ctr(cfg: DetectionConfig) -> Column:
    ctr, place, limit = F.col("c_ctr"), F.col("c_position"), F.col("expected_ctr") * cfg.low_ctr_ratio
    share = f" threshold ({int(cfg.low_ctr_ratio * 100 + 0.5)}% of the ≈"
    text = said("CTR was ", percent_text(ctr), " at an average position of ", place_text(place), ", below the ", percent_text(limit), share, percent_text(F.col("expected_ctr")), " typical for that position).")
    fires = place.isNotNull() & (F.col("c_impressions") >= cfg.low_ctr_min_impressions) & (place <= cfg.low_ctr_max_position) & (ctr < limit)
    return evidence(fires, text, type="LOW_CTR", metric="ctr", unit="percent", value=as_percent(ctr), threshold=as_percent(limit), comparison="<")


def absolute_ctr(cfg: DetectionConfig) -> Column:
    """The low click-through rate of a page with many impressions, at any position."""
    ctr, limit = F.col("c_ctr"), F.lit(cfg.high_impressions_max_ctr)
    text = said("Only ", count_text(F.col("c_clicks")), " clicks from ", count_text(F.col("c_impressions")), " impressions: a CTR of ", percent_text(ctr), ", below ", percent_text(limit), ".")
    return evidence(F.lit(True), text, type="LOW_CTR", primary=True, metric="ctr", unit="percent", value=as_percent(ctr), threshold=as_percent(limit), comparison="<")


def page_one(cfg: DetectionConfig) -> Column:
    place, low, high = F.col("c_position"), cfg.page_one_min_position, cfg.page_one_max_position
    text = said("Average position was ", place_text(place), f", within the {low:g}–{high:g} range on page one.")
    return evidence(place.between(low, high), text, type="PAGE_ONE_RANKING", metric="position", unit="position", value=half_up(place, 2), threshold=low, threshold_max=high, comparison="between")


def click_decline(cfg: DetectionConfig) -> Column:
    before, now, change = F.col("p_clicks"), F.col("c_clicks"), F.col("click_change")
    was = said("Clicks went from ", count_text(before), " (", F.col("prev_start"), " to ", F.col("prev_end"), ")")
    text = said(was, " to ", count_text(now), " (", F.col("cur_start"), " to ", F.col("cur_end"), "), a ", place_text(F.abs(change)), f"% decrease (threshold: {cfg.min_decline_percent:g}%).")
    fires = (before >= cfg.decline_min_previous_clicks) & (change <= -cfg.min_decline_percent)
    return evidence(fires, text, type="CLICK_DECLINE", metric="clicks", unit="count", value=now, previous_value=before, threshold=-cfg.min_decline_percent, comparison="<")


def ctr_decline(cfg: DetectionConfig) -> Column:
    before, now, change = F.col("p_ctr"), F.col("c_ctr"), F.col("ctr_change")
    text = said("CTR went from ", percent_text(before), " to ", percent_text(now), " between the two periods, a ", place_text(F.abs(change)), "% relative decrease.")
    fires = (F.col("p_impressions") >= cfg.decline_min_previous_impressions) & (F.col("c_impressions") >= cfg.min_impressions) & (change <= -cfg.min_decline_percent)
    return evidence(fires, text, type="CTR_DECLINE", metric="ctr", unit="percent", value=as_percent(now), previous_value=as_percent(before), threshold=-cfg.min_decline_percent, comparison="<")


def position_change(cfg: DetectionConfig) -> Column:
    before, now = F.col("p_position"), F.col("c_position")
    text = said("Average position moved from ", place_text(before), " to ", place_text(now), " (a higher number is further down the results).")
    fires = (F.col("p_impressions") > 0) & (now - before >= cfg.position_change_min)
    return evidence(fires, text, type="POSITION_CHANGE", metric="position", unit="position", value=half_up(now, 2), previous_value=half_up(before, 2), threshold=cfg.position_change_min, comparison=">=")


def top_query(cfg: DetectionConfig) -> Column:
    top = F.col("top_query")
    place = F.when(top["position"].isNotNull(), said(", average position ", place_text(top["position"]))).otherwise(F.lit(""))
    text = said('Top query "', top["query"], '": ', count_text(top["impressions"]), " impressions, ", count_text(top["clicks"]), " clicks, CTR ", percent_text(top["ctr"]), place, ".")
    return evidence(top["impressions"] >= cfg.min_query_impressions, text, type="HIGH_QUERY_IMPRESSIONS", metric="impressions", unit="count", value=top["impressions"], threshold=cfg.min_query_impressions, comparison=">=", query=top["query"])


def concentration(cfg: DetectionConfig) -> Column:
    top, share = F.col("top_query"), F.col("top_share")
    text = said('"', top["query"], '" accounts for ', percent_text(share), " of the impressions attributed to individual queries.")
    fires = top.isNotNull() & (F.col("query_impressions") > 0) & (share >= cfg.query_concentration_share) & (F.col("query_count") > 1)
    return evidence(fires, text, type="QUERY_CONCENTRATION", metric="top_query_share", unit="percent", value=as_percent(share), threshold=as_percent(F.lit(cfg.query_concentration_share)), comparison=">=", query=top["query"])


def gap_fact(gap: Column, cfg: DetectionConfig) -> Column:
    terms = F.array_join(F.transform(gap["missing_terms"], lambda t: said('"', t, '"')), ", ")
    text = said('The query "', gap["query"], '" had ', count_text(gap["impressions"]), " impressions, but the page title, H1 and headings do not contain ", terms, ". The page may not cover this query in a dedicated section.")
    return evidence(
        F.lit(True), text, type="CONTENT_COVERAGE_SIGNAL", metric="covered_term_ratio", unit="percent", value=as_percent(gap["ratio"]), threshold=as_percent(F.lit(cfg.coverage_min_term_ratio)), comparison="<",
        query=gap["query"], missing_terms=gap["missing_terms"],
    )


def summary_text() -> Column:
    place = F.when(F.col("c_position").isNotNull(), said(" and an average position of ", place_text(F.col("c_position")))).otherwise(F.lit(""))
    window = said(" between ", F.col("cur_start"), " and ", F.col("cur_end"), ", with a CTR of ", percent_text(F.col("c_ctr")), place)
    end = ". It shows a measurable optimization opportunity based on its current Search Console performance."
    return said("This page received ", count_text(F.col("c_impressions")), " impressions and ", count_text(F.col("c_clicks")), " clicks", window, end)


def with_components(rows: DataFrame, cfg: DetectionConfig) -> DataFrame:
    """Adds the six score components, each from 0 to 1."""
    c, lo, hi, far = F.col, cfg.page_one_min_position, cfg.page_one_max_position, cfg.low_ctr_max_position
    p, want = c("c_position"), F.coalesce("expected_ctr", F.lit(0.0))
    place = F.when(p < lo, 0.3).when(p <= hi, 1 - (p - lo) * 0.3 / float(max(hi - lo, 1))).when(p < far, (far - p) * 0.7 / float(max(far - hi, 1))).otherwise(0.0)
    fall = F.greatest(-F.coalesce("click_change", F.lit(0.0)), -F.coalesce("ctr_change", F.lit(0.0)), F.lit(0.0))
    return rows.withColumns({
        "s_impressions": log_scaled(c("c_impressions"), cfg.min_impressions, cfg.impressions_scale_max),
        "s_ctr": F.when(want > 0, unit_interval((want - c("c_ctr")) / want)).otherwise(F.lit(0.0)),
        "s_position": unit_interval(place), "s_trend": unit_interval(fall / float(cfg.trend_full_decline_percent)),
        "s_query": unit_interval(c("improvable_share")), "s_coverage": unit_interval(c("uncovered_share") / float(cfg.coverage_full_share)),
    })


def breakdown(kind: str) -> Column:
    """Points of a type by component, heaviest first; points are rounded before they are summed."""
    order = sorted((x for x in WEIGHTS[kind] if WEIGHTS[kind][x]), key=lambda x: -WEIGHTS[kind][x])
    return F.array(*[F.struct(F.lit(x).alias("component"), half_up(F.col(f"s_{x}"), 3).alias("value"), F.lit(WEIGHTS[kind][x]).alias("weight"), half_up(F.col(f"s_{x}") * float(WEIGHTS[kind][x]), 1).alias("points")) for x in order])


def total(points: Column) -> Column:
    return half_up(F.least(F.lit(100.0), F.greatest(F.lit(0.0), F.aggregate(points, F.lit(0.0), lambda s, b: s + b["points"]))), 1)


def rule_evidence(kind: str, cfg: DetectionConfig) -> Column:
    """The primary evidence of a type, or an empty array where its rule doesn't fire."""
    c = F.col
    some = lambda *names: F.filter(F.array(*names), lambda e: e.isNotNull())
    return {
        "LOW_CTR": some("low_ctr"),
        "PAGE_ONE_NEAR_TOP": F.when(c("c_impressions") >= cfg.page_one_min_impressions, some("page_one")).otherwise(some(F.lit(None).cast(F_STRUCT))),
        "HIGH_IMPRESSIONS_LOW_CLICKS": F.when(c("high_impressions").isNotNull() & (c("c_ctr") < cfg.high_impressions_max_ctr), F.array("high_impressions", absolute_ctr(cfg))).otherwise(some(F.lit(None).cast(F_STRUCT))),
        "PERFORMANCE_DECLINE": some("click_decline", "ctr_decline"),
        "CONTENT_COVERAGE_SIGNAL": c("gap_facts"),
    }[kind]


F_STRUCT = "struct<" + ",".join(f"{n}:{k}" for n, k in _FIELDS) + ">"


def merged_evidence(primary: Column, facts: Column) -> Column:
    """Primary evidence first, then the facts whose type, metric and query aren't among it."""
    key = lambda e: F.concat_ws(":", e["type"], e["metric"], F.coalesce(e["query"], F.lit("")))
    mine = F.transform(primary, key)
    return F.concat(F.transform(primary, lambda e: e.withField("primary", F.lit(True))), F.filter(facts, lambda e: ~F.array_contains(mine, key(e))))


def opportunities(candidates: DataFrame, ranked: DataFrame, cfg: DetectionConfig) -> DataFrame:
    """Every opportunity of every page: candidates from page_candidates(), ranked from ranked_queries().

    Columns: tenant keys, page_id, url, title, type, score, score_breakdown, evidence, window, totals and changes, gaps,
    queries. Joined once by page, all rules are columns of one projection, then one explode."""
    rows = candidates.join(query_lists(ranked), [*TENANT, "url"], "left")
    rows = with_components(with_facts(rows, cfg), cfg)
    found = []
    for k, kind in enumerate(TYPES):
        primary, points = rule_evidence(kind, cfg), breakdown(kind)
        found.append(F.when(F.size(primary) > 0, F.struct(F.lit(kind).alias("type"), F.lit(k).alias("rule"), primary.alias("primary"), points.alias("score_breakdown"))))
    moved = F.when(F.col("p_impressions") > 0, half_up(F.col("c_position") - F.col("p_position"), 2))
    rows = rows.withColumn("found", F.explode(F.filter(F.array(*found), lambda x: x.isNotNull())))
    return rows.select(
        *TENANT, "page_id", "url", "title", "found.type", "found.rule", total(F.col("found.score_breakdown")).alias("score"), "found.score_breakdown", merged_evidence(F.col("found.primary"), F.col("facts")).alias("evidence"), F.col("cur_start").alias("date_start"), F.col("cur_end").alias("date_end"),
        F.col("c_clicks").alias("clicks"), F.col("c_impressions").alias("impressions"), F.col("c_ctr").alias("ctr"), F.col("c_position").alias("position"),
        "expected_ctr", "query_count", half_up(F.col("click_change"), 1).alias("click_change"), half_up(F.col("ctr_change"), 1).alias("ctr_change"), moved.alias("position_change"),
        F.transform("gaps", lambda g: g.withField("ratio", half_up(g["ratio"], 2))).alias("coverage_gaps"), summary_text().alias("summary"), F.col("queries").alias("top_queries"),
    )


def primary_texts(found: DataFrame) -> DataFrame:
    """The listing's projection: texts of primary evidence only."""
    return found.withColumn("evidence_texts", F.transform(F.filter("evidence", lambda e: e["primary"]), lambda e: e["text"])).drop("evidence")


def listed(found: DataFrame, limit: int, offset: int = 0) -> DataFrame:
    """By score, impressions and clicks, each descending, then page and type."""
    return found.orderBy(F.desc("score"), F.desc("impressions"), F.desc("clicks"), "page_id", "type").offset(offset).limit(limit)


def per_page(found: DataFrame) -> DataFrame:
    """Each page's opportunities (types) by score, heaviest first; ties keep the order of the rules."""
    item = F.struct((-F.col("score")).alias("weight"), "rule", "type")
    rows = found.groupBy(*TENANT, "page_id").agg(F.array_sort(F.collect_list(item)).alias("items"))
    return rows.withColumn("types", F.transform("items", lambda x: x["type"])).drop("items")


def listed_with_total(found: DataFrame, limit: int, offset: int = 0) -> DataFrame:
    """listed() with the number of all rows beside each of its few."""
    total = found.agg(F.count("*").alias("total"))
    # one row of one count: broadcast by construction
    return listed(found, limit, offset).join(F.broadcast(total))


def batch(candidates: DataFrame, number: int, size: int = 200) -> DataFrame:
    """One batch of candidates by impressions (null as 0), descending, then page."""
    return candidates.orderBy(F.desc(F.coalesce("c_impressions", F.lit(0))), "page_id").offset(number * size).limit(size)
