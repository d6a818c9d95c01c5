"""Performance rollups of one grain: totals, series, top lists, two windows in one scan, queries per page."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.numeric import half_up, ratio, weighted_position
from tidemark.sources.tables import of_grain, only

TENANT = ("org_id", "project_id", "property_id")


def measures():
    clicks, impressions = F.sum("clicks"), F.sum("impressions")
    return [F.coalesce(clicks, F.lit(0)).alias("clicks"), F.coalesce(impressions, F.lit(0)).alias("impressions"), ratio(clicks, impressions).alias("ctr"), half_up(weighted_position(F.col("position"), F.col("impressions")), 2).alias("position")]


def totals(facts: DataFrame) -> DataFrame:
    """One row over the page grain, zeros and a null position without facts."""
    return only(facts, "page").agg(*measures())


def daily(facts: DataFrame) -> DataFrame:
    """By date, ascending; days without facts are absent."""
    return only(facts, "page").groupBy("date").agg(*measures()).orderBy("date")


def top(facts: DataFrame, by: str, limit: int = 50) -> DataFrame:
    """The top pages (page grain) or queries (query grain) by impressions, then by name."""
    rows = only(facts, "page" if by == "page" else "query").groupBy(by).agg(*measures())
    return rows.orderBy(F.desc("impressions"), by).limit(limit)


def within(facts: DataFrame, windows: DataFrame, first: str) -> DataFrame:
    """Facts of the days that some property's windows span, as literal bounds: a scan leaves all other days out."""
    bounds = windows.agg(F.min(first).alias("lo"), F.max("cur_end").alias("hi")).first()
    return facts.where(F.col("date").between(F.lit(bounds.lo), F.lit(bounds.hi)))


def window_pair(facts: DataFrame, windows: DataFrame) -> DataFrame:
    """Clicks, impressions and position of each page in the current and the previous window of its property, in one scan.

    windows (one row for each property) is joined on the tenant's keys; rows outside both windows drop out."""
    rows = within(only(facts, "page"), windows, "prev_start").join(windows, list(TENANT)).where(F.col("date").between(F.col("prev_start"), F.col("cur_end")))
    cur, prev = F.col("date") >= F.col("cur_start"), F.col("date") <= F.col("prev_end")
    out = []
    for name, when in (("c", cur), ("p", prev)):
        out += [F.coalesce(F.sum(F.when(when, F.col("clicks"))), F.lit(0)).alias(f"{name}_clicks"), F.coalesce(F.sum(F.when(when, F.col("impressions"))), F.lit(0)).alias(f"{name}_impressions"), half_up(weighted_position(F.col("position"), F.col("impressions"), when), 2).alias(f"{name}_position")]
    return rows.groupBy(*TENANT, "page", "prev_start", "prev_end", "cur_start", "cur_end").agg(*out)


def page_candidates(facts: DataFrame, windows: DataFrame, pages: DataFrame, min_impressions: int) -> DataFrame:
    """window_pair() of pages with min_impressions in either window, joined to active crawled pages."""
    pair = window_pair(facts, windows).where((F.col("c_impressions") >= min_impressions) | (F.col("p_impressions") >= min_impressions))
    active = pages.where(F.col("status") == "ACTIVE").select(*TENANT, "page_id", "url", "title", "h1", "headings")
    rows = pair.withColumnRenamed("page", "url").join(active, [*TENANT, "url"])
    for w in ("c", "p"):
        rows = rows.withColumn(f"{w}_ctr", ratio(F.col(f"{w}_clicks"), F.col(f"{w}_impressions")))
    return rows


def ranked_queries(facts: DataFrame, windows: DataFrame, limit: int = 25) -> DataFrame:
    """The limit top queries of each page in its current window: rank rn, and query_count over all its queries."""
    rows = within(only(facts, "query"), windows, "cur_start").join(windows, list(TENANT)).where(F.col("date").between(F.col("cur_start"), F.col("cur_end")))
    page = Window.partitionBy(*TENANT, "page")
    out = rows.groupBy(*TENANT, "page", "query").agg(*measures())
    out = out.withColumn("query_count", F.count("*").over(page)).withColumn("rn", F.row_number().over(page.orderBy(F.desc("impressions"), F.desc("clicks"), "query")))
    return out.where(F.col("rn") <= limit)


def query_lists(ranked: DataFrame) -> DataFrame:
    """For each page its ranked queries as one array, and their number before the cut."""
    item = F.struct("rn", "query", "clicks", "impressions", "ctr", "position")
    return ranked.groupBy(*TENANT, F.col("page").alias("url")).agg(F.max("query_count").alias("query_count"), F.array_sort(F.collect_list(item)).alias("queries"))


def query_shares(lists: DataFrame, low: float = 4, high: float = 20) -> DataFrame:
    """Impressions over the listed queries, and the shares of the top one and of those at improvable positions."""
    total = F.aggregate("queries", F.lit(0).cast("long"), lambda s, q: s + q["impressions"])
    good = F.aggregate(F.filter("queries", lambda q: q["position"].between(low, high)), F.lit(0).cast("long"), lambda s, q: s + q["impressions"])
    return lists.withColumn("query_impressions", total).withColumn("improvable_share", ratio(good, F.col("query_impressions"))).withColumn("top_share", ratio(F.coalesce(F.get("queries", F.lit(0))["impressions"], F.lit(0)), F.col("query_impressions")))


def of_pages(facts: DataFrame, pages: DataFrame) -> DataFrame:
    """Facts of the given pages (tenant keys, page) only."""
    return facts.join(pages.select(*TENANT, "page"), [*TENANT, "page"], "left_semi")


def walked(rows: Column) -> Column:
    """Totals of an array of rows (clicks, impressions, position), one after the other: what rollups are held against."""
    start = F.struct(F.lit(0).cast("long").alias("clicks"), F.lit(0).cast("long").alias("impressions"), F.lit(0.0).alias("weight"))

    def step(s: Column, r: Column) -> Column:
        return F.struct((s["clicks"] + r["clicks"]).alias("clicks"), (s["impressions"] + r["impressions"]).alias("impressions"), (s["weight"] + r["position"] * r["impressions"]).alias("weight"))

    def finish(s: Column) -> Column:
        place = F.when(s["impressions"] > 0, half_up(s["weight"] / s["impressions"], 2))
        return F.struct(s["clicks"].alias("clicks"), s["impressions"].alias("impressions"), ratio(s["clicks"], s["impressions"]).alias("ctr"), place.alias("position"))

    return F.aggregate(rows, start, step, finish)


def keyset(rows: DataFrame, key: str, after, limit: int) -> DataFrame:
    """The limit rows after a key, in its order, with has_more: one more is read, and only these few are counted."""
    few = rows.where(F.col(key) > after).orderBy(key).limit(limit + 1)
    # one row of one flag: broadcast by construction
    more = few.agg((F.count("*") > limit).alias("has_more"))
    return few.orderBy(key).limit(limit).join(F.broadcast(more))


#: Levels of rollup: nothing, tenant, property, page, query, and page with query.
LEVELS = ((), TENANT[:2], TENANT, (*TENANT, "page"), (*TENANT, "query"), (*TENANT, "page", "query"))


def levels(facts: DataFrame) -> DataFrame:
    """Totals at all levels in one pass: grain, the level's keys (null above it), level (0 to 5 in order of LEVELS) and measures.

    Grains are never mixed: each level is there for page totals and for query rows, but those by query for query rows only.
    One Expand; partial sums go into the shuffle, so that a row of it stands for a group of a task, not for a fact. A level's
    keys that are null in the facts differ from those left out by level."""
    named = facts if "grain" in facts.columns else facts.withColumn("grain", F.when(of_grain("page"), "page").otherwise("query"))
    keys = [*TENANT, "page", "query"]
    rows = named.groupingSets([["grain", *x] for x in LEVELS], "grain", *keys).agg(F.grouping_id().alias("_id"), *measures())
    code = {sum(1 << len(keys) - 1 - k for k, c in enumerate(keys) if c not in x): n for n, x in enumerate(LEVELS)}
    level = F.element_at(F.create_map(*[F.lit(v) for pair in code.items() for v in pair]), F.col("_id").cast("int"))
    return rows.withColumn("level", level).drop("_id").where((F.col("grain") == "query") | (F.col("level") < 4))


def by_weekday(facts: DataFrame) -> DataFrame:
    """Impressions of each property by weekday (Monday first), a column each, in one pass; 0 without facts."""
    day = F.weekday("date")
    rows = only(facts, "page").groupBy(*TENANT)
    return rows.agg(*[F.coalesce(F.sum(F.when(day == k, F.col("impressions"))), F.lit(0)).alias(name) for k, name in enumerate(("mon", "tue", "wed", "thu", "fri", "sat", "sun"))])


def trend_breaks(facts: DataFrame, days: int = 7, change: float = 0.5, least: int = 5) -> DataFrame:
    """page days at which the impressions of the next days, this one first, differ from those of the days before by at least the
    part change of the larger, where both windows lie inside the page's span and one has least impressions.

    Days without facts count as 0: frames go by date, not by row, and every day of a page's span is there once. A page's days
    are one window group: as many rows as its span has days, whatever its facts are."""
    keys = [*TENANT, "page"]
    daily = only(facts, "page").groupBy(*keys, "date").agg(F.sum("impressions").alias("impressions"))
    span = daily.groupBy(*keys).agg(F.min("date").alias("_lo"), F.max("date").alias("_hi"))
    calendar = span.withColumn("date", F.explode(F.sequence("_lo", "_hi")))
    rows = calendar.join(daily, [*keys, "date"], "left").withColumns({"impressions": F.coalesce("impressions", F.lit(0)), "_day": F.unix_date("date")})
    order = Window.partitionBy(*keys).orderBy("_day")
    before, after = (F.sum("impressions").over(order.rangeBetween(*x)) for x in ((-days, -1), (0, days - 1)))
    rows = rows.withColumns({"before": before, "after": after})
    whole = (F.date_sub("date", days) >= F.col("_lo")) & (F.date_add("date", days - 1) <= F.col("_hi"))
    larger = F.greatest("before", "after")
    broken = whole & (larger >= least) & (F.abs(F.col("after") - F.col("before")) >= change * larger)
    return rows.where(broken).select(*keys, "date", "before", "after")
