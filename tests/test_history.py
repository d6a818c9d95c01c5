"""As-of joins, sketches, rollups at all levels, redirects and trend breaks against plain definitions."""

import datetime as dt
import math
import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators import asof, performance, redirects, sketches, skew

DAY = dt.date(2026, 1, 1)


def day(k):
    return DAY + dt.timedelta(k)


def in_force(facts, versions):
    """(key, day, n, version) by looking through all versions of each fact."""
    out = []
    for k, d, n in facts:
        known = [(s, v) for i, s, v in versions if i == k and i is not None and d is not None and s is not None and s <= d]
        out.append((k, d, n, max(known)[1] if known else None))
    return sorted(out, key=str)


@pytest.mark.parametrize("days, few", [(32, 100_000), (5, 100_000), (1, 3), (400, 2)])
def test_as_of(spark, monkeypatch, days, few):
    monkeypatch.setattr(skew, "MOST_KEYS", 100)
    draw = random.Random(days)
    facts = [(draw.choice("aab"), day(draw.randrange(-20, 120)), n) for n in range(150)] + [("hot", day(k % 7), k) for k in range(200)]
    facts += [(None, day(1), 1), ("a", None, 2), ("none", day(3), 3)] + [("a", day(10), 4)] * 3
    versions = [(draw.choice("aab"), day(draw.randrange(0, 100)), v) for v in range(30)] + [("hot", day(0), 100), ("hot", day(4), 101), ("hot", day(5), 102), ("a", day(50), 103), ("a", day(50), 104)]
    versions += [(None, day(0), 105), ("a", None, 106)]
    left, right = spark.createDataFrame(facts, "page string, date date, n int"), spark.createDataFrame(versions, "page string, since date, v int")
    got = asof.as_of(left, right, ["page"], "date", "since", days, few)
    assert sorted(map(tuple, got.select("page", "date", "n", "v").collect()), key=str) == in_force(facts, versions)


def test_as_of_empty(spark):
    facts, versions = spark.createDataFrame([("a", DAY, 1)], "page string, date date, n int"), spark.createDataFrame([], "page string, since date, v int")
    assert asof.as_of(facts, versions, ["page"], "date", "since").collect()[0].v is None
    assert asof.as_of(facts.limit(0), versions, ["page"], "date", "since").count() == 0


def test_version_history(spark):
    crawls = spark.createDataFrame([("a", 1, "x"), ("a", 2, "x"), ("a", 3, None), ("a", 4, None), ("a", 5, "x"), ("b", 1, None)], "page string, at int, hash string")
    rows = asof.validity(asof.version_history(crawls, ["page"], "at", "hash"), ["page"], "at").orderBy("page", "at")
    assert [tuple(r) for r in rows.select("page", "version_no", "hash", "valid_from", "valid_to").collect()] == [("a", 1, "x", 1, 3), ("a", 2, None, 3, 5), ("a", 3, "x", 5, None), ("b", 1, None, 1, None)]


def test_quantiles_keep_their_error(spark):
    draw = random.Random(2)
    rows = [(draw.choice("ab"), k % 5, draw.choice([0.0, draw.lognormvariate(3, 2), 1e-9, 7.0])) for k in range(4000)]
    days = sketches.histogram(spark.createDataFrame(rows, "p string, d int, x double"), ["p", "d"], "x")
    again = sketches.merged_histogram(days, ["p"]).unionByName(days.where("d < 0").drop("d"))
    at = [0.0, 0.1, 0.5, 0.9, 0.999, 1.0]
    for r in sketches.quantiles(again, ["p"], at).collect():
        values = sorted(x for p, _, x in rows if p == r.p)
        exact = values[max(1, math.ceil(round(r.q * len(values), 6))) - 1]
        assert abs(r.value - exact) <= sketches.ERROR * exact * (1 + 1e-6), (r, exact)
    assert again.count() < 1500


def test_distinct_counts(spark):
    rows = spark.range(60_000).select((F.col("id") % 3).alias("p"), (F.col("id") % 7).alias("d"), (F.col("id") % 20_000).cast("string").alias("x"))
    rows = rows.unionByName(spark.createDataFrame([(9, 1, "a"), (9, 2, "a"), (9, 2, "b")], "p long, d long, x string"))
    days = sketches.smallest(rows.select("p", "d", sketches.hashed("x").alias("hash")), ["p", "d"], 256)
    assert days.groupBy("p", "d").count().agg(F.max("count")).first()[0] == 256
    found = {r.p: r.estimate for r in sketches.distinct_counts(days, ["p"], 256).collect()}
    assert found[9] == 2
    for p in range(3):
        exact = rows.where(F.col("p") == p).select("x").distinct().count()
        assert abs(found[p] - exact) <= 4 * exact / math.sqrt(254)
    # merging is exact: sketches of days give what a sketch of all rows gives
    whole = sketches.distinct_counts(rows.select("p", sketches.hashed("x").alias("hash")), ["p"], 256)
    assert {r.p: r.estimate for r in whole.collect()} == found


def chains(pairs):
    to = {}
    for a, b in sorted((p for p in pairs if None not in p), reverse=True):
        to[a] = b
    out = []
    for a in to:
        x, n = a, 0
        while x in to and n <= len(to):
            x, n = to[x], n + 1
        out.append((a, x if x not in to else None, n if x not in to else None, x in to))
    return sorted(out, key=str)


def test_chain_ends(spark, monkeypatch):
    monkeypatch.setattr(skew, "MOST_KEYS", 100)
    pairs = [(f"c{k}", f"c{k + 1}") for k in range(37)] + [("x", "y"), ("y", "z"), ("z", "x"), ("in", "x"), ("in2", "in"), ("self", "self"), ("c3", "zzz"), (None, "c1"), ("q", None)]
    pairs += [(f"many{k}", "home") for k in range(60)] + [("home", "c30")]
    got = redirects.chain_ends(spark.createDataFrame(pairs, "url string, to string"), few=5)
    assert sorted(map(tuple, got.select("url", "final", "hops", "looped").collect()), key=str) == chains(pairs)
    assert redirects.chain_ends(spark.createDataFrame([], "url string, to string")).count() == 0
    assert [tuple(r) for r in redirects.chain_ends(spark.createDataFrame([("a", "a")], "url string, to string")).collect()] == [("a", None, None, True)]


def test_followed(spark):
    results = spark.createDataFrame([("https://S.com/a/", 1), ("https://s.com/other", 2), ("https://s.com/l1", 3)], "url string, n int")
    hops = spark.createDataFrame([("https://s.com/a", "https://s.com/b?utm_source=x"), ("https://s.com/b", "https://s.com/c"), ("https://s.com/l1", "https://s.com/l2"), ("https://s.com/l2", "https://s.com/l1")], "url string, to string")
    assert sorted((r.n, r.final_url) for r in redirects.followed(results, hops).collect()) == [(1, "https://s.com/c"), (2, "https://s.com/other"), (3, None)]


FACTS = "org_id string, project_id string, property_id string, date date, page string, query string, clicks long, impressions long, ctr double, position double"


def fact(d, page, query, clicks, impressions, position=1.0, prop="p"):
    return ("o", "j", prop, day(d), page, query, clicks, impressions, 0.0, position)


def test_levels_keep_grains_apart(spark):
    facts = spark.createDataFrame([fact(0, "a", "", 5, 50, 2.0), fact(1, "a", "", 1, 10, 8.0), fact(0, "a", "q", 1, 20), fact(0, "b", "q", 2, 30), fact(0, "b", "r", 0, 0)], FACTS)
    rows = {(r.grain, r.level, r.page, r.query): (r.clicks, r.impressions, r.position) for r in performance.levels(facts).collect()}
    assert rows["page", 0, None, None] == (6, 60, 3.0) and rows["query", 2, None, None] == (3, 50, 1.0)
    assert rows["query", 4, None, "q"] == (3, 50, 1.0) and rows["query", 5, "b", "r"] == (0, 0, None)
    assert not any(g == "page" and level > 3 for g, level, _, _ in rows)


def test_trend_breaks_count_missing_days(spark):
    days = [*range(0, 10), *range(20, 40)]  # none for ten days
    got = performance.trend_breaks(spark.createDataFrame([fact(d, "a", "", 0, 10) for d in days], FACTS)).collect()
    value = lambda a, b: sum(10 for d in range(a, b) if d in days)
    want = [(day(d), value(d - 7, d), value(d, d + 7)) for d in range(7, 34) if abs(value(d - 7, d) - value(d, d + 7)) * 2 >= max(value(d - 7, d), value(d, d + 7), 5)]
    assert sorted((r.date, r.before, r.after) for r in got) == want


def test_looked_up(spark):
    rows = spark.createDataFrame([("h", k) for k in range(50)] + [("x", 1), (None, 2)], "key string, n int")
    side = spark.createDataFrame([("h", "hot"), ("y", "none")], "key string, what string")
    got = skew.looked_up(rows, side, ["key"], few=4)
    assert sorted(map(tuple, got.select("key", "n", "what").collect()), key=str) == sorted([("h", k, "hot") for k in range(50)] + [("x", 1, None), (None, 2, None)], key=str)
