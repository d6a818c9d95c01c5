"""Operators on small inputs with known results."""

import datetime as dt
import gzip
import math

import pytest
from pyspark.sql import functions as F

from tidemark.config import DetectionConfig, OverlapConfig
from tidemark.functions import extract, terms, urls, wording
from tidemark.functions.numeric import expected_ctr, half_up
from tidemark.operators import detect, lifecycle, measure, overlap
from tidemark.operators.performance import query_lists
from tidemark.sources import discovery, sinks, tables


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values())], list(values)) if values else spark.range(1)
    return row.select(column.alias("x")).first().x


@pytest.mark.parametrize(
    "raw, want",
    [
        ("https://Example.com/Blog/Post/", "https://example.com/Blog/Post"),
        ("https://example.com", "https://example.com/"),
        ("https://example.com:443/a#section", "https://example.com/a"),
        ("https://example.com/a?utm_source=x&b=2&a=1&gclid=z", "https://example.com/a?a=1&b=2"),
        ("https://example.com//a//b/", "https://example.com/a/b"),
        ("https://example.com/?page=2&ref=x", "https://example.com/?page=2"),
        ("javascript:alert(1)", None),
        ("not a url", None),
    ],
)
def test_canonical(spark, raw, want):
    assert one(spark, urls.canonical(F.col("u")), u=raw) == want


def test_numbers(spark):
    assert one(spark, half_up(F.lit(-2.5))) == -2.0
    assert one(spark, half_up(F.lit(0.285), 2)) == 0.28
    for position, want in ((0.5, 0.28), (1.0, 0.28), (7.5, 0.036), (200.0, 0.002)):
        assert one(spark, expected_ctr(F.lit(position))) == pytest.approx(want)


def test_variants_merge(spark):
    rows = [("https://s.com/blog/post-a/", "", 10, 1000, 8.0), ("https://s.com/blog/post-a?utm_source=x", "", 2, 200, 2.0), ("https://s.com/blog/post-b", "", 5, 100, 3.0), ("nope", "", 5, 100, 3.0)]
    got = {r.page: r for r in tables.merged_variants(spark.createDataFrame(rows, "page string, query string, clicks long, impressions long, position double")).collect()}
    assert set(got) == {"https://s.com/blog/post-a", "https://s.com/blog/post-b"}
    a = got["https://s.com/blog/post-a"]
    assert (a.clicks, a.impressions, a.position) == (12, 1200, 7.0)


def test_coverage_terms():
    assert terms.lacking(terms.tokens("optimizing react performance"), "React performance optimization") == []
    assert terms.lacking(terms.tokens("react server components"), "React guide") == ["server", "components"]
    assert [terms.stem(x) for x in ("guides", "rankings", "queries", "boxes", "stations")] == ["guide", "rank", "query", "box", "st"]


PAGES = [  # page, current and previous (clicks, impressions, position), queries, structure
    ("A", (300, 30000, 7.2), (310, 29000, 7.0), [("react guide", 120, 12000, 6.5), ("react hooks tutorial", 80, 8000, 7.4), ("react state management", 40, 4000, 8.1)], ("The Complete React Guide", "React Guide", ["React hooks tutorial", "State management in React", "Testing"])),
    ("B", (5, 50, 40.0), (4, 45, 42.0), [("tiny note", 5, 50, 40.0)], ("A tiny note", "A tiny note", [])),
    ("C", (1000, 42000, 5.2), (2000, 40000, 5.0), [("node api tutorial", 500, 20000, 4.8), ("express rest api", 300, 12000, 5.5)], ("Building a Node API", "Node API tutorial", ["Express REST API basics", "Authentication"])),
    ("D", (300, 3000, 3.5), (290, 2900, 3.6), [("kubernetes deployment tutorial", 120, 1500, 3.8), ("docker compose", 90, 600, 3.1)], ("Docker Guide", "Docker Guide", ["Installing Docker", "Docker Compose basics"])),
]


@pytest.fixture(scope="module")
def found(spark):
    cfg = DetectionConfig()
    day = dt.date(2026, 9, 8)
    pages, queries = [], []
    for k, (name, cur, prev, qs, (title, h1, heads)) in enumerate(PAGES):
        ctr = [c / i for c, i, _ in (cur, prev)]
        pages.append(("o", "p", "s", name, k, title, h1, heads, day - dt.timedelta(28), day - dt.timedelta(1), day, day + dt.timedelta(27), *cur, *prev, *ctr))
        queries += [("o", "p", "s", name, q, c, i, c / i, p, len(qs), n + 1) for n, (q, c, i, p) in enumerate(qs)]
    rows = spark.createDataFrame(pages, "org_id string, project_id string, property_id string, url string, page_id long, title string, h1 string, headings array<string>, prev_start date, prev_end date, cur_start date, cur_end date, c_clicks long, c_impressions long, c_position double, p_clicks long, p_impressions long, p_position double, c_ctr double, p_ctr double")
    rows = rows.where((F.col("c_impressions") >= cfg.min_impressions) | (F.col("p_impressions") >= cfg.min_impressions))
    ranked = spark.createDataFrame(queries, "org_id string, project_id string, property_id string, page string, query string, clicks long, impressions long, ctr double, position double, query_count long, rn int")
    assert query_lists(ranked).count() == 4
    return {(r.url, r.type): r for r in detect.opportunities(rows, ranked, cfg).collect()}


def test_detected_types(found):
    types = {p: {t for q, t in found if q == p} for p in "ABCD"}
    assert types["A"] == {"LOW_CTR", "PAGE_ONE_NEAR_TOP", "HIGH_IMPRESSIONS_LOW_CLICKS"}
    assert types["B"] == set()
    assert "PERFORMANCE_DECLINE" in types["C"]
    assert types["D"] == {"CONTENT_COVERAGE_SIGNAL"}


def test_scores(found):
    want = {("A", "LOW_CTR"): 74.0, ("A", "PAGE_ONE_NEAR_TOP"): 76.8, ("A", "HIGH_IMPRESSIONS_LOW_CLICKS"): 74.9, ("C", "LOW_CTR"): 79.6, ("C", "PAGE_ONE_NEAR_TOP"): 86.9, ("C", "PERFORMANCE_DECLINE"): 84.6, ("D", "CONTENT_COVERAGE_SIGNAL"): 55.4}
    assert {k: r.score for k, r in found.items()} == want


def test_evidence(found):
    a = found["A", "HIGH_IMPRESSIONS_LOW_CLICKS"].evidence
    assert [(e.type, e.primary) for e in a][:2] == [("HIGH_IMPRESSIONS", True), ("LOW_CTR", True)]
    assert sum(e.type == "LOW_CTR" for e in a) == 1  # the relative one is the same type, metric and query
    assert a[0].text == "The page received 30,000 impressions between 2026-09-08 and 2026-10-05 (threshold: 5,000)."
    d = found["D", "CONTENT_COVERAGE_SIGNAL"]
    assert d.coverage_gaps[0].missing_terms == ["kubernetes", "deployment", "tutorial"]


HTML = """<!doctype html><html lang="en"><head><title>  A   page </title><meta name="robots" content="noindex"><link rel="canonical" href="/x#y">
<script type="application/ld+json">{"@graph": [{"@type": "Article"}, {"@type": ["FAQPage"]}]}</script><script type="application/ld+json">{bad</script></head>
<body><header><a href="/home">Home</a></header><div class="cookie-banner">accept all our cookies now</div><article><h1>Top</h1><p>One two<p>three four <b>five
<h2>List</h2><ul><li>a<li>b</ul><table><tr><td>1<td>2</table><img src="/i.png"><img src="d.png" alt=""><div>some loose text</div></article><footer>end of the page</footer></body></html>"""


def test_extract():
    p = extract.extract(HTML, "https://example.com/blog/post")
    assert (p["title"], p["h1"], p["language"], p["noindex"], p["container"]) == ("A page", "Top", "en", True, "article")
    assert p["canonical_url"] == "https://example.com/x"
    assert [j["types"] for j in p["json_ld"]] == [["Article", "FAQPage"]] and p["invalid_json_ld"] == 1
    assert [s["key"] for s in p["sections"]] == ["s0-top", "s1-list"]
    assert [b["type"] for b in p["sections"][1]["blocks"]] == ["ul", "table", "img", "img", "p"]
    assert [i["alt"] for i in p["images"]] == [None, ""]
    assert p["links"] == [{"target": "https://example.com/home", "anchor": "Home", "internal": True, "in_content": False, "rel": [], "nofollow": False}]
    assert "cookies" not in p["body_text"] and "end of" not in p["body_text"]
    assert extract.extract(HTML.replace("<body>", "<body data-x='1'><script>1</script>"), "https://example.com/blog/post")["content_hash"] == p["content_hash"]
    assert extract.extract(HTML.replace("loose", "tight"), "https://example.com/blog/post")["content_hash"] != p["content_hash"]
    assert extract.extract(None, "")["word_count"] == 0


DOC = "doc_id string, page_id string, url string, website_id string, field string, section_key string, text string"
CHECK = "check_id string, page_id string, website_id string, field string, section_key string, text string"
SENTENCE = "the quick brown fox jumps over the lazy dog while seven wizards brew strong tea"


def page(k, text, field="SECTION_TEXT", key=None):
    return (f"{k}:{field}", str(k), f"u{k}", "w", field, key, text)


def assess(spark, checks, docs):
    found = overlap.assessed(spark.createDataFrame(checks, CHECK), spark.createDataFrame(docs, DOC), OverlapConfig())
    return {r.check_id: r for r in found.collect()}


def test_overlap(spark):
    fillers = [page(f"f{k}", f"unrelated page number {k} about ladders and nets") for k in range(8)]
    docs = [page(1, f"Intro here. {SENTENCE}. And more."), page(2, "Exactly this title", "TITLE"), page(3, "own words of this page that nobody else on the whole site has", "H1"), *fillers]
    checks = [
        ("copy", "9", SENTENCE.upper()), ("edit", "9", SENTENCE.replace("lazy", "sleepy")), ("quoted", "9", f'As they put it, "{SENTENCE}"'), ("cited", "9", f"According to the wizards, {SENTENCE}"), ("same", "1", SENTENCE), ("title", "9", "exactly - THIS title!"),
        ("none", "9", "nothing of the kind is said on any page here"), ("empty", "9", " ... "), ("short", "9", "a brown fox jumps over the lazy dog or two of them at the end of a rather long text with other words in it"), ("replaced", "3", "own words of this page that nobody else on the whole site has"),
    ]
    got = assess(spark, [(c, p, "w", "H1", None, t) for c, p, t in checks], docs)
    first = {k: (r.matches[0].kind, r.matches[0].severity) if r.matches else None for k, r in got.items()}
    assert first == {"copy": ("EXACT", "SIGNIFICANT"), "edit": ("NEAR_VERBATIM", "SIGNIFICANT"), "quoted": ("EXACT", "MINOR"), "cited": ("EXACT", "MINOR"), "same": ("EXACT", "INFO"), "title": ("DUPLICATE_FIELD", "SIGNIFICANT"), "none": None, "empty": None, "short": ("EXACT", "MINOR"), "replaced": None}
    assert {k: r.assessment for k, r in got.items() if not r.matches} == dict.fromkeys(("none", "empty", "replaced"), "NO_MATCHES")
    assert got["copy"].overlap_ratio == 1.0 and got["same"].overlap_ratio == 0.0 and got["empty"].overlap_ratio == 0.0
    assert got["same"].assessment == "INFORMATIONAL_MATCHES" and got["quoted"].assessment == "MINOR_MATCHES"
    m = got["quoted"].matches[0]
    assert m.attributed and m.passage == SENTENCE and m.longest_run == 15


def test_overlap_over_pages(spark):
    """Common phrases don't count; one passage on several pages is one match that names the others; runs keep their order."""
    common = "ask our friendly team for a quote today"
    docs = [page(k, f"page {k} says. {common}.") for k in range(6)] + [page(f"x{k}", f"{k} more. {SENTENCE}.") for k in range(2)] + [page(f"f{k}", f"number {k} of other things") for k in range(12)]
    swapped = " ".join([*SENTENCE.split()[8:], *SENTENCE.split()[:8]])
    got = assess(spark, [("common", "9", "w", "H1", None, f"New words. {common}."), ("twice", "9", "w", "H1", None, SENTENCE), ("swapped", "9", "w", "H1", None, swapped)], docs)
    assert got["common"].assessment == "NO_MATCHES"
    assert len(got["twice"].matches) == 1 and got["twice"].matches[0].also_found_in == ["ux1#SECTION_TEXT"]
    assert [(m.kind, m.d_start, m.d_end) for m in got["swapped"].matches] == [("EXACT", 0, 7), ("EXACT", 7, 15)]


def test_overlap_commonness_leaves_the_replaced_field_out(spark):
    """An n-gram is common from max(3, 30 % of pages) on, counted without a page that has only the replaced field."""
    fields = [page(k, f"{k} x {SENTENCE}") for k in range(3)] + [page(k, f"page {k} alone has these words", "TITLE") for k in range(3, 10)] + [page("own", SENTENCE, "H1")]
    limits = {r.check_id: r.most for r in overlap.common_limits(spark.createDataFrame([("a", "own", "w", "H1", None, SENTENCE), ("b", "zz", "w", "H1", None, SENTENCE)], CHECK), spark.createDataFrame(fields, DOC), OverlapConfig())[0].collect()}
    assert limits == {"a": 3, "b": 4}


def test_passages_are_cut_from_the_text_as_written(spark):
    """Places count in the folded text, where a ligature is two letters; passages come from the text as it is."""
    got = assess(spark, [("c", "9", "w", "H1", None, f"\ufb01rst. {SENTENCE} end")], [page(1, f"so {SENTENCE} now")])
    m = got["c"].matches[0]
    assert (m.start, m.passage) == (7, f"\ufb01rst. {SENTENCE} end"[m.start : m.end])


def test_facts_of_texts(spark):
    fold = wording.folded(F.col("t"))
    assert one(spark, wording.numbers_of(fold), t="From 1,200 units in 7.5 days, 24 and 24 hours") == ["1200", "7.5", "24"]
    assert one(spark, wording.names_of(fold), t="We use Ravenna. The K-beam is here, from AB Iron: Not this; but Ravenna") == ["ravenna", "k-beam", "ab", "iron"]
    assert one(spark, wording.word_distance(F.split("a", " "), F.split("b", " ")), a="a b c", b="a x c d") == 2
    assert one(spark, wording.words_of(fold), t="Don’t re-use \ufb01ne O'Neil's") == ["don't", "re-use", "fine", "o'neil's"]


@pytest.mark.parametrize("text, want", [("This is guaranteed to work", True), ("Results are not guaranteed", False), ("There's no guarantee", False), ("cannot be a guaranteed result, we guarantee", True), ("It will boost sales", True), ("It may improve sales", False), ("certainly is", True), ("", False)])
def test_forbidden(spark, text, want):
    assert one(spark, wording.forbidden(F.col("t")), t=text) == want


ORIGINAL = "Rent a lifting frame by the week or month. Delivery depends on the quantity and on where you are. We lend only K-beam and Ravenna frames, and delivery to Lyon may take 2 days. Fees are not fixed; they may change with distance and crew."
REWRITE = "Lifting frames can be rented weekly or monthly. Delivery depends on the quantity and your location. We lend only K-beam and Ravenna frames; delivery to Lyon may take 2 days. Fees are not fixed and may change with distance and crew."


@pytest.mark.parametrize(
    "draft, want",
    [
        (REWRITE, None), (f"{REWRITE} Fees start at 500 a day.", "adds numbers not in the section: 500"), (REWRITE.replace("to Lyon", "to Lyon and Nantes"), "adds names not on the page: nantes"), (REWRITE.replace("2 days", "two days"), "drops or changes material numbers: 2"),
        (REWRITE.replace(" and Ravenna", ""), "drops material names: ravenna"), (REWRITE.replace("Fees are not fixed and may change", "Fees change"), 'negation caveat from the original (e.g. "not")'), (REWRITE.replace("depends on", "covers"), "condition caveat"), (REWRITE.replace("lend only", "lend"), "limitation caveat"),
        (REWRITE.replace("may ", "will "), "hedge caveat"), (f"{REWRITE}\n\n{REWRITE}", "expands the original too much"), ("Frames for rent.", "minimum is 15"), ("Every shift begins with a check of ropes and hooks by someone trained for it, and rain makes platforms slippery, so look again after storms.", "keeps too few"),
        (f"<p>{REWRITE}</p>", "plain text"), (f"**{REWRITE}**", "plain text"), ("   ", "draft is empty"),
    ],
)
def test_body_checks(spark, draft, want):
    rows = spark.createDataFrame([(ORIGINAL, draft, "The page also names Paris.")], "o string, d string, p string")
    rows = rows.withColumn("r", wording.rewrite(F.col("o"), F.col("d"), F.col("p"))).withColumn("m", wording.body_metrics(F.col("r")))
    got = rows.select(wording.body_issues(F.col("r"), F.col("m")).alias("x"), "m").first()
    assert got.x == [] if want is None else any(want in x for x in got.x), got.x
    if want is None:
        assert got.m.fact_preservation == 1 and got.m.paragraphs == 1 and got.m.change_ratio < 0.6


def test_caveats_are_words_of_ascii(spark):
    """As in SQL and in the reference: a letter with an accent is no part of a word, so that it doesn't hide one before it."""
    rows = spark.createDataFrame([(f"No\u00f6 {ORIGINAL.replace('not ', '')}", ORIGINAL.replace("not ", ""))], "o string, d string")
    rows = rows.withColumn("r", wording.rewrite(F.col("o"), F.col("d"), F.col("o"))).withColumn("m", wording.body_metrics(F.col("r")))
    assert any('negation caveat from the original (e.g. "No")' in x for x in rows.select(wording.body_issues(F.col("r"), F.col("m")).alias("x")).first().x)


def test_percent_texts_are_scaled_once(spark):
    """0.0905 stands for 9.1 %, though 0.0905 * 100 is a little less than 9.05."""
    from tidemark.operators import detect

    values = [x / 10_000 for x in range(10_000)]
    rows = spark.createDataFrame([(x,) for x in values], "x double").select("x", detect.percent_text(F.col("x")).alias("t"), detect.as_percent(F.col("x") / 3).alias("p")).collect()
    assert all(r.t == f"{math.floor(r.x * 1000 + 0.5) / 10:.1f}%" and r.p == math.floor(r.x / 3 * 10_000 + 0.5) / 100 for r in rows)


def test_unsupported_claims(spark):
    page_text, queries = "A fern guide.\n Daily rates start at 500 for accurate notes", "ferns in Porto"
    issues = lambda d, p=page_text: one(spark, wording.unsupported(F.col("d"), F.col("p"), F.lit(queries)), d=d, p=p)
    assert issues("Fern guide with daily rates from 500") == [] and issues("A guide for readers in Porto") == []
    assert issues("Fern guide with 50 notes") == ['number "50" does not appear on the page']
    assert issues("Certified fern guide for ₹9") == ['number "9" does not appear on the page', 'claim "Certified" is not supported by the page content', 'claim "₹" is not supported by the page content']
    assert issues("A fern guide from Nantes") == ['name "Nantes" does not appear on the page or in its queries']
    rows = spark.createDataFrame([("x", None)], "d string, p string")
    assert rows.select(wording.unsupported(F.col("d"), F.col("p"), F.lit("")).alias("x")).first().x == ["no crawled page content to ground the draft in"]


def test_rollups_against_a_walk_over_rows(spark):
    """Totals of any rows are those of the row-level reference."""
    from hypothesis import given, settings
    from hypothesis import strategies as st

    from tidemark.operators import performance

    row = st.tuples(st.integers(0, 50), st.integers(0, 1000), st.integers(1, 100).map(float))

    @settings(max_examples=8, deadline=None)
    @given(st.lists(row, max_size=12))
    def check(rows):
        facts = spark.createDataFrame([(*r, "") for r in rows], "clicks long, impressions long, position double, query string")
        rolled = performance.totals(facts).first()
        walked = facts.agg(F.collect_list(F.struct("clicks", "impressions", "position")).alias("r")).select(performance.walked(F.col("r")).alias("t")).select("t.*").first()
        assert tuple(rolled) == tuple(walked)

    check()


def test_lifecycle_is_idempotent(spark, small):
    from tidemark.plans import lifecycle as plan

    once = plan.after_run(spark, small)
    again = lifecycle.upsert_detected(once.drop("action"), plan.detections(spark, small), "run-1", plan.NOW)
    assert again.where("action = 'created'").count() == 0
    key = ["page_id", "type", "status", "score"]
    assert sorted(map(tuple, once.select(*key).collect())) == sorted(map(tuple, again.select(*key).collect()))


def test_baseline(spark):
    rows = [("s", "a", "2026-10-01", "", 10, 1000, 5.0), ("s", "a", "2026-10-10", "", 30, 1000, 7.0), ("s", "a", "2026-10-10", "q", 5, 400, 6.0), ("s", "b", "2026-10-02", "", 1, 10, 1.0), ("s", "a", "2026-08-01", "", 500, 5000, 2.0)]
    facts = spark.createDataFrame(rows, "property_id string, page string, date string, query string, clicks long, impressions long, position double").withColumn("date", F.to_date("date"))
    asked = spark.createDataFrame([("s", "a", "2026-10-10", "2026-10-20"), ("s", "z", "2026-10-10", "2026-10-20"), ("t", "a", None, "2026-10-20")], "property_id string, page string, last_synced string, as_of string").withColumns({c: F.to_date(c) for c in ("last_synced", "as_of")})
    got = {(r.property_id, r.page): r for r in measure.baselines(facts, asked).collect()}
    a = got["s", "a"]
    assert (a.clicks, a.impressions, a.ctr, a.position, a.days_with_data, a.data_complete) == (40, 2000, 0.02, 6.0, 2, True)
    assert (a.window_start, a.window_end) == (dt.date(2026, 9, 13), dt.date(2026, 10, 10))
    z = got["s", "z"]
    assert (z.clicks, z.position, z.days_with_data) == (0, None, 0)
    assert got["t", "a"].limitation == "GSC_NOT_SYNCED"


def test_discovery(spark):
    index = b"<?xml version='1.0'?><sitemapindex><sitemap><loc>https://s.com/a.xml</loc></sitemap></sitemapindex>"
    urlset = b"<urlset><url><loc>https://s.com/p</loc><lastmod>2026-01-01</lastmod></url><url><loc></loc></url></urlset>"
    assert discovery.parse_sitemap(b"https://s.com/1\nx")["kind"] == "text" and discovery.parse_sitemap(b"junk")["kind"] == "unknown"
    index = index.replace(b"</sitemapindex>", b"".join(b"<sitemap><loc>https://%s</loc></sitemap>" % x for x in (b"s.com/a.xml", b"www.s.com/b.txt", b"s.com/gone.xml", b"s.com/junk.xml", b"other.com/c.xml", b"s.com/i.xml")) + b"</sitemapindex>")
    files = [("https://s.com/i.xml", 200, index), ("https://s.com/a.xml", 200, gzip.compress(urlset)), ("https://www.s.com/b.txt", 200, b"https://s.com/q\nhttps://s.com/p"), ("https://s.com/gone.xml", 404, b""), ("https://s.com/junk.xml", 200, b"<html/>"), ("https://other.com/c.xml", 200, urlset)]
    files = spark.createDataFrame([(u, c, bytearray(b), "") for u, c, b in files], "url string, status int, body binary, content_type string")
    start = spark.createDataFrame([("https://s.com/i.xml",)], "url string")
    got = discovery.discover(start, files, "s.com")
    assert [(r.url, r.lastmod, r.file) for r in got.entries.collect()] == [("https://s.com/p", "2026-01-01", "https://s.com/a.xml"), ("https://s.com/q", None, "https://www.s.com/b.txt"), ("https://s.com/p", None, "https://www.s.com/b.txt")]
    assert {(r.url[-8:], r.error) for r in got.files.where("error is not null").collect()} == {("gone.xml", "HTTP 404"), ("junk.xml", "Not a sitemap")} and got.files.count() == 5 and not got.truncated
    few = discovery.discover(start, files, "s.com", most_files=2)
    assert few.truncated and few.entries.count() == 1 and few.files.count() == 2
    assert discovery.discover(start, files, "s.com", most_urls=2).truncated
    whole = discovery.discover(start, files, "s.com", most_urls=None)
    assert not whole.truncated and whole.entries.count() == 3
    robots = discovery.parse_robots("User-agent: *\nDisallow: /\n\nUser-agent: mybot\nDisallow: /private\nAllow: /private/ok$\nCrawl-delay: 99\nSitemap: https://s.com/i.xml", "MyBot/1.0")
    assert [robots.allows(p) for p in ("/", "/private/x", "/private/ok", "/private/ok2")] == [True, False, True, False]
    assert robots.delay == 10.0 and robots.sitemaps == ("https://s.com/i.xml",)
    paths = spark.createDataFrame([("https://s.com/private/x",), ("https://s.com/private/ok",), ("https://s.com",)], "url string")
    assert discovery.allowed(paths, robots).count() == 2
    assert not discovery.parse_robots("", "b", 503).allows("/") and discovery.parse_robots("", "b", 404).allows("/")


def test_day_replace(spark, tmp_path):
    path = str(tmp_path / "facts")
    kind = "property_id string, date string, page string, query string, clicks long"
    sinks.replace_days(spark.createDataFrame([("s", "2026-01-01", "a", "", 1), ("s", "2026-01-02", "a", "", 2)], kind), path)
    sinks.replace_days(spark.createDataFrame([("s", "2026-01-01", "a", "", 5)], kind), path, spark.createDataFrame([("s", "2026-01-01"), ("s", "2026-01-02")], "property_id string, date string"))
    assert [(str(r.date), r.clicks) for r in spark.read.parquet(path).collect()] == [("2026-01-01", 5)]
    before = None
    for n in (3, 5, 7):
        sinks.swap_snapshot(spark.range(n), str(tmp_path / "snap"))
        assert sinks.snapshot(spark, str(tmp_path / "snap")).count() == n
        assert before is None or before.count() == n - 2  # who reads the version before still can
        before = sinks.snapshot(spark, str(tmp_path / "snap"))
    assert sorted(x.name for x in (tmp_path / "snap").iterdir() if not x.name.startswith(".")) == ["_current-000000002", "_current-000000003", "v=000000002", "v=000000003"]
    sinks.append_log(spark, str(tmp_path / "log"), spark.range(3).select("id", F.col("id").alias("at")))
    sinks.append_log(spark, str(tmp_path / "log"), spark.range(3, 5).select("id", F.col("id").alias("at")))
    assert [r.id for r in sinks.newest(spark.read.parquet(str(tmp_path / "log")), 2).collect()] == [4, 3]


def test_values_of_a_row_are_computed_once(spark):
    """Not for each item of a lambda: the known words of two texts, and a page's folded text."""
    rows = spark.createDataFrame([(["a", "b", "c"], ["a", "c"], "9 and 10, 9", "10")], "a array<string>, b array<string>, t string, p string")
    found = rows.select(wording.word_distance(F.col("a"), F.col("b")).alias("d"), wording.unsupported(F.col("t"), F.col("p"), F.lit("")).alias("u"))
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("concat(a#") == 1 and plan.count("lower(") <= 6
    assert found.first() == (1, ['number "9" does not appear on the page'])


def test_pages_in_parts(spark):
    """More pages than are held at once, in order, with maps and lists, equal those read one by one."""
    html = [f"<html><head><title>T{k}</title><meta property='og:type' content='x{k}'></head><body><h1>H{k}</h1><a href='/b'>b</a></body></html>" for k in range(150)]
    rows = spark.createDataFrame([(k, "https://s.com/a", h) for k, h in enumerate(html)], "page_id int, url string, html string").coalesce(1)
    got = {r.page_id: r.p for r in rows.select("page_id", extract.page_struct(F.col("html"), F.col("url"), "title", "og", "links", "content_hash").alias("p")).collect()}
    for k in (0, 63, 64, 149):
        want = extract.extract(html[k], "https://s.com/a")
        assert (got[k].title, got[k].og, got[k].content_hash, got[k].links[0].target) == (f"T{k}", {"type": f"x{k}"}, want["content_hash"], "https://s.com/b")


def test_all_that_a_page_brings(spark, tmp_path):
    """Each of many links with its whole text, through the query and its SQL, and each image and block of structured data."""
    import duckdb

    from tidemark.plans import registry

    links = "".join(f'<a href="/l{k}">text {k}</a>' for k in range(2600)) + "".join(f'<a href="/long">{"w" * 600}{k}</a>' for k in range(2))
    html = f"<html><body>{links}</body></html>"
    spark.createDataFrame([(1, "https://s.com/a", html)], "page_id long, url string, html string").coalesce(1).write.parquet(str(tmp_path / "pages.parquet"))
    got = {tuple(r) for r in registry.QUERIES["page_links"](spark, str(tmp_path)).collect()}
    con = duckdb.connect()
    con.sql(f"create view pages as select * from '{tmp_path}/pages.parquet/*.parquet'")
    assert len(got) == 2602 and got == set(con.sql(registry.ORACLES["page_links"]).fetchall())

    data = "".join(f'<script type="application/ld+json">{{"@type": "T{k}"}}</script>' for k in range(25)) + f'<script type="application/ld+json">{{"@type": "Long", "x": "{"y" * 250_000}"}}</script>'
    p = extract.extract(f"<html><head>{data}</head><body>{''.join(f'<img src=/i{k}.png>' for k in range(700))}</body></html>", "https://s.com/a")
    assert (len(p["images"]), len(p["json_ld"]), p["invalid_json_ld"]) == (700, 26, 0)


def test_a_link_ends_where_the_next_begins():
    """Links that are never closed don't hold all links after them: anchors together are no longer than the page."""
    p = extract.extract("<html><body>" + "".join(f"<a href='/{k}'>t{k} " for k in range(3000)) + "<a href='/i'><img src='i.png' alt='picture'></a><a href='/n' title='named'></a></body></html>", "https://s.com/a")
    assert [x["anchor"] for x in p["links"]] == [*(f"t{k}" for k in range(3000)), "picture", "named"]
