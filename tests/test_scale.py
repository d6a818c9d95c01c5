"""Steps that cost much are done once for what they are about, not once for each row that meets it."""

import random

import pyarrow as pa
from pyspark.sql import functions as F

from tidemark.functions import terms, urls
from tidemark.operators import asof, overlap
from tidemark.plans import history
from tidemark.sources import tables


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_canonical_takes_each_part_once(spark):
    """The parts of an address are named many times over, but matched once each (and the host and path as a whole)."""
    text = spark.range(1).select(F.col("id").cast("string").alias("u")).select(urls.canonical(F.col("u")).alias("c"))
    assert plan(text).count("(?is)^(https?)") == 5


def test_facts_make_addresses_canonical_once_a_page(spark, small):
    facts = tables.facts(spark, small)
    assert "regexp" not in plan(facts)
    merged = tables.merged_variants(tables.raw_rows(spark, small), "property_id", "date")
    cut = lambda df: sorted((r.property_id, str(r.date), r.page, r.query, r.clicks, r.impressions, round(r.position, 9)) for r in df.collect())
    assert cut(facts) == cut(merged)


def test_versions_make_addresses_canonical_once_a_page(spark, small):
    assert "regexp" not in plan(history.page_versions(spark, small))


def test_version_performance_takes_page_totals_alone(spark, small, monkeypatch):
    """Rows of queries don't go through the as-of join, as none of them counts."""
    taken = []
    as_of = asof.as_of
    monkeypatch.setattr(asof, "as_of", lambda facts, *a, **k: taken.append(facts) or as_of(facts, *a, **k))
    history.version_performance(spark, small)
    assert [f.where("query <> ''").count() for f in taken] == [0]


def test_words_by_places_are_those_of_texts():
    """Words as places in an array of code points are those that words_of() finds, and equal words alone have equal hashes."""
    draw, hashes = random.Random(3), {}
    signs = ["a", "B", "'", "’", "_", "1", " ", "\n", "É", "é", "ß", "Σ", "σ", "İ", "ﬁ", "²", "x’Y", "日本", "़", "٣", "O'Neil", "ΑΣ", "ǅ", "Ⅷ"]
    for _ in range(3000):
        text = "".join(draw.choice(signs) for _ in range(draw.randrange(14)))
        codes, start, end = overlap.word_places(text)
        words = [overlap.text_of(codes[a:b]) for a, b in zip(start, end, strict=True)]
        assert words == overlap.words_of(text)
        hashes |= zip(words, overlap.word_hashes(codes, start, end).tolist(), strict=True)
    assert len(set(hashes.values())) == len(hashes) > 1000


def test_documents_are_cut_once(spark, monkeypatch):
    """One pass of documents tells n-grams and wholes, and the bitmap rules out wholes as well."""
    told = []
    monkeypatch.setattr(overlap, "kept", lambda df: told.append(df) or df)
    kind = "page_id long, field string, section_key string, text string"
    text = "one two three four five six seven"
    checks = spark.createDataFrame([("c", 9, "H1", None, text)], f"check_id string, {kind}")
    docs = spark.createDataFrame([("a", 1, "H1", None, text.upper()), ("b", 2, "H1", None, "quite another text of some seven words"), ("d", 3, "H1", None, f"So {text}")], f"doc_id string, {kind}")
    _, asked = overlap.checked_and_asked(checks, docs, 6)
    assert plan(told[1]).count("MapInArrow") == 2  # checks and documents
    assert sorted((r.doc_id, r.at, r.words) for r in asked.collect()) == [("a", -1, 7), ("a", 0, 7), ("a", 1, 7), ("d", 1, 8), ("d", 2, 8)]
    cut = overlap.grams(docs, "doc_id", 6, overlap.bitmap_of(told[0]))
    assert {r.doc_id for r in cut.where("at < 0").collect()} == {"a"}


def test_gaps_hold_few_pages_at_once(monkeypatch):
    """A batch of pages becomes Python objects in parts, and a page's structure is cut once for all its queries."""
    cut = []
    told_by = terms.told_by
    monkeypatch.setattr(terms, "told_by", lambda x: cut.append(x) or told_by(x))
    monkeypatch.setattr(terms, "PAGES_AT_ONCE", 2)
    query = lambda text: {"query": text, "impressions": 9, "clicks": 1, "position": 2.0}
    queries = pa.array([[query("react hooks"), query("vue slots")], None, [], [query("vue slots")], [query("the")]])
    got = terms._gaps(queries, pa.array(["React hooks", "x", "y", None, "z"]), pa.array([0.5] * 5)).to_pylist()
    assert [[(g["query"], g["missing_terms"], g["ratio"]) for g in page] for page in got] == [[("vue slots", ["vue", "slots"], 0.0)], [], [], [], []]
    assert cut == ["React hooks", "z"]
