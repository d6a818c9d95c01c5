"""The paged source, model answers and drafts."""

from pyspark.sql import functions as F

from tidemark.operators import drafts
from tidemark.sources import paged as paged_source
from tidemark.sources.paged import PagedSearch


def fetch(arguments, day, dimensions, size, at):
    total = 7 if dimensions == ["page"] else 3
    return [{"keys": ["https://s.com/a", "q"][: len(dimensions)], "clicks": 1, "impressions": arguments["n"], "position": 2.0} for _ in range(at, min(total, at + size))]


def test_paged_source(spark):
    spark.dataSource.register(PagedSearch)
    rows = spark.read.format("paged_search").option("client", "tests.test_sources:fetch").option("start", "2026-01-01").option("end", "2026-01-02").option("rowsPerPage", "3").option("arguments", '{"n": 4}').load()
    got = {(str(r.date), r.query): (r.n, r.i) for r in rows.groupBy("date", "query").agg(F.count("*").alias("n"), F.sum("impressions").alias("i")).collect()}
    assert got == {(d, q): (n, 4 * n) for d in ("2026-01-01", "2026-01-02") for q, n in (("", 7), ("q", 3))}


def paged(spark):
    spark.dataSource.register(PagedSearch)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    return lambda start: start.option("client", "tests.test_sources:fetch").option("start", "2026-01-01").option("rowsPerPage", "3").option("arguments", '{"n": 4}')


def test_filters_choose_slices(spark):
    rows = paged(spark)(spark.read.format("paged_search")).option("end", "2026-12-31").option("filters", "true").load()
    two = rows.where("date >= '2026-02-03' and date < '2026-02-05'")
    assert two.rdd.getNumPartitions() == 4 and two.count() == 2 * 10
    assert rows.where("date = '2026-02-03' and query <> ''").rdd.getNumPartitions() == 1
    some = rows.where("date in ('2026-02-03', '2026-03-03', '2027-01-01') and query = ''")
    assert some.rdd.getNumPartitions() == 4 and some.count() == 14
    assert rows.where("date is null").count() == 0
    assert rows.where("date > '2026-12-30' and clicks = 1").count() == 10


def test_stream_of_days(spark, tmp_path):
    """Days that became final since the last run, each once."""
    for end, want in (("2026-01-02", 20), ("2026-01-02", 20), ("2026-01-05", 50)):
        stream = paged(spark)(spark.readStream.format("paged_search")).option("end", end).load()
        run = stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
        run.awaitTermination()
        out = spark.read.parquet(str(tmp_path / "out"))
        assert out.count() == want and out.select("date").distinct().count() == want // 10


def test_answers(spark):
    good = '```json\n{"summary": "s", "search_intent": [{"query": "A  b", "intent": "x"}, {"query": "zz", "intent": "y"}], "content_gaps": [], "recommendations": [{"type": "TITLE", "target_section": "s9"}]}\n```'
    rows = spark.createDataFrame([(good,), ("nonsense",), (None,)], "t string").withColumn("a", drafts.answer(F.col("t")))
    issues = drafts.ungrounded(F.col("a"), F.array(F.lit("a b")), F.array(F.lit("s0")))
    got = [r.x for r in rows.select(F.when(F.col("a").isNotNull(), issues).alias("x")).collect()]
    assert got == [["unknown query: zz", "unknown section: s9"], None, None]
    assert [r.x for r in spark.createDataFrame([("text/html; charset=x",), (None,), ("application/pdf",)], "c string").select(drafts.html_content(F.col("c")).alias("x")).collect()] == [True, True, False]


def test_drafts(spark):
    rows = [("TITLE", "A fine new page title", "Old", "a fine new page title here", ""), ("TITLE", "Cheap title with 5 stars", "Old", "a page", ""), (None, "x", None, None, ""), ("H1", None, None, None, "")]
    got = drafts.checked(spark.createDataFrame(rows, "target string, value string, current string, page_text string, queries string")).collect()
    assert [r.value for r in got] == ["A fine new page title", None, None, None]
    assert got[1].issues[0] == 'number "5" does not appear on the page' and got[3].issues == []
    sections = F.array(F.struct(F.lit("s0").alias("key"), F.lit(None).cast("string").alias("heading"), F.lit("text").alias("text")), F.struct(F.lit("s1").alias("key"), F.lit("Head").alias("heading"), F.lit("").alias("text")))
    kinds = [("HEADING", None), ("HEADING", "s1"), ("INTRODUCTION", "s0"), ("CLARIFICATION", "s0"), ("CLARIFICATION", "s1"), ("MISSING_TOPIC", "s0")]
    found = spark.createDataFrame(kinds, "k string, t string").select(drafts.draft_target(F.col("k"), F.col("t"), sections).alias("x")).collect()
    assert [r.x for r in found] == ["H1", "SECTION_HEADING", "INTRODUCTION", "SECTION_BODY", None, None]
    old = spark.createDataFrame([(1, "same  text")], "review_id int, value string")
    assert drafts.novel(spark.createDataFrame([(1, " same text"), (1, "other"), (2, "same text")], "review_id int, value string"), old).count() == 2


def test_a_slice_is_read_once_for_all_its_pages(tmp_path, monkeypatch):
    import pyarrow as pa
    import pyarrow.dataset as ds
    import pyarrow.parquet as pq

    folder = tmp_path / "dimensions=1" / "date=2024-01-01"
    folder.mkdir(parents=True)
    pq.write_table(pa.table({"page": [f"p{9 - k}" for k in range(10)], "clicks": [1] * 10, "impressions": [2] * 10, "position": [1.0] * 10}), folder / "x.parquet")
    read, times = ds.dataset, []
    monkeypatch.setattr(ds, "dataset", lambda *a, **k: times.append(1) or read(*a, **k))
    page = lambda at: [r["keys"][0] for r in paged_source.folder_client({"path": tmp_path.as_uri()}, "2024-01-01", ["page"], 4, at)]
    assert [page(at) for at in (0, 4, 8)] == [["p0", "p1", "p2", "p3"], ["p4", "p5", "p6", "p7"], ["p8", "p9"]] and len(times) == 1
    assert page(0)[0] == "p0" and len(times) == 2  # a first page reads anew
    assert paged_source.folder_client({"path": tmp_path.as_uri()}, "2024-01-02", ["page"], 4, 0) == []
