"""Extracted pages and their child tables, versions by content hash, crawl outcomes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import urls
from tidemark.functions.extract import page_struct
from tidemark.sources.tables import spread


def extracted(pages: DataFrame, *fields: str, min_words: int = 50) -> DataFrame:
    """page_id, url (canonical) and the given fields of the page's structure, or all of them, with the verdict in words.

    Wide rows: persist or write this once, then take child tables from it."""
    verdict = ("word_count", "app_shell")
    wanted = [*fields, *(f for f in verdict if f not in fields)] if fields else []
    rows = spread(pages.select("page_id", "url", "html")).select("page_id", "url", page_struct(F.col("html"), F.col("url"), *wanted).alias("p")).select("page_id", urls.canonical(F.col("url")).alias("url"), "p.*")
    enough = ~F.col("app_shell") & (F.col("word_count") >= min_words)
    reason = F.when(enough, None).when(F.col("app_shell"), "Page looks like a JavaScript application shell").otherwise(F.format_string("Only %d words of content found", "word_count"))
    return rows.withColumn("sufficient", enough).withColumn("reason", reason)


def child(rows: DataFrame, array: str, *keys: str) -> DataFrame:
    """A child table: one row per element, with its place, from the given rows only.

    Outer, then without the rows of empty arrays: a filter on the array itself would have pages extracted twice."""
    return rows.select(*keys, F.posexplode_outer(array).alias("at", "x")).where("at is not null").select(*keys, "at", "x.*")


def better(rendered: Column, fetched: Column) -> Column:
    """The rendered page if it has more words than the fetched one."""
    return F.when(rendered["word_count"] > fetched["word_count"], rendered).otherwise(fetched)


def page_status(http_status: Column, noindex: Column, redirected: Column) -> Column:
    return F.when(http_status.isin(404, 410), "GONE").when(redirected, "REDIRECTED").when((http_status < 200) | (http_status >= 300), "ERROR").when(noindex, "EXCLUDED").otherwise("ACTIVE")


def versioned(current: DataFrame, extracted_: DataFrame) -> DataFrame:
    """Next versions: current (page_id, version_no, content_hash) against new hashes; outcome CREATED, UPDATED, UNCHANGED or KEPT.

    A new version only where the hash differs; pages not seen again are KEPT. Writing the result anew is one snapshot swap."""
    old = current.select("page_id", F.col("version_no").alias("old_no"), F.col("content_hash").alias("old_hash"))
    rows = extracted_.select("page_id", "content_hash").join(old, "page_id", "full_outer")
    outcome = F.when(F.col("content_hash").isNull(), "KEPT").when(F.col("old_no").isNull(), "CREATED").when(F.col("content_hash") == F.col("old_hash"), "UNCHANGED").otherwise("UPDATED")
    number = F.coalesce("old_no", F.lit(0)) + F.when(outcome.isin("CREATED", "UPDATED"), 1).otherwise(0)
    return rows.select("page_id", outcome.alias("outcome"), number.cast("int").alias("version_no"), F.coalesce("content_hash", "old_hash").alias("content_hash"))


def status_update(pages: DataFrame, seen: DataFrame) -> DataFrame:
    """Known pages with the status of those seen (page_id, new_status); never a new row."""
    return pages.join(seen.select("page_id", "new_status"), "page_id", "left").withColumn("status", F.coalesce("new_status", "status")).drop("new_status")


def crawl_summary(results: DataFrame) -> DataFrame:
    """Counters and final status of each job from its results (job_id, outcome, error, cancelled, limit_hit)."""
    count = lambda *o: F.count_if(F.col("outcome").isin(*o))
    rows = results.groupBy("job_id").agg(count("CREATED", "UPDATED", "UNCHANGED").alias("ok"), count("FAILED").alias("failed"), count("SKIPPED").alias("skipped"), F.bool_or("error").alias("error"), F.bool_or("cancelled").alias("cancelled"), F.bool_or("limit_hit").alias("limit_hit"))
    status = F.when(F.col("error") | ((F.col("ok") == 0) & (F.col("failed") > 0)), "FAILED").when(F.col("cancelled"), "CANCELLED").when((F.col("failed") > 0) | F.col("limit_hit"), "PARTIAL").otherwise("COMPLETED")
    return rows.withColumn("status", status)


def identified(results: DataFrame) -> DataFrame:
    """Crawl results (url, at, http_status, final_url) with identity, status and outcome: content belongs to the canonical
    final URL, which the first result that leads there stores; later ones are DUPLICATE, pages that led elsewhere REDIRECTED."""
    url, final = urls.canonical(F.col("url")), F.coalesce(urls.canonical(F.col("final_url")), urls.canonical(F.col("url")))
    rows = results.withColumns({"url": url, "identity": final, "good": F.col("http_status").between(200, 299)})
    first = rows.where("good").groupBy("identity").agg(F.min("at").alias("_first"))
    rows = rows.join(first, "identity", "left")
    moved = F.col("url") != F.col("identity")
    status = page_status(F.col("http_status"), F.lit(False), F.col("good") & moved)
    outcome = F.when(~F.col("good"), "FAILED").when(F.col("at") > F.col("_first"), "DUPLICATE").otherwise("STORED")
    return rows.select("url", "at", F.when(F.col("good"), F.col("identity")).alias("identity"), status.alias("status"), outcome.alias("outcome"))


def new_children(extracted_: DataFrame, outcomes: DataFrame, array: str) -> DataFrame:
    """A child table of those pages only that have a new version (outcomes: page_id, outcome, version_no)."""
    fresh = outcomes.where(F.col("outcome").isin("CREATED", "UPDATED")).select("page_id", "version_no")
    return child(extracted_.join(fresh, "page_id"), array, "page_id", "version_no")


def with_current(pages: DataFrame, versions: DataFrame) -> DataFrame:
    """pages with the fields (v_*) of the version that each points to by current_version_id, null without one."""
    own = versions.select(*[F.col(c).alias(f"v_{c}") for c in versions.columns])
    return pages.join(own, (F.col("page_id") == F.col("v_page_id")) & (F.col("current_version_id") == F.col("v_version_id")), "left").drop("v_page_id", "v_version_id")


def page_contents(pages: DataFrame, versions: DataFrame) -> DataFrame:
    """pages with title, h1 and headings of their current versions, which detection compares queries with; null without one."""
    rows = with_current(pages, versions.select("version_id", "page_id", "title", "h1", "headings"))
    return rows.withColumnsRenamed({f"v_{c}": c for c in ("title", "h1", "headings")})


def nested(parents: DataFrame, children: DataFrame, key: str, order: str, name: str) -> DataFrame:
    """parents with an array of their children (structs of all other columns), in order; empty without any."""
    rest = [c for c in children.columns if c not in (key, order)]
    rows = children.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(order, *rest))).alias(name))
    return parents.join(rows, key, "left").withColumn(name, F.coalesce(name, F.array().cast(rows.schema[name].dataType)))


def structured_facts(rows: DataFrame) -> DataFrame:
    """page_id, the distinct types of all JSON-LD blocks in order of appearance, and images without an alt text."""
    types = F.array_distinct(F.flatten(F.transform("json_ld", lambda b: b["types"])))
    return rows.select("page_id", types.alias("types"), F.size(F.filter("images", lambda i: i["alt"].isNull())).alias("images_missing_alt"))
