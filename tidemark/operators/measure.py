"""Verification of applied changes against a live page, baselines before a change and measurements after it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.numeric import half_up, ratio, weighted_position
from tidemark.functions.wording import composed, folded_space, stripped
from tidemark.operators.performance import measures
from tidemark.sources.tables import only


def located(change: Column, target: Column, approved: Column, live: Column) -> Column:
    """struct(found, value, section_key) of the field that a change goes to in the live version; sections are never guessed.

    approved, live: structs of title, meta_description, h1, sections (key, order, level, heading, text)."""
    field = lambda v: F.struct(F.lit(True).alias("found"), v.alias("value"), F.lit(None).cast("string").alias("section_key"))
    none = F.struct(F.lit(False).alias("found"), F.lit(None).cast("string").alias("value"), F.lit(None).cast("string").alias("section_key"))
    source = F.get(F.filter(approved["sections"], lambda s: s["key"] == target), F.lit(0))
    body = F.get(F.filter(live["sections"], lambda s: s["key"] == source["key"]), F.lit(0))
    head = F.get(F.filter(live["sections"], lambda s: (s["order"] == source["order"]) & (s["level"] == source["level"])), F.lit(0))
    at = lambda s, v: F.when(s.isNotNull(), F.struct(F.lit(True).alias("found"), v.alias("value"), s["key"].alias("section_key"))).otherwise(none)
    same_count = F.size(live["sections"]) == F.size(approved["sections"])
    return (
        F.when(change == "TITLE", field(live["title"])).when(change == "META_DESCRIPTION", field(live["meta_description"])).when(change == "H1", field(live["h1"]))
        .when(change == "SECTION_CONTENT", at(body, body["text"])).when((change == "SECTION_HEADING") & same_count, at(head, head["heading"])).otherwise(none)
    )


def verified(rows: DataFrame) -> DataFrame:
    """rows (change_type, target_section, current_value, proposed_value, approved, live) with result, live_value, live_section."""
    rows = rows.withColumn("_at", located(F.col("change_type"), F.col("target_section"), F.col("approved"), F.col("live")))
    now, want, was = (folded_space(composed(F.col(c))) for c in ("_at.value", "proposed_value", "current_value"))
    result = F.when(~F.col("_at.found"), "TARGET_MISSING").when((want != "") & (now == want), "MATCH").when(now == was, "UNCHANGED").otherwise("CONFLICT")
    return rows.withColumns({"result": result, "live_value": F.when(F.col("_at.value").isNotNull(), now), "live_section": F.col("_at.section_key")}).drop("_at")


#: The longest proposed value of each kind of change.
LONGEST = {"TITLE": 200, "META_DESCRIPTION": 400, "H1": 200, "SECTION_HEADING": 200, "SECTION_CONTENT": 20_000}


def proposals_built(rows: DataFrame) -> DataFrame:
    """rows (change_type, target_section, proposed_value, version: title, meta_description, h1, sections) with current_value,
    proposed_value tidied, and problem: why it can't be taken, or null."""
    section = F.col("change_type").isin("SECTION_HEADING", "SECTION_CONTENT")
    own = F.get(F.filter("version.sections", lambda s: s["key"] == F.col("target_section")), F.lit(0))
    kind = F.col("change_type")
    current = F.when(kind == "TITLE", F.col("version.title")).when(kind == "META_DESCRIPTION", F.col("version.meta_description")).when(kind == "H1", F.col("version.h1")).when(kind == "SECTION_HEADING", own["heading"]).when(kind == "SECTION_CONTENT", own["text"])
    tidy = F.when(kind == "SECTION_CONTENT", stripped(F.col("proposed_value"))).otherwise(folded_space(F.col("proposed_value")))
    most = F.create_map(*[F.lit(x) for pair in LONGEST.items() for x in pair])[kind]
    rows = rows.withColumns({"current_value": current, "proposed_value": tidy, "_own": own})
    value = F.col("proposed_value")
    problem = (
        F.when(section & F.col("target_section").isNull(), "no section").when(section & F.col("_own").isNull(), "unknown section").when(value == "", "empty").when(F.length(value) > most, "too long")
        .when(value.rlike(r"(?i)<\s*(script|iframe|style)\b"), "markup").when(stripped(F.col("current_value")) == value, "identical")
    )
    return rows.withColumn("problem", problem).drop("_own")


def change_fingerprint(*fields: str) -> Column:
    """SHA-256 of a fixed-order JSON array of the fields."""
    return F.sha2(F.to_json(F.array(*[F.col(f).cast("string") for f in fields])), 256)


def baselines(facts: DataFrame, requests: DataFrame, window_days: int = 28, lag: int = 3) -> DataFrame:
    """For requests (property_id, page, last_synced, as_of) the totals of the window that ends at the latest day that is
    synced, final and before as_of; days_with_data, data_complete, or a limitation instead of numbers."""
    span = only(facts, "page").groupBy("property_id").agg(F.min("date").alias("first_day"))
    end = F.least("last_synced", F.date_sub("as_of", lag), F.date_sub("as_of", 1))
    rows = requests.join(span, "property_id", "left").withColumn("window_end", F.when(F.col("last_synced").isNotNull(), end)).withColumn("window_start", F.date_sub("window_end", window_days - 1))
    # only days of some window are read at all, and each request meets those of its own
    bounds = rows.agg(F.min("window_start").alias("lo"), F.max("window_end").alias("hi")).first()
    daily = only(facts, "page").where(F.col("date").between(F.lit(bounds.lo), F.lit(bounds.hi)))
    daily = daily.select(F.col("property_id").alias("_s"), F.col("page").alias("_p"), "date", "clicks", "impressions", "position")
    joined = rows.join(daily, (F.col("property_id") == F.col("_s")) & (F.col("page") == F.col("_p")) & F.col("date").between(F.col("window_start"), F.col("window_end")), "left")
    keys = ["property_id", "page", "last_synced", "as_of", "first_day", "window_start", "window_end"]
    sums = [F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("clicks", "impressions")]
    out = joined.groupBy(*keys).agg(*sums, half_up(weighted_position(F.col("position"), F.col("impressions")), 2).alias("position"), F.count("date").alias("days_with_data"))
    limitation = F.when(F.col("property_id").isNull(), "NO_GSC_PROPERTY").when(F.col("last_synced").isNull(), "GSC_NOT_SYNCED").when(F.col("first_day").isNull(), "NO_GSC_DATA")
    out = out.withColumns({"ctr": ratio(F.col("clicks"), F.col("impressions")), "data_complete": F.coalesce(F.col("first_day") <= F.col("window_start"), F.lit(False)), "limitation": limitation})
    return out.drop("first_day", "last_synced", "as_of")


def baseline_queries(facts: DataFrame, windows: DataFrame, limit: int = 20) -> DataFrame:
    """The top queries of each page in its window (property_id, page, window_start, window_end)."""
    rows = only(facts, "query").join(windows, ["property_id", "page"]).where(F.col("date").between(F.col("window_start"), F.col("window_end")))
    out = rows.groupBy("property_id", "page", "query").agg(*measures())
    rank = F.row_number().over(Window.partitionBy("property_id", "page").orderBy(F.desc("impressions"), "query"))
    return out.withColumn("rn", rank).where(F.col("rn") <= limit)


def measured_change(before: DataFrame, after: DataFrame) -> DataFrame:
    """An extension: differences of a later window's totals from the baseline's, by property and page."""
    new = after.select("property_id", "page", *[F.col(c).alias(f"after_{c}") for c in ("clicks", "impressions", "ctr", "position")])
    rows = before.join(new, ["property_id", "page"])
    return rows.withColumns({f"{c}_change": F.col(f"after_{c}") - F.col(c) for c in ("clicks", "impressions", "ctr", "position")})


def clipped_sections(sections: DataFrame, per_section: int = 4000, in_all: int = 40_000) -> DataFrame:
    """sections (page_id, order, text) with kept, the characters of each that fit a running budget, and truncated."""
    order = Window.partitionBy("page_id").orderBy("order").rowsBetween(Window.unboundedPreceding, 0)
    own = F.least(F.length("text"), F.lit(per_section))
    rows = sections.withColumn("_own", own).withColumn("_sum", F.sum("_own").over(order))
    kept = F.least(F.col("_sum"), F.lit(in_all)) - F.least(F.col("_sum") - F.col("_own"), F.lit(in_all))
    return rows.withColumn("kept", kept.cast("int")).withColumn("truncated", F.col("kept") < F.length("text")).withColumn("text", F.substring("text", F.lit(1), F.col("kept"))).drop("_own", "_sum")
