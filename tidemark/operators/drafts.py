"""Model answers as data: parsing, grounding in what was supplied, targets and novelty of drafts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import wording

ANSWER_DDL = "struct<summary:string,search_intent:array<struct<query:string,intent:string>>,content_gaps:array<struct<topic:string,related_queries:array<string>>>,evidence_sufficient:boolean,recommendations:array<struct<type:string,target_section:string,suggested_value:string,rationale:string>>>"
#: Length limits of drafts by target, and targets that keep their line breaks.
LENGTHS = {"TITLE": (10, 70), "META_DESCRIPTION": (50, 160), "H1": (3, 90), "SECTION_HEADING": (3, 90), "INTRODUCTION": (80, 1200), "SECTION_BODY": (1, 20_000)}
MULTILINE = ("INTRODUCTION", "SECTION_BODY")


def html_content(content_type: Column) -> Column:
    """Whether a response is a page: HTML, XHTML or without a type."""
    return F.coalesce(content_type, F.lit("")).rlike(r"(?i)^\s*($|(text/html|application/xhtml\+xml)\b)")


def answer(text: Column) -> Column:
    """The model's JSON without its code fence, as ANSWER_DDL; null for anything invalid."""
    bare = F.regexp_replace(F.regexp_replace(F.trim(text), r"(?i)^```(?:json)?\s*", ""), r"\s*```$", "")
    return F.when(F.try_parse_json(bare).isNotNull() & bare.rlike(r"(?s)^\s*\{.*\}\s*$"), F.from_json(bare, ANSWER_DDL))


#: Bounds of an answer: characters of texts, and how many items there may be.
SUMMARY, TOPIC, RATIONALE, VALUE = 1200, 200, 800, 20_000
MOST = {"search_intent": 15, "content_gaps": 10, "recommendations": 10, "related_queries": 10}
#: Kinds of recommendations.
KINDS = ("TITLE", "META_DESCRIPTION", "HEADING", "SECTION_EXPANSION", "MISSING_TOPIC", "CLARIFICATION", "INTERNAL_LINK", "INTRODUCTION")


def answer_problems(parsed: Column) -> Column:
    """Which bounds an answer() breaks; one that could not be read has no answer at all."""
    size = lambda name: F.coalesce(F.size(parsed[name]), F.lit(0))
    any_of = lambda name, test: F.coalesce(F.exists(parsed[name], test), F.lit(False))
    queries = lambda g: F.coalesce(F.size(g["related_queries"]), F.lit(0))
    checks = [
        (F.length(parsed["summary"]) > SUMMARY, F.lit("summary too long")), (parsed["summary"].isNull(), F.lit("no summary")),
        *[(size(n) > MOST[n], F.lit(f"too many {n}")) for n in ("search_intent", "content_gaps", "recommendations")],
        (any_of("content_gaps", lambda g: queries(g) == 0), F.lit("empty related_queries")), (any_of("content_gaps", lambda g: queries(g) > MOST["related_queries"]), F.lit("too many related_queries")),
        (any_of("content_gaps", lambda g: F.length(g["topic"]) > TOPIC), F.lit("topic too long")), (any_of("recommendations", lambda r: ~r["type"].isin(*KINDS)), F.lit("unknown type")),
        (any_of("recommendations", lambda r: F.length(r["rationale"]) > RATIONALE), F.lit("rationale too long")), (any_of("recommendations", lambda r: F.length(r["suggested_value"]) > VALUE), F.lit("suggested_value too long")),
    ]
    return F.when(parsed.isNull(), F.array(F.lit("no answer"))).otherwise(wording.listed(checks))


def asked(query: Column) -> Column:
    """A query in its grounding form."""
    return F.trim(F.regexp_replace(F.lower(query), r"\s+", " "))


def ungrounded(parsed: Column, queries: Column, sections: Column) -> Column:
    """What an answer refers to that was not supplied: queries of intents and gaps, and sections of recommendations."""
    known = F.transform(queries, asked)
    of_gaps = F.flatten(F.transform(parsed["content_gaps"], lambda g: g["related_queries"]))
    named = F.concat(F.coalesce(F.transform(parsed["search_intent"], lambda s: s["query"]), F.array().cast("array<string>")), F.coalesce(of_gaps, F.array().cast("array<string>")))
    strange = F.filter(named, lambda q: ~F.array_contains(known, asked(q)))
    targets = F.filter(F.transform(parsed["recommendations"], lambda r: r["target_section"]), lambda t: t.isNotNull())
    return F.concat(F.transform(strange, lambda q: F.concat(F.lit("unknown query: "), q)), F.transform(F.array_except(F.coalesce(targets, F.array().cast("array<string>")), sections), lambda t: F.concat(F.lit("unknown section: "), t)))


def draft_target(kind: Column, target: Column, sections: Column) -> Column:
    """The field that a recommendation's draft may replace, or null; sections: array of struct(key, heading, text)."""
    own = F.get(F.filter(sections, lambda s: s["key"] == target), F.lit(0))
    first = F.get(sections, F.lit(0))
    return (
        F.when(kind.isin("TITLE", "META_DESCRIPTION"), kind)
        .when((kind == "HEADING") & target.isNull(), "H1")
        .when((kind == "HEADING") & own["heading"].isNotNull(), "SECTION_HEADING")
        .when((kind == "INTRODUCTION") & first["heading"].isNull() & (first["key"] == target), "INTRODUCTION")
        .when(kind.isin("CLARIFICATION", "SECTION_EXPANSION") & (F.trim(F.coalesce(own["text"], F.lit(""))) != ""), "SECTION_BODY")
    )


def current_value(target: Column, section: Column, version: Column) -> Column:
    """What the target holds now: version is a struct of title, meta_description, h1, sections (key, heading, text)."""
    own = F.get(F.filter(version["sections"], lambda s: s["key"] == section), F.lit(0))
    return F.when(target == "TITLE", version["title"]).when(target == "META_DESCRIPTION", version["meta_description"]).when(target == "H1", version["h1"]).when(target == "SECTION_HEADING", own["heading"]).when(target.isin(*MULTILINE), own["text"])


def checked(drafts: DataFrame) -> DataFrame:
    """drafts (target, value, current, page_text, queries) with issues, and value null where there are any (five are kept).

    A draft of a section's body is held against the section as a rewrite as well."""
    lengths = F.create_map(*[x for k, (low, high) in LENGTHS.items() for x in (F.lit(k), F.struct(F.lit(low).alias("low"), F.lit(high).alias("high")))])
    limits, single = lengths[F.col("target")], ~F.col("target").isin(*MULTILINE)
    rows = drafts.withColumn("_r", wording.rewrite(F.col("current"), F.col("value"), F.col("page_text"))).withColumn("_m", wording.body_metrics(F.col("_r")))
    own = wording.draft_issues(F.col("value"), F.col("current"), F.col("page_text"), F.col("queries"), F.col("target"), limits["low"], limits["high"], single)
    none = F.array().cast("array<string>")
    body = F.when(F.col("target") == "SECTION_BODY", wording.body_issues(F.col("_r"), F.col("_m"))).otherwise(none)
    barred = F.array(F.lit("this recommendation may not carry a draft"))
    issues = F.when(F.col("value").isNull(), none).when(limits.isNull(), barred).otherwise(F.concat(body, own))
    rows = rows.withColumn("issues", F.slice(issues, 1, 5)).drop("_r", "_m")
    tidy = F.when(single, wording.folded_space(F.col("value"))).otherwise(wording.stripped(F.col("value")))
    return rows.withColumn("value", F.when((F.size("issues") == 0) & F.col("value").isNotNull(), tidy))


def novel(drafts: DataFrame, earlier: DataFrame) -> DataFrame:
    """Drafts (review_id, value) that no earlier one of their review equals once folded."""
    key = lambda d: d.withColumn("_f", wording.folded_space(F.col("value")))
    return key(drafts).join(key(earlier).select("review_id", "_f"), ["review_id", "_f"], "left_anti").drop("_f")
