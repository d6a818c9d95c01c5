"""Model answers against their schema: bounds as data, compiled to one native check over a VARIANT."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

# What an answer's fields may be.
INTENTS = ("INFORMATIONAL", "COMMERCIAL", "TRANSACTIONAL", "NAVIGATIONAL", "MIXED", "UNKNOWN")
OBSERVATION_TYPES = ("PERFORMANCE", "RANKING", "CTR", "TREND", "QUERY", "CONTENT_STRUCTURE", "METADATA", "INTERNAL_LINKS")
RECOMMENDATION_TYPES = ("TITLE", "META_DESCRIPTION", "HEADING", "SECTION_EXPANSION", "MISSING_TOPIC", "CLARIFICATION", "INTERNAL_LINK", "INTRODUCTION")
PRIORITIES = ("HIGH", "MEDIUM", "LOW")


@dataclass(frozen=True)
class Rule:
    """What the values at a path must be; [] stands for all items of a list. kind: text (trimmed, least to most characters),
    maybe (a text of most characters, or null), list (least to most items), part (a number, least to most), flag, or one_of."""

    path: str
    kind: str
    least: float = 0
    most: float = 0
    values: tuple[str, ...] = ()


def text(path: str, most: int) -> Rule:
    return Rule(path, "text", 1, most)


def items(path: str, least: int, most: int, each: int | None = None) -> list[Rule]:
    """A list, of texts of each characters if given."""
    return [Rule(path, "list", least, most), *([text(f"{path}[]", each)] if each else [])]


def part(path: str) -> Rule:
    return Rule(path, "part", 0, 1)


# Bounds of an analysis, of a set of recommendations, and of a draft.
ANALYSIS = [
    text("summary", 1200), Rule("evidenceSufficient", "flag"), *items("insufficientEvidenceNotes", 0, 6, 400),
    *items("observations", 1, 12), Rule("observations[].type", "one_of", values=OBSERVATION_TYPES), text("observations[].statement", 600), *items("observations[].evidence", 1, 6, 400),
    *items("interpretations", 0, 8), text("interpretations[].statement", 600), *items("interpretations[].basedOn", 1, 6, 400), part("interpretations[].confidence"),
    *items("searchIntent", 0, 15), text("searchIntent[].query", 500), Rule("searchIntent[].intent", "one_of", values=INTENTS), part("searchIntent[].confidence"), text("searchIntent[].reasoning", 400),
    *items("contentGaps", 0, 10), text("contentGaps[].topic", 200), *items("contentGaps[].relatedQueries", 1, 10, 500), text("contentGaps[].evidence", 600), part("contentGaps[].confidence"),
    *items("areasForInvestigation", 0, 8, 400),
]
RECOMMENDATIONS = [
    *items("recommendations", 0, 10), Rule("recommendations[].type", "one_of", values=RECOMMENDATION_TYPES), text("recommendations[].recommendation", 800), text("recommendations[].rationale", 800),
    *items("recommendations[].evidence", 1, 6, 400), Rule("recommendations[].targetSection", "maybe", 0, 200), Rule("recommendations[].priority", "one_of", values=PRIORITIES),
    Rule("recommendations[].suggestedValue", "maybe", 0, 20_000), *items("caveats", 0, 6, 400),
]
DRAFT = [Rule("suggestedValue", "maybe", 0, 20_000), Rule("note", "line", 0, 400)]


def parsed(answer: Column) -> Column:
    """The model's JSON object without its code fence, as a VARIANT; null for anything else."""
    bare = F.regexp_replace(F.regexp_replace(F.trim(answer), r"(?i)^```(?:json)?\s*", ""), r"\s*```$", "")
    return F.when(bare.rlike(r"(?s)^\s*\{.*\}\s*$"), F.try_parse_json(bare))


def values_at(root: Column, path: str) -> Column:
    """An array of the values at a path; null where a field is missing. A list that is none has no items."""
    found = F.array(root)
    for k, name in enumerate(path.split("[]")):
        if k:
            found = F.flatten(F.transform(found, lambda x: F.coalesce(F.try_variant_get(x, "$", "array<variant>"), F.array().cast("array<variant>"))))
        if name.strip("."):
            found = F.transform(found, _field(name.strip(".")))
    return found


def _field(name: str):
    return lambda x: F.try_variant_get(x, f"$.{name}", "variant")


def problem(rule: Rule) -> list[tuple[str, object]]:
    """What may be wrong with one value: names and tests, the first that holds counts. A test gets a VARIANT, or null."""
    kind = lambda x: F.coalesce(F.schema_of_variant(x), F.lit("VOID"))
    string = lambda x: F.try_variant_get(x, "$", "string")
    number = lambda x: F.try_variant_get(x, "$", "double")
    size = lambda x: F.size(F.try_variant_get(x, "$", "array<variant>"))
    length = lambda x: F.length(F.regexp_replace(string(x), r"(?U)^\s+|\s+$", ""))
    if rule.kind == "list":
        return [("not a list", lambda x: ~kind(x).startswith("ARRAY")), ("too few", lambda x: size(x) < rule.least), ("too many", lambda x: size(x) > rule.most)]
    if rule.kind == "part":
        return [("not a number", lambda x: ~kind(x).rlike("^(?:BIGINT|DOUBLE|FLOAT|DECIMAL)")), ("out of range", lambda x: ~number(x).between(rule.least, rule.most))]
    if rule.kind == "flag":
        return [("not true or false", lambda x: kind(x) != "BOOLEAN")]
    if rule.kind == "one_of":
        return [("not a text", lambda x: kind(x) != "STRING"), ("unknown", lambda x: ~string(x).isin(*rule.values))]
    if rule.kind == "maybe":  # given, but perhaps as null
        return [("missing", lambda x: x.isNull()), ("not a text", lambda x: ~kind(x).isin("STRING", "VOID")), ("too long", lambda x: F.length(string(x)) > rule.most)]
    shortest = [] if rule.kind == "line" else [("too short", lambda x: length(x) < rule.least)]
    longest = (lambda x: F.length(string(x))) if rule.kind == "line" else length
    return [("not a text", lambda x: kind(x) != "STRING"), *shortest, ("too long", lambda x: longest(x) > rule.most)]


def problems(root: Column, rules: list[Rule]) -> Column:
    """An array of (path, problem, n) of a parsed() answer: how many values at each path are wrong, and how. An answer that could not
    be read has one problem of its own, with an empty path. No problem at all: an empty array."""

    def told(rule: Rule) -> Column:
        def first(x: Column) -> Column:
            return F.coalesce(*[F.when(test(x), F.lit(name)) for name, test in problem(rule)])

        wrong = F.filter(F.transform(values_at(root, rule.path), first), lambda x: x.isNotNull())
        return F.transform(F.array_distinct(wrong), lambda w: F.struct(F.lit(rule.path).alias("path"), w.alias("problem"), F.size(F.filter(wrong, lambda x: x == w)).alias("n")))

    unread = F.array(F.struct(F.lit("").alias("path"), F.lit("no answer").alias("problem"), F.lit(1).alias("n")))
    return F.when(root.isNull(), unread).otherwise(F.concat(*[told(r) for r in rules]))
