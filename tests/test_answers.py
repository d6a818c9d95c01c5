"""Answers against the rules of their schemas, at the bounds and one beyond; hosts and encoding of addresses."""

import json
import random

import pytest
from pyspark.sql import functions as F

from tidemark.functions import urls
from tidemark.operators import answers

REC = {"type": "TITLE", "recommendation": "r", "rationale": "r", "evidence": ["e"], "targetSection": None, "priority": "HIGH", "suggestedValue": None}
SET = {"recommendations": [REC], "caveats": []}


def found(spark, rules, *given):
    rows = spark.createDataFrame([(k, g if isinstance(g, str) or g is None else json.dumps(g)) for k, g in enumerate(given)], "k int, a string")
    out = rows.select("k", answers.problems(answers.parsed(F.col("a")), rules).alias("p")).orderBy("k").collect()
    return [[tuple(p) for p in r.p] for r in out]


def with_(**changes):
    return SET | {"recommendations": [REC | changes]}


@pytest.mark.parametrize(
    "given, want",
    [
        (SET, []),
        (SET | {"recommendations": []}, []),
        (SET | {"recommendations": [REC] * 10}, []),
        (SET | {"recommendations": [REC] * 11}, [("recommendations", "too many", 1)]),
        (with_(type="POEM"), [("recommendations[].type", "unknown", 1)]),
        (with_(type=7), [("recommendations[].type", "not a text", 1)]),
        (with_(evidence=[]), [("recommendations[].evidence", "too few", 1)]),
        (with_(evidence=["x"] * 6 + [" "]), [("recommendations[].evidence", "too many", 1), ("recommendations[].evidence[]", "too short", 1)]),
        (with_(evidence=["x" * 400, " " + "x" * 400 + "\n", "x" * 401, 5]), [("recommendations[].evidence[]", "too long", 1), ("recommendations[].evidence[]", "not a text", 1)]),
        (with_(targetSection="s" * 200), []),
        (with_(targetSection="s" * 201), [("recommendations[].targetSection", "too long", 1)]),
        (with_(priority="high"), [("recommendations[].priority", "unknown", 1)]),
        ({"recommendations": [{k: v for k, v in REC.items() if k != "suggestedValue"}], "caveats": "none"}, [("recommendations[].suggestedValue", "missing", 1), ("caveats", "not a list", 1)]),
        ("not json", [("", "no answer", 1)]),
        ("[1, 2]", [("", "no answer", 1)]),
        (None, [("", "no answer", 1)]),
    ],
)
def test_recommendations(spark, given, want):
    assert found(spark, answers.RECOMMENDATIONS, given) == [want]


def test_drafts_and_numbers(spark):
    assert found(spark, answers.DRAFT, {"suggestedValue": None, "note": ""}, {"suggestedValue": "v", "note": "n" * 401}, {"note": None}) == [[], [("note", "too long", 1)], [("suggestedValue", "missing", 1), ("note", "not a text", 1)]]
    rule = [answers.part("confidence")]
    assert found(spark, rule, *({"confidence": x} for x in (0, 1, 0.5, 1.01, -1, "0.5", None, True)), {}) == [[], [], [], *[[("confidence", "out of range", 1)]] * 2, *[[("confidence", "not a number", 1)]] * 4]


def test_international_hosts(spark):
    """Native Punycode against the codec, label by label."""
    draw = random.Random(1)
    labels = ["".join(draw.choice("abcxyz-019éüßñ日本語中文אבд😀𝒳") for _ in range(draw.randrange(1, 15))) for _ in range(150)] + ["MÜNCHEN", "bücher", "日本語", "ü"]
    ascii_ = lambda x: x if x.isascii() else "xn--" + x.encode("punycode").decode()
    names = [f"{a}.{b}.com" for a, b in zip(labels, labels[1:], strict=False)]
    rows = spark.createDataFrame([(n,) for n in names], "name string").select("name", urls.ascii_host(F.col("name")).alias("got")).collect()
    assert [r.got for r in rows] == [".".join(ascii_(x) for x in r.name.lower().split(".")) for r in rows]


@pytest.mark.parametrize(
    "raw, want",
    [
        ("https://MÜNCHEN.de/straße/../x/./y/..", "https://xn--mnchen-3ya.de/x"),
        ("https://e.com/a b/é?q=x y&z=%C3%A9&b", "https://e.com/a%20b/%C3%A9?b=&q=x+y&z=%C3%A9"),
        ("https://e.com/a%20b?x=%zz", "https://e.com/a%20b?x=%25zz"),
        ("https://e.com/%2e%2E/a/.", "https://e.com/a"),
        ("https://e.com\\x\\y", "https://e.com/x/y"),
        ("https://e.com/..", "https://e.com/"),
        ("https://例え.jp", "https://xn--r8jz45g.jp/"),
    ],
)
def test_encoding(spark, raw, want):
    assert spark.createDataFrame([(raw,)], "u string").select(urls.canonical(F.col("u"))).first()[0] == want


def test_answers_are_read_once(spark, small):
    """One reading of each answer serves all checks of its bounds."""
    import __spark_entry__

    plan = __spark_entry__.queries()["answer_bounds"](spark, small)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("from_json") == 1
