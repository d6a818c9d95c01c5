"""Search terms: tokens without stop words, light stems, and which terms of a query a page's structure lacks."""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

import pandas as pd
import pyarrow as pa
from pyspark.sql import functions as F

#: Words that carry no search intent.
STOP_WORDS = frozenset(
    "a an and are as at be by can do does for from how i in is it its me my of on or the that this to vs was what when where "
    "which who why will with without you your best top guide 2023 2024 2025 2026".split()
)
#: Endings in the order they are tried, and what takes their place.
ENDINGS = tuple((re.compile(p), r) for p, r in ((r"ations?$", ""), (r"ings?$", ""), (r"ies$", "y"), (r"(?<=ch|sh|ss)es$", ""), (r"(?<=[xz])es$", ""), (r"ed$", ""), (r"(?<=[^s])s$", "")))
_RUN = re.compile(r"[^\W_]+")
_MARKS = re.compile(r"[̀-ͯ]")
PREFIX = 5


@lru_cache(1 << 16)
def stem(token: str) -> str:
    if len(token) > 4:
        for ending, by in ENDINGS:
            if ending.search(token):
                return ending.sub(by, token)
    return token


def tokens(text: str | None) -> list[str]:
    plain = _MARKS.sub("", unicodedata.normalize("NFKD", text or "")).lower()
    return [t for t in _RUN.findall(plain) if len(t) >= 2 and t not in STOP_WORDS and stem(t) not in STOP_WORDS]


def told_by(structure: str) -> tuple[set[str], set[str]]:
    """The stems of a structure's tokens, and the beginnings of the long ones."""
    stems = set(map(stem, tokens(structure)))
    return stems, {s[:PREFIX] for s in stems if len(s) >= PREFIX}


def untold(terms: list[str], stems: set[str], heads: set[str]) -> list[str]:
    return [t for t in terms if stem(t) not in stems and not (len(stem(t)) >= PREFIX and stem(t)[:PREFIX] in heads)]


def lacking(terms: list[str], structure: str) -> list[str]:
    """Terms that no token of the structure matches: equal stems, or two long stems of one beginning."""
    return untold(terms, *told_by(structure))


def tokens_column(text):
    """tokens() as a column."""

    def batch(rows: pd.Series) -> pd.Series:
        return rows.map(tokens)

    return F.pandas_udf(batch, "array<string>")(text)


def stem_column(token):
    def batch(rows: pd.Series) -> pd.Series:
        return rows.map(stem)

    return F.pandas_udf(batch, "string")(token)


def lacking_column(terms, structure):
    """lacking() as a column: terms of an array that no token of a text matches."""

    def batch(asked: pd.Series, texts: pd.Series) -> pd.Series:
        return pd.Series([lacking(list(a) if a is not None else [], t or "") for a, t in zip(asked, texts, strict=True)])

    return F.pandas_udf(batch, "array<string>")(terms, structure)


GAP = "array<struct<query:string,impressions:bigint,clicks:bigint,position:double,terms:array<string>,missing_terms:array<string>,ratio:double>>"
_GAPS = pa.list_(pa.struct([("query", pa.string()), ("impressions", pa.int64()), ("clicks", pa.int64()), ("position", pa.float64()), ("terms", pa.list_(pa.string())), ("missing_terms", pa.list_(pa.string())), ("ratio", pa.float64())]))
#: Pages whose queries are held as Python objects at once.
PAGES_AT_ONCE = 256


def _gaps(queries: pa.Array, structure: pa.Array, ratio: pa.Array) -> pa.Array:
    def one(rows, text, least):
        out, told = [], told_by(text) if rows and text is not None else None
        for q in rows or ():
            terms = list(dict.fromkeys(tokens(q["query"])))
            if terms and told is not None:
                missing = untold(terms, *told)
                share = (len(terms) - len(missing)) / len(terms)
                if share < least:
                    out.append({"query": q["query"], "impressions": q["impressions"], "clicks": q["clicks"], "position": q["position"], "terms": terms, "missing_terms": missing, "ratio": share})
        return out

    def part(at: int) -> pa.Array:
        few = [x.slice(at, PAGES_AT_ONCE).to_pylist() for x in (queries, structure, ratio)]
        return pa.array([one(*x) for x in zip(*few, strict=True)], _GAPS)

    return pa.concat_arrays([part(at) for at in range(0, len(queries), PAGES_AT_ONCE)] or [pa.array([], _GAPS)])


def coverage_gaps(queries, title, h1, headings, min_impressions: int, most: int, least_ratio: float):
    """Gaps among the first most queries with min_impressions: their terms are mostly absent from title, h1 and headings.

    Queries without terms keep their place among the most. Only those few queries go through Python, and of a batch few pages
    are Python objects at a time: what a task holds goes by PAGES_AT_ONCE, not by how many pages there are."""
    few = F.slice(F.filter(queries, lambda q: q["impressions"] >= min_impressions), 1, most)
    structure = F.when(title.isNotNull() | h1.isNotNull() | headings.isNotNull(), F.concat_ws(" ", title, h1, headings))
    return F.arrow_udf(_gaps, GAP)(few, structure, F.lit(float(least_ratio)))
