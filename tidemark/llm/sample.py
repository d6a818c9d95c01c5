"""Bounded, repeatable samples of labelled rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def unit(*columns: str | Column) -> Column:
    """A number in [0, 1) from a hash of the columns: the same row always has the same."""
    return F.shiftrightunsigned(F.xxhash64(*columns), 11).cast("double") / float(1 << 53)


def bounded(rows: DataFrame, bound: int, *columns: str, by: str | None = None, most: int = 1000) -> DataFrame:
    """About bound rows (for each value of by) with the smallest hashes of columns; all of them if there are fewer.

    Which rows are taken depends on their own columns only; equal rows are taken all or not at all. Of by, the most common
    values (most at most, ties by value) are counted first, one small row for each; rows of other values, and of null, are
    left out. An empty table gives no rows."""
    if by is None:
        n = rows.count()
        return rows.where(unit(*columns) < bound / max(n, 1))
    common = rows.where(F.col(by).isNotNull()).groupBy(by).count().orderBy(F.desc("count"), by).limit(most).collect()
    if not common:
        return rows.where(F.lit(False))
    share = F.create_map(*[F.lit(x) for r in common for x in (r[0], bound / r[1])])
    return rows.where(unit(*columns) < F.element_at(share, F.col(by)))


def within(rows: DataFrame, most_bytes: int, *columns: str) -> DataFrame:
    """rows (with text), or, if their texts have more than most_bytes bytes, the part of them that has about so many: what
    the driver trains on is bounded however long the texts are. Rows are chosen by another hash of columns, whole."""
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return rows if total <= most_bytes else rows.where(unit(*columns, F.lit("bytes")) < most_bytes / total)
