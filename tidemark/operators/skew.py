"""Joins in which one key may hold a large part of all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows of a key that one task may get, at least; at most one in MOST_KEYS of all rows, so that there are few hot keys.
FEW, MOST_KEYS = 100_000, 10_000


def fans(counts: DataFrame, few: int = FEW) -> DataFrame:
    """Keys that are dealt to several tasks, with their number (_fan); counts: keys and n, their rows. At most MOST_KEYS rows,
    whatever counts holds, so that it can be broadcast."""
    total = counts.agg(F.sum("n")).first()[0] or 0
    limit = max(few, total // MOST_KEYS)
    return counts.where(F.col("n") > limit).withColumn("_fan", F.ceil(F.col("n") / limit).cast("int")).drop("n")


def dealt(rows: DataFrame, keys: list[str], fans_: DataFrame, *spread: str) -> DataFrame:
    """rows with _part: 0, or for a hot key one of its parts by a hash of the columns spread."""
    hot = F.broadcast(fans_)
    return rows.join(hot, keys, "left").withColumn("_part", F.when(F.col("_fan").isNull(), 0).otherwise(F.pmod(F.xxhash64(*spread), F.col("_fan")))).withColumn("_part", F.col("_part").cast("int")).drop("_fan")


def sent(side: DataFrame, keys: list[str], fans_: DataFrame) -> DataFrame:
    """side with each row of a hot key once in every part of it (_part)."""
    parts = F.sequence(F.lit(0), F.coalesce("_fan", F.lit(1)) - 1)
    return side.join(F.broadcast(fans_), keys, "left").withColumn("_part", F.explode(parts)).drop("_fan")


def looked_up(rows: DataFrame, side: DataFrame, keys: list[str], few: int = FEW) -> DataFrame:
    """rows left-joined with side (one row for each key); rows is read twice, so give a written table."""
    spread = [c for c in rows.columns if c not in keys] or keys
    fans_ = fans(rows.groupBy(*keys).agg(F.count("*").alias("n")), few)
    return dealt(rows, keys, fans_, *spread).join(sent(side, keys, fans_), [*keys, "_part"], "left").drop("_part")
