"""Sketches of facts by day, kept as rows and merged over any days: quantiles within a stated error, and distinct counts."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Relative error of quantiles, and smallest hashes that are kept of a day and of a window.
ERROR, SMALLEST = 0.01, 1024
#: Hashes are 60 bits.
SPACE = 1 << 60


def bucket(x: Column, error: float = ERROR) -> Column:
    """The bucket of a value: k holds values over g^(k-1) and up to g^k, with g = (1 + error) / (1 - error). 0 and less: null."""
    return F.when(x > 0, F.ceil(F.round(F.log(x) / math.log((1 + error) / (1 - error)), 9)).cast("int"))


def middle(bucket_: Column, error: float = ERROR) -> Column:
    """A value that is within error of all values of a bucket; 0 for the null bucket."""
    growth = (1 + error) / (1 - error)
    return F.coalesce(2 * F.pow(F.lit(growth), bucket_) / (growth + 1), F.lit(0.0))


def histogram(rows: DataFrame, keys: list[str], value: str, weight: Column | None = None, error: float = ERROR) -> DataFrame:
    """keys, bucket and n: how many values (or how much weight) each bucket has. Sums merge: over other keys, or with another
    table of the same kind. A null value counts for nothing. Rows for each key: at most as many as there are buckets between
    its smallest and largest value."""
    n = F.count("*") if weight is None else F.sum(weight)
    return rows.where(F.col(value).isNotNull()).groupBy(*keys, bucket(F.col(value), error).alias("bucket")).agg(n.alias("n"))


def merged_histogram(sketch: DataFrame, keys: list[str]) -> DataFrame:
    return sketch.groupBy(*keys, "bucket").agg(F.sum("n").alias("n"))


def quantiles(sketch: DataFrame, keys: list[str], at: list[float], error: float = ERROR) -> DataFrame:
    """keys, q and value: for each q the middle of the bucket in which the value of rank max(1, ceil(q * n)) lies, so that it is
    within error of that value. A window over the buckets of a key, not over its values."""
    order = Window.partitionBy(*keys).orderBy(F.col("bucket").asc_nulls_first())
    run = merged_histogram(sketch, keys).withColumn("_to", F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    run = run.withColumn("_all", F.sum("n").over(Window.partitionBy(*keys))).withColumn("q", F.explode(F.array(*[F.lit(float(q)) for q in at])))
    rank = F.greatest(F.lit(1), F.ceil(F.round(F.col("q") * F.col("_all"), 6)))
    return run.where((F.col("_to") >= rank) & (F.col("_to") - F.col("n") < rank)).select(*keys, "q", middle(F.col("bucket"), error).alias("value"))


def hashed(*columns: str) -> Column:
    """A 60-bit hash of columns as text, the same in any engine."""
    return F.conv(F.substring(F.md5(F.concat_ws("\x1f", *columns).cast("binary")), 1, 15), 16, 10).cast("long")


def smallest(rows: DataFrame, keys: list[str], k: int = SMALLEST) -> DataFrame:
    """keys and hash: the k smallest distinct hashes (column hash) of each key. The smallest of several days' smallest are
    those of the days together, so that this merges. Each task drops what is beyond its own k before the shuffle."""
    order = F.row_number().over(Window.partitionBy(*keys).orderBy("hash"))
    return rows.select(*keys, "hash").distinct().withColumn("_at", order).where(F.col("_at") <= k).drop("_at")


def distinct_counts(sketch: DataFrame, keys: list[str], k: int = SMALLEST) -> DataFrame:
    """keys and estimate from k smallest hashes: exact below k values, else (k - 1) over the k-th hash as a part of all; the
    standard error is 1 / sqrt(k - 2) of the count, 3.1 % at 1,024."""
    rows = smallest(sketch, keys, k).groupBy(*keys).agg(F.count("*").alias("n"), F.max("hash").alias("last"))
    return rows.select(*keys, F.when(F.col("n") < k, F.col("n").cast("double")).otherwise((k - 1) / ((F.col("last") + 1) / SPACE)).alias("estimate"))
