"""Set operations over scans and mapper outputs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def append(*frames: DataFrame) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), frames)


def combine(*frames: DataFrame) -> DataFrame:
    """Union of differently shaped outputs; missing columns become NULL."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def new_only(current: DataFrame, previous: DataFrame, key: str) -> DataFrame:
    return current.select(key).distinct().exceptAll(previous.select(key).distinct())


def fixed_only(current: DataFrame, previous: DataFrame, key: str) -> DataFrame:
    return new_only(previous, current, key)


def persisting(current: DataFrame, previous: DataFrame, key: str) -> DataFrame:
    return current.select(key).intersect(previous.select(key))


def except_all(a: DataFrame, b: DataFrame) -> DataFrame:
    return _copies(a, b, lambda x, y: F.greatest(x - y, F.lit(0)))


def intersect_all(a: DataFrame, b: DataFrame) -> DataFrame:
    return _copies(a, b, F.least)


def _copies(a: DataFrame, b: DataFrame, count) -> DataFrame:
    """Multiset operation on counts: a hot row is counted in its task before the shuffle."""
    cols = a.columns
    tagged = a.select("*", F.lit(1).alias("_a"), F.lit(0).alias("_b")).unionByName(
        b.select("*", F.lit(0).alias("_a"), F.lit(1).alias("_b"))
    )
    n = tagged.groupBy(*cols).agg(F.sum("_a").alias("_a"), F.sum("_b").alias("_b"))
    n = n.withColumn("_n", count(F.col("_a"), F.col("_b"))).where(F.col("_n") > 0)
    # Copies are unfolded in two steps, so that no array grows with a row's count.
    chunk = 100_000
    starts = F.sequence(F.lit(0), F.floor((F.col("_n") - 1) / chunk))
    parts = n.select(*cols, "_n", F.explode(starts).alias("_c"))
    size = F.least(F.lit(chunk), F.col("_n") - F.col("_c") * chunk)
    return parts.select(*cols, F.explode(F.sequence(F.lit(1).cast("bigint"), size.cast("bigint"))).alias("_i")).drop("_i")


def union_distinct(*frames: DataFrame) -> DataFrame:
    return append(*frames).distinct()


def scan_diff(current: DataFrame, previous: DataFrame, key: str = "fingerprint") -> DataFrame:
    """Counts per key in both scans with status new, fixed or persisting."""
    tag = lambda df, a, b: df.select(key, F.lit(a).alias("_c"), F.lit(b).alias("_p"))
    both = tag(current, 1, 0).unionByName(tag(previous, 0, 1))
    n = both.groupBy(key).agg(F.sum("_c").alias("now"), F.sum("_p").alias("before"))
    status = F.when(F.col("before") == 0, "new").when(F.col("now") == 0, "fixed").otherwise("persisting")
    return n.select(key, "now", "before", status.alias("status"))
