"""Behaviour over time: versions, trends, top-k, bursts, islands, beacons, outliers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from palisade.operators.ordered import carry_last, global_order, int_bucket, ranged_sums


def latest(df: DataFrame, key: str, order: Sequence[str]) -> DataFrame:
    """Last version per key. The planner trims every task to one row per key before the shuffle."""
    return top_k(df, key, [F.desc(c) for c in order], 1).drop("place")


def trend(daily: DataFrame, series: str, day: str, value: str) -> DataFrame:
    """Previous value, running total and 7-day mean. Input: one row per (series, day)."""
    w = W.partitionBy(series).orderBy(day)
    return daily.select(
        series, day, value,
        F.lag(value).over(w).alias("previous"),
        (F.col(value) - F.lag(value).over(w)).alias("delta"),
        F.sum(value).over(w.rowsBetween(W.unboundedPreceding, 0)).alias("running"),
        F.round(F.avg(value).over(w.rowsBetween(-6, 0)), 6).alias("mean7"),
    )


def top_k(df: DataFrame, key: str, order: Sequence[Column], k: int) -> DataFrame:
    """Best k rows per key. The planner trims every task to k rows per key before the shuffle."""
    w = W.partitionBy(key).orderBy(*order)
    return df.withColumn("place", F.row_number().over(w)).where(F.col("place") <= k)


def burst(events: DataFrame, key: str, ts: str, n: int, delta_us: int, tie: str) -> DataFrame:
    """Events that close a run of at least n events of the key within the trailing delta.

    Windows run inside (key, time bucket); each row also visits the next bucket as
    context when it lies within delta of it, so a hot key is spread over time.
    """
    width = max(delta_us, 3_600_000_000)
    us = F.unix_micros(F.col(ts).cast("timestamp"))
    src = events.withColumn("_us", us).withColumn("_b", int_bucket(F.col("_us"), width))
    reaches_next = (F.col("_us") + F.lit(delta_us)) >= (F.col("_b") + 1) * F.lit(width)
    homes = F.when(reaches_next, F.array(F.struct(F.lit(True).alias("own"), F.col("_b").alias("b")),
                                         F.struct(F.lit(False).alias("own"), (F.col("_b") + 1).alias("b"))))
    homes = homes.otherwise(F.array(F.struct(F.lit(True).alias("own"), F.col("_b").alias("b"))))
    spread = src.withColumn("_h", F.explode(homes))
    w = W.partitionBy(key, "_h.b").orderBy("_us").rangeBetween(-delta_us, 0)
    counted = spread.withColumn("in_window", F.count("*").over(w))
    return counted.where(F.col("_h.own") & (F.col("in_window") >= n)).select(*events.columns, "in_window")


def enumeration(requests: DataFrame, key: str, ident: str, n: int, width: int = 1_000_000) -> DataFrame:
    """Runs of at least n consecutive identifiers per key (gaps and islands).

    Islands are found inside (key, identifier bucket) and those touching a bucket
    edge are merged afterwards; at most two per bucket take part in the merge.
    """
    ids = requests.select(key, ident).distinct().withColumn("_b", int_bucket(F.col(ident), width))
    w = W.partitionBy(key, "_b").orderBy(ident)
    local = ids.withColumn("_i", F.col(ident) - F.row_number().over(w)).groupBy(key, "_b", "_i").agg(
        F.min(ident).alias("first"), F.max(ident).alias("last")
    )
    low, high = F.col("_b") * width, (F.col("_b") + 1) * width - 1
    edge = (F.col("first") == low) | (F.col("last") == high)
    chain = W.partitionBy(key).orderBy("first")
    prior = F.lag("last").over(chain)
    starts = F.when(prior == F.col("first") - 1, 0).otherwise(1)
    merged = (
        local.where(edge)
        .withColumn("_s", starts)
        .withColumn("_g", F.sum("_s").over(chain.rowsBetween(W.unboundedPreceding, 0)))
        .groupBy(key, "_g")
        .agg(F.min("first").alias("first"), F.max("last").alias("last"))
    )
    out = local.where(~edge).select(key, "first", "last").unionByName(merged.select(key, "first", "last"))
    return out.withColumn("length", F.col("last") - F.col("first") + 1).where(F.col("length") >= n)


def beacons(events: DataFrame, key: str, ts: str, tie: str, min_gaps: int = 3) -> DataFrame:
    """Regularity of inter-arrival times per key, ranked from the most regular.

    ``percent_rank`` and the quartile come from a range-partitioned rank over all keys.
    """
    us = F.unix_micros(F.col(ts).cast("timestamp"))
    src = events.select(key, F.col(tie), us.alias("_us"))
    gaps = carry_last(src, [key], ["_us", tie], None, {"_prev": F.col("_us")}, inclusive=False)
    gap = (F.col("_us") - F.col("_prev")) / F.lit(1_000_000.0)
    stats = (
        gaps.where(F.col("_prev").isNotNull())
        .groupBy(key)
        .agg(F.count("*").alias("gaps"), F.avg(gap).alias("_mean"), F.stddev(gap).alias("_sd"))
        .where((F.col("gaps") >= min_gaps) & (F.col("_mean") > 0))
        .select(
            key, "gaps", F.round("_mean", 3).alias("mean_gap"),
            F.round(F.col("_sd") / F.col("_mean"), 6).alias("cv"),
        )
    )
    ranked = global_order(stats, ["cv", key])
    lowest = ranked.groupBy(F.col("cv").alias("_cv")).agg(F.min("index").alias("_rk"))
    placed = ranked.join(lowest, F.col("cv").eqNullSafe(F.col("_cv")))
    placed = placed.withColumn("_n", ranked.agg(F.max("index")).scalar())
    n, i = F.col("_n"), F.col("index")
    small, extra = F.floor(n / 4), n % 4
    cut = extra * (small + 1)
    quartile = F.when(i <= cut, F.floor((i - 1) / (small + 1)) + 1).otherwise(
        extra + F.floor(F.try_divide(i - cut - 1, small)) + 1
    )
    return placed.select(
        key, "gaps", "mean_gap", "cv",
        F.round(F.coalesce(F.try_divide(F.col("_rk") - 1, n - 1), F.lit(0.0)), 6).alias("pct"),
        quartile.cast("bigint").alias("quartile"),
    )


def outliers(events: DataFrame, key: str, value: str, z: float) -> DataFrame:
    """Values more than z standard deviations above the key's mean.

    Statistics are one small row per key, joined back: the rows of a hot key stay
    where they are or are split by the skew join, unlike in a window.
    """
    stats = events.groupBy(F.col(key).alias("_k")).agg(F.avg(value).alias("_mean"), F.stddev(value).alias("_sd"))
    score = F.round(F.try_divide(F.col(value) - F.col("_mean"), F.col("_sd")), 4)
    return (
        events.join(stats, events[key] == F.col("_k"))
        .withColumn("score", score)
        .where(F.col("score") > z)
        .select(*events.columns, "score")
    )


def sessions(events: DataFrame, key: str, ts: str, tie: str, gap_us: int) -> DataFrame:
    """Activity sessions per key: a pause of ``gap_us`` or more starts a new one.

    The batch form of a session window; a hot key is cut into parts of about equal numbers of rows.
    """
    us = F.unix_micros(F.col(ts).cast("timestamp"))
    src = events.select(key, F.col(tie), us.alias("_us"))
    seen = carry_last(src, [key], ["_us", tie], None, {"_prev": F.col("_us")}, inclusive=False)
    starts = F.when(F.col("_prev").isNull() | (F.col("_us") - F.col("_prev") >= gap_us), 1).otherwise(0)
    numbered = ranged_sums(seen, [key], ["_us", tie], {"_s": starts})
    return numbered.groupBy(key, "_s").agg(
        F.min("_us").alias("start_us"), (F.max("_us") + gap_us).alias("end_us"), F.count("*").alias("n")
    ).drop("_s")
