"""Mergeable summaries: stored per day and key, merged over days, and candidates for exact counts.

A summary is one small row, whatever it summarises; days are added by merging rows, without a second pass over the events.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palisade.session import cut_lineage

SIGMAS = 3


def daily_actors(events: DataFrame, day: Column, key: str, actor: str, lg: int = 12) -> DataFrame:
    """Written table (day, key, n, sketch): a distinct-count sketch of 2^lg registers per day and key."""
    return cut_lineage(events.groupBy(day.alias("day"), key).agg(F.count("*").alias("n"), F.hll_sketch_agg(actor, lg).alias("sketch")))


def merged_actors(daily: DataFrame, key: str, lg: int = 12) -> DataFrame:
    """(key, days, n, actors, low, high): the estimate over all stored days, and the bounds that hold in 997 of 1,000 cases.

    Small counts are held exactly by the sketch; the bounds are those of a full one.
    """
    error = SIGMAS * 1.04 / math.sqrt(1 << lg)
    merged = daily.groupBy(key).agg(
        F.count_distinct("day").alias("days"), F.sum("n").alias("n"), F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("actors"))
    return merged.select(
        key, "days", "n", "actors", F.floor(F.col("actors") / (1 + error)).cast("bigint").alias("low"), F.ceil(F.col("actors") / (1 - error)).cast("bigint").alias("high"))


def quantile_sketches(values: DataFrame, part: Column, key: str, value: Column, k: int = 200) -> DataFrame:
    """Written table (part, key, sketch) of quantile sketches of whole numbers; up to k values are held exactly."""
    return cut_lineage(values.groupBy(part.alias("part"), key).agg(F.kll_sketch_agg_bigint(value.cast("bigint"), k).alias("sketch")))


def merged_quantiles(parts: DataFrame, key: str, at: dict[str, float], k: int = 200) -> DataFrame:
    """(key, n, quantiles by name): the smallest value that the share ``at`` of all values does not exceed."""
    merged = parts.groupBy(key).agg(F.kll_merge_agg_bigint("sketch", k).alias("s"))
    return merged.select(key, F.kll_sketch_get_n_bigint("s").alias("n"), *[F.kll_sketch_get_quantile_bigint("s", F.lit(q)).alias(name) for name, q in at.items()])


def heavy_hitters(rows: DataFrame, item: Column, share: float, by: Sequence[str] = ()) -> DataFrame:
    """(by…, item, n, total): the items that make up at least ``share`` of the rows (of each ``by``), counted exactly.

    A frequent-item sketch per group tracks eight times as many items as can qualify. Its error is below half of the threshold, so
    no item that qualifies is missing among its first 2 / share; these candidates alone are counted in a second, narrow pass.
    Nulls are no items.
    """
    able = math.ceil(1 / share)
    src = rows.select(*by, item.alias("item")).where(F.col("item").isNotNull())
    groups = src.groupBy(*by).agg(F.count("*").alias("total"), F.expr(f"approx_top_k_accumulate(item, {8 * able})").alias("_s"))
    candidates = groups.select(*by, "total", F.explode(F.expr(f"approx_top_k_estimate(_s, {2 * able})")["item"]).alias("item"))
    candidates = cut_lineage(candidates)
    # Without groups the candidates are at most 2 / share rows.
    met = src.join(candidates if by else F.broadcast(candidates), [*by, "item"])
    counted = met.groupBy(*by, "item").agg(F.count("*").alias("n"), F.max("total").alias("total"))
    return counted.where(F.col("n") >= F.lit(share) * F.col("total"))
