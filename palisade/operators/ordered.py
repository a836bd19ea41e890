"""Ordered computations that survive a hot key.

A plain ``Window.partitionBy(key)`` sends all rows of a key to one task. The
helpers here cut the order axis into buckets, work inside (key, bucket), and
carry one small row per bucket forward. Results equal the plain window.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from palisade.session import cut_lineage

HOUR_US = 3_600_000_000
NESTED = 1000  # items of one key that share a row
DAY_US = 24 * HOUR_US


def int_bucket(x: Column, width: int) -> Column:
    """floor(x / width) in exact integer arithmetic."""
    return F.call_function("div", x - F.pmod(x, F.lit(width)), F.lit(width)).cast("bigint")


def time_bucket(ts: Column | str, width_us: int = DAY_US) -> Column:
    ts = F.col(ts) if isinstance(ts, str) else ts
    return int_bucket(F.unix_micros(ts.cast("timestamp")), width_us)


def seq_bucket(seq: Column | str, width: int = 1_000_000) -> Column:
    return int_bucket(F.col(seq) if isinstance(seq, str) else seq, width)


def carry_last(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    bucket: Column | None,
    values: dict[str, Column],
    inclusive: bool = True,
    partitions: int | None = None,
) -> DataFrame:
    """Add, per name in ``values``, the last non-null value at or before the row.

    ``inclusive=False`` looks strictly before the row. ``bucket`` must not
    decrease along ``order``; without one the rows are cut into parts of about
    equal numbers of rows, so a key with most rows of any moment is many parts.
    """
    end = 0 if inclusive else -1
    local = W.partitionBy(*keys, "_b").orderBy(*order).rowsBetween(W.unboundedPreceding, end)
    src = df.select("*", *[value.alias(f"_v_{name}") for name, value in values.items()])
    src = _ranged(src, [*keys, *order], partitions).withColumnRenamed("_part", "_b") if bucket is None else src.withColumn("_b", bucket)
    ranked = F.struct(*[F.col(c) for c in order])
    per_bucket = src.groupBy(*keys, "_b").agg(
        *[F.max_by(f"_v_{n}", F.when(F.col(f"_v_{n}").isNotNull(), ranked)).alias(f"_l_{n}") for n in values]
    )
    before = W.partitionBy(*keys).orderBy("_b").rowsBetween(W.unboundedPreceding, -1)
    carry = per_bucket.select(
        *keys, "_b", *[F.last(f"_l_{n}", ignorenulls=True).over(before).alias(f"_c_{n}") for n in values]
    )
    out = src
    for name in values:
        out = out.withColumn(f"_p_{name}", F.last(f"_v_{name}", ignorenulls=True).over(local))
    cond = [out[k].eqNullSafe(carry[k]) for k in [*keys, "_b"]]
    joined = out.join(carry, cond, "left")
    return joined.select(
        *[out[c] for c in df.columns],
        *[F.coalesce(F.col(f"_p_{n}"), F.col(f"_c_{n}")).alias(n) for n in values],
    )


def running_sum(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    bucket: Column,
    values: dict[str, Column],
) -> DataFrame:
    """Add running totals (row included) per key along ``order``."""
    src = df.withColumn("_b", bucket)
    for name, value in values.items():
        src = src.withColumn(f"_v_{name}", value)
    local = W.partitionBy(*keys, "_b").orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    per_bucket = src.groupBy(*keys, "_b").agg(*[F.sum(f"_v_{n}").alias(f"_t_{n}") for n in values])
    before = W.partitionBy(*keys).orderBy("_b").rowsBetween(W.unboundedPreceding, -1)
    carry = per_bucket.select(
        *keys, "_b", *[F.coalesce(F.sum(f"_t_{n}").over(before), F.lit(0)).alias(f"_c_{n}") for n in values]
    )
    out = src
    for name in values:
        out = out.withColumn(f"_p_{name}", F.sum(f"_v_{name}").over(local))
    cond = [out[k].eqNullSafe(carry[k]) for k in [*keys, "_b"]]
    return out.join(carry, cond).select(
        *[out[c] for c in df.columns], *[(F.col(f"_p_{n}") + F.col(f"_c_{n}")).alias(n) for n in values]
    )


def _ranged(df: DataFrame, order: Sequence[str], partitions: int | None = None) -> DataFrame:
    """Range-partition along ``order`` and write out, with the partition number as a stored column."""
    # Without a number, small neighbouring ranges are merged at run time.
    ranged = df.repartitionByRange(partitions, *order) if partitions else df.repartitionByRange(*order)
    return cut_lineage(ranged.withColumn("_part", F.spark_partition_id()))


def global_order(df: DataFrame, order: Sequence[str], totals: dict[str, Column] | None = None,
                 partitions: int | None = None) -> DataFrame:
    """Number all rows 1..n along ``order`` without an unpartitioned window.

    Rows are range-partitioned and written out, so that the partition number is
    a stored value; per-partition counts (one row per partition) give the offsets.
    Adds ``index`` (1-based), ``rank`` (ties share the lowest index) and, per name
    in ``totals``, the running total up to and including the row.
    """
    totals = totals or {}
    src = df
    for name, value in totals.items():
        src = src.withColumn(f"_v_{name}", value)
    fixed = _ranged(src, order, partitions)
    local = W.partitionBy("_part").orderBy(*order)
    so_far = local.rowsBetween(W.unboundedPreceding, 0)
    counts = fixed.groupBy("_part").agg(
        F.count("*").alias("_n"), *[F.sum(f"_v_{t}").alias(f"_s_{t}") for t in totals]
    )
    # One row per range partition: an unpartitioned window is safe here, and so is the broadcast below.
    before = W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    offsets = counts.select(
        "_part",
        F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"),
        *[F.coalesce(F.sum(f"_s_{t}").over(before), F.lit(0)).alias(f"_o_{t}") for t in totals],
    )
    out = (
        fixed.withColumn("_rn", F.row_number().over(local))
        .withColumn("_rk", F.rank().over(local))
        .select("*", *[F.sum(f"_v_{t}").over(so_far).alias(f"_r_{t}") for t in totals])
        .join(F.broadcast(offsets), "_part")
    )
    return out.select(
        *df.columns,
        (F.col("_off") + F.col("_rn")).alias("index"),
        (F.col("_off") + F.col("_rk")).alias("rank"),
        *[(F.col(f"_o_{t}") + F.col(f"_r_{t}")).alias(t) for t in totals],
    )


def ranged_sums(df: DataFrame, keys: Sequence[str], order: Sequence[str], values: dict[str, Column], partitions: int | None = None) -> DataFrame:
    """``running_sum`` in parts of about equal numbers of rows: a key with most of the rows, at any moment, is many parts."""
    placed = running_sum(_ranged(df, [*keys, *order], partitions), keys, order, F.col("_part"), values)
    return placed.select(*df.columns, *values)


def positions(df: DataFrame, keys: Sequence[str], order: Sequence[str], name: str = "pos") -> DataFrame:
    """0-based position of every row within its key along ``order``, whatever the key's size."""
    placed = ranged_sums(df, keys, order, {"_nth": F.lit(1).cast("bigint")})
    return placed.select(*df.columns, (F.col("_nth") - 1).alias(name))


def nested(df: DataFrame, keys: Sequence[str], order: Sequence[str], item: Column, chunk: int = NESTED) -> DataFrame:
    """Rows as arrays of at most ``chunk`` items: (keys…, part, items), in order.

    Item i of a key is element i % chunk of part i // chunk, so a key of any size
    becomes rows of bounded size.
    """
    placed = positions(df, keys, order).withColumn("part", int_bucket(F.col("pos"), chunk))
    pairs = F.array_sort(F.collect_list(F.struct(F.col("pos"), item.alias("item"))))
    return placed.groupBy(*keys, "part").agg(F.transform(pairs, lambda p: p["item"]).alias("items"))
