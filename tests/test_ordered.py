"""Bucketed computations equal plain windows, hot key included."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from palisade.operators import joins as J
from palisade.operators import windows as WN
from palisade.operators.ordered import carry_last, global_order, nested, positions, running_sum, seq_bucket
from palisade.operators.sets import except_all, intersect_all


@pytest.fixture(scope="module")
def rows(spark):
    rnd = random.Random(7)
    data = [(i, "hot" if rnd.random() < 0.5 else f"k{rnd.randrange(9)}", rnd.randrange(50), rnd.choice([None, i])) for i in range(400)]
    return spark.createDataFrame(data, "seq long, key string, n int, v long").cache()


def same(a, b):
    assert sorted(map(tuple, a.collect()), key=repr) == sorted(map(tuple, b.collect()), key=repr)


@pytest.mark.parametrize("inclusive", [True, False])
def test_carry_last(rows, inclusive):
    w = W.partitionBy("key").orderBy("seq").rowsBetween(W.unboundedPreceding, 0 if inclusive else -1)
    want = rows.select("*", F.last("v", ignorenulls=True).over(w).alias("x"))
    same(carry_last(rows, ["key"], ["seq"], seq_bucket("seq", 13), {"x": F.col("v")}, inclusive), want)


@pytest.mark.parametrize("inclusive", [True, False])
def test_carry_last_in_parts_of_equal_size(rows, inclusive):
    w = W.partitionBy("key").orderBy("seq").rowsBetween(W.unboundedPreceding, 0 if inclusive else -1)
    want = rows.select("*", F.last("v", ignorenulls=True).over(w).alias("x"))
    same(carry_last(rows, ["key"], ["seq"], None, {"x": F.col("v")}, inclusive, partitions=9), want)


def test_a_key_with_most_rows_of_one_moment(spark):
    """All rows of a key within a second: as-of and sessions cut them by number, not by the clock."""
    events = spark.range(3000).selectExpr("if(id < 2700, 1, id) AS k", "id AS i", "timestamp_micros(1700000000000000 + id * 100) AS ts")
    ranged = events.repartitionByRange(8, "k", "ts", "i").selectExpr("k", "spark_partition_id() AS p").where("k = 1").distinct()
    assert ranged.count() >= 6
    seen = J.asof(events.where("i % 3 = 0"), events.where("i % 3 <> 0"), "k", "ts", "i", {"hit": "i"})
    w = W.partitionBy("k").orderBy("ts", "i").rowsBetween(W.unboundedPreceding, 0)
    want = events.select("*", F.last(F.when(F.col("i") % 3 != 0, F.col("i")), ignorenulls=True).over(w).alias("hit")).where("i % 3 = 0")
    same(seen, want.select("k", "i", "ts", "hit"))
    assert {(r.k, r.n) for r in WN.sessions(events, "k", "ts", "i", 10_000_000).collect()} >= {(1, 2700)}


def test_running_sum(rows):
    w = W.partitionBy("key").orderBy("seq").rowsBetween(W.unboundedPreceding, 0)
    want = rows.select("*", F.sum("n").over(w).alias("x"))
    same(running_sum(rows, ["key"], ["seq"], seq_bucket("seq", 13), {"x": F.col("n")}), want)


def test_global_order(rows):
    got = global_order(rows.select("n", "seq"), ["n", "seq"], {"t": F.col("n")}, partitions=5)
    w = W.orderBy("n", "seq")
    want = rows.select(
        "n", "seq", F.row_number().over(w).alias("index"), F.rank().over(w).alias("rank"),
        F.sum("n").over(w.rowsBetween(W.unboundedPreceding, 0)).alias("t"),
    )
    same(got, want)


def test_positions_and_nested_parts(rows):
    w = W.partitionBy("key").orderBy("n", "seq")
    want = rows.select("key", "n", "seq", (F.row_number().over(w) - 1).cast("bigint").alias("pos"))
    same(positions(rows.select("key", "n", "seq"), ["key"], ["n", "seq"]), want)
    parts = nested(rows.select("key", "n", "seq"), ["key"], ["n", "seq"], F.col("seq"), chunk=7)
    assert parts.where(F.size("items") > 7).count() == 0
    flat = parts.select("key", "part", F.posexplode("items").alias("i", "seq"))
    same(flat.select("key", "seq", (F.col("part") * 7 + F.col("i")).alias("pos")), want.select("key", "seq", "pos"))


def test_burst_equals_range_window(spark):
    rnd = random.Random(3)
    data = [(i, "hot" if rnd.random() < 0.6 else "cold", 1_700_000_000 + rnd.randrange(200_000)) for i in range(300)]
    ev = spark.createDataFrame(data, "event_id long, key string, s long").select("event_id", "key", F.timestamp_seconds("s").alias("ts"))
    w = W.partitionBy("key").orderBy(F.unix_micros("ts")).rangeBetween(-3_600_000_000, 0)
    want = ev.withColumn("in_window", F.count("*").over(w)).where("in_window >= 2")
    same(WN.burst(ev, "key", "ts", 2, 3_600_000_000, "event_id"), want)


def test_enumeration_merges_over_bucket_edges(spark):
    data = [("a", i) for i in [*range(5, 38), 50, 51, *range(60, 80)]] + [("b", 9), ("b", 10), ("b", 30)]
    got = WN.enumeration(spark.createDataFrame(data, "k string, i long"), "k", "i", 2, width=10)
    assert sorted(map(tuple, got.collect())) == [("a", 5, 37, 33), ("a", 50, 51, 2), ("a", 60, 79, 20), ("b", 9, 10, 2)]


def test_interval_join_equals_brute_force(spark):
    rnd = random.Random(5)
    make = lambda n: [(i, "hot", rnd.randrange(20_000)) for i in range(n)]
    a, b = make(60), make(60)
    frame = lambda d: spark.createDataFrame(d, "event_id long, k string, s long").select("event_id", "k", F.timestamp_seconds("s").alias("ts"))
    got = J.followed_by(frame(a), frame(b), "k", "ts", 900_000_000).select("a_event_id", "b_event_id")
    want = sorted((x[0], y[0]) for x in a for y in b if x[2] <= y[2] <= x[2] + 900)
    assert sorted(map(tuple, got.collect())) == want


def test_multiset_operations(spark):
    a = spark.createDataFrame([(x,) for x in "aaabbc"], "x string")
    b = spark.createDataFrame([(x,) for x in "abbbd"], "x string")
    assert sorted(r[0] for r in except_all(a, b).collect()) == ["a", "a", "c"]
    assert sorted(r[0] for r in intersect_all(a, b).collect()) == ["a", "b", "b"]
