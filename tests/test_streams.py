from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from palisade.operators.changes import apply_changes
from palisade.sources.streams import read_stream
from palisade.streaming import jobs as J


@pytest.mark.parametrize("parts", [1, 16])
def test_fold_over_many_batches_equals_one_batch(spark, sf, tmp_path, parts):
    events = spark.read.parquet(f"{sf}/events.parquet")
    edges = [0, 200, 450, 500, 800, 10**9]
    for n, (lo, hi) in enumerate(zip(edges, edges[1:], strict=False)):
        events.where((F.col("event_id") >= lo) & (F.col("event_id") < hi)).coalesce(1).write.parquet(str(tmp_path / "in" / f"part{n}"))
    m = F.col("event_type")
    method = F.when(m == "signup", "POST").when(m == "click", "PUT").when(m == "error", "DELETE").otherwise("GET")

    def requests(df):
        return df.select(
            F.col("event_id").alias("req_id"), F.col("event_id").alias("seq"), method.alias("method"), F.col("user_id").alias("id"),
            F.when(method.isin("PUT", "POST"), F.concat(F.lit("n"), F.col("event_id").cast("string"))).alias("new_name"),
        )

    start = spark.range(8).select("id", F.lit("old").alias("name"), F.lit("keep").alias("note"))
    values = {"name": F.col("new_name")}
    feed = requests(read_stream(spark, str(tmp_path / "in" / "*"), files_per_trigger=1))
    got = J.fold_changes(spark, feed, start, values, parts=parts)
    want, _ = apply_changes(start, requests(events), values)
    rows = lambda df: sorted(map(tuple, df.collect()))
    assert rows(got) == rows(want) and got.count() > 0


def test_stateful_alarms_over_many_batches(spark, tmp_path):
    hour = 3600
    data = [
        # user 1: two failures and a success in time, spread over batches
        (1, 1, "error", 1000), (2, 1, "error", 2000), (3, 1, "signup", 3000),
        # user 2: the failures are too far apart
        (4, 2, "error", 1000), (5, 2, "error", 1000 + 2 * hour), (6, 2, "signup", 1100 + 2 * hour),
        # the clock moves on, so that all above is decided
        (7, 3, "signup", 40 * hour), (8, 3, "signup", 41 * hour),
    ]
    schema = "event_id long, user_id long, event_type string, s long"
    for n, part in enumerate([data[:2], data[2:5], data[5:7], data[7:]]):
        rows = spark.createDataFrame(part, schema).select(
            "event_id", F.timestamp_seconds("s").cast("timestamp_ntz").alias("ts"), "user_id", "event_type",
            F.lit(1.0).alias("value"), F.lit("{}").alias("props"),
        )
        rows.coalesce(1).write.parquet(str(tmp_path / "in" / f"part{n}"))
    feed = read_stream(spark, str(tmp_path / "in" / "*"), files_per_trigger=1)
    got = J.run_to_parquet(J.failures_then_success(feed), "alarms").collect()
    assert [tuple(r) for r in got] == [(1, 3, 1_000_000_000, 2_000_000_000)]
