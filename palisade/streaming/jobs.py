"""Structured Streaming jobs over event files, each with a batch twin in the tests.

Sinks are parquet folders below the shared folder; nothing is gathered on the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from palisade.operators.changes import apply_changes
from palisade.session import cut_lineage, scratch_path


def run_to_parquet(stream: DataFrame, name: str, mode: str = "append", base: str | None = None) -> DataFrame:
    """Run a stream over what is available, into parquet, and read the result.

    With the ``base`` of an earlier run the stream goes on from its checkpoint.
    """
    spark = stream.sparkSession
    base = base or scratch_path(spark, name)
    writer = stream.writeStream.trigger(availableNow=True).option("checkpointLocation", f"{base}/checkpoint")
    if mode == "append":
        query = writer.format("parquet").outputMode("append").option("path", f"{base}/out").start()
    else:
        def keep(batch: DataFrame, _: int) -> None:
            # Complete mode: each batch is the whole result, so it replaces the last.
            batch.write.mode("overwrite").parquet(f"{base}/out")

        query = writer.outputMode(mode).foreachBatch(keep).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{base}/out")


def tumbling_counts(events: DataFrame, width: str = "1 hour", late: str = "1 hour") -> DataFrame:
    return (
        events.withWatermark("ts", late)
        .groupBy(F.window("ts", width).alias("w"), "event_type")
        .agg(F.count("*").alias("n"))
        .select(F.col("w.start").alias("window_start"), "event_type", "n")
    )


def sliding_rate(events: DataFrame, width: str = "1 hour", slide: str = "15 minutes", floor: int = 2, late: str = "1 hour") -> DataFrame:
    """Users at or above ``floor`` events in a sliding window."""
    return (
        events.withWatermark("ts", late)
        .groupBy(F.window("ts", width, slide).alias("w"), "user_id")
        .agg(F.count("*").alias("n"))
        .where(F.col("n") >= floor)
        .select(F.col("w.start").alias("window_start"), "user_id", "n")
    )


def session_counts(events: DataFrame, gap: str = "6 hours", late: str = "1 hour") -> DataFrame:
    return (
        events.withWatermark("ts", late)
        .groupBy(F.session_window("ts", gap).alias("w"), "user_id")
        .agg(F.count("*").alias("n"))
        .select("user_id", F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "n")
    )


def deduplicate(events: DataFrame, key: str = "event_id", late: str = "1 hour") -> DataFrame:
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark([key])


def enrich(events: DataFrame, static: DataFrame, on: Column, columns: list[str]) -> DataFrame:
    """Stream–static join; the size of the static side decides the join at run time."""
    return events.join(static, on, "left").select(*columns)


def interval_join(a: DataFrame, b: DataFrame, key: str, delta_us: int, late: str = "2 hours", how: str = "inner") -> DataFrame:
    """Pairs of one key with ``a.ts <= b.ts <= a.ts + delta``.

    The state is held by (key, time bucket of width delta): a b row visits its own bucket and the one before, so each pair meets
    once, a hot key is spread over time, and a row is compared with rows of two buckets only.
    """
    bucket = lambda ts: F.expr(f"unix_micros({ts}) DIV {delta_us}")
    left = a.select(F.col(key).alias("a_key"), F.col("ts").alias("a_ts"), F.col("event_id").alias("a_id"), bucket("ts").alias("a_bucket")).withWatermark("a_ts", late)
    right = b.select(F.col(key).alias("b_key"), F.col("ts").alias("b_ts"), F.col("event_id").alias("b_id"),
                     F.explode(F.array(bucket("ts"), bucket("ts") - 1)).alias("b_bucket")).withWatermark("b_ts", late)
    cond = F.expr(f"a_key = b_key AND a_bucket = b_bucket AND b_ts >= a_ts AND b_ts <= a_ts + INTERVAL {delta_us // 1_000_000} SECONDS")
    return left.join(right, cond, {"inner": "inner", "left": "leftOuter"}[how]).drop("a_bucket", "b_bucket")


def token_replay(events: DataFrame, token: Column, width: str = "2 hours", slide: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """Tokens that a second actor uses within a window: the actor who used it first, and all uses.

    The state of a token in a window is its first and its smallest and largest actor, whatever the number of uses; it goes with the
    watermark. Uses at most ``width`` - ``slide`` apart always share a window.
    """
    seen = events.withWatermark("ts", late).groupBy(F.window("ts", width, slide).alias("w"), token.alias("token")).agg(
        F.min_by("user_id", F.struct("ts", "event_id")).alias("owner"), F.min("user_id").alias("_a"), F.max("user_id").alias("_b"), F.count("*").alias("uses"))
    return seen.where((F.col("_a") != F.col("_b")) & F.col("token").isNotNull()).select(F.col("w.start").alias("window_start"), "token", "owner", "uses")


ALARM = "user_id bigint, event_id bigint, first_error bigint, second_error bigint"


def failures_then_success(events: DataFrame, delta_us: int = 3_600_000_000, late: str = "1 hour") -> DataFrame:
    """Two errors of a user within delta, then a signup within delta of the second.

    State per user: the times of the last two errors and the events still newer
    than the watermark, so that disorder inside the allowed lateness does no harm.
    Expired state is dropped by an event-time timer.
    """

    def step(key: tuple, chunks: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        (user,) = key
        older, newer, times, ids, kinds = state.get if state.exists else (0, 0, [], [], [])
        pending = list(zip(times, ids, kinds, strict=True))
        for pdf in chunks:
            pending += zip(pdf["us"].tolist(), pdf["event_id"].tolist(), pdf["event_type"].tolist(), strict=True)
        ready_until = state.getCurrentWatermarkMs() * 1000
        pending.sort()
        out = []
        rest = [p for p in pending if p[0] >= ready_until]
        for us, event_id, kind in (p for p in pending if p[0] < ready_until):
            if kind == "error":
                older, newer = newer, us
            elif older and newer - older <= delta_us and us - newer <= delta_us:
                out.append((user, event_id, older, newer))
        if rest or newer > ready_until - delta_us:
            state.update((older, newer, [p[0] for p in rest], [p[1] for p in rest], [p[2] for p in rest]))
            wake = (rest[0][0] if rest else newer + delta_us) // 1000 + 1
            state.setTimeoutTimestamp(max(wake, ready_until // 1000 + 1))
        else:
            state.remove()
        if out:
            yield pd.DataFrame(out, columns=["user_id", "event_id", "first_error", "second_error"])

    useful = events.where(F.col("event_type").isin("error", "signup")).withWatermark("ts", late)
    return (
        useful.withColumn("us", F.unix_micros("ts"))
        .select("user_id", "ts", "us", "event_id", "event_type")
        .groupBy("user_id")
        .applyInPandasWithState(
            step, ALARM, "older bigint, newer bigint, times array<bigint>, ids array<bigint>, kinds array<string>",
            "append", "EventTimeTimeout",
        )
    )


def fold_changes(spark: SparkSession, requests: DataFrame, start: DataFrame, values: dict[str, Column], name: str = "fold",
                 parts: int = 64, key: str = "id") -> DataFrame:
    """Fold a stream of change requests into a state table, touching only the parts that a batch's keys fall into.

    The state is partitioned by the hash of the key. A batch reads the parts of its keys (the filter prunes folders), folds, and
    overwrites these parts and no others. Folding a batch once more changes nothing, since the last write, removal and creation of
    a key decide, so a batch that is repeated after a failure leaves the same state.
    """
    base = scratch_path(spark, name)
    path, part = f"{base}/state", F.pmod(F.hash(F.col(key)), F.lit(parts)).alias("part")
    start.select("*", part).write.partitionBy("part").parquet(path)
    schema = StructType([*start.schema.fields, StructField("part", IntegerType())])

    def state() -> DataFrame:
        return spark.read.schema(schema).parquet(path).where(F.col(key).isNotNull())

    def fold(batch: DataFrame, _: int) -> None:
        batch = cut_lineage(batch)
        touched = [r.part for r in batch.where(F.col(key).isNotNull()).select(part).distinct().collect()]  # at most ``parts`` numbers
        if not touched:
            return
        before = state().where(F.col("part").isin(touched)).drop("part")
        after, _ = apply_changes(before, batch, values)
        # Written apart first: the parts that are read are the ones that are overwritten. A row without a key stands in
        # each of them, so that a part whose last entity went is overwritten, too.
        marks = spark.createDataFrame([(p,) for p in touched], "part int")
        after = cut_lineage(after.select("*", part).unionByName(marks, allowMissingColumns=True))
        after.write.partitionBy("part").option("partitionOverwriteMode", "dynamic").mode("overwrite").parquet(path)

    query = (
        requests.writeStream.trigger(availableNow=True)
        .option("checkpointLocation", f"{base}/checkpoint")
        .foreachBatch(fold)
        .start()
    )
    query.awaitTermination()
    return state().drop("part")
