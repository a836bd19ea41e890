"""Streams over the event files, each with a batch twin as oracle."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palisade.operators.windows import sessions
from palisade.plans.catalog import query
from palisade.plans.changes import FOLD_STATE
from palisade.session import scratch_path
from palisade.sources.streams import read_stream
from palisade.sources.tables import Tables
from palisade.streaming import jobs as J


def stream(t: Tables) -> DataFrame:
    return read_stream(t.spark, t.dir, glob="events.parquet")


# What an append-mode stream has emitted in the end: windows closed by the last watermark (millisecond precision).
MARK = "(SELECT (max(epoch_us(ts)) // 1000) * 1000 - 3600000000 FROM events)"


@query("s10_stream_read", "SELECT event_id, user_id, event_type FROM events")
def s10(t: Tables) -> DataFrame:
    return J.run_to_parquet(stream(t).select("event_id", "user_id", "event_type"), "s10")


@query(
    "t1_tumbling",
    f"SELECT epoch_us(time_bucket(INTERVAL 1 HOUR, ts)) AS start_us, event_type, count(*) AS n FROM events GROUP BY 1, 2 HAVING start_us + 3600000000 <= {MARK}",
)
def t1(t: Tables) -> DataFrame:
    out = J.run_to_parquet(J.tumbling_counts(stream(t)), "t1")
    return out.select(F.unix_micros("window_start").alias("start_us"), "event_type", "n")


@query(
    "t1_tumbling_complete",
    "SELECT epoch_us(time_bucket(INTERVAL 1 HOUR, ts)) AS start_us, event_type, count(*) AS n FROM events GROUP BY 1, 2",
)
def t1_complete(t: Tables) -> DataFrame:
    out = J.run_to_parquet(J.tumbling_counts(stream(t)), "t1c", "complete")
    return out.select(F.unix_micros("window_start").alias("start_us"), "event_type", "n")


@query(
    "t2_sliding",
    "WITH s AS (SELECT user_id, epoch_us(time_bucket(INTERVAL 15 MINUTE, ts)) - k * CAST(900000000 AS BIGINT) AS start_us FROM events, (VALUES (0), (1), (2), (3)) v(k)) "
    f"SELECT start_us, user_id, count(*) AS n FROM s GROUP BY 1, 2 HAVING count(*) >= 2 AND start_us + 3600000000 <= {MARK}",
)
def t2(t: Tables) -> DataFrame:
    out = J.run_to_parquet(J.sliding_rate(stream(t)), "t2")
    return out.select(F.unix_micros("window_start").alias("start_us"), "user_id", "n")


_SESSIONS = (
    "WITH g AS (SELECT user_id, epoch_us(ts) AS us, CASE WHEN lag(ts) OVER w IS NULL OR ts - lag(ts) OVER w >= INTERVAL 6 HOUR THEN 1 ELSE 0 END AS s FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)), "
    "h AS (SELECT user_id, us, sum(s) OVER (PARTITION BY user_id ORDER BY us ROWS UNBOUNDED PRECEDING) AS k FROM g) "
    "SELECT user_id, min(us) AS start_us, max(us) + 21600000000 AS end_us, count(*) AS n FROM h GROUP BY user_id, k"
)


@query("t3_sessions", f"SELECT * FROM ({_SESSIONS}) WHERE end_us <= {MARK}")
def t3(t: Tables) -> DataFrame:
    out = J.run_to_parquet(J.session_counts(stream(t)), "t3")
    return out.select("user_id", F.unix_micros("session_start").alias("start_us"), F.unix_micros("session_end").alias("end_us"), "n")


@query("t3_sessions_batch", _SESSIONS)
def t3_batch(t: Tables) -> DataFrame:
    return sessions(t.events_utc, "user_id", "ts", "event_id", 6 * 3_600_000_000)


@query(
    "t4_late",
    f"SELECT epoch_us(time_bucket(INTERVAL 1 HOUR, ts)) AS start_us, event_type, count(*) AS n FROM events GROUP BY 1, 2 HAVING start_us + 3600000000 <= {MARK}",
)
def t4(t: Tables) -> DataFrame:
    """The events, a heartbeat, then the first day's purchases again: those are too late to count.

    Rows are judged by the watermark of the batch before, so the heartbeat makes the first one count.
    """
    e = t.events.withColumn("_d", F.date_format("ts", "yyyy-MM-dd"))
    ends = e.agg(F.min("_d").alias("_first"), F.max("ts").alias("_last"))  # one row
    late = e.where("event_type = 'purchase'").join(F.broadcast(ends), F.col("_d") == F.col("_first"), "left_semi")
    beat = ends.selectExpr("-1L AS event_id", "_last AS ts", "-1L AS user_id", "'heartbeat' AS event_type", "0D AS value", "'' AS props")
    folder, base = scratch_path(t.spark, "late"), scratch_path(t.spark, "t4")
    for name, rows in (("a", t.events), ("b", beat), ("c", late.select(*t.events.columns))):
        rows.write.parquet(f"{folder}/{name}")
        # Each arrival is one run that goes on from the checkpoint of the last.
        out = J.run_to_parquet(J.tumbling_counts(read_stream(t.spark, f"{folder}/*")), "t4", base=base)
    return out.where("event_type <> 'heartbeat'").select(F.unix_micros("window_start").alias("start_us"), "event_type", "n")


@query("t5_dedup", "SELECT event_id, user_id, event_type FROM events")
def t5(t: Tables) -> DataFrame:
    """Every purchase is sent twice; within the watermark one copy passes."""
    feed = stream(t)
    copies = F.when(F.col("event_type") == "purchase", F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
    twice = feed.withColumn("copy", F.explode(copies))
    return J.run_to_parquet(J.deduplicate(twice).select("event_id", "user_id", "event_type"), "t5")


@query(
    "t6_stateful",
    "WITH e AS (SELECT user_id, event_id, event_type, epoch_us(ts) AS us, lag(epoch_us(ts)) OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS prev FROM events WHERE event_type IN ('error', 'signup')), "
    "a AS (SELECT *, last_value(CASE WHEN event_type = 'error' THEN {'us': us, 'prev': prev} END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY us, event_id ROWS UNBOUNDED PRECEDING) AS l FROM e) "
    "SELECT user_id, event_id, l.prev AS first_error, l.us AS second_error FROM a WHERE event_type = 'signup' AND l.us - l.prev <= 86400000000 AND us - l.us <= 86400000000 "
    "AND us < (SELECT (max(us) // 1000) * 1000 - 3600000000 FROM e)",
)
def t6(t: Tables) -> DataFrame:
    return J.run_to_parquet(J.failures_then_success(stream(t), 24 * 3_600_000_000), "t6")


@query(
    "t7_enrich",
    "SELECT event_id, user_id, c_mktsegment AS segment, event_type FROM events LEFT JOIN customer ON user_id = c_custkey",
)
def t7(t: Tables) -> DataFrame:
    static = t.customer.select("c_custkey", F.col("c_mktsegment").alias("segment"))
    feed = stream(t).drop("value", "props")
    out = J.enrich(feed, static, F.col("user_id") == F.col("c_custkey"), ["event_id", "user_id", "segment", "event_type"])
    return J.run_to_parquet(out, "t7")


@query("t8_foreach_batch", FOLD_STATE)
def t8(t: Tables) -> DataFrame:
    k = F.get_json_object("props", "$.k")
    m = F.col("event_type")
    method = F.when(m == "signup", "POST").when(m == "click", "PUT").when(m == "error", "DELETE").otherwise("GET")
    raw = F.when(F.col("value") < 1, "abc").otherwise((F.col("user_id") * 11).cast("string"))
    requests = stream(t).select(
        F.col("event_id").alias("req_id"), F.col("event_id").alias("seq"), method.alias("method"), raw.try_cast("bigint").alias("id"),
        F.when(method.isin("PUT", "POST"), F.concat(F.lit("u"), k)).alias("new_name"),
    )
    return J.fold_changes(t.spark, requests, t.users.select("id", "name", "email"), {"name": F.col("new_name")})


@query(
    "t9_stream_join",
    "SELECT a.event_id AS a_id, b.event_id AS b_id, a.user_id FROM events a JOIN events b ON a.user_id = b.user_id "
    "AND a.event_type = 'error' AND b.event_type = 'purchase' AND b.ts >= a.ts AND b.ts <= a.ts + INTERVAL 1 HOUR",
)
def t9(t: Tables) -> DataFrame:
    feed = stream(t)
    out = J.interval_join(feed.where("event_type = 'error'"), stream(t).where("event_type = 'purchase'"), "user_id", 3_600_000_000)
    return J.run_to_parquet(out.select("a_id", "b_id", F.col("a_key").alias("user_id")), "t9")


@query(
    "t9_stream_left_join",
    "SELECT a.event_id AS a_id, b.event_id AS b_id, a.user_id FROM events a LEFT JOIN events b ON a.user_id = b.user_id AND b.event_type = 'purchase' "
    "AND b.ts >= a.ts AND b.ts <= a.ts + INTERVAL 1 HOUR WHERE a.event_type = 'error' AND (b.event_id IS NOT NULL OR epoch_us(a.ts) + 3600000000 < "
    "least((SELECT max(epoch_us(ts)) // 1000 * 1000 FROM events WHERE event_type = 'error'), (SELECT max(epoch_us(ts)) // 1000 * 1000 FROM events WHERE event_type = 'purchase')) - 7200000000)",
)
def t9_left(t: Tables) -> DataFrame:
    """Outer rows appear once the watermark rules out a later partner."""
    out = J.interval_join(stream(t).where("event_type = 'error'"), stream(t).where("event_type = 'purchase'"), "user_id", 3_600_000_000, how="left")
    return J.run_to_parquet(out.select("a_id", "b_id", F.col("a_key").alias("user_id")), "t9l")


@query(
    "d11_token_replay",
    "WITH s AS (SELECT json_extract_string(props, '$.k') AS token, user_id, ts, event_id, epoch_us(time_bucket(INTERVAL 1 HOUR, ts)) - k * CAST(3600000000 AS BIGINT) AS start_us FROM events, (VALUES (0), (1)) v(k)) "
    "SELECT start_us, token, arg_min(user_id, (ts, event_id)) AS owner, count(*) AS uses FROM s WHERE token IS NOT NULL GROUP BY 1, 2 "
    f"HAVING count(DISTINCT user_id) > 1 AND start_us + 7200000000 <= {MARK}",
)
def d11_token_replay(t: Tables) -> DataFrame:
    out = J.run_to_parquet(J.token_replay(stream(t), F.get_json_object("props", "$.k")), "replay")
    return out.select(F.unix_micros("window_start").alias("start_us"), "token", "owner", "uses")
