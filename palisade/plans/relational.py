"""Joins, aggregates and windows over business and event tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palisade.functions.text import path_template
from palisade.operators import aggs as A
from palisade.operators import joins as J
from palisade.operators import sets
from palisade.operators import sketches as SK
from palisade.operators import windows as W
from palisade.operators.ordered import nested
from palisade.plans.catalog import query
from palisade.session import tasks_for
from palisade.sources.scanner_log import segment_runs
from palisade.sources.tables import Tables

HOUR = 3_600_000_000


@query("j4_orphans", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def j4(t: Tables) -> DataFrame:
    return J.orphans(t.documents.select("doc_id"), "doc_id", t.labels, "doc_id")


_RELATIONS = [
    ("lineitem.order", "lineitem", "l_orderkey", "orders", "o_orderkey"),
    ("lineitem.part", "lineitem", "l_partkey", "part", "p_partkey"),
    ("lineitem.supplier", "lineitem", "l_suppkey", "supplier", "s_suppkey"),
    ("orders.customer", "orders", "o_custkey", "customer", "c_custkey"),
    ("customer.nation", "customer", "c_nationkey", "nation", "n_nationkey"),
    ("events.customer", "events", "user_id", "customer", "c_custkey"),
    ("events.order", "events", "event_id", "orders", "o_orderkey"),
    ("documents.label", "documents", "doc_id", "labels", "doc_id"),
]


@query(
    "j4_integrity",
    " UNION ALL ".join(
        f"SELECT '{n}' AS relation, count(*) AS rows, count(*) FILTER ({fk} NOT IN (SELECT {pk} FROM {p})) AS orphans FROM {c}"
        for n, c, fk, p, pk in _RELATIONS
    ),
)
def j4_integrity(t: Tables) -> DataFrame:
    return J.integrity({n: (getattr(t, c), fk, getattr(t, p), pk) for n, c, fk, p, pk in _RELATIONS})


@query(
    "j5_order_facts",
    "SELECT p_partkey % 25 AS category, c_mktsegment AS segment, count(*) AS lines, count(DISTINCT o_orderkey) AS orders, round(sum(l_extendedprice), 2) AS revenue "
    "FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2",
)
def j5(t: Tables) -> DataFrame:
    """Items with their order, product and user, folded per category and segment."""
    sold = t.orders.select("o_orderkey", "o_custkey").join(t.customer.select("c_custkey", "c_mktsegment"), F.col("o_custkey") == F.col("c_custkey"))
    lines = t.lineitem.select("l_orderkey", "l_partkey", "l_extendedprice").join(t.part.select("p_partkey"), F.col("l_partkey") == F.col("p_partkey"))
    # Orders are told apart within a task: a task's share of the items stays the same, whatever the table's size.
    facts = lines.repartition(tasks_for(t.lineitem), "l_orderkey").join(sold, F.col("l_orderkey") == F.col("o_orderkey"))
    return facts.groupBy((F.col("p_partkey") % 25).alias("category"), F.col("c_mktsegment").alias("segment")).agg(
        F.count("*").alias("lines"), F.count_distinct("o_orderkey").alias("orders"), F.round(F.sum("l_extendedprice"), 2).alias("revenue")
    )


_TEMPLATE = "regexp_replace(regexp_extract(url, '^[a-z]+://[^/?#]+([^?#]*)', 1), '[0-9]+', '{id}', 'g')"


@query(
    "j6_drift",
    f"SELECT coalesce(s.template, c.template) AS template, CASE WHEN c.template IS NULL THEN 'only_spec' WHEN s.template IS NULL THEN 'only_code' ELSE 'both' END AS status "
    f"FROM (SELECT DISTINCT {_TEMPLATE} AS template FROM pages WHERE url LIKE 'https://%') s "
    f"FULL JOIN (SELECT DISTINCT {_TEMPLATE} AS template FROM pages WHERE url LIKE 'http://%') c ON s.template = c.template",
)
def j6(t: Tables) -> DataFrame:
    """Templates served over https (the description) against those over http (the code)."""
    p = t.pages.select("url", path_template("url").alias("template"))
    return J.drift(p.where(F.startswith("url", F.lit("https://"))), p.where(F.startswith("url", F.lit("http://"))), ["template"])


@query(
    "j9_asof",
    "SELECT p.event_id, p.user_id, v.event_id AS view_id FROM (SELECT * FROM events WHERE event_type = 'purchase') p "
    "ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'view') v ON p.user_id = v.user_id AND p.ts >= v.ts",
)
def j9(t: Tables) -> DataFrame:
    e = t.events_utc.select("event_id", "user_id", "ts", "event_type")
    views = e.where("event_type = 'view'")
    return J.asof(e.where("event_type = 'purchase'"), views, "user_id", "ts", "event_id", {"view_id": "event_id"}).select(
        "event_id", "user_id", "view_id"
    )


@query(
    "j10_interval",
    "SELECT a.event_id AS a_event_id, b.event_id AS b_event_id, a.user_id FROM events a JOIN events b ON a.user_id = b.user_id "
    "AND a.event_type = 'error' AND b.event_type = 'purchase' AND b.ts >= a.ts AND b.ts <= a.ts + INTERVAL 1 HOUR",
)
def j10(t: Tables) -> DataFrame:
    e = t.events_utc.select("event_id", "user_id", "ts", "event_type")
    return J.followed_by(e.where("event_type = 'error'"), e.where("event_type = 'purchase'"), "user_id", "ts", HOUR).select(
        "a_event_id", "b_event_id", F.col("a_user_id").alias("user_id")
    )


@query(
    "j10_first_follower",
    "SELECT a.event_id, (SELECT arg_min(b.event_id, (b.ts, b.event_id)) FROM events b WHERE b.user_id = a.user_id AND b.event_type = 'purchase' "
    "AND b.ts >= a.ts AND b.ts <= a.ts + INTERVAL 24 HOUR) AS follower FROM events a WHERE a.event_type = 'error'",
)
def j10_first(t: Tables) -> DataFrame:
    e = t.events_utc.select("event_id", "user_id", "ts", "event_type")
    return J.first_follower(
        e.where("event_type = 'error'"), e.where("event_type = 'purchase'"), "user_id", "ts", "event_id", 24 * HOUR
    ).select("event_id", "follower")


@query(
    "j11_typosquat",
    "SELECT a.n AS name, b.n AS known, CAST(levenshtein(a.n, b.n) AS INTEGER) AS distance FROM (SELECT DISTINCT p_name AS n FROM part) a, "
    "(SELECT DISTINCT p_name AS n FROM part) b WHERE a.n <> b.n AND levenshtein(a.n, b.n) <= 2",
)
def j11(t: Tables) -> DataFrame:
    return J.similar_names(t.part, t.part, "p_name", 2)


@query("a1_order_total", "SELECT order_id, round(sum(price * quantity), 2) AS total FROM order_items GROUP BY order_id")
def a1(t: Tables) -> DataFrame:
    parts = nested(t.order_items, ["order_id"], ["id", "product_id", "quantity", "price"], F.struct("price", "quantity"))
    totals = parts.select("order_id", A.order_total(F.col("items")).alias("_part"))
    return totals.groupBy("order_id").agg(F.round(F.sum("_part"), 2).alias("total"))


@query("a2_order_total_flat", "SELECT order_id, round(sum(price * quantity), 2) AS total, count(*) AS items FROM order_items GROUP BY order_id")
def a2(t: Tables) -> DataFrame:
    return A.order_total_flat(t.order_items, "order_id", F.col("price"), F.col("quantity"))


@query("a9_distinct", "SELECT event_type, count(DISTINCT user_id) AS actors FROM events GROUP BY event_type")
def a9(t: Tables) -> DataFrame:
    return A.distinct_actors(t.events, "event_type", "user_id", exact=True)


_BOUND = 3 * 1.04 / 2**8


@query("a9_approx_distinct", "SELECT event_type, count(DISTINCT user_id) AS actors FROM events GROUP BY event_type")
def a9_approx(t: Tables) -> DataFrame:
    """Estimate by one sketch a group, of a size that holds the counts of the test tables exactly."""
    return t.events.groupBy("event_type").agg(F.hll_sketch_estimate(F.hll_sketch_agg("user_id", 16)).alias("actors"))


@query(
    "a9_sketches",
    "WITH d AS (SELECT event_type, count(DISTINCT strftime(ts, '%Y-%m-%d')) AS days, count(*) AS n, count(DISTINCT user_id) AS actors FROM events GROUP BY 1) "
    f"SELECT event_type, days, n, actors, CAST(floor(actors / (1 + {_BOUND})) AS BIGINT) AS low, CAST(ceil(actors / (1 - {_BOUND})) AS BIGINT) AS high FROM d",
)
def a9_sketches(t: Tables) -> DataFrame:
    """Distinct actors over all days from the days' stored sketches, with bounds."""
    return SK.merged_actors(SK.daily_actors(t.events, F.date_format("ts", "yyyy-MM-dd"), "event_type", "user_id", 16), "event_type", 16)


@query(
    "t2_heavy",
    "WITH s AS (SELECT user_id, epoch_us(time_bucket(INTERVAL 6 HOUR, ts)) - k * CAST(21600000000 AS BIGINT) AS start_us FROM events, (VALUES (0), (1), (2), (3)) v(k)), "
    "n AS (SELECT start_us, user_id, count(*) AS n FROM s GROUP BY 1, 2) "
    "SELECT start_us, user_id, n, CAST(sum(n) OVER (PARTITION BY start_us) AS BIGINT) AS total FROM n QUALIFY n >= 0.02 * sum(n) OVER (PARTITION BY start_us)",
)
def t2_heavy(t: Tables) -> DataFrame:
    """Users with at least 2 % of the events of a sliding day."""
    windows = t.events_utc.select("user_id", F.unix_micros(F.window("ts", "24 hours", "6 hours")["start"]).alias("start_us"))
    return SK.heavy_hitters(windows, F.col("user_id"), 0.02, ["start_us"]).select("start_us", F.col("item").alias("user_id"), "n", "total")


_TYPES = ["click", "error", "purchase", "signup", "view"]


@query(
    "a10_pivot",
    "SELECT strftime(ts, '%Y-%m-%d') AS day, " + ", ".join(f"count(*) FILTER (event_type = '{x}') AS \"{x}\"" for x in _TYPES) + " FROM events GROUP BY 1",
)
def a10(t: Tables) -> DataFrame:
    return A.matrix(t.events.withColumn("day", F.date_format("ts", "yyyy-MM-dd")), "day", "event_type", _TYPES)


@query(
    "w4_trend",
    "WITH d AS (SELECT event_type, strftime(ts, '%Y-%m-%d') AS day, count(*) AS n FROM events GROUP BY 1, 2) "
    "SELECT event_type, day, n, lag(n) OVER w AS previous, n - lag(n) OVER w AS delta, "
    "CAST(sum(n) OVER (PARTITION BY event_type ORDER BY day ROWS UNBOUNDED PRECEDING) AS BIGINT) AS running, "
    "round(avg(n) OVER (PARTITION BY event_type ORDER BY day ROWS BETWEEN 6 PRECEDING AND CURRENT ROW), 6) AS mean7 "
    "FROM d WINDOW w AS (PARTITION BY event_type ORDER BY day)",
)
def w4(t: Tables) -> DataFrame:
    daily = t.events.groupBy("event_type", F.date_format("ts", "yyyy-MM-dd").alias("day")).agg(F.count("*").alias("n"))
    return W.trend(daily, "event_type", "day", "n")


@query(
    "w5_segment",
    "SELECT conv_id, turn, CAST(sum(CASE WHEN role = 'user' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn, role, text ROWS UNBOUNDED PRECEDING) AS BIGINT) AS run FROM conversations",
)
def w5(t: Tables) -> DataFrame:
    return segment_runs(t.conversations, F.col("role") == "user", keys=("conv_id",), order=("turn", "role", "text"), width=2).select(
        "conv_id", "turn", "run"
    )


@query(
    "w6_topk",
    "SELECT o_custkey, o_orderkey, o_totalprice, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS INTEGER) AS place FROM orders QUALIFY place <= 3",
)
def w6(t: Tables) -> DataFrame:
    rows = t.orders.select("o_custkey", "o_orderkey", "o_totalprice")
    return W.top_k(rows, "o_custkey", [F.desc("o_totalprice"), F.asc("o_orderkey")], 3)


@query(
    "w7_burst",
    "SELECT event_id, user_id, count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 1 HOUR PRECEDING AND CURRENT ROW) AS in_window "
    "FROM events WHERE event_type = 'error' QUALIFY in_window >= 2",
)
def w7(t: Tables) -> DataFrame:
    errors = t.events_utc.where("event_type = 'error'").select("event_id", "user_id", "ts")
    return W.burst(errors, "user_id", "ts", 2, HOUR, "event_id").select("event_id", "user_id", "in_window")


@query(
    "w8_islands",
    "SELECT o_custkey, min(o_orderkey) AS first, max(o_orderkey) AS last, count(*) AS length FROM "
    "(SELECT o_custkey, o_orderkey, o_orderkey - row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS g FROM orders) GROUP BY o_custkey, g HAVING count(*) >= 2",
)
def w8(t: Tables) -> DataFrame:
    return W.enumeration(t.orders, "o_custkey", "o_orderkey", 2, width=100).select("o_custkey", "first", "last", "length")


@query(
    "w9_beacon",
    "WITH g AS (SELECT user_id, epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS gap FROM events), "
    "s AS (SELECT user_id, count(gap) AS gaps, avg(gap / 1000000.0) AS m, stddev_samp(gap / 1000000.0) AS sd FROM g WHERE gap IS NOT NULL GROUP BY user_id HAVING count(gap) >= 3), "
    "r AS (SELECT user_id, gaps, round(m, 3) AS mean_gap, round(sd / m, 6) AS cv FROM s WHERE m > 0) "
    "SELECT user_id, gaps, mean_gap, cv, round(percent_rank() OVER (ORDER BY cv), 6) AS pct, ntile(4) OVER (ORDER BY cv, user_id) AS quartile FROM r",
)
def w9(t: Tables) -> DataFrame:
    return W.beacons(t.events_utc, "user_id", "ts", "event_id")


@query(
    "w10_outlier",
    "WITH s AS (SELECT user_id AS k, avg(value) AS m, stddev_samp(value) AS sd FROM events GROUP BY 1) "
    "SELECT event_id, user_id, round((value - m) / nullif(sd, 0), 4) AS score FROM events JOIN s ON user_id = k WHERE round((value - m) / nullif(sd, 0), 4) > 3",
)
def w10(t: Tables) -> DataFrame:
    return W.outliers(t.events.select("event_id", "user_id", "value"), "user_id", "value", 3.0).select("event_id", "user_id", "score")


# Two scans of one estate: before, documents and chats; now, documents that are not toxic, and web pages.
PREVIOUS = "SELECT md5(text) AS fp FROM documents UNION ALL SELECT md5(text) FROM conversations"
CURRENT = (
    "SELECT md5(text) AS fp FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1) UNION ALL SELECT md5(html) FROM pages"
)


def two_scans(t: Tables) -> tuple[DataFrame, DataFrame]:
    md5 = lambda df, c: df.select(F.md5(c).alias("fp"))
    toxic = t.labels.where("toxic = 1").select("doc_id")
    now = md5(t.documents.join(toxic, "doc_id", "left_anti"), "text").unionByName(md5(t.pages, "html"))
    return now, md5(t.documents, "text").unionByName(md5(t.conversations, "text"))


@query("u3_new", f"SELECT * FROM (({CURRENT}) EXCEPT ({PREVIOUS}))")
def u3_new(t: Tables) -> DataFrame:
    return sets.new_only(*two_scans(t), "fp")


@query("u3_fixed", f"SELECT * FROM (({PREVIOUS}) EXCEPT ({CURRENT}))")
def u3_fixed(t: Tables) -> DataFrame:
    return sets.fixed_only(*two_scans(t), "fp")


@query("u3_persisting", f"SELECT * FROM (({CURRENT}) INTERSECT ({PREVIOUS}))")
def u3_persisting(t: Tables) -> DataFrame:
    return sets.persisting(*two_scans(t), "fp")


@query(
    "u3_scan_diff",
    f"SELECT coalesce(c.fp, p.fp) AS fp, coalesce(c.n, 0) AS now, coalesce(p.n, 0) AS before, CASE WHEN p.n IS NULL THEN 'new' WHEN c.n IS NULL THEN 'fixed' ELSE 'persisting' END AS status "
    f"FROM (SELECT fp, count(*) AS n FROM ({CURRENT}) GROUP BY fp) c FULL JOIN (SELECT fp, count(*) AS n FROM ({PREVIOUS}) GROUP BY fp) p ON c.fp = p.fp",
)
def u3_diff(t: Tables) -> DataFrame:
    return sets.scan_diff(*two_scans(t), key="fp")


@query("u4_except_all", f"SELECT * FROM (({PREVIOUS}) EXCEPT ALL ({CURRENT}))")
def u4_except(t: Tables) -> DataFrame:
    now, before = two_scans(t)
    return sets.except_all(before, now)


@query("u4_intersect_all", f"SELECT * FROM (({PREVIOUS}) INTERSECT ALL ({CURRENT}))")
def u4_intersect(t: Tables) -> DataFrame:
    now, before = two_scans(t)
    return sets.intersect_all(before, now)


@query("u5_union_distinct", f"SELECT * FROM (({CURRENT}) UNION ({PREVIOUS}))")
def u5(t: Tables) -> DataFrame:
    return sets.union_distinct(*two_scans(t))
