"""Change application and keys."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palisade.operators import changes as M
from palisade.operators import joins as J
from palisade.operators import windows as W
from palisade.operators.ordered import NESTED, nested
from palisade.plans.catalog import query
from palisade.sources.entities import conform
from palisade.sources.tables import Tables

Q = "chr(34)"
NOW = "2024-02-01T00:00:00Z"

# Sign-ups: customers of one segment return in capitals, suppliers are new (all under one more spelling).
NEW_USERS = (
    "SELECT c_custkey AS seq, c_name AS name, upper(lower(replace(c_name, '#', '.')) || '@example.com') AS email "
    "FROM customer WHERE c_mktsegment = 'BUILDING' UNION ALL "
    "SELECT s_suppkey + 1000000000 AS seq, s_name AS name, s_name || '@example.com' AS email FROM supplier"
)


def new_users(t: Tables) -> DataFrame:
    old = t.customer.where("c_mktsegment = 'BUILDING'").selectExpr(
        "c_custkey AS seq", "c_name AS name", "upper(lower(replace(c_name, '#', '.')) || '@example.com') AS email"
    )
    fresh = t.supplier.selectExpr("s_suppkey + 1000000000 AS seq", "s_name AS name", "s_name || '@example.com' AS email")
    return old.unionByName(fresh)


def now():
    return F.to_timestamp(F.lit(NOW))


@query("j1_dup_semi", f"SELECT n.seq, n.email FROM ({NEW_USERS}) n WHERE lower(n.email) IN (SELECT email FROM users)")
def j1_semi(t: Tables) -> DataFrame:
    return J.split_duplicates(new_users(t), t.users, "email")[0].select("seq", "email")


@query("j1_dup_anti", f"SELECT n.seq, n.email FROM ({NEW_USERS}) n WHERE lower(n.email) NOT IN (SELECT email FROM users)")
def j1_anti(t: Tables) -> DataFrame:
    return J.split_duplicates(new_users(t), t.users, "email")[1].select("seq", "email")


# Every user sends an e-mail: machinery customers the one of their predecessor, all others their own.
_MAILS = "SELECT id, CASE WHEN c_mktsegment = 'MACHINERY' THEN 'CUSTOMER.' || lpad(CAST(id - 1 AS STRING), 9, '0') || '@example.com' ELSE email END AS email"


@query(
    "j2_dup_not_self",
    f"SELECT n.id, n.email FROM ({_MAILS} FROM users JOIN customer ON id = c_custkey) n "
    "WHERE EXISTS (SELECT 1 FROM users u WHERE u.email = lower(n.email) AND u.id <> n.id)",
)
def j2(t: Tables) -> DataFrame:
    sent = t.customer.selectExpr(
        "c_custkey AS id",
        "CASE WHEN c_mktsegment = 'MACHINERY' THEN 'CUSTOMER.' || lpad(CAST(c_custkey - 1 AS STRING), 9, '0') || '@example.com' "
        "ELSE lower(replace(c_name, '#', '.')) || '@example.com' END AS email",
    )
    return J.split_duplicates(sent, t.users, "email", exclude_self=True)[0].select("id", "email")


_ASK = r"TRY_CAST(nullif(regexp_extract(raw_id, '^\s*([+-]?[0-9]+)', 1), '') AS BIGINT)"


@query(
    "j3_lookup_status",
    f"SELECT r.req_id, CASE WHEN r.ask IS NULL THEN 400 WHEN u.id IS NULL THEN 404 ELSE 200 END AS status, u.name FROM "
    f"(SELECT req_id, {_ASK} AS ask FROM requests) r LEFT JOIN (SELECT id, name FROM users) u ON r.ask = u.id",
)
def j3(t: Tables) -> DataFrame:
    return J.lookup(t.requests, t.users, bring=["name"]).select("req_id", "status", "name")


_BODY = f"'{{' || {Q} || 'name' || {Q} || ':' || {Q} || name || {Q} || ',' || {Q} || 'email' || {Q} || ':' || {Q} || email || {Q} || '}}'"


@query(
    "m5_apply_creates",
    f"WITH n AS ({NEW_USERS}), m AS (SELECT max(id) AS top FROM users), "
    "ok AS (SELECT seq, name, lower(email) AS email FROM n WHERE lower(email) NOT IN (SELECT email FROM users)) "
    "SELECT id, name, email, role FROM users UNION ALL "
    "SELECT m.top + row_number() OVER (ORDER BY seq), name, email, 'user' FROM ok, m",
)
def m5(t: Tables) -> DataFrame:
    requests = new_users(t).selectExpr("seq AS req_id", "seq", f"{_BODY} AS body")
    state, _ = M.apply_creates(conform(t.users, "users"), requests, "users", now(), unique="email")
    return state.select("id", "name", "email", "role")


@query(
    "m5_create_responses",
    f"SELECT seq AS req_id, CASE WHEN lower(email) IN (SELECT email FROM users) THEN 409 ELSE 201 END AS status FROM ({NEW_USERS}) n",
)
def m5_responses(t: Tables) -> DataFrame:
    requests = new_users(t).selectExpr("seq AS req_id", "seq", f"{_BODY} AS body")
    return M.apply_creates(conform(t.users, "users"), requests, "users", now(), unique="email")[1].select("req_id", "status")


# Updates: every event renames its user; some bodies carry a role, some are too short, some are no JSON.
_PUT = (
    f"CASE WHEN value < 3 THEN '{{bad' "
    f"WHEN event_type = 'error' THEN '{{' || {Q} || 'name' || {Q} || ':' || {Q} || 'x' || {Q} || '}}' "
    f"WHEN event_type = 'signup' THEN '{{' || {Q} || 'role' || {Q} || ':' || {Q} || 'admin' || {Q} || ',' || {Q} || 'isAdmin' || {Q} || ':true}}' "
    f"ELSE '{{' || {Q} || 'name' || {Q} || ':' || {Q} || ' u' || CAST(event_id AS STRING) || ' ' || {Q} || '}}' END"
)
_UPD = (
    f"WITH r AS (SELECT req_id, seq, {_ASK} AS ask, value, event_type FROM requests JOIN events ON req_id = event_id), "
    "s AS (SELECT r.*, CASE WHEN ask IS NULL THEN 400 WHEN u.id IS NULL THEN 404 WHEN value < 3 OR event_type = 'error' THEN 400 ELSE 200 END AS status "
    "FROM r LEFT JOIN (SELECT id FROM users) u ON r.ask = u.id) "
)


def _put_requests(t: Tables) -> DataFrame:
    r = t.events.selectExpr(
        "event_id AS req_id", "event_id AS seq",
        "CASE WHEN value < 1 THEN 'abc' ELSE CAST(user_id * 11 AS STRING) END AS raw_id", f"{_PUT} AS body",
    )
    return r


@query(
    "m6_apply_updates",
    _UPD + ", f AS (SELECT ask, max(CASE WHEN event_type <> 'signup' THEN seq END) AS named, count(*) FILTER (event_type = 'signup') AS promoted "
    "FROM s WHERE status = 200 GROUP BY ask) "
    "SELECT u.id, CASE WHEN f.named IS NULL THEN u.name ELSE 'u' || CAST(f.named AS STRING) END AS name, u.email, "
    "CASE WHEN f.promoted > 0 THEN 'admin' ELSE u.role END AS role, f.ask IS NOT NULL AS touched "
    "FROM (SELECT * FROM users) u LEFT JOIN f ON u.id = f.ask",
)
def m6(t: Tables) -> DataFrame:
    state, _, _ = M.apply_updates(conform(t.users, "users"), _put_requests(t), "users", now(), unique="email")
    return state.select("id", "name", "email", "role", F.col("updatedAt").isNotNull().alias("touched"))


@query(
    "m6_update_responses",
    _UPD + "SELECT req_id, status, CASE WHEN ask IS NULL THEN 'Invalid user ID' WHEN status = 404 THEN 'User not found' WHEN status = 200 THEN NULL "
    "WHEN value < 3 THEN 'Invalid JSON' ELSE 'Validation failed' END AS error FROM s",
)
def m6_responses(t: Tables) -> DataFrame:
    return M.apply_updates(conform(t.users, "users"), _put_requests(t), "users", now(), unique="email")[1].select("req_id", "status", "error")


_ID = f"{_ASK} AS id"


def change_requests(t: Tables) -> DataFrame:
    """requests with numeric ids and the name a PUT carries."""
    k = F.get_json_object("body", "$.k")
    return t.requests.select(
        "req_id", "seq", "ts", "method", F.expr("try_cast(raw_id AS BIGINT)").alias("id"),
        F.when(F.col("method").isin("PUT", "POST"), F.concat(F.lit("u"), k)).alias("new_name"),
    )


@query("m7_apply_deletes", f"SELECT id, name FROM users WHERE id NOT IN (SELECT {_ASK} FROM requests WHERE method = 'DELETE' AND {_ASK} IS NOT NULL)")
def m7(t: Tables) -> DataFrame:
    ids = change_requests(t).where("method = 'DELETE'").select("id")
    return M.apply_deletes(t.users, ids)[0].select("id", "name")


@query("m7_deleted_rows", f"SELECT id, name FROM users WHERE id IN (SELECT {_ASK} FROM requests WHERE method = 'DELETE')")
def m7_deleted(t: Tables) -> DataFrame:
    return M.apply_deletes(t.users, change_requests(t).where("method = 'DELETE'").select("id"))[1].select("id", "name")


# Existence before a request: the last POST or DELETE of its id, else the state.
_FOLD = (
    f"WITH r AS (SELECT req_id, seq, method, {_ASK} AS id, 'u' || json_extract_string(body, '$.k') AS nm FROM requests), "
    "e AS (SELECT r.*, coalesce(last_value(CASE method WHEN 'POST' THEN true WHEN 'DELETE' THEN false END IGNORE NULLS) "
    "OVER (PARTITION BY r.id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), u.id IS NOT NULL) AS there "
    "FROM r LEFT JOIN (SELECT id FROM users) u ON r.id = u.id), "
    "s AS (SELECT *, CASE WHEN id IS NULL THEN 400 WHEN method = 'POST' THEN CASE WHEN there THEN 409 ELSE 201 END "
    "WHEN NOT there THEN 404 ELSE 200 END AS status FROM e) "
)
FOLD_STATE = (
    _FOLD + ", f AS (SELECT id, max(seq) FILTER (method = 'POST' AND status < 400) AS c, max(seq) FILTER (method = 'DELETE' AND status < 400) AS d, "
    "max(seq) FILTER (method IN ('POST', 'PUT') AND status < 400) AS w, arg_max(nm, seq) FILTER (method IN ('POST', 'PUT') AND status < 400) AS nm "
    "FROM s WHERE id IS NOT NULL GROUP BY id) "
    "SELECT coalesce(u.id, f.id) AS id, CASE WHEN f.w IS NOT NULL AND (f.c IS NULL OR f.w >= f.c) THEN f.nm WHEN f.c IS NULL THEN u.name END AS name, "
    "CASE WHEN f.c IS NULL THEN u.email END AS email "
    "FROM (SELECT * FROM users) u FULL JOIN f ON u.id = f.id "
    "WHERE CASE WHEN f.c IS NULL AND f.d IS NULL THEN u.id IS NOT NULL ELSE coalesce(f.c, -1) > coalesce(f.d, -1) END"
)


@query("m8_apply_changes", FOLD_STATE)
def m8(t: Tables) -> DataFrame:
    state = t.users.select("id", "name", "email")
    return M.apply_changes(state, change_requests(t), {"name": F.col("new_name")}, width=2000)[0]


@query("m8_responses", _FOLD + "SELECT req_id, status FROM s")
def m8_responses(t: Tables) -> DataFrame:
    state = t.users.select("id", "name", "email")
    return M.apply_changes(state, change_requests(t), {"name": F.col("new_name")}, width=2000)[1]


@query(
    "w1_assign_ids",
    "SELECT (SELECT max(c_custkey) FROM customer) + row_number() OVER (ORDER BY s_name) AS id, s_name AS name FROM supplier",
)
def w1(t: Tables) -> DataFrame:
    new = t.supplier.select(F.col("s_name").alias("name"))
    return M.assign_ids(new, t.customer.select(F.col("c_custkey").alias("id")), ["name"])


# Child ids: an order's items keep their line numbers by position; those past the number of distinct lines get fresh ids.
@query(
    "w2_item_ids",
    "WITH i AS (SELECT order_id, id, product_id, quantity, row_number() OVER (PARTITION BY order_id ORDER BY id, product_id, quantity, price) - 1 AS pos FROM order_items), "
    "o AS (SELECT order_id, id AS old_id, row_number() OVER (PARTITION BY order_id ORDER BY id) - 1 AS pos FROM (SELECT DISTINCT order_id, id FROM order_items)) "
    "SELECT i.order_id, CAST(i.pos AS INTEGER) AS pos, CASE WHEN coalesce(o.old_id, 0) <> 0 THEN o.old_id ELSE 1706745600000 + i.pos END AS id, i.product_id "
    "FROM i LEFT JOIN o ON i.order_id = o.order_id AND i.pos = o.pos",
)
def w2(t: Tables) -> DataFrame:
    keep = t.order_items.select("order_id", F.col("id").cast("bigint").alias("id"), F.col("product_id").alias("productId"), "quantity", "price")
    new = nested(keep, ["order_id"], ["id", "productId", "quantity", "price"], F.struct("id", "productId", "quantity", "price"))
    old = nested(keep.select("order_id", "id").distinct(), ["order_id"], ["id"], F.struct("id")).withColumnRenamed("items", "old")
    # Parts of an order and of its old items start at the same positions, so they pair up by part.
    both = new.join(old, ["order_id", "part"], "left")
    first = F.unix_millis(now()) + F.col("part") * NESTED
    fixed = both.select("order_id", "part", M.item_ids(F.col("items"), first, F.coalesce("old", F.array().cast("array<struct<id:bigint>>"))).alias("items"))
    return fixed.select("order_id", "part", F.posexplode("items").alias("n", "i")).select(
        "order_id", (F.col("part") * NESTED + F.col("n")).cast("int").alias("pos"), F.col("i.id").alias("id"), F.col("i.productId").alias("product_id")
    )


@query(
    "w3_latest",
    "SELECT user_id, event_id, event_type, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1",
)
def w3(t: Tables) -> DataFrame:
    return W.latest(t.events, "user_id", ["ts", "event_id"]).select("user_id", "event_id", "event_type", "value")
