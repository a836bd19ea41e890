"""M1, M2, M5, M6 for every entity: bodies from the given tables that reach each message and default."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palisade.operators import changes as M
from palisade.operators.validate import validate
from palisade.plans.catalog import query, sql_text
from palisade.plans.changes import now
from palisade.schemas import ENTITIES
from palisade.sources.entities import conform
from palisade.sources.tables import Tables

NOW_MS = 1706745600000


@dataclass(frozen=True)
class Field:
    """A field of a body: its JSON text in Spark SQL (NULL leaves it out), and when it is wrong on create and on update."""

    name: str
    value: str
    message: str
    create: str
    update: str


def _quoted(text: str) -> str:
    return f"concat('\"', {text}, '\"')"


NAME, EMAIL = "Name must be a string with at least 2 characters", "Valid email is required"
ROLE = 'Role must be either "admin" or "user"'
_NO_USER = "o_orderkey % 5 <> 0 AND (o_orderkey % 7 = 0 OR o_custkey <= 0)"
BODIES = {
    "users": ("customer", "c_custkey", [
        Field("name", f"CASE WHEN c_custkey % 11 = 0 THEN NULL WHEN c_custkey % 7 = 0 THEN {_quoted(sql_text(' x '))} ELSE {_quoted('c_name')} END", NAME,
              "c_custkey % 11 = 0 OR c_custkey % 7 = 0", "c_custkey % 11 <> 0 AND c_custkey % 7 = 0"),
        Field("email", f"CASE WHEN c_custkey % 6 = 0 THEN NULL WHEN c_custkey % 5 = 0 THEN {_quoted('c_name')} ELSE {_quoted(sql_text('a@b.example'))} END", EMAIL,
              "c_custkey % 6 = 0 OR c_custkey % 5 = 0", "c_custkey % 6 <> 0 AND c_custkey % 5 = 0"),
        Field("role", "CASE c_custkey % 5 WHEN 0 THEN NULL WHEN 1 THEN '\"root\"' WHEN 2 THEN '\"\"' WHEN 3 THEN '1' ELSE '\"admin\"' END", ROLE,
              "c_custkey % 5 IN (1, 3)", "c_custkey % 5 IN (1, 2, 3)"),
    ]),
    "posts": ("part", "p_partkey", [
        Field("title", f"CASE WHEN p_size < 5 THEN {_quoted(sql_text('ab'))} WHEN p_size < 10 THEN NULL ELSE {_quoted('p_name')} END",
              "Title must be a string with at least 3 characters", "p_size < 10", "p_size < 5"),
        Field("content", _quoted("p_type"), "Content must be a string with at least 10 characters", "length(p_type) < 10", "length(p_type) < 10"),
        Field("authorId", "CASE WHEN p_size > 45 THEN NULL WHEN p_size > 40 THEN '\"3\"' ELSE CAST(p_partkey % 4 AS STRING) END",
              "Author ID must be a positive number", "p_size BETWEEN 41 AND 45 OR (p_size <= 40 AND p_partkey % 4 = 0)", "p_size BETWEEN 41 AND 45 OR (p_size <= 40 AND p_partkey % 4 = 0)"),
        Field("tags", "CASE p_partkey % 4 WHEN 0 THEN '[\"a\",\"b\"]' WHEN 1 THEN '[\"a\",2]' WHEN 2 THEN '\"a\"' END",
              "Tags must be an array of strings", "p_partkey % 4 IN (1, 2)", "p_partkey % 4 IN (1, 2)"),
        Field("published", "CASE p_partkey % 3 WHEN 0 THEN 'true' WHEN 1 THEN '0' END", "Published must be a boolean", "p_partkey % 3 = 1", "p_partkey % 3 = 1"),
    ]),
    "categories": ("supplier", "s_suppkey", [
        Field("name", f"CASE WHEN s_suppkey % 4 = 0 THEN NULL WHEN s_suppkey % 3 = 0 THEN '7' ELSE {_quoted('s_name')} END", NAME,
              "s_suppkey % 4 = 0 OR s_suppkey % 3 = 0", "s_suppkey % 4 <> 0 AND s_suppkey % 3 = 0"),
        Field("description", f"CASE WHEN s_suppkey % 5 = 0 THEN {_quoted(sql_text('abcd  '))} ELSE {_quoted('s_name')} END",
              "Description must be a string with at least 5 characters", "s_suppkey % 5 = 0", "s_suppkey % 5 = 0"),
        Field("active", "CASE s_suppkey % 3 WHEN 0 THEN 'false' WHEN 1 THEN 'null' END", "Active must be a boolean", "s_suppkey % 3 = 1", "s_suppkey % 3 = 1"),
    ]),
    "orders": ("orders", "o_orderkey", [
        Field("userId", "CASE WHEN o_orderkey % 5 = 0 THEN NULL WHEN o_orderkey % 7 = 0 THEN '-1' ELSE CAST(o_custkey AS STRING) END",
              "User ID must be a positive number", _NO_USER, _NO_USER),
        Field("items", "CASE o_orderkey % 4 WHEN 0 THEN NULL WHEN 1 THEN '{}' WHEN 2 THEN '[{\"productId\":1,\"quantity\":0,\"price\":2}]' ELSE '[{\"productId\":1,\"quantity\":1,\"price\":2}]' END",
              "Items must be an array", "o_orderkey % 4 = 1", "o_orderkey % 4 = 1"),
        Field("items", "CAST(NULL AS STRING)", "Item 1: Quantity must be a positive number", "o_orderkey % 4 = 2", "o_orderkey % 4 = 2"),
        Field("status", "CASE o_orderstatus WHEN 'O' THEN '\"open\"' WHEN 'F' THEN '\"shipped\"' END",
              "Status must be one of: pending, processing, shipped, delivered, cancelled", "o_orderstatus = 'O'", "o_orderstatus = 'O'"),
    ]),
}


def bodies(t: Tables, entity: str) -> DataFrame:
    table, key, fields = BODIES[entity]
    parts = ", ".join(f"concat('\"{f.name}\":', {f.value})" for f in fields)
    return getattr(t, table).selectExpr(f"{key} AS id", f"concat('{{', concat_ws(',', {parts}), '}}') AS body")


def _errors_sql(entity: str, mode: str) -> str:
    table, key, fields = BODIES[entity]
    arms = ", ".join(f"CASE WHEN {getattr(f, mode)} THEN {sql_text(f.message)} END" for f in fields)
    return f"SELECT id, errors, errors = '' AS valid FROM (SELECT {key} AS id, concat_ws('|', {arms}) AS errors FROM {table})"


def _register(entity: str, number: int, mode: str) -> None:
    @query(f"m{number}_{entity}", _errors_sql(entity, mode))
    def run(t: Tables) -> DataFrame:
        return validate(bodies(t, entity), entity, mode).select("id", F.concat_ws("|", "errors").alias("errors"), "valid")


for _entity in BODIES:
    _register(_entity, 1, "create")
    _register(_entity, 2, "update")


@query(
    "m5_posts",
    "SELECT CAST(row_number() OVER (ORDER BY p_partkey) AS BIGINT) AS id, p_name AS title, "
    "CASE WHEN p_size % 3 = 0 THEN 'x,y' ELSE '' END AS tags, CASE p_size % 4 WHEN 0 THEN true WHEN 1 THEN NULL ELSE false END AS published FROM part",
)
def m5_posts(t: Tables) -> DataFrame:
    """New posts: absent tags are an empty list, an absent flag is false, a null one stays null."""
    body = (
        "concat('{', concat_ws(',', concat('\"title\":\" ', p_name, ' \"'), '\"content\":\"0123456789\"', '\"authorId\":1', "
        "CASE WHEN p_size % 3 = 0 THEN '\"tags\":[\"x\",\"y\"]' END, CASE p_size % 4 WHEN 0 THEN '\"published\":true' WHEN 1 THEN '\"published\":null' WHEN 2 THEN '\"published\":false' END), '}') AS body"
    )
    # A null flag is no boolean: those bodies are checked as the lenient form of the API does, by the default alone.
    parsed, accessor = M.JsonBody.prepared(t.part.selectExpr("p_partkey", body), "body")
    values = M.new_entity(accessor, "posts", now())
    made = parsed.select("p_partkey", *[values[c].alias(c) for c in ("title", "tags", "published")])
    none = t.spark.createDataFrame([], "id bigint")
    return M.assign_ids(made, none, ["p_partkey"]).select("id", "title", F.array_join("tags", ",").alias("tags"), "published")


# New orders: one or two items, some without items, some with a total of their own.
_ORDER_OK = "o_orderkey % 6 <> 0"
_ORDER_ITEMS = "CASE WHEN o_orderkey % 2 = 0 THEN 2 ELSE 1 END"


@query(
    "m5_orders",
    f"SELECT (SELECT max(o_orderkey) FROM orders) + row_number() OVER (ORDER BY o_orderkey) AS id, o_custkey + 1 AS user_id, "
    f"CASE WHEN o_orderkey % 5 = 0 THEN 0.0 ELSE CAST(o_custkey + 1 AS DOUBLE) * 2 * {_ORDER_ITEMS} END AS total, "
    f"CASE WHEN o_orderkey % 3 = 0 THEN 'shipped' ELSE 'pending' END AS status, {NOW_MS - 1} + {_ORDER_ITEMS} AS last_item FROM orders WHERE {_ORDER_OK}",
)
def m5_orders(t: Tables) -> DataFrame:
    item = "concat('{\"productId\":3,\"quantity\":2,\"price\":', CAST(o_custkey + 1 AS STRING), '}')"
    body = (
        "concat('{', concat_ws(',', concat('\"userId\":', CAST(o_custkey + 1 AS STRING)), "
        f"CASE WHEN {_ORDER_OK} THEN concat('\"items\":[', array_join(array_repeat({item}, {_ORDER_ITEMS}), ','), ']') END, "
        "CASE WHEN o_orderkey % 5 = 0 THEN '\"totalAmount\":0' END, CASE WHEN o_orderkey % 3 = 0 THEN '\"status\":\"shipped\"' END), '}') AS body"
    )
    requests = t.orders.selectExpr("o_orderkey AS req_id", "o_orderkey AS seq", body)
    old = conform(t.orders_e, "orders")
    state, _ = M.apply_creates(old, requests, "orders", now())
    new = state.join(old.select("id"), "id", "left_anti")
    return new.select("id", F.col("userId").alias("user_id"), F.col("totalAmount").alias("total"), "status", F.element_at("items", -1)["id"].alias("last_item"))


@query(
    "m6_orders",
    "WITH o AS (SELECT l_orderkey AS id, count(*) AS n, 1 + l_orderkey % 3 AS k1, 1 + l_orderkey % 5 AS k2 FROM lineitem GROUP BY 1) "
    f"SELECT id, CAST(p AS INTEGER) AS pos, CASE WHEN p < least(n, k1) THEN p + 1 ELSE {NOW_MS} + p END AS item_id FROM (SELECT *, unnest(range(k2)) AS p FROM o)",
)
def m6_orders(t: Tables) -> DataFrame:
    """Two bodies per order in one batch: positions that the first drops get fresh ids in the second."""
    # An order has as many items as line items, at most seven in these tables; the state holds them as one array.
    items = t.order_items.groupBy(F.col("order_id").alias("id")).agg(F.count("*").alias("n"))
    state = items.select("id", F.transform(F.sequence(F.lit(1), F.col("n").cast("int")), lambda i: F.struct(
        i.cast("bigint").alias("id"), F.lit(1).cast("bigint").alias("productId"), F.lit(1.0).alias("quantity"), F.lit(1.0).alias("price"))).alias("items"))
    one = "array_repeat('{\"productId\":1,\"quantity\":1,\"price\":1}', cast(1 + id % K as int))"
    puts = [
        items.selectExpr(f"id * 2 + {k} AS req_id", f"id * 2 + {k} AS seq", "cast(id as string) AS raw_id", f"concat('{{\"items\":[', array_join({one.replace("K", str(m))}, ','), ']}}') AS body")
        for k, m in ((0, 3), (1, 5))
    ]
    full = conform(state, "orders")
    assert full.columns == ENTITIES["orders"].fieldNames()
    out, _, _ = M.apply_updates(full, puts[0].unionByName(puts[1]), "orders", now())
    return out.select("id", F.posexplode("items").alias("pos", "i")).select("id", "pos", F.col("i.id").alias("item_id"))
