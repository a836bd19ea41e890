"""S1, S2, S8, P1–P12, M1–M4, O1–O3, U1–U2 and the scalar functions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palisade.functions import coerce as C
from palisade.functions import text as X
from palisade.operators import filters as P
from palisade.operators import sets
from palisade.operators.validate import json_types, validate, validate_items
from palisade.plans.catalog import query
from palisade.sources.entities import conform, read_requests, seed
from palisade.sources.tables import Tables

Q, NL = "chr(34)", "chr(10)"


@query("s1_read_entities", "SELECT id, name, email, role FROM users")
def s1(t: Tables) -> DataFrame:
    return conform(t.users, "users").select("id", "name", "email", "role")


# Every event sends a body; the cheapest ones are cut off before the closing brace.
BODY = "CASE WHEN value < 5 THEN substr(props, 1, length(props) - 1) ELSE props END AS body"


@query(
    "s2_parse_bodies",
    "SELECT event_id, CASE WHEN value < 5 THEN 400 ELSE 200 END AS parse_status, "
    "CASE WHEN value < 5 THEN 'Invalid JSON' END AS parse_error, "
    "CASE WHEN value < 5 THEN NULL ELSE CAST(json_extract_string(props, '$.k') AS BIGINT) END AS k FROM events",
)
def s2(t: Tables) -> DataFrame:
    parsed = read_requests(t.events.selectExpr("event_id", BODY))
    return parsed.select("event_id", "parse_status", "parse_error", F.try_variant_get(F.col("body_fields")["k"], "$", "bigint").alias("k"))


@query(
    "s8_seed_users",
    "SELECT row_number() OVER (ORDER BY s_name) AS id, s_name AS username, lower(s_name) || '@example.com' AS email FROM supplier",
)
def s8(t: Tables) -> DataFrame:
    rows = t.supplier.selectExpr("s_name AS username", "lower(s_name) || '@example.com' AS email")
    return seed(rows, ["username"], "seeded_users")


@query("p1_project", "SELECT id, name, email FROM users")
def p1(t: Tables) -> DataFrame:
    return P.project(t.users, ["id", "name", "email"])


@query("p2_filter_role", "SELECT c_custkey, c_mktsegment FROM customer WHERE c_mktsegment = 'BUILDING'")
def p2(t: Tables) -> DataFrame:
    return P.filter_eq(P.filter_eq(t.customer, "c_mktsegment", "BUILDING"), "c_name", "").select("c_custkey", "c_mktsegment")


@query("p3_filter_user", "SELECT id, user_id FROM orders_e WHERE user_id = 12")
def p3(t: Tables) -> DataFrame:
    return P.filter_int(t.orders_e, "user_id", "12abc").select("id", "user_id")


@query("p4_filter_flag", "SELECT doc_id, quality FROM labels WHERE (quality = 1) = false")
def p4(t: Tables) -> DataFrame:
    flagged = t.labels.withColumn("flag", F.col("quality") == 1)
    return P.filter_bool(flagged, "flag", "").select("doc_id", "quality")


@query("p5_price_range", "SELECT p_partkey, p_retailprice FROM part WHERE p_retailprice >= 930.5 AND p_retailprice <= 960")
def p5(t: Tables) -> DataFrame:
    return P.filter_range(t.part, "p_retailprice", "930.5usd", "960").select("p_partkey", "p_retailprice")


@query("p6_filter_tag", "SELECT doc_id AS id, lang || ',' || source AS tags FROM documents WHERE list_contains([lang, source], 'fr')")
def p6(t: Tables) -> DataFrame:
    tagged = t.documents.select(F.col("doc_id").alias("id"), F.array("lang", "source").alias("tags"))
    return P.filter_tag(tagged, "tags", "fr").select("id", F.array_join("tags", ",").alias("tags"))


@query("p7_product_search", "SELECT id, name, price FROM products WHERE category_id = 7 AND price >= 900 AND price <= 1090 AND active = true")
def p7(t: Tables) -> DataFrame:
    params = {"categoryId": "7", "minPrice": "900", "maxPrice": "1090", "active": "true"}
    return P.query_entities(t.products, "products", params).select("id", "name", "price")


@query(
    "p8_lookup",
    "SELECT CASE WHEN a.ask IS NULL THEN 400 WHEN u.id IS NULL THEN 404 ELSE 200 END AS status, u.id, u.name FROM "
    "(VALUES (12), (NULL), (-5)) a(ask) LEFT JOIN (SELECT id, name FROM users) u ON a.ask = u.id",
)
def p8(t: Tables) -> DataFrame:
    return sets.append(*[P.get_by_id(t.users.select("id", "name"), raw) for raw in ("12abc", "abc", "-5")])


@query("p9_search", "SELECT p_partkey, p_name FROM part WHERE p_name ILIKE '%RED%'")
def p9(t: Tables) -> DataFrame:
    return P.search(t.part, "p_name", "RED").select("p_partkey", "p_name")


@query("p10_find_one", "SELECT id, name FROM users WHERE name = 'Customer#000000042' ORDER BY id LIMIT 1")
def p10(t: Tables) -> DataFrame:
    return P.find_one(t.users, "name", "Customer#000000042").select("id", "name")


@query("p11_enum", "SELECT o_orderkey, o_orderstatus IN ('O', 'F') AS known FROM orders")
def p11(t: Tables) -> DataFrame:
    return t.orders.select("o_orderkey", P.is_enum("o_orderstatus", ["O", "F"]).alias("known"))


@query("p12_param_sql", "SELECT id, name, email FROM users WHERE id = 7 OR name LIKE '%00001%'")
def p12(t: Tables) -> DataFrame:
    sql = "SELECT id, name, email FROM p12_users WHERE id = :id OR name LIKE concat('%', :q, '%')"
    return P.run_sql(t.spark, sql, {"id": 7, "q": "00001"}, p12_users=t.users)


# Bodies of new products: short names, free, uncategorised, oversold and mistyped ones among them.
PRODUCT_BODY = (
    f"'{{' || {Q} || 'name' || {Q} || ':' || {Q} || CASE WHEN p_size < 3 THEN ' x ' ELSE p_name END || {Q} || ',' || "
    f"{Q} || 'description' || {Q} || ':' || {Q} || p_type || {Q} || ',' || "
    f"{Q} || 'price' || {Q} || ':' || CASE WHEN p_size > 45 THEN 'null' ELSE CAST(p_size - 5 AS STRING) END || ',' || "
    f"{Q} || 'categoryId' || {Q} || ':' || CAST(p_partkey % 25 AS STRING) || ',' || "
    f"{Q} || 'stock' || {Q} || ':' || CASE WHEN p_size > 40 THEN {Q} || '7' || {Q} ELSE CAST(p_size - 10 AS STRING) END || ',' || "
    f"{Q} || 'active' || {Q} || ':' || CASE WHEN p_size > 30 THEN '1' ELSE 'true' END || '}}' AS body"
)
_CREATE_ERRORS = [
    ("p_size < 3", "Name must be a string with at least 2 characters"),
    ("length(p_type) < 10", "Description must be a string with at least 10 characters"),
    ("p_size > 45 OR p_size <= 5", "Price must be a positive number"),
    ("p_partkey % 25 = 0", "Category ID must be a positive number"),
    ("p_size > 40 OR p_size < 10", "Stock must be a non-negative number"),
    ("p_size > 30", "Active must be a boolean"),
]


def _errors_sql(rules: list[tuple[str, str]]) -> str:
    arms = ", ".join(f"CASE WHEN {c} THEN '{m}' END" for c, m in rules)
    return f"concat_ws('|', {arms})"


@query("m1_validate_create", f"SELECT id, errors, errors = '' AS valid FROM (SELECT p_partkey AS id, {_errors_sql(_CREATE_ERRORS)} AS errors FROM part)")
def m1(t: Tables) -> DataFrame:
    bodies = t.part.selectExpr("p_partkey AS id", PRODUCT_BODY)
    return validate(bodies, "products", "create").select("id", F.concat_ws("|", "errors").alias("errors"), "valid")


UPDATE_BODY = (
    f"CASE p_type WHEN 'ECONOMY' THEN '{{' || {Q} || 'price' || {Q} || ':' || CAST(p_size - 20 AS STRING) || '}}' "
    f"WHEN 'STANDARD' THEN '{{' || {Q} || 'name' || {Q} || ':' || CASE WHEN p_size > 25 THEN 'null' ELSE {Q} || p_name || {Q} END || '}}' "
    f"WHEN 'PROMO' THEN '{{}}' "
    f"ELSE '{{' || {Q} || 'description' || {Q} || ':' || {Q} || p_name || {Q} || ',' || {Q} || 'extra' || {Q} || ':1}}' END AS body"
)
_UPDATE_ERRORS = [
    ("p_type = 'STANDARD' AND p_size > 25", "Name must be a string with at least 2 characters"),
    ("p_type NOT IN ('ECONOMY', 'STANDARD', 'PROMO') AND length(p_name) < 10", "Description must be a string with at least 10 characters"),
    ("p_type = 'ECONOMY' AND p_size <= 20", "Price must be a positive number"),
]


@query("m2_validate_update", f"SELECT id, errors, errors = '' AS valid FROM (SELECT p_partkey AS id, {_errors_sql(_UPDATE_ERRORS)} AS errors FROM part)")
def m2(t: Tables) -> DataFrame:
    bodies = t.part.selectExpr("p_partkey AS id", UPDATE_BODY)
    return validate(bodies, "products", "update").select("id", F.concat_ws("|", "errors").alias("errors"), "valid")


@query(
    "m3_validate_items",
    "SELECT order_id, count(*) AS items, CAST(sum(CASE WHEN product_id <= 100 THEN 1 ELSE 0 END + CASE WHEN quantity - 5 <= 0 THEN 1 ELSE 0 END) AS BIGINT) AS errors "
    "FROM order_items GROUP BY order_id",
)
def m3(t: Tables) -> DataFrame:
    """Every item is checked where it lies, with its number as a column; the quantities are shifted so that some fail."""
    item = F.struct(
        F.col("id"), (F.col("product_id") - 100).alias("productId"), (F.col("quantity") - 5).alias("quantity"), F.lit(1.0).alias("price")
    )
    rows = t.order_items.select("order_id", F.array(item).alias("items"), (F.col("id") - 1).alias("n"))
    return validate_items(rows, offset=F.col("n")).groupBy("order_id").agg(
        F.sum(F.size("items")).alias("items"), F.sum(F.size("errors")).alias("errors")
    )


@query(
    "m4_json_type",
    "SELECT 'number' AS k_type, 'undefined' AS missing_type, count(*) AS n FROM events",
)
def m4(t: Tables) -> DataFrame:
    typed = json_types(t.events, {"k_type": "k", "missing_type": "nope"}, "props")
    return typed.groupBy("k_type", "missing_type").agg(F.count("*").alias("n"))


@query("o1_sorted", "SELECT id, name FROM users ORDER BY id")
def o1(t: Tables) -> DataFrame:
    return P.in_order(t.users.select("id", "name"), "id")


@query("o2_first", "SELECT id, name FROM users ORDER BY id LIMIT 1")
def o2(t: Tables) -> DataFrame:
    return P.first_row(t.users.select("id", "name"), "id")


@query("o3_top_global", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25")
def o3(t: Tables) -> DataFrame:
    return P.top(t.orders.select("o_orderkey", "o_totalprice"), 25, F.desc("o_totalprice"), F.asc("o_orderkey"))


@query("u1_append", "SELECT c_custkey AS id, c_name AS name FROM customer UNION ALL SELECT s_suppkey, s_name FROM supplier")
def u1(t: Tables) -> DataFrame:
    return sets.append(
        t.customer.select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name")),
        t.supplier.select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name")),
    )


@query(
    "u2_combine",
    "SELECT 'code' AS mapper, doc_id AS id, lang, NULL AS url, length(text) AS chars FROM documents UNION ALL "
    "SELECT 'web', page_id, NULL, url, length(html) FROM pages UNION ALL SELECT 'chat', conv_id, NULL, NULL, length(text) FROM conversations",
)
def u2(t: Tables) -> DataFrame:
    n = lambda c: F.length(c).cast("bigint").alias("chars")
    return sets.combine(
        t.documents.select(F.lit("code").alias("mapper"), F.col("doc_id").alias("id"), "lang", n("text")),
        t.pages.select(F.lit("web").alias("mapper"), F.col("page_id").alias("id"), "url", n("html")),
        t.conversations.select(F.lit("chat").alias("mapper"), F.col("conv_id").alias("id"), n("text")),
    ).select("mapper", "id", "lang", "url", "chars")


_INT = r"regexp_extract({x}, '^\s*([+-]?[0-9]+)', 1)"


@query(
    "f_scalars",
    "SELECT event_id, CAST(event_id AS BIGINT) AS parsed_int, round(value, 6) AS parsed_float, 'Ab ' || event_type AS trimmed, "
    "length('Ab ' || event_type) AS trimmed_length, upper(event_type) = 'ERROR' AS has_or, event_type LIKE 'p%' AS starts_p, "
    "'Item ' || CAST(event_id + 1 AS STRING) || ': ' || event_type AS message, CASE WHEN event_type = 'view' THEN 'none' ELSE event_type END AS falsy_default, "
    "strftime(ts, '%Y-%m-%dT%H:%M:%S.') || lpad(CAST((epoch_us(ts) % 1000000) // 1000 AS STRING), 3, '0') || 'Z' AS iso, epoch_us(ts) // 1000 AS millis, "
    "json_extract_string(props, '$.k') AS json_k, lower(event_type) AS header_key, 'AB' || CAST(user_id AS STRING) AS decoded, "
    "sha256(event_type) AS hashed, substr(event_type, 1, 4) || '***' AS masked, round(list_entropy(string_split(event_type, '')), 6) AS bits, "
    "CAST(user_id AS STRING) || ' x' AS url_param, user_id * 2 AS merged FROM events",
)
def f_scalars(t: Tables) -> DataFrame:
    e = t.events_utc
    spaced = F.concat(F.lit("\t Ab "), F.col("event_type"), F.lit("  \n"))
    url = F.concat(F.lit("http://h.example/p?u="), F.col("user_id").cast("string"), F.lit("%20x&v=1"))
    header = F.concat(F.initcap("event_type"), F.lit(": a:b"))
    old = F.create_map(F.lit("a"), F.col("user_id"), F.lit("b"), F.lit(0).cast("bigint"))
    new = F.create_map(F.lit("a"), F.col("user_id") * 2)
    return e.select(
        "event_id",
        C.js_parse_int(F.concat(F.lit(" "), F.col("event_id").cast("string"), F.lit("px"))).alias("parsed_int"),
        F.round(C.js_parse_float(F.concat(F.col("value").cast("string"), F.lit(" usd"))), 6).alias("parsed_float"),
        C.js_trim(spaced).alias("trimmed"),
        C.trimmed_length(spaced).cast("bigint").alias("trimmed_length"),
        F.contains(F.col("event_type"), F.lit("rror")).alias("has_or"),
        F.startswith(F.col("event_type"), F.lit("p")).alias("starts_p"),
        F.concat(F.lit("Item "), (F.col("event_id") + 1).cast("string"), F.lit(": "), F.col("event_type")).alias("message"),
        _falsy(F.when(F.col("event_type") == "view", "").otherwise(F.col("event_type"))).alias("falsy_default"),
        C.iso_timestamp("ts").alias("iso"),
        C.epoch_millis("ts").alias("millis"),
        F.get_json_object("props", "$.k").alias("json_k"),
        F.map_keys(C.header_pair(header))[0].alias("header_key"),
        X.decode_payload(F.concat(F.lit("CHAR(65,66)"), F.col("user_id").cast("string"))).alias("decoded"),
        X.sha256_text("event_type").alias("hashed"),
        X.redact("event_type").alias("masked"),
        X.entropy("event_type").alias("bits"),
        C.query_map(url)["u"].alias("url_param"),
        C.spread(old, new)["a"].alias("merged"),
    )


def _falsy(value):
    body = C.JsonBody(F.to_json(F.struct(value.alias("t"))))
    return body.or_default("t", body.string("t"), F.lit("none"))
