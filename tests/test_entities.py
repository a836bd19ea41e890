"""Seed rows and validation cases, typed here as small rows."""

from __future__ import annotations

import json

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from palisade.operators import changes as M
from palisade.operators import filters as P
from palisade.operators.validate import item_errors, validate
from palisade.schemas import ENTITIES
from palisade.sources.entities import read_entities


def now():
    return F.to_timestamp(F.lit("2024-02-01T00:00:00Z"))


@pytest.fixture(scope="module")
def users(spark):
    rows = [(1, "Ann Lee", "ann@example.com", "admin"), (2, "Ben Ray", "ben@example.com", "user"), (3, "Cat Fox", "cat@example.com", "user")]
    return spark.createDataFrame(rows, "id long, name string, email string, role string").select(
        "*", F.to_timestamp(F.lit("2024-01-01")).alias("createdAt"), F.to_timestamp(F.lit("2024-01-01")).alias("updatedAt")
    )


@pytest.fixture(scope="module")
def products(spark):
    rows = [(1, 1299.99, 1, True), (2, 199.99, 1, True), (3, 29.99, 2, False)]
    return spark.createDataFrame(rows, "id long, price double, category_id long, active boolean")


@pytest.fixture(scope="module")
def orders(spark):
    rows = [
        (1, 1, [(1, 1, 1.0, 1299.99), (2, 2, 2.0, 199.99)], 1699.97, "delivered"),
        (2, 2, [(3, 3, 1.0, 29.99)], 29.99, "pending"),
    ]
    schema = "id long, userId long, items array<struct<id:bigint,productId:bigint,quantity:double,price:double>>, totalAmount double, status string"
    return spark.createDataFrame(rows, schema).select("*", now().alias("createdAt"), now().alias("updatedAt"))


def ids(df):
    return sorted(r[0] for r in df.select("id").collect())


def bodies(spark, *texts, raw_ids=None):
    rows = [(i, i, (raw_ids or ["1"] * len(texts))[i], x) for i, x in enumerate(texts)]
    return spark.createDataFrame(rows, "req_id long, seq long, raw_id string, body string")


@pytest.mark.parametrize(
    "params,want",
    [
        ({"active": ""}, [3]), ({"active": "true"}, [1, 2]), ({}, [1, 2, 3]), ({"minPrice": "29.99", "maxPrice": "199.99"}, [2, 3]),
        ({"categoryId": "1abc"}, [1, 2]), ({"categoryId": "abc"}, []), ({"categoryId": ""}, [1, 2, 3]),
        ({"categoryId": "1", "maxPrice": "500"}, [2]),
    ],
)
def test_product_filters(products, params, want):
    assert ids(P.query_entities(products, "products", params)) == want


def test_lookup_statuses(users):
    assert [P.get_by_id(users, raw).first()["status"] for raw in ("2x", "abc", "99")] == [200, 400, 404]


def test_search_wildcards(users):
    assert ids(P.search(users, "name", "a_n")) == [1]
    assert ids(P.search(users, "name", "a_n", literal=True)) == []
    assert ids(P.search(users, "name", "%")) == [1, 2, 3]
    assert ids(P.search(users, "name", "%", literal=True)) == []
    assert ids(P.search(users, "name", "LEE")) == [1]


@pytest.mark.parametrize(
    "entity,mode,body,errors",
    [
        ("users", "create", {"name": "A", "email": "x"}, ["Name must be a string with at least 2 characters", "Valid email is required"]),
        ("users", "update", {}, []),
        ("users", "create", {"name": "Ab", "email": "a@b", "role": ""}, []),
        ("users", "update", {"role": ""}, ['Role must be either "admin" or "user"']),
        ("users", "update", {"role": None}, ['Role must be either "admin" or "user"']),
        ("posts", "create", {"title": "abc", "content": "0123456789", "tags": ["a", 1]}, ["Tags must be an array of strings"]),
        ("posts", "create", {"title": "abc", "content": "0123456789", "tags": [], "authorId": 1}, []),
        ("products", "create", {"name": "ab", "description": "0123456789", "price": None}, ["Price must be a positive number"]),
        ("products", "update", {"stock": -1, "active": 1}, ["Stock must be a non-negative number", "Active must be a boolean"]),
        ("categories", "create", {"name": "ab", "description": " abc  "}, ["Description must be a string with at least 5 characters"]),
        ("orders", "create", {"items": 3}, ["Items must be an array"]),
        (
            "orders", "create", {"items": [{"productId": 0, "quantity": -1, "price": 5}]},
            ["Item 1: Product ID must be a positive number", "Item 1: Quantity must be a positive number"],
        ),
        ("orders", "create", {"status": "lost"}, ["Status must be one of: pending, processing, shipped, delivered, cancelled"]),
        ("orders", "update", {"userId": "1"}, ["User ID must be a positive number"]),
    ],
)
def test_validation(spark, entity, mode, body, errors):
    df = spark.createDataFrame([(json.dumps(body),)], "body string")
    assert validate(df, entity, mode).first()["errors"] == errors


def test_creates(spark, users):
    requests = bodies(
        spark, '{"name":" Dan Ash ","email":"DAN@example.com"}', '{"name":"Ann","email":"ANN@example.com"}', "{bad",
        '{"name":"Dan Two","email":"dan@example.com"}', '{"name":"x"}', '{"name":"Eve Ivy","email":"eve@example.com","role":"admin"}',
    )
    state, responses = M.apply_creates(users, requests, "users", now(), unique="email")
    got = {r["req_id"]: (r["status"], r["error"]) for r in responses.collect()}
    assert got == {
        0: (201, None), 1: (409, "Email already exists"), 2: (400, "Invalid JSON"), 3: (409, "Email already exists"),
        4: (400, "Validation failed"), 5: (201, None),
    }
    new = {r["id"]: (r["name"], r["email"], r["role"]) for r in state.where("id > 3").collect()}
    assert new == {4: ("Dan Ash", "dan@example.com", "user"), 5: ("Eve Ivy", "eve@example.com", "admin")}


def test_order_creates(spark, orders):
    item = '{"productId":1,"quantity":2,"price":1.5}'
    requests = bodies(spark, f'{{"userId":1,"items":[{item},{item}]}}', '{"userId":1}', f'{{"items":[{item}],"totalAmount":0}}')
    state, responses = M.apply_creates(orders, requests, "orders", now())
    assert sorted((r["req_id"], r["status"], r["error"]) for r in responses.collect()) == [(0, 201, None), (1, 400, "Missing items"), (2, 201, None)]
    new = {r["id"]: r for r in state.where("id > 2").collect()}
    assert new[3]["totalAmount"] == 6.0 and new[4]["totalAmount"] == 0.0
    assert [i["id"] for i in new[3]["items"]] == [1706745600000, 1706745600001]
    assert new[3]["status"] == "pending"


def test_order_updates(spark, orders):
    item = '{"productId":9,"quantity":1,"price":10}'
    requests = bodies(spark, f'{{"items":[{item},{item},{item}]}}', '{"totalAmount":0}', raw_ids=["1", "2"])
    state, responses, _ = M.apply_updates(orders, requests, "orders", now())
    got = {r["id"]: r for r in state.collect()}
    assert [i["id"] for i in got[1]["items"]] == [1, 2, 1706745600002]
    assert got[1]["totalAmount"] == 30.0
    assert got[2]["totalAmount"] == 29.99
    assert got[1]["status"] == "delivered"


def test_orders_updated_twice_in_a_batch(spark, orders):
    """A shorter body drops the ids behind it; a longer one after it gets fresh ones."""
    item = '{"productId":9,"quantity":1,"price":10}'
    requests = bodies(spark, f'{{"items":[{item}]}}', f'{{"items":[{item},{item}]}}', raw_ids=["1", "1"])
    state, _, _ = M.apply_updates(orders, requests, "orders", now())
    assert [i["id"] for i in state.where("id = 1").first()["items"]] == [1, 1706745600001]


def test_updates(spark, users):
    requests = bodies(
        spark, '{"email":"ANN@example.com"}', '{"email":"ann@example.com"}', '{"name":"New Cat","isAdmin":true}', "{bad", "{}", "{}",
        raw_ids=["1", "2", "3", "3", "abc", "99"],
    )
    state, responses, extra = M.apply_updates(users, requests, "users", now(), unique="email")
    assert {r["req_id"]: r["status"] for r in responses.collect()} == {0: 200, 1: 409, 2: 200, 3: 400, 4: 400, 5: 404}
    assert [tuple(r) for r in extra.collect()] == [(2, 3, "isAdmin")]
    assert {r["id"]: r["name"] for r in state.collect()}[3] == "New Cat"
    assert "isAdmin" not in state.columns


def test_deletes(spark, users):
    state, gone = M.apply_deletes(users, spark.createDataFrame([(2,), (2,), (9,)], "id long"))
    assert ids(state) == [1, 3] and ids(gone) == [2]


CHANGE = st.tuples(st.sampled_from(["POST", "PUT", "DELETE", "GET"]), st.integers(1, 4), st.text("xyz", min_size=1, max_size=2))


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(CHANGE, min_size=1, max_size=25))
def test_fold_equals_sequential_apply(spark, changes):
    start = {1: ("one", "k1"), 2: ("two", "k2")}
    state = spark.createDataFrame([(i, *v) for i, v in start.items()], "id long, name string, keep string")
    rows = [(n, n, m, i, name if m in ("POST", "PUT") else None) for n, (m, i, name) in enumerate(changes)]
    requests = spark.createDataFrame(rows, "req_id long, seq long, method string, id long, new_name string")
    model, statuses = dict(start), {}
    for n, (m, i, name) in enumerate(changes):
        if m == "POST":
            statuses[n] = 409 if i in model else 201
            model.setdefault(i, (name, None))
        elif i not in model:
            statuses[n] = 404
        else:
            statuses[n] = 200
            if m == "PUT":
                model[i] = (name, model[i][1])
            elif m == "DELETE":
                del model[i]
    # Buckets of three requests: the carry between buckets is exercised.
    after, responses = M.apply_changes(state, requests, {"name": F.col("new_name")}, width=3)
    assert {r["id"]: (r["name"], r["keep"]) for r in after.collect()} == model
    assert {r["req_id"]: r["status"] for r in responses.collect()} == statuses


def test_read_entities_has_fixed_schema(spark, users, tmp_path):
    users.write.parquet(str(tmp_path / "u"))
    got = read_entities(spark, str(tmp_path / "u"), "users")
    assert got.schema == ENTITIES["users"]
    assert ids(got) == [1, 2, 3]


@pytest.mark.parametrize("raw_id", ["id", "'abc'"])
def test_requests_without_a_claim_are_spread(spark, raw_id):
    """Requests that ask for no key, or have no id, do not meet in one task."""
    state = spark.range(400).selectExpr("id", "concat('u', id) AS name", "concat('u', id, '@x') AS email", "'user' AS role").select(
        "*", now().alias("createdAt"), now().alias("updatedAt"))
    requests = spark.range(400).selectExpr("id AS req_id", "id AS seq", f"string({raw_id}) AS raw_id", "'{\"name\":\"new name\"}' AS body").repartition(4, "seq")
    plain = {"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    before = {k: spark.conf.get(k) for k in plain}
    try:
        for k, v in plain.items():
            spark.conf.set(k, v)
        _, responses, _ = M.apply_updates(state, requests, "users", now(), unique="email")
        per_task = [r["count"] for r in responses.groupBy(F.spark_partition_id()).count().collect()]
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert sum(per_task) == 400 and max(per_task) < 200


def test_claims_of_one_key(spark, users):
    """Of two that ask for a free key the first gets it; a held key and one asked for again by its winner."""
    asked = [(1, "1", "New@x.com"), (2, "2", "new@x.com"), (3, "1", "new@x.com"), (4, "3", "ann@example.com"), (5, None, "q@x.com"), (6, "2", "ben@example.com")]
    requests = spark.createDataFrame([(i, i, r, json.dumps({"email": e})) for i, r, e in asked], "req_id int, seq int, raw_id string, body string")
    state, responses, _ = M.apply_updates(users, requests, "users", now(), unique="email")
    assert {r.req_id: r.status for r in responses.collect()} == {1: 200, 2: 409, 3: 200, 4: 409, 5: 400, 6: 200}
    assert sorted(r.email for r in state.collect()) == ["ben@example.com", "cat@example.com", "new@x.com"]


def test_an_items_type_is_read_once(spark):
    """One look at the type of each of an item's three values, with the same messages."""
    out = M.JsonBody.prepared(spark.createDataFrame([
        ('{"items":[{"productId":1,"quantity":"2","price":true},{"productId":0,"quantity":1.5,"price":null},{"quantity":[1],"price":{}},3]}',)], "body string"), "body")
    df = out[0].select(item_errors(out[1]).alias("e"))
    label = {"productId": "Product ID", "quantity": "Quantity", "price": "Price"}
    bad = [(1, "quantity"), (1, "price"), (2, "productId"), (2, "price"), *[(i, k) for i in (3, 4) for k in label]]
    assert df.first().e == [f"Item {i}: {label[k]} must be a positive number" for i, k in bad]
    assert df._jdf.queryExecution().analyzed().toString().count("schema_of_variant") == 3
