"""API descriptions and scanner logs, typed here."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from palisade.operators.detect.code import code_endpoints
from palisade.operators.joins import constraint_drift, drift
from palisade.sources.scanner_log import read_log_lines, read_scanner_log
from palisade.sources.specs import read_openapi, resolve_refs

COLLECTIONS = ["rooms", "guests", "stays"]


def description() -> dict:
    """A health check and three collections: list, create, read, replace, remove."""
    paths: dict = {"/api/health": {"get": {"summary": "Health", "responses": {"200": {"description": "ok"}}}}}
    for c in COLLECTIONS:
        ref = {"$ref": f"#/components/schemas/{c.capitalize()}"}
        many = {"description": "ok", "content": {"application/json": {"schema": {"type": "array", "items": ref}}}}
        one = {"description": "ok", "content": {"application/json": {"schema": ref}}}
        body = {"content": {"application/json": {"schema": {"type": "object", "required": ["price"], "properties": {"price": {"type": "number", "minimum": 0.01}}}}}}
        key = [{"name": "id", "in": "path", "required": True, "schema": {"type": "integer", "minimum": 1}}]
        paths[f"/api/{c}"] = {
            "get": {"responses": {"200": many}, "parameters": [{"name": "q", "in": "query", "schema": {"type": "string", "enum": ["a", "b"]}}]},
            "post": {"responses": {"201": one, "400": {"description": "bad"}}, "requestBody": body},
        }
        paths[f"/api/{c}/{{id}}"] = {m: {"parameters": key, "responses": {"200": one}} for m in ("get", "put", "delete")}
    schemas = {c.capitalize(): {"type": "object", "properties": {"id": {"type": "integer"}, "name": {"type": "string"}}} for c in COLLECTIONS}
    schemas["Stays"]["properties"]["guest"] = {"$ref": "#/components/schemas/Guests"}
    return {"openapi": "3.0.3", "servers": [{"url": "http://api.example:80"}], "paths": paths, "components": {"schemas": schemas}}


@pytest.fixture(scope="module")
def api(spark):
    return read_openapi(spark.createDataFrame([("spec", json.dumps(description()))], "path string, content string"))


def test_references_to_the_last_level(spark):
    """Seven nested schemas, the last of which refers back to the second."""
    ref = lambda n: {"$ref": f"#/components/schemas/S{n}"}
    schemas = {f"S{n}": {"type": "object", "properties": {"x": ref(n + 1 if n < 7 else 2), "v": {"type": "string"}}} for n in range(1, 8)}
    get = {"responses": {"200": {"description": "ok", "content": {"application/json": {"schema": ref(1)}}}}}
    text = json.dumps({"openapi": "3.0.3", "paths": {"/a": {"get": get}}, "components": {"schemas": schemas}})
    api = read_openapi(spark.createDataFrame([("deep", text)], "path string, content string"))
    rows = {r["field_path"]: (r["depth"], r["cyclic"]) for r in resolve_refs(api["responses"], api["schema_fields"]).collect()}
    x = lambda n: ".".join("x" * n)
    assert rows == {**{x(n): (n, n == 7) for n in range(1, 8)}, **{".".join([*"x" * (n - 1), "v"]): (n, False) for n in range(1, 8)}}


def test_inventory(api):
    e = api["endpoints"]
    assert (e.select("path").distinct().count(), e.count()) == (7, 16)
    assert e.where("has_security").count() == 0
    assert api["servers"].first()["url"] == "http://api.example:80"
    assert api["params"].where("location = 'path' AND required AND minimum = 1").count() == 9
    assert [r["enum"] for r in api["params"].where("path = '/api/guests' AND name = 'q'").collect()] == [["a", "b"]]
    assert api["responses"].where("ref IS NOT NULL").count() == 15


def test_references(api):
    flat = resolve_refs(api["responses"], api["schema_fields"])
    got = {r["field_path"] for r in flat.where("source = 'GET /api/stays 200'").collect()}
    assert got == {"id", "name", "guest", "guest.id", "guest.name"}


def test_code_and_description_agree_on_paths(spark, api):
    rows = [("r", "api/health/route.ts", "export async function GET() {}")]
    for c in COLLECTIONS:
        rows.append(("r", f"api/{c}/route.ts", "export async function GET(r) {}\nexport async function POST(r) {}"))
        rows.append(("r", f"api/{c}/[id]/route.ts", "\n".join(f"export async function {m}(r) {{}}" for m in ("GET", "PUT", "DELETE"))))
    code = code_endpoints(spark.createDataFrame(rows, "repo string, path string, content string"))
    assert code.count() == 16
    d = drift(api["endpoints"], code, ["path", "method"])
    assert d.where("status <> 'both'").count() == 0


def test_constraint_drift(spark, api):
    spec = api["schema_fields"].where("kind = 'body'").select("owner", "field", "required", "minimum")
    code = spec.select("owner", "field", F.lit(False).alias("required"), F.lit(0.0).alias("minimum"))
    got = constraint_drift(spec, code, ["owner", "field"], ["required", "minimum"])
    assert {r["attr"] for r in got.collect()} == {"required", "minimum"} and got.count() == 6


LOG = """banner
[*] starting @ 21:40:00 /2024-06-30/
[WARNING] page not found (404)
[*] ending @ 21:40:02 /2024-06-30/
[*] starting @ 21:55:10 /2024-06-30/
Parameter: room (POST)
    Type: UNION query
    Title: 4 columns
    Payload: room=b' UNION ALL SELECT NULL

    Type: time-based blind
    Title: delay
    Payload: room=b' AND SLEEP(2)
back-end DBMS: PostgreSQL
[*] ending @ 21:55:31 /2024-06-30/
"""


@pytest.mark.parametrize("width", [2, 100_000])
def test_scanner_log(spark, tmp_path, width):
    (tmp_path / "scan.log").write_text(LOG)
    log = read_scanner_log(read_log_lines(spark, str(tmp_path)), width)
    runs = {r["run"]: (r["started"][:8], r["ended"][:8], r["dbms"]) for r in log["runs"].collect()}
    assert runs == {1: ("21:40:00", "21:40:02", None), 2: ("21:55:10", "21:55:31", "PostgreSQL")}
    points = sorted((r["run"], r["parameter"], r["place"], r["type"]) for r in log["points"].collect())
    assert points == [(2, "room", "POST", "UNION query"), (2, "room", "POST", "time-based blind")]
