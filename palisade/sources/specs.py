"""API descriptions (OpenAPI 3, as JSON or YAML) as flat tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palisade.operators.sets import append
from palisade.session import cut_lineage

PARAM = "STRUCT<name: STRING, `in`: STRING, required: BOOLEAN, schema: STRING>"
OPERATION = (
    "STRUCT<summary: STRING, security: STRING, requestBody: STRING, "
    f"parameters: ARRAY<{PARAM}>, responses: MAP<STRING, STRING>>"
)
SPEC = (
    "STRUCT<openapi: STRING, security: STRING, servers: ARRAY<STRUCT<url: STRING>>, "
    f"paths: MAP<STRING, MAP<STRING, {OPERATION}>>, "
    "components: STRUCT<schemas: MAP<STRING, STRING>>>"
)
FIELD = (
    "STRUCT<type: STRING, format: STRING, `$ref`: STRING, minimum: DOUBLE, minLength: DOUBLE, "
    "minItems: DOUBLE, maxLength: DOUBLE, enum: ARRAY<STRING>, items: STRING>"
)
OBJECT = f"STRUCT<type: STRING, required: ARRAY<STRING>, properties: MAP<STRING, {FIELD}>>"
REF = r'"[$]ref"\s*:\s*"#/components/schemas/([A-Za-z0-9_]+)"'


def parse_specs(files: DataFrame) -> DataFrame:
    """files(path, content) → (spec, doc); content that is no JSON object gives a null doc."""
    return files.select(F.col("path").alias("spec"), F.from_json("content", SPEC).alias("doc"))


def read_openapi(files: DataFrame) -> dict[str, DataFrame]:
    """endpoints, params, responses, schema_fields and servers of all descriptions."""
    # Parsed once and written: six tables are cut from it.
    docs = cut_lineage(parse_specs(files))
    paths = docs.select("spec", "doc", F.explode("doc.paths").alias("path", "methods"))
    ops = paths.select("spec", "doc", "path", F.explode("methods").alias("method", "op"))
    endpoints = ops.select(
        "spec", "path", F.upper("method").alias("method"), F.col("op.summary").alias("summary"),
        (F.col("op.security").isNotNull() | F.col("doc.security").isNotNull()).alias("has_security"),
    )
    schema = F.from_json("p.schema", FIELD)
    params = ops.select("spec", "path", F.upper("method").alias("method"), F.explode("op.parameters").alias("p")).select(
        "spec", "path", "method", F.col("p.name").alias("name"), F.col("p.in").alias("location"),
        F.coalesce(F.col("p.required"), F.lit(False)).alias("required"),
        schema["type"].alias("type"), schema["minimum"].alias("minimum"), schema["enum"].alias("enum"),
    )
    responses = ops.select("spec", "path", F.upper("method").alias("method"), F.explode("op.responses").alias("status", "r")).select(
        "spec", "path", "method", "status",
        F.get_json_object("r", "$.description").alias("description"),
        F.nullif(F.regexp_extract("r", REF, 1), F.lit("")).alias("ref"),
    )
    comp = docs.select("spec", F.explode("doc.components.schemas").alias("owner", "text")).select(
        "spec", F.lit("schema").alias("kind"), "owner", F.from_json("text", OBJECT).alias("o")
    )
    bodies = ops.where(F.col("op.requestBody").isNotNull()).select(
        "spec", F.lit("body").alias("kind"), F.concat_ws(" ", F.upper("method"), "path").alias("owner"),
        F.from_json(F.get_json_object("op.requestBody", "$.content['application/json'].schema"), OBJECT).alias("o"),
    )
    fields = comp.unionByName(bodies).select("spec", "kind", "owner", "o.required", F.explode("o.properties").alias("field", "f")).select(
        "spec", "kind", "owner", "field", F.col("f.type").alias("type"), F.col("f.format").alias("format"),
        F.coalesce(
            F.nullif(F.regexp_extract(F.coalesce(F.col("f.$ref"), F.lit("")), "#/components/schemas/(.*)$", 1), F.lit("")),
            F.nullif(F.regexp_extract(F.coalesce(F.col("f.items"), F.lit("")), REF, 1), F.lit("")),
        ).alias("ref"),
        F.col("f.minimum").alias("minimum"), F.col("f.minLength").alias("min_length"),
        F.col("f.minItems").alias("min_items"), F.col("f.maxLength").alias("max_length"),
        F.col("f.enum").alias("enum"),
        F.coalesce(F.array_contains("required", F.col("field")), F.lit(False)).alias("required"),
    )
    servers = docs.select("spec", F.explode("doc.servers.url").alias("url"))
    return {"endpoints": endpoints, "params": params, "responses": responses, "schema_fields": fields, "servers": servers}


METHODS = ("get", "put", "post", "delete", "options", "head", "patch", "trace")
SCHEMA_REF = "#/components/schemas/([A-Za-z0-9_]+)"


def spec_tables(rows: DataFrame) -> dict[str, DataFrame]:
    """The tables of ``read_openapi`` from leaves (file, n, path, type, value), as ``yaml_rows`` gives them.

    Every table is a filter on paths and one aggregation, so a description may be of any size.
    """
    p = lambda i: F.get("path", F.lit(i))
    rows = cut_lineage(rows.select(F.col("file").alias("spec"), "n", "path", "type", "value"))
    size = F.size("path")
    ops = rows.where((p(0) == "paths") & (size >= 3) & p(2).isin(*METHODS)).select(
        "spec", p(1).alias("path"), F.upper(p(2)).alias("method"), "n", "type", "value", F.slice("path", 4, 1000).alias("in"))
    i = lambda k: F.get("in", F.lit(k))
    depth = F.size("in")
    value_at = lambda *names: F.max(F.when(
        (depth == len(names)) & F.array_join(F.slice("in", 1, len(names)), "\x01").eqNullSafe("\x01".join(names)), F.col("value")))
    secured = rows.where(p(0) == "security").select("spec").distinct().withColumn("_all", F.lit(True))
    endpoints = ops.groupBy("spec", "path", "method").agg(
        value_at("summary").alias("summary"), F.max((i(0) == "security").cast("int")).alias("_own")).join(secured, "spec", "left").select(
        "spec", "path", "method", "summary", (F.coalesce("_all", F.lit(False)) | (F.coalesce("_own", F.lit(0)) == 1)).alias("has_security"))
    # A parameter's leaves are parameters/i/name, parameters/i/schema/type, parameters/i/schema/enum/j.
    leaf = lambda *names: F.max(F.when((depth == 2 + len(names)) & (F.array_join(F.slice("in", 3, 10), "\x01") == "\x01".join(names)), F.col("value")))
    listed = lambda cond, nth: F.transform(F.array_sort(F.collect_list(F.when(cond, F.struct(nth.cast("int").alias("i"), F.col("value").alias("v"))))), lambda x: x["v"])
    params = ops.where((i(0) == "parameters") & (depth > 1)).groupBy("spec", "path", "method", i(1).alias("_i")).agg(
        leaf("name").alias("name"), leaf("in").alias("location"), F.coalesce(leaf("required") == "true", F.lit(False)).alias("required"),
        leaf("schema", "type").alias("type"), leaf("schema", "minimum").cast("double").alias("minimum"),
        listed((depth == 5) & (i(2) == "schema") & (i(3) == "enum"), i(4)).alias("enum"))
    params = params.drop("_i").withColumn("enum", F.when(F.size("enum") > 0, F.col("enum")))
    target = F.nullif(F.regexp_extract(F.coalesce("value", F.lit("")), f"^{SCHEMA_REF}$", 1), F.lit(""))
    first_ref = F.min(F.when((last_of("in") == "$ref") & target.isNotNull(), F.struct("n", target.alias("v"))))["v"]
    responses = ops.where((i(0) == "responses") & (depth > 1)).groupBy("spec", "path", "method", i(1).alias("status")).agg(
        F.max(F.when((depth == 3) & (i(2) == "description"), F.col("value"))).alias("description"), first_ref.alias("ref"))
    # What an object schema says about a field, wherever the schema stands.
    body = ["requestBody", "content", "application/json", "schema"]
    comp = rows.where((p(0) == "components") & (p(1) == "schemas") & (size >= 4)).select(
        "spec", F.lit("schema").alias("kind"), p(2).alias("owner"), "n", "value", F.slice("path", 4, 1000).alias("in"))
    bodies = ops.where((depth > 4) & (F.array_join(F.slice("in", 1, 4), "\x01") == "\x01".join(body))).select(
        "spec", F.lit("body").alias("kind"), F.concat_ws(" ", "method", "path").alias("owner"), "n", "value", F.slice("in", 5, 1000).alias("in"))
    about = comp.unionByName(bodies)
    attr = lambda name: F.max(F.when((depth == 3) & (i(2) == name), F.col("value")))
    own_ref = F.max(F.when((depth == 3) & (i(2) == "$ref"), F.nullif(F.regexp_extract(F.coalesce("value", F.lit("")), "#/components/schemas/(.*)$", 1), F.lit(""))))
    item_ref = F.min(F.when((i(2) == "items") & (last_of("in") == "$ref") & target.isNotNull(), F.struct("n", target.alias("v"))))["v"]
    fields = about.where((i(0) == "properties") & (depth > 1)).groupBy("spec", "kind", "owner", i(1).alias("field")).agg(
        attr("type").alias("type"), attr("format").alias("format"), F.coalesce(own_ref, item_ref).alias("ref"),
        attr("minimum").cast("double").alias("minimum"), attr("minLength").cast("double").alias("min_length"), attr("minItems").cast("double").alias("min_items"),
        attr("maxLength").cast("double").alias("max_length"), listed((depth == 4) & (i(2) == "enum"), i(3)).alias("enum"))
    needed = about.where((i(0) == "required") & (depth == 2)).select("spec", "kind", "owner", F.col("value").alias("field"), F.lit(True).alias("required")).distinct()
    fields = fields.withColumn("enum", F.when(F.size("enum") > 0, F.col("enum"))).join(needed, ["spec", "kind", "owner", "field"], "left").select(
        "spec", "kind", "owner", "field", "type", "format", "ref", "minimum", "min_length", "min_items", "max_length", "enum",
        F.coalesce("required", F.lit(False)).alias("required"))
    servers = rows.where((p(0) == "servers") & (size == 3) & (p(2) == "url")).select("spec", F.col("value").alias("url"))
    return {"endpoints": endpoints, "params": params, "responses": responses, "schema_fields": fields, "servers": servers}


def last_of(path: str):
    return F.element_at(path, -1)


def resolve_refs(responses: DataFrame, fields: DataFrame) -> DataFrame:
    """Follow references from responses into fields, down to the last level.

    Every level is one equi-join on (spec, schema) and a written table; the loop ends with the first level that refers to
    nothing. A path carries the schemas it went through: a reference back to one of them is a row with ``cyclic`` set
    and is not followed again.
    """
    level = responses.where(F.col("ref").isNotNull()).select(
        "spec", F.concat_ws(" ", "method", "path", "status").alias("source"), F.lit("").alias("at"), "ref", F.array("ref").alias("seen")
    )
    schemas = cut_lineage(fields.where(F.col("kind") == "schema").select(
        F.col("spec").alias("_spec"), F.col("owner").alias("_owner"), "field", "type", F.col("ref").alias("next_ref")
    ))
    out, depth = None, 0
    while True:
        depth += 1
        hop = cut_lineage(level.join(schemas, (level.spec == schemas._spec) & (level.ref == schemas._owner)).select(
            "spec", "source",
            F.concat_ws(".", F.nullif(F.col("at"), F.lit("")), "field").alias("field_path"),
            F.coalesce("type", F.lit("object")).alias("type"), F.lit(depth).alias("depth"),
            F.coalesce(F.array_contains("seen", F.col("next_ref")), F.lit(False)).alias("cyclic"), "next_ref", "seen",
        ))
        rows = hop.drop("next_ref", "seen")
        out = rows if out is None else out.unionByName(rows)
        level = hop.where(F.col("next_ref").isNotNull() & ~F.col("cyclic")).select(
            "spec", "source", F.col("field_path").alias("at"), F.col("next_ref").alias("ref"), F.array_append("seen", F.col("next_ref")).alias("seen")
        )
        if level.isEmpty():
            return out


def lint(api: dict[str, DataFrame]) -> DataFrame:
    """Weak spots of API descriptions: (spec, lint, at)."""
    op = F.concat_ws(" ", "method", "path")
    keys = ["spec", "path", "method"]
    endpoints, fields = api["endpoints"], api["schema_fields"]
    refuses = api["responses"].where(F.col("status").isin("401", "403")).select(*keys).distinct()
    unbounded = (F.col("type") == "string") & F.col("max_length").isNull() & F.col("format").isNull() & F.col("enum").isNull()

    def row(df: DataFrame, name: str, at) -> DataFrame:
        return df.select("spec", F.lit(name).alias("lint"), at.alias("at"))

    return append(
        row(endpoints.where(~F.col("has_security")), "no_security", op),
        row(endpoints.join(refuses, keys, "left_anti"), "no_401_403", op),
        row(fields.where(unbounded), "unbounded_string", F.concat_ws(".", "owner", "field")),
        row(api["servers"].where(F.startswith("url", F.lit("http://"))), "plain_http", F.col("url")),
    )
