"""Record validation over JSON bodies: all messages, in a fixed order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palisade.functions.coerce import JsonBody, json_type, let, trimmed_length

# Enumerations and messages of the API being validated.
ROLES = ["admin", "user"]
STATUSES = ["pending", "processing", "shipped", "delivered", "cancelled"]

# field, kind, argument, message
RULES = {
    "users": [
        ("name", "text", 2, "Name must be a string with at least 2 characters"),
        ("email", "email", None, "Valid email is required"),
        ("role", "truthy_enum", ROLES, 'Role must be either "admin" or "user"'),
    ],
    "posts": [
        ("title", "text", 3, "Title must be a string with at least 3 characters"),
        ("content", "text", 10, "Content must be a string with at least 10 characters"),
        ("authorId", "positive", None, "Author ID must be a positive number"),
        ("tags", "strings", None, "Tags must be an array of strings"),
        ("published", "boolean", None, "Published must be a boolean"),
    ],
    "products": [
        ("name", "text", 2, "Name must be a string with at least 2 characters"),
        ("description", "text", 10, "Description must be a string with at least 10 characters"),
        ("price", "positive", None, "Price must be a positive number"),
        ("categoryId", "positive", None, "Category ID must be a positive number"),
        ("stock", "nonnegative", None, "Stock must be a non-negative number"),
        ("active", "boolean", None, "Active must be a boolean"),
    ],
    "categories": [
        ("name", "text", 2, "Name must be a string with at least 2 characters"),
        ("description", "text", 5, "Description must be a string with at least 5 characters"),
        ("active", "boolean", None, "Active must be a boolean"),
    ],
    "orders": [
        ("userId", "positive", None, "User ID must be a positive number"),
        ("items", "items", None, "Items must be an array"),
        ("status", "enum", STATUSES, "Status must be one of: pending, processing, shipped, delivered, cancelled"),
    ],
}

ITEM_FIELDS = [("productId", "Product ID"), ("quantity", "Quantity"), ("price", "Price")]


def _bad(body: JsonBody, field: str, kind: str, arg, create: bool) -> Column:
    present, kind_of, text = body.present(field), body.type(field), body.string(field)
    if kind == "text":
        wrong = (kind_of != "string") | (trimmed_length(text) < arg)
        return wrong if create else present & wrong
    if kind == "email":
        wrong = (kind_of != "string") | ~F.contains(text, F.lit("@"))
        return wrong if create else present & wrong
    outside = (kind_of != "string") | ~text.isin(*(arg or [""]))
    if kind == "truthy_enum":
        return (body.truthy(field) if create else present) & outside
    if kind == "enum":
        return present & outside
    number = body.get(field, "double")
    if kind == "positive":
        return present & ((kind_of != "number") | (number <= 0))
    if kind == "nonnegative":
        return present & ((kind_of != "number") | (number < 0))
    if kind == "boolean":
        return present & (kind_of != "boolean")
    if kind == "strings":
        values = body.get(field, "array<variant>")
        all_text = F.forall(values, lambda v: json_type(v) == "string")
        return present & ((kind_of != "array") | ~F.coalesce(all_text, F.lit(False)))
    raise ValueError(kind)


def item_errors(body: JsonBody) -> Column:
    """Messages of nested items, numbered from 1."""
    items = body.get("items", "array<variant>")

    def check(item: Column, n: Column) -> Column:
        def message(key: str, label: str) -> Column:
            # The value is taken out once and its type read once. An absent key gives a NULL variant, which is no number either.
            kind = lambda v: let(F.schema_of_variant(v), lambda k: (
                ~k.isin("VOID", "STRING", "BOOLEAN") & ~k.startswith("ARRAY") & ~k.startswith("OBJECT")))
            ok = let(F.try_variant_get(item, f"$.{key}", "variant"), lambda v: kind(v) & (F.try_variant_get(v, "$", "double") > 0))
            text = F.concat(F.lit("Item "), (n + 1).cast("string"), F.lit(f": {label} must be a positive number"))
            return F.when(~F.coalesce(ok, F.lit(False)), text)

        return F.array_compact(F.array(*[message(k, label) for k, label in ITEM_FIELDS]))

    return F.coalesce(F.flatten(F.transform(items, check)), F.array().cast("array<string>"))


def error_list(body: JsonBody, entity: str, mode: str) -> Column:
    """All messages of a body in rule order; valid bodies give an empty array."""
    create = mode == "create"
    parts = []
    for field, kind, arg, message in RULES[entity]:
        if kind == "items":
            is_array = body.type(field) == "array"
            nested = F.when(is_array, item_errors(body)).otherwise(F.array(F.lit(message)))
            parts.append(F.when(body.present(field), nested).otherwise(F.array().cast("array<string>")))
        else:
            bad = F.coalesce(_bad(body, field, kind, arg, create), F.lit(True))
            parts.append(F.array_compact(F.array(F.when(bad, F.lit(message)))))
    return F.flatten(F.array(*parts))


def validate(df: DataFrame, entity: str, mode: str, body_col: str = "body") -> DataFrame:
    """Add ``errors`` and ``valid``; mode 'create' is strict, 'update' checks present keys only.

    Orders follow the lenient form in both modes. A body that is not JSON gets
    the single message ``Invalid JSON``.
    """
    if mode not in ("create", "update"):
        raise ValueError(mode)
    parsed, body = JsonBody.prepared(df, body_col, [r[0] for r in RULES[entity]])
    errors = F.when(body.valid(), error_list(body, entity, mode)).otherwise(F.array(F.lit("Invalid JSON")))
    return parsed.select(*df.columns, errors.alias("errors")).withColumn("valid", F.size("errors") == 0)


def validate_items(df: DataFrame, items_col: str = "items", offset: Column | None = None) -> DataFrame:
    """The nested check over a typed items column; ``offset`` is the number of items in earlier parts."""
    start = F.lit(1) if offset is None else offset + 1

    def check(item: Column, n: Column) -> Column:
        out = []
        for key, label in ITEM_FIELDS:
            ok = F.coalesce(item[key] > 0, F.lit(False))
            out.append(F.when(~ok, F.concat(F.lit("Item "), (n + start).cast("string"), F.lit(f": {label} must be a positive number"))))
        return F.array_compact(F.array(*out))

    return df.withColumn("errors", F.flatten(F.transform(F.col(items_col), check)))


def json_types(df: DataFrame, paths: dict[str, str], body_col: str = "body") -> DataFrame:
    """Run-time types of JSON keys as columns: name → key."""
    parsed, body = JsonBody.prepared(df, body_col)
    return parsed.select(*df.columns, *[body.type(key).alias(name) for name, key in paths.items()])
