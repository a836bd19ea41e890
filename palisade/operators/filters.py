"""Optional filters, lookups and search over entity collections.

Filter values arrive as request strings. ``None`` means *absent*; the rules for
``''`` differ per kind and follow the functions' docstrings.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from palisade.functions.coerce import js_parse_float, js_parse_int


def project(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return df.select(*cols)


def eq_predicate(col: str, raw: str | None) -> Column | None:
    """Equality; absent and '' mean no filter."""
    return F.col(col) == F.lit(raw) if raw else None


def int_predicate(col: str, raw: str | None) -> Column | None:
    """Equality with the integer prefix; no prefix keeps nothing."""
    return F.col(col) == js_parse_int(F.lit(raw)) if raw else None


def bool_predicate(col: str, raw: str | None) -> Column | None:
    """Present means filter: anything but 'true' (also '') keeps the false rows."""
    return F.col(col) == F.lit(raw == "true") if raw is not None else None


def range_predicate(col: str, lo: str | None, hi: str | None) -> Column | None:
    """Inclusive range, either end optional; '' means no bound."""
    parts = []
    if lo:
        parts.append(F.col(col) >= js_parse_float(F.lit(lo)))
    if hi:
        parts.append(F.col(col) <= js_parse_float(F.lit(hi)))
    return _all(parts)


def tag_predicate(col: str, tag: str | None) -> Column | None:
    """Exact-case membership in an array column."""
    return F.array_contains(F.col(col), tag) if tag else None


def is_enum(col: Column | str, values: Sequence[str]) -> Column:
    col = F.col(col) if isinstance(col, str) else col
    return col.isin(*values)


def _all(parts: Sequence[Column | None]) -> Column | None:
    kept = [p for p in parts if p is not None]
    if not kept:
        return None
    out = kept[0]
    for p in kept[1:]:
        out = out & p
    return out


def _where(df: DataFrame, predicate: Column | None) -> DataFrame:
    return df if predicate is None else df.where(predicate)


def filter_eq(df: DataFrame, col: str, raw: str | None) -> DataFrame:
    return _where(df, eq_predicate(col, raw))


def filter_int(df: DataFrame, col: str, raw: str | None) -> DataFrame:
    return _where(df, int_predicate(col, raw))


def filter_bool(df: DataFrame, col: str, raw: str | None) -> DataFrame:
    return _where(df, bool_predicate(col, raw))


def filter_range(df: DataFrame, col: str, lo: str | None, hi: str | None) -> DataFrame:
    return _where(df, range_predicate(col, lo, hi))


def filter_tag(df: DataFrame, col: str, tag: str | None) -> DataFrame:
    return _where(df, tag_predicate(col, tag))


# Query parameters of every collection: parameter → (kind, column).
PARAMETERS = {
    "users": {"role": ("eq", "role")},
    "posts": {"authorId": ("int", "author_id"), "tag": ("tag", "tags"), "published": ("bool", "published")},
    "products": {
        "categoryId": ("int", "category_id"),
        "minPrice": ("min", "price"),
        "maxPrice": ("max", "price"),
        "active": ("bool", "active"),
    },
    "categories": {"active": ("bool", "active")},
    "orders": {"userId": ("int", "user_id"), "status": ("eq", "status")},
}

_KINDS = {
    "eq": eq_predicate,
    "int": int_predicate,
    "bool": bool_predicate,
    "tag": tag_predicate,
    "min": lambda col, raw: range_predicate(col, raw, None),
    "max": lambda col, raw: range_predicate(col, None, raw),
}


def query_entities(df: DataFrame, entity: str, params: Mapping[str, str | None],
                   columns: Mapping[str, str] | None = None) -> DataFrame:
    """Conjunction of a collection's optional filters as one predicate."""
    columns = columns or {}
    parts = [
        _KINDS[kind](columns.get(name, col), params.get(name)) for name, (kind, col) in PARAMETERS[entity].items()
    ]
    return _where(df, _all(parts))


def get_by_id(df: DataFrame, raw_id: str, id_col: str = "id") -> DataFrame:
    """Point lookup as one row: status 400 (no number), 404 (no row) or 200 with the entity."""
    spark = df.sparkSession
    ask = spark.range(1).select(js_parse_int(F.lit(raw_id)).alias("_ask"))
    # The asked id is one row by construction.
    hit = df.where(F.col(id_col) == js_parse_int(F.lit(raw_id))).limit(1)
    joined = ask.join(hit, F.col("_ask") == F.col(id_col), "left")
    status = F.when(F.col("_ask").isNull(), 400).when(F.col(id_col).isNull(), 404).otherwise(200)
    return joined.select(status.alias("status"), *[hit[c] for c in df.columns])


def search(df: DataFrame, col: str, q: str, literal: bool = False) -> DataFrame:
    """Case-insensitive substring search; '%' and '_' are wildcards unless ``literal``."""
    if literal:
        return df.where(F.contains(F.lower(F.col(col)), F.lower(F.lit(q))))
    return df.where(F.col(col).ilike(f"%{q}%"))


def find_one(df: DataFrame, col: str, value: str, order: str = "id") -> DataFrame:
    return df.where(F.col(col) == F.lit(value)).orderBy(order).limit(1)


def run_sql(spark: SparkSession, sql: str, args: Mapping[str, object], **tables: DataFrame) -> DataFrame:
    """Parameterised SQL: values are bound by name, never concatenated."""
    for name, df in tables.items():
        df.createOrReplaceTempView(name)
    return spark.sql(sql, args=dict(args))


def in_order(df: DataFrame, *order: str) -> DataFrame:
    """Stable list order, applied at the sink only."""
    return df.orderBy(*order)


def first_row(df: DataFrame, *order: str) -> DataFrame:
    return df.orderBy(*order).limit(1)


def top(df: DataFrame, k: int, *order: Column) -> DataFrame:
    """Global top-k: every task keeps k rows, only those reach the last one."""
    return df.orderBy(*order).limit(k)
