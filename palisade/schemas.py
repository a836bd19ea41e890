"""Fixed schemas of entities, findings and the tables derived from specs and logs."""

from __future__ import annotations

from pyspark.sql import types as T

LONG, INT, DOUBLE, TEXT, FLAG, TIME = (
    T.LongType(), T.IntegerType(), T.DoubleType(), T.StringType(), T.BooleanType(), T.TimestampType(),
)


def table(**columns: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in columns.items()])


ITEM = table(id=LONG, productId=LONG, quantity=DOUBLE, price=DOUBLE)
ITEMS = "array<struct<id: bigint, productId: bigint, quantity: double, price: double>>"
TEXT_MAP = T.MapType(TEXT, TEXT)

ENTITIES = {
    "users": table(id=LONG, name=TEXT, email=TEXT, role=TEXT, createdAt=TIME, updatedAt=TIME),
    "posts": table(
        id=LONG, title=TEXT, content=TEXT, authorId=LONG, tags=T.ArrayType(TEXT), createdAt=TIME, updatedAt=TIME, published=FLAG
    ),
    "products": table(
        id=LONG, name=TEXT, description=TEXT, price=DOUBLE, categoryId=LONG, stock=DOUBLE, createdAt=TIME, updatedAt=TIME, active=FLAG
    ),
    "categories": table(id=LONG, name=TEXT, description=TEXT, createdAt=TIME, updatedAt=TIME, active=FLAG),
    "orders": table(
        id=LONG, userId=LONG, items=T.ArrayType(ITEM), totalAmount=DOUBLE, status=TEXT, createdAt=TIME, updatedAt=TIME
    ),
    "sql_users": table(id=LONG, username=TEXT, email=TEXT),
}

REQUESTS = table(
    req_id=LONG, seq=LONG, ts=TIME, user_id=LONG, method=TEXT, path=TEXT, params=TEXT_MAP, body=TEXT
)

FINDINGS = table(
    scan_id=TEXT, repo=TEXT, path=TEXT, line=INT, detector=TEXT, rule_id=TEXT, vector_id=INT, severity=INT,
    match=TEXT, confidence=DOUBLE, fingerprint=TEXT, attrs=TEXT_MAP,
)

DEPENDENCIES = table(repo=TEXT, manifest=TEXT, ecosystem=TEXT, name=TEXT, spec=TEXT, version=TEXT, scope=TEXT)

EVENTS = table(event_id=LONG, ts=T.TimestampNTZType(), user_id=LONG, event_type=TEXT, value=DOUBLE, props=TEXT)
