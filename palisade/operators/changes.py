"""Batches of create, update and delete requests applied to a state table.

All operators are set-based: a batch is a DataFrame of requests ordered by
``seq``. Within a batch the first writer of a unique key wins.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palisade.functions.coerce import JsonBody, js_parse_int, js_trim
from palisade.operators.ordered import carry_last, global_order, seq_bucket
from palisade.operators.validate import error_list
from palisade.schemas import ENTITIES, ITEMS
from palisade.session import cut_lineage

TRIMMED = {"name", "title", "content", "description"}
LABELS = {"users": "user", "posts": "post", "products": "product", "categories": "category", "orders": "order"}
TITLES = {k: v.capitalize() for k, v in LABELS.items()}
PROTECTED = {"id", "createdAt", "updatedAt"}


def assign_ids(new: DataFrame, state: DataFrame, order: Sequence[str], id_col: str = "id") -> DataFrame:
    """``max(id) + position``; the position needs no single-task window."""
    top = state.agg(F.coalesce(F.max(id_col), F.lit(0))).scalar()
    numbered = global_order(new, order)
    return numbered.select((F.col("index") + top).alias(id_col), *[c for c in new.columns if c != id_col])


def _body_fields(entity: str) -> list[str]:
    return [f for f in ENTITIES[entity].fieldNames() if f not in PROTECTED]


def item_ids(items: Column, now_ms: Column, old_items: Column | None = None, kept_below: Column | None = None) -> Column:
    """Child ids by position: the old id where there is one (below position ``kept_below``), else now + position."""

    def fix(item: Column, n: Column) -> Column:
        fresh = now_ms + n.cast("bigint")
        kept = fresh
        if old_items is not None:
            old = F.get(old_items, n)["id"]
            kept = F.when((old != 0) & (n < kept_below if kept_below is not None else F.lit(True)), old).otherwise(fresh)
        return F.struct(
            kept.alias("id"), item["productId"].alias("productId"), item["quantity"].alias("quantity"), item["price"].alias("price")
        )

    return F.transform(items, fix)


def order_total(items: Column) -> Column:
    return F.aggregate(items, F.lit(0.0), lambda a, i: a + i["price"] * i["quantity"])


def body_value(body: JsonBody, entity: str, field: str) -> Column:
    """A body field in the entity's type."""
    kind = ENTITIES[entity][field].dataType.simpleString()
    if field == "items":
        return body.get("items", ITEMS)
    if kind == "string":
        text = body.string(field)
        if field in TRIMMED:
            return js_trim(text)
        return F.lower(text) if field == "email" else text
    if kind == "boolean":
        return body.boolean(field)
    if kind == "bigint":
        return body.integer(field)
    if kind == "double":
        return body.number(field)
    return body.get(field, kind)


def new_entity(body: JsonBody, entity: str, now: Column) -> dict[str, Column]:
    """Column per field (except id) of a created entity, defaults included."""
    out: dict[str, Column] = {}
    for field in ENTITIES[entity].fieldNames():
        if field == "id":
            continue
        if field in ("createdAt", "updatedAt"):
            out[field] = now
            continue
        value = body_value(body, entity, field)
        if (entity, field) == ("users", "role"):
            value = body.or_default(field, value, F.lit("user"))
        elif (entity, field) == ("posts", "tags"):
            value = body.or_default(field, value, F.array().cast("array<string>"))
        elif (entity, field) == ("products", "stock"):
            value = body.or_default(field, value, F.lit(0.0))
        elif field == "published":
            value = body.undef_default(field, value, F.lit(False))
        elif field == "active":
            value = body.undef_default(field, value, F.lit(True))
        elif (entity, field) == ("orders", "status"):
            value = body.or_default(field, value, F.lit("pending"))
        elif (entity, field) == ("orders", "totalAmount"):
            value = F.when(body.present(field), value).otherwise(order_total(body_value(body, entity, "items")))
        elif field == "items":
            value = item_ids(value, F.unix_millis(now))
        out[field] = value
    return out


def unknown_keys(body: JsonBody, entity: str) -> Column:
    """Keys of a body that an update must not write."""
    allowed = [f for f in ENTITIES[entity].fieldNames() if f not in PROTECTED]
    return F.array_except(body.keys(), F.array(*[F.lit(f) for f in allowed]))


def _respond(status: Column, error: Column, details: Column) -> list[Column]:
    empty = F.array().cast("array<string>")
    return [
        status.alias("status"),
        F.when(status >= 400, error).alias("error"),
        F.when(status == 400, F.coalesce(details, empty)).otherwise(empty).alias("details"),
    ]


def apply_creates(state: DataFrame, requests: DataFrame, entity: str, now: Column,
                  unique: str | None = None) -> tuple[DataFrame, DataFrame]:
    """requests(req_id, seq, body) → (new state, responses).

    Ladder: JSON 400 → validation 400 → duplicate 409 → 201. Duplicates are found
    against the state and, inside the batch, against the earliest accepted seq.
    """
    parsed, body = JsonBody.prepared(requests.select("req_id", "seq", "body"), "body", _body_fields(entity))
    errors = F.when(body.valid(), error_list(body, entity, "create"))
    missing = (~body.present("items")) if entity == "orders" else F.lit(False)
    checked = parsed.select(
        "req_id", "seq", body.valid().alias("_json"), errors.alias("_errors"), missing.alias("_missing"),
        *[c.alias(n) for n, c in new_entity(body, entity, now).items()],
    )
    # Written once: the duplicate check, the new rows and the responses all read it.
    checked = cut_lineage(checked)
    ok = F.col("_json") & (F.size("_errors") == 0) & ~F.col("_missing")
    checked = checked.withColumn("_ok", F.coalesce(ok, F.lit(False)))
    if unique:
        held = state.select(F.col(unique).alias("_held")).distinct()
        first = checked.where("_ok").groupBy(F.col(unique).alias("_key")).agg(F.min("seq").alias("_first"))
        checked = (
            checked.join(held, checked[unique] == F.col("_held"), "left")
            .join(first, checked[unique] == F.col("_key"), "left")
            .withColumn("_dup", F.col("_ok") & (F.col("_held").isNotNull() | (F.col("seq") > F.col("_first"))))
            .drop("_held", "_key", "_first")
        )
    else:
        checked = checked.withColumn("_dup", F.lit(False))
    status = (
        F.when(~F.col("_ok"), 400).when(F.col("_dup"), 409).otherwise(201)
    )
    error = (
        F.when(~F.col("_json"), "Invalid JSON")
        .when(F.size("_errors") > 0, "Validation failed")
        .when(F.col("_missing"), "Missing items")
        .otherwise("Email already exists")
    )
    fields = [f for f in ENTITIES[entity].fieldNames() if f != "id"]
    accepted = checked.where(F.col("_ok") & ~F.col("_dup")).select("seq", *fields)
    created = assign_ids(accepted, state, ["seq"]).drop("seq")
    responses = checked.select("req_id", *_respond(status, error, F.col("_errors")))
    return state.unionByName(created.select(*state.columns)), responses


def apply_deletes(state: DataFrame, ids: DataFrame, id_col: str = "id") -> tuple[DataFrame, DataFrame]:
    """(state without the ids, the deleted rows)."""
    gone = ids.select(F.col(ids.columns[0]).alias(id_col)).distinct()
    return state.join(gone, id_col, "left_anti"), state.join(gone, id_col, "left_semi")


def apply_updates(state: DataFrame, requests: DataFrame, entity: str, now: Column,
                  unique: str | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """requests(req_id, seq, raw_id, body) → (new state, responses, mass-assignment keys).

    Ladder: bad id 400 → not found 404 → JSON 400 → validation 400 → duplicate 409 → 200.
    Accepted requests of one id are folded per field: the last present value wins,
    so an explicit null overwrites and an absent key keeps the old value.
    """
    label, title = LABELS[entity], TITLES[entity]
    fields = _body_fields(entity)
    parsed, body = JsonBody.prepared(requests.select("req_id", "seq", js_parse_int("raw_id").alias("_id"), "body"), "body", _body_fields(entity))

    def written(field: str) -> Column:
        """(seq, value) where the body writes the field: present, and truthy where the update guards for it."""
        guarded = field in TRIMMED or field in ("email", "items", "totalAmount")
        kept = body.truthy(field) if guarded else body.present(field)
        return F.when(kept, F.struct(F.col("seq").alias("s"), body_value(body, entity, field).alias("v"))).alias(f"_n_{field}")

    # Everything that needs the body is computed and written here, before the joins that read it several times.
    asked = cut_lineage(parsed.select(
        "req_id", "seq", "_id",
        F.when(body.valid(), error_list(body, entity, "update")).alias("_errors"),
        unknown_keys(body, entity).alias("_extra"),
        (F.when(body.truthy(unique), F.lower(body.string(unique))) if unique else F.lit(None).cast("string")).alias("_ask"),
        *[written(f) for f in fields],
    ))
    old = state.select(F.col("id").alias("_sid"), *([F.col(unique).alias("_own")] if unique else []))
    # Requests without an id meet nothing: they stay out of the joins, where all of them would be one key.
    lost = asked.where(F.col("_id").isNull()).select("*", *[F.lit(None).cast(f.dataType).alias(f.name) for f in old.schema])
    src = asked.where(F.col("_id").isNotNull()).join(old, F.col("_id") == F.col("_sid"), "left").withColumn(
        "_ok", F.coalesce(F.col("_sid").isNotNull() & (F.size("_errors") == 0), F.lit(False))
    )
    if unique:
        # A claim is a changed key of a request that passed everything before it.
        changed = F.col("_ok") & (F.col("_ask") != F.col("_own"))
        src = src.withColumn("_want", F.when(changed, F.col("_ask")))
        claims = src.where(F.col("_want").isNotNull())
        held = state.select(F.col(unique).alias("_held")).distinct()
        first = claims.groupBy(F.col("_want").alias("_key")).agg(F.min_by("_id", "seq").alias("_winner"))
        asked_for = claims.select(F.col("_id").alias("_by"), F.col("_want").alias("_for")).distinct()
        judged = asked_for.join(held, F.col("_for") == F.col("_held"), "left").join(first, F.col("_for") == F.col("_key"), "left").select(
            "_by", "_for", (F.col("_held").isNotNull() | (F.col("_winner") != F.col("_by"))).alias("_taken"))
        # Joined by id and key, so that requests without a claim are spread by their ids.
        src = src.join(judged, (F.col("_id") == F.col("_by")) & (F.col("_want") == F.col("_for")), "left").withColumn(
            "_dup", F.when(F.col("_want").isNull(), F.lit(False)).otherwise(F.col("_taken"))).drop("_by", "_for", "_taken")
        lost = lost.withColumn("_want", F.lit(None).cast("string"))
    else:
        src = src.withColumn("_dup", F.lit(False))
    src = src.unionByName(lost.withColumn("_ok", F.lit(False)).withColumn("_dup", F.lit(False)))
    status = (
        F.when(F.col("_id").isNull(), 400)
        .when(F.col("_sid").isNull(), 404)
        .when(~F.col("_ok"), 400)
        .when(F.col("_dup"), 409)
        .otherwise(200)
    )
    error = (
        F.when(F.col("_id").isNull(), f"Invalid {label} ID")
        .when(F.col("_sid").isNull(), f"{title} not found")
        .when(F.col("_errors").isNull(), "Invalid JSON")
        .when(F.size("_errors") > 0, "Validation failed")
        .otherwise("Email already exists")
    )
    responses = src.select("req_id", *_respond(status, error, F.col("_errors")))
    wins = src.where(F.col("_ok") & ~F.col("_dup"))

    folds = [F.max_by(f"_n_{f}", F.when(F.col(f"_n_{f}").isNotNull(), F.col("seq"))).alias(f"_f_{f}") for f in fields]
    if "items" in fields:
        # A request with fewer items drops the ids of the positions it lacks; a later one cannot bring them back.
        folds.append(F.min(F.when(F.col("_n_items").isNotNull(), F.size("_n_items.v"))).alias("_fewest"))
    folded = wins.groupBy(F.col("_id").alias("_fid")).agg(*folds)
    joined = state.join(folded, state.id == F.col("_fid"), "left")
    out = []
    for f in ENTITIES[entity].fields:
        if f.name == "updatedAt":
            col = F.when(F.col("_fid").isNotNull(), now).otherwise(state[f.name])
        elif f.name in PROTECTED:
            col = state[f.name]
        elif f.name == "items":
            fresh = item_ids(F.col("_f_items.v"), F.unix_millis(now), state["items"], F.col("_fewest"))
            col = F.when(F.col("_f_items").isNotNull(), fresh).otherwise(state["items"])
        elif f.name == "totalAmount" and entity == "orders":
            # The newer of an explicit total and a total recomputed from items; one body with both keeps the explicit one.
            explicit, items = F.col("_f_totalAmount"), F.col("_f_items")
            use_explicit = explicit.isNotNull() & (items.isNull() | (explicit["s"] >= items["s"]))
            col = (
                F.when(use_explicit, explicit["v"])
                .when(items.isNotNull(), order_total(items["v"]))
                .otherwise(state["totalAmount"])
            )
        else:
            col = F.when(F.col(f"_f_{f.name}").isNotNull(), F.col(f"_f_{f.name}.v")).otherwise(state[f.name])
        out.append(col.cast(f.dataType).alias(f.name))
    extra = wins.select("req_id", F.col("_id").alias("id"), F.explode("_extra").alias("key"))
    return joined.select(*out), responses, extra


def change_log(state: DataFrame, requests: DataFrame, width: int = 1_000_000) -> DataFrame:
    """Per request, whether its entity exists just before it, and the resulting status.

    requests(req_id, seq, method, id): existence is the last POST or DELETE of the
    id before the request, else its presence in the state. One bucketed carry, so
    a hot id is spread over its sequence buckets.
    """
    marks = F.when(F.col("method") == "POST", F.lit(True)).when(F.col("method") == "DELETE", F.lit(False))
    log = carry_last(requests, ["id"], ["seq"], seq_bucket("seq", width), {"_mark": marks}, inclusive=False)
    known = state.select(F.col("id").alias("_sid"))
    log = log.join(known, log.id == F.col("_sid"), "left")
    exists = F.coalesce(F.col("_mark"), F.col("_sid").isNotNull())
    m = F.col("method")
    status = (
        F.when(F.col("id").isNull(), 400)
        .when(m == "POST", F.when(exists, 409).otherwise(201))
        .when(~exists, 404)
        .otherwise(200)
    )
    return log.select(*requests.columns, exists.alias("existed"), status.alias("status"))


def apply_changes(state: DataFrame, requests: DataFrame, values: dict[str, Column], width: int = 1_000_000
                  ) -> tuple[DataFrame, DataFrame]:
    """Fold creates, updates and deletes in ``seq`` order → (new state, responses).

    ``requests(req_id, seq, method, id, …)``; ``values`` maps a state column to
    the request's value for it, NULL when the request does not carry it. POST
    writes an entity only if absent, PUT changes present values of an existing
    one, DELETE removes it, GET reads. The whole fold is one aggregation per id.
    """
    log = change_log(state, requests, width)
    m, seq, ok = F.col("method"), F.col("seq"), F.col("status") < 400
    created = F.when((m == "POST") & ok, seq)
    removed = F.when((m == "DELETE") & ok, seq)
    writes = ok & m.isin("POST", "PUT")
    aggs = [F.max(created).alias("_created"), F.max(removed).alias("_removed")]
    for name, value in values.items():
        aggs.append(
            F.max_by(F.struct(seq.alias("s"), value.alias("v")), F.when(writes & value.isNotNull(), seq)).alias(f"_w_{name}")
        )
    folded = log.where(F.col("id").isNotNull()).groupBy(F.col("id").alias("_fid")).agg(*aggs)
    joined = state.join(folded, state.id == F.col("_fid"), "full_outer")
    never = F.col("_created").isNull() & F.col("_removed").isNull()
    alive = F.when(never, state.id.isNotNull()).otherwise(
        F.coalesce(F.col("_created"), F.lit(-1)) > F.coalesce(F.col("_removed"), F.lit(-1))
    )
    reborn = F.col("_created").isNotNull()
    out = []
    for c in state.columns:
        if c == "id":
            out.append(F.coalesce(state.id, F.col("_fid")).alias("id"))
        elif c in values:
            w = F.col(f"_w_{c}")
            # A write counts if it belongs to the current life of the entity.
            fresh = w.isNotNull() & (~reborn | (w["s"] >= F.col("_created")))
            out.append(F.when(fresh, w["v"]).when(~reborn, state[c]).alias(c))
        else:
            out.append(F.when(~reborn, state[c]).alias(c))
    return joined.where(alive).select(*out), log.select("req_id", "status")
