"""Joins: uniqueness, lookups, referential integrity, enrichment, as-of, interval, similarity."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palisade.functions.coerce import js_parse_int
from palisade.operators.ordered import carry_last, time_bucket


def split_duplicates(new: DataFrame, state: DataFrame, key: str, id_col: str = "id",
                     exclude_self: bool = False) -> tuple[DataFrame, DataFrame]:
    """(duplicates, accepted) by the lower-cased key; optionally a row may keep its own key."""
    # Distinct before the join: a hot key arrives once, whatever the size of its group.
    held = state.select(F.col(key).alias("_held"), F.col(id_col).alias("_hid"))
    held = held.distinct() if exclude_self else held.select("_held").distinct()
    cond = F.lower(new[key]) == F.col("_held")
    if exclude_self:
        cond = cond & (new[id_col] != F.col("_hid"))
    return new.join(held, cond, "left_semi"), new.join(held, cond, "left_anti")


def lookup(requests: DataFrame, state: DataFrame, raw_id: str = "raw_id", id_col: str = "id",
           bring: Sequence[str] = ()) -> DataFrame:
    """Batched point lookups: 400 without a number, 404 without a row, else 200."""
    asked = requests.withColumn("_ask", js_parse_int(raw_id))
    right = state.select(F.col(id_col).alias("_sid"), *[F.col(c).alias(f"_s_{c}") for c in bring])
    joined = asked.join(right, asked._ask == F.col("_sid"), "left")
    status = F.when(F.col("_ask").isNull(), 400).when(F.col("_sid").isNull(), 404).otherwise(200)
    return joined.select(*requests.columns, status.alias("status"), *[F.col(f"_s_{c}").alias(c) for c in bring])


def orphans(child: DataFrame, fk: str, parent: DataFrame, pk: str) -> DataFrame:
    """Child rows whose key has no parent."""
    keys = parent.select(F.col(pk).alias("_pk")).distinct()
    return child.where(F.col(fk).isNotNull()).join(keys, F.col(fk) == F.col("_pk"), "left_anti")


def integrity(checks: Mapping[str, tuple[DataFrame, str, DataFrame, str]]) -> DataFrame:
    """One row per relation: child rows, orphan rows."""
    out = None
    for name, (child, fk, parent, pk) in checks.items():
        # Counted per key first, so that a hot key reaches the join as one row.
        per_key = child.where(F.col(fk).isNotNull()).groupBy(F.col(fk).alias("_fk")).agg(F.count("*").alias("_n"))
        keys = parent.select(F.col(pk).alias("_pk")).distinct()
        row = per_key.join(keys, F.col("_fk") == F.col("_pk"), "left").agg(
            F.coalesce(F.sum("_n"), F.lit(0)).alias("rows"),
            F.coalesce(F.sum(F.when(F.col("_pk").isNull(), F.col("_n"))), F.lit(0)).alias("orphans"),
        ).select(F.lit(name).alias("relation"), "rows", "orphans")
        out = row if out is None else out.unionByName(row)
    return out


def drift(left: DataFrame, right: DataFrame, keys: Sequence[str], left_name: str = "spec", right_name: str = "code") -> DataFrame:
    """Full comparison of two key sets: only_<left>, only_<right> or both."""
    a = left.select(*keys).distinct().withColumn("_a", F.lit(1))
    b = right.select(*keys).distinct().withColumn("_b", F.lit(1))
    status = (
        F.when(F.col("_b").isNull(), f"only_{left_name}").when(F.col("_a").isNull(), f"only_{right_name}").otherwise("both")
    )
    return a.join(b, list(keys), "full_outer").select(*keys, status.alias("status"))


def constraint_drift(spec: DataFrame, code: DataFrame, keys: Sequence[str], attrs: Sequence[str]) -> DataFrame:
    """Attributes that disagree between two descriptions of the same fields."""
    joined = spec.alias("s").join(code.alias("c"), list(keys), "inner")
    pairs = F.array(*[
        F.struct(F.lit(a).alias("attr"), F.col(f"s.{a}").cast("string").alias("spec"), F.col(f"c.{a}").cast("string").alias("code"))
        for a in attrs
    ])
    return joined.select(*keys, F.inline(pairs)).where(~F.col("spec").eqNullSafe(F.col("code")))


def asof(left: DataFrame, right: DataFrame, key: str, ts: str, tie: str, bring: Mapping[str, str],
         width_us: int | None = None) -> DataFrame:
    """Latest right row at or before each left row, per key.

    Both sides are unioned and the last right row is carried along (key, ts):
    no pairs; hot keys are cut into parts of about equal numbers of rows, or into
    time buckets if a width is given. ``tie`` orders rows with the same ``ts``.
    """
    l = left.select(F.lit(1).alias("_side"), F.col(key), F.col(ts), F.col(tie), F.struct("*").alias("_l"),
                    F.lit(None).cast(_struct_type(right, bring)).alias("_r"))
    r = right.select(F.lit(0).alias("_side"), F.col(key), F.col(ts), F.col(tie),
                     F.lit(None).cast(l.schema["_l"].dataType).alias("_l"),
                     F.struct(*[F.col(c).alias(n) for n, c in bring.items()]).alias("_r"))
    both = carry_last(l.unionByName(r), [key], [ts, tie, "_side"], time_bucket(ts, width_us) if width_us else None, {"_hit": F.col("_r")})
    return both.where(F.col("_side") == 1).select("_l.*", *[F.col(f"_hit.{n}").alias(n) for n in bring])


def _struct_type(df: DataFrame, bring: Mapping[str, str]):
    return df.select(F.struct(*[F.col(c).alias(n) for n, c in bring.items()]).alias("s")).schema["s"].dataType


def followed_by(a: DataFrame, b: DataFrame, key: str, ts: str, delta_us: int) -> DataFrame:
    """Pairs (a, b) of one key with ``a.ts <= b.ts <= a.ts + delta``.

    The join key is (key, time bucket of width delta): a hot key is spread over
    its buckets, and a row only meets rows of its own and the next bucket.
    """
    left = a.select(*[F.col(c).alias(f"a_{c}") for c in a.columns]).withColumn("_b", time_bucket(f"a_{ts}", delta_us))
    right = (
        b.select(*[F.col(c).alias(f"b_{c}") for c in b.columns])
        .withColumn("_w", time_bucket(f"b_{ts}", delta_us))
        .withColumn("_b", F.explode(F.array(F.col("_w"), F.col("_w") - 1)))
    )
    gap = F.unix_micros(F.col(f"b_{ts}").cast("timestamp")) - F.unix_micros(F.col(f"a_{ts}").cast("timestamp"))
    cond = (F.col(f"a_{key}") == F.col(f"b_{key}")) & (left._b == right._b) & gap.between(0, delta_us)
    return left.join(right, cond).drop("_b", "_w")


def first_follower(a: DataFrame, b: DataFrame, key: str, ts: str, tie: str, delta_us: int) -> DataFrame:
    """Each a row with the earliest b row within delta (NULL if none): linear, no pairs, a hot key in many parts."""
    back = lambda df: df.withColumn("_neg", -F.unix_micros(F.col(ts).cast("timestamp"))).withColumn("_negtie", -F.col(tie))
    rows = back(a).withColumn("_side", F.lit(1)).select(key, ts, tie, "_neg", "_negtie", "_side", F.lit(None).cast("struct<t:timestamp,i:bigint>").alias("_v"))
    marks = back(b).withColumn("_side", F.lit(0)).select(
        key, ts, tie, "_neg", "_negtie", "_side",
        F.struct(F.col(ts).cast("timestamp").alias("t"), F.col(tie).cast("bigint").alias("i")).alias("_v"),
    )
    seen = carry_last(rows.unionByName(marks), [key], ["_neg", "_side", "_negtie"], None, {"_next": F.col("_v")})
    near = (F.unix_micros("_next.t") + F.col("_neg")) <= delta_us
    return seen.where(F.col("_side") == 1).select(
        key, ts, tie,
        F.when(near, F.col("_next.i")).alias("follower"),
        F.when(near, F.unix_micros("_next.t") + F.col("_neg")).alias("gap_us"),
    )


def deletion_variants(name: Column, k: int) -> Column:
    """The string and everything reachable by deleting up to k characters."""
    variants = F.array(name)
    for _ in range(k):
        one_less = F.flatten(
            F.transform(
                variants,
                lambda s: F.when(
                    F.length(s) > 0,
                    F.transform(
                        F.sequence(F.lit(1), F.length(s)),
                        lambda i: F.concat(F.substring(s, F.lit(1), i - 1), F.substring(s, i + 1, F.length(s))),
                    ),
                ).otherwise(F.array(s)),
            )
        )
        variants = F.array_distinct(F.concat(variants, one_less))
    return variants


def similar_names(candidates: DataFrame, known: DataFrame, col: str, k: int = 2) -> DataFrame:
    """Pairs (name, known) with 1 <= edit distance <= k.

    Two strings within distance k share a string after at most k deletions on
    each side, so an equi-join on those keys finds every pair.
    """
    keyed = lambda df, alias: (
        df.select(F.col(col).alias(alias)).distinct().withColumn("_k", F.explode(deletion_variants(F.col(alias), k)))
    )
    pairs = keyed(candidates, "name").join(keyed(known, "known"), "_k").where(F.col("name") != F.col("known"))
    dist = F.levenshtein("name", "known", k)
    return pairs.select("name", "known").distinct().withColumn("distance", dist).where(F.col("distance").between(1, k))
