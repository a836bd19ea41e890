"""JavaScript-style coercions as column expressions (all JVM-side)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed patterns of the coercion rules.
INT_PREFIX = r"^[\s\uFEFF]*([+-]?[0-9]+)"
HEX_PREFIX = r"^[\s\uFEFF]*([+-]?)0[xX]([0-9a-fA-F]+)"
FLOAT_PREFIX = r"^[\s\uFEFF]*([+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?)"
OUTER_SPACE = r"(?U)^[\s\uFEFF]+|[\s\uFEFF]+$"
ISO_FORMAT = "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"


def _col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def let(value: Column, use) -> Column:
    """Bind an expression to a lambda variable, so that nested lambdas read it instead of recomputing it."""
    return F.transform(F.array(value), use)[0]


def js_parse_int(x: Column | str) -> Column:
    """Leading integer of a string; NULL plays the part of NaN.

    A number beyond BIGINT is a number still: it becomes the end of the range, an id that no entity has.
    """
    x = _col(x).cast("string")
    top, bottom = F.lit(2**63 - 1), F.lit(-(2**63))
    digits = F.regexp_replace(F.regexp_extract(x, HEX_PREFIX, 2), "^0+(?=.)", "")
    # conv() raises on overflow under ANSI: 16 hex digits are within its 64 bits.
    magnitude = F.coalesce(F.when(F.length(digits) <= 16, F.conv(digits, 16, 10)).try_cast("bigint"), top)
    hexed = F.when(F.regexp_extract(x, HEX_PREFIX, 1) == "-", -magnitude).otherwise(magnitude)
    decimal = F.regexp_extract(x, INT_PREFIX, 1)
    plain = F.when(decimal != "", F.coalesce(decimal.try_cast("bigint"), F.when(F.startswith(decimal, F.lit("-")), bottom).otherwise(top)))
    return F.when(x.rlike(HEX_PREFIX), hexed).otherwise(plain)


def js_parse_float(x: Column | str) -> Column:
    """Leading decimal number of a string; NULL plays the part of NaN."""
    return F.regexp_extract(_col(x).cast("string"), FLOAT_PREFIX, 1).try_cast("double")


def js_trim(x: Column | str) -> Column:
    """Strip all Unicode white space at both ends."""
    return F.regexp_replace(_col(x), OUTER_SPACE, "")


def trimmed_length(x: Column | str) -> Column:
    return F.length(js_trim(x))


def iso_timestamp(x: Column | str) -> Column:
    return F.date_format(_col(x), ISO_FORMAT)


def parse_iso(x: Column | str) -> Column:
    return _col(x).try_cast("timestamp")


def epoch_millis(x: Column | str) -> Column:
    return F.unix_millis(_col(x))


def spread(old: Column | str, new: Column | str) -> Column:
    """Object spread over open maps: keys of ``new`` win (no session setting needed)."""
    old, new = _col(old), _col(new)
    kept = F.map_filter(old, lambda k, _: ~F.map_contains_key(new, k))
    return F.when(new.isNull(), old).when(old.isNull(), new).otherwise(F.map_concat(kept, new))


def item_at(items: Column | str, n: Column | int, field: str) -> Column:
    """``items[n]?.field``: 0-based, NULL when out of range."""
    n = F.lit(n) if isinstance(n, int) else n
    return F.get(_col(items), n).getField(field)


class JsonBody:
    """Typed access to a JSON text column that keeps *absent* and *null* apart.

    ``JsonBody(text)`` works inside any expression; ``JsonBody.prepared`` adds the
    parsed object as a column first, so that many fields cost one parse.
    """

    def __init__(self, body: Column | str | None = None, ok: Column | None = None, fields: Column | None = None,
                 ready: frozenset[str] = frozenset()):
        value = F.try_parse_json(_col(body)) if body is not None else None
        self._ok = ok if ok is not None else value.isNotNull() & ~F.is_variant_null(value)
        self._fields = fields if fields is not None else F.try_variant_get(value, "$", "map<string,variant>")
        self._ready = ready

    @classmethod
    def prepared(cls, df: DataFrame, body: str, read: Sequence[str] = ()) -> tuple[DataFrame, JsonBody]:
        """(df + parsed columns, accessor); the columns are named ``_json`` and ``_fields``.

        The fields in ``read`` get columns of their own for value, type and text (``_f_``, ``_t_``, ``_s_`` and the name), so that
        checks and conversions of a field share one extraction.
        """
        parsed = df.withColumn("_parsed", F.try_parse_json(body))
        value = F.col("_parsed")
        out = parsed.select(
            *df.columns,
            (value.isNotNull() & ~F.coalesce(F.is_variant_null(value), F.lit(True))).alias("_json"),
            F.try_variant_get(value, "$", "map<string,variant>").alias("_fields"),
        )
        if read:
            out = out.select("*", *[F.col("_fields")[k].alias(f"_f_{k}") for k in read])
            plain = cls(ok=F.col("_json"), fields=F.col("_fields"))
            out = out.select("*", *[
                c for k in read
                for c in (F.when(~plain.present(k), "undefined").otherwise(json_type(F.col(f"_f_{k}"))).alias(f"_t_{k}"),
                          F.try_variant_get(f"_f_{k}", "$", "string").alias(f"_s_{k}"))
            ])
        return out, cls(ok=F.col("_json"), fields=F.col("_fields"), ready=frozenset(read))

    def valid(self) -> Column:
        return F.coalesce(self._ok, F.lit(False))

    def keys(self) -> Column:
        return F.coalesce(F.map_keys(self._fields), F.array().cast("array<string>"))

    def present(self, key: str) -> Column:
        if key in self._ready:
            return F.col(f"_t_{key}") != "undefined"
        return F.coalesce(F.map_contains_key(self._fields, key), F.lit(False))

    def variant(self, key: str) -> Column:
        return F.col(f"_f_{key}") if key in self._ready else self._fields[key]

    def get(self, key: str, kind: str) -> Column:
        return F.try_variant_get(self.variant(key), "$", kind)

    def type(self, key: str) -> Column:
        """undefined, null, string, number, boolean, array or object."""
        if key in self._ready:
            return F.col(f"_t_{key}")
        return F.when(~self.present(key), "undefined").otherwise(json_type(self.variant(key)))

    def string(self, key: str) -> Column:
        return F.col(f"_s_{key}") if key in self._ready else self.get(key, "string")

    def number(self, key: str) -> Column:
        return F.when(self.type(key) == "number", self.get(key, "double"))

    def integer(self, key: str) -> Column:
        return self.number(key).try_cast("bigint")

    def boolean(self, key: str) -> Column:
        return F.when(self.type(key) == "boolean", self.get(key, "boolean"))

    def truthy(self, key: str) -> Column:
        kind = self.type(key)
        return (
            F.when(kind == "string", self.string(key) != "")
            .when(kind == "number", self.get(key, "double") != 0)
            .when(kind == "boolean", self.get(key, "boolean"))
            .otherwise(kind.isin("array", "object"))
        )

    def or_default(self, key: str, value: Column, default: Column) -> Column:
        """``body.key || default``: every falsy value is replaced."""
        return F.when(self.truthy(key), value).otherwise(default)

    def undef_default(self, key: str, value: Column, default: Column) -> Column:
        """``body.key !== undefined ? body.key : default``."""
        return F.when(self.present(key), value).otherwise(default)


def json_type(variant: Column) -> Column:
    """Run-time type of a VARIANT value, in JavaScript's terms."""
    kind = F.schema_of_variant(variant)
    return (
        F.when(variant.isNull(), "undefined")
        .when(kind == "VOID", "null")
        .when(kind == "STRING", "string")
        .when(kind == "BOOLEAN", "boolean")
        .when(kind.startswith("ARRAY"), "array")
        .when(kind.startswith("OBJECT"), "object")
        .otherwise("number")
    )


def header_pair(line: Column | str) -> Column:
    """``Key: value`` → one-entry map with a lower-cased key."""
    parts = F.split(_col(line), ":", 2)
    return F.when(
        F.size(parts) == 2,
        F.create_map(F.lower(js_trim(parts[0])), js_trim(parts[1])),
    )


def query_map(url: Column | str) -> Column:
    """Decoded query parameters of a URL; the last of repeated keys wins."""
    query = F.try_parse_url(_col(url), F.lit("QUERY"))
    pairs = F.transform(
        F.filter(F.split(query, "&"), lambda p: p != ""),
        lambda p: F.struct(
            F.try_url_decode(F.split(p, "=", 2)[0]).alias("k"),
            F.try_url_decode(F.coalesce(F.get(F.split(p, "=", 2), F.lit(1)), F.lit(""))).alias("v"),
        ),
    )
    pairs = F.filter(pairs, lambda p: p.k.isNotNull())
    return F.when(
        query.isNotNull(),
        F.aggregate(
            pairs,
            F.create_map().cast("map<string,string>"),
            lambda acc, p: F.map_concat(
                F.map_filter(acc, lambda k, _: k != p.k), F.create_map(p.k, p.v)
            ),
        ),
    )
