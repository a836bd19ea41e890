from __future__ import annotations

import math
import re
from collections import Counter

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from palisade.functions import coerce as C
from palisade.functions import text as X


def column(spark, values, expr):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, x string")
    return [r[0] for r in df.orderBy("i").select(expr(F.col("x"))).collect()]


def test_parse_int_examples(spark):
    got = column(spark, ["12abc", "abc", " 7", "-3.9", "0x1F", "-0x10", "", "1e5", None, "99999999999999999999", "-99999999999999999999", "0xFFFFFFFFFFFFFFFF1", "0x000000000000000000A", "0x7fffffffffffffff"], C.js_parse_int)
    assert got == [12, None, 7, -3, 31, -16, None, 1, None, 2**63 - 1, -(2**63), 2**63 - 1, 10, 2**63 - 1]


def test_parse_float_examples(spark):
    assert column(spark, ["1.5x", ".5", "x", "2e3", "-7", "3."], C.js_parse_float) == [1.5, 0.5, None, 2000.0, -7.0, 3.0]


def test_trim_strips_unicode_space(spark):
    assert column(spark, ["\t a b\n", " x ", "﻿y", ""], C.js_trim) == ["a b", "x", "y", ""]


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(alphabet="0123456789 +-abx.eE\t", max_size=8), min_size=1, max_size=20))
def test_parse_int_model(spark, values):
    def model(s):
        m = re.match(r"^\s*([+-]?)0[xX]([0-9a-fA-F]+)", s)
        if m:
            return (-1 if m[1] == "-" else 1) * int(m[2], 16)
        m = re.match(r"^\s*([+-]?[0-9]+)", s)
        return int(m[1]) if m else None

    assert column(spark, values, C.js_parse_int) == [model(v) for v in values]


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(alphabet="abcdefgh0123", max_size=20), min_size=1, max_size=10))
def test_entropy_model(spark, values):
    for v, got in zip(values, column(spark, values, X.entropy), strict=True):
        if not v:
            assert got is None
        else:
            want = -sum(n / len(v) * math.log2(n / len(v)) for n in Counter(v).values())
            assert abs(got - want) < 1e-5


@settings(max_examples=10, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.dictionaries(st.sampled_from("abc"), st.integers(0, 9)), st.dictionaries(st.sampled_from("abc"), st.integers(0, 9)))
def test_spread_model(spark, old, new):
    df = spark.createDataFrame([(old, new)], "o map<string,int>, n map<string,int>")
    assert df.select(C.spread("o", "n")).first()[0] == {**old, **new}


def test_body_keeps_absent_and_null_apart(spark):
    df = spark.createDataFrame([('{"a":null,"b":""}',), ('{"a":0,"b":[]}',), ("{bad",)], "x string")
    b = C.JsonBody("x")
    rows = df.select(b.valid(), b.present("a"), b.type("a"), b.type("b"), b.truthy("b"), b.type("c")).collect()
    assert [tuple(r) for r in rows] == [
        (True, True, "null", "string", False, "undefined"),
        (True, True, "number", "array", True, "undefined"),
        (False, False, "undefined", "undefined", False, "undefined"),
    ]


def test_defaults(spark):
    df = spark.createDataFrame([('{"r":"","p":false}',), ('{"r":"x"}',)], "x string")
    b = C.JsonBody("x")
    rows = df.select(
        b.or_default("r", b.string("r"), F.lit("user")), b.undef_default("p", b.boolean("p"), F.lit(True))
    ).collect()
    assert [tuple(r) for r in rows] == [("user", False), ("x", True)]


def test_decode_and_luhn(spark):
    assert column(spark, ["CHAR(113,112)||x", "a%20b", "plain"], X.decode_payload) == ["qp||x", "a b", "plain"]
    assert column(spark, ["4111111111111111", "4111111111111112"], X.luhn_valid) == [True, False]


def test_iso_roundtrip(spark):
    df = spark.sql("SELECT timestamp'2024-01-15 10:00:00.250' AS t")
    assert df.select(C.iso_timestamp("t")).first()[0] == "2024-01-15T10:00:00.250Z"
    assert df.select(C.parse_iso(C.iso_timestamp("t")) == F.col("t")).first()[0]


def test_query_map(spark):
    assert column(spark, ["http://h/p?a=1&b=x%20y&a=2", "http://h/p"], C.query_map) == [{"a": "2", "b": "x y"}, None]
