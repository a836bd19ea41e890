"""Wider candidates: digit runs of phone length, compressed IPv6."""

from __future__ import annotations

import pytest

from palisade.llm import pii


@pytest.mark.parametrize(("kind", "form"), [
    ("phone", "5551234567"), ("phone", "5551234"), ("phone", "(555)1234567"), ("phone", "(555) 123-4567"), ("phone", "0044 20 7946 0958"),
    ("phone", "004420794609581"), ("card", "004420794609581"), ("ip", "2001:db8::1"), ("ip", "::1"), ("ip", "fe80::a"),
    ("ip", "2001:db8:0:0:0:0:0:1")])
def test_candidates(kind, form):
    assert (kind, 8, 8 + len(form)) in pii.loose_spans(f"call me {form} today", [])


@pytest.mark.parametrize("text", ["no 123456 here", "a 5551234567x", "std::vector", "a :: b", "1:2::3::4", "+5551234567", "5551234567-a"])
def test_no_candidates(text):
    assert pii.loose_spans(text, []) == []


def test_linear():
    for t in ("1 " * 150_000 + "x", "1 (" * 100_000 + "x", "1:" * 150_000, "::" * 150_000, "a::" * 100_000, "12345678 x " * 30_000):
        pii.loose_spans(t, pii.base_spans(t))


def test_found_by_context(spark):
    rows = [(i, f"please call me +1 212 555 0{i:03d} today") for i in range(30)]
    rows += [(i, f"server listens on 10.0.0.{i} always") for i in range(100, 130)]
    rows += [(200, "please call me 5551234567 today"), (201, "please call me 004420794609581 today"), (202, "server listens on 2001:db8::1 always"),
             (203, "order 5551234568 was sent")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    left = {r.doc_id: r.text for r in pii.redact(df).collect()}
    assert left[200] == left[201] == "please call me [PHONE] today" and left[202] == "server listens on [IP] always" and left[203] == rows[-1][1]
