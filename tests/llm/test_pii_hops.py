"""Discovered identifiers teach further patterns."""

from __future__ import annotations

from palisade.llm import pii


def test_discoveries_are_seeds(spark):
    """`call me _` has fixed-form seeds; `dial extension _` only numbers that the former found, `ring desk _` only numbers of the latter."""
    texts = [f"you can call me +1 555 010 0{i:03d} today" for i in range(40)]
    texts += [f"you can call me 555 {i:03d} 1234 today" for i in range(4)]
    texts += [f"then dial extension 555 {i:03d} 1234 now" for i in range(4) for _ in range(5)]
    texts += [f"then dial extension 444 {i:03d} 1234 now" for i in range(4)]
    texts += [f"or ring desk 444 {i:03d} 1234 again" for i in range(4) for _ in range(5)]
    texts += ["or ring desk 333 777 1234 again", "the order number 333 888 1234 shipped"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    found = {texts[r.doc_id] for r in pii.report(pii.find(df)).collect() if "phone:" in r.spans}
    assert found == set(texts[:-1])
