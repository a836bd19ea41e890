"""Adapters turn every detector's rows into findings."""

from __future__ import annotations

from palisade.operators.detect.adapters import ADAPTERS, adapt
from palisade.operators.detect.rules import COMPLIANCE, ORGANIZERS, PACK
from palisade.schemas import FINDINGS


def test_rows_become_findings(spark):
    rows = spark.createDataFrame([(1, "union"), (2, None), (3, "quote")], "req_id long, class string")
    out = adapt(rows, "sqli")
    assert [(f.name, f.dataType) for f in out.schema] == [(f.name, f.dataType) for f in FINDINGS]
    got = [(r["repo"], r["path"], r["detector"], r["rule_id"], r["vector_id"], r["severity"], r["match"]) for r in out.orderBy("path").collect()]
    assert got == [("requests", "1", "D6", "sqli.union", 4, 4, "unio***"), ("requests", "3", "D6", "sqli.quote", 1, 2, "quot***")]


def test_every_mapped_detector_can_give_findings():
    giving = {a.detector for a in ADAPTERS.values()} | {r.detector for r in PACK}
    wanted = {d for m in (ORGANIZERS, COMPLIANCE) for ds in m.values() for d in ds}
    assert wanted <= giving
