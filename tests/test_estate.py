"""Findings of all detectors, counted per rule."""

from __future__ import annotations

from palisade.operators.detect.adapters import adapt
from palisade.operators.findings import parsed
from palisade.plans.estate import per_rule


def test_findings_per_rule_move_their_fingerprints_as_bytes(spark):
    """A request that comes twice is two findings with one fingerprint."""
    rows = spark.createDataFrame([(1, "union"), (1, "union"), (2, "union"), (None, "union"), (3, "quote"), (4, None)], "req_id long, class string")
    out = per_rule(parsed(adapt(rows, "sqli")))
    assert {tuple(r) for r in out.collect()} == {("D6", "sqli.union", 4, 4, 4, 3), ("D6", "sqli.quote", 1, 2, 1, 1)}
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "unhex(" in plan and out.schema["distinct_findings"].dataType.simpleString() == "bigint"
