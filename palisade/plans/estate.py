"""R1, R3, R4, R9 over the findings of all detectors: rule packs over text, and adapted tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palisade.operators import findings as R
from palisade.operators.detect.adapters import ADAPTERS, adapt, adapted_sql
from palisade.operators.detect.rules import COMPLIANCE, ORGANIZERS, pack, scan
from palisade.plans import detectors as D
from palisade.plans.catalog import FINGERPRINT, ORACLES, findings_ctes, query
from palisade.plans.findings import _mapping
from palisade.session import cut_lineage
from palisade.sources.tables import Tables

# Which detector's rows each adapter reads.
ROWS = {
    "sqli": ("d6_sqli", D.d6), "payload": ("d7_url_payload", D.d7), "verbs": ("d7_verb_tampering", D.d7_verbs), "error_rate": ("d8_error_rate", D.d8),
    "foreign_access": ("d9_foreign_access", D.d9), "browsing": ("d9_forced_browsing", D.d9_browsing), "mass_assignment": ("d10_mass_assign", D.d10),
    "bruteforce": ("d11_bruteforce", D.d11), "spraying": ("d11_spraying", D.d11_spraying), "takeover": ("d11_takeover", D.d11_takeover),
    "host_entropy": ("d12_host_entropy", D.d12), "dependencies": ("d14_risk_signals", D.d14), "obfuscation": ("d15_obfuscation", D.d15),
    "signature": ("d16_signature", D.d16), "database": ("d17_db_artifacts", D.d17), "spec_lint": ("d19_spec_lint", D.d19),
    "personal": ("d21_pii", D.d21), "inline_scripts": ("d23_page_risks", D.d23), "third_party": ("d23_page_risks", D.d23),
    "packages": ("d13_dependencies", D.d13), "exfiltration": ("d12_exfiltration", D.d12_exfiltration), "stuffing": ("d11_stuffing", D.d11_stuffing),
    "tenants": ("d9_cross_tenant", D.d9_tenant), "endpoints": ("d18_code_endpoints", D.d18_code), "cycles": ("d20_code_graph", D.d20_code_graph),
    "failed_calls": ("d24_calls", D.d24_calls), "open_forms": ("d23_page_risks", D.d23), "comments": ("d23_page_risks", D.d23), "tool_calls": ("d24_transcript", D.d24),
}
assert ROWS.keys() == ADAPTERS.keys()


TEXTS = ("files", "web_files", "code_files", "chats")


def all_texts(t: Tables) -> DataFrame:
    """Documents, pages, source and chats as files of one estate."""
    return reduce(lambda a, b: a.unionByName(b), [getattr(t, v).select("repo", "path", "content") for v in TEXTS])


def estate(t: Tables) -> DataFrame:
    """Findings of every detector: one scan of all texts, and the adapted tables, of which one that several adapters read is made once."""
    made: dict[str, DataFrame] = {}
    parts = [scan(all_texts(t))]
    for name, (key, rows) in ROWS.items():
        if key not in made:
            made[key] = rows(t) if sum(k == key for k, _ in ROWS.values()) == 1 else cut_lineage(rows(t))
        parts.append(adapt(made[key], name))
    return reduce(lambda a, b: a.unionByName(b), parts)


_ROWS_SQL = " UNION ALL ".join(adapted_sql(ORACLES[key], name) for name, (key, _) in ROWS.items())
ESTATE = (
    "all_texts AS (" + " UNION ALL ".join(f"SELECT repo, path, content FROM {v}" for v in TEXTS) + "), "
    f"{findings_ctes(pack(), 'all_texts', 'scanned')}, estate AS (SELECT repo, path, detector, rule_id, vector_id, severity, fingerprint FROM scanned UNION ALL "
    f"SELECT repo, path, detector, rule_id, vector_id, severity, {FINGERPRINT} AS fingerprint FROM ({_ROWS_SQL}))"
)


def per_rule(findings: DataFrame) -> DataFrame:
    """Findings and different findings per rule.

    The fingerprint, a hash spelled in hexadecimal digits, is most of what moves for a finding: it moves as bytes, half as long.
    """
    return findings.withColumn("fingerprint", F.unhex("fingerprint")).groupBy("detector", "rule_id", "vector_id", "severity").agg(
        F.count("*").alias("n"), F.count_distinct("fingerprint").alias("distinct_findings"))


@query(
    "r1_estate",
    f"WITH {ESTATE} SELECT detector, rule_id, vector_id, severity, count(*) AS n, count(DISTINCT fingerprint) AS distinct_findings FROM estate GROUP BY ALL",
)
def r1_estate(t: Tables) -> DataFrame:
    """One findings table of all detectors, counted per rule."""
    return per_rule(R.parsed(estate(t)))


@query(
    "r4_estate_organizers",
    f"WITH {ESTATE} SELECT organizer, count(*) AS findings, max(severity) AS worst FROM estate JOIN (VALUES {_mapping(ORGANIZERS)}) o(organizer, d) ON detector = d GROUP BY 1",
)
def r4_estate(t: Tables) -> DataFrame:
    return R.organizers(estate(t))


@query(
    "r9_estate_compliance",
    f"WITH {ESTATE} SELECT control, count(*) AS findings FROM estate JOIN (VALUES {_mapping(COMPLIANCE)}) o(control, d) ON detector = d GROUP BY 1",
)
def r9_estate(t: Tables) -> DataFrame:
    return R.compliance(estate(t))
