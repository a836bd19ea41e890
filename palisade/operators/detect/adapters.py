"""Adapters: what a detector returns, as findings.

Detectors over requests, pages, packages and transcripts have tables of their own. An adapter says in SQL
expressions, which any dialect here reads, where a row belongs and which rule, vector and severity it stands for.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palisade.functions.text import fingerprint, redact
from palisade.schemas import FINDINGS


@dataclass(frozen=True)
class Adapter:
    detector: str
    repo: str
    path: str
    rule: str
    vector: str
    severity: str
    match: str = "''"
    line: str = "0"
    where: str = "true"


def _case(column: str, values: dict[str, int], other: int) -> str:
    return f"CASE {column} " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in values.items()) + f" ELSE {other} END"


def _text(column: str) -> str:
    return f"CAST({column} AS STRING)"


# Vector numbers and severities of the adapted detectors.
ADAPTERS = {
    "sqli": Adapter("D6", "'requests'", _text("req_id"), "'sqli.' || class", _case("class", {"union": 4, "time": 3, "boolean": 5}, 1),
                    _case("class", {"quote": 2, "boolean": 3}, 4), "class", where="class IS NOT NULL"),
    "payload": Adapter("D7", "src", _text("id"), "'payload.' || kind", _case("kind", {
        "traversal": 14, "ssrf": 187, "redirect": 65, "header_injection": 66, "parameter_pollution": 80, "xml_entity": 10}, 64), "3", "kind"),
    "verbs": Adapter("D7", "'requests'", _text("event_id"), "'payload.verb'", "64", "2", "method"),
    "error_rate": Adapter("D8", "'users'", _text("user_id"), "'leak.error_rate'", "53", "2"),
    "foreign_access": Adapter("D9", "'requests'", _text("event_id"), "'access.foreign'", "20", "4", _text("owner")),
    "browsing": Adapter("D9", "'users'", _text("user_id"), "'access.browsing'", "19", "3"),
    "mass_assignment": Adapter("D10", "'requests'", _text("event_id"), "'assign.key'", "79", "3", "key"),
    "bruteforce": Adapter("D11", "'users'", _text("user_id"), "'login.burst'", "16", "4"),
    "spraying": Adapter("D11", "'sources'", "source", "'login.spraying'", "17", "4"),
    "takeover": Adapter("D11", "'users'", _text("user_id"), "'login.takeover'", "42", "5"),
    "host_entropy": Adapter("D12", "'hosts'", "host", "'exfil.host_entropy'", "103", "3", "label", where="entropy >= 3"),
    "dependencies": Adapter("D14", "'modules'", "module", "'dep.' || signal", _case("signal", {"private_name": 56, "advisory": 129}, 58),
                            _case("signal", {"advisory": 4, "private_name": 4}, 2), "name"),
    "obfuscation": Adapter("D15", "'documents'", _text("doc_id"), "'obf.score'", "120", "3", where="score >= 30"),
    "signature": Adapter("D16", "'documents'", _text("doc_id"), "'signature.overlap'", "129", "4", _text("item_id"), where="overlap >= 0.5"),
    "database": Adapter("D17", "repo", "path", "'db.' || kind", "46", _case("kind", {"connection": 4}, 1), "detail", "line"),
    "spec_lint": Adapter("D19", "'specs'", "spec", "'spec.' || lint", "77", "2", "_r.at"),
    "personal": Adapter("D21", "src", _text("id"), "'pii.' || kind", "150", "3", "value", where="kind IN ('card', 'ip')"),
    "inline_scripts": Adapter("D23", "'pages'", _text("page_id"), "'page.inline_script'", "9", "2", where="inline_scripts > 0"),
    "third_party": Adapter("D23", "'pages'", _text("page_id"), "'page.third_party'", "116", "2", where="third_party > 0"),
    "open_forms": Adapter("D23", "'pages'", _text("page_id"), "'page.open_form'", "153", "3", where="open_forms > 0"),
    "comments": Adapter("D23", "'pages'", _text("page_id"), "'page.comment'", "175", "1", where="comments > 0"),
    "packages": Adapter("D13", "repo", "manifest", "'dep.' || ecosystem", "58", "1", "name"),
    "exfiltration": Adapter("D12", "'users'", _text("user_id"), "'exfil.score'", "103", "3", where="score >= 30"),
    "stuffing": Adapter("D11", "'sources'", "source", "'login.stuffing'", "17", "4"),
    "tenants": Adapter("D9", "'requests'", _text("event_id"), "'access.tenant'", "20", "5", _text("owner")),
    "endpoints": Adapter("D18", "repo", "path", "'api.endpoint'", "77", "1", "method"),
    "cycles": Adapter("D20", "repo", "path", "'graph.cycle'", "0", "1", "component", where="cycle_files > 1"),
    "failed_calls": Adapter("D24", "'conversations'", f"{_text('conv_id')} || '-' || {_text('turn')}", "'agent.' || outcome", "0", "2", "tool", where="outcome <> 'ok'"),
    "tool_calls": Adapter("D24", "'conversations'", f"{_text('conv_id')} || '-' || {_text('turn')}", "'agent.tool_call'", "0", "1", "tool", where="kind = 'tool_call'"),
}


def adapt(rows: DataFrame, name: str, scan_id: str = "scan") -> DataFrame:
    """Rows of a detector → findings."""
    a = ADAPTERS[name]
    out = rows.where(a.where).alias("_r").selectExpr(
        f"{a.repo} AS repo", f"{a.path} AS path", f"{a.line} AS line", f"{a.rule} AS rule_id", f"{a.vector} AS vector_id",
        f"{a.severity} AS severity", f"{a.match} AS match")
    made = out.select(
        F.lit(scan_id).alias("scan_id"), "repo", "path", "line", F.lit(a.detector).alias("detector"), "rule_id", "vector_id", "severity",
        redact("match").alias("match"), F.lit(1.0).alias("confidence"),
        fingerprint(F.col("repo"), F.col("path"), F.col("rule_id"), F.col("match")).alias("fingerprint"), F.create_map().alias("attrs"))
    return made.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in FINDINGS])


def adapted_sql(rows: str, name: str) -> str:
    """The same findings from the SQL of a detector's rows."""
    a = ADAPTERS[name]
    return (f"SELECT {a.repo} AS repo, {a.path} AS path, '{a.detector}' AS detector, {a.rule} AS rule_id, {a.vector} AS vector_id, {a.severity} AS severity, "
            f"{a.match} AS match FROM ({rows}) AS _r WHERE {a.where}")
