"""Catalog of queries: a Spark function and, where SQL can say it, an oracle."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from palisade.operators.detect.rules import Rule
from palisade.sources.tables import VIEWS, Tables, view_sql

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

# Oracle-side fragments that several queries share.
LINES = (
    "SELECT repo, path, CAST(i AS INTEGER) AS line, l[i] AS text FROM "
    "(SELECT repo, path, l, unnest(range(1, len(l) + 1)) AS i FROM (SELECT repo, path, string_split(content, chr(10)) AS l FROM {src}))"
)


def sql_text(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _check_sql(rule: Rule) -> str:
    if not rule.check:
        return "true"
    kind, *args = rule.check
    p = sql_text(rule.pattern)
    if kind == "entropy":
        value = f"regexp_extract(match, {p}, {args[0]})"
        return f"round(list_entropy(string_split({value}, '')), 6) >= {args[1]}"
    if kind == "equal":
        return f"regexp_extract(match, {p}, {args[0]}) = regexp_extract(match, {p}, {args[1]})"
    raise ValueError(kind)


def matches_sql(rules: list[Rule], lines: str = "lines", checked: bool = True) -> str:
    """All matches of all rules over lines(repo, path, line, text)."""
    parts = []
    for r in rules:
        p = sql_text(r.pattern)
        inner = f"SELECT repo, path, line, unnest(regexp_extract_all(text, {p}, 0)) AS match FROM {lines}"
        where = f" WHERE {_check_sql(r)}" if checked else ""
        parts.append(
            f"SELECT repo, path, line, '{r.detector}' AS detector, '{r.rule_id}' AS rule_id, {r.vector_id} AS vector_id, "
            f"{r.severity} AS severity, match FROM ({inner}){where}"
        )
    return " UNION ALL ".join(parts)


FINGERPRINT = "sha256(concat_ws(chr(1), repo, path, rule_id, lower(trim(match))))"


def findings_ctes(rules: list[Rule], src: str = "files", name: str = "findings") -> str:
    """CTE list: lines of ``src`` and their findings."""
    return (
        f"{name}_lines AS MATERIALIZED ({LINES.format(src=src)}), "
        f"{name} AS MATERIALIZED (SELECT repo, path, line, detector, rule_id, vector_id, severity, "
        f"substr(match, 1, 4) || '***' AS match, {FINGERPRINT} AS fingerprint FROM ({matches_sql(rules, name + '_lines')}))"
    )


def with_views(sql: str) -> str:
    """Prefix the adapter views a statement mentions as CTEs."""
    used = [v for v in VIEWS if re.search(rf"(?i)\b(from|join)\s+\(?{v}\b", sql)]
    if not used:
        return sql
    ctes = ", ".join(f"{v} AS ({view_sql(v)})" for v in used)
    m = re.match(r"(?is)^\s*with\s+(recursive\s+)?", sql)
    if m:
        return f"WITH {m.group(1) or ''}{ctes}, " + sql[m.end():]
    return f"WITH {ctes} {sql}"


def query(name: str, oracle: str | None = None) -> Callable[[Callable[[Tables], DataFrame]], Callable[[Tables], DataFrame]]:
    def keep(fn: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            # Instants in the queries are UTC, as in the oracle.
            spark.conf.set("spark.sql.session.timeZone", "UTC")
            return fn(Tables(spark, sf_dir))

        run.__name__ = name
        run.__doc__ = fn.__doc__
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = run
        if oracle is not None:
            ORACLES[name] = with_views(oracle)
        return fn

    return keep
