"""User-facing functions: pandas UDFs, a table function, SQL functions."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palisade.operators.detect.rules import Rule, pack, text_gate


def register_sql_functions(spark: SparkSession) -> list[str]:
    """SQL functions built from SQL expressions: they inline into the plan."""
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION redact(s STRING) RETURNS STRING RETURN concat(substring(s, 1, 4), '***')")
    spark.sql(
        "CREATE OR REPLACE TEMPORARY FUNCTION severity_name(n INT) RETURNS STRING RETURN "
        "CASE WHEN n >= 5 THEN 'critical' WHEN n = 4 THEN 'high' WHEN n = 3 THEN 'medium' WHEN n = 2 THEN 'low' ELSE 'info' END"
    )
    return ["redact", "severity_name"]


def register_views(tables: dict[str, DataFrame]) -> None:
    for name, df in tables.items():
        df.createOrReplaceTempView(name)


def finding_rules() -> list[Rule]:
    """The rules of the table function: those that a pattern alone decides."""
    return [r for r in pack("D1", "D21") if not r.check]


def finding_candidates(df: DataFrame, text: str) -> DataFrame:
    """The rows whose text a rule of the table function may match, by the rules' gates."""
    rules = finding_rules()
    return df.where(text_gate(F.col(text), rules)) if all(r.gate for r in rules) else df


def finding_rows():
    """Table function text → (rule_id, match) rows, for LATERAL in SQL."""
    compiled = [(r.rule_id, r.pattern) for r in finding_rules()]

    @F.udtf(returnType="rule_id string, match string", useArrow=True)
    class FindingRows:
        def __init__(self):
            self._rules = [(rule_id, re.compile(p)) for rule_id, p in compiled]

        def eval(self, text: str) -> Iterator[tuple[str, str]]:
            if text is not None:
                for rule_id, rx in self._rules:
                    for m in rx.finditer(text):
                        yield rule_id, m.group(0)

    return FindingRows


def risk_udaf():
    """Grouped aggregate: 100·(1 − Π(1 − w)^n) over severity counts of one key.

    Feed it pre-aggregated rows (key, severity, n): a group then holds at most
    five rows, however many findings the key has.
    """

    @F.pandas_udf("double")
    def risk(severity: pd.Series, n: pd.Series) -> float:
        keep = ((1.0 - severity / 50.0) ** n).prod()
        return float(100.0 * (1.0 - keep))

    return risk


def risk_by(findings: DataFrame, key: str = "repo") -> DataFrame:
    small = findings.groupBy(key, "severity").agg(F.count("*").alias("n"))
    return small.groupBy(key).agg(F.round(risk_udaf()("severity", "n"), 6).alias("risk"))
