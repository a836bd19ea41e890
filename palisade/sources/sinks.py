"""Report sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def report_rows(findings: DataFrame) -> DataFrame:
    """One JSON signal per finding plus its partition key."""
    cols = [c for c in findings.columns if c != "repo"]
    return findings.select("repo", F.to_json(F.struct(*cols)).alias("signal"))


def write_report(findings: DataFrame, path: str, summary: DataFrame | None = None, fmt: str = "json") -> None:
    """Signals partitioned by repo, with the summary statistics beside them."""
    if fmt == "csv":
        flat = [F.to_json(c).alias(c) if t.startswith(("map", "array", "struct")) else F.col(c) for c, t in findings.dtypes]
        findings = findings.select(*flat)
    findings.write.mode("overwrite").partitionBy("repo").format(fmt).save(f"{path}/signals")
    if summary is not None:
        summary.write.mode("overwrite").format(fmt).save(f"{path}/summary")
