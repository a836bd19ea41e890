"""Aggregations over orders, findings and events."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palisade.operators.changes import order_total

__all__ = ["order_total"]


def order_total_flat(items: DataFrame, key: str, price: Column, quantity: Column) -> DataFrame:
    return items.groupBy(key).agg(F.round(F.sum(price * quantity), 2).alias("total"), F.count("*").alias("items"))


def summarize(findings: DataFrame) -> DataFrame:
    """Signal summary per detector and severity."""
    return findings.groupBy("detector", "severity").agg(
        F.count("*").alias("signals"),
        F.count_distinct("repo", "path").alias("files"),
        F.max("line").alias("max_line"),
    )


def report_rollup(findings: DataFrame, section: str = "detector", rule: str = "rule_id") -> DataFrame:
    return findings.rollup(section, rule).agg(
        F.count("*").alias("n"), F.max("severity").alias("worst"), F.grouping_id().cast("bigint").alias("level")
    )


def report_cube(findings: DataFrame, a: str = "repo", b: str = "severity") -> DataFrame:
    return findings.cube(a, b).agg(F.count("*").alias("n"), F.grouping_id().cast("bigint").alias("level"))


def grouping_sets(findings: DataFrame, sets: Sequence[Sequence[str]], cols: Sequence[str]) -> DataFrame:
    return findings.groupingSets([[F.col(c) for c in s] for s in sets], *cols).agg(
        F.count("*").alias("n"), F.grouping_id().cast("bigint").alias("level")
    )


def risk_score(findings: DataFrame, key: str = "repo", weight: Column | None = None) -> DataFrame:
    """Capped weighted sum, worst severity and number of findings."""
    w = weight if weight is not None else F.col("severity")
    return findings.groupBy(key).agg(
        F.least(F.lit(100), F.sum(w)).cast("bigint").alias("risk"),
        F.max("severity").alias("worst"),
        F.count("*").alias("findings"),
    )


def dedup_findings(findings: DataFrame) -> DataFrame:
    """One row per fingerprint, keeping the first occurrence and all reporting detectors.

    ``collect_set`` holds detector names only, whose number is fixed by the registry.
    """
    return findings.groupBy("fingerprint").agg(
        F.min_by("path", F.struct("path", "line")).alias("path"),
        F.min_by("line", F.struct("path", "line")).alias("line"),
        F.min("rule_id").alias("rule_id"),
        F.max("severity").alias("severity"),
        F.array_join(F.array_sort(F.collect_set("detector")), ",").alias("detectors"),
        F.count("*").alias("occurrences"),
    )


def benchmark(findings: DataFrame, k: int, salt: str, cohort: str = "rule_id") -> DataFrame:
    """Anonymised industry benchmark: findings per repo, only cohorts of at least k repos.

    ``percentile`` buffers distinct counts per repo, a small integer domain.
    """
    per_repo = findings.groupBy(cohort, F.sha2(F.concat(F.col("repo"), F.lit(salt)), 256).alias("anon")).agg(
        F.count("*").alias("n")
    )
    return per_repo.groupBy(cohort).agg(
        F.count("*").alias("repos"),
        F.percentile("n", F.lit(0.5)).alias("median"),
        F.percentile("n", F.lit(0.9)).alias("p90"),
    ).where(F.col("repos") >= k)


def meter(files: DataFrame, key: str = "repo", text: str = "content") -> DataFrame:
    """Size, lines and an estimate of tokens (4 characters each) per repo."""
    chars = F.length(text).cast("bigint")
    return files.groupBy(key).agg(
        F.count("*").alias("files"),
        F.sum(F.octet_length(text).cast("bigint")).alias("bytes"),
        F.sum(F.length(text) - F.length(F.replace(F.col(text), F.lit("\n"), F.lit(""))) + 1).cast("bigint").alias("lines"),
        F.sum(F.ceil(chars / 4)).cast("bigint").alias("tokens"),
    )


def distinct_actors(df: DataFrame, key: str, actor: str, exact: bool = False, rsd: float = 0.02) -> DataFrame:
    count = F.count_distinct(actor) if exact else F.approx_count_distinct(actor, rsd)
    return df.groupBy(key).agg(count.alias("actors"))


def matrix(df: DataFrame, row: str, col: str, values: Sequence[str]) -> DataFrame:
    """Counts as a row × column table; the column values are given, so no extra pass."""
    return df.groupBy(row).pivot(col, list(values)).agg(F.count(F.lit(1))).na.fill(0)


def evaluate(predicted: DataFrame, truth: DataFrame, key: str) -> DataFrame:
    """Confusion counts and precision, recall, F1. Both sides: (key, flag)."""
    p = predicted.select(key, F.col("flag").alias("_p"))
    t = truth.select(key, F.col("flag").alias("_t"))
    both = t.join(p, key, "left").select("_t", F.coalesce("_p", F.lit(False)).alias("_p"))
    n = lambda c: F.coalesce(F.sum(F.when(c, 1)), F.lit(0))
    c = both.agg(
        n(F.col("_t") & F.col("_p")).alias("tp"), n(~F.col("_t") & F.col("_p")).alias("fp"),
        n(F.col("_t") & ~F.col("_p")).alias("fn"), n(~F.col("_t") & ~F.col("_p")).alias("tn"),
    )
    return c.select(
        "*",
        F.round(F.try_divide("tp", F.col("tp") + F.col("fp")), 6).alias("precision"),
        F.round(F.try_divide("tp", F.col("tp") + F.col("fn")), 6).alias("recall"),
        F.round(F.try_divide(F.col("tp") * 2, F.col("tp") * 2 + F.col("fp") + F.col("fn")), 6).alias("f1"),
    )
