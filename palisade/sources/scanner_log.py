"""Logs of injection scanners: runs and the injection points they report."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palisade.functions.coerce import js_trim
from palisade.operators.ordered import carry_last, running_sum, seq_bucket
from palisade.sources.lines import read_lines

RUN_START = r"^\[\*\] starting @ (.*)$"
RUN_END = r"^\[\*\] ending @ (.*)$"


def read_log_lines(spark: SparkSession, path: str) -> DataFrame:
    """log_lines(file, n, text): numbered lines, a large log read by many tasks."""
    return read_lines(spark, path)


def segment_runs(log_lines: DataFrame, start, keys=("file",), order=("n",), width: int = 100_000) -> DataFrame:
    """Add ``run``: the number of start lines up to and including each line."""
    return running_sum(
        log_lines, keys, order, seq_bucket(order[0], width), {"run": F.when(start, 1).otherwise(0).cast("bigint")}
    )


def read_scanner_log(log_lines: DataFrame, width: int = 100_000) -> dict[str, DataFrame]:
    """log_lines(file, n, text) → runs and injection points.

    A point is closed by its ``Payload:`` line and takes the last ``Parameter``,
    ``Type`` and ``Title`` before it in the file.
    """
    text = F.col("text")
    seg = segment_runs(log_lines, text.rlike(RUN_START), width=width).where(F.col("run") > 0)
    one = lambda pattern: F.max(F.nullif(F.regexp_extract("text", pattern, 1), F.lit("")))
    runs = seg.groupBy("file", "run").agg(
        one(RUN_START).alias("started"),
        one(RUN_END).alias("ended"),
        one(r"^back-end DBMS: (.*)$").alias("dbms"),
        F.count("*").alias("lines"),
    )
    grab = lambda pattern: F.nullif(F.regexp_extract("text", pattern, 1), F.lit(""))
    marked = carry_last(
        seg.where(text.rlike(r"^\s*(Parameter|Type|Title|Payload): ")),
        ["file", "run"],
        ["n"],
        seq_bucket("n", width),
        {
            "head": grab(r"^Parameter: (.*)$"),
            "type": grab(r"^\s+Type: (.*)$"),
            "title": grab(r"^\s+Title: (.*)$"),
        },
    )
    points = marked.where(text.rlike(r"^\s+Payload: ")).select(
        "file", "run", "n",
        js_trim(F.regexp_extract("head", r"^(.*?) *\(", 1)).alias("parameter"),
        F.regexp_extract("head", r"\(([A-Z]+)\)", 1).alias("place"),
        "type", "title",
        F.regexp_extract("text", r"^\s+Payload: (.*)$", 1).alias("payload"),
    )
    return {"runs": runs, "points": points}
