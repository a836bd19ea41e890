"""Numbered lines of text files of any size."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from palisade.session import cut_lineage


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, n, text): every line with its number from 0; ``file`` is the path below ``path``.

    Large files are read by byte ranges, many tasks a file; Spark gives a line that a boundary cuts to the range it starts in. The
    ranges are read once and written with each line's place in its range. Lines of a range are counted, the counts are added
    up along the file, and the sum ahead of a range (one row a range) turns places into line numbers. Lines end by ``\\n`` or
    ``\\r\\n``; a compressed file is one range.
    """
    raw = spark.read.option("lineSep", "\n").text(path)
    lines = cut_lineage(raw.select(
        F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("range"),
        F.monotonically_increasing_id().alias("place"), F.regexp_replace("value", "\r$", "").alias("text")))
    ranges = lines.groupBy("path", "range").agg(F.count("*").alias("lines"), F.min("place").alias("first"))
    before = W.partitionBy("path").orderBy("range").rowsBetween(W.unboundedPreceding, -1)
    ranges = ranges.select("path", "range", (F.coalesce(F.sum("lines").over(before), F.lit(0)) - F.col("first")).alias("shift"))
    # A folder's files are named from below it; a file or a pattern has no folder to leave out.
    root = f"{path.rstrip('/').split('://', 1)[-1].removeprefix('file:')}/"
    name = F.when(F.contains("path", F.lit(root)), F.element_at(F.split("path", _literal(root), 2), 2)).otherwise(F.element_at(F.split("path", "/"), -1))
    return lines.join(ranges, ["path", "range"]).select(name.alias("file"), (F.col("place") + F.col("shift")).alias("n"), "text")


def _literal(text: str) -> str:
    return "\\Q" + text + "\\E"
