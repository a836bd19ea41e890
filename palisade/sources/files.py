"""Repository scans: files from disk, line tables, and the one-document corpus."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palisade.operators.ordered import global_order

# Fixed map of file suffixes to languages.
LANGUAGES = {
    "py": "python", "js": "javascript", "jsx": "javascript", "ts": "typescript", "tsx": "typescript",
    "java": "java", "go": "go", "rb": "ruby", "php": "php", "sql": "sql", "html": "html",
    "yaml": "yaml", "yml": "yaml", "json": "json", "md": "markdown", "txt": "text",
}


def language(path):
    suffix = F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))
    table = F.create_map(*[F.lit(x) for kv in LANGUAGES.items() for x in kv])
    return F.coalesce(F.try_element_at(table, suffix), F.lit("other"))


def describe(files: DataFrame) -> DataFrame:
    """files(repo, path, content) → + bytes, sha256, lang."""
    return files.select(
        "repo",
        "path",
        "content",
        F.octet_length("content").cast("bigint").alias("bytes"),
        F.sha2("content", 256).alias("sha256"),
        language(F.col("path")).alias("lang"),
    )


def read_files(spark: SparkSession, root: str, globs: str | Sequence[str] = "*") -> DataFrame:
    """Recursive scan of ``root/<repo>/…`` into the files table.

    Bytes that are not UTF-8 are replaced, never dropped.
    """
    pattern = globs if isinstance(globs, str) else "{" + ",".join(globs) + "}"
    raw = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", "true")
        .option("pathGlobFilter", pattern)
        .load(root)
    )
    base = root.rstrip("/")
    rel = F.regexp_replace("path", F.lit(r"^.*?" + _quote(base) + "/"), F.lit(""))
    out = raw.select(
        F.regexp_extract(rel, r"^([^/]+)/", 1).alias("repo"),
        F.regexp_replace(rel, r"^[^/]+/", "").alias("path"),
        F.make_valid_utf8(F.col("content").cast("string")).alias("content"),
    )
    return describe(out)


def _quote(text: str) -> str:
    return r"\Q" + text + r"\E"


def lines(files: DataFrame, *keep: str) -> DataFrame:
    """One row per line (1-based). Narrow: no shuffle."""
    return files.select(*keep, F.posexplode(F.split("content", "\n")).alias("_pos", "text")).select(
        *keep, (F.col("_pos") + 1).alias("line"), "text"
    )


def corpus_layout(files: DataFrame) -> DataFrame:
    """Where each file sits in its repository's single document: (repo, path, chars, md5, index, offset).

    The document of a repo is its files in path order, each followed by a line
    break. Sizes, not texts, are ordered; offsets come from a range-partitioned
    running total, so no repo has to fit in one task.
    """
    sized = files.select("repo", "path", F.length("content").cast("bigint").alias("chars"), F.md5("content").alias("md5"))
    placed = global_order(sized, ["repo", "path"], {"_end": F.col("chars") + 1})
    starts = placed.groupBy("repo").agg(F.min(F.col("_end") - F.col("chars") - 1).alias("_base"))
    return placed.join(starts, "repo").select(
        "repo", "path", "chars", "md5", "index", (F.col("_end") - F.col("chars") - 1 - F.col("_base")).alias("offset")
    )


def write_corpus(files: DataFrame, target: str, partitions: int | None = None) -> None:
    """Write every repo's files in path order as text below ``repo=…``.

    Range partitioning on (repo, path) splits a large repo over many tasks; the
    part files of a repo, read in name order, form its single document.
    """
    by = ["repo", "path"]
    ranged = files.repartitionByRange(partitions, *by) if partitions else files.repartitionByRange(*by)
    (
        ranged
        .sortWithinPartitions("repo", "path")
        .select("repo", F.col("content").alias("value"))
        .write.mode("overwrite")
        .partitionBy("repo")
        .text(target)
    )
