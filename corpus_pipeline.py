"""The training-data pipeline over documents: rules, near duplicates, personal data, mixing, packing.

Every stage works on all that the one before kept and hands on the columns of documents; the last returns packed pieces. Further
columns of the table are left behind at the first stage, whatever their names. Nulls, repeated rows and empty tables are handled as each
stage says; an empty table gives empty results throughout.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palisade.llm import mixing, neardup, packing, pii, quality
from palisade.llm.queries import tokenizer
from palisade.session import cut_lineage, small_batches

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _measured(docs: DataFrame) -> DataFrame:
    """n_chars follows the text that a stage changed."""
    return docs.withColumn("n_chars", F.length("text").cast("bigint")).select(*COLUMNS)


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected documents go; boilerplate lines leave the others.

    A null or empty text has no words and is rejected; documents without a source form one host; repeated rows are judged alike.
    """
    small_batches(spark)
    return _measured(quality.clean(docs.select(*COLUMNS)))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class stays, the one with the smallest id; a null id is the largest.

    Of repeated rows one stays. A class of texts is what links of similarity 0.8 or more connect.
    """
    small_batches(spark)
    return neardup.deduplicated(docs.select(*COLUMNS))


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is replaced by its kind in brackets; every row stays, a null text stays null."""
    small_batches(spark)
    return _measured(pii.redact(docs.select(*COLUMNS)))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents appear as often as the mix takes them, up to 3 times, or not at all; a null source is a source, the last."""
    small_batches(spark)
    return mixing.mixed(docs.select(*COLUMNS))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of at most 2048 tokens; a null text is its end sign alone, each repeated row has pieces."""
    small_batches(spark)
    return packing.pack(docs, tokenizer("byte_bpe_50k.json"))


STAGES = [
    ("quality rules", quality_stage),
    ("MinHash near-dedup", near_duplicate_stage),
    ("PII", pii_stage),
    ("mixing sources to target weights", mixing_stage),
    ("best-fit packing", packing_stage),
]

# Sampling, tokenizing and packing are beyond SQL; the tests compare the stages with plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each result is a written table that the next one reads.

    The rows are those of the last stage: a piece of a document with its sequence and its place there.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = cut_lineage(docs)
    return docs
