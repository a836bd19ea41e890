"""Helpers of the corpus operators: word columns in Arrow, slices of bounded size, stable held-out folds."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from palisade.session import cut_lineage

# A word is a maximal run of characters other than the ASCII white space U+0020 and U+0009 to U+000D.
WORD = r"[^\x20\x09-\x0D]+"
SLICE_BYTES = 16 << 20
HEAVY = 10_000  # keys and rows, see spread_join


def documents(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select(*columns)


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def n_words(text: Column) -> Column:
    """Words of a text, 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def fold(doc_id: str, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``; null for a null id."""
    return F.pmod(F.crc32(F.col(doc_id).cast("string")), F.lit(folds))


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut batches so that a slice holds at most ``limit`` bytes of text, or one row."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0))
        group = (np.cumsum(sizes) - sizes) // limit
        starts = np.flatnonzero(np.diff(group, prepend=-1))
        for a, b in zip(starts, [*starts[1:], batch.num_rows], strict=True):
            yield batch.slice(a, b - a)
        # Workers are kept for later tasks; what they do not use goes back.
        pa.default_memory_pool().release_unused()


def split_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All words of the texts in order, and per text where its words begin (one offset more than texts)."""
    lists = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
    words = pc.list_flatten(lists)
    sizes = np.asarray(pc.list_value_length(lists), dtype=np.int64)
    full = np.asarray(pc.not_equal(pc.binary_length(words), 0))
    if not full.all():  # white space at an end leaves an empty word
        owner = np.repeat(np.arange(len(sizes)), sizes)[full]
        sizes = np.bincount(owner, minlength=len(sizes))
        words = words.filter(pa.array(full))
    return words, np.concatenate([[0], np.cumsum(sizes)])


def coded(words: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """Words as numbers, and the distinct words in that numbering."""
    d = pc.dictionary_encode(words)
    if isinstance(d, pa.ChunkedArray):
        d = d.combine_chunks()
    return np.asarray(d.indices), d.dictionary


def sums(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sum of values per range of offsets; an empty range gives 0."""
    total = np.concatenate([np.zeros(1, values.dtype if values.dtype.kind == "f" else np.int64), np.cumsum(values)])
    return total[offsets[1:]] - total[offsets[:-1]]


def free_names(df: DataFrame, *names: str) -> list[str]:
    """The names, each with as many underscores ahead as make it new to the table."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        out.append(name)
    return out


def spread_join(left: DataFrame, right: DataFrame, key: str, how: str = "inner") -> DataFrame:
    """Join of left, of any distribution, with right, which holds a key once; inner or left_semi.

    The keys with more than ``HEAVY`` left rows and more than a ``HEAVY``-th of them are fewer than ``HEAVY``: their right rows are
    broadcast, the others are shuffled.
    """
    counts = left.groupBy(key).agg(F.count("*").alias("_n"))
    most, total = counts.agg(F.max("_n"), F.sum("_n")).first()
    limit = max(HEAVY, (total or 0) // HEAVY)
    if (most or 0) <= limit:
        return left.join(right, key, how)
    heavy = cut_lineage(counts.where(F.col("_n") > limit).select(key))
    few = F.broadcast(cut_lineage(right.join(F.broadcast(heavy), key, "left_semi")))
    rest = left.join(F.broadcast(heavy), key, "left_anti")
    return left.join(F.broadcast(heavy), key, "left_semi").join(few, key, how).unionByName(rest.join(right, key, how))
