"""Quality rules: lines that recur across the documents of a host are removed, depleted documents rejected.

Lines are normalised (lower case, white space collapsed) and hashed together with their host. A line is frequent if more than
``min_docs`` documents of its host hold it, an absolute number that does not loosen with the host's size. A document of which
frequent lines leave less than ``min_left`` of its words has no content of its own. A frequent line is boilerplate if more than
``min_docs`` documents with content of their own hold it: the lines of a group of copies, which are frequent because the whole text
is, are not, so copies stay for the near-duplicate stage to choose from. Boilerplate is removed; a document that is left with less
than ``min_left`` of its words is depleted.

Counts run over one narrow table (document, line, words), by partial aggregation; neither a hot host nor a hot line meets in one
task. A document is its id, host and text: repeated rows count once and are judged alike, each with its own row. Nulls: a null text
has no words and no lines; documents without a host form one host. Empty tables give empty results. Extra columns are ignored by
``judge`` and kept by ``clean``, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from palisade.llm.common import coded, free_names, n_words, slices, split_words, spread_join, sums, text_or_empty
from palisade.llm.tables import marked
from palisade.session import cut_lineage

SLICE = 2 << 20
SYMBOLS = "#*$%&|<>"
SPACES = " \t\n\v\f\r"
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def line_hash(host: Column, line: Column) -> Column:
    """Hash of a host's normalised line; null for a line without a word."""
    plain = F.trim(F.regexp_replace(F.lower(line), r"[\x20\x09-\x0D]+", " "))
    return F.when(plain != "", F.xxhash64(host, plain))


def document(doc_id: str, host: str, text: str) -> Column:
    return F.xxhash64(F.col(doc_id), F.col(host), F.col(text), F.col(host).isNull())


def once(rows: DataFrame, key: str) -> DataFrame:
    """A row of each 64-bit key; rows move only if their key may come twice, which a bit table tells."""
    twice = cut_lineage(rows.groupBy(key).agg(F.count("*").alias("n")).where(F.col("n") > 1).select(F.col(key).alias("key")))
    if twice.isEmpty():
        return rows
    known = marked(twice)
    return rows.where(~known(F.col(key))).unionByName(rows.where(known(F.col(key))).dropDuplicates([key]))


def boilerplate_lines(docs: DataFrame, doc_id: str, host: str, text: str, min_docs: int, min_left: float) -> DataFrame:
    """Written table (doc, line, words): the boilerplate lines of every document that has some, with their words there."""
    src = once(docs.select(document(doc_id, host, text).alias("doc"), F.col(host).alias("host"), text_or_empty(text).alias("text")), "doc")
    found = F.transform(F.split("text", "\n"), lambda x: F.struct(line_hash(F.col("host"), x).alias("line"), n_words(x).alias("words")))
    lines = src.select("doc", F.explode(F.filter(found, lambda x: x["line"].isNotNull())).alias("x")).select("doc", "x.*")
    lines = cut_lineage(lines.groupBy("doc", "line").agg(F.sum("words").alias("words")))
    often = lambda df: df.groupBy("line").agg(F.count("*").alias("n")).where(F.col("n") > min_docs).select("line")
    frequent = cut_lineage(spread_join(lines, often(lines), "line", "left_semi"))
    left = lines.groupBy("doc").agg(F.sum("words").alias("all")).join(frequent.groupBy("doc").agg(F.sum("words").alias("gone")), "doc")
    own = left.where(F.col("all") - F.col("gone") >= min_left * F.col("all")).select("doc")
    return cut_lineage(spread_join(frequent, often(frequent.join(own, "doc", "left_semi")), "line", "left_semi"))


def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, text, doc) to the counts of each text."""
    rng = np.random.default_rng(5)
    factor = rng.integers(1, 2**63, 5, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    for batch in slices(batches, limit=SLICE):
        words, at = split_words(batch.column("text"))
        codes, kinds = coded(words)
        texts = batch.column("text").to_pylist()
        n = len(texts)
        chars, symbols, dup_lines = (np.zeros(n, np.int64) for _ in range(3))
        for i, t in enumerate(texts):
            t = t or ""
            chars[i] = len(t) - sum(map(t.count, SPACES))
            symbols[i] = sum(map(t.count, SYMBOLS))
            lines = [x for x in t.split("\n") if x.strip(SPACES)]
            dup_lines[i] = len(lines) - len(set(lines))
        yield pa.RecordBatch.from_pydict({
            "doc_id": batch.column("doc_id"), "n_words": np.diff(at), "word_chars": chars, "n_symbols": symbols,
            "n_dup_lines": dup_lines, "n_repeat_words": repeated_words(codes, at, len(kinds), factor, rng), "doc": batch.column("doc"),
        })


def repeated_words(codes: np.ndarray, at: np.ndarray, kinds: int, factor: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Per text the words inside 5-word windows that the text holds twice or more; windows meet as 64-bit hashes."""
    if len(codes) < 5:
        return np.zeros(len(at) - 1, np.int64)
    word = rng.integers(0, 2**64, max(kinds, 1), dtype=np.uint64)[codes]
    owner = np.repeat(np.arange(len(at) - 1), np.diff(at))
    salt = rng.integers(0, 2**64, len(at) - 1, dtype=np.uint64)
    m = len(codes) - 4
    key = salt[owner[:m]]
    for k in range(5):
        key = key + word[k : k + m] * factor[k]
    inside = owner[:m] == owner[4:]
    start = np.flatnonzero(inside)
    key = key[inside]
    ordered = np.sort(key)
    twice = np.unique(ordered[1:][ordered[1:] == ordered[:-1]])
    if not len(twice):
        return np.zeros(len(at) - 1, np.int64)
    place = np.minimum(np.searchsorted(twice, key), len(twice) - 1)
    hit = start[twice[place] == key]
    edge = np.zeros(len(codes) + 1, np.int64)
    np.add.at(edge, hit, 1)
    np.add.at(edge, hit + 5, -1)
    return sums((np.cumsum(edge[:-1]) > 0).astype(np.int64), at)


def judge(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", host: str = "source", min_words: int = 10,
          max_repeat_pct: int = 20, min_left: float = 0.3, min_docs: int = 20) -> DataFrame:
    """One row per document: the measures, ``base_failed``, ``removed_words`` (in boilerplate lines) and ``kept``."""
    src = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), F.col(host).alias("source"))
    gone = boilerplate_lines(src, "doc_id", "source", "text", min_docs, min_left).groupBy("doc").agg(F.sum("words").alias("removed"))
    rows = src.select("doc_id", "text", document("doc_id", "source", "text").alias("doc"))
    kind = docs.schema[doc_id].dataType.simpleString()
    found = rows.mapInArrow(measure, f"doc_id {kind}, " + ", ".join(f"{m} bigint" for m in MEASURES) + ", doc bigint")
    found = found.join(gone, "doc", "left").withColumn("removed", F.coalesce("removed", F.lit(0).cast("bigint")))
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat_pct * F.col("n_words"))
    depleted = F.col("n_words") - F.col("removed") < min_left * F.col("n_words")
    return found.select("doc_id", *MEASURES, failed.alias("base_failed"), (~failed & ~depleted).alias("kept"),
                        F.col("removed").alias("removed_words"))


def clean(docs: DataFrame, text: str = "text", host: str = "source", min_words: int = 10, max_repeat_pct: int = 20,
          min_left: float = 0.3, min_docs: int = 20, doc_id: str = "doc_id") -> DataFrame:
    """The documents that ``judge`` keeps, without their boilerplate lines; all columns stay.

    Texts move only if they hold boilerplate: the others are told by a bit table and take no part in the join.
    """
    doc, words, repeat, lines, removed = free_names(docs, "doc", "words", "repeat", "lines", "removed")
    found = boilerplate_lines(docs, doc_id, host, text, min_docs, min_left)
    gone = cut_lineage(found.groupBy("doc").agg(F.collect_list("line").alias("lines"), F.sum("words").alias("removed")))
    gone = gone.select(F.col("doc").alias(doc), F.col("lines").alias(lines), F.col("removed").alias(removed))
    schema = T.StructType([*docs.schema.fields, *[T.StructField(n, T.LongType()) for n in (doc, words, repeat)]])

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rng = np.random.default_rng(5)
        factor = rng.integers(1, 2**63, 5, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        for batch in slices(batches, text, SLICE):
            found, at = split_words(batch.column(text))
            codes, kinds = coded(found)
            counts = [pa.array(np.diff(at)), pa.array(repeated_words(codes, at, len(kinds), factor, rng))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *counts], schema.names)

    known = marked(gone.select(F.col(doc).alias("key")))
    src = docs.withColumn(doc, document(doc_id, host, text))
    passed = (F.col(words) >= min_words) & (100 * F.col(repeat) <= max_repeat_pct * F.col(words))
    whole = src.where(~known(F.col(doc))).mapInArrow(counted, schema).where(passed).select(*docs.columns)
    met = src.where(known(F.col(doc))).mapInArrow(counted, schema).where(passed).join(gone, doc, "left")
    met = met.where(F.col(words) - F.coalesce(F.col(removed), F.lit(0)) >= min_left * F.col(words))
    kept = F.filter(F.split(F.col(text), "\n"), lambda x: ~F.coalesce(F.array_contains(F.col(lines), line_hash(F.col(host), x)), F.lit(False)))
    left = F.when(F.col(lines).isNull(), F.col(text)).otherwise(F.array_join(kept, "\n"))
    return whole.unionByName(met.select(*[left.alias(c) if c == text else F.col(c) for c in docs.columns]))
