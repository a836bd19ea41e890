"""Passages that texts share with known ones, by winnowed fingerprints with their places.

Of every run of ``window`` consecutive word n-grams the smallest hash is kept, the last one if it occurs twice. Two texts that
share a passage of ``n + window - 1`` words keep a common fingerprint in it, and only hashes and places ever move. Matches on one
diagonal (place there minus place here) that follow one another closely are one passage.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

WORDS = r"[A-Za-z0-9À-ÿ]+"
MANY = 1 << 16  # kept n-grams that leave a task together


def fingerprints(texts: DataFrame, key: str, text: str, n: int = 5, window: int = 4) -> DataFrame:
    """(key, hash, place): the kept n-grams of each text; place counts words from 0. Shorter texts have none."""
    words = F.regexp_extract_all(F.lower(F.col(text)), F.lit(WORDS), F.lit(0))
    src = texts.select(F.col(key).alias("_key"), F.array_join(words, " ").alias("_w"))
    kind = src.schema["_key"].dataType.simpleString()
    return src.mapInArrow(_kept(n, window), f"_key {kind}, hash string, place int").select(F.col("_key").alias(key), "hash", "place")


def _kept(n: int, window: int):
    """Texts of words with one space between to their kept n-grams: an n-gram is a stretch of its text and is hashed once."""

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, hashes, places, held = [], [], [], 0
            for row, words in enumerate(batch.column("_w")):
                raw = (words.as_py() or "").encode()
                spaces = np.flatnonzero(np.frombuffer(raw, np.uint8) == 32)
                grams = len(spaces) + 2 - n
                if not raw or grams < window:
                    continue
                starts, ends = np.concatenate([[0], spaces + 1]), np.concatenate([spaces, [len(raw)]])
                md5s = [hashlib.md5(raw[a:b]).digest() for a, b in zip(starts[:grams].tolist(), ends[n - 1 :].tolist(), strict=True)]
                # Digests as big-endian halves: the smallest of a window, the last of equal ones.
                halves = np.frombuffer(b"".join(md5s), ">u8").astype(np.uint64).reshape(-1, 2)
                at = np.arange(grams - window + 1)
                for i in range(1, window):
                    other = np.arange(i, grams - window + 1 + i)
                    less = (halves[other, 0] < halves[at, 0]) | ((halves[other, 0] == halves[at, 0]) & (halves[other, 1] <= halves[at, 1]))
                    at = np.where(less, other, at)
                at = np.unique(at)
                rows.append(np.full(len(at), row))
                places.append(at)
                hashes += [md5s[i].hex() for i in at.tolist()]
                held += len(at)
                if held >= MANY:
                    yield _rows(batch, rows, hashes, places)
                    rows, hashes, places, held = [], [], [], 0
            if rows:
                yield _rows(batch, rows, hashes, places)

    return kept


def _rows(batch: pa.RecordBatch, rows: list[np.ndarray], hashes: list[str], places: list[np.ndarray]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [batch.column("_key").take(pa.array(np.concatenate(rows))), pa.array(hashes, pa.string()), pa.array(np.concatenate(places), pa.int32())], ["_key", "hash", "place"])


def shared_passages(texts: DataFrame, known: DataFrame, key: str, known_key: str, text: str = "text", n: int = 5, window: int = 4, least: int = 12) -> DataFrame:
    """(key, known_key, start, end, known_start, marks): passages of at least ``least`` words, as places of words, end exclusive."""
    mine = fingerprints(texts, key, text, n, window)
    theirs = fingerprints(known, known_key, text, n, window).withColumnRenamed("place", "there")
    met = mine.join(theirs, "hash").withColumn("_d", F.col("there") - F.col("place"))
    line = W.partitionBy(key, known_key, "_d").orderBy("place")
    far = F.col("place") - F.lag("place").over(line) > n + window
    runs = met.withColumn("_s", F.when(far, 1).otherwise(0)).withColumn("_r", F.sum("_s").over(line))
    spans = runs.groupBy(key, known_key, "_d", "_r").agg(F.min("place").alias("start"), (F.max("place") + n).alias("end"), F.min("there").alias("known_start"), F.count("*").alias("marks"))
    return spans.where(F.col("end") - F.col("start") >= least).select(key, known_key, "start", "end", "known_start", "marks")
