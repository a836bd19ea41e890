"""Number tables of fixed size that tasks fill and Spark adds up: hashed counts and bit sets."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PART = 1 << 14  # entries that travel as one row

Fill = Callable[[Iterator[pa.RecordBatch], np.ndarray], None]


def filled(df: DataFrame, fill: Fill, size: int, joined: np.ufunc = np.add) -> np.ndarray:
    """The table of ``size`` int32 entries after every task has filled its own; entries meet by ``joined``.

    Tasks send parts of ``PART`` entries, compressed; the parts are joined by Spark and only the result, whose size is fixed,
    reaches the driver.
    """

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros(size, np.int32)
        fill(batches, table)
        parts = table.reshape(-1, min(PART, size))
        used = np.flatnonzero(parts.any(1))
        yield _rows(used, [parts[i] for i in used])

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for i, data in zip(batch.column("part").to_pylist(), batch.column("data").to_pylist(), strict=True):
                x = np.frombuffer(pa.decompress(data, 4 * min(PART, size), "zstd", asbytes=True), np.int32)
                held[i] = joined(held[i], x) if i in held else x
        yield _rows(list(held), list(held.values()))

    schema = "part int, data binary"
    rows = df.mapInArrow(task, schema).repartition("part").mapInArrow(join, schema).collect()
    out = np.zeros(size, np.int32).reshape(-1, min(PART, size))
    for r in rows:
        out[r.part] = np.frombuffer(pa.decompress(bytes(r.data), 4 * min(PART, size), "zstd", asbytes=True), np.int32)
    return out.reshape(-1)


MARKS = 1 << 22


def marked(keys: DataFrame, bits: int = MARKS) -> Callable[[Column], Column]:
    """Test whether a 64-bit hash may be in the column ``key``, by a bit table of fixed size.

    A key is never missed; one that passes by chance costs its transport only.
    """

    def mark(batches: Iterator[pa.RecordBatch], table: np.ndarray) -> None:
        for batch in batches:
            table[np.asarray(batch.column("key")).astype(np.uint64) % np.uint64(bits)] = 1

    shared = keys.sparkSession.sparkContext.broadcast(filled(keys, mark, bits, np.maximum).astype(bool))

    @F.pandas_udf("boolean")
    def known(found: pd.Series) -> pd.Series:
        return pd.Series(shared.value[found.to_numpy().astype(np.uint64) % np.uint64(bits)])

    return known


def told(rows: DataFrame, entries: int = MARKS) -> Callable[[Column], Column]:
    """Value of a 64-bit hash of the column ``key``, from the column ``value`` (0 to 7), by a table of fixed size.

    Null for a hash whose entry is shared by keys of different values. It never tells a key of ``rows`` a wrong value; other
    hashes may get any.
    """

    def mark(batches: Iterator[pa.RecordBatch], table: np.ndarray) -> None:
        for batch in batches:
            at = np.asarray(batch.column("key")).astype(np.uint64) % np.uint64(entries)
            np.bitwise_or.at(table, at.astype(np.int64), np.int32(1) << np.asarray(batch.column("value")).astype(np.int32))

    values = np.full(256, -1, np.int8)
    values[1 << np.arange(8)] = np.arange(8)
    shared = rows.sparkSession.sparkContext.broadcast(values[filled(rows.select("key", "value"), mark, entries, np.bitwise_or)])

    @F.pandas_udf("int")
    def value(found: pd.Series) -> pd.Series:
        got = pd.Series(shared.value[found.to_numpy().astype(np.uint64) % np.uint64(entries)].astype("float64"))
        return got.where(got >= 0).astype("Int32")

    return value


def _rows(parts: list[int], arrays: list[np.ndarray]) -> pa.RecordBatch:
    data = [pa.compress(np.ascontiguousarray(a).tobytes(), "zstd", asbytes=True) for a in arrays]
    return pa.RecordBatch.from_pydict({"part": pa.array(parts, pa.int32()), "data": pa.array(data, pa.binary())})
