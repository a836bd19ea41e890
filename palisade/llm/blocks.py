"""Per-document sums over a corpus-wide table of strings, without moving documents.

A block is a slice of documents with the distinct strings (tokens, pre-tokens) of its texts and how often each document
holds each of them, as packed arrays. Only (block, string) pairs travel: sorted by string they reach the task that values
each distinct string once, and the values go back to the block, where each document's sum is a sparse product. A string that
every document holds travels once a block, so no key is hot; a block's memory is bounded by its text.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palisade.llm.common import slices
from palisade.session import cut_lineage

GROUP = 1 << 19  # occurrences that are sorted together, or one document
# (slice of documents) to (their strings' numbers in order, offsets per document, distinct strings, further document columns)
Reader = Callable[[pa.RecordBatch], tuple[np.ndarray, np.ndarray, pa.Array, dict[str, np.ndarray]]]


def frequencies(codes: np.ndarray, at: np.ndarray, kinds: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Occurrences to (document, string, count), ordered by document. Documents are taken some at a time to bound memory."""
    found = [(np.zeros(0, np.int32),) * 3]
    group = at[:-1] // GROUP
    cuts = [*np.flatnonzero(np.diff(group, prepend=-1)).tolist(), len(at) - 1]
    for a, b in zip(cuts, cuts[1:], strict=False):
        key = np.repeat(np.arange(a, b, dtype=np.int64) * max(kinds, 1), np.diff(at[a : b + 1]))
        key += codes[at[a] : at[b]]
        key.sort()
        first = np.flatnonzero(np.diff(key, prepend=-1))
        key, times = key[first], np.diff(first, append=len(key))
        found.append(((key // max(kinds, 1)).astype(np.int32), (key % max(kinds, 1)).astype(np.int32), times.astype(np.int32)))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def _shrink(numbers: np.ndarray) -> bytes:
    """Small numbers as bytes, one byte plane after the other, compressed."""
    return pa.compress(np.ascontiguousarray(numbers.astype("<i4").view(np.uint8).reshape(-1, 4).T).tobytes(), "zstd", asbytes=True)


def _grow(data: bytes, n: int) -> np.ndarray:
    planes = np.frombuffer(pa.decompress(data, 4 * n, "zstd", asbytes=True), np.uint8).reshape(4, n)
    return np.ascontiguousarray(planes.T).view("<i4").reshape(n).astype(np.int64)


def blocks(docs: DataFrame, make_reader: Callable[[], Reader], columns: dict[str, str], limit: int, counted: str | None = None) -> DataFrame:
    """Written table (block, doc_id, columns…, strings, totals, sizes, held, times).

    Per block: the documents' ids and columns, the distinct strings and how often the block holds each, the number of
    distinct strings of each document, and for each of those its number (as a difference) and count, packed. ``docs`` has doc_id, text and what the
    reader wants; ``columns`` names the reader's columns and their SQL types. ``counted`` is a column of ``docs`` that says
    whether a document adds to the totals (default: all do).
    """
    kind = docs.schema["doc_id"].dataType.simpleString()

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read, task = make_reader(), TaskContext.get().partitionId()
        for i, batch in enumerate(slices(batches, limit=limit)):
            codes, at, strings, more = read(batch)
            doc, held, times = frequencies(codes, at, len(strings))
            sizes = np.bincount(doc, minlength=batch.num_rows).astype(np.int32)
            adds = times if counted is None else times * np.asarray(batch.column(counted).to_pylist(), dtype=np.int64)[doc]
            totals = np.bincount(held, adds, len(strings)).astype(np.int64)
            one = lambda x: pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x)
            yield pa.RecordBatch.from_pydict({
                "block": pa.array([(task << 32) + i], pa.int64()), "doc_id": one(batch.column("doc_id")),
                **{c: one(pa.array(more[c])) for c in columns}, "strings": one(strings), "totals": one(pa.array(totals)),
                "sizes": one(pa.array(sizes)), "held": pa.array([_shrink(np.diff(held, prepend=0))]), "times": pa.array([_shrink(times)]),
            })

    schema = (f"block bigint, doc_id array<{kind}>, " + "".join(f"{c} array<{t}>, " for c, t in columns.items())
              + "strings array<string>, totals array<bigint>, sizes array<int>, held binary, times binary")
    return cut_lineage(docs.mapInArrow(pack, schema))


def by_string(table: DataFrame, totals: bool = False) -> DataFrame:
    """(string, block, place) and, if asked for, the total in the block; dealt and sorted by string."""
    if totals:
        pairs = table.select("block", F.posexplode(F.arrays_zip("strings", "totals")).alias("place", "s")).select(
            F.col("s.strings").alias("string"), "block", "place", F.col("s.totals").alias("total"))
    else:
        pairs = table.select("block", F.posexplode("strings").alias("place", "string")).select("string", "block", "place")
    return pairs.repartition("string").sortWithinPartitions("string")


def runs(batches: Iterator[pa.RecordBatch], column: str = "string") -> Iterator[pa.RecordBatch]:
    """Cut sorted batches only between different strings. A string's run is as long as there are blocks at most."""
    held: pa.Table | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        t = pa.Table.from_batches([batch])
        if held is not None:
            t = pa.concat_tables([held, t])
        col = t.column(column)
        last, n = col[len(col) - 1], len(col)
        lo, hi = 0, n - 1  # first row of the last string
        while lo < hi:
            mid = (lo + hi) // 2
            if col[mid].as_py() == last.as_py():
                hi = mid
            else:
                lo = mid + 1
        if lo:
            yield t.slice(0, lo).combine_chunks().to_batches()[0]
        held = t.slice(lo)
    if held is not None and held.num_rows:
        yield held.combine_chunks().to_batches()[0]


def document_sums(table: DataFrame, valued: DataFrame, sent: dict[str, str], columns: dict[str, str],
                  derive: Callable[[dict[str, np.ndarray]], dict[str, np.ndarray]] | None = None, values: dict[str, str] | None = None) -> DataFrame:
    """One row per document: doc_id, the columns, and per value the sum of count * value over its strings.

    ``valued`` has (block, place, ``sent``…) for every string of every block; ``derive`` makes the values of it (default: the same).
    """
    kind = table.schema["doc_id"].dataType.elementType.simpleString()
    values = values or sent
    keep = list(columns)
    back = valued.groupBy("block").agg(F.collect_list(F.struct("place", *sent)).alias("valued"))
    met = table.select("block", "doc_id", *keep, "sizes", "held", "times").join(back, "block", "left").select(
        "doc_id", *keep, "sizes", "held", "times", F.col("valued.place").alias("_place"), *[F.col(f"valued.{v}").alias(f"_{v}") for v in sent])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                cell = lambda c, r=r, batch=batch: batch.column(c)[r].values
                sizes = np.asarray(cell("sizes"), dtype=np.int64)
                at = np.concatenate([[0], np.cumsum(sizes)])
                held = np.cumsum(_grow(batch.column("held")[r].as_py(), at[-1]))
                times = _grow(batch.column("times")[r].as_py(), at[-1])
                out = {"doc_id": cell("doc_id"), **{c: cell(c) for c in keep}}
                total = {v: np.zeros(len(sizes), np.float64 if t == "double" else np.int64) for v, t in values.items()}
                if len(held):
                    place, given = np.asarray(cell("_place")), {v: np.asarray(cell(f"_{v}")) for v in sent}
                    full = np.flatnonzero(sizes)
                    for v, x in (derive(given) if derive else given).items():
                        by_place = np.zeros(len(x), x.dtype)
                        by_place[place] = x
                        # A sum per document on its own, so that its value does not depend on its neighbours.
                        total[v][full] = np.add.reduceat(times * by_place[held], at[full])
                yield pa.RecordBatch.from_pydict({**out, **{v: pa.array(x) for v, x in total.items()}})

    schema = f"doc_id {kind}" + "".join(f", {c} {t}" for c, t in columns.items()) + "".join(f", {v} {t}" for v, t in values.items())
    return met.mapInArrow(add, schema)
