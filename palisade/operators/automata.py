"""Finite automata over ordered rows that survive a hot key.

A row's symbol is a map of states to states, and maps compose, so a key's rows need not be read by one task from their start: rows
are dealt by ranges of (key, order), every task composes the maps of its stretch of a key, and only one map per stretch is carried
to the next one. A map of up to ``STATES`` states is one 64-bit number, four bits a state.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from palisade.session import cut_lineage

STATES = 15
BITS = 4


def packed(maps: np.ndarray) -> np.ndarray:
    """Rows of next states as numbers."""
    return (maps.astype(np.int64) << (BITS * np.arange(maps.shape[1]))).sum(1)


def composed(maps: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Per row the map from the start of its stretch to behind the row; ``first`` marks where stretches start.

    The stretch doubles with every step, so n rows take log2(n) steps over whole columns.
    """
    out, stretch, d = maps, np.cumsum(first), 1
    while d < len(out):
        joined = np.take_along_axis(out[d:], out[:-d], 1)
        same = stretch[d:] == stretch[:-d]
        out = np.concatenate([out[:d], np.where(same[:, None], joined, out[d:])])
        d *= 2
    return out


def changes(columns: list[pa.Array]) -> np.ndarray:
    """Where a row's keys differ from those of the row before; the first row counts as different."""
    n = len(columns[0])
    out = np.ones(n, bool)
    if n > 1:
        out[1:] = False
        for c in columns:
            differs = pc.fill_null(pc.not_equal(c.slice(1), c.slice(0, n - 1)), True)
            both_null = pc.and_(pc.is_null(c.slice(1)), pc.is_null(c.slice(0, n - 1)))
            out[1:] |= np.asarray(pc.and_not(differs, both_null))
    return out


def step(code: str, state: str) -> Column:
    """The state that a packed map gives for a state."""
    return F.expr(f"cast(shiftright({code}, {BITS} * {state}) & {(1 << BITS) - 1} AS int)")


def run_automaton(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], symbol: Column, delta: Sequence[Sequence[int]],
    start: int = 0, partitions: int | None = None,
) -> DataFrame:
    """Add ``state_before`` and ``state`` to every row: the automaton's state ahead of and behind it, along ``order`` per key.

    ``delta[symbol][state]`` is the next state; a null symbol leaves the state as it is. Every key starts in ``start``. Rows that
    ``order`` ties are taken in any order. One shuffle by ranges; the maps of the stretches that a range boundary cuts are at most
    one per range and key, and are broadcast.
    """
    table = np.array([*delta, range(len(delta[0]))], np.int64)
    if table.shape[1] > STATES:
        raise ValueError(f"more than {STATES} states")
    n_keys = len(keys)
    src = df.withColumn("_symbol", F.coalesce(symbol.cast("int"), F.lit(len(delta))))
    ordered = [F.col(c) for c in [*keys, *order]]
    dealt = src.repartitionByRange(partitions, *ordered) if partitions else src.repartitionByRange(*ordered)
    schema = T.StructType([*df.schema.fields, *[T.StructField(n, T.LongType()) for n in ("_part", "_at", "_before", "_after")]])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, at = TaskContext.get().partitionId(), 0
        held, last = None, None  # the map so far of the stretch that goes on, and its keys
        for batch in batches:
            if not batch.num_rows:
                continue
            columns = [batch.column(k) for k in keys]
            maps = table[np.asarray(batch.column("_symbol"))]
            first = changes(columns)
            own = [c[0].as_py() for c in columns]
            goes_on = held is not None and own == last
            after = composed(maps, first)
            if goes_on:
                stop = np.flatnonzero(first[1:])[:1]
                stop = int(stop[0]) + 1 if len(stop) else len(after)
                after[:stop] = after[:stop][:, held]
            before = np.concatenate([np.arange(table.shape[1])[None], after[:-1]])
            before[first] = np.arange(table.shape[1])
            if goes_on:
                before[0] = held
            n = batch.num_rows
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], pa.array(np.full(n, part)), pa.array(np.arange(at, at + n)), pa.array(packed(before)), pa.array(packed(after))],
                schema.names)
            held, last, at = after[-1], [c[n - 1].as_py() for c in columns], at + n

    rows = cut_lineage(dealt.sortWithinPartitions(*ordered).mapInArrow(scan, schema))
    pieces = rows.groupBy(*keys, "_part").agg(F.max_by("_after", "_at").alias("_map"))
    ends = rows.groupBy("_part").agg(
        *[F.min_by(k, "_at").alias(f"_a{i}") for i, k in enumerate(keys)], *[F.max_by(k, "_at").alias(f"_b{i}") for i, k in enumerate(keys)])
    # A key that lies in two parts is the last of one and the first of another.
    own = lambda side: ends.select("_part", *[F.col(f"_{side}{i}").alias(f"_k_{k}") for i, k in enumerate(keys)])
    edges = own("a").union(own("b")).distinct().groupBy(*[f"_k_{k}" for k in keys]).agg(F.count("*").alias("_n")).where(F.col("_n") > 1).drop("_n")
    cut = pieces.join(F.broadcast(edges), [pieces[k].eqNullSafe(edges[f"_k_{k}"]) for k in keys]).select(*keys, "_part", "_map")

    def entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, last = start, None
        for batch in batches:
            entered = []
            for *own, code in zip(*[batch.column(c).to_pylist() for c in [*keys, "_map"]], strict=True):
                now = now if own == last else start
                entered.append(now)
                now, last = (code >> (BITS * now)) & ((1 << BITS) - 1), own
            yield pa.RecordBatch.from_arrays([*batch.columns[:n_keys + 1], pa.array(entered, pa.int32())], [*names, "_entry"])

    names = [*[f"_k_{k}" for k in keys], "_p"]
    kinds = T.StructType([*[T.StructField(f"_k_{k}", df.schema[k].dataType) for k in keys], T.StructField("_p", T.LongType()), T.StructField("_entry", T.IntegerType())])
    entered = cut_lineage(cut.repartition(*keys).sortWithinPartitions(*keys, "_part").mapInArrow(entries, kinds))
    met = rows.join(F.broadcast(entered), [*[F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in keys], F.col("_part") == F.col("_p")], "left")
    met = met.withColumn("_s", F.coalesce("_entry", F.lit(start)))
    return met.select(*df.columns, step("_before", "_s").alias("state_before"), step("_after", "_s").alias("state"))

