"""Exact top-k by integer inner product: tiles of queries times tiles of rows, partial selection, tree merge.

Components become floor(scale * x). Rows and queries are packed into tiles (matrices of at most ``TILE`` rows); every query
tile is copied to each slot, and the tiles of the rows are dealt to the slots, so a row moves once. A slot takes one query tile after
the other, keeps a running list for each query of the tile, and sends them on when the next tile begins; the lists of the slots are
merged 16 at a time. Products run in floating point as long as no sum can pass 2^53,
which keeps them exact; otherwise in Python integers, and a score beyond 64 bits is held at the end of that range.

Vectors that are null or hold null or non-finite components take no part; a query meets the rows of its own length only.
A row with the id of the query is the query's own. Repeated queries get a list each; rows without an id can be found, last
among ties. Empty tables give no rows. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from palisade.session import cut_lineage

TILE = 4096
FAN_IN = 16
EXACT = 2.0**53
LOW, HIGH = -(2**63), 2**63 - 1


def tiles(vectors: DataFrame, scale: float) -> DataFrame:
    """(dim, tile, ids, matrix): valid vectors packed by length."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, made = TaskContext.get().partitionId(), 0
        held: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}

        def flush(dim: int) -> pa.RecordBatch:
            nonlocal made
            parts = held.pop(dim)
            ids = pa.concat_arrays([p[0] for p in parts])
            made += 1
            return pa.RecordBatch.from_pydict({
                "dim": pa.array([dim], pa.int32()), "tile": pa.array([(task << 32) + made], pa.int64()),
                "ids": pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids),
                "matrix": pa.array([np.concatenate([p[1] for p in parts]).astype("<f8").tobytes()])})

        for whole in batches:
            for a in range(0, whole.num_rows, TILE):
                batch = whole.slice(a, TILE)
                vec = batch.column("vector")
                lengths = np.asarray(pc.fill_null(pc.list_value_length(vec), 0), dtype=np.int64)
                values = pc.list_flatten(vec)
                x = np.asarray(pc.fill_null(values, float("nan")), dtype=np.float64)
                at = np.concatenate([[0], np.cumsum(lengths)])
                with np.errstate(over="ignore", invalid="ignore"):
                    x = np.floor(scale * x)
                bad = np.concatenate([[0], np.cumsum(~np.isfinite(x))])
                good = (bad[at[1:]] == bad[at[:-1]]) & np.asarray(pc.is_valid(vec))
                for dim in np.unique(lengths[good]).tolist():
                    rows = np.flatnonzero(good & (lengths == dim))
                    part = x[(at[rows][:, None] + np.arange(dim))] if dim else np.zeros((len(rows), 0))
                    held.setdefault(dim, []).append((batch.column("id").take(pa.array(rows)), part))
                    if sum(len(p[0]) for p in held[dim]) >= TILE:
                        yield flush(dim)
        for dim in list(held):
            yield flush(dim)

    return vectors.mapInArrow(build, "dim int, tile bigint, ids array<bigint>, matrix binary")


def scores_of(q: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Exact inner products of integral rows."""
    if q.shape[1] * np.abs(q).max(initial=0) * np.abs(v).max(initial=0) < EXACT:
        return q @ v.T
    a, b = ([[int(x) for x in row] for row in m] for m in (q, v))
    out = np.empty((len(a), len(b)), object)
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            out[i, j] = min(max(sum(s * t for s, t in zip(x, y, strict=True)), LOW), HIGH)
    return out


def best(scores: np.ndarray, ids: np.ndarray, known: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best: score down, then id up, rows without an id last among ties."""
    if len(scores) > 4 * k and scores.dtype != object:
        near = np.flatnonzero(scores >= np.partition(scores, len(scores) - k)[len(scores) - k])
    else:
        near = np.arange(len(scores))
    order = sorted(near.tolist(), key=lambda i: (-scores[i], not known[i], ids[i]))
    return np.array(order[:k], dtype=np.int64)


def sent(top: dict[tuple[int, int], tuple]) -> Iterator[pa.RecordBatch]:
    """The lists of a tile's queries as one batch."""
    if not top:
        return
    sizes = [len(v[2]) for v in top.values()]
    ids = np.concatenate([v[3] for v in top.values()])
    known = np.concatenate([v[4] for v in top.values()])
    per = lambda values, kind: pa.array([x for x, n in zip(values, sizes, strict=True) for _ in range(n)], kind)
    yield pa.RecordBatch.from_pydict({
        "q_tile": per([t for t, _ in top], pa.int64()), "q_place": per([p for _, p in top], pa.int32()), "query_id": per([v[0] for v in top.values()], pa.int64()),
        "part": per([v[1] for v in top.values()], pa.int32()), "vec_id": pa.array(ids, pa.int64(), mask=~known),
        "score": pa.array([int(x) for v in top.values() for x in v[2]], pa.int64())})


def select(k: int):
    """Joined tiles (query tile, row tile) of a task to one running list per query."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        top: dict[tuple[int, int], tuple] = {}  # (tile, place) to (query id, slot, scores, ids, known)
        last = None
        for batch in batches:
            for r in range(batch.num_rows):
                dim, slot, tile = (batch.column(c)[r].as_py() for c in ("dim", "slot", "q_tile"))
                if (slot, tile) != last:  # a tile that comes again has two lists, which are merged as those of two slots
                    yield from sent(top)
                    top, last = {}, (slot, tile)
                side = lambda i, m, r=r, batch=batch, dim=dim: (
                    batch.column(i)[r].values, np.frombuffer(batch.column(m)[r].as_py(), "<f8").reshape(len(batch.column(i)[r].values), dim))
                (q_ids, q), (v_ids, v) = side("q_ids", "q_matrix"), side("ids", "matrix")
                known = np.asarray(pc.is_valid(v_ids))
                ids = np.asarray(pc.fill_null(v_ids, 0), dtype=np.int64)
                for a in range(0, len(q), 256):
                    s = scores_of(q[a : a + 256], v)
                    for i in range(len(s)):
                        me = q_ids[a + i].as_py()
                        other = np.flatnonzero((ids != me) | ~known)
                        row, row_ids, row_known = s[i][other], ids[other], known[other]
                        pick = best(row, row_ids, row_known, k)
                        row, row_ids, row_known = row[pick], row_ids[pick], row_known[pick]
                        if old := top.get((tile, a + i)):
                            row, row_ids, row_known = (np.concatenate([x, y]) for x, y in zip(old[2:], (row, row_ids, row_known), strict=True))
                            pick = best(row, row_ids, row_known, k)
                            row, row_ids, row_known = row[pick], row_ids[pick], row_known[pick]
                        top[tile, a + i] = (me, slot, row, row_ids, row_known)
        yield from sent(top)

    return run


def top_k(rows: DataFrame, queries: DataFrame, k: int = 10, vec_id: str = "vec_id", embedding: str = "embedding", scale: float = 1024.0) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k best rows."""
    spark = rows.sparkSession
    plain = lambda df: df.select(F.col(vec_id).cast("bigint").alias("id"), F.col(embedding).alias("vector"))
    slots = 4 * spark.sparkContext.defaultParallelism
    per_tile = -(-queries.count() // TILE) or 1
    asked = cut_lineage(tiles(plain(queries).repartition(per_tile), scale)).select(
        "dim", F.col("tile").alias("q_tile"), F.col("ids").alias("q_ids"), F.col("matrix").alias("q_matrix"),
        F.explode(F.sequence(F.lit(0), F.lit(slots - 1))).alias("slot"))
    dealt = tiles(plain(rows), scale).withColumn("slot", F.pmod(F.xxhash64("tile"), F.lit(slots)).cast("int"))
    # A merge join goes through its left side once, so the tiles of a slot come one after the other.
    lists = asked.hint("merge").join(dealt, ["dim", "slot"]).select("dim", "slot", "q_tile", "q_ids", "q_matrix", "ids", "matrix").mapInArrow(
        select(k), "q_tile bigint, q_place int, query_id bigint, part int, vec_id bigint, score bigint")
    order = [F.desc("score"), F.asc_nulls_last("vec_id")]
    while slots > FAN_IN:
        slots = -(-slots // FAN_IN)
        lists = lists.withColumn("part", F.floor(F.col("part") / FAN_IN).cast("int"))
        lists = lists.withColumn("_r", F.row_number().over(W.partitionBy("q_tile", "q_place", "part").orderBy(*order))).where(F.col("_r") <= k).drop("_r")
    ranked = lists.withColumn("rank", F.row_number().over(W.partitionBy("q_tile", "q_place").orderBy(*order))).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
