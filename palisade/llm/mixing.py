"""Mixing sources to target weights by pivotal dependent rounding.

Every document of a source gets target / source size copies, a number from 0 to 3. The whole part is settled; the
fractional parts are rounded dependently: two documents move mass (probability times words) from one to the other,
at random and without changing either's expectation, until one of them is integral. Each move keeps the words of the pair,
so a group of documents ends with its exact share of words but for one document. The documents of a source are dealt into
groups of bounded size by a hash of the row; what is left of the groups is paired again, 64 groups at a time, until one
document a source is left and rounded. No group depends on the number of tasks, so reruns agree.

Nulls: a null text has size 0; a null source is a source of its own, the last one. Rows that are alike are told apart
only by which of them gets the copies. Documents of size 0 are taken 0 times. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palisade.llm.common import free_names, n_words, text_or_empty
from palisade.llm.tables import MARKS, told
from palisade.operators.ordered import global_order
from palisade.session import cut_lineage

GROUP = 4096
FAN_IN = 64
JOINED = 7  # copies that a table of small numbers does not hold
ROWS = "doc_id {kind}, source string, size bigint, source_size bigint, target double, key bigint, bucket bigint, copies int, open double"


def targets(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3), limit: float = 3.0) -> DataFrame:
    """(source, source_size) to (source, source_size, target).

    A target is min(limit * size, level * weight); the level that makes the targets sum to all sizes is where resharing the
    excess by weight ends. Each round is one aggregate over the sources, and caps at least one source more.
    """
    ordered = global_order(sizes.withColumn("_absent", F.col("source").isNull()), ["_absent", "source"])
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), F.pmod(F.col("index") - 1, F.lit(len(weights))).cast("int") + 1)
    table = cut_lineage(ordered.select("source", "source_size", weight.alias("weight")))
    top = limit * F.col("source_size")
    total, all_weights = table.agg(F.sum("source_size"), F.sum("weight")).first()
    total = total or 0
    level, capped = (total / all_weights if all_weights else 0.0), 0
    while True:
        over = top < level * F.col("weight")
        n, mass, rest = table.agg(
            F.coalesce(F.sum(over.cast("bigint")), F.lit(0)), F.coalesce(F.sum(F.when(over, top)), F.lit(0.0)),
            F.coalesce(F.sum(F.when(~over, F.col("weight"))), F.lit(0.0))).first()
        if n == capped or rest == 0:
            break
        level, capped = (total - mass) / rest, n
    return table.select("source", "source_size", F.least(top, level * F.col("weight")).alias("target"))


def _pair(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (source, bucket, …): settle all but at most one row of each bucket."""
    held: tuple | None = None  # (row, p, size), the one open row of the current bucket
    group: tuple | None = None
    for batch in batches:
        cols = {c: batch.column(c).to_pylist() for c in batch.schema.names}
        done: list[tuple] = []
        names = batch.schema.names
        rows = list(zip(*[cols[c] for c in names], strict=True))
        at = {c: i for i, c in enumerate(names)}
        for row in rows:
            here = (row[at["source"]], row[at["bucket"]])
            if here != group:
                if held:
                    done.append(_close(held[0], at, held[1]))
                held, group = None, here
            p, size = row[at["open"]], row[at["size"]]
            if p is None or not size:
                done.append(row[: at["open"]] + (None,))
                continue
            if held is None:
                held = (row, p, size)
                continue
            other, q, other_size = held
            up = min((1 - p) * size, q * other_size)  # words that may move to this row
            down = min(p * size, (1 - q) * other_size)
            u = _uniform(row[at["key"]], other[at["key"]])
            move = up if u * (up + down) < down else -down
            p, q = p + move / size, q - move / other_size
            # The bound that was reached makes one of the two integral; the comparison is by which one is nearer.
            if min(p, 1 - p) <= min(q, 1 - q):
                done.append(_settle(row, at, round(p)))
                held = (other, min(max(q, 0.0), 1.0), other_size)
            else:
                done.append(_settle(other, at, round(q)))
                held = (row, min(max(p, 0.0), 1.0), size)
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*done, strict=True), batch.schema.types, strict=True)], names)
        schema = batch.schema
    if held:
        yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(_close(held[0], at, held[1]), schema.types, strict=True)], schema.names)


def _settle(row: tuple, at: dict[str, int], extra: int) -> tuple:
    row = list(row)
    row[at["copies"]] += extra
    row[at["open"]] = None
    return tuple(row)


def _close(row: tuple, at: dict[str, int], p: float) -> tuple:
    """Keep the row open with what is left, unless that is nothing or one."""
    if p < 1e-9 or p > 1 - 1e-9:
        return _settle(row, at, round(p))
    row = list(row)
    row[at["open"]] = p
    return tuple(row)


def _uniform(a: int, b: int) -> float:
    """A number in [0, 1) from two row keys, by a 64-bit mixing step."""
    x = (a * 0x9E3779B97F4A7C15 + b * 0xC2B2AE3D27D4EB4F) & 0xFFFFFFFFFFFFFFFF
    x ^= x >> 29
    x = (x * 0xBF58476D1CE4E5B9) & 0xFFFFFFFFFFFFFFFF
    x ^= x >> 32
    return (x >> 11) / 2.0**53


def mix(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source",
        weights: tuple[int, ...] = (1, 2, 3), limit: float = 3.0, seed: int = 7) -> DataFrame:
    """One row per document: doc_id, source, size, source_size, target (its source's), copies, taken, and the row key.

    The text is read once; a few numbers a document are stored and dealt out.
    """
    base = cut_lineage(docs.select(
        F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), n_words(F.col(text)).alias("size"),
        F.xxhash64(F.lit(seed), F.col(doc_id), F.col(source), text_or_empty(text)).alias("key")))
    per_source = base.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("_docs"))
    aims = cut_lineage(targets(per_source.select("source", "source_size")).alias("t").join(
        per_source.select(F.col("source").alias("_s"), "_docs"), F.col("source").eqNullSafe(F.col("_s"))).drop("_s"))
    joined = base.join(aims.withColumnRenamed("source", "_s"), F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
    each = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    part = F.col("_each") - F.floor("_each")
    groups = F.floor((F.col("_docs") + GROUP - 1) / GROUP)
    kind = docs.schema[doc_id].dataType.simpleString()
    rows = joined.withColumn("_each", each).select(
        "doc_id", "source", "size", "source_size", "target", "key", F.pmod(F.col("key"), groups).cast("bigint").alias("bucket"),
        F.floor("_each").cast("int").alias("copies"), F.when((part > 1e-9) & (F.col("size") > 0), part).alias("open"))
    settled, left = [], rows
    last = base.groupBy().agg(F.count("*")).first()[0] // GROUP + 1  # no bucket number is larger
    while True:
        dealt = left.repartition("source", "bucket").sortWithinPartitions("source", "bucket", "key", "doc_id", "size", "open")
        paired = cut_lineage(dealt.mapInArrow(_pair, ROWS.format(kind=kind)))
        settled.append(paired.where(F.col("open").isNull()))
        left = paired.where(F.col("open").isNotNull()).withColumn("bucket", F.floor(F.col("bucket") / FAN_IN).cast("bigint"))
        if last == 0:
            break
        last //= FAN_IN
    up = F.pmod(F.xxhash64(F.col("key"), F.lit(seed)), F.lit(1 << 30)) < F.col("open") * float(1 << 30)
    out = left.withColumn("copies", F.col("copies") + up.cast("int"))
    for more in settled:
        out = out.unionByName(more)
    return out.select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).cast("bigint").alias("taken"), "key")


def mixed(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", seed: int = 7,
          entries: int = MARKS, **how) -> DataFrame:
    """The documents as often as the mix takes them, with the columns of ``docs``.

    A table of ``entries`` numbers tells most rows their copies where they are, by the row key. Only rows that share an entry with
    rows taken another number of times, and rows that are alike, meet their copies in a join; rows that are alike share the
    sum of their copies.
    """
    key, copies, alike, nth = free_names(docs, "key", "copies", "alike", "nth")
    taken = cut_lineage(mix(docs, doc_id, text, source, seed=seed, **how).groupBy(F.col("key").alias(key)).agg(
        F.sum("copies").alias(copies), F.count("*").alias(alike)))
    # The last value stands for what only the join can say.
    value = F.when((F.col(alike) > 1) | (F.col(copies) >= JOINED), F.lit(JOINED)).otherwise(F.col(copies).cast("int"))
    known = told(taken.select(F.col(key).alias("key"), value.alias("value")), entries)
    here = F.coalesce(known(F.col(key)), F.lit(JOINED))
    keyed = docs.withColumn(key, F.xxhash64(F.lit(seed), F.col(doc_id), F.col(source), text_or_empty(text)))
    one = keyed.withColumn(copies, here.cast("bigint")).where((F.col(copies) > 0) & (F.col(copies) < JOINED)).drop(key)
    open_ = cut_lineage(taken.where((F.col(copies) > 0) & (here == JOINED)))
    met = keyed.where(here == JOINED).join(open_, key)
    single = met
    if not open_.where(F.col(alike) > 1).isEmpty():
        single = met.where(F.col(alike) == 1).unionByName(met.where(F.col(alike) > 1).dropDuplicates([key]))
    one = one.unionByName(single.drop(key, alike))
    return one.withColumn(nth, F.explode(F.sequence(F.lit(1), F.col(copies).cast("int")))).select(*docs.columns)
