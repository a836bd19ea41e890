"""The findings report kept up to date from changes: a batch touches the groups that its rows belong to, and no others.

A change is a finding with a sign, +1 for one that came and -1 for one that went, and the side it is on, the current or the previous
scan. Sums per group are state tables partitioned by the hash of the group. A batch is folded in two steps: what changes (each group's sums
before and after) is written first, under the batch's number, then the parts of these groups are overwritten with the sums after. A
batch that is repeated after a failure finds its changes written and sets the same sums again.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from palisade.operators.windows import top_k
from palisade.session import cut_lineage

PARTS = 64


def _read(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame | None:
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" in str(e):
            return None
        raise


class Sums:
    """Sums per group in parts by the group's hash; groups whose sums are all 0 are gone."""

    def __init__(self, spark: SparkSession, path: str, keys: dict[str, str], sums: Sequence[str], parts: int = PARTS) -> None:
        self.spark, self.path, self.keys, self.sums, self.parts = spark, path, keys, list(sums), parts
        columns = ", ".join(f"{c} {t}" for c, t in keys.items())
        self.schema = T.StructType.fromDDL(f"{columns}, {', '.join(f'{s} bigint' for s in self.sums)}, mark boolean, part int")
        self.log = T.StructType.fromDDL(f"{columns}, {', '.join(f'before_{s} bigint, after_{s} bigint' for s in self.sums)}, part int")

    def _state(self, touched: list[int]) -> DataFrame:
        state = _read(self.spark, f"{self.path}/state", self.schema)
        state = self.spark.createDataFrame([], self.schema) if state is None else state
        return state.where(F.col("part").isin(touched) & ~F.col("mark")).drop("mark")

    def rows(self) -> DataFrame:
        state = _read(self.spark, f"{self.path}/state", self.schema)
        state = self.spark.createDataFrame([], self.schema) if state is None else state
        return state.where(~F.col("mark")).drop("mark", "part")

    def _touched(self, df: DataFrame) -> list[int]:
        return [r.part for r in df.select("part").distinct().collect()]  # at most ``parts`` numbers

    def changes(self, deltas: DataFrame, batch: int) -> DataFrame:
        """Written table (keys…, before and after of each sum, part) of the groups that the batch's deltas change."""
        path = f"{self.path}/changes/batch={batch}"
        if (done := _read(self.spark, path, self.log)) is not None:
            return done
        part = F.pmod(F.hash(*self.keys), F.lit(self.parts)).cast("int").alias("part")
        own = cut_lineage(deltas.groupBy(*self.keys).agg(*[F.sum(s).cast("bigint").alias(s) for s in self.sums]).select("*", part))
        zero = F.lit(0).cast("bigint")
        either = lambda df, old: df.select(
            *self.keys, "part", *[(F.col(s) if old else zero).alias(f"before_{s}") for s in self.sums],
            *[(zero if old else F.col(s)).alias(f"by_{s}") for s in self.sums], F.lit(not old).alias("given"))
        met = either(self._state(self._touched(own)), True).unionByName(either(own, False)).groupBy(*self.keys, "part").agg(
            *[F.sum(c).alias(c) for s in self.sums for c in (f"before_{s}", f"by_{s}")], F.max("given").alias("given"))
        moved = reduce(lambda a, b: a | b, [F.col(f"by_{s}") != 0 for s in self.sums])
        out = met.where(F.col("given") & moved).select(
            *self.keys, *[c for s in self.sums for c in (F.col(f"before_{s}"), (F.col(f"before_{s}") + F.col(f"by_{s}")).alias(f"after_{s}"))], "part")
        out.write.mode("overwrite").parquet(path)
        return _read(self.spark, path, self.log)

    def fold(self, deltas: DataFrame, batch: int) -> tuple[DataFrame, list[int]]:
        """The changes of a batch, applied, and the parts that hold them."""
        changes = self.changes(deltas, batch)
        touched = self._touched(changes)
        if not touched:
            return changes, touched
        state, named = self._state(touched), changes.select(*[F.col(k).alias(f"_{k}") for k in self.keys])
        same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in self.keys])
        kept = state.join(named, same, "left_anti")
        new = changes.select(*self.keys, *[F.col(f"after_{s}").alias(s) for s in self.sums], "part").where(
            reduce(lambda a, b: a | b, [F.col(f"after_{s}") != 0 for s in self.sums]))
        # A marked row stands in each part, so that a part whose last group went is overwritten, too.
        marks = self.spark.createDataFrame([(True, p) for p in touched], "mark boolean, part int")
        rows = kept.unionByName(new).withColumn("mark", F.lit(False)).unionByName(marks, allowMissingColumns=True)
        # Written apart first: the parts that are read are the ones that are overwritten.
        cut_lineage(rows).write.partitionBy("part").option("partitionOverwriteMode", "dynamic").mode("overwrite").parquet(f"{self.path}/state")
        return changes, touched


def status(current: Column, previous: Column) -> Column:
    """new, fixed or persisting; null for a finding that neither scan holds."""
    return F.when((current > 0) & (previous > 0), "persisting").when(current > 0, "new").when(previous > 0, "fixed")


class KeptReport:
    """Signal counts, the most exposed files and what is new, fixed or persisting, kept below a folder."""

    def __init__(self, spark: SparkSession, base: str, k: int = 3, parts: int = PARTS) -> None:
        self.spark, self.base, self.k = spark, base, k
        self.counts = Sums(spark, f"{base}/counts", {"detector": "string", "rule_id": "string", "severity": "int"}, ["n"], parts)
        self.files = Sums(spark, f"{base}/files", {"repo": "string", "path": "string"}, ["score", "n"], parts)
        self.prints = Sums(spark, f"{base}/prints", {"fingerprint": "string"}, ["current", "previous"], parts)
        self.statuses = Sums(spark, f"{base}/statuses", {"status": "string"}, ["n"], 1)
        self.best_schema = T.StructType.fromDDL("repo string, path string, score bigint, part int")

    def fold(self, batch: DataFrame, number: int) -> None:
        """One batch of (findings…, side, sign)."""
        batch = cut_lineage(batch.select("detector", "rule_id", F.col("severity").cast("int").alias("severity"), "repo", "path", "fingerprint", "side", F.col("sign").cast("bigint").alias("sign")))
        now = batch.where("side = 'current'")
        self.counts.fold(now.withColumn("n", F.col("sign")), number)
        _, touched = self.files.fold(now.select("repo", "path", (F.col("severity") * F.col("sign")).alias("score"), F.col("sign").alias("n")), number)
        if touched:
            # The best of a part decide what of it can be among the best of all.
            state = self.files._state(touched).withColumn("_k", F.struct("part", "repo"))
            best = top_k(state, "_k", [F.desc("score"), F.asc("path")], self.k).select("repo", "path", "score", "part")
            marks = self.spark.createDataFrame([(p,) for p in touched], "part int")
            rows = best.unionByName(marks, allowMissingColumns=True)
            rows.write.partitionBy("part").option("partitionOverwriteMode", "dynamic").mode("overwrite").parquet(f"{self.base}/best")
        one = lambda side: F.when(F.col("side") == side, F.col("sign")).otherwise(F.lit(0)).alias(side)
        changes, _ = self.prints.fold(batch.select("fingerprint", one("current"), one("previous")), number)
        before, after = (status(F.col(f"{when}_current"), F.col(f"{when}_previous")) for when in ("before", "after"))
        moved = changes.where(~before.eqNullSafe(after)).select(F.inline(F.array(
            F.struct(before.alias("status"), F.lit(-1).cast("bigint").alias("n")), F.struct(after.alias("status"), F.lit(1).cast("bigint").alias("n")))))
        self.statuses.fold(moved.where(F.col("status").isNotNull()), number)

    def run(self, changes: DataFrame) -> None:
        """Fold what a stream of changes has to offer; goes on from the folder's checkpoint."""
        changes.writeStream.trigger(availableNow=True).option("checkpointLocation", f"{self.base}/checkpoint").foreachBatch(self.fold).start().awaitTermination()

    def report(self) -> DataFrame:
        """(section, item, detail, n), read from the sums alone."""
        row = lambda df, section, item, detail, n: df.select(
            F.lit(section).alias("section"), item.cast("string").alias("item"), detail.cast("string").alias("detail"), n.cast("bigint").alias("n"))
        counts = self.counts.rows()
        signals = counts.rollup("detector", "rule_id").agg(F.sum("n").alias("n")).where(F.col("n") > 0)
        severity = counts.groupBy("severity").agg(F.sum("n").alias("n"))
        best = _read(self.spark, f"{self.base}/best", self.best_schema)
        best = self.spark.createDataFrame([], self.best_schema) if best is None else best
        worst = top_k(best.where(F.col("score").isNotNull()), "repo", [F.desc("score"), F.asc("path")], self.k)
        return reduce(lambda a, b: a.unionByName(b), [
            row(signals, "signals", F.coalesce("detector", F.lit("all")), F.coalesce("rule_id", F.lit("all")), F.col("n")),
            row(severity, "severity", F.col("severity"), F.lit(""), F.col("n")),
            row(worst, "top files", F.col("repo"), F.concat(F.col("place").cast("string"), F.lit(" "), F.col("path")), F.col("score")),
            row(self.statuses.rows(), "delta", F.col("status"), F.lit(""), F.col("n"))])
