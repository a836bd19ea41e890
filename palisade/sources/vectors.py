"""The attack-vector dimension: numbered list of names with the detector that covers each."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

VECTOR_COUNT = 300

# Detector → vector numbers it covers (a-b is a range). All others are 'none'.
COVERAGE = {
    "D1": "41 46 89 127 140 142 148 186 284 287",
    "D2": "1",
    "D3": "6-8 11-13 22-25 31 32 51 62 131 132 144 208 236-238 262-265 299",
    "D4": "35-39 141 184 251 252 256 258",
    "D5": "49 52 54 55 63 74 76 82 83 135 138 146 174 239 249 289 291 292 300",
    "D6": "2-5",
    "D7": "10 14 50 64-66 80 137 187-190 206 207",
    "D8": "53 290 295",
    "D9": "15 19-21 81 139 150 298",
    "D10": "79",
    "D11": "16 17 42-44 47 78 136 143 180 181 230 294 297",
    "D12": "103 124 219-221 225 269",
    "D14": "56 58 59 129 177 178 282 286",
    "D15": "120 122 126 213",
    "D19": "77 288",
    "D23": "9 116 153 175 240 261",
    "D25": "48 145",
}


def coverage_sql(number: str = "id") -> str:
    """CASE expression number → detector, valid in Spark SQL and elsewhere."""
    arms = []
    for detector, spans in COVERAGE.items():
        tests = []
        for span in spans.split():
            lo, _, hi = span.partition("-")
            tests.append(f"{number} BETWEEN {lo} AND {hi or lo}")
        arms.append(f"WHEN {' OR '.join(tests)} THEN '{detector}'")
    return f"CASE {' '.join(arms)} ELSE 'none' END"


def vectors(spark: SparkSession, listing: str | None = None) -> DataFrame:
    """vectors(id, name, family). ``listing`` is a text file with lines ``<n>. <name>``."""
    ids = spark.range(1, VECTOR_COUNT + 1).select(F.col("id").cast("int"), F.expr(coverage_sql()).alias("family"))
    if listing is None:
        return ids.select("id", F.concat(F.lit("vector "), F.col("id").cast("string")).alias("name"), "family")
    item = r"^\s*([0-9]{1,3})[.] +(.+?)\s*$"
    names = (
        spark.read.text(listing)
        .where(F.col("value").rlike(item))
        .select(F.regexp_extract("value", item, 1).cast("int").alias("id"), F.regexp_extract("value", item, 2).alias("name"), )
        .groupBy("id").agg(F.max("name").alias("name"))
    )
    return ids.join(F.broadcast(names), "id", "left").select("id", "name", "family")
