"""Entity collections, request bodies and seeded tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palisade.functions.coerce import JsonBody
from palisade.operators.ordered import global_order
from palisade.schemas import ENTITIES


def read_entities(spark: SparkSession, path: str, entity: str, fmt: str = "parquet") -> DataFrame:
    """Read a collection with its fixed schema (no inference pass)."""
    return spark.read.schema(ENTITIES[entity]).format(fmt).load(path)


def conform(df: DataFrame, entity: str) -> DataFrame:
    """Cast a DataFrame to an entity's schema; missing columns become NULL."""
    schema = ENTITIES[entity]
    return df.select(
        *[
            (F.col(f.name).try_cast(f.dataType) if f.name in df.columns else F.lit(None).cast(f.dataType)).alias(f.name)
            for f in schema.fields
        ]
    )


def read_requests(df: DataFrame, body_col: str = "body") -> DataFrame:
    """Parse JSON bodies: malformed text becomes status 400, never a failure."""
    parsed, body = JsonBody.prepared(df, body_col)
    return parsed.select(
        *df.columns,
        F.col("_fields").alias("body_fields"),
        F.when(body.valid(), body.keys()).alias("body_keys"),
        F.when(body.valid(), 200).otherwise(400).alias("parse_status"),
        F.when(~body.valid(), F.lit("Invalid JSON")).alias("parse_error"),
    )


def read_json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON files with a column that keeps the text of malformed lines."""
    return (
        spark.read.schema(schema + ", _corrupt_record STRING")
        .option("mode", "PERMISSIVE")
        .option("columnNameOfCorruptRecord", "_corrupt_record")
        .json(path)
    )


def seed(rows: DataFrame, order: list[str], name: str, table: bool = False) -> DataFrame:
    """Create or replace a table with auto-increment ids (1, 2, … along ``order``)."""
    out = global_order(rows, order).select(F.col("index").alias("id"), *rows.columns)
    if table:
        out.write.mode("overwrite").saveAsTable(name)
        return rows.sparkSession.table(name)
    out.createOrReplaceTempView(name)
    return rows.sparkSession.table(name)
