"""File streams of events or triggers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from palisade.schemas import EVENTS


def read_stream(
    spark: SparkSession, path: str, schema: StructType = EVENTS, glob: str | None = None, files_per_trigger: int = 1000
) -> DataFrame:
    """Parquet files of a folder as a stream; ``ts`` becomes an instant for watermarks."""
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    df = reader.parquet(path)
    return df.withColumn("ts", F.col("ts").cast("timestamp")) if "ts" in df.columns else df
