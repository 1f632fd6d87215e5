"""The stateless operators over a stream of sections, and exactly-once sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as t

from veristrata.functions import text as T


def watch(spark: SparkSession, path: str, schema: t.StructType, files_per_trigger: int = 16) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def cleaned(rows: DataFrame, text: str = "text") -> DataFrame:
    return rows.withColumn("clean", T.clean(F.col(text))).withColumn("line_count", T.full_lines(F.col("clean")))


def first_of_each(rows: DataFrame, key: str, at: str, late: str = "1 hour") -> DataFrame:
    """The first row of each key, with state kept for as long as rows may be late."""
    return rows.withWatermark(at, late).dropDuplicatesWithinWatermark([key])


def into(rows: DataFrame, path: str, checkpoint: str):
    """Write each batch once, in a folder named by its number, so a repeated batch replaces itself."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return rows.writeStream.option("checkpointLocation", checkpoint).foreachBatch(write)
