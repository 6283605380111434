"""Raw message readers; all return ``RAW_MESSAGE`` columns, batch or streaming."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.schemas import DIMENSION_CHANGE, RAW_MESSAGE


def kafka(
    spark: SparkSession,
    servers: str,
    topic: str,
    streaming: bool = True,
    max_offsets_per_trigger: int | None = None,
) -> DataFrame:
    """Messages of a Kafka topic (needs Spark's Kafka connector on the class path)."""
    reader = spark.readStream if streaming else spark.read
    reader = (
        reader.format("kafka")
        .option("kafka.bootstrap.servers", servers)
        .option("subscribe", topic)
        .option("startingOffsets", "earliest")
    )
    if streaming and max_offsets_per_trigger:
        reader = reader.option("maxOffsetsPerTrigger", max_offsets_per_trigger)
    return reader.load().select(
        F.col("value").cast("string").alias("value"),
        "topic",
        "partition",
        "offset",
        F.col("timestamp").alias("arrived_at"),
    )


def landed(
    spark: SparkSession, path: str, streaming: bool = False, max_files_per_trigger: int | None = None
) -> DataFrame:
    """Messages landed as Parquet files with the ``RAW_MESSAGE`` columns."""
    reader = (spark.readStream if streaming else spark.read).schema(RAW_MESSAGE)
    if streaming and max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    return reader.parquet(path)


def json_lines(
    spark: SparkSession, path: str, topic: str, streaming: bool = False
) -> DataFrame:
    """Messages landed as text files, one JSON document per line.

    A line has no broker offset; it gets a stable one from its file and content, so only exact
    repeats of a line within one file share it. Its arrival is the file's modification time.
    """
    reader = spark.readStream if streaming else spark.read
    lines = reader.text(path).select("value", "_metadata")
    return lines.select(
        "value",
        F.lit(topic).alias("topic"),
        F.lit(0).alias("partition"),
        F.pmod(
            F.xxhash64("_metadata.file_path", "value"), F.lit((1 << 63) - 1)
        ).alias("offset"),
        F.col("_metadata.file_modification_time").alias("arrived_at"),
    )


def dimension_changes(spark: SparkSession, path: str, streaming: bool = False) -> DataFrame:
    """Dimension changes landed as Parquet files; feed them to ``dimension.replay``."""
    reader = spark.readStream if streaming else spark.read
    return reader.schema(DIMENSION_CHANGE).parquet(path)
