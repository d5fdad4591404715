"""Streams of queue messages: (message_id, arrival, value). `arrival` grows with the time a message came in."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MESSAGE = "message_id string, arrival bigint, value string"


def messages_from_files(spark: SparkSession, path: str, files_per_batch: int = 1) -> DataFrame:
    """Parquet files of messages, oldest file first; without a column `arrival` it is null."""
    return (
        spark.readStream.schema(MESSAGE).option("maxFilesPerTrigger", files_per_batch).parquet(path)
    )


def messages_from_kafka(spark: SparkSession, servers: str, topics: str, per_batch: int) -> DataFrame:
    """Kafka topics; needs the Kafka connector on the class path.

    The id names the record, not its content, so a record read twice keeps its id.
    """
    records = (
        spark.readStream.format("kafka")
        .option("kafka.bootstrap.servers", servers)
        .option("subscribe", topics)
        .option("maxOffsetsPerTrigger", per_batch)
        .load()
    )
    record = F.concat_ws("/", "topic", F.col("partition").cast("string"), F.col("offset").cast("string"))
    arrival = F.unix_micros("timestamp").alias("arrival")
    return records.select(record.alias("message_id"), arrival, F.col("value").cast("string").alias("value"))
