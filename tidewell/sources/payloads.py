"""Payload bodies from files: one body per line or per file, plain or gzip."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_bodies(
    spark: SparkSession,
    path: str,
    limit: int | None = None,
    whole_files: bool = False,
    streaming: bool = False,
) -> tuple[DataFrame, DataFrame]:
    """Bodies within the size limit (if one is given), and the rejected ones with their text and size.

    Compressed files (`.gz`) are decoded by the reader; the limit is on the decoded body.
    """
    reader = spark.readStream if streaming else spark.read
    bodies = (
        reader.format("text")
        .option("wholetext", str(whole_files).lower())
        .schema("value string")
        .load(path)
        .select(F.col("value").alias("body"), F.octet_length("value").alias("body_bytes"))
    )
    too_large = F.lit(False) if limit is None else F.col("body_bytes") > limit
    rejects = bodies.filter(too_large).withColumn("reason", F.lit("body over the size limit"))
    return bodies.filter(~too_large), rejects


def write_bodies(df: DataFrame, path: str, compression: str = "gzip") -> None:
    df.select("body").write.option("compression", compression).text(path)
