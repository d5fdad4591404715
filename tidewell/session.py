"""Session settings and the shared working folder."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark import SparkConf
from pyspark.sql import DataFrame, SparkSession


def build_session(app: str, master: str, shuffle_partitions: int, shared: str | None = None) -> SparkSession:
    """A session for tests and the benchmark; clusters bring their own. ``shared`` is used if no folder is set yet."""
    builder = SparkSession.builder
    if shared and SparkConf().get("spark.checkpoint.dir") is None:
        builder = builder.config("spark.checkpoint.dir", shared)
    return (
        builder.master(master)
        .appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.maxMetadataStringLength", "2000")  # else the filters of a scan are cut in the text of a plan
        .getOrCreate()
    )


def use_utc(spark: SparkSession) -> SparkSession:
    """Day, week and month keys are UTC calendar keys, whatever the host's zone is."""
    if spark.conf.get("spark.sql.session.timeZone") != "UTC":
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark


BATCH_BYTES = 4_000_000


def small_batches(spark: SparkSession) -> SparkSession:
    """Rows go to Python in batches of about BATCH_BYTES (the row that reaches it is the last), for all frames that run from here on.

    By default a batch has 10,000 rows, however long their texts, and both sides hold several copies of it.
    """
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach, as the cluster names it in spark.checkpoint.dir.

    Only a local session without that setting gets a temporary folder.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder all executors share")
    own = spark.sparkContext.getCheckpointDir()
    if own is None:
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="tidewell-"))
        own = spark.sparkContext.getCheckpointDir()
    return own.rstrip("/")


def run_dir(spark: SparkSession, label: str) -> str:
    """A fresh sub-folder name for one run, so that runs never meet."""
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


FREES_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def shuffles_freed(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of the frames written in here go as soon as each is written, not when the driver collects garbage.

    A stage that is retried meanwhile still finds or recomputes them; the session's own setting comes back afterwards.
    """
    before = spark.conf.get(FREES_SHUFFLES)
    spark.conf.set(FREES_SHUFFLES, "true")
    try:
        yield
    finally:
        spark.conf.set(FREES_SHUFFLES, before)


def written_once(df: DataFrame) -> DataFrame:
    """Compute a frame once for several readers and keep it in the shared checkpoint folder.

    Later stages read the files, so a lost executor costs no recomputation.
    """
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_dir(spark))
    return df.checkpoint()
