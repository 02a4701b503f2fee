"""Session settings the jobs rely on, and the shared scratch folder."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from contextlib import contextmanager

from pyspark import inheritable_thread_target
from pyspark.sql import Column, DataFrame, Observation, SparkSession

# Settings that results depend on; always set.
REQUIRED = {
    "spark.sql.session.timeZone": "UTC",
    # Times stored as INT96 carry no statistics, so a filter on share_date
    # could not skip row groups.
    "spark.sql.parquet.outputTimestampType": "TIMESTAMP_MICROS",
}

# Tuning; set only where the session has no value of its own.
TUNING = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Size of a written file before compression, and of a piece of a skewed
    # partition. Other shuffles keep their parallelism first.
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "128m",
    # A join whose smaller side turns out to fit in memory task by task is hashed
    # instead of sorting the shares.
    "spark.sql.adaptive.maxShuffledHashJoinLocalMapThreshold": "128m",
}

# Settings of a new session or of spark-submit.
STATIC = {
    # What `settle` stores is removed once nothing refers to it.
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    "spark.checkpoint.compress": "true",
}


def configure(spark: SparkSession) -> SparkSession:
    for key, value in REQUIRED.items():
        spark.conf.set(key, value)
    own = spark.conf.getAll
    for key, value in TUNING.items():
        if key not in own:
            spark.conf.set(key, value)
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach, as the cluster names it.

    Only a local session without the setting gets a folder of its own; on a
    cluster a machine-local folder would lose data with its machine.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    context = spark.sparkContext
    if not folder:
        folder = context.getCheckpointDir()
    if not folder:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        folder = tempfile.mkdtemp(prefix="sharelode-")
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(folder)
    return folder


def settle(df: DataFrame) -> DataFrame:
    """Store `df` in the shared folder and go on from the stored rows.

    Used for small derived sets that several later steps read: they are
    computed once and survive the loss of executors.
    """
    shared_dir(df.sparkSession)
    return df.checkpoint()


def counted(df: DataFrame, **aggregates: Column) -> tuple[DataFrame, dict]:
    """`settle`, with aggregates over the rows taken in the pass that stores them."""
    watch = Observation()
    settled = settle(df.observe(watch, *[value.alias(name) for name, value in aggregates.items()]))
    return settled, watch.get


@contextmanager
def staged(df: DataFrame, **aggregates: Column) -> Iterator[tuple[DataFrame, dict]]:
    """`df` as a columnar table in the shared folder, with aggregates taken as it is written.

    For rows that several jobs read in part. The table is removed at the end, also of
    a block that fails.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/stage-{uuid.uuid4().hex}"
    watch = Observation()
    try:
        df.observe(watch, *[value.alias(name) for name, value in aggregates.items()]).write.parquet(path)
        yield spark.read.schema(df.schema).parquet(path), watch.get
    finally:
        remove(spark, path)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder of the shared file system, if it is there."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def at_once(spark: SparkSession, *steps: Callable[[], object]) -> list:
    """Run steps that do not need each other side by side, each in a scheduler pool of its own.

    All have ended when this returns or raises what one of them has raised.
    """
    context = spark.sparkContext

    def run(number: int, step: Callable[[], object]) -> object:
        context.setLocalProperty("spark.scheduler.pool", f"step-{number}")
        return step()

    with ThreadPoolExecutor(len(steps)) as pool:
        started = [pool.submit(inheritable_thread_target(spark)(run), i, step) for i, step in enumerate(steps)]
    return [future.result() for future in started]
