"""Checkpoints in the folder that the cluster names."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``, which all executors share; a temporary one only where it is unset and Spark is local."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir isn't set: executors need a folder that they share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="weftline-checkpoint-"))
        named = spark.sparkContext.getCheckpointDir()
    return named


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` in the folder that all executors share."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


#: Whether a job's shuffle files are removed as soon as it is done, and not when the driver happens to collect garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def setting(spark: SparkSession, key: str, value: str) -> Iterator[None]:
    """A setting of the session, for what is planned inside."""
    before = spark.conf.get(key, None)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def cleaned(spark: SparkSession):
    """Jobs of frames that are made inside leave no shuffle files."""
    return setting(spark, CLEANUP, "true")


def table_path(spark: SparkSession) -> str:
    """A new table's path in the folder that all executors share."""
    return f"{shared_folder(spark)}/table-{uuid.uuid4().hex}"


def stored(df: DataFrame, path: str | None = None) -> DataFrame:
    """``df`` as compressed columns in the folder that all executors share, without the shuffle files that it was made from.

    For tables that grow with the values: a checkpoint holds rows as they are, and leaves the shuffle files beside them. What
    is at a given ``path`` is replaced; ``df`` must not read it.
    """
    spark = df.sparkSession
    path = path or table_path(spark)
    with cleaned(spark):
        df.select("*").write.mode("overwrite").parquet(path)
    return spark.read.schema(df.schema).parquet(path)
