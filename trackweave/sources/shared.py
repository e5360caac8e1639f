"""The folder that driver and executors share, and tables kept in it."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; where none is set a local one, if the master is local, as in tests, else an error."""
    context = spark.sparkContext
    held = context.getCheckpointDir()
    if not held:
        held = spark.conf.get("spark.checkpoint.dir", "")
        if not held and not (context.master == "local" or context.master.startswith("local[")):
            raise ValueError("spark.checkpoint.dir is needed: a folder that driver and executors share")
        context.setCheckpointDir(held or f"file://{tempfile.mkdtemp(prefix='trackweave-')}")
        held = context.getCheckpointDir()
    return held.rstrip("/")


def new_folder(spark: SparkSession, name: str) -> str:
    """A folder of its own under the shared one, not made yet."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def settled(df: DataFrame) -> DataFrame:
    """Computed once and kept under spark.checkpoint.dir, so that neither the plan grows nor a lost executor takes it along."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def kept(df: DataFrame, name: str = "kept") -> DataFrame:
    """As settled, but a written table that is read again: for steps of a long loop, as a checkpoint's estimated size is carried on and grows with each join, while a table's is that of its files."""
    path = new_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)
