"""Scratch tables in the folder that the driver and all executors share."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def checkpoint_dir(spark: SparkSession) -> str:
    """The session's spark.checkpoint.dir; a local session without one gets a temporary folder. On a cluster the setting
    must be there, since executors do not see one another's folders."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir is unset: it must name a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="spark-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def scratch_dir(spark: SparkSession) -> str:
    """The application's own folder in the shared one, for tables that nothing needs after it."""
    return f"{checkpoint_dir(spark)}/scratch-{spark.sparkContext.applicationId}"


def written(df: DataFrame, label: str, codec: str | None = "zstd") -> DataFrame:
    """df written to the application's scratch folder and read again, so that its lineage ends here. codec: of the files;
    None: the session's."""
    path = f"{scratch_dir(df.sparkSession)}/{label}-{uuid.uuid4().hex}"
    (df.write.option("compression", codec) if codec else df.write).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """Each job that is run within removes its shuffle files as it ends, so those of a long chain of jobs do not lie on the
    disks together until the driver collects its garbage."""
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(_CLEANUP, before)


def remove_scratch(spark: SparkSession) -> None:
    """Removes the application's scratch folder. To be called when the results that were asked for are written: DataFrames
    read from scratch tables, and language models trained in it, cannot be used afterwards."""
    path = spark._jvm.org.apache.hadoop.fs.Path(scratch_dir(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
