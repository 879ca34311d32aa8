"""The batch jobs over a stream of landed files. State is the store under root (see plans.store): every micro-batch reads and
writes only the buckets that it meets and commits one version, which also remembers the batch's number, so a batch that is
delivered again is left out."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from rolespark.config import DEFAULT, Config
from rolespark.plans import store
from rolespark.schemas import RAW_JOB
from rolespark.sources import versions


def raw_stream(spark: SparkSession, path: str, fmt: str = "parquet", files_a_batch: int = 100) -> DataFrame:
    return spark.readStream.schema(f"{RAW_JOB}, seq long").format(fmt).option("maxFilesPerTrigger", files_a_batch).load(path)


def _run(stream: DataFrame, root: str, checkpoint: str, step: Callable[[DataFrame, int, dict[str, int]], None]) -> StreamingQuery:
    name = f"stream {hashlib.sha1(checkpoint.encode()).hexdigest()}"

    def once(batch: DataFrame, number: int) -> None:
        if versions.current(stream.sparkSession, root).facts.get(name, -1) < number:
            step(batch, number, {name: number})

    return stream.writeStream.foreachBatch(once).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def ingest_stream(spark: SparkSession, path: str, root: str, checkpoint: str, since: Column, as_of: Column, history: DataFrame | None = None, excluded: DataFrame | None = None, config: Config = DEFAULT, fmt: str = "parquet", files_a_batch: int = 100, buckets: int = 64) -> StreamingQuery:
    """Raw postings into the store; each micro-batch's outcomes are counted in the table runs."""

    def step(batch: DataFrame, number: int, facts: dict[str, int]) -> None:
        store.ingest_into(spark, root, batch, since, as_of, history, excluded, config=config, buckets=buckets, window=f"batch {number}", facts=facts)

    return _run(raw_stream(spark, path, fmt, files_a_batch), root, checkpoint, step)


def first_seen_stream(spark: SparkSession, path: str, root: str, checkpoint: str, out: str, as_of: Column, fmt: str = "parquet", files_a_batch: int = 100, buckets: int = 64) -> StreamingQuery:
    """Raw postings dated at first sight, to a folder of their own for each micro-batch. Known are the ids and boards under
    root, those of stored jobs and of the batches before."""

    def step(batch: DataFrame, number: int, facts: dict[str, int]) -> None:
        def save(dated: DataFrame) -> None:
            dated.write.mode("overwrite").parquet(f"{out}/batch={number}")

        store.date_into(spark, root, batch, as_of, save, buckets, facts)

    return _run(raw_stream(spark, path, fmt, files_a_batch), root, checkpoint, step)
