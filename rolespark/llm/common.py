"""What the operators of this package share: table access, shared scratch tables, small column helpers."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rolespark.storage import scratch_dir, written

#: White space between words: blank, tab, line feed, vertical tab, form feed, carriage return.
SPACE = r"[\x20\x09-\x0D]"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession, label: str) -> str:
    return f"{scratch_dir(spark)}/{label}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Writes df to the shared folder and reads it back: lineage ends here, so a lost executor costs no
    recomputation, and values that a task derived from its own place (ids, ranks) stay as they are."""
    return written(df, label, None)


def let(value: Column, body) -> Column:
    """body(value) with value computed once, however often body uses it, also inside lambdas."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def words_of(text: Column) -> Column:
    """Array of the words of a text (no word: empty array; null: null)."""
    return F.array_remove(F.split(text, SPACE + "+"), "")
