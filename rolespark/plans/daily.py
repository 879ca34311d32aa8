"""One day's run: landed responses and scraped rows into the jobs store."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rolespark.config import DEFAULT, Config
from rolespark.functions.places import with_points
from rolespark.plans.store import Run, ingest_into
from rolespark.sources.payloads import map_all, map_jobspy
from rolespark.storage import shuffles_removed, written


def run_day(
    spark: SparkSession,
    root: str,
    landed: DataFrame,
    scraped: DataFrame | None,
    since: Column,
    as_of: Column,
    history: DataFrame | None = None,
    excluded: DataFrame | None = None,
    employers: DataFrame | None = None,
    aliases: DataFrame | None = None,
    gazetteer: DataFrame | None = None,
    states: dict[str, str] | None = None,
    config: Config = DEFAULT,
    buckets: int = 64,
) -> Run:
    """Maps the responses (see payloads.land) and scraped rows, resolves their places where there is a gazetteer, dates
    undated rows, filters, matches employers, and upserts all into the store under root in one commit.

    The order of the rows in the run, which decides between rows of one id and equal sources, is the order in which they
    were read; it is written down once, so a lost executor does not change it."""
    raw = map_all(landed, since, config)
    if scraped is not None:
        raw = raw.unionByName(map_jobspy(scraped, as_of))
    if gazetteer is not None:
        raw = with_points(raw, gazetteer, states or {})
    with shuffles_removed(spark):
        raw = written(raw.withColumn("seq", F.monotonically_increasing_id()), "day")
    return ingest_into(spark, root, raw, since, as_of, history, excluded, employers, aliases, config, buckets)
