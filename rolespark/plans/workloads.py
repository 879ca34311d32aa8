"""Daily ingest and the way from the store to the digest."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rolespark.config import DEFAULT, Config
from rolespark.operators import digest, jobs, matching, scoring
from rolespark.storage import written


def prepare(dated: DataFrame, since: Column, history: DataFrame | None = None, excluded: DataFrame | None = None, employers: DataFrame | None = None, aliases: DataFrame | None = None, config: Config = DEFAULT) -> DataFrame:
    """Dated raw postings with a column seq, their order in the run, as rows for the upsert, written once. Duplicates go
    first: which row of an id stays does not depend on the rules, and what these and matching say of it only on the row."""
    single = jobs.dedup_batch(jobs.normalize_jobs(dated, config))
    batch = written(jobs.with_status(jobs.prefilter(single, since, history, excluded, config)), "batch")
    if employers is not None:
        kept = batch.filter("status <> 'excluded'")
        return written(matching.apply_lca(batch, matching.match_employer(kept, employers, aliases, config)), "matched")
    none = {"lca_filings": "int", "lca_relevant_soc": "int", "lca_match_name": "string", "lca_match_score": "double"}
    return batch.withColumns({c: F.lit(None).cast(t) for c, t in none.items()})


def ingest(raw: DataFrame, store: DataFrame, since: Column, as_of: Column, history: DataFrame | None = None, excluded: DataFrame | None = None, employers: DataFrame | None = None, aliases: DataFrame | None = None, config: Config = DEFAULT) -> tuple[DataFrame, DataFrame]:
    """(outcomes, new store) for raw postings with a column seq, the store being one table."""
    dated = jobs.resolve_undated(raw, store, as_of)
    return jobs.upsert_jobs(prepare(dated, since, history, excluded, employers, aliases, config), store, as_of)


def shortlist(store: DataFrame, query: list[float], as_of: Column, config: Config = DEFAULT) -> DataFrame:
    """The store after stale rows are expired and new ones are compared with the query vector."""
    live = jobs.expire_stale(store, as_of, config)
    fresh = F.when(F.col("status") == "new", scoring.similarity(F.col("embedding"), query)).otherwise(F.col("similarity"))
    return scoring.select_shortlist(live.withColumn("similarity", fresh), config)


def daily_digest(store: DataFrame, points: DataFrame, as_of: Column, config: Config = DEFAULT) -> tuple[DataFrame, DataFrame]:
    """(digest lines, store after marking). points: location and its points, from places.resolve_locations."""
    ranked = scoring.rank_update(store, config)
    selected = digest.select_digest(ranked, as_of, config)
    located = selected.join(points, "location", "left").withColumn("points", F.coalesce("points", F.array().cast("array<struct<lat:double,lon:double>>")))
    lines = digest.digest_lines(digest.collapse_locations(located, config), as_of, config)
    return lines, digest.mark_digested(ranked, selected, as_of)
