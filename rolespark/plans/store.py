"""The jobs store in buckets, and the daily run into it. Root holds four tables under one version: jobs (by id), seen (the
(source, ats_job_id) of every job that was ever stored, with its company and id, by source and ats_job_id), boards (every
(source, company) that was ever stored) and runs. A run reads and writes only the buckets that its batch meets, and all
four tables change in one commit or not at all."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rolespark.config import DEFAULT, Config
from rolespark.operators import jobs
from rolespark.operators.review import run_log
from rolespark.plans.workloads import prepare
from rolespark.schemas import JOB, RUNS
from rolespark.sources import versions
from rolespark.storage import shuffles_removed, written

SEEN = "source string, ats_job_id string, company string, id string"
BOARDS = "source string, company string"
KEYS = {"jobs": ["id"], "seen": ["source", "ats_job_id"], "boards": ["source", "company"], "runs": ["started_at"]}
SCHEMAS = {"jobs": JOB, "seen": SEEN, "boards": BOARDS, "runs": RUNS}


@dataclass(frozen=True)
class Run:
    """What one run did. read and rewritten: buckets of jobs; None for version: nothing was left to do."""

    version: versions.Version | None
    counts: dict[str, int]
    read: list[int]
    rewritten: list[int]


def table(spark: SparkSession, root: str, name: str, version: versions.Version | None = None) -> DataFrame:
    return versions.read(spark, root, version or versions.current(spark, root), name, SCHEMAS[name])


def sighted(spark: SparkSession, root: str, version: versions.Version, raw: DataFrame, buckets: int) -> tuple[DataFrame, DataFrame]:
    """seen and boards, of the buckets that raw meets."""
    return tuple(versions.read(spark, root, version, t, SCHEMAS[t], versions.touched(raw, KEYS[t], buckets)) for t in ("seen", "boards"))


def _unseen(rows: DataFrame, seen: DataFrame, boards: DataFrame) -> dict[str, DataFrame]:
    """Keys (SEEN columns) and boards of rows that seen and boards lack."""
    keyed = rows.filter("ats_job_id is not null").select("source", "ats_job_id", "company", "id").distinct()
    known = seen.withColumn("id", F.coalesce("id", F.lit("")))  # dated at first sight, but not stored as a job
    fresh = keyed.withColumn("id", F.coalesce("id", F.lit(""))).join(known, ["source", "ats_job_id", "company", "id"], "left_anti")
    return {"seen": fresh.withColumn("id", F.nullif("id", F.lit(""))), "boards": keyed.select("source", "company").distinct().join(boards, ["source", "company"], "left_anti")}


def _added(spark: SparkSession, root: str, version: versions.Version, rows: dict[str, DataFrame], buckets: int) -> dict[str, dict[str, list[str]]]:
    made = {}
    for name, some in rows.items():
        some = written(some, name)
        if not some.isEmpty():
            made[name] = versions.append(some, root, version, name, SCHEMAS[name], KEYS[name], buckets)
    return made


def ingest_into(spark: SparkSession, root: str, raw: DataFrame, since: Column, as_of: Column, history: DataFrame | None = None, excluded: DataFrame | None = None, employers: DataFrame | None = None, aliases: DataFrame | None = None, config: Config = DEFAULT, buckets: int = 64, window: str = "day", facts: dict[str, int] | None = None) -> Run:
    """Raw postings with a column seq into the store under root. buckets must stay what it was at the first run; choose it
    so that a bucket of jobs is some hundred MB. A run that finds every row stored writes no bucket of jobs.

    raw is read several times: write it first where it is costly. An id that is undated counts as known if it was ever stored, also where an update has since given its row another key."""
    with shuffles_removed(raw.sparkSession):
        return _ingest_into(spark, root, raw, since, as_of, history, excluded, employers, aliases, config, buckets, window, facts)


def _ingest_into(spark: SparkSession, root: str, raw: DataFrame, since: Column, as_of: Column, history: DataFrame | None, excluded: DataFrame | None, employers: DataFrame | None, aliases: DataFrame | None, config: Config, buckets: int, window: str, facts: dict[str, int] | None) -> Run:
    base = versions.current(spark, root)
    seen, boards = sighted(spark, root, base, raw, buckets)
    known = seen.select("source", "company", "ats_job_id").distinct()
    batch = prepare(jobs.date_at_first_sight(raw, known, boards, as_of), since, history, excluded, employers, aliases, config)
    # rows that the batch can meet: those of its ids, and those whose key it has
    met = batch.filter("ats_job_id is not null").select("source", "ats_job_id").distinct().join(seen, ["source", "ats_job_id"]).select("id").filter("id is not null")
    read = versions.touched(batch.select("id").unionByName(met), ["id"], buckets)
    stored = versions.read(spark, root, base, "jobs", JOB, read)
    decided, rows = jobs.upsert_rows(batch, stored, as_of)
    changed = written(rows.filter("changed"), "changed")
    rewritten = versions.touched(changed, ["id"], buckets)
    tables = {}
    if rewritten:
        left = rows.filter(~F.col("changed") & versions.bucket_of(["id"], buckets).isin(rewritten))
        mine = changed.unionByName(left).drop("changed")
        tables["jobs"] = base.tables.get("jobs", {}) | versions.write(mine, root, ["id"], buckets)
    tables |= _added(spark, root, base, _unseen(changed, seen, boards), buckets)
    counts = {k: int(v) for k, v in jobs.run_counts(decided).first().asDict().items()}
    sources = sorted(r[0] for r in raw.select("source").distinct().collect())
    log = run_log(spark.createDataFrame([], RUNS), counts, as_of, F.current_timestamp(), window, sources)
    tables["runs"] = versions.append(log, root, base, "runs", RUNS, KEYS["runs"], 1)
    return Run(versions.commit(spark, root, base, tables, facts), counts, read, rewritten)


def date_into(spark: SparkSession, root: str, raw: DataFrame, as_of: Column, save: Callable[[DataFrame], None], buckets: int = 64, facts: dict[str, int] | None = None) -> versions.Version:
    """Gives raw, dated at first sight, to save, then remembers its boards and ids under root."""
    base = versions.current(spark, root)
    raw = written(raw, "raw")
    seen, boards = sighted(spark, root, base, raw, buckets)
    save(jobs.date_at_first_sight(raw, seen.select("source", "company", "ats_job_id").distinct(), boards, as_of))
    strangers = raw.select("source", "ats_job_id", "company").distinct().join(seen.select("source", "ats_job_id", "company").distinct(), ["source", "ats_job_id", "company"], "left_anti")
    fresh = _unseen(strangers.withColumn("id", F.lit(None).cast("string")), seen, boards)
    return versions.commit(spark, root, base, _added(spark, root, base, fresh, buckets), facts)
