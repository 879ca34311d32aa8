"""Postings: normalizing, the ordered exclusion rules, dedup and upsert into the store."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rolespark.config import ATS_SOURCES, DEFAULT, Config
from rolespark.functions import text as T
from rolespark.functions.helpers import min_years_required
from rolespark.functions.places import metro_group
from rolespark.operators.matching import already_applied
from rolespark.schemas import JOB, conform
from rolespark.storage import written

#: Date of postings that stood on an undated board when it was first seen.
BASELINE = datetime(2000, 1, 1)


def normalize_jobs(raw: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """Raw rows with the columns of a job. A column `points` (see places.with_points) lets distance decide about New York.
    Other columns pass through."""
    located = T.parse_location(F.col("location"), F.col("description_text"), config)
    if "points" in raw.columns:
        located = T.parse_location(F.col("location"), F.col("description_text"), config, metro_group(F.col("points"), config), F.size("points") > 0)
    out = raw.withColumns({"company_norm": T.normalize_company(F.col("company")), "_place": located, "title_norm": T.title_norm(F.col("title"))})
    key = F.concat_ws("|", "company_norm", "title_norm", T.location_norm(F.col("location")))
    return out.withColumns(
        {
            "id": F.sha1(key),
            "is_us": F.col("_place.is_us"),
            "is_remote": F.coalesce("is_remote", F.lit(False)) | F.col("_place.is_remote"),
            "is_nyc_metro": F.col("_place.is_nyc_metro"),
            "description": F.col("description_text"),
        }
    ).drop("_place", "description_text", "description_html", "undated")


def is_excluded_company(jobs: DataFrame, excluded: DataFrame, out: str = "is_excluded") -> DataFrame:
    """jobs with whether the normalized company is one of the excluded names (column name); whole names only."""
    names = excluded.select(F.col("name").alias("_name"), F.lit(True).alias("_hit")).distinct()
    own = T.without_technology(F.col("company_norm")) if "company_norm" in jobs.columns else T.normalize_excluded(F.col("company"))
    found = jobs.withColumn("_name", own).join(names, "_name", "left")
    return found.withColumn(out, F.coalesce("_hit", F.lit(False))).drop("_name", "_hit")


def prefilter(jobs: DataFrame, since: Column, history: DataFrame | None = None, excluded: DataFrame | None = None, config: Config = DEFAULT) -> DataFrame:
    """Adds keep and reason: the first rule that fails names the reason. since: the oldest allowed date. excluded: names
    (column name) as read_excluded gives them. With a history jobs are written once, as the names that they were given are
    read twice: for the rows, and for what the history has of them."""
    staffing = [" ".join(n.split()) for n in config.staffing_companies]
    body, title = F.coalesce("description", F.lit("")), F.coalesce("title", F.lit(""))
    out = jobs if history is None else written(jobs, "normalized")
    given = out
    if excluded is not None:
        # as a table its size is known to Spark, which need not deal out all jobs for a short list
        out = is_excluded_company(out, written(excluded.select("name").distinct(), "excluded"), "_excluded")
    else:
        out = out.withColumn("_excluded", F.lit(None).cast("boolean"))
    if history is not None:
        seen = already_applied(given, history, config.fuzzy_cutoff).withColumn("_applied", F.lit(True))
        out = out.join(seen, ["company_norm", "title_norm"], "left")
    else:
        out = out.withColumn("_applied", F.lit(None).cast("boolean"))
    rules = [
        ("excluded_company", F.col("_excluded")),
        ("title_no_match", ~T.title_included(title, config)),
        ("title_excluded", T.any_of(title, config.title_exclude)),
        ("not_us", ~F.coalesce("is_us", F.lit(False))),
        ("no_posted_at", F.col("posted_at").isNull()),
        ("stale", F.col("posted_at") < since),
        ("staffing_company", F.col("company_norm").isin(*staffing)),
        ("staffing_description", T.any_of(body, config.staffing_patterns)),
        ("red_flag_description", T.any_of(body, config.red_flags)),
    ]
    out = out.withColumn("_early", F.coalesce(*[F.when(failed, name) for name, failed in rules]))
    # only texts that speak of years, of rows that no earlier rule fails, go to the Python rule
    years = min_years_required(F.when(F.col("_early").isNull() & body.rlike("(?i)year"), body))
    reason = F.coalesce("_early", F.when(years > config.max_yoe, "yoe_too_high"), F.when(F.col("_applied"), "already_applied"))
    return out.withColumn("reason", reason).withColumn("keep", F.col("reason").isNull()).drop("_excluded", "_applied", "_early")


def with_status(filtered: DataFrame) -> DataFrame:
    return filtered.withColumns({"status": F.when(F.col("keep"), "new").otherwise("excluded"), "exclude_reason": F.col("reason")}).drop("keep", "reason")


def dedup_batch(jobs: DataFrame, order: str = "seq") -> DataFrame:
    """One row an id: the highest source priority, of these the latest in batch order; it takes the place of the first
    row with that id."""
    by_id = Window.partitionBy("id")
    best = by_id.orderBy(T.source_priority(F.col("source")).desc(), F.col(order).desc())
    ranked = jobs.withColumns({"_n": F.row_number().over(best), "_first": F.min(order).over(by_id)})
    return ranked.filter("_n = 1").withColumn(order, F.col("_first")).drop("_n", "_first")


def dedup_terms(postings: DataFrame, key: str | list[str], order: list[str]) -> DataFrame:
    """First row of each posting across search terms; rows without a key (of several columns: without the last) are dropped."""
    keys = [key] if isinstance(key, str) else key
    w = Window.partitionBy(*keys).orderBy(*order)
    return postings.filter(F.col(keys[-1]).isNotNull()).withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def resolve_undated(raw: DataFrame, store: DataFrame, as_of: Column) -> DataFrame:
    """Dates rows of boards without dates: ids not stored yet get as_of, all others, and boards never seen, the baseline."""
    known = store.filter("ats_job_id is not null").select("source", "company", "ats_job_id").distinct()
    return date_at_first_sight(raw, known, known.select("source", "company").distinct(), as_of)


def date_at_first_sight(raw: DataFrame, known: DataFrame, boards: DataFrame, as_of: Column) -> DataFrame:
    """resolve_undated with what is known as two tables: known (source, company, ats_job_id) and boards (source, company),
    each row once. Only rows that lack a date are joined with them; the others are not dealt out."""
    lacks = F.coalesce("undated", F.lit(False)) & F.col("posted_at").isNull()
    out = raw.filter(lacks).join(boards.withColumn("_board", F.lit(True)), ["source", "company"], "left").join(known.withColumn("_known", F.lit(True)), ["source", "company", "ats_job_id"], "left")
    fresh = F.col("_board").isNotNull() & F.col("_known").isNull() & F.col("ats_job_id").isNotNull()
    dated = F.when(fresh, as_of).otherwise(F.lit(BASELINE).cast("timestamp"))
    return raw.filter(~lacks).unionByName(out.withColumn("posted_at", dated).select(*raw.columns))


def upsert_outcomes(batch: DataFrame, store: DataFrame, order: str = "seq") -> DataFrame:
    """batch with outcome: unchanged if its (source, ats_job_id) is stored, inserted if its id is new, updated if a
    posting system's row meets a scraped one's id, else unchanged. Of several rows with one (source, ats_job_id) only the
    first that would write does."""
    keys = store.filter("ats_job_id is not null").select("source", "ats_job_id").distinct().withColumn("_key", F.lit(True))
    ids = store.select("id", F.col("source").alias("_stored")).dropDuplicates(["id"])
    # ids first: the turn is counted under the deal of the join by keys
    out = batch.join(ids, "id", "left").join(keys, ["source", "ats_job_id"], "left")
    would = (
        F.when(F.col("_key"), "unchanged")
        .when(F.col("_stored").isNull(), "inserted")
        .when(T.should_overwrite(F.col("_stored"), F.col("source")), "updated")
        .otherwise("unchanged")
    )
    writes = (F.col("_would") != "unchanged") & F.col("ats_job_id").isNotNull()
    turn = F.row_number().over(Window.partitionBy("source", "ats_job_id", writes).orderBy(order))
    out = out.withColumn("_would", would).withColumn("_turn", F.when(writes, turn).otherwise(1))
    return out.withColumn("outcome", F.when(F.col("_turn") == 1, F.col("_would")).otherwise("unchanged")).drop("_key", "_stored", "_would", "_turn")


def upsert_rows(batch: DataFrame, store: DataFrame, as_of: Column, order: str = "seq") -> tuple[DataFrame, DataFrame]:
    """(outcomes, rows of the new store with whether the upsert has changed or added them). An update changes source, url,
    description and ats_job_id only, so the status stays; rows that are stored already get filing columns they lack; an
    excluded row has no description. The outcomes are written once, as both results and the caller read them."""
    decided = upsert_outcomes(batch, store, order).withColumn("description", F.when(F.col("status") != "excluded", F.col("description")))
    decided = written(decided, "decided")
    change = decided.filter("outcome = 'updated'").select("id", *[F.col(c).alias(f"_{c}") for c in ("source", "url", "description", "ats_job_id")], F.lit(True).alias("_hit"))
    lca = ("lca_filings", "lca_relevant_soc", "lca_match_name", "lca_match_score")
    w = Window.partitionBy("source", "ats_job_id").orderBy(order)
    fill = decided.filter("ats_job_id is not null and lca_match_name is not null").withColumn("_n", F.row_number().over(w)).filter("_n = 1")
    fill = fill.select("source", "ats_job_id", *[F.col(c).alias(f"_{c}") for c in lca])
    kept = store.join(fill, ["source", "ats_job_id"], "left").join(change, "id", "left")
    late = F.col("lca_match_name").isNull() & F.col("_lca_match_name").isNotNull()
    changed = F.coalesce("_hit", F.lit(False)) | late
    values = {c: F.when(late, F.col(f"_{c}")).otherwise(F.col(c)) for c in lca}
    values |= {c: F.when(F.col("_hit"), F.col(f"_{c}")).otherwise(F.col(c)) for c in ("source", "url", "description", "ats_job_id")}
    values["updated_at"] = F.when(changed, as_of).otherwise(F.col("updated_at"))
    kept = kept.select(*[values.get(c, F.col(c)).alias(c) for c in store.columns], changed.alias("changed"))
    fresh = conform(decided.filter("outcome = 'inserted'").withColumns({"first_seen_at": as_of, "updated_at": as_of}), JOB)
    fresh = fresh.withColumns({"cap_exempt": F.coalesce("cap_exempt", F.lit(False)), "red_flags": F.coalesce("red_flags", F.array().cast("array<string>"))})
    flagged = f"{JOB}, changed boolean"
    return decided, conform(kept, flagged).unionByName(fresh.withColumn("changed", F.lit(True)))


def upsert_jobs(batch: DataFrame, store: DataFrame, as_of: Column, order: str = "seq") -> tuple[DataFrame, DataFrame]:
    """(outcomes, new store), see upsert_rows."""
    decided, rows = upsert_rows(batch, store, as_of, order)
    return decided, rows.drop("changed")


def run_counts(outcomes: DataFrame) -> DataFrame:
    named = {k: F.count_if(F.col("outcome") == k) for k in ("inserted", "updated", "unchanged")}
    return outcomes.agg(F.count("*").alias("fetched"), *[c.alias(k) for k, c in named.items()], F.count_if(F.col("status") == "excluded").alias("excluded"))


def fetch_summary(jobs: DataFrame, sources: tuple[str, ...] = ATS_SOURCES) -> DataFrame:
    """source, jobs, newest for every known source and for scraped rows together; unknown sources are left out."""
    listed = jobs.sparkSession.createDataFrame([(s,) for s in sources], "source string")
    name = F.when(F.col("source").startswith("jobspy_"), "jobspy").otherwise(F.col("source"))
    tally = jobs.groupBy(name.alias("source")).agg(F.count("*").alias("jobs"), F.max("posted_at").alias("newest"))
    found = listed.join(tally, "source", "left").select("source", F.coalesce("jobs", F.lit(0)).alias("jobs"), "newest")
    return found.unionByName(tally.filter("source = 'jobspy'"))


def sync_cap_exempt(store: DataFrame, companies: DataFrame) -> DataFrame:
    """The store with cap_exempt as the full company list says, and changed for the rows that it changes."""
    exempt = companies.filter("cap_exempt").select(T.normalize_company(F.col("name")).alias("company_norm")).distinct().withColumn("_exempt", F.lit(True))
    out = store.join(exempt, "company_norm", "left").withColumn("_now", F.coalesce("_exempt", F.lit(False)))
    changed = ~F.col("cap_exempt").eqNullSafe(F.col("_now"))
    return out.select(*[F.col("_now").alias(c) if c == "cap_exempt" else F.col(c) for c in store.columns], changed.alias("changed"))


def expire_stale(store: DataFrame, as_of: Column, config: Config = DEFAULT) -> DataFrame:
    """New and shortlisted rows without a date or past the age cap become excluded and lose their description."""
    old = F.col("posted_at").isNull() | (F.col("posted_at") < as_of - F.make_dt_interval(F.lit(config.max_age_days)))
    hit = F.col("status").isin("new", "shortlisted") & old
    values = {
        "status": F.when(hit, "excluded").otherwise(F.col("status")),
        "exclude_reason": F.when(hit, "stale").otherwise(F.col("exclude_reason")),
        "description": F.when(~hit, F.col("description")),
    }
    return store.select(*[values.get(c, F.col(c)).alias(c) for c in store.columns])


def table_counts(tables: dict[str, DataFrame]) -> DataFrame:
    out = None
    for name, df in tables.items():
        one = df.agg(F.count("*").alias("n_rows")).select(F.lit(name).alias("table_name"), "n_rows")
        out = one if out is None else out.unionByName(one)
    return out
