"""Postings: string rules, exclusion rules, dedup, upsert, boards."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rolespark.config import ATS_SOURCES, DEFAULT
from rolespark.functions import text as T
from rolespark.operators import boards, jobs, matching
from rolespark.queries import duck as D
from rolespark.queries import register
from rolespark.queries.adapters import AS_OF, SINCE, YEARS, frame, pick
from rolespark.sources import tables
from rolespark.storage import written

_ATS = "(" + ", ".join(f"'{s}'" for s in ATS_SOURCES) + ")"
_PRIORITY = f"CASE WHEN source IN {_ATS} THEN 1 ELSE 0 END"


def as_of():
    return F.expr(AS_OF)


def since():
    return F.expr(SINCE)


def raw(spark, sf_dir) -> DataFrame:
    return frame(spark, sf_dir, "SELECT * FROM @raw_jobs")


@register(f"SELECT seq, {D.norm_company('company')} AS company_norm, {D.norm_excluded('company')} AS excluded_norm, {D.norm_title('title')} AS title_norm, {D.norm_location('location')} AS location_norm FROM @raw_jobs")
def normalized_names(spark, sf_dir):
    c = F.col
    return raw(spark, sf_dir).select("seq", T.normalize_company(c("company")).alias("company_norm"), T.normalize_excluded(c("company")).alias("excluded_norm"), T.title_norm(c("title")).alias("title_norm"), T.location_norm(c("location")).alias("location_norm"))


_ID = f"sha1({D.norm_company('company')} || '|' || {D.norm_title('title')} || '|' || {D.norm_location('location')})"


@register(f"SELECT seq, {_ID} AS id, {_PRIORITY} AS priority, {_PRIORITY} > 0 AS beats_scraped FROM @raw_jobs")
def canonical_id(spark, sf_dir):
    c = F.col
    key = T.canonical_id(T.normalize_company(c("company")), c("title"), c("location"))
    return raw(spark, sf_dir).select("seq", key.alias("id"), T.source_priority(c("source")).alias("priority"), T.should_overwrite(F.lit("jobspy_indeed"), c("source")).alias("beats_scraped"))


@register(f"SELECT seq, {D.title_matches('title')} AS matches FROM @raw_jobs")
def title_matches(spark, sf_dir):
    return raw(spark, sf_dir).select("seq", T.title_matches(F.col("title")).alias("matches"))


@register(f"SELECT seq, coalesce({D.non_us('location')}, false) AS non_us, coalesce({D.us_signal('description_text')}, false) AS us_signal FROM @raw_jobs")
def us_signals(spark, sf_dir):
    return raw(spark, sf_dir).select("seq", F.coalesce(T.has_non_us_keyword(F.col("location")), F.lit(False)).alias("non_us"), T.has_us_signal(F.col("description_text")).alias("us_signal"))


_US, _REMOTE, _NYC = D.is_us("location", "description_text"), D.is_remote("location"), D.is_nyc("location")


@register(f"SELECT seq, {_US} AS is_us, {_REMOTE} AS is_remote, {_NYC} AS is_nyc_metro FROM @raw_jobs")
def parse_location(spark, sf_dir):
    found = T.parse_location(F.col("location"), F.col("description_text"))
    return raw(spark, sf_dir).select("seq", found.alias("p")).select("seq", "p.*")


_NORMAL = f"""SELECT seq, {_ID} AS id, source, ats_job_id, company, {D.norm_company("company")} AS company_norm, title, {D.norm_title("title")} AS title_norm, location, is_remote OR {_REMOTE} AS is_remote, {_US} AS is_us,
 {_NYC} AS is_nyc_metro, url, posted_at, description_text AS description, k FROM @raw_jobs"""


@register(_NORMAL)
def normalize_jobs(spark, sf_dir):
    return jobs.normalize_jobs(raw(spark, sf_dir))


_YEARS = "CASE k % 9 " + " ".join(f"WHEN {i} THEN {y}" for i, y in enumerate(YEARS) if y) + " END"
_BODY = "coalesce(description, '')"
_STAFFING = ", ".join(f"'{n}'" for n in DEFAULT.staffing_companies)
# titles of the history are equal to, or a word order away from, the posting's, or too far from it
_APPLIED = "(company_norm, array_to_string(list_sort(string_split(title_norm, ' ')), ' ')) IN (SELECT (company_norm, array_to_string(list_sort(string_split(title_norm, ' ')), ' ')) FROM @history)"
_REASON = f"""CASE WHEN {D.norm_excluded("company")} = 'acme' THEN 'excluded_company' WHEN NOT {D.any_of("title", DEFAULT.title_include)} THEN 'title_no_match' WHEN {D.any_of("title", DEFAULT.title_exclude)} THEN 'title_excluded'
 WHEN NOT is_us THEN 'not_us' WHEN posted_at IS NULL THEN 'no_posted_at' WHEN posted_at < {SINCE} THEN 'stale' WHEN company_norm IN ({_STAFFING}) THEN 'staffing_company'
 WHEN {D.any_of(_BODY, DEFAULT.staffing_patterns)} THEN 'staffing_description' WHEN {D.any_of(_BODY, DEFAULT.red_flags)} THEN 'red_flag_description' WHEN {_YEARS} > 4 THEN 'yoe_too_high' WHEN {_APPLIED} OR {{near}} THEN 'already_applied' END"""
_REASON = _REASON.format(near="(title_norm = 'ml engineer ads' AND (company_norm, 'ml engineer ad') IN (SELECT (company_norm, title_norm) FROM @history))")
_FILTERED = f"SELECT *, {_REASON} AS reason FROM ({_NORMAL})"


def _excluded(spark) -> DataFrame:
    return tables.excluded_names(spark.createDataFrame([("# none of these",), ("",), ("ACME Technology, Inc.",)], "value string"))


def filtered(spark, sf_dir) -> DataFrame:
    return jobs.prefilter(jobs.normalize_jobs(raw(spark, sf_dir)), since(), frame(spark, sf_dir, "SELECT * FROM @history"), _excluded(spark))


@register(f"SELECT seq, reason IS NULL AS keep, reason FROM ({_FILTERED})")
def prefilter(spark, sf_dir):
    return filtered(spark, sf_dir).select("seq", "keep", "reason")


@register(f"SELECT reason, count(*) AS n FROM ({_FILTERED}) WHERE reason IS NOT NULL GROUP BY reason")
def excluded_by_reason(spark, sf_dir):
    return filtered(spark, sf_dir).filter("not keep").groupBy("reason").agg(F.count("*").alias("n"))


@register(f"SELECT DISTINCT company_norm, title_norm FROM ({_NORMAL}) WHERE {_APPLIED} OR (title_norm = 'ml engineer ads' AND (company_norm, 'ml engineer ad') IN (SELECT (company_norm, title_norm) FROM @history))")
def already_applied(spark, sf_dir):
    return matching.already_applied(jobs.normalize_jobs(raw(spark, sf_dir)), frame(spark, sf_dir, "SELECT * FROM @history"))


_BATCH = f"SELECT * EXCLUDE (n, seq), first AS seq FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY {_PRIORITY} DESC, seq DESC) AS n, min(seq) OVER (PARTITION BY id) AS first FROM ({_FILTERED})) WHERE n = 1"


def batch(spark, sf_dir) -> DataFrame:
    """Written, as the queries on it also make the store of an earlier run of it."""
    return written(jobs.dedup_batch(jobs.with_status(filtered(spark, sf_dir))), "batch")


@register(f"SELECT id, source, seq, url FROM ({_BATCH})")
def dedup_batch(spark, sf_dir):
    return batch(spark, sf_dir).select("id", "source", "seq", "url")


# the store of an earlier run: some of the ids with another source, some of the keys under another id
_STORED = f"""SELECT id, CASE WHEN seq % 2 = 0 THEN 'jobspy_indeed' ELSE 'lever' END AS source, 'old' || CAST(seq AS STRING) AS ats_job_id FROM ({_BATCH}) WHERE seq % 3 = 0
 UNION ALL SELECT sha1(id) AS id, source, ats_job_id FROM ({_BATCH}) WHERE seq % 7 = 0 AND ats_job_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY source, ats_job_id ORDER BY seq) = 1"""
_OUTCOME = f"""WITH b AS MATERIALIZED ({_BATCH}), s AS (SELECT id, CASE WHEN seq % 2 = 0 THEN 'jobspy_indeed' ELSE 'lever' END AS stored FROM b WHERE seq % 3 = 0),
 keys AS (SELECT DISTINCT source, ats_job_id FROM b WHERE seq % 7 = 0 AND ats_job_id IS NOT NULL),
 w AS (SELECT b.*, stored, CASE WHEN keys.source IS NOT NULL THEN 'unchanged' WHEN stored IS NULL THEN 'inserted' WHEN b.source IN {_ATS} AND stored NOT IN {_ATS} THEN 'updated' ELSE 'unchanged' END AS would
   FROM b LEFT JOIN s ON b.id = s.id LEFT JOIN keys ON b.source = keys.source AND b.ats_job_id = keys.ats_job_id),
 o AS (SELECT *, CASE WHEN would <> 'unchanged' AND ats_job_id IS NOT NULL AND row_number() OVER (PARTITION BY source, ats_job_id, would <> 'unchanged' ORDER BY seq) > 1 THEN 'unchanged' ELSE would END AS outcome FROM w)"""


def stored(b: DataFrame) -> DataFrame:
    from pyspark.sql import Window

    from rolespark.schemas import JOB, conform

    by_id = b.filter("seq % 3 = 0").withColumns({"source": F.when(F.col("seq") % 2 == 0, "jobspy_indeed").otherwise("lever"), "ats_job_id": F.concat(F.lit("old"), F.col("seq").cast("string"))})
    n = F.row_number().over(Window.partitionBy("source", "ats_job_id").orderBy("seq"))
    by_key = b.filter("seq % 7 = 0 and ats_job_id is not null").withColumn("n", n).filter("n = 1").withColumn("id", F.sha1("id")).drop("n")
    return conform(by_id.unionByName(by_key), JOB)


@register(f"{_OUTCOME} SELECT id, source, ats_job_id, seq, outcome FROM o")
def upsert_outcomes(spark, sf_dir):
    b = batch(spark, sf_dir)
    return jobs.upsert_outcomes(b, stored(b)).select("id", "source", "ats_job_id", "seq", "outcome")


@register(
    f"""{_OUTCOME} SELECT id, source, url, description FROM o WHERE outcome = 'inserted' AND false UNION ALL
 SELECT id, source, url, CASE WHEN reason IS NULL THEN description END AS description FROM o WHERE outcome IN ('inserted', 'updated') UNION ALL
 SELECT b.id, CASE WHEN b.seq % 2 = 0 THEN 'jobspy_indeed' ELSE 'lever' END AS source, b.url, b.description FROM b JOIN o ON b.id = o.id WHERE b.seq % 3 = 0 AND o.outcome <> 'updated' UNION ALL
 SELECT sha1(id) AS id, source, url, description FROM (SELECT * FROM b WHERE seq % 7 = 0 AND ats_job_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY source, ats_job_id ORDER BY seq) = 1)"""
)
def upsert_jobs(spark, sf_dir):
    """The store after the upsert."""
    b = batch(spark, sf_dir)
    none = {"lca_filings": "int", "lca_relevant_soc": "int", "lca_match_name": "string", "lca_match_score": "double"}
    b = b.withColumns({c: F.lit(None).cast(t) for c, t in none.items()})
    return jobs.upsert_jobs(b, stored(b), as_of())[1].select("id", "source", "url", "description")


@register(
    f"""{_OUTCOME} SELECT count(*) AS fetched, count(*) FILTER (outcome = 'inserted') AS inserted, count(*) FILTER (outcome = 'updated') AS updated, count(*) FILTER (outcome = 'unchanged') AS unchanged,
 count(*) FILTER (reason IS NOT NULL) AS excluded FROM o"""
)
def run_counts(spark, sf_dir):
    b = batch(spark, sf_dir)
    return jobs.run_counts(jobs.upsert_outcomes(b, stored(b)))


_KNOWN = " UNION ALL ".join(f"SELECT '{s}' AS source" for s in (*ATS_SOURCES, "jobspy"))


@register(f"SELECT s.source, count(j.seq) AS jobs, max(posted_at) AS newest FROM ({_KNOWN}) s LEFT JOIN @raw_jobs j ON s.source = CASE WHEN starts_with(j.source, 'jobspy_') THEN 'jobspy' ELSE j.source END GROUP BY s.source")
def fetch_summary(spark, sf_dir):
    return jobs.fetch_summary(raw(spark, sf_dir))


_UNDATED = "SELECT seq, source, company, ats_job_id, seq % 2 = 0 AS undated, CASE WHEN seq % 10 = 0 THEN posted_at END AS posted_at FROM @raw_jobs"


@register(
    f"""WITH r AS ({_UNDATED}), s AS (SELECT DISTINCT source, company, ats_job_id FROM r WHERE seq % 3 = 0 AND ats_job_id IS NOT NULL)
 SELECT seq, coalesce(posted_at, CASE WHEN undated THEN CASE WHEN (source, company) IN (SELECT (source, company) FROM s) AND ats_job_id IS NOT NULL AND (source, company, ats_job_id) NOT IN (SELECT (source, company, ats_job_id) FROM s)
 THEN {AS_OF} ELSE TIMESTAMP '2000-01-01 00:00:00' END END) AS posted_at FROM r"""
)
def resolve_undated(spark, sf_dir):
    rows = frame(spark, sf_dir, _UNDATED)
    return jobs.resolve_undated(rows, rows.filter("seq % 3 = 0"), as_of()).select("seq", "posted_at")


@register("SELECT id, company_norm IN (SELECT lower(replace(c_name, '#', ' ')) FROM customer WHERE c_custkey % 4 = 0) AS cap_exempt, cap_exempt <> (company_norm IN (SELECT lower(replace(c_name, '#', ' ')) FROM customer WHERE c_custkey % 4 = 0)) AS changed FROM @store")
def sync_cap_exempt(spark, sf_dir):
    companies = frame(spark, sf_dir, "SELECT c_name || ', Inc.' AS name, c_custkey % 4 = 0 AS cap_exempt FROM @customer")
    return jobs.sync_cap_exempt(frame(spark, sf_dir, "SELECT * FROM @store"), companies).select("id", "cap_exempt", "changed")


_OLD = f"status IN ('new', 'shortlisted') AND (posted_at IS NULL OR posted_at < {AS_OF} - INTERVAL '14' DAY)"


@register(f"SELECT id, CASE WHEN {_OLD} THEN 'excluded' ELSE status END AS status, CASE WHEN {_OLD} THEN 'stale' ELSE exclude_reason END AS exclude_reason, CASE WHEN {_OLD} THEN NULL ELSE description END AS description FROM @store")
def expire_stale(spark, sf_dir):
    return jobs.expire_stale(frame(spark, sf_dir, "SELECT * FROM @store"), as_of()).select("id", "status", "exclude_reason", "description")


@register("SELECT 'jobs' AS table_name, count(*) AS n_rows FROM @store UNION ALL SELECT 'applied_history' AS table_name, count(*) AS n_rows FROM @history")
def table_counts(spark, sf_dir):
    return jobs.table_counts({"jobs": frame(spark, sf_dir, "SELECT * FROM @store"), "applied_history": frame(spark, sf_dir, "SELECT * FROM @history")})


_HOST, _SEG = r"regexp_extract(url, '^https://([^/]+)', 1)", r"nullif(regexp_extract(url, '^https://[^/]+/+([^/?]+)', 1), '')"
_PARSED = f"""SELECT k, company, title, CASE WHEN h IN ('boards.greenhouse.io', 'job-boards.greenhouse.io') AND s IS NOT NULL THEN 'greenhouse' WHEN h = 'jobs.lever.co' AND s IS NOT NULL THEN 'lever' WHEN h = 'careers.smartrecruiters.com' THEN 'smartrecruiters'
 WHEN h = 'jobs.ashbyhq.com' THEN 'ashby' WHEN h LIKE '%.myworkdayjobs.com' THEN 'workday' END AS ats, CASE WHEN h NOT LIKE '%.myworkdayjobs.com' AND h <> 'example.com' THEN s END AS slug, CASE WHEN h LIKE '%.myworkdayjobs.com' THEN h END AS host,
 CASE WHEN h LIKE '%.myworkdayjobs.com' THEN split_part(h, '.', 1) END AS tenant, CASE WHEN h LIKE '%.myworkdayjobs.com' THEN 'External' END AS board FROM (SELECT *, {_HOST} AS h, {_SEG} AS s FROM @boards)"""
_KEY = "CASE WHEN ats = 'workday' THEN 'workday|' || host || '|' || tenant || '|' || board ELSE ats || '|' || slug END"
_BLOCK = "ats || '|' || coalesce(slug, tenant)"


@register(f"SELECT k, ats, slug, host, tenant, board, {_KEY} AS key, {_BLOCK} AS block FROM ({_PARSED}) WHERE ats IS NOT NULL")
def parse_ats_url(spark, sf_dir):
    rows = frame(spark, sf_dir, "SELECT k, url FROM @boards").withColumn("ref", T.parse_ats_url(F.col("url"))).filter("ref is not null")
    return rows.select("k", "ref.*", T.ref_key(F.col("ref")).alias("key"), T.blocklist_key(F.col("ref")).alias("block"))


_TEST = r"regexp_matches(title, '(?i)^\d+$|test|sandbox|bug\s*bash|do\s*not\s*apply|ignore\s*this')"
_VALID = f"SELECT key, count(*) >= 3 AND avg(CASE WHEN {_TEST} THEN 1.0 ELSE 0.0 END) <= 0.3 AND block <> 'greenhouse|linkedin' AS valid FROM (SELECT title, {_KEY} AS key, {_BLOCK} AS block FROM ({_PARSED}) WHERE ats IS NOT NULL) GROUP BY key, block"


def valid_boards(spark, sf_dir) -> DataFrame:
    rows = frame(spark, sf_dir, "SELECT title, url FROM @boards").withColumn("ref", T.parse_ats_url(F.col("url"))).filter("ref is not null")
    return boards.validate_boards(rows.select(T.ref_key(F.col("ref")).alias("key"), T.blocklist_key(F.col("ref")).alias("block"), "title"))


@register(_VALID)
def validate_boards(spark, sf_dir):
    return valid_boards(spark, sf_dir)


def known_companies(spark, sf_dir) -> DataFrame:
    rows = frame(spark, sf_dir, "SELECT company AS name, url FROM @boards WHERE k % 10 = 1").withColumn("ref", T.parse_ats_url(F.col("url"))).filter("ref is not null")
    return rows.select("name", "ref.*")


@register(
    f"""WITH p AS (SELECT *, {_KEY} AS key FROM ({_PARSED}) WHERE ats IS NOT NULL)
 SELECT min(company) AS name, ats, slug, host, tenant, board, 'discovered' AS source FROM p WHERE {D.title_matches("title")} AND coalesce(slug, tenant) <> 'b7' AND key NOT IN (SELECT key FROM p WHERE k % 10 = 1)
 AND key IN (SELECT key FROM ({_VALID}) WHERE valid) GROUP BY key, ats, slug, host, tenant, board"""
)
def discover_boards(spark, sf_dir):
    excluded = spark.createDataFrame([("b7",)], "name string")
    found = boards.discover_boards(frame(spark, sf_dir, "SELECT company, title, url FROM @boards"), known_companies(spark, sf_dir), valid_boards(spark, sf_dir), excluded)
    return found.select("name", "ats", "slug", "host", "tenant", "board", "source")


@register(
    f"""WITH p AS (SELECT k, CASE WHEN ats IS NOT NULL THEN {_KEY} END AS key, lower(coalesce(slug, tenant)) AS slug FROM ({_PARSED})),
 s AS (SELECT k, key, CASE WHEN key IS NULL THEN 'no_ats_link' WHEN key IN (SELECT key FROM p WHERE k % 10 = 1 AND key IS NOT NULL) THEN 'already_present' WHEN slug = 'b7' THEN 'dropped' ELSE 'open' END AS state FROM p),
 a AS (SELECT key, min(k) AS first FROM s WHERE state = 'open' AND key IN (SELECT key FROM ({_VALID}) WHERE valid) GROUP BY key)
 SELECT CASE WHEN state IN ('no_ats_link', 'already_present') THEN state WHEN state = 'open' AND k = first THEN 'added' WHEN state = 'open' AND k > first THEN 'already_present' END AS outcome, count(*) AS n FROM s LEFT JOIN a USING (key) GROUP BY 1"""
)
def seed_from_comments(spark, sf_dir):
    """Counts by outcome. Each comment has a company of its own, so boards decide alone (tests hold the greedy acceptance by
    board and name against a loop)."""
    rows = frame(spark, sf_dir, "SELECT k, company, url FROM @boards")
    comments = rows.select(F.col("k").alias("pos"), F.concat(F.col("company"), F.lit(" | Remote | ML<p>Apply: <a href=&quot;"), F.col("url"), F.lit('&quot;>here</a> <a href="'), F.col("url"), F.lit('">x</a>')).alias("text"))
    found = boards.seed_from_comments(comments, known_companies(spark, sf_dir), valid_boards(spark, sf_dir), spark.createDataFrame([("b7",)], "name string"))
    return found.groupBy("outcome").agg(F.count("*").alias("n"))


@register("SELECT id, title, created_at FROM (SELECT event_id AS id, CASE WHEN event_type = 'view' THEN 'Ask HN: Who is hiring? ' || CAST(event_id AS STRING) ELSE 'Ask HN: other' END AS title, ts AS created_at FROM events) WHERE starts_with(title, 'Ask HN: Who is hiring?') ORDER BY created_at DESC, id LIMIT 6")
def recent_threads(spark, sf_dir):
    rows = frame(spark, sf_dir, "SELECT event_id AS id, CASE WHEN event_type = 'view' THEN 'Ask HN: Who is hiring? ' || CAST(event_id AS STRING) ELSE 'Ask HN: other' END AS title, ts AS created_at FROM @events")
    return boards.recent_threads(rows, 6)


@register("SELECT DISTINCT lower(replace(c_name, '#', ' ')) AS name FROM customer WHERE c_custkey % 3 <> 0")
def read_excluded(spark, sf_dir):
    return tables.excluded_names(frame(spark, sf_dir, "SELECT CASE WHEN c_custkey % 3 = 0 THEN '# ' || c_name ELSE '  The ' || c_name || ' Technologies, Inc. ' END AS value FROM @customer"))


_TRACKER = f"SELECT CASE WHEN c_custkey % 11 = 0 THEN NULL ELSE c_name || ' LLC' END AS company, {pick('c_custkey', 'Data Scientist', 'ML Engineer (Req 10422)', 'AI Engineer', None)} AS title, CASE WHEN c_custkey % 5 = 0 THEN 'soon' ELSE '2001-07-' || lpad(CAST(1 + c_custkey % 28 AS STRING), 2, '0') END AS applied FROM @customer"


@register(
    f"""WITH h AS (SELECT company_norm, title_norm FROM @history), t AS (SELECT {D.norm_company("company")} AS company_norm, {D.norm_title("title")} AS title_norm, TRY_CAST(applied AS DATE) AS applied_at FROM ({_TRACKER}) WHERE company IS NOT NULL AND title IS NOT NULL)
 SELECT company_norm, title_norm, NULL::DATE AS applied_at, 'store' AS source FROM h UNION ALL SELECT company_norm, title_norm, min(applied_at), 'tracker' FROM t WHERE (company_norm, title_norm) NOT IN (SELECT (company_norm, title_norm) FROM h) GROUP BY company_norm, title_norm"""
)
def import_tracker(spark, sf_dir):
    sheet = frame(spark, sf_dir, _TRACKER).toDF("Company Name", "Job Title", "Date of Application")
    history = frame(spark, sf_dir, "SELECT company_norm, title_norm, CAST(NULL AS DATE) AS applied_at, 'store' AS source FROM @history")
    return tables.import_tracker(sheet, history)
