"""What is written to files and read again: filings, companies, aliases, employers, the tracker, the run log, and streams.
The files lie in new folders below the session's shared folder."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rolespark import schemas
from rolespark.functions import dates
from rolespark.operators import filings, matching, review
from rolespark.plans import store
from rolespark.queries import postings, register
from rolespark.queries.adapters import frame
from rolespark.queries.duck import norm_company
from rolespark.queries.filings import EMPLOYERS, _flat, lca
from rolespark.sources import tables, versions
from rolespark.storage import checkpoint_dir
from rolespark.streaming.ingest import first_seen_stream as seen_stream
from rolespark.streaming.ingest import ingest_stream as jobs_stream


def folder(spark: SparkSession, label: str) -> str:
    return f"{checkpoint_dir(spark)}/{label}-{uuid.uuid4().hex}"


_KEPT = ", ".join(c for c in schemas.LCA_COLUMNS if c not in ("TOTAL_WORKER_POSITIONS", "DECISION_DATE", "WORKSITE_STATE"))
# a CSV file has no empty cells besides nulls
_STATE = "CASE WHEN WORKSITE_STATE <> '' OR CASE_STATUS NOT IN ('Certified', 'Withdrawn') THEN WORKSITE_STATE END AS WORKSITE_STATE"


@register(
    f"""SELECT {_KEPT}, {_STATE}, CASE WHEN CASE_NUMBER NOT LIKE '%-2' THEN TOTAL_WORKER_POSITIONS END AS TOTAL_WORKER_POSITIONS,
 CASE WHEN CASE_NUMBER NOT LIKE '%-3' THEN CAST(DECISION_DATE AS DATE) END AS DECISION_DATE, true AS named, 2 AS n_refused FROM @lca_raw"""
)
def read_lca(spark, sf_dir):
    """CSV files of two column orders and a Parquet file with columns of its own, with bad numbers and dates. n_refused:
    how many files the error names when one of each kind lacks a column."""
    c = F.col
    raw = lca(spark, sf_dir).withColumns(
        {
            "TOTAL_WORKER_POSITIONS": F.when(c("CASE_NUMBER").endswith("-2"), "n/a").otherwise(c("TOTAL_WORKER_POSITIONS").cast("string")),
            "DECISION_DATE": F.when(c("CASE_NUMBER").endswith("-3"), "soon").otherwise(c("DECISION_DATE").cast("string")),
            "WAGE_RATE_OF_PAY_FROM": c("WAGE_RATE_OF_PAY_FROM").cast("string"),
        }
    )
    path, columns = folder(spark, "lca"), list(schemas.LCA_COLUMNS)
    as_csv = {"header": True, "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}
    raw.filter("CASE_STATUS = 'Certified'").select(*reversed(columns)).write.options(**as_csv).csv(f"{path}/certified")
    raw.filter("CASE_STATUS = 'Withdrawn'").select("source_file", *columns[3:], *columns[:3]).write.options(**as_csv).csv(f"{path}/withdrawn")
    raw.filter("CASE_STATUS not in ('Certified', 'Withdrawn')").select("source_file", *columns).write.parquet(f"{path}/others")
    lacking = raw.limit(1).coalesce(1)
    lacking.drop("VISA_CLASS").write.parquet(f"{path}/lacking/a")
    lacking.drop("SOC_CODE").write.options(**as_csv).csv(f"{path}/lacking/b")
    try:
        tables.read_lca(spark, [path])
        refused = 0
    except ValueError as e:
        refused = str(e).count("/lacking/")
    read = tables.read_lca(spark, [f"{path}/certified", f"{path}/withdrawn", f"{path}/others"])
    named = F.col("source_file").endswith(".parquet") | F.col("source_file").endswith(".csv")
    return read.withColumns({"DECISION_DATE": F.to_date("DECISION_DATE"), "named": named, "n_refused": F.lit(refused)}).drop("source_file")


_COMPANIES = """SELECT c_name AS name, 'lever' AS ats, CASE WHEN c_custkey % 3 = 0 THEN 'seed' END AS source, CASE WHEN c_custkey % 4 = 0 THEN true END AS cap_exempt,
 'b' || CAST(c_custkey AS STRING) AS slug FROM @customer"""


@register(f"SELECT name, ats, coalesce(source, 'manual') AS source, coalesce(cap_exempt, false) AS cap_exempt, slug FROM ({_COMPANIES})")
def read_companies(spark, sf_dir):
    path = folder(spark, "companies")
    schemas.conform(frame(spark, sf_dir, _COMPANIES), schemas.COMPANY).write.option("header", True).csv(path)
    return tables.read_companies(spark, path, fmt="csv").select("name", "ats", "source", "cap_exempt", "slug")


@register(
    f"""SELECT {norm_company("'The ' || s_name")} AS alias_norm, {norm_company("s_name || ' LLC'")} AS target_norm, 0 AS pos FROM @supplier
 UNION ALL SELECT {norm_company("'The ' || s_name")} AS alias_norm, {norm_company("s_name || ' & Sons'")} AS target_norm, 1 AS pos FROM @supplier WHERE s_suppkey % 2 = 0"""
)
def read_aliases(spark, sf_dir):
    """Lines with a list of names, and with one name."""
    path = folder(spark, "aliases")
    many = """'["' || s_name || ' LLC", "' || s_name || ' & Sons"]'"""
    one = """'"' || s_name || ' LLC"'"""
    line = f"""'{{"alias": "The ' || s_name || '", "targets": ' || CASE WHEN s_suppkey % 2 = 0 THEN {many} ELSE {one} END || '}}'"""
    frame(spark, sf_dir, f"SELECT {line} AS value FROM @supplier").write.text(path)
    return tables.read_aliases(spark, path)


@register(EMPLOYERS)
def write_employers(spark, sf_dir):
    """The second of two snapshots, the first of another table."""
    root = folder(spark, "employers")
    employers = filings.employer_history(lca(spark, sf_dir))
    tables.write_employers(employers.limit(0), root)
    tables.write_employers(employers, root)
    return _flat(tables.read_snapshot(spark, root))


_MATCHES = "SELECT lower(replace(c_name, '#', ' ')) AS company_norm, c_custkey % 90 AS filings_total, c_custkey % 7 AS filings_relevant_soc, c_name AS lca_match_name, 100.0 AS lca_match_score FROM @customer WHERE c_custkey % 3 <> 0"


@register(
    f"""SELECT s.id, CASE WHEN s.status <> 'excluded' THEN m.filings_total END AS lca_filings, CASE WHEN s.status <> 'excluded' THEN m.filings_relevant_soc END AS lca_relevant_soc,
 CASE WHEN s.status <> 'excluded' THEN m.lca_match_name END AS lca_match_name, CASE WHEN s.status <> 'excluded' THEN CAST(m.lca_match_score AS DOUBLE) END AS lca_match_score
 FROM @store s LEFT JOIN ({_MATCHES}) m ON s.company_norm = m.company_norm"""
)
def apply_lca(spark, sf_dir):
    """No match is null, never 0; a match with no filings is 0."""
    matches = frame(spark, sf_dir, _MATCHES).withColumn("lca_match_score", F.col("lca_match_score").cast("double"))
    done = matching.apply_lca(frame(spark, sf_dir, "SELECT * FROM @store"), matches)
    return done.select("id", F.col("lca_filings").cast("long"), F.col("lca_relevant_soc").cast("long"), "lca_match_name", "lca_match_score")


_HEAD = ("Company Name", "Job Title", "Years of Exp required", "Sponsorship Status", "Date of Application", "One-line summary of the role", "LCA filings (FY25 to FY26)", "Relevant SOC filings")
_CELLS = ("company", "title", "coalesce(CAST(yoe_min AS VARCHAR), yoe_text)", "coalesce(sponsorship_jd, 'Not Mentioned')", "applied_at", "summary", "lca_filings", "lca_relevant_soc")
_LINE = " || ' | ' || ".join(f"replace(coalesce(CAST({x} AS VARCHAR), ''), '|', '/')" for x in _CELLS)


@register(f"SELECT '| {' | '.join(_HEAD)} |' AS line UNION ALL SELECT '|{'---|' * len(_HEAD)}' AS line UNION ALL SELECT '| ' || {_LINE} || ' |' AS line FROM @store WHERE status = 'applied'")
def write_tracker(spark, sf_dir):
    """The lines of the written table."""
    path = folder(spark, "tracker")
    review.write_tracker(frame(spark, sf_dir, "SELECT * FROM @store"), path)
    return spark.read.text(f"{path}/table").withColumnRenamed("value", "line")


@register("SELECT 'ok' AS status, 'day' AS \"window\", source, count(*) AS n FROM @raw_jobs GROUP BY source")
def run_log(spark, sf_dir):
    """A run's counts by source, appended, written and read again."""
    root = folder(spark, "runs")
    counts = {r.source: r.n for r in frame(spark, sf_dir, "SELECT source, count(*) AS n FROM @raw_jobs GROUP BY source").collect()}
    log = review.run_log(spark.createDataFrame([], schemas.RUNS), counts, postings.as_of(), postings.as_of(), "day", sorted(counts))
    base = versions.current(spark, root)
    versions.commit(spark, root, base, {"runs": versions.append(log, root, base, "runs", schemas.RUNS, ["started_at"], 1)})
    return versions.read(spark, root, versions.current(spark, root), "runs", schemas.RUNS).select("status", "window", F.explode("counts").alias("source", "n"))


def landed(spark: SparkSession, rows: DataFrame) -> str:
    """Raw postings as files of a stream."""
    path = folder(spark, "landed")
    schemas.conform(rows, f"{schemas.RAW_JOB}, seq long").write.parquet(path)
    return path


# in an empty store the first row that writes a (source, ats_job_id) is inserted, and no row meets its own id again
_INSERTED = f"""SELECT id, source, ats_job_id, CASE WHEN reason IS NULL THEN 'new' ELSE 'excluded' END AS status FROM ({postings._BATCH})
 QUALIFY ats_job_id IS NULL OR row_number() OVER (PARTITION BY source, ats_job_id ORDER BY seq) = 1"""


@register(
    f"""WITH b AS MATERIALIZED ({postings._BATCH}), i AS MATERIALIZED ({_INSERTED}) SELECT id, source, ats_job_id, status, (SELECT count(*) FROM b) AS fetched, (SELECT count(*) FROM i) AS first_inserted, 0::BIGINT AS second_inserted, 0::BIGINT AS second_updated FROM i"""
)
def ingest_stream(spark, sf_dir):
    """The store after the stream has run, and has run again from its start, with the counts that both runs have logged."""
    path, root = landed(spark, postings.raw(spark, sf_dir)), folder(spark, "store")
    history, excluded = frame(spark, sf_dir, "SELECT * FROM @history"), postings._excluded(spark)
    for _ in range(2):
        jobs_stream(spark, path, root, folder(spark, "stream"), postings.since(), postings.as_of(), history, excluded, files_a_batch=1_000_000).awaitTermination()
    logged = [r.counts for r in store.table(spark, root, "runs").orderBy("finished_at").collect()]
    first, second = logged
    counts = {"fetched": first["fetched"], "first_inserted": first["inserted"], "second_inserted": second["inserted"], "second_updated": second["updated"]}
    return store.table(spark, root, "jobs").select("id", "source", "ats_job_id", "status", *[F.lit(n).cast("long").alias(k) for k, n in counts.items()])


_SIGHTED = """SELECT seq, source, ats_job_id, company, seq % 3 = 0 AS undated, CASE WHEN seq % 3 <> 0 THEN posted_at END AS posted_at, CASE WHEN seq % 2 = 0 THEN 1 ELSE 2 END AS day, title, location, url, description_text, is_remote FROM @raw_jobs"""


@register(
    f"""WITH r AS MATERIALIZED ({_SIGHTED}), s AS (SELECT source, company, ats_job_id FROM r WHERE day = 1 AND ats_job_id IS NOT NULL)
 SELECT seq, source, ats_job_id, CASE WHEN NOT undated THEN posted_at WHEN day = 2 AND ats_job_id IS NOT NULL AND (source, company) IN (SELECT (source, company) FROM s) AND (source, company, ats_job_id) NOT IN (SELECT (source, company, ats_job_id) FROM s)
 THEN {postings.AS_OF} ELSE TIMESTAMP '2000-01-01 00:00:00' END AS posted_at FROM r"""
)
def first_seen_stream(spark, sf_dir):
    """The dates that undated postings get at first sight, one half of the rows landing after the other."""
    rows = frame(spark, sf_dir, _SIGHTED)
    path, root, out, checkpoint = folder(spark, "landed"), folder(spark, "store"), folder(spark, "seen"), folder(spark, "stream")
    for day in (1, 2):
        schemas.conform(rows.filter(F.col("day") == day), f"{schemas.RAW_JOB}, seq long").write.mode("append").parquet(path)
        seen_stream(spark, path, root, checkpoint, out, postings.as_of(), files_a_batch=1_000_000).awaitTermination()
    return spark.read.parquet(out).select("seq", "source", "ats_job_id", "posted_at")


_WINDOWS = " UNION ALL ".join(f"SELECT {k} AS k, '{w}' AS name, {hours} AS hours" for k, (w, hours) in enumerate(postings.DEFAULT.window_hours.items()))


@register(
    f"""SELECT o_orderkey, name, CAST(o_orderdate AS TIMESTAMP) - to_hours(CAST(least(hours + {postings.DEFAULT.grace_hours}, {24 * postings.DEFAULT.max_age_days}) AS BIGINT)) AS since
 FROM orders JOIN ({_WINDOWS}) w ON w.k = o_orderkey % {len(postings.DEFAULT.window_hours)}"""
)
def compute_since(spark, sf_dir):
    """Where a run of each order's day begins to look, by the window that its key names."""
    names = list(postings.DEFAULT.window_hours)
    rows = frame(spark, sf_dir, "SELECT o_orderkey, CAST(o_orderdate AS TIMESTAMP) AS as_of FROM @orders")
    name = F.get(F.array(*map(F.lit, names)), (F.col("o_orderkey") % len(names)).cast("int"))
    found = F.coalesce(*[F.when(name == w, dates.compute_since(F.col("as_of"), w)) for w in names])
    return rows.select("o_orderkey", name.alias("name"), found.alias("since"))
