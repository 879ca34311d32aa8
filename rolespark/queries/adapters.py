"""Adapters: filings, postings, a store, decisions and landed responses, made of the driver's tables."""

from __future__ import annotations

import hashlib
import re

from pyspark.sql import DataFrame, SparkSession

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
AS_OF = "TIMESTAMP '2001-08-01 12:00:00'"
SINCE = "TIMESTAMP '2001-07-18 10:00:00'"


def pick(key: str, *values: str | None) -> str:
    """One of the values by key modulo their number."""
    cases = " ".join(f"WHEN {i} THEN " + ("NULL" if v is None else "'" + v.replace("'", "''") + "'") for i, v in enumerate(values))
    return f"CASE CAST({key} AS BIGINT) % {len(values)} {cases} END"


def days_back(key: str, n: int) -> str:
    return f"CAST(DATE '2001-08-01' - CAST({key} % {n} AS INTEGER) AS TIMESTAMP)"


TITLES = (
    "Data Scientist", "Senior Machine Learning Engineer (Req-10422)", "Applied Scientist - Remote", "Data Science Manager", "Line Cook", "ML Engineer, Ads",
    "NLP Researcher", "Staff Data Scientist", "AI Engineer", "Decision Scientist R 20331", "Deep Learning Engineer", "Machine Learning Intern",
)
LOCATIONS = (
    "New York, NY", "Jersey City, NJ", "Washington, DC", "Remote", "Remote - US", "London, United Kingdom", "Austin, TX; New York, NY", "Philadelphia, PA", None,
    "San Francisco, CA", "Toronto, Canada",
)
DESCRIPTIONS = (
    "We build models. 3+ years of experience with Python.", "Requires 7 years of experience in forecasting.", "Our client is a bank in the United States.",
    "Note: US citizenship is required for this role.", "Based in the United States. Minimum of 2 years in industry.", "Pay range $120,000 - $150,000 a year.",
    "We are unable to sponsor visas.", "Ten years of experience preferred. At least four years required.", None,
)
YEARS = (3, 7, None, None, 2, None, None, 4, None)

ADAPTERS = {
    "lca_raw": """
        SELECT CAST(l_orderkey AS STRING) || '-' || CAST(l_linenumber AS STRING) AS CASE_NUMBER,
          CASE l_returnflag WHEN 'A' THEN 'Certified' WHEN 'N' THEN ' CERTIFIED ' ELSE 'Withdrawn' END AS CASE_STATUS,
          CASE WHEN l_linenumber % 4 = 3 THEN 'E-3 Australian' ELSE 'H-1B' END AS VISA_CLASS,
          CASE WHEN l_partkey % 53 = 0 THEN NULL WHEN l_partkey % 4 = 0 THEN s_name || ', Inc.' WHEN l_partkey % 4 = 1 THEN s_name || ' LLC'
            WHEN l_partkey % 4 = 2 THEN 'The ' || s_name ELSE upper(s_name) || ' & Co., L.L.C.' END AS EMPLOYER_NAME,
          CASE l_partkey % 7 WHEN 0 THEN '15-2051.00' WHEN 1 THEN '15-1252' WHEN 2 THEN ' 15-1221.00' WHEN 3 THEN NULL ELSE '13-2011' END AS SOC_CODE,
          CASE s_nationkey % 5 WHEN 0 THEN 'NY' WHEN 1 THEN 'nj ' WHEN 2 THEN 'CA' WHEN 3 THEN '' ELSE NULL END AS WORKSITE_STATE,
          CASE WHEN l_linenumber = 7 THEN NULL ELSE CAST(l_quantity AS INT) END AS TOTAL_WORKER_POSITIONS,
          l_extendedprice AS WAGE_RATE_OF_PAY_FROM,
          CASE l_linenumber WHEN 1 THEN 'Hour' WHEN 2 THEN 'Week' WHEN 3 THEN 'Bi-Weekly' WHEN 4 THEN 'Month' WHEN 5 THEN ' Year ' WHEN 6 THEN 'Piece' ELSE NULL END AS WAGE_UNIT_OF_PAY,
          CASE WHEN l_suppkey % 41 = 0 THEN NULL ELSE l_shipdate END AS DECISION_DATE,
          'FY' || CAST(extract(year FROM l_shipdate) AS STRING) || '.parquet' AS source_file
        FROM @lineitem JOIN @supplier ON l_suppkey = s_suppkey""",
    "raw_jobs": f"""
        SELECT o_orderkey AS seq, {pick("o_orderkey", "greenhouse", "lever", "jobspy_indeed", "workday", "jobspy_linkedin")} AS source,
          CASE WHEN o_orderkey % 17 = 0 THEN NULL ELSE 'J' || CAST(CAST(floor(o_orderkey / 10) AS BIGINT) AS STRING) END AS ats_job_id,
          CASE WHEN o_custkey % 29 = 0 THEN 'Robert Half, Inc.' WHEN o_custkey % 31 = 0 THEN 'Acme Technologies' WHEN o_custkey % 3 = 0 THEN c_name || ' LLC'
            WHEN o_custkey % 3 = 1 THEN 'The ' || c_name || ', Inc.' ELSE c_name END AS company,
          {pick("o_orderkey", *TITLES)} AS title, {pick("o_custkey", *LOCATIONS)} AS location,
          o_orderkey % 13 = 0 AS is_remote, 'https://jobs.example.com/' || CAST(o_orderkey AS STRING) AS url,
          CASE WHEN o_orderkey % 23 = 0 THEN NULL ELSE {days_back("o_orderkey", 19)} END AS posted_at,
          {pick("o_orderkey", *DESCRIPTIONS)} AS description_text, o_orderkey AS k
        FROM @orders JOIN @customer ON o_custkey = c_custkey""",
    # a store whose rows have every status
    "store": f"""
        SELECT sha1('j' || CAST(o_orderkey AS STRING)) AS id, {pick("o_orderkey", "greenhouse", "jobspy_indeed", "lever")} AS source,
          'S' || CAST(o_orderkey AS STRING) AS ats_job_id, c_name || ' LLC' AS company, lower(replace(c_name, '#', ' ')) AS company_norm,
          {pick("CAST(floor(o_orderkey / 4) AS BIGINT)", *TITLES)} AS title, {pick("o_orderkey", *LOCATIONS)} AS location, o_orderkey % 7 = 0 AS is_remote, o_orderkey % 5 = 0 AS is_nyc_metro,
          CASE WHEN o_orderkey % 6 = 0 THEN 'https://site.example/jobs/view/role-' || CAST(4000000 + o_orderkey AS STRING) || '?t=1' ELSE 'https://b.example/' || CAST(1000000 + o_orderkey AS STRING) END AS url,
          CASE WHEN o_orderkey % 37 = 0 THEN NULL ELSE {days_back("o_orderkey", 21)} END AS posted_at,
          CASE WHEN o_orderkey % 4 = 0 THEN 'short' ELSE repeat('Build models with Python and SQL. ', 8) END AS description,
          CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE floor(o_totalprice % 1000) / 1000e0 END AS similarity,
          CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE CAST(o_orderkey % 7 AS INT) END AS yoe_min, CASE WHEN o_orderkey % 6 = 0 THEN 'some years' END AS yoe_text,
          {pick("o_custkey", "Available", None, "Not Mentioned", "N/A")} AS sponsorship_jd, CASE WHEN o_custkey % 4 = 0 THEN 'we sponsor' ELSE '' END AS sponsorship_evidence,
          CASE WHEN o_custkey % 3 = 0 THEN NULL ELSE CAST(o_custkey % 50 AS INT) END AS lca_filings, CASE WHEN o_custkey % 3 = 1 THEN CAST(o_custkey % 9 AS INT) END AS lca_relevant_soc,
          CAST(20 + o_orderkey % 66 AS INT) AS fit_score,
          {pick("o_orderkey + o_custkey", "new", "scored", "digested", "applied", "skipped", "shortlisted", "excluded", "scored")} AS status,
          CASE WHEN (o_orderkey + o_custkey) % 8 = 4 THEN {pick("o_custkey", "skip:location", "skip:pay", "skip")} WHEN (o_orderkey + o_custkey) % 8 = 6 THEN 'stale' END AS exclude_reason,
          CASE WHEN (o_orderkey + o_custkey) % 8 = 3 THEN CAST({days_back("o_orderkey", 60)} AS DATE) END AS applied_at,
          'Role ' || CAST(o_orderkey AS STRING) AS summary, o_orderkey % 10 = 0 AS cap_exempt, o_orderkey AS k
        FROM @orders JOIN @customer ON o_custkey = c_custkey""",
    "ranked": "SELECT *, CASE WHEN status IN ('scored', 'digested') AND posted_at IS NOT NULL THEN -8919 - k % 21 + fit_score / 1000e0 END AS rank_score FROM @store",
    "history": f"""
        SELECT DISTINCT lower(replace(c_name, '#', ' ')) AS company_norm, {pick("c_custkey", "data scientist", "machine learning engineer", "ai engineer", "applied scientist", "scientist data", "ml engineer ad")} AS title_norm
        FROM @customer WHERE c_custkey % 2 = 0""",
    "boards": f"""
        SELECT c_custkey AS k, c_name AS company, {pick("c_custkey", "Data Scientist", "123", "Test role", "ML Engineer", "AI Engineer")} AS title,
          CASE c_custkey % 8 WHEN 0 THEN 'https://boards.greenhouse.io/b' || CAST(c_custkey % 40 AS STRING) || '/jobs/1' WHEN 1 THEN 'https://jobs.lever.co/b' || CAST(c_custkey % 30 AS STRING)
            WHEN 2 THEN 'https://acme' || CAST(c_custkey % 5 AS STRING) || '.wd1.myworkdayjobs.com/en-US/External/job/1' WHEN 3 THEN 'https://jobs.ashbyhq.com/b' || CAST(c_custkey % 9 AS STRING) || '/x'
            WHEN 4 THEN 'https://careers.smartrecruiters.com/B' || CAST(c_custkey % 20 AS STRING) WHEN 5 THEN 'https://example.com/jobs' WHEN 6 THEN 'https://jobs.lever.co/' ELSE 'https://job-boards.greenhouse.io/linkedin' END AS url
        FROM @customer""",
}


def expand(sql: str) -> str:
    """Adapters in a text replaced by their SQL, tables by their names."""
    names = re.compile(rf"@({'|'.join([*ADAPTERS, *TABLES])})\b")
    while names.search(sql):
        sql = names.sub(lambda m: f"({ADAPTERS[m[1]]})" if m[1] in ADAPTERS else m[1], sql)
    return sql


def frame(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """A text with adapters as a DataFrame over the tables in sf_dir."""
    mark = hashlib.md5(sf_dir.encode()).hexdigest()[:8]
    text = expand(sql)
    for name in TABLES:
        if re.search(rf"(?:FROM|JOIN) {name}\b", text):
            spark.read.parquet(f"{sf_dir}/{name}.parquet").createOrReplaceTempView(f"{name}_{mark}")
            text = re.sub(rf"(?<=FROM )\b{name}\b|(?<=JOIN )\b{name}\b", f"{name}_{mark}", text)
    return spark.sql(text)
