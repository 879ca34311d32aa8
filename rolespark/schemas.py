"""Schemas of the tables, always declared, never inferred."""

from __future__ import annotations

from pyspark.sql import types as T


def _schema(text: str) -> T.StructType:
    return T._parse_datatype_string(text)


LCA_COLUMNS = (
    "CASE_NUMBER", "CASE_STATUS", "VISA_CLASS", "EMPLOYER_NAME", "SOC_CODE", "WORKSITE_STATE", "TOTAL_WORKER_POSITIONS", "WAGE_RATE_OF_PAY_FROM",
    "WAGE_UNIT_OF_PAY", "DECISION_DATE",
)
RAW_JOB = (
    "source string, ats_job_id string, company string, title string, location string, is_remote boolean, url string, posted_at timestamp, "
    "description_html string, description_text string, undated boolean"
)
JOB = (
    "id string, source string, ats_job_id string, company string, company_norm string, title string, location string, is_remote boolean, is_us boolean, "
    "is_nyc_metro boolean, url string, posted_at timestamp, description string, embedding array<float>, similarity double, yoe_min int, yoe_text string, "
    "seniority string, sponsorship_jd string, sponsorship_evidence string, lca_filings int, lca_relevant_soc int, lca_match_name string, "
    "lca_match_score double, fit_score int, rank_score double, summary string, red_flags array<string>, status string, exclude_reason string, "
    "digested_at timestamp, applied_at date, first_seen_at timestamp, updated_at timestamp, cap_exempt boolean"
)
COMPANY = "name string, ats string, source string, cap_exempt boolean, slug string, host string, tenant string, board string, site string"
SCORE_RESULT = (
    "years_required_min int, years_required_text string, seniority string, sponsorship_jd string, sponsorship_evidence string, required_skills array<string>, "
    "matched_skills array<string>, experience_fit int, domain_fit int, one_line_summary string, red_flags array<string>"
)
EMPLOYERS = (
    "employer_norm string, employer_raw string, filings_total long, filings_relevant_soc long, positions_total long, ny_nj_filings long, states array<string>, "
    "median_wage_relevant double, last_decision_date date, source_files array<string>"
)
APPLIED_HISTORY = "company_norm string, title_norm string, applied_at date, source string"
SCORE_BATCHES = "batch_id string, created_at timestamp, status string, custom_id string"
RUNS = "started_at timestamp, finished_at timestamp, sources array<string>, window string, counts map<string,long>, status string, error string"


def columns(ddl: str) -> list[str]:
    return [f.name for f in _schema(ddl).fields]


def conform(df, ddl: str):
    """df with exactly the columns of a schema: cast, missing ones null, others dropped."""
    from pyspark.sql import functions as F

    return df.select(*[(F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in _schema(ddl).fields])
