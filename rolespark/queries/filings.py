"""Filings: from raw cases to employers, and names matched with them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rolespark.operators import filings, matching
from rolespark.queries import register
from rolespark.queries.adapters import frame
from rolespark.queries.duck import norm_company

_DEDUP = """SELECT * FROM @lca_raw QUALIFY row_number() OVER (PARTITION BY CASE_NUMBER ORDER BY DECISION_DATE DESC NULLS FIRST, source_file DESC NULLS LAST, CASE_STATUS ASC NULLS FIRST,
 VISA_CLASS ASC NULLS FIRST, EMPLOYER_NAME ASC NULLS FIRST, SOC_CODE ASC NULLS FIRST, WORKSITE_STATE ASC NULLS FIRST, TOTAL_WORKER_POSITIONS ASC NULLS FIRST, WAGE_RATE_OF_PAY_FROM ASC NULLS FIRST, WAGE_UNIT_OF_PAY ASC NULLS FIRST) = 1"""
_CERTIFIED = f"SELECT * FROM ({_DEDUP}) WHERE lower(trim(CASE_STATUS)) = 'certified' AND lower(trim(VISA_CLASS)) = 'h-1b'"
_WAGE = "WAGE_RATE_OF_PAY_FROM * CASE trim(WAGE_UNIT_OF_PAY) WHEN 'Hour' THEN 2080 WHEN 'Week' THEN 52 WHEN 'Bi-Weekly' THEN 26 WHEN 'Month' THEN 12 WHEN 'Year' THEN 1 END"
_RELEVANT = "coalesce(substr(trim(SOC_CODE), 1, 7) IN ('15-2051', '15-1221', '15-1252'), false)"
EMPLOYERS = f"""
WITH c AS (SELECT *, {norm_company("EMPLOYER_NAME")} AS employer_norm, {_RELEVANT} AS relevant, {_WAGE} AS wage, upper(trim(WORKSITE_STATE)) AS st FROM ({_CERTIFIED}) WHERE EMPLOYER_NAME IS NOT NULL),
n AS (SELECT employer_norm, EMPLOYER_NAME, count(*) AS n FROM c GROUP BY ALL),
r AS (SELECT employer_norm, EMPLOYER_NAME AS employer_raw FROM n QUALIFY row_number() OVER (PARTITION BY employer_norm ORDER BY n DESC, EMPLOYER_NAME) = 1)
SELECT employer_norm, any_value(employer_raw) AS employer_raw, count(*) AS filings_total, count(*) FILTER (relevant) AS filings_relevant_soc, coalesce(sum(CAST(TOTAL_WORKER_POSITIONS AS BIGINT)), 0)::BIGINT AS positions_total,
 count(*) FILTER (coalesce(st IN ('NY', 'NJ'), false)) AS ny_nj_filings, coalesce(array_to_string(list_sort(list(DISTINCT st) FILTER (st <> '')), ','), '') AS states,
 round(median(wage) FILTER (relevant), 4) AS median_wage_relevant, max(CAST(DECISION_DATE AS DATE)) AS last_decision_date, array_to_string(list_sort(list(DISTINCT source_file)), ',') AS source_files
FROM c JOIN r USING (employer_norm) WHERE employer_norm <> '' GROUP BY employer_norm"""


def lca(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frame(spark, sf_dir, "SELECT * FROM @lca_raw")


def _flat(employers: DataFrame) -> DataFrame:
    joined = {c: F.array_join(c, ",") for c in ("states", "source_files")}
    return employers.withColumns(joined | {"median_wage_relevant": F.round("median_wage_relevant", 4)})


@register("SELECT source_file, count(*) AS n_rows, min(DECISION_DATE) AS first_decision, max(DECISION_DATE) AS last_decision FROM @lca_raw GROUP BY source_file")
def lca_file_ranges(spark, sf_dir):
    return filings.lca_file_ranges(lca(spark, sf_dir))


@register(_DEDUP)
def dedup_cases(spark, sf_dir):
    return filings.dedup_cases(lca(spark, sf_dir))


@register("SELECT CASE_NUMBER, CASE_STATUS, VISA_CLASS FROM @lca_raw WHERE lower(trim(CASE_STATUS)) = 'certified' AND lower(trim(VISA_CLASS)) = 'h-1b'")
def filter_certified_h1b(spark, sf_dir):
    return filings.filter_certified_h1b(lca(spark, sf_dir)).select("CASE_NUMBER", "CASE_STATUS", "VISA_CLASS")


@register(EMPLOYERS)
def lca_employers(spark, sf_dir):
    return _flat(filings.employer_history(lca(spark, sf_dir)))


@register(f"SELECT employer_norm, employer_raw, filings_relevant_soc, filings_total, ny_nj_filings FROM ({EMPLOYERS}) WHERE ny_nj_filings > 0 ORDER BY filings_relevant_soc DESC, employer_norm LIMIT 20")
def lca_top_employers(spark, sf_dir):
    top = filings.lca_top_employers(filings.employer_history(lca(spark, sf_dir)))
    return top.select("employer_norm", "employer_raw", "filings_relevant_soc", "filings_total", "ny_nj_filings")


@register(f"SELECT employer_norm, employer_raw, ny_nj_filings, filings_relevant_soc FROM ({EMPLOYERS}) WHERE ny_nj_filings > 0 ORDER BY ny_nj_filings DESC, employer_norm LIMIT 20")
def lca_top_near(spark, sf_dir):
    top = filings.lca_top_employers(filings.employer_history(lca(spark, sf_dir)), by="ny_nj_filings")
    return top.select("employer_norm", "employer_raw", "ny_nj_filings", "filings_relevant_soc")


@register(f"SELECT CASE_NUMBER, WAGE_UNIT_OF_PAY, round({_WAGE}, 4) AS annual FROM @lca_raw")
def annualize(spark, sf_dir):
    from rolespark.functions.text import annualize as a

    return lca(spark, sf_dir).select("CASE_NUMBER", "WAGE_UNIT_OF_PAY", F.round(a(F.col("WAGE_RATE_OF_PAY_FROM"), F.col("WAGE_UNIT_OF_PAY")), 4).alias("annual"))


# employers: even suppliers; wanted: names as they are (exact), one digit gone (fuzzy), aliases, and names without a partner
_FACTS = "SELECT 'supplier ' || substr(s_name, 10) AS employer_norm, s_name AS employer_raw, s_suppkey % 90 + 1 AS filings_total, s_suppkey % 7 AS filings_relevant_soc, s_suppkey % 5 AS ny_nj_filings FROM @supplier WHERE s_suppkey % 2 = 0"
_WANTED = """SELECT CASE s_suppkey % 4 WHEN 0 THEN 'supplier ' || substr(s_name, 10) WHEN 1 THEN 'alias ' || CAST(s_suppkey AS STRING) WHEN 2 THEN substr(substr(s_name, 10), 2) || ' supplier'
 ELSE 'nobody ' || CAST(s_suppkey * 7919 AS STRING) END AS company_norm FROM @supplier"""
_ALIAS = """SELECT 'alias ' || CAST(s_suppkey AS STRING) AS alias_norm, 'supplier ' || lpad(CAST(s_suppkey + p AS STRING), 9, '0') AS target_norm, p AS pos
 FROM @supplier JOIN (SELECT 1 AS p UNION ALL SELECT 2 AS p UNION ALL SELECT 3 AS p) AS ps ON true WHERE s_suppkey % 4 = 1"""


@register(
    f"""WITH f AS ({_FACTS}), w AS (SELECT DISTINCT company_norm FROM ({_WANTED})), a AS ({_ALIAS}),
x AS (SELECT company_norm, company_norm AS lca_match_name, 100.0::DOUBLE AS lca_match_score, sum(filings_total)::BIGINT AS filings_total, sum(filings_relevant_soc)::BIGINT AS filings_relevant_soc,
 sum(ny_nj_filings)::BIGINT AS ny_nj_filings, 'alias' AS match_source, string_agg(employer_raw, ',' ORDER BY pos) AS entities FROM w JOIN a ON company_norm = alias_norm JOIN f ON target_norm = employer_norm GROUP BY company_norm),
e AS (SELECT company_norm, employer_raw AS lca_match_name, 100.0::DOUBLE AS lca_match_score, filings_total, filings_relevant_soc, ny_nj_filings, 'exact' AS match_source, employer_raw AS entities FROM w JOIN f ON company_norm = employer_norm),
z AS (SELECT company_norm, employer_raw AS lca_match_name, round(200.0 * length(company_norm) / (2 * length(company_norm) + 1), 6) AS lca_match_score, filings_total, filings_relevant_soc, ny_nj_filings, 'fuzzy' AS match_source, employer_raw AS entities
 FROM w JOIN f ON company_norm = substr(employer_norm, 11) || ' supplier')
SELECT * FROM x UNION ALL SELECT * FROM e UNION ALL SELECT * FROM z"""
)
def match_employer(spark, sf_dir):
    """All three steps. A name with one digit gone has several partners of equal score, the least of which is its own."""
    found = matching.match_employer(frame(spark, sf_dir, _WANTED), frame(spark, sf_dir, _FACTS), frame(spark, sf_dir, _ALIAS))
    return found.withColumns({"lca_match_score": F.round("lca_match_score", 6), "entities": F.array_join("entities", ",")})


_LONG = "SELECT p_partkey AS k, lower(p_name) || ' ' || md5(CAST(p_partkey AS STRING)) AS full_name FROM @part"
_CUT = "SELECT k, CASE WHEN k % 5 = 0 THEN 'unrelated ' || sha1(CAST(k AS STRING)) ELSE substr(full_name, 1, length(full_name) - 1 - CAST(k % 4 AS INT)) END AS cut_name FROM (" + _LONG + ")"


@register(f"SELECT cut_name AS left_name, full_name AS right_name, round(200.0 * length(cut_name) / (length(cut_name) + length(full_name)), 6) AS score FROM ({_CUT}) c JOIN ({_LONG}) l ON c.k = l.k WHERE c.k % 5 <> 0")
def fuzzy_match_topone(spark, sf_dir):
    left = frame(spark, sf_dir, f"SELECT cut_name AS left_name FROM ({_CUT})")
    right = frame(spark, sf_dir, f"SELECT full_name AS right_name FROM ({_LONG})")
    return matching.fuzzy_match_topone(left, right).withColumn("score", F.round("score", 6))
