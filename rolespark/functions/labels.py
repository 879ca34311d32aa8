"""Text columns of the digest."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from rolespark.config import DEFAULT, Config
from rolespark.functions.dates import age_days, display_fit


def posted_age(posted_at: Column, as_of: Column) -> Column:
    days = F.floor(age_days(posted_at, as_of))
    return F.when(days < 1, "posted today").when(days == 1, "posted 1 day ago").otherwise(F.format_string("posted %d days ago", days))


def _or(value: Column, default: str) -> Column:
    """value, or the default where it is null or empty."""
    return F.when(F.coalesce(value, F.lit("")) != "", value).otherwise(F.lit(default))


def yoe_label(yoe_min: Column, yoe_text: Column) -> Column:
    return F.when(yoe_min.isNotNull(), F.concat(yoe_min.cast("string"), F.lit("+ years"))).otherwise(_or(yoe_text, "Not stated"))


def sponsorship_label(status: Column, evidence: Column) -> Column:
    known = _or(status, "Not Mentioned")
    return F.when(F.coalesce(evidence, F.lit("")) != "", F.concat(known, F.lit(' ("'), evidence, F.lit('")'))).otherwise(known)


def lca_label(filings: Column, relevant: Column) -> Column:
    """No match is null and has no history; 0 is a match without relevant filings."""
    text = F.concat(filings.cast("string"), F.lit(" LCA filings, "), F.coalesce(relevant, F.lit(0)).cast("string"), F.lit(" in relevant SOC codes"))
    return F.when(filings.isNull(), "No filing history").otherwise(text)


def title_line(company: Column, title: Column, cap_exempt: Column) -> Column:
    return F.concat(company, F.lit(" - "), title, F.when(cap_exempt, " [Cap-exempt]").otherwise(""))


def fit_label(core_fit: Column, posted_at: Column, as_of: Column, config: Config = DEFAULT) -> Column:
    fit = display_fit(core_fit, posted_at, as_of, config)
    return F.format_string("%d/100 (core %d/85 + recency %d/15)", fit["total"], core_fit.cast("int"), fit["recency"])
