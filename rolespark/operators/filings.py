"""Employer filing history: one row a case, certified ones only, added up by employer."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rolespark.config import DEFAULT, Config
from rolespark.functions.text import annualize, normalize_company
from rolespark.schemas import EMPLOYERS, LCA_COLUMNS, columns
from rolespark.storage import written


def lca_file_ranges(filings: DataFrame) -> DataFrame:
    return filings.groupBy("source_file").agg(F.count("*").alias("n_rows"), F.min("DECISION_DATE").alias("first_decision"), F.max("DECISION_DATE").alias("last_decision"))


def dedup_cases(filings: DataFrame) -> DataFrame:
    """The latest row of each case. A missing date counts as latest; ties go to the last source file, then to the least
    values of the other columns. Rows without a case number are one case."""
    rest = [F.col(c).asc_nulls_first() for c in LCA_COLUMNS if c not in ("CASE_NUMBER", "DECISION_DATE")]
    w = Window.partitionBy("CASE_NUMBER").orderBy(F.col("DECISION_DATE").desc_nulls_first(), F.col("source_file").desc_nulls_last(), *rest)
    return filings.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def filter_certified_h1b(filings: DataFrame) -> DataFrame:
    return filings.filter((F.lower(F.trim("CASE_STATUS")) == "certified") & (F.lower(F.trim("VISA_CLASS")) == "h-1b"))


def grouped_median(rows: DataFrame, key: str, value: str) -> DataFrame:
    """key, median of each key's values (nulls are left out), without holding a key's values anywhere: counts by bins of
    nearly equal values give the bins of the middle ranks, and counts by value within those give the values. A bin is 1/256
    of a power of two wide; a group needs one row a bin, then one a different value of its middle bins."""
    v = F.col(value)
    size = F.floor(F.least(F.log2(F.abs(v)), F.lit(1100.0)) * 256)  # infinity has a bin too
    bins = F.when(F.isnan(v), F.lit(1 << 40)).when(v > 0, size + (1 << 20)).when(v < 0, -size - (1 << 20)).otherwise(0)
    counts = rows.filter(v.isNotNull()).groupBy(key, bins.cast("long").alias("_bin"), v.alias("_value")).agg(F.count("*").alias("_n"))
    by_bin = Window.partitionBy(key).orderBy("_bin")
    whole = Window.partitionBy(key)
    ranked = counts.groupBy(key, "_bin").agg(F.sum("_n").alias("_n")).select(key, "_bin", "_n", F.sum("_n").over(by_bin).alias("_upto"), F.sum("_n").over(whole).alias("_all"))
    low, high = F.floor((F.col("_all") + 1) / 2), F.floor(F.col("_all") / 2) + 1  # middle ranks from 1
    middle = ranked.filter((F.col("_upto") >= low) & (F.col("_upto") - F.col("_n") < high)).select(key, "_bin", (F.col("_upto") - F.col("_n")).alias("_before"), "_all")
    by_value = Window.partitionBy(key, "_bin").orderBy("_value")
    placed = counts.join(middle, [key, "_bin"]).withColumn("_upto", F.col("_before") + F.sum("_n").over(by_value))
    first, last = F.col("_upto") - F.col("_n") + 1, F.col("_upto")
    at = lambda rank: F.max(F.when((first <= rank) & (rank <= last), F.col("_value")))
    pair = placed.groupBy(key).agg(at(low).alias("_low"), at(high).alias("_high"))
    return pair.select(key, F.when(F.col("_low") == F.col("_high"), F.col("_low")).otherwise(F.col("_low") + (F.col("_high") - F.col("_low")) / 2).alias("median"))


def lca_employers(filings: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """One row an employer name. Names are normalized once for each spelling and joined back; the most frequent spelling
    (least on ties) comes from counts by spelling, so no group holds its spellings. The filings and the rows made of them are
    written, as both are used several times: else a dedup below would be done anew each time."""
    used = ("EMPLOYER_NAME", "WORKSITE_STATE", "SOC_CODE", "TOTAL_WORKER_POSITIONS", "WAGE_RATE_OF_PAY_FROM", "WAGE_UNIT_OF_PAY", "DECISION_DATE", "source_file")
    filings = written(filings.filter("EMPLOYER_NAME is not null").select(*used), "filings")
    names = filings.groupBy("EMPLOYER_NAME").agg(F.count("*").alias("n"))
    names = names.withColumn("employer_norm", normalize_company(F.col("EMPLOYER_NAME"))).filter("employer_norm <> ''")
    spelling = names.groupBy("employer_norm").agg(F.min_by("EMPLOYER_NAME", F.struct(-F.col("n"), F.col("EMPLOYER_NAME"))).alias("employer_raw"))
    state = F.upper(F.trim("WORKSITE_STATE"))
    relevant = F.coalesce(F.substring(F.trim("SOC_CODE"), 1, 7).isin(*config.relevant_soc), F.lit(False))
    rows = filings.join(names.select("EMPLOYER_NAME", "employer_norm"), "EMPLOYER_NAME").select(
        "employer_norm",
        relevant.alias("relevant"),
        F.col("TOTAL_WORKER_POSITIONS").cast("long").alias("positions"),
        F.coalesce(state.isin("NY", "NJ"), F.lit(False)).alias("near"),
        F.nullif(state, F.lit("")).alias("state"),
        F.when(relevant, annualize(F.col("WAGE_RATE_OF_PAY_FROM"), F.col("WAGE_UNIT_OF_PAY"))).alias("wage"),
        F.to_date("DECISION_DATE").alias("decided"),
        "source_file",
    )
    rows = written(rows, "filings")
    grouped = rows.groupBy("employer_norm").agg(
        F.count("*").alias("filings_total"),
        F.count_if("relevant").alias("filings_relevant_soc"),
        F.coalesce(F.sum("positions"), F.lit(0)).cast("long").alias("positions_total"),
        F.count_if("near").alias("ny_nj_filings"),
        F.sort_array(F.collect_set("state")).alias("states"),
        F.max("decided").alias("last_decision_date"),
        F.sort_array(F.collect_set("source_file")).alias("source_files"),
    )
    medians = grouped_median(rows, "employer_norm", "wage").withColumnRenamed("median", "median_wage_relevant")
    return grouped.join(spelling, "employer_norm").join(medians, "employer_norm", "left").select(*columns(EMPLOYERS))


def lca_top_employers(employers: DataFrame, by: str = "filings_relevant_soc", n: int = 20) -> DataFrame:
    """The n employers near New York with the most filings of one kind; ties by name."""
    return employers.filter("ny_nj_filings > 0").orderBy(F.col(by).desc(), "employer_norm").limit(n)


def employer_history(filings: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """Raw filings to employers. The filter stays above the dedup: a later withdrawal takes a certified case away."""
    return lca_employers(filter_certified_h1b(dedup_cases(filings)), config)
