"""The daily digest: selection, one row a role, groups, labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rolespark.config import DEFAULT, Config
from rolespark.functions import labels as L
from rolespark.functions.places import metro_group, nearest_miles
from rolespark.functions.text import normalize_company, title_norm

GROUPS = ("NYC metro", "DC / Philadelphia corridor", "Remote US", "Elsewhere US")


def select_digest(store: DataFrame, as_of: Column, config: Config = DEFAULT) -> DataFrame:
    fresh = F.col("posted_at") >= as_of - F.make_dt_interval(F.lit(config.max_age_days))
    years = F.col("yoe_min").isNull() | (F.col("yoe_min") <= config.max_yoe)
    good = store.filter((F.col("status") == "scored") & F.col("rank_score").isNotNull() & (F.col("fit_score") >= config.min_core_fit) & years & fresh)
    return good.orderBy(F.col("rank_score").desc(), "id").limit(config.digest_jobs)


def group_of(points: Column, is_nyc: Column, is_remote: Column, config: Config = DEFAULT) -> Column:
    """Distance first; the stored New York flag only where no place resolves."""
    metro = metro_group(points, config)
    return (
        F.when(metro == "nyc", GROUPS[0])
        .when(metro == "corridor", GROUPS[1])
        .when(is_nyc & (F.size(points) == 0), GROUPS[0])
        .when(is_remote, GROUPS[2])
        .otherwise(GROUPS[3])
    )


def _grouped(jobs: DataFrame, config: Config) -> DataFrame:
    return jobs.withColumn("group", group_of(F.col("points"), F.col("is_nyc_metro"), F.col("is_remote"), config))


def collapse_locations(selected: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """One row for each company and title of the selection (columns of a job and points): the place of the best group and
    nearest to a hub, ties in rank order, marked with the number of the others. position: the first member's rank. The
    selection has at most config.digest_jobs rows, so ranking it is one small sort."""
    ranked = _grouped(selected, config).withColumn("_rank", F.row_number().over(Window.orderBy(F.col("rank_score").desc(), "id")))
    number = F.array_position(F.array(*map(F.lit, GROUPS)), F.col("group"))
    ranked = ranked.withColumns({"_company": normalize_company(F.col("company")), "_title": title_norm(F.col("title")), "_group": number, "_miles": F.coalesce(nearest_miles(F.col("points"), config), F.lit(float("inf")))})
    role = Window.partitionBy("_company", "_title")
    out = ranked.withColumns({"_n": F.row_number().over(role.orderBy("_group", "_miles", "_rank")), "_others": F.count("*").over(role) - 1, "position": F.min("_rank").over(role)})
    place = F.when(F.coalesce("location", F.lit("")) != "", F.col("location")).otherwise("Not stated")
    more = F.concat(place, F.lit(" (+"), F.col("_others").cast("string"), F.lit(" other location"), F.when(F.col("_others") > 1, "s").otherwise(""), F.lit(")"))
    return out.filter("_n = 1").withColumn("location", F.when(F.col("_others") > 0, more).otherwise(F.col("location"))).drop("_rank", "_company", "_title", "_group", "_miles", "_n", "_others", "group")


def digest_groups(collapsed: DataFrame, config: Config = DEFAULT) -> DataFrame:
    return _grouped(collapsed, config).groupBy("group").agg(F.count("*").alias("n_jobs"))


def digest_lines(collapsed: DataFrame, as_of: Column, config: Config = DEFAULT) -> DataFrame:
    """The digest as rows: group_number, group, number in the group, and the labels."""
    rows = _grouped(collapsed, config)
    c = F.col
    number = (F.array_position(F.array(*map(F.lit, GROUPS)), c("group"))).cast("int")
    place = F.when(F.coalesce("location", F.lit("")) != "", c("location")).otherwise("Not stated")
    return rows.select(
        number.alias("group_number"),
        "group",
        F.row_number().over(Window.partitionBy("group").orderBy("position")).alias("number"),
        L.title_line(c("company"), c("title"), c("cap_exempt")).alias("role"),
        F.concat(place, F.lit(" ("), L.posted_age(c("posted_at"), as_of), F.lit(")")).alias("place"),
        L.fit_label(c("fit_score"), c("posted_at"), as_of, config).alias("fit"),
        L.yoe_label(c("yoe_min"), c("yoe_text")).alias("years"),
        L.sponsorship_label(c("sponsorship_jd"), c("sponsorship_evidence")).alias("sponsorship"),
        L.lca_label(c("lca_filings"), c("lca_relevant_soc")).alias("history"),
        F.coalesce("summary", F.lit("")).alias("summary"),
        "url",
        "id",
    )


def mark_digested(store: DataFrame, selected: DataFrame, as_of: Column) -> DataFrame:
    """All selected rows that are scored become digested, also those that the collapse left out."""
    ids = selected.select("id", F.lit(True).alias("_hit")).distinct()
    out = store.join(ids, "id", "left")
    hit = F.col("_hit") & (F.col("status") == "scored")
    values = {"status": F.when(hit, "digested").otherwise(F.col("status")), "digested_at": F.when(hit, as_of).otherwise(F.col("digested_at"))}
    return out.select(*[values.get(c, F.col(c)).alias(c) for c in store.columns])


def v_daily_digest(store: DataFrame) -> DataFrame:
    shown = "id rank_score fit_score company title location is_nyc_metro is_remote posted_at yoe_min sponsorship_jd sponsorship_evidence lca_filings lca_relevant_soc summary url status cap_exempt".split()
    rows = store.filter(F.col("status").isin("scored", "digested") & F.col("rank_score").isNotNull())
    return rows.select(*shown).orderBy(F.col("is_nyc_metro").desc(), F.col("rank_score").desc(), "id")
