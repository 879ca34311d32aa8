"""Similarity, shortlist, model requests and results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rolespark.config import DEFAULT, Config
from rolespark.functions import text as T
from rolespark.functions.dates import rank_score
from rolespark.schemas import SCORE_RESULT

SENIORITIES = ("intern", "entry", "mid", "senior", "staff_plus", "unclear")
SPONSORSHIP = ("Available", "N/A", "Not Mentioned")
SKILL_POINTS, MAX_SKILLS, CAP_YEARS, CAP_POINTS = 40, 12, 5, 10
REQUEST_CHARACTERS = 12_000


def l2_normalize(vector: Column) -> Column:
    """vector / norm; the zero vector stays."""
    squares = F.aggregate(vector, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    norm = F.sqrt(squares)
    length = F.get(F.transform(F.array(norm), lambda n: F.when(n == 0, F.lit(1.0)).otherwise(n)), F.lit(0))
    return F.zip_with(vector, F.array_repeat(length, F.size(vector)), lambda x, n: x.cast("double") / n)


def similarity(vector: Column, query: list[float]) -> Column:
    """Cosine of a vector column and one query vector, which is a literal: no join."""
    size = sum(x * x for x in query) ** 0.5 or 1.0
    constant = F.split(F.lit(",".join(repr(x / size) for x in query)), ",").cast("array<double>")
    dot = F.aggregate(F.zip_with(vector, constant, lambda x, q: x.cast("double") * q), F.lit(0.0), lambda a, x: a + x)
    norm = F.sqrt(F.aggregate(vector, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    return F.when(norm == 0, F.lit(0.0)).otherwise(dot / norm)


def select_shortlist(jobs: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """jobs (id, status, similarity, is_nyc_metro, ...) with every new row shortlisted or not: New York first, then
    similarity, then id. Only the shortlist's ids are joined back."""
    ranked = jobs.filter((F.col("status") == "new") & (F.col("similarity") >= config.min_similarity))
    top = ranked.orderBy(F.col("is_nyc_metro").desc(), F.col("similarity").desc(), "id").limit(config.max_shortlist).select("id", F.lit(True).alias("_top"))
    status = F.when(F.col("status") != "new", F.col("status")).when(F.col("_top"), "shortlisted").otherwise("not_shortlisted")
    return jobs.join(F.broadcast(top), "id", "left").withColumn("status", status).drop("_top").select(*jobs.columns)


def in_flight(batches: DataFrame) -> DataFrame:
    """batches: batch_id, status, custom_id, ...; a row each member, so that no batch is ever held in one place."""
    return batches.filter("status = 'in_progress' and custom_id is not null").select(F.col("custom_id").alias("id")).distinct()


def load_shortlisted(store: DataFrame, batches: DataFrame, as_of: Column, limit: int, config: Config = DEFAULT) -> DataFrame:
    """What goes to the model next: the limit is taken before rows without a description are left out."""
    fresh = F.col("posted_at") >= as_of - F.make_dt_interval(F.lit(config.max_age_days))
    waiting = store.filter((F.col("status") == "shortlisted") & fresh).join(in_flight(batches), "id", "left_anti")
    top = waiting.orderBy(F.col("is_nyc_metro").desc(), F.col("similarity").desc_nulls_last(), "id").limit(limit)
    return top.filter(T.has_description(F.col("description")))


def top_shortlisted(store: DataFrame, n: int = 10) -> DataFrame:
    return store.filter("status = 'shortlisted'").orderBy(F.col("similarity").desc(), "id").select("id", "similarity", "is_nyc_metro", "company", "title").limit(n)


def build_score_requests(jobs: DataFrame) -> DataFrame:
    """custom_id and request, one JSON a job."""
    place = F.when(F.coalesce("location", F.lit("")) != "", F.col("location")).otherwise("unspecified")
    text = F.substring(F.coalesce("description", F.lit("")), 1, REQUEST_CHARACTERS)
    content = F.concat(F.lit("Company: "), "company", F.lit("\nTitle: "), "title", F.lit("\nLocation: "), place, F.lit("\n\nJob description:\n"), text)
    return jobs.select(F.col("id").alias("custom_id"), F.to_json(F.struct(F.col("id").alias("custom_id"), content.alias("content"))).alias("request"))


_PRESENT = [f.split()[0] for f in SCORE_RESULT.split(", ")]


def _once(df: DataFrame, name: str, **values: Column) -> DataFrame:
    """df with a struct of the values, each computed once a row: the optimizer does not copy what a generator makes into
    the expressions that use it."""
    return df.withColumn(name, F.explode(F.array(F.struct(*[v.alias(k) for k, v in values.items()]))))


def validate_score_result(results: DataFrame) -> DataFrame:
    """results (custom_id, stop_reason, text, ...) with the parsed result and, where it is unusable, a reason. Unknown
    values, wrong types, missing fields, too many skills, points out of range, or matched skills that are not required.
    The text is parsed twice a row, as the schema and as a map, however often the result is used."""
    out = _once(results, "_p", result=F.from_json("text", SCORE_RESULT), raw=F.from_json("text", "map<string,string>"))
    r, raw = F.col("_p.result"), F.col("_p.raw")
    absent = F.lit(False)
    for name in _PRESENT:
        absent = absent | ~F.coalesce(F.map_contains_key(raw, F.lit(name)), F.lit(False))
        if name != "years_required_min":
            absent = absent | r[name].isNull()
    bad_years = r["years_required_min"].isNull() & raw["years_required_min"].isNotNull()
    required, matched = T.skill_keys(r["required_skills"]), T.skill_keys(r["matched_skills"])
    reason = (
        F.when(F.coalesce(F.col("stop_reason") != "end_turn", F.lit(True)), "stopped")
        .when(raw.isNull() | absent | bad_years, "fields")
        .when(~r["seniority"].isin(*SENIORITIES) | ~r["sponsorship_jd"].isin(*SPONSORSHIP), "value")
        .when(F.size(r["required_skills"]) > MAX_SKILLS, "too_many_skills")
        .when(~r["experience_fit"].between(0, 20) | ~r["domain_fit"].between(0, 15), "range")
        .when(F.size(F.array_except(matched, required)) > 0, "skills")
    )
    judged = _once(out, "_v", result=r, invalid=reason)
    return judged.select(*results.columns, F.col("_v.result").alias("result"), F.col("_v.invalid").alias("invalid"))


def skills_match(required: Column, matched: Column) -> Column:
    """Half-even rounded share of the required skills, in points."""
    n = F.greatest(F.size(T.skill_keys(required)), F.lit(1))
    return F.rint(SKILL_POINTS * F.size(T.skill_keys(matched)) / n).cast("int")


def experience_cap(years: Column, points: Column) -> Column:
    return F.when(years >= CAP_YEARS, F.least(points, F.lit(CAP_POINTS))).otherwise(points)


def core_points(result: Column) -> Column:
    return skills_match(result["required_skills"], result["matched_skills"]) + experience_cap(result["years_required_min"], result["experience_fit"]) + result["domain_fit"]


def apply_scores(store: DataFrame, valid: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """The store with the results of valid (custom_id, result, location_points), got_result for the rows that have one, and
    evidence_violation for those: a quote that the description does not have counts but stays."""
    hit = valid.select(F.col("custom_id").alias("id"), F.col("result").alias("_r"), F.col("location_points").alias("_points"))
    out = store.join(hit, "id", "left")
    r, got = F.col("_r"), F.col("_r").isNotNull()
    reason = F.when(r["sponsorship_jd"] == "N/A", "jd_no_sponsorship").when(r["years_required_min"] > config.max_yoe, "yoe_too_high")
    evidence = F.when(F.trim(r["sponsorship_evidence"]) != "", r["sponsorship_evidence"])
    values = {
        "fit_score": core_points(r) + F.col("_points"),
        "yoe_min": r["years_required_min"],
        "yoe_text": r["years_required_text"],
        "seniority": r["seniority"],
        "sponsorship_jd": r["sponsorship_jd"],
        "sponsorship_evidence": evidence,
        "summary": r["one_line_summary"],
        "red_flags": r["red_flags"],
        "status": F.when(reason.isNotNull(), "excluded").otherwise("scored"),
        "exclude_reason": reason,
        "description": F.when(reason.isNull(), F.col("description")),
    }
    columns = [F.when(got, values[c]).otherwise(F.col(c)).alias(c) if c in values else F.col(c) for c in store.columns]
    violated = got & ~T.evidence_is_verbatim(r["sponsorship_evidence"], F.col("description"))
    return out.select(*columns, got.alias("got_result"), violated.alias("evidence_violation"))


def score_tally(results: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """results: status, exclude_reason, evidence_violation, mode (batch or sync), tokens_in, tokens_out."""
    cost = F.lit(0.0)
    for mode, (price_in, price_out) in (("batch", config.batch_prices), ("sync", config.sync_prices)):
        mine = F.col("mode") == mode
        cost = cost + F.coalesce(F.sum(F.when(mine, F.col("tokens_in") * price_in + F.col("tokens_out") * price_out)), F.lit(0.0))
    return results.agg(
        F.count_if(F.col("status") == "scored").alias("scored"),
        F.count_if(F.col("exclude_reason") == "jd_no_sponsorship").alias("excluded_no_sponsorship"),
        F.count_if(F.col("exclude_reason") == "yoe_too_high").alias("excluded_yoe"),
        F.count_if("evidence_violation").alias("evidence_violations"),
        F.sum("tokens_in").alias("tokens_in"),
        F.sum("tokens_out").alias("tokens_out"),
        (cost / 1e6).alias("cost"),
    )


def collect_batches(batches: DataFrame, answers: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(answers of ended batches with their batch, the batches with those marked as ended). batches: batch_id, status,
    custom_id, ..., a row each member; answers: batch_id, custom_id, ended, ...; a batch that still runs keeps its ids in
    flight."""
    done = answers.filter("ended").select("batch_id").distinct()
    wanted = batches.filter("status = 'in_progress'").select("batch_id", "custom_id")
    found = answers.filter("ended").join(wanted, ["batch_id", "custom_id"], "left_semi")
    marked = batches.join(done.withColumn("_done", F.lit(True)), "batch_id", "left")
    status = F.when(F.col("_done") & (F.col("status") == "in_progress"), "ended").otherwise(F.col("status"))
    return found, marked.withColumn("status", status).select(*batches.columns)


def rank_update(store: DataFrame, config: Config = DEFAULT) -> DataFrame:
    ready = (F.col("status") == "scored") & F.col("posted_at").isNotNull() & F.col("fit_score").isNotNull()
    score = F.when(ready, rank_score(F.col("posted_at"), F.col("fit_score"), config)).otherwise(F.col("rank_score"))
    return store.select(*[score.alias(c) if c == "rank_score" else F.col(c) for c in store.columns])
