"""Decisions on digested roles, the tracker, and the comparison of scores with decisions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rolespark.functions.text import normalize_company, title_norm, url_key


HEAD, DIGITS = 8, 6


def resolve_refs(refs: DataFrame, store: DataFrame) -> DataFrame:
    """refs (ref) with outcome (matched, ambiguous or missing), n_hits and, when matched, the job's id. A reference is an
    id, eight or more characters of its beginning, a url, or a number of six or more digits that begins a part of a url's
    path.

    One pass over the store gives each job's keys: the first eight characters of its id, its url, and the first six digits
    of the numbers in its url. References have the same keys, so one equi-join finds the candidates, and the rest of the
    text decides."""
    ref, number = F.col("ref"), F.col("_number")
    named = refs.select(F.trim("ref").alias("ref")).distinct().withColumn("_number", url_key(F.col("ref")))

    def key(kind: str, value: Column, whole: Column) -> Column:
        return F.struct(F.lit(kind).alias("kind"), value.alias("key"), whole.alias("whole"))

    wanted = named.select(
        "ref",
        F.inline(
            F.array_compact(
                F.array(
                    F.when(F.length(ref) >= HEAD, key("id", F.substring(ref, 1, HEAD), ref)),
                    F.when(ref != "", key("url", ref, ref)),
                    F.when(number.rlike(f"^[0-9]{{{DIGITS},}}$"), key("number", F.substring(number, 1, DIGITS), number)),
                )
            )
        ),
    )
    numbers = F.transform(F.array_distinct(F.regexp_extract_all("url", F.lit(rf"/(\d{{{DIGITS},}})"), F.lit(1))), lambda x: key("number", F.substring(x, 1, DIGITS), x))
    own = F.array(key("id", F.substring("id", 1, HEAD), F.col("id")), key("url", F.col("url"), F.col("url")))
    # ids and urls shorter than a head are found by the whole text only
    keys = store.select("id", F.inline(F.concat(own, F.coalesce(numbers, F.array().cast("array<struct<kind:string,key:string,whole:string>>"))))).withColumnRenamed("whole", "_whole")
    short = F.length("_whole") < HEAD
    hits = wanted.join(keys.filter(~((F.col("kind") == "id") & short)), ["kind", "key"]).filter(F.startswith("_whole", "whole"))
    tiny = named.filter(F.length("ref") < HEAD).join(store.select("id"), ref == F.col("id")).select("ref", "id")
    counted = hits.select("ref", "id").unionByName(tiny).distinct().groupBy("ref").agg(F.count("*").alias("n_hits"), F.min("id").alias("id"))
    n = F.coalesce("n_hits", F.lit(0))
    outcome = F.when(n == 0, "missing").when(n == 1, "matched").otherwise("ambiguous")
    return named.select("ref").join(counted, "ref", "left").select("ref", outcome.alias("outcome"), n.alias("n_hits"), F.when(n == 1, F.col("id")).alias("id"))


def apply_decisions(store: DataFrame, decisions: DataFrame, history: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(store, history) after decisions (id, decision applied or skipped, reason, decided_on), one for each id."""
    own = decisions.select("id", F.col("decision").alias("_d"), F.col("reason").alias("_r"), F.col("decided_on").alias("_on"))
    out = store.join(own, "id", "left")
    applied, skipped = F.col("_d") == "applied", F.col("_d") == "skipped"
    values = {
        "status": F.coalesce("_d", "status"),
        "applied_at": F.when(applied, F.col("_on")).otherwise(F.col("applied_at")),
        "exclude_reason": F.when(applied, None).when(skipped, skip_reason(F.col("_r"))).otherwise(F.col("exclude_reason")),
    }
    now = out.select(*[values.get(c, F.col(c)).alias(c) for c in store.columns])
    fresh = out.filter(applied).select(normalize_company(F.col("company")).alias("company_norm"), title_norm(F.col("title")).alias("title_norm"), F.col("_on").alias("applied_at"))
    return now, add_history(history, fresh.withColumn("source", F.lit("review")))


def skip_reason(reason: Column) -> Column:
    return F.when(F.coalesce(reason, F.lit("")) != "", F.concat(F.lit("skip:"), reason)).otherwise("skip")


def skip_rest(store: DataFrame, reason: str | None = None) -> DataFrame:
    hit = F.col("status") == "digested"
    values = {"status": F.when(hit, "skipped").otherwise(F.col("status")), "exclude_reason": F.when(hit, skip_reason(F.lit(reason))).otherwise(F.col("exclude_reason"))}
    return store.select(*[values.get(c, F.col(c)).alias(c) for c in store.columns])


def add_history(history: DataFrame, fresh: DataFrame) -> DataFrame:
    """history and those of fresh whose (company_norm, title_norm) it lacks; of equal ones the earliest."""
    keys = ["company_norm", "title_norm"]
    first = fresh.groupBy(*keys).agg(F.min_by(F.struct("applied_at", "source"), F.struct(F.col("applied_at").isNull(), "applied_at", "source")).alias("v"))
    return history.unionByName(first.join(history.select(*keys), keys, "left_anti").select(*keys, "v.applied_at", "v.source"))


def undecided(store: DataFrame) -> DataFrame:
    return store.filter("status = 'digested'").orderBy(F.col("posted_at").desc_nulls_last(), "id").select("id", "company", "title", "location", "posted_at", "url")


def v_tracker(store: DataFrame) -> DataFrame:
    c = F.col
    return store.filter("status = 'applied'").orderBy(c("applied_at").desc_nulls_first(), "id").select(
        c("company").alias("Company Name"),
        c("title").alias("Job Title"),
        F.coalesce(c("yoe_min").cast("string"), c("yoe_text"), F.lit("")).alias("Years of Exp required"),
        F.coalesce("sponsorship_jd", F.lit("Not Mentioned")).alias("Sponsorship Status"),
        c("applied_at").alias("Date of Application"),
        c("summary").alias("One-line summary of the role"),
        c("lca_filings").alias("LCA filings (FY25 to FY26)"),
        c("lca_relevant_soc").alias("Relevant SOC filings"),
    )


def tracker_lines(tracker: DataFrame) -> DataFrame:
    """Rows of a pipe table; bars inside a cell become slashes, nulls blanks."""
    cells = [F.replace(F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")), F.lit("|"), F.lit("/")) for c in tracker.columns]
    return tracker.select(F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |")).alias("line"))


def write_tracker(store: DataFrame, path: str) -> None:
    """path/csv with a header, path/table as lines. The tracker is one person's list, so each is one ordered file."""
    tracker = v_tracker(store)
    tracker.coalesce(1).write.mode("overwrite").option("header", True).csv(f"{path}/csv")
    head = tracker.sparkSession.createDataFrame([("| " + " | ".join(tracker.columns) + " |",), ("|" + "---|" * len(tracker.columns),)], "line string")
    head.coalesce(1).unionAll(tracker_lines(tracker)).coalesce(1).write.mode("overwrite").text(f"{path}/table")


def calibration_stats(store: DataFrame) -> DataFrame:
    """outcome, reason, n and the least, median and greatest fit: for applied, for skipped, and for each skip reason."""
    rows = store.filter(F.col("status").isin("applied", "skipped") & F.col("fit_score").isNotNull())
    rows = rows.select(F.col("status").alias("outcome"), F.coalesce("exclude_reason", F.lit("")).alias("reason"), "fit_score")
    sets = rows.groupingSets([["outcome"], ["outcome", "reason"]], "outcome", "reason").agg(
        F.count("*").alias("n"), F.min("fit_score").alias("least"), F.median("fit_score").alias("median"), F.max("fit_score").alias("greatest"), F.grouping("reason").alias("_all")
    )
    return sets.filter("_all = 1 or (outcome = 'skipped' and reason <> '')").drop("_all")


def calibration_cutoffs(store: DataFrame, first: int = 40, last: int = 80, step: int = 5) -> DataFrame:
    """For each cutoff how many applied and skipped rows it keeps, with the totals: every row adds to a few sums."""
    rows = store.filter(F.col("status").isin("applied", "skipped") & F.col("fit_score").isNotNull())
    done = {s: F.count_if(F.col("status") == s).alias(s) for s in ("applied", "skipped")}
    kept = [F.count_if((F.col("status") == s) & (F.col("fit_score") >= k)).alias(f"{s}_{k}") for k in range(first, last + 1, step) for s in ("applied", "skipped")]
    sums = rows.agg(*done.values(), *kept)
    each = [F.struct(F.lit(k).alias("cutoff"), F.col(f"applied_{k}").alias("kept_applied"), F.col("applied").alias("all_applied"), F.col(f"skipped_{k}").alias("kept_skipped"), F.col("skipped").alias("all_skipped")) for k in range(first, last + 1, step)]
    return sums.select(F.explode(F.array(*each)).alias("c")).select("c.*")


def run_log(runs: DataFrame, counts: dict[str, int], started: Column, finished: Column, window: str, sources: list[str], status: str = "ok", error: str | None = None) -> DataFrame:
    """runs and one more row."""
    spark = runs.sparkSession
    pairs = [x for k, n in counts.items() for x in (F.lit(k), F.lit(n).cast("long"))]
    made = F.create_map(*pairs) if pairs else F.create_map().cast("map<string,long>")
    row = spark.range(1).select(started.alias("started_at"), finished.alias("finished_at"), F.array(*map(F.lit, sources)).cast("array<string>").alias("sources"), F.lit(window).alias("window"), made.alias("counts"), F.lit(status).alias("status"), F.lit(error).cast("string").alias("error"))
    return runs.unionByName(row)
