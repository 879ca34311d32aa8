"""Discovery of job boards from urls, and seeding from hiring comments."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rolespark.config import DEFAULT, Config
from rolespark.functions import text as T
from rolespark.functions.helpers import unescape
from rolespark.storage import written

TEST_TITLE = r"(?iuU)^\d+$|test|sandbox|bug\s*bash|do\s*not\s*apply|ignore\s*this"


def validate_boards(titles: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """Boards (key, valid) from landed titles (key, block, title): enough jobs, not blocked, and at most three in ten titles
    that look like tests."""
    found = titles.groupBy("key", "block").agg(F.count("*").alias("n"), F.avg(F.coalesce("title", F.lit("")).rlike(TEST_TITLE).cast("double")).alias("tests"))
    blocked = [f"{a}|{b}" for a, b in config.blocked_boards]
    return found.select("key", ((F.col("n") >= config.min_board_jobs) & (F.col("tests") <= 0.3) & ~F.col("block").isin(*blocked)).alias("valid"))


def _with_ref(rows: DataFrame) -> DataFrame:
    return rows.withColumn("ref", T.parse_ats_url(F.col("url"))).filter("ref is not null").withColumn("key", T.ref_key(F.col("ref")))


def discover_boards(candidates: DataFrame, companies: DataFrame, valid: DataFrame, excluded: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """New companies from candidates (company, title, url): matching title, a known kind of board, no staffing or excluded
    name or slug, no board that is listed already; one row a board (the least name), validated."""
    rows = _with_ref(candidates.filter(T.title_matches(F.col("title"), config)))
    staffing = list(config.staffing_companies)
    slug = F.coalesce(F.col("ref.slug"), F.col("ref.tenant"), F.lit(""))
    rows = rows.withColumns({"_norm": T.normalize_company(F.col("company")), "_name": T.normalize_excluded(F.col("company")), "_slug": T.normalize_excluded(slug)})
    rows = rows.filter(~F.col("_norm").isin(*staffing))
    for column in ("_name", "_slug"):
        rows = rows.join(excluded.select(F.col("name").alias(column)), column, "left_anti")
    rows = rows.join(companies.select(T.ref_key(F.struct("ats", "slug", "host", "tenant", "board")).alias("key")), "key", "left_anti")
    rows = rows.join(valid.filter("valid").select("key"), "key", "left_semi")
    first = rows.groupBy("key").agg(F.min(F.struct("company", "ref")).alias("v"))
    return first.select(F.col("v.company").alias("name"), "v.ref.*", F.lit("discovered").alias("source"))


def recent_threads(threads: DataFrame, n: int, prefix: str = "Ask HN: Who is hiring?") -> DataFrame:
    return threads.filter(F.col("title").startswith(prefix)).orderBy(F.col("created_at").desc(), "id").limit(n)


def seed_from_comments(comments: DataFrame, companies: DataFrame, valid: DataFrame, excluded: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """outcome (added, no_ats_link, already_present, or null for a row that is left out silently) for every comment (pos,
    text), with the company's entry where added. Rows are accepted in order when neither their board nor their name was
    before; a row blocked by its name does not use up its board. What competes is one row for each board and name, and
    each round accepts all rows that are first for both."""
    plain = unescape(F.regexp_replace(F.coalesce("text", F.lit("")), "<[^>]+>", " "))
    rows = comments.withColumns({"_urls": T.hrefs(unescape(F.coalesce("text", F.lit("")))), "_plain": plain})
    refs = rows.select("pos", F.posexplode("_urls").alias("_at", "url"))
    first = _with_ref(refs).groupBy("pos").agg(F.min_by(F.struct("ref", "key"), "_at").alias("_v")).select("pos", "_v.ref", "_v.key")
    rows = rows.join(first, "pos", "left")
    slug = F.coalesce(F.col("ref.slug"), F.col("ref.tenant"), F.lit(""))
    rows = rows.withColumn("name", T.guess_company_name(F.col("_plain"), F.coalesce(F.col("ref.slug"), F.col("ref.board"), F.lit("unknown"))))
    rows = rows.withColumns({"norm": T.normalize_company(F.col("name")), "_a": T.normalize_excluded(F.col("name")), "_b": T.normalize_excluded(slug)})
    keys = companies.select(T.ref_key(F.struct("ats", "slug", "host", "tenant", "board")).alias("key"), F.lit(True).alias("_key")).distinct()
    names = companies.select(T.normalize_company(F.col("name")).alias("norm"), F.lit(True).alias("_norm")).distinct()
    out = excluded.select("name").distinct()
    rows = rows.join(keys, "key", "left").join(names, "norm", "left").join(valid.filter("valid").select("key", F.lit(True).alias("_valid")), "key", "left")
    for column in ("_a", "_b"):
        rows = rows.join(out.select(F.col("name").alias(column), F.lit(True).alias(f"{column}x")), column, "left")
    dropped = F.col("_ax").isNotNull() | F.col("_bx").isNotNull() | (F.col("norm").isin(*config.staffing_companies) & F.col("_norm").isNull())
    state = F.when(F.col("ref").isNull(), "no_ats_link").when(F.col("_key"), "already_present").when(dropped, "dropped").when(F.col("_norm"), "already_present").otherwise("open")
    rows = rows.select("pos", "name", "norm", "key", "ref", state.alias("state"), F.coalesce("_valid", F.lit(False)).alias("_valid"))
    contest = written(rows.filter("state = 'open' and _valid").groupBy("key", "norm").agg(F.min("pos").alias("pos")), "contest")
    accepted = contest.limit(0)
    while not contest.isEmpty():
        least = lambda c: F.min("pos").over(Window.partitionBy(c))
        won = written(contest.withColumns({"_k": least("key"), "_n": least("norm")}).filter("pos = _k and pos = _n").select("key", "norm", "pos"), "won")
        accepted = accepted.unionByName(won)
        contest = written(contest.join(won.select("key"), "key", "left_anti").join(won.select("norm"), "norm", "left_anti"), "contest")
    by_key = accepted.select("key", F.col("pos").alias("_kp"))
    by_name = accepted.select("norm", F.col("pos").alias("_np"))
    rows = rows.join(by_key, "key", "left").join(by_name, "norm", "left")
    before = (F.col("_kp") < F.col("pos")) | (F.col("_np") < F.col("pos"))
    outcome = F.when(F.col("state").isin("no_ats_link", "already_present"), F.col("state")).when((F.col("state") == "open") & (F.col("_kp") == F.col("pos")), "added").when((F.col("state") == "open") & F.coalesce(before, F.lit(False)), "already_present")
    return rows.select("pos", outcome.alias("outcome"), "name", "ref")
