"""From similarity to the digest, and decisions on it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rolespark.config import DC, NYC, PHILADELPHIA
from rolespark.functions import dates, labels, places
from rolespark.functions import text as T
from rolespark.operators import digest, review, scoring
from rolespark.queries import register
from rolespark.queries.adapters import AS_OF, frame



def as_of():
    return F.expr(AS_OF)
_QUERY = [((i * 37) % 19 - 9) / 10 for i in range(64)]
_DUCK_QUERY = "[" + ", ".join(map(str, _QUERY)) + "]::DOUBLE[]"
_VECTORS = f"SELECT 'v' || CAST(vec_id AS STRING) AS id, embedding, label % 3 = 0 AS is_nyc_metro, CASE WHEN vec_id % 9 = 0 THEN 'scored' ELSE 'new' END AS status FROM @embeddings"


def table(spark, sf_dir, name: str) -> DataFrame:
    return frame(spark, sf_dir, f"SELECT * FROM @{name}")


@register(f"SELECT vec_id, round(list_cosine_similarity(embedding::DOUBLE[], {_DUCK_QUERY}), 9) AS similarity FROM embeddings")
def similarity(spark, sf_dir):
    rows = frame(spark, sf_dir, "SELECT vec_id, embedding FROM @embeddings")
    return rows.select("vec_id", F.round(scoring.similarity(F.col("embedding"), _QUERY), 9).alias("similarity"))


@register(
    """SELECT vec_id, unnest(range(len(embedding))) AS pos, round(unnest(list_transform(embedding::DOUBLE[], lambda x: x / sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])))), 6) + 0.0e0 AS value
 FROM embeddings"""
)
def l2_normalize(spark, sf_dir):
    """Every component of every vector."""
    unit = frame(spark, sf_dir, "SELECT vec_id, embedding FROM @embeddings").select("vec_id", F.posexplode(scoring.l2_normalize(F.col("embedding"))).alias("pos", "value"))
    return unit.select("vec_id", F.col("pos").cast("long").alias("pos"), (F.round("value", 6) + 0.0).alias("value"))


@register(
    f"""WITH s AS (SELECT * EXCLUDE (embedding), list_cosine_similarity(embedding::DOUBLE[], {_DUCK_QUERY}) + 0.6 AS similarity FROM ({_VECTORS})),
 top AS (SELECT id FROM s WHERE status = 'new' AND similarity >= 0.5 ORDER BY is_nyc_metro DESC, similarity DESC, id LIMIT 60)
 SELECT id, CASE WHEN status <> 'new' THEN status WHEN id IN (SELECT id FROM top) THEN 'shortlisted' ELSE 'not_shortlisted' END AS status FROM s"""
)
def select_shortlist(spark, sf_dir):
    rows = frame(spark, sf_dir, _VECTORS).withColumn("similarity", scoring.similarity(F.col("embedding"), _QUERY) + 0.6).drop("embedding")
    return scoring.select_shortlist(rows).select("id", "status")


_FRESH = f"posted_at >= {AS_OF} - INTERVAL '14' DAY"


@register(f"SELECT id, similarity FROM (SELECT * FROM @store WHERE status = 'shortlisted' AND {_FRESH} AND k % 5 <> 1 ORDER BY is_nyc_metro DESC, similarity DESC NULLS LAST, id LIMIT 100) WHERE length(trim(description)) >= 200")
def load_shortlisted(spark, sf_dir):
    store = table(spark, sf_dir, "store")
    batches = store.filter("k % 5 in (1, 2)").select(F.when(F.col("k") % 5 == 1, "in_progress").otherwise("ended").alias("status"), F.col("id").alias("custom_id"))
    return scoring.load_shortlisted(store, batches, as_of(), 100).select("id", "similarity")


@register("SELECT id, similarity, is_nyc_metro, company, title FROM @store WHERE status = 'shortlisted' ORDER BY similarity DESC NULLS LAST, id LIMIT 10")
def top_shortlisted(spark, sf_dir):
    return scoring.top_shortlisted(table(spark, sf_dir, "store"))


@register("SELECT id AS custom_id, 'Company: ' || company || chr(10) || 'Title: ' || title || chr(10) || 'Location: ' || coalesce(location, 'unspecified') || chr(10) || chr(10) || 'Job description:' || chr(10) || description AS content FROM @store")
def build_score_requests(spark, sf_dir):
    made = scoring.build_score_requests(table(spark, sf_dir, "store"))
    return made.select("custom_id", F.get_json_object("request", "$.content").alias("content"))


# model answers by order: good ones, and one of each kind that is not usable
_ANSWER = """'{"years_required_min": ' || CASE WHEN o_orderkey % 5 = 0 THEN 'null' ELSE CAST(o_orderkey % 8 AS STRING) END || ', "years_required_text": "", "seniority": "' || CASE WHEN o_orderkey % 19 = 0 THEN 'boss' ELSE 'mid' END ||
 '", "sponsorship_jd": "' || CASE WHEN o_orderkey % 7 = 0 THEN 'N/A' ELSE 'Available' END || '", "sponsorship_evidence": "' || CASE WHEN o_orderkey % 4 = 1 THEN 'Python and SQL' WHEN o_orderkey % 4 = 2 THEN 'we will' ELSE '' END ||
 '", "required_skills": ["Python", "SQL", "machine  learning"' || CASE WHEN o_orderkey % 3 = 0 THEN ', "Spark"' ELSE '' END || '], "matched_skills": ["python"' || CASE WHEN o_orderkey % 2 = 0 THEN ', "Machine learning"' ELSE '' END ||
 CASE WHEN o_orderkey % 23 = 0 THEN ', "Cobol"' ELSE '' END || '], "experience_fit": ' || CAST(o_orderkey % 21 + CASE WHEN o_orderkey % 29 = 0 THEN 40 ELSE 0 END AS STRING) || ', "domain_fit": ' || CAST(o_orderkey % 16 AS STRING) ||
 CASE WHEN o_orderkey % 31 = 0 THEN '' ELSE ', "one_line_summary": "s"' END || ', "red_flags": []}'"""
_RESULTS = f"""SELECT sha1('j' || CAST(o_orderkey AS STRING)) AS custom_id, o_orderkey AS k, CASE WHEN o_orderkey % 37 = 0 THEN 'max_tokens' ELSE 'end_turn' END AS stop_reason,
 CASE WHEN o_orderkey % 41 = 0 THEN 'not json' ELSE {_ANSWER} END AS text FROM @orders"""
_INVALID = """CASE WHEN k % 37 = 0 THEN 'stopped' WHEN k % 41 = 0 OR k % 31 = 0 THEN 'fields' WHEN k % 19 = 0 THEN 'value' WHEN k % 29 = 0 THEN 'range' WHEN k % 23 = 0 THEN 'skills' END"""
_YEARS = "CASE WHEN k % 5 <> 0 THEN k % 8 END"
_SKILLS = "round_even(40.0 * CASE WHEN k % 2 = 0 THEN 2 ELSE 1 END / CASE WHEN k % 3 = 0 THEN 4 ELSE 3 END, 0)"
_POINTS = f"CAST({_SKILLS} AS BIGINT) + CASE WHEN coalesce({_YEARS}, 0) >= 5 THEN least(k % 21, 10) ELSE k % 21 END + k % 16"


def results(spark, sf_dir) -> DataFrame:
    return scoring.validate_score_result(frame(spark, sf_dir, _RESULTS))


@register(f"SELECT custom_id, {_INVALID} AS invalid FROM ({_RESULTS})")
def validate_score_result(spark, sf_dir):
    return results(spark, sf_dir).select("custom_id", "invalid")


@register(f"SELECT custom_id, {_POINTS} AS points FROM ({_RESULTS}) WHERE {_INVALID} IS NULL")
def core_points(spark, sf_dir):
    return results(spark, sf_dir).filter("invalid is null").select("custom_id", scoring.core_points(F.col("result")).cast("long").alias("points"))


_APPLIED = f"""SELECT id, CASE WHEN k % 7 = 0 OR coalesce({_YEARS}, 0) > 4 THEN 'excluded' ELSE 'scored' END AS status, CASE WHEN k % 7 = 0 THEN 'jd_no_sponsorship' WHEN coalesce({_YEARS}, 0) > 4 THEN 'yoe_too_high' END AS exclude_reason,
 {_POINTS} + 3 AS fit_score, CASE WHEN k % 4 = 1 THEN 'Python and SQL' WHEN k % 4 = 2 THEN 'we will' END AS sponsorship_evidence, k % 4 = 2 OR (k % 4 = 1 AND NOT contains(description, 'Python and SQL')) AS evidence_violation, k FROM @store WHERE {_INVALID} IS NULL"""


def applied(spark, sf_dir) -> DataFrame:
    valid = results(spark, sf_dir).filter("invalid is null").withColumn("location_points", F.lit(3)).select("custom_id", "result", "location_points")
    store = table(spark, sf_dir, "store").withColumns({"seniority": F.lit(None).cast("string"), "red_flags": F.array().cast("array<string>")})
    return scoring.apply_scores(store, valid).filter("got_result")


@register(f"SELECT id, status, exclude_reason, fit_score, sponsorship_evidence, evidence_violation FROM ({_APPLIED})")
def apply_scores(spark, sf_dir):
    return applied(spark, sf_dir).select("id", "status", "exclude_reason", "fit_score", "sponsorship_evidence", "evidence_violation")


@register(
    f"""SELECT count(*) FILTER (status = 'scored') AS scored, count(*) FILTER (exclude_reason = 'jd_no_sponsorship') AS excluded_no_sponsorship, count(*) FILTER (exclude_reason = 'yoe_too_high') AS excluded_yoe,
 count(*) FILTER (evidence_violation) AS evidence_violations, sum(1000 + k % 100)::BIGINT AS tokens_in, sum(k % 50)::BIGINT AS tokens_out, round(sum(CASE WHEN k % 6 = 0 THEN 1.0 * (1000 + k % 100) + 5.0 * (k % 50) ELSE 0.5 * (1000 + k % 100) + 2.5 * (k % 50) END) / 1e6, 6) AS cost FROM ({_APPLIED})"""
)
def score_tally(spark, sf_dir):
    rows = applied(spark, sf_dir).withColumns({"mode": F.when(F.col("k") % 6 == 0, "sync").otherwise("batch"), "tokens_in": 1000 + F.col("k") % 100, "tokens_out": F.col("k") % 50})
    return scoring.score_tally(rows).withColumn("cost", F.round("cost", 6))


@register("SELECT 'b' || CAST(k % 10 AS STRING) AS batch_id, id AS custom_id FROM @store WHERE k % 20 IN (2, 6)")
def collect_batches(spark, sf_dir):
    """Batches 0 to 8 in progress, of which the answers of 2 and 6 have ended; half of their ids were asked for."""
    store = table(spark, sf_dir, "store").withColumn("batch_id", F.concat(F.lit("b"), (F.col("k") % 10).cast("string")))
    batches = store.filter("k % 20 < 10").select("batch_id", F.lit("in_progress").alias("status"), F.col("id").alias("custom_id"))
    answers = store.select("batch_id", F.col("id").alias("custom_id"), (F.col("k") % 10).isin(2, 6).alias("ended"))
    return scoring.collect_batches(batches, answers)[0].select("batch_id", "custom_id")


@register("SELECT id, round(CASE WHEN status = 'scored' AND posted_at IS NOT NULL THEN -8919 - k % 21 + fit_score / 1000e0 END, 6) AS rank_score FROM @store")
def rank_update(spark, sf_dir):
    store = table(spark, sf_dir, "store").withColumn("rank_score", F.lit(None).cast("double"))
    return scoring.rank_update(store).select("id", F.round("rank_score", 6).alias("rank_score"))


@register("SELECT k, CASE WHEN posted_at IS NULL THEN 0 ELSE round_even(15 * greatest(1 - (k % 21 + 0.5) / 14, 0), 0)::BIGINT END AS recency, fit_score + CASE WHEN posted_at IS NULL THEN 0 ELSE round_even(15 * greatest(1 - (k % 21 + 0.5) / 14, 0), 0)::BIGINT END AS total FROM @store")
def recency_points(spark, sf_dir):
    fit = dates.display_fit(F.col("fit_score"), F.col("posted_at"), as_of())
    return table(spark, sf_dir, "store").select("k", fit["recency"].cast("long").alias("recency"), fit["total"].cast("long").alias("total"))


# points of the adapters' locations, as a gazetteer would give them
_LATLON = {"New York, NY": (NYC.lat, NYC.lon), "Jersey City, NJ": (40.7282, -74.0776), "Washington, DC": (DC.lat, DC.lon), "Philadelphia, PA": (PHILADELPHIA.lat, PHILADELPHIA.lon), "Austin, TX; New York, NY": (NYC.lat, NYC.lon), "San Francisco, CA": (37.7749, -122.4194)}


def with_points(df: DataFrame) -> DataFrame:
    empty = F.array().cast(places.POINTS)
    points = empty
    for name, (lat, lon) in _LATLON.items():
        points = F.when(F.col("location") == name, F.array(F.struct(F.lit(lat).alias("lat"), F.lit(lon).alias("lon")))).otherwise(points)
    return df.withColumn("points", points)


def _duck_miles(hub) -> str:
    cases = " ".join(f"WHEN '{n}' THEN 7917.6 * asin(sqrt(pow(sin(radians({hub.lat} - {lat}) / 2), 2) + cos(radians({lat})) * cos(radians({hub.lat})) * pow(sin(radians({hub.lon} - ({lon})) / 2), 2)))" for n, (lat, lon) in _LATLON.items())
    return f"CASE location {cases} END"


_NEAREST = f"least({_duck_miles(NYC)}, {_duck_miles(DC)})"
_METRO = f"CASE WHEN {_duck_miles(NYC)} <= 50 THEN 'nyc' WHEN least({_duck_miles(DC)}, {_duck_miles(PHILADELPHIA)}) <= 50 THEN 'corridor' END"
_PLACE_POINTS = f"CASE WHEN is_remote THEN 10 WHEN {_NEAREST} IS NULL THEN 0 WHEN {_NEAREST} <= 25 THEN 10 WHEN {_NEAREST} >= 250 THEN 0 ELSE round_even(10 * (250 - {_NEAREST}) / 225, 0)::BIGINT END"


@register(f"SELECT id, round({_NEAREST}, 4) AS miles, {_PLACE_POINTS} AS points, {_METRO} AS metro FROM @store")
def location_points(spark, sf_dir):
    rows = with_points(table(spark, sf_dir, "store"))
    p = F.col("points")
    return rows.select("id", F.round(places.nearest_miles(p), 4).alias("miles"), places.location_points(p, F.col("is_remote")).cast("long").alias("points"), places.metro_group(p).alias("metro"))


@register("SELECT name, state, lat, lon, population FROM (SELECT lower('City ' || CAST(c_custkey % 40 AS STRING)) AS name, 'S' || CAST(c_nationkey % 5 AS STRING) AS state, c_custkey * 0.01 AS lat, c_custkey * -0.02 AS lon, c_custkey AS population FROM customer) QUALIFY row_number() OVER (PARTITION BY name, state ORDER BY population DESC) = 1")
def read_gazetteer(spark, sf_dir):
    return places.read_gazetteer(frame(spark, sf_dir, "SELECT 'City ' || CAST(c_custkey % 40 AS STRING) AS name, 'S' || CAST(c_nationkey % 5 AS STRING) AS state, c_custkey * 0.01 AS lat, c_custkey * -0.02 AS lon, c_custkey AS population FROM @customer"))


@register(f"SELECT id, CASE location {' '.join(f'''WHEN '{n}' THEN {lat}''' for n, (lat, _) in _LATLON.items() if n != 'Jersey City, NJ')} END AS lat FROM @store")
def resolve_location(spark, sf_dir):
    """Location texts looked up in a gazetteer; New York and Washington by their aliases, Jersey City is not in it."""
    cities = [("new york city", "NY", NYC.lat, NYC.lon, 8_000_000), ("washington", "DC", DC.lat, DC.lon, 600_000), ("philadelphia", "PA", PHILADELPHIA.lat, PHILADELPHIA.lon, 1_500_000), ("san francisco", "CA", 37.7749, -122.4194, 800_000)]
    gazetteer = spark.createDataFrame(cities, "name string, state string, lat double, lon double, population long")
    states = {"NY": "new york", "PA": "pennsylvania", "CA": "california", "NJ": "new jersey", "TX": "texas"}
    found = places.with_points(table(spark, sf_dir, "store"), gazetteer, states)
    return found.select("id", F.get("points", F.lit(0))["lat"].alias("lat"))


_SELECTED = f"SELECT * FROM @ranked WHERE status = 'scored' AND rank_score IS NOT NULL AND fit_score >= 50 AND (yoe_min IS NULL OR yoe_min <= 4) AND {_FRESH} ORDER BY rank_score DESC, id LIMIT 30"
_GROUP = f"CASE WHEN ({_METRO}) = 'nyc' THEN 1 WHEN ({_METRO}) = 'corridor' THEN 2 WHEN is_nyc_metro AND {_NEAREST} IS NULL THEN 1 WHEN is_remote THEN 3 ELSE 4 END"
_COLLAPSED = f"""SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY role ORDER BY grp, coalesce(miles, 'infinity'::DOUBLE), rnk) AS pick_n, count(*) OVER (PARTITION BY role) - 1 AS others, min(rnk) OVER (PARTITION BY role) AS position FROM
 (SELECT *, company || '|' || title AS role, row_number() OVER (ORDER BY rank_score DESC, id) AS rnk, {_GROUP} AS grp, {_NEAREST} AS miles FROM ({_SELECTED}))) WHERE pick_n = 1"""
_PLACE = "CASE WHEN others > 0 THEN coalesce(location, 'Not stated') || ' (+' || others || ' other location' || CASE WHEN others > 1 THEN 's' ELSE '' END || ')' ELSE location END"
_NAMES = "CASE grp " + " ".join(f"WHEN {i} THEN '{g}'" for i, g in enumerate(digest.GROUPS, 1)) + " END"


def selected(spark, sf_dir) -> DataFrame:
    return digest.select_digest(table(spark, sf_dir, "ranked"), as_of())


@register(f"SELECT id, round(rank_score, 6) AS rank_score FROM ({_SELECTED})")
def select_digest(spark, sf_dir):
    return selected(spark, sf_dir).select("id", F.round("rank_score", 6).alias("rank_score"))


# one company, so that roles repeat and locations collapse
_ONE = f"SELECT * REPLACE ('Acme' AS company) FROM ({_SELECTED})"
_COLLAPSED = _COLLAPSED.replace(f"({_SELECTED})", f"({_ONE})")


def collapsed(spark, sf_dir) -> DataFrame:
    return digest.collapse_locations(with_points(selected(spark, sf_dir).withColumn("company", F.lit("Acme"))))


@register(f"SELECT id, {_PLACE} AS location, position FROM ({_COLLAPSED})")
def collapse_locations(spark, sf_dir):
    return collapsed(spark, sf_dir).select("id", "location", "position")


# the mark of other locations does not change the group: it is made from the points
@register(f'SELECT {_NAMES} AS "group", count(*) AS n_jobs FROM ({_COLLAPSED}) GROUP BY ALL')
def digest_groups(spark, sf_dir):
    return digest.digest_groups(collapsed(spark, sf_dir))


_AGE = "CASE k % 21 WHEN 0 THEN 'posted today' WHEN 1 THEN 'posted 1 day ago' ELSE 'posted ' || k % 21 || ' days ago' END"
_REC = "round_even(15 * greatest(1 - (k % 21 + 0.5) / 14, 0), 0)::BIGINT"
_LABELS = f"""company || ' - ' || title || CASE WHEN cap_exempt THEN ' [Cap-exempt]' ELSE '' END AS role, fit_score + {_REC} || '/100 (core ' || fit_score || '/85 + recency ' || {_REC} || '/15)' AS fit,
 CASE WHEN yoe_min IS NOT NULL THEN yoe_min || '+ years' ELSE coalesce(yoe_text, 'Not stated') END AS years, coalesce(sponsorship_jd, 'Not Mentioned') || CASE WHEN sponsorship_evidence <> '' THEN ' ("' || sponsorship_evidence || '")' ELSE '' END AS sponsorship,
 CASE WHEN lca_filings IS NULL THEN 'No filing history' ELSE lca_filings || ' LCA filings, ' || coalesce(lca_relevant_soc, 0) || ' in relevant SOC codes' END AS history"""


@register(f"SELECT id, grp AS group_number, row_number() OVER (PARTITION BY grp ORDER BY position) AS number, coalesce({_PLACE}, 'Not stated') || ' (' || {_AGE} || ')' AS place, {_LABELS} FROM ({_COLLAPSED})")
def digest_lines(spark, sf_dir):
    lines = digest.digest_lines(collapsed(spark, sf_dir), as_of())
    return lines.select("id", "group_number", "number", "place", "role", "fit", "years", "sponsorship", "history")


@register(f"SELECT id, {_AGE} AS age, {_LABELS} FROM @store WHERE posted_at IS NOT NULL")
def labels_of_jobs(spark, sf_dir):
    c = F.col
    return table(spark, sf_dir, "store").filter("posted_at is not null").select(
        "id", labels.posted_age(c("posted_at"), as_of()).alias("age"), labels.title_line(c("company"), c("title"), c("cap_exempt")).alias("role"), labels.fit_label(c("fit_score"), c("posted_at"), as_of()).alias("fit"),
        labels.yoe_label(c("yoe_min"), c("yoe_text")).alias("years"), labels.sponsorship_label(c("sponsorship_jd"), c("sponsorship_evidence")).alias("sponsorship"), labels.lca_label(c("lca_filings"), c("lca_relevant_soc")).alias("history"),
    )


@register(f"SELECT id, CASE WHEN id IN (SELECT id FROM ({_SELECTED})) THEN 'digested' ELSE status END AS status, CASE WHEN id IN (SELECT id FROM ({_SELECTED})) THEN {AS_OF} END AS digested_at FROM @ranked")
def mark_digested(spark, sf_dir):
    store = table(spark, sf_dir, "ranked").withColumn("digested_at", F.lit(None).cast("timestamp"))
    return digest.mark_digested(store, digest.select_digest(store, as_of()), as_of()).select("id", "status", "digested_at")


_SHOWN = "id, round(rank_score, 6) AS rank_score, fit_score, company, title, location, is_nyc_metro, is_remote, posted_at, yoe_min, sponsorship_jd, sponsorship_evidence, lca_filings, lca_relevant_soc, summary, url, status, cap_exempt"


@register(f"SELECT {_SHOWN} FROM @ranked WHERE status IN ('scored', 'digested') AND rank_score IS NOT NULL")
def v_daily_digest(spark, sf_dir):
    return digest.v_daily_digest(table(spark, sf_dir, "ranked")).withColumn("rank_score", F.round("rank_score", 6))


_REFS = f"""SELECT CASE o_orderkey % 8 WHEN 0 THEN sha1('j' || CAST(o_orderkey AS STRING)) WHEN 2 THEN ' ' || substr(sha1('j' || CAST(o_orderkey AS STRING)), 1, 12) WHEN 4 THEN
 CASE WHEN o_orderkey % 6 = 0 THEN 'https://x.example/jobs/view/some-name-' || CAST(4000000 + o_orderkey AS STRING) || '?track=9' ELSE 'https://b.example/' || CAST(1000000 + o_orderkey AS STRING) END
 ELSE 'nothing ' || CAST(o_orderkey AS STRING) END AS ref FROM @orders"""


@register(
    f"""WITH r AS (SELECT DISTINCT trim(ref) AS ref, coalesce(nullif(regexp_extract(ref, '/jobs/view/(?:[^/?]*-)?([0-9]{{6,}})', 1), ''), trim(ref)) AS key FROM ({_REFS})), j AS (SELECT id, url FROM @store),
 h AS (SELECT r.ref, j.id FROM r JOIN j ON r.ref = j.id UNION SELECT r.ref, j.id FROM r JOIN j ON length(r.ref) = 12 AND substr(j.id, 1, 12) = r.ref UNION SELECT r.ref, j.id FROM r JOIN j ON r.ref = j.url
  UNION SELECT r.ref, j.id FROM r JOIN j ON regexp_extract(j.url, '/([0-9]{{6,}})', 1) = r.key AND regexp_matches(r.key, '^[0-9]{{6,}}$')),
 n AS (SELECT ref, count(*) AS n_hits, min(id) AS id FROM h GROUP BY ref)
 SELECT r.ref, CASE coalesce(n_hits, 0) WHEN 0 THEN 'missing' WHEN 1 THEN 'matched' ELSE 'ambiguous' END AS outcome, coalesce(n_hits, 0) AS n_hits, CASE WHEN n_hits = 1 THEN id END AS id FROM r LEFT JOIN n ON r.ref = n.ref"""
)
def resolve_refs(spark, sf_dir):
    return review.resolve_refs(frame(spark, sf_dir, _REFS), table(spark, sf_dir, "store"))


_DECIDED = "k % 3 = 0 AND status = 'digested'"


@register(
    f"""SELECT id, CASE WHEN {_DECIDED} THEN CASE WHEN k % 2 = 0 AND k % 4 = 0 THEN 'applied' ELSE 'skipped' END ELSE status END AS status, CASE WHEN {_DECIDED} AND k % 4 = 0 THEN DATE '2001-08-01' ELSE applied_at END AS applied_at,
 CASE WHEN {_DECIDED} THEN CASE WHEN k % 4 = 0 THEN NULL WHEN k % 12 = 6 THEN 'skip:pay' ELSE 'skip' END ELSE exclude_reason END AS exclude_reason FROM @store"""
)
def apply_decisions(spark, sf_dir):
    store = table(spark, sf_dir, "store")
    decisions = store.filter(_DECIDED).select("id", F.when(F.col("k") % 4 == 0, "applied").otherwise("skipped").alias("decision"), F.when(F.col("k") % 12 == 6, "pay").alias("reason"), F.expr("DATE '2001-08-01'").alias("decided_on"))
    history = spark.createDataFrame([], "company_norm string, title_norm string, applied_at date, source string")
    return review.apply_decisions(store, decisions, history)[0].select("id", "status", "applied_at", "exclude_reason")


@register("SELECT id, CASE WHEN status = 'digested' THEN 'skipped' ELSE status END AS status, CASE WHEN status = 'digested' THEN 'skip:not_relevant' ELSE exclude_reason END AS exclude_reason FROM @store")
def skip_rest(spark, sf_dir):
    return review.skip_rest(table(spark, sf_dir, "store"), "not_relevant").select("id", "status", "exclude_reason")


@register("SELECT id, company, title, location, posted_at, url FROM @store WHERE status = 'digested'")
def undecided(spark, sf_dir):
    return review.undecided(table(spark, sf_dir, "store"))


@register(
    """SELECT company AS "Company Name", title AS "Job Title", coalesce(CAST(yoe_min AS VARCHAR), yoe_text, '') AS "Years of Exp required", coalesce(sponsorship_jd, 'Not Mentioned') AS "Sponsorship Status", applied_at AS "Date of Application",
 summary AS "One-line summary of the role", lca_filings AS "LCA filings (FY25 to FY26)", lca_relevant_soc AS "Relevant SOC filings" FROM @store WHERE status = 'applied'"""
)
def v_tracker(spark, sf_dir):
    return review.v_tracker(table(spark, sf_dir, "store"))


@register(
    """WITH r AS (SELECT status AS outcome, coalesce(exclude_reason, '') AS reason, fit_score FROM @store WHERE status IN ('applied', 'skipped'))
 SELECT outcome, NULL AS reason, count(*) AS n, min(fit_score) AS least, median(fit_score) AS median, max(fit_score) AS greatest FROM r GROUP BY outcome
 UNION ALL SELECT outcome, reason, count(*), min(fit_score), median(fit_score), max(fit_score) FROM r WHERE outcome = 'skipped' AND reason <> '' GROUP BY outcome, reason"""
)
def calibration_stats(spark, sf_dir):
    return review.calibration_stats(table(spark, sf_dir, "store"))


@register("SELECT cutoff, count(*) FILTER (status = 'applied' AND fit_score >= cutoff) AS kept_applied, count(*) FILTER (status = 'applied') AS all_applied, count(*) FILTER (status = 'skipped' AND fit_score >= cutoff) AS kept_skipped, count(*) FILTER (status = 'skipped') AS all_skipped FROM @store, (SELECT unnest(range(40, 81, 5)) AS cutoff) GROUP BY cutoff")
def calibration_cutoffs(spark, sf_dir):
    return review.calibration_cutoffs(table(spark, sf_dir, "store"))


@register("SELECT id, contains(lower(description), 'python and sql.') AS verbatim, length(trim(description)) >= 200 AS described, length(title || chr(10) || company || chr(10) || substr(description, 1, 2000)) AS text_chars FROM @store")
def description_checks(spark, sf_dir):
    c = F.col
    return table(spark, sf_dir, "store").select("id", T.evidence_is_verbatim(F.lit("Python  and\nSQL."), c("description")).alias("verbatim"), T.has_description(c("description")).alias("described"), F.length(T.job_text(c("title"), c("company"), c("description"))).alias("text_chars"))
