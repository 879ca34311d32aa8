"""Operators on small frames: ties, nulls, repeats, and properties such as upserting twice."""

from __future__ import annotations

import random
import time
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from rolespark import storage
from rolespark.functions import helpers, places
from rolespark.functions.helpers import sorted_ratio
from rolespark.operators import boards, filings, jobs, matching, review, scoring
from rolespark.plans import store, workloads
from rolespark.plans.workloads import ingest
from rolespark.schemas import JOB, LCA_COLUMNS, RAW_JOB
from rolespark.sources import payloads, tables


def as_of():
    return F.expr("TIMESTAMP '2026-03-01 12:00:00'")


def since():
    return F.expr("TIMESTAMP '2026-02-15 00:00:00'")


def filing(case, status="Certified", name="Acme Inc", decided=datetime(2025, 1, 1), source="a", soc="15-2051.00", wage=50.0, unit="Hour", state="NY", positions=1):
    return (case, status, "H-1B", name, soc, state, positions, wage, unit, decided, source)


def filings_frame(spark, rows):
    types = {"TOTAL_WORKER_POSITIONS": "int", "WAGE_RATE_OF_PAY_FROM": "double", "DECISION_DATE": "timestamp"}
    return spark.createDataFrame(rows, ", ".join(f"{c} {types.get(c, 'string')}" for c in LCA_COLUMNS) + ", source_file string")


def test_filings(spark):
    rows = [
        filing("1"),
        filing("1", status="Withdrawn", decided=datetime(2025, 2, 1)),  # a later withdrawal takes the case away
        filing("2", decided=datetime(2025, 1, 1)),
        filing("2", decided=None, source="b", wage=60.0),  # an undated copy counts as the latest
        filing("3", name="ACME, INC.", unit="Piece", state=" nj", positions=None),
        filing("4", name=None),
        filing("5", name="Acme Inc", soc=None, state=None),
    ]
    out = filings.employer_history(filings_frame(spark, rows)).collect()
    assert len(out) == 1
    r = out[0]
    assert (r.employer_norm, r.employer_raw, r.filings_total, r.filings_relevant_soc, r.positions_total, r.ny_nj_filings) == ("acme", "Acme Inc", 3, 2, 2, 2)
    assert (r.states, r.median_wage_relevant, str(r.last_decision_date), r.source_files) == (["NJ", "NY"], 60.0 * 2080, "2025-01-01", ["a", "b"])
    assert filings.employer_history(filings_frame(spark, [])).count() == 0


def test_fuzzy_is_brute_force(spark):
    rng = random.Random(3)
    words = ["alpha", "beta", "gamma systems", "data", "north star", "co", "x", "lab"]
    left = sorted({" ".join(rng.choices(words, k=rng.randint(1, 3))) for _ in range(60)})

    def blur(name: str) -> str:
        cut = rng.randrange(len(name))
        return (name[:cut] + rng.choice("abcxyz") + name[cut + rng.randint(0, 1) :]).strip()

    right = sorted({blur(n) for n in left for _ in range(2)})
    want = {(a, b) for a in left for b in right if sorted_ratio(a, b) >= 90}
    found = matching.fuzzy_pairs(spark.createDataFrame([(a,) for a in left], "left_name string"), spark.createDataFrame([(b,) for b in right], "right_name string"))
    assert {(r.left_name, r.right_name) for r in found.collect()} == want and want


def test_match_order(spark):
    employers = spark.createDataFrame([("acme", "Acme Inc", 10, 5, 1), ("acme labs", "Acme Labs", 3, 2, 0), ("globex data", "Globex Data", 4, 4, 4)], "employer_norm string, employer_raw string, filings_total long, filings_relevant_soc long, ny_nj_filings long")
    aliases = tables.aliases_frame(spark, {"Big Acme": ["Acme LLC", "Acme Labs", "Gone"], "Lost": "Gone", "acme": "nobody"})
    names = spark.createDataFrame([("big acme",), ("acme",), ("globex dat",), ("lost",), ("zzz",), (None,)], "company_norm string")
    found = {r.company_norm: r for r in matching.match_employer(names, employers, aliases).collect()}
    assert set(found) == {"big acme", "acme", "globex dat"}
    assert (found["big acme"].match_source, found["big acme"].filings_total, found["big acme"].entities) == ("alias", 13, ["Acme Inc", "Acme Labs"])
    assert found["acme"].match_source == "exact" and found["globex dat"].match_source == "fuzzy"


def raw_row(seq, source="lever", number="1", company="Acme", title="Data Scientist", location="Austin, TX", posted=datetime(2026, 2, 28), text="work", undated=False):
    return (source, number, company, title, location, False, f"u/{seq}", posted, None, text, undated, seq)


def raw_frame(spark, rows):
    return spark.createDataFrame(rows, f"{RAW_JOB}, seq long")


def test_prefilter_names_first_reason(spark):
    rows = [raw_row(1), raw_row(2, title="Cook", location="Paris, France"), raw_row(3, title="Data Science Manager"), raw_row(4, location="Paris, France"), raw_row(5, posted=None), raw_row(6, posted=datetime(2025, 1, 1)), raw_row(7, company="Robert Half Inc"), raw_row(8, text="Our client is big. No sponsorship"), raw_row(9, text="No visa sponsorship"), raw_row(10, text="6+ years of experience"), raw_row(11, title="AI Engineer"), raw_row(12, text=None), raw_row(13, company="Evil Technologies")]
    history = spark.createDataFrame([("acme", "ai engineer")], "company_norm string, title_norm string")
    excluded = spark.createDataFrame([("evil",)], "name string")
    out = {r.seq: r.reason for r in jobs.prefilter(jobs.normalize_jobs(raw_frame(spark, rows)), since(), history, excluded).collect()}
    assert out == {1: None, 2: "title_no_match", 3: "title_excluded", 4: "not_us", 5: "no_posted_at", 6: "stale", 7: "staffing_company", 8: "staffing_description", 9: "red_flag_description", 10: "yoe_too_high", 11: "already_applied", 12: None, 13: "excluded_company"}


def test_upsert_twice_changes_nothing(spark):
    empty = spark.createDataFrame([], JOB)
    rows = [raw_row(1, source="jobspy_indeed", number="i1"), raw_row(2, title="ML Engineer", number="2"), raw_row(3, title="AI Engineer", number="2"), raw_row(4, title="NLP", number=None), raw_row(5, location="Rome, Italy", number="5")]
    outcomes, store = ingest(raw_frame(spark, rows), empty, since(), as_of())
    assert {r.seq: r.outcome for r in outcomes.collect()} == {1: "inserted", 2: "inserted", 3: "unchanged", 4: "inserted", 5: "inserted"}
    store = spark.createDataFrame(store.collect(), JOB)
    again, same = ingest(raw_frame(spark, rows), store, since(), as_of())
    assert {r.outcome for r in again.filter("seq <> 3").collect()} == {"unchanged"}
    assert sorted(r.id for r in same.collect()) == sorted({*[r.id for r in store.collect()], *[r.id for r in again.filter("outcome = 'inserted'").collect()]})
    # a posting system's row takes over a scraped one, status and all other columns stay
    over, after = ingest(raw_frame(spark, [raw_row(9, source="greenhouse", number="g")]), store, since(), as_of())
    assert over.first().outcome == "updated"
    was, now = store.filter("ats_job_id = 'i1'").first(), after.filter("ats_job_id = 'g'").first()
    assert now.id == was.id and now.status == was.status and now.source == "greenhouse" and now.url == "u/9"


def test_dedup_batch(spark):
    rows = [("a", "lever", 1), ("a", "jobspy_x", 2), ("b", "jobspy_x", 3), ("b", "jobspy_y", 4), ("a", "ashby", 5)]
    out = jobs.dedup_batch(spark.createDataFrame(rows, "id string, source string, seq long")).collect()
    assert {(r.id, r.source, r.seq) for r in out} == {("a", "ashby", 1), ("b", "jobspy_y", 3)}


def test_undated(spark):
    store = spark.createDataFrame([("avature", "Acme", "1")], "source string, company string, ats_job_id string")
    rows = [raw_row(1, "avature", "1", posted=None, undated=True), raw_row(2, "avature", "2", posted=None, undated=True), raw_row(3, "avature", None, posted=None, undated=True), raw_row(4, "avature", "9", company="New", posted=None, undated=True), raw_row(5, "lever", "5")]
    out = {r.seq: r.posted_at.year for r in jobs.resolve_undated(raw_frame(spark, rows), store, as_of()).collect()}
    assert out == {1: 2000, 2: 2026, 3: 2000, 4: 2000, 5: 2026}


def test_places(spark):
    cities = [("new york city", "NY", 40.7, -74.0, 8_000_000), ("austin", "TX", 30.3, -97.7, 900_000), ("austin", "MN", 43.7, -93.0, 26_000), ("princeton", "NJ", 40.3, -74.6, 30_000), ("rochester", "NY", 43.2, -77.6, 200_000)]
    cities += [("rochester", "MN", 44.0, -92.5, 120_000), ("washington", "DC", 38.9, -77.0, 690_000), ("washington", "PA", 40.2, -80.2, 13_000), ("st. paul", "MN", 44.9, -93.1, 310_000)]
    gazetteer = spark.createDataFrame(cities, "name string, state string, lat double, lon double, population long")
    states = {"NY": "new york", "TX": "texas", "NJ": "new jersey", "WA": "washington", "MN": "minnesota", "PA": "pennsylvania"}
    wanted = {
        "Princeton - NJ - US": [40.3],
        "New York, New York": [40.7],
        "Rochester, New York": [43.2],
        "Rochester, MN": [44.0],
        "Rochester": [43.2],  # the greater of two
        "Austin, United States": [30.3],
        "Austin Minnesota": [43.7],
        "Princeton": [],  # no major city
        "in the office": [],
        "Austin, TX; Brooklyn; Mars": [30.3, 40.7],
        "Brooklyn;Austin, TX.": [40.7, 30.3],
        "Washington D.C.": [38.9],
        "Washington": [],  # the name of a state
        "Washington, PA": [],
        "St. Paul, MN": [44.9],
        "": [],
        ";;": [],
    }
    rows = [(k,) for k in wanted] * 2 + [(None,)]
    out = places.resolve_locations(spark.createDataFrame(rows, "location string"), gazetteer, states).collect()
    assert len(out) == len(wanted)
    assert {r.location: [p.lat for p in r.points] for r in out} == wanted


def test_seeding_is_the_greedy_loop(spark):
    rng = random.Random(5)
    rows = [(i, f"Name{rng.randrange(6)} | x <a href=&quot;https://jobs.lever.co/b{rng.randrange(6)}&quot;>y</a>") for i in range(25)] + [(99, "no link"), (100, None)]
    keys = {f"lever|b{k}": k != 5 for k in range(6)}
    valid = spark.createDataFrame(list(keys.items()), "key string, valid boolean")
    companies = spark.createDataFrame([("Name0", "lever", "b0")], "name string, ats string, slug string").selectExpr("*", "string(null) host", "string(null) tenant", "string(null) board")
    seen_keys, seen_names, want = {"lever|b0"}, {"name0"}, {}
    for pos, text in rows:
        if not text or "href" not in text:
            want[pos] = "no_ats_link"
            continue
        name, key = text.split(" |")[0].lower(), "lever|" + text.split("lever.co/")[1].split("&")[0]
        if key in seen_keys or name in seen_names:
            want[pos] = "already_present"
        elif keys[key]:
            want[pos] = "added"
            seen_keys.add(key)
            seen_names.add(name)
        else:
            want[pos] = None
    out = boards.seed_from_comments(spark.createDataFrame(rows, "pos long, text string"), companies, valid, spark.createDataFrame([], "name string"))
    assert {r.pos: r.outcome for r in out.collect()} == want and "added" in want.values()


@pytest.mark.parametrize(
    ("change", "reason"),
    [({}, None), ({"years_required_min": None}, None), ({"seniority": "boss"}, "value"), ({"domain_fit": 16}, "range"), ({"domain_fit": "many"}, "fields"), ({"matched_skills": ["Go"]}, "skills"), ({"required_skills": [str(i) for i in range(13)], "matched_skills": []}, "too_many_skills"), ({"drop": "summary"}, "fields")],
)
def test_results(spark, change, reason):
    import json

    body = {"years_required_min": 3, "years_required_text": "3", "seniority": "mid", "sponsorship_jd": "Available", "sponsorship_evidence": "", "required_skills": ["Python", "SQL"], "matched_skills": [" python"], "experience_fit": 12, "domain_fit": 5, "one_line_summary": "s", "red_flags": []}
    body |= {k: v for k, v in change.items() if k != "drop"}
    if "drop" in change:
        del body["one_line_summary"]
    df = spark.createDataFrame([("1", "end_turn", json.dumps(body))], "custom_id string, stop_reason string, text string")
    row = scoring.validate_score_result(df).withColumn("points", scoring.core_points(F.col("result"))).first()
    assert row.invalid == reason
    if not change:
        assert row.points == 20 + 12 + 5


def test_refs(spark):
    store = spark.createDataFrame([("abcdef1234", "https://x/jobs/view/a-1234567?t=1"), ("abcdef1299", "https://y/2")], "id string, url string")
    refs = spark.createDataFrame([(r,) for r in (" abcdef1234 ", "abcdef12", "abc", "https://z/jobs/view/title-1234567?u=2", "https://y/2", "nope")], "ref string")
    got = {r.ref: (r.outcome, r.id) for r in review.resolve_refs(refs, store.unionByName(store.limit(0))).collect()}
    assert got == {"abcdef1234": ("matched", "abcdef1234"), "abcdef12": ("ambiguous", None), "abc": ("missing", None), "https://z/jobs/view/title-1234567?u=2": ("missing", None), "https://y/2": ("matched", "abcdef1299"), "nope": ("missing", None)}


def test_snapshots_and_readers(spark, tmp_path):
    root = str(tmp_path / "t")
    tables.write_snapshot(spark.createDataFrame([(1,)], "a int"), root)
    tables.write_snapshot(tables.read_snapshot(spark, root).selectExpr("a + 1 as a"), root)
    assert tables.read_snapshot(spark, root).collect() == [(2,)]
    assert tables.read_excluded(spark, str(tmp_path / "none.txt")).count() == 0
    with pytest.raises(ValueError, match="missing columns"):
        tables.import_tracker(spark.createDataFrame([("a",)], "`Company Name` string"), spark.createDataFrame([], "company_norm string, title_norm string, applied_at date, source string"))


def test_broken_payloads(spark):
    columns = "company string, host string, tenant string, board string, slug string, site string, kind string, key string, term string, page int, payload string, fetched_at timestamp, ats string"
    rows = [("c", None, None, None, None, None, kind, None, "t", 0, payload, None, ats) for ats in payloads.MAPPERS for kind in ("list", "detail", "page", "sitemap") for payload in (None, "", "{", "[]", "{}", "<p>")]
    assert payloads.map_all(spark.createDataFrame(rows, columns), since()).count() == 0


def test_a_system_of_many_small_pages_is_split(spark, tmp_path):
    """Else one task parses them all, however many there are."""
    pages = spark.range(120_000).select(F.lit("<p>").alias("payload"), F.lit("icims").alias("ats"), F.lit("list").alias("kind"))
    payloads.land(pages, str(tmp_path / "landed"))
    assert len(list((tmp_path / "landed").glob("ats=icims/kind=list/*.parquet"))) >= 3


def test_terms_are_dealt_once(spark):
    """The join with details takes the postings as the dedup across terms has dealt them."""
    plan = payloads._first_of_terms(spark.createDataFrame([], "company string, posting string, term string, page int, pos int")).join(
        spark.createDataFrame([], "company string, posting string, d string").hint("merge"), ["company", "posting"], "left"
    )
    assert plan._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 2


def common_word_names(rng, n):
    """Names of an invented word or two and one or two of a few common ones."""
    common = "systems solutions group global services partners digital technology consulting capital health data labs networks media".split()
    invented = lambda: "".join(rng.choice("bdfgklmnprstvz") + rng.choice("aeiou") for _ in range(rng.randint(2, 4)))
    return [" ".join([*(invented() for _ in range(rng.randint(1, 2))), *rng.sample(common, rng.randint(1, 2))]) for _ in range(n)]


def edited(rng, name):
    i = rng.randrange(len(name))
    return name[:i] + rng.choice("aeiou") + name[i + rng.randint(0, 1) :]


def test_best_partner_by_rounds_is_the_best_of_all(spark):
    rng = random.Random(11)
    right = common_word_names(rng, 150)
    left = [*[edited(rng, edited(rng, x)) for x in right[:80]], *[edited(rng, x) for x in right[40:120]], *common_word_names(rng, 40), None, ""]
    frames = [spark.createDataFrame([(k % 2, x) for k in (0, 1) for x in xs], f"g int, {c} string") for xs, c in ((left, "left_name"), (right, "right_name"))]
    every = matching.fuzzy_pairs(*frames, 90.0, ["g"]).collect()
    want = {}
    for r in every:
        key = (r.g, r.left_name)
        if key not in want or (-r.score, r.right_name) < (-want[key][1], want[key][0]):
            want[key] = (r.right_name, r.score)
    found = matching.fuzzy_match_topone(*frames, 90.0, ["g"], bounds=(98.0, 95.0))
    assert {(r.g, r.left_name): (r.right_name, r.score) for r in found.collect()} == want and len(want) > 200


def test_titles_of_a_large_company_are_not_all_compared(spark, monkeypatch):
    rng = random.Random(12)
    monkeypatch.setattr(matching, "DIRECT_TITLES", 20)
    titles = list(dict.fromkeys(common_word_names(rng, 3000)))
    rows = [("big", edited(rng, t)) for t in titles[:300]] + [("big", t) for t in titles[:10]] + [("small", "data engineer ii"), ("small", "line cook"), ("none", titles[0]), ("big", None), (None, titles[0])]
    history = spark.createDataFrame([("big", t) for t in titles] + [("small", "data engineer iii"), ("small", None)], "company_norm string, title_norm string")
    jobs = spark.createDataFrame(rows, "company_norm string, title_norm string")
    score = helpers.token_sort_ratio
    pairs = jobs.distinct().join(history.withColumnRenamed("title_norm", "known"), "company_norm")
    want = {(r.company_norm, r.title_norm) for r in pairs.filter("title_norm is not null and known is not null").filter(score("title_norm", "known") >= 90).collect()}
    found = matching.already_applied(jobs, history).collect()
    assert {tuple(r) for r in found} == want and len(found) == len(want) > 200
    scored = matching.fuzzy_candidates(jobs.filter("company_norm = 'big'").withColumnRenamed("title_norm", "left_name"), history.withColumnRenamed("title_norm", "right_name"), 90.0, ["company_norm"])
    assert scored.count() < 0.02 * 310 * len(titles)


def test_substrings_of_names_are_not_broadcast(spark):
    names = spark.createDataFrame([(f"name {k} of one",) for k in range(50)], "name string")
    found = matching.fuzzy_match_topone(names.withColumnRenamed("name", "left_name"), names.withColumnRenamed("name", "right_name"), bounds=())
    assert len(found.collect()) == 50
    assert "BroadcastHashJoin" not in found._jdf.queryExecution().executedPlan().toString()


def shuffled(spark) -> int:
    """Bytes that this session has written into shuffles."""
    context = spark.sparkContext._jsc.sc()
    context.listenerBus().waitUntilEmpty()
    found = context.statusStore().executorList(False)
    return sum(found.apply(k).totalShuffleWrite() for k in range(found.size()))


def test_substrings_are_dealt_out_as_hashes_of_pieces(spark):
    """Names of 43 characters have some hundred substrings; with the names dealt out beside each they took 11 KB a name."""
    rng = random.Random(13)
    right = [f"large ring {rng.randrange(16**32):032x}" for _ in range(3000)]
    frames = [spark.createDataFrame([(x,) for x in xs], f"{c} string") for xs, c in (([x[:-2] for x in right], "left_name"), (right, "right_name"))]
    before = shuffled(spark)
    found = matching.fuzzy_match_topone(*frames)
    assert {(r.left_name, r.right_name) for r in found.collect()} == {(x[:-2], x) for x in right}
    assert shuffled(spark) - before < 5_000 * len(right)


@pytest.mark.parametrize("sizes", [(40, 400), (400, 40)])
def test_either_side_may_be_cut(spark, sizes):
    rng = random.Random(14)
    names = common_word_names(rng, max(sizes))
    left, right = [edited(rng, x) for x in names[: sizes[0]]], [*names[: sizes[1] - 1], names[0].upper()]
    frames = [spark.createDataFrame([(g, x) for g in ("a", "b", None) for x in xs], f"g string, {c} string") for xs, c in ((left, "left_name"), (right, "right_name"))]
    want = {(g, x, y) for g in "ab" for x in left for y in right if helpers.sorted_ratio(x, y) >= 88}
    assert {(r.g, r.left_name, r.right_name) for r in matching.fuzzy_pairs(*frames, 88.0, ["g"]).collect()} == want and len(want) > 70


def test_employers_do_not_repeat_the_dedup(spark):
    rows = [filing("1"), filing("2", name="ACME, INC."), filing("3", name=None)]
    text = filings.employer_history(filings_frame(spark, rows))._jdf.queryExecution().optimizedPlan().toString()
    assert "CASE_NUMBER" not in text


def test_only_undecided_texts_go_to_the_rule_on_years(spark):
    """A text of a row that an earlier rule fails is not sent to Python."""
    row = dict(seq=1, company="Acme", title="Data Scientist", location="New York, NY", is_remote=False, posted_at=datetime(2025, 1, 2), description_text="Requires 9 years of experience.")
    rows = [row, row | {"seq": 2, "title": "Line Cook"}, row | {"seq": 3, "description_text": "3 years of experience"}, row | {"seq": 4, "posted_at": None}]
    raw = spark.createDataFrame(rows, "seq long, company string, title string, location string, is_remote boolean, posted_at timestamp, description_text string")
    out = jobs.prefilter(jobs.normalize_jobs(raw), F.lit(datetime(2025, 1, 1)))
    assert {r.seq: r.reason for r in out.collect()} == {1: "yoe_too_high", 2: "title_no_match", 3: None, 4: "no_posted_at"}
    text = out._jdf.queryExecution().optimizedPlan().toString()
    assert "min_years_required(CASE WHEN (isnull(_early" in text


def test_names_are_made_once_and_short_lists_deal_no_jobs(spark):
    """With a history the rules read the normalized rows, not the regular expressions a second time."""
    rows = jobs.normalize_jobs(spark.createDataFrame([], RAW_JOB))
    history = spark.createDataFrame([("acme", "data scientist")], "company_norm string, title_norm string")
    plan = jobs.prefilter(rows, since(), history, spark.createDataFrame([("other",)], "name string"))._jdf.queryExecution().optimizedPlan().toString()
    assert "incorporated|inc" not in plan
    # scans of files: the jobs, the list, and the names that the history is asked for; the history itself is the caller's
    assert plan.count("LogicalRDD") == sum("LogicalRDD" in line and "company_norm" in line for line in plan.splitlines())


def test_dated_rows_are_not_dealt_out_for_the_undated(spark):
    rng = random.Random(15)
    rows = [("s", f"c{k % 5}", str(k), k < 10, None if k < 20 else datetime(2025, 1, 1), f"{rng.randrange(16**200):x}") for k in range(3000)]
    raw = spark.createDataFrame(rows, "source string, company string, ats_job_id string, undated boolean, posted_at timestamp, description_text string")
    known = spark.createDataFrame([("s", "c1", "1")], "source string, company string, ats_job_id string").hint("merge")
    before = shuffled(spark)
    found = jobs.date_at_first_sight(raw, known, known.select("source", "company").hint("merge"), F.lit(datetime(2025, 2, 2))).collect()
    assert shuffled(spark) - before < 20_000
    first = {"1": jobs.BASELINE, "6": datetime(2025, 2, 2)}  # of the boards only c1 was seen, and its number 1
    want = {r[2]: first.get(r[2], jobs.BASELINE) if r[3] else r[4] for r in rows}
    assert {r.ats_job_id: r.posted_at for r in found} == want and len(found) == len(rows)


def test_duplicates_go_before_the_rules(spark, monkeypatch):
    given = []
    monkeypatch.setattr(jobs, "prefilter", lambda rows, *rest, f=jobs.prefilter: (given.append(rows.count()), f(rows, *rest))[1])
    row = dict(company="Acme", title="Data Scientist", location="New York, NY", is_remote=False, posted_at=datetime(2025, 1, 2), description_text="x")
    rows = [row | {"seq": k, "source": s, "ats_job_id": str(k)} for k, s in enumerate(("jobspy_indeed", "lever", "lever", "jobspy_indeed"))] + [row | {"seq": 4, "source": "lever", "ats_job_id": "4", "title": "Line Cook"}]
    raw = spark.createDataFrame(rows, "seq long, source string, ats_job_id string, company string, title string, location string, is_remote boolean, posted_at timestamp, description_text string")
    found = workloads.prepare(raw, F.lit(datetime(2025, 1, 1)))
    assert {(r.ats_job_id, r.seq, r.status, r.exclude_reason) for r in found.collect()} == {("2", 0, "new", None), ("4", 4, "excluded", "title_no_match")}
    assert given == [2]


def test_a_run_leaves_no_shuffles_behind(spark, tmp_path):
    def held() -> int:
        blocks = spark.sparkContext._jsc.sc().env().blockManager().diskBlockManager().getAllBlocks()
        return sum(blocks.apply(k).isShuffle() for k in range(blocks.size()))

    rows = spark.range(200).selectExpr("id AS seq", "'lever' AS source", "CAST(id AS STRING) AS ats_job_id", "'Acme ' || id AS company", "'Data Scientist' AS title", "'New York, NY' AS location", "false AS is_remote", "'u' AS url", "TIMESTAMP '2025-01-02' AS posted_at", "'x' AS description_text", "false AS undated")
    before, setting = held(), spark.conf.get(storage._CLEANUP)
    for _ in range(2):
        run = store.ingest_into(spark, str(tmp_path / "store"), rows, F.lit(datetime(2025, 1, 1)), F.lit(datetime(2025, 1, 3)), buckets=4)
        end = time.monotonic() + 10  # files go in the background
        while held() > before and time.monotonic() < end:
            time.sleep(0.1)
        assert held() <= before and spark.conf.get(storage._CLEANUP) == setting
    assert run.counts["unchanged"] == 200 and store.table(spark, str(tmp_path / "store"), "jobs").count() == 200


def test_turns_are_counted_under_the_join_by_keys(spark):
    batch = spark.createDataFrame([], "id string, source string, ats_job_id string, seq long").hint("merge")
    found = jobs.upsert_outcomes(batch, spark.createDataFrame([], "id string, source string, ats_job_id string"))
    plan = found._jdf.queryExecution().executedPlan().toString()
    above = plan[plan.index("row_number") : plan.index("SortMergeJoin")]
    assert "Exchange" not in above
