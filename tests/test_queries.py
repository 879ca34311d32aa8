"""The registered queries' inputs and results are whole."""

from __future__ import annotations

import random
import re

import pytest
from pyspark.sql import functions as F
from test_operators import shuffled

from rolespark.operators import filings as operators_of_filings
from rolespark.operators import review
from rolespark.operators import scoring as operators
from rolespark.queries import adapters, filings, payloads, scoring
from rolespark.schemas import SCORE_BATCHES
from rolespark.sources.payloads import read_landed


@pytest.fixture(scope="module")
def small(spark, tmp_path_factory):
    """Tables of 24 orders and 48 suppliers."""
    path = tmp_path_factory.mktemp("small")
    rows = [(k, k % 5, float(k)) for k in range(24)]
    spark.createDataFrame(rows, "o_orderkey long, o_custkey long, o_totalprice double").write.parquet(f"{path}/orders.parquet")
    spark.createDataFrame([(k, f"Customer#{k:09d}", 0) for k in range(5)], "c_custkey long, c_name string, c_nationkey int").write.parquet(f"{path}/customer.parquet")
    spark.createDataFrame([(k, f"Supplier#{k:09d}", 0) for k in range(1, 49)], "s_suppkey long, s_name string, s_nationkey int").write.parquet(f"{path}/supplier.parquet")
    return str(path)


def test_all_orders_are_read(spark, small):
    texts = ["SELECT k FROM @store", "SELECT k FROM @ranked", f"SELECT o_orderkey AS k {payloads._ORDERS}", f"SELECT k FROM ({scoring._RESULTS})", f"SELECT ref AS k FROM ({scoring._REFS})"]
    assert [adapters.frame(spark, small, text).distinct().count() for text in texts] == [24] * 5
    assert payloads.sitemap_urls(spark, small).count() == 24


def test_match_employer_has_every_step(spark, small):
    found = {r.company_norm: r for r in filings.match_employer(spark, small).collect()}
    steps = {r.match_source: 0 for r in found.values()}
    for r in found.values():
        steps[r.match_source] += 1
    assert steps == {"alias": 12, "exact": 12, "fuzzy": 12}
    for k in range(2, 49, 4):  # the own employer is the least of the partners with one edit in 17 + 18 characters
        r = found[f"{k:08d} supplier"]
        assert (r.lca_match_name, r.lca_match_score) == (f"Supplier#{k:09d}", pytest.approx(3400 / 35))


def test_batches_are_rows(spark, small):
    members = [("a", None, "in_progress", "x"), ("a", None, "in_progress", "y"), ("b", None, "in_progress", "z"), ("b", None, "in_progress", None), ("c", None, "ended", "w")]
    batches = spark.createDataFrame(members, SCORE_BATCHES)
    assert sorted(r.id for r in operators.in_flight(batches).collect()) == ["x", "y", "z"]
    answers = spark.createDataFrame([("a", "x", True), ("a", "other", True), ("b", "z", False), ("c", "w", True)], "batch_id string, custom_id string, ended boolean")
    found, marked = operators.collect_batches(batches, answers)
    assert [(r.batch_id, r.custom_id) for r in found.collect()] == [("a", "x")]
    assert sorted((r.custom_id or "", r.status) for r in marked.collect()) == [("", "in_progress"), ("w", "ended"), ("x", "ended"), ("y", "ended"), ("z", "in_progress")]
    for query in (scoring.load_shortlisted, scoring.collect_batches):
        assert "collect_list" not in query(spark, small)._jdf.queryExecution().toString()


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_an_answer_is_parsed_twice_at_most(spark, small):
    for query in (scoring.validate_score_result, scoring.apply_scores, scoring.score_tally, scoring.core_points):
        assert plan(query(spark, small)).count("from_json") <= 2


def test_references_take_one_pass_over_the_store(spark, small):
    """Besides the pass of references too short for a head, which reads ids only."""
    store = spark.createDataFrame([("abcdefgh12", "https://x/jobs/view/123456789"), ("abcdefgh34", "https://x/7654321"), ("short", None)], "id string, url string")
    refs = spark.createDataFrame([(r,) for r in ("abcdefgh", "abcdefgh1", " abcdefgh34 ", "short", "shor", "https://x/7654321", "https://y/jobs/view/a-123456789?t=1", "7654", "", None)], "ref string")
    found = {r.ref: (r.outcome, r.n_hits, r.id) for r in review.resolve_refs(refs, store).collect()}
    assert found["abcdefgh"] == ("ambiguous", 2, None) and found["abcdefgh1"] == ("matched", 1, "abcdefgh12") and found["abcdefgh34"] == ("matched", 1, "abcdefgh34")
    assert found["short"] == ("matched", 1, "short") and found["shor"][0] == found[""][0] == found["7654"][0] == "missing"
    assert found["https://x/7654321"] == ("matched", 1, "abcdefgh34")
    assert found["https://y/jobs/view/a-123456789?t=1"] == ("matched", 1, "abcdefgh12")
    joined = review.resolve_refs(refs, store)._jdf.queryExecution().toString()
    assert "Generate inline" in joined and "NestedLoop" not in joined and "CartesianProduct" not in joined


def test_median_by_ranks(spark):
    rng = random.Random(8)
    values = [None, 0.0, -1.5, 3.0, 1e9, 1e-9, float("inf"), *[round(rng.uniform(50_000, 50_300), 2) for _ in range(40)]]
    rows = [(k % 9 if k else None, rng.choice(values)) for k in range(900)] + [(77, 4.0), (88, None), (99, 1.0), (99, 2.0)]
    df = spark.createDataFrame(rows, "key int, v double")
    want = {r.key: r.m for r in df.groupBy("key").agg(F.median("v").alias("m")).collect() if r.m is not None}
    got = {r.key: r.median for r in operators_of_filings.grouped_median(df, "key", "v").filter("key is not null").collect()}
    assert got == pytest.approx({k: m for k, m in want.items() if k is not None})


def test_all_mappers_together_read_each_file_once(spark, small):
    """Every scan is of one system and kind, and no two are of the same."""
    text = payloads.map_all(spark, small)._jdf.queryExecution().sparkPlan().toString()
    scans = [line for line in text.splitlines() if "FileScan" in line]
    wanted = [tuple(re.findall(r"(?:ats|kind)#\d+ = (\w+)", line.split("PartitionFilters")[1])) for line in scans]
    assert len(wanted) == len(set(wanted)) >= 20 and all(len(w) == 2 for w in wanted)


def test_responses_are_landed_where_they_are_made(spark, tmp_path):
    """Only orders go through a shuffle, some 20 bytes each; all their responses took 900."""
    spark.range(2000).selectExpr("id AS o_orderkey", "id % 50 AS o_custkey", "CAST(id AS DOUBLE) AS o_totalprice").write.parquet(f"{tmp_path}/orders.parquet")
    spark.range(50).selectExpr("id AS c_custkey", "'Customer#' || id AS c_name", "0 AS c_nationkey").write.parquet(f"{tmp_path}/customer.parquet")
    before = shuffled(spark)
    payloads._land_all(spark, str(tmp_path), f"{tmp_path}/landed")
    assert shuffled(spark) - before < 100 * 2000
    landed = read_landed(spark, f"{tmp_path}/landed").groupBy("ats", "kind").count().collect()
    assert {(r.ats, r.kind): r["count"] for r in landed if r.ats in ("workday", "avature")} == {("workday", "list"): 4000, ("workday", "detail"): 2000, ("avature", "list"): 2000, ("avature", "detail"): 1000}
    assert len(landed) == 21


def test_references_without_a_semicolon_stay(spark, tmp_path):
    pages = [(1, "<p>a &amp;&amp</p><h1>b &lt; &lt</h1>"), (2, "x & y &#x27; &"), (3, None), (4, "&middot;&eacute;")]
    spark.createDataFrame(pages, "page_id long, html string").write.parquet(f"{tmp_path}/pages.parquet")
    assert {r.page_id: r.text for r in payloads.html_to_text(spark, str(tmp_path)).collect()} == {1: "a &&amp\nb < &lt", 2: "x & y ' &", 3: "", 4: "·é"}


def test_links_come_from_whole_pages_without_a_copy_of_them(spark, tmp_path):
    pages = [(1, '<a href="a?x=1&amp;y">1</a><a href=&quot;b&quot;>2</a><a href="">3</a>'), (2, "none"), (3, None)]
    spark.createDataFrame(pages, "page_id long, html string").write.parquet(f"{tmp_path}/pages.parquet")
    found = payloads.extract_urls(spark, str(tmp_path))
    assert {r.page_id: (r.n_links, r.first_link) for r in found.collect()} == {1: (2, "a?x=1&y"), 2: (0, None), 3: (None, None)}
    assert "unescape" not in plan(found)
