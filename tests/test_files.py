"""What is written and read again, and streams that run twice."""

from __future__ import annotations

import os
import shutil
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from rolespark import schemas
from rolespark.functions.dates import compute_since
from rolespark.plans import store
from rolespark.plans.workloads import ingest
from rolespark.queries import files, postings
from rolespark.queries.adapters import frame
from rolespark.sources import tables, versions
from rolespark.storage import remove_scratch, scratch_dir, written
from rolespark.streaming.ingest import first_seen_stream


@pytest.fixture(scope="module")
def small(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("small")
    spark.createDataFrame([(k, k % 5, float(k)) for k in range(1, 200)], "o_orderkey long, o_custkey long, o_totalprice double").write.parquet(f"{path}/orders.parquet")
    spark.createDataFrame([(k, f"Customer#{k:09d}", 0) for k in range(5)], "c_custkey long, c_name string, c_nationkey int").write.parquet(f"{path}/customer.parquet")
    return str(path)


def jobs_rows(n: int, first: int = 0, **values):
    """Raw postings: (source, ats_job_id, company, title, seq) and what values give to all of them."""
    return [{"source": "greenhouse", "ats_job_id": f"j{k}", "company": f"Company {k % 7}", "title": f"Data Scientist T{k}", "location": "New York, NY", "posted_at": datetime(2026, 5, 1), "seq": k, **values} for k in range(first, first + n)]


def raw_frame(spark, rows):
    return spark.createDataFrame([tuple(r.get(c) for c in RAW) for r in rows], ", ".join(f"{c} {t}" for c, t in RAW.items()))


RAW = {f.split()[0]: f.split()[1] for f in f"{schemas.RAW_JOB}, seq long".split(", ")}
SINCE, NOW = datetime(2026, 4, 25), datetime(2026, 5, 2)


def test_the_stream_gives_what_one_ingest_gives(spark, small):
    rows = files.ingest_stream(spark, small).collect()
    raw = schemas.conform(postings.raw(spark, small), f"{schemas.RAW_JOB}, seq long")
    history, excluded = frame(spark, small, "SELECT * FROM @history"), postings._excluded(spark)
    outcomes, jobs = ingest(raw, spark.createDataFrame([], schemas.JOB), postings.since(), postings.as_of(), history, excluded)
    assert rows and {(r.id, r.source, r.status) for r in rows} == {(r.id, r.source, r.status) for r in jobs.collect()}
    assert {(r.fetched, r.first_inserted, r.second_inserted, r.second_updated) for r in rows} == {(outcomes.count(), len(rows), 0, 0)}


def test_only_buckets_that_change_are_written(spark, tmp_path):
    root = str(tmp_path / "store")
    first = store.ingest_into(spark, root, raw_frame(spark, jobs_rows(200)), F.lit(SINCE), F.lit(NOW), buckets=16)
    assert len(first.rewritten) == 16 and first.counts["inserted"] == 200
    again = store.ingest_into(spark, root, raw_frame(spark, jobs_rows(200)), F.lit(SINCE), F.lit(NOW), buckets=16)
    assert again.rewritten == [] and again.counts["unchanged"] == 200
    assert again.version.tables["jobs"] == first.version.tables["jobs"] and again.version.tables["seen"] == first.version.tables["seen"]
    # one new row, and one that keeps its key under another title: it reads its own bucket and that of the stored row
    more = jobs_rows(1, 900) + [{**jobs_rows(1)[0], "title": "Applied Scientist"}]
    third = store.ingest_into(spark, root, raw_frame(spark, more), F.lit(SINCE), F.lit(NOW), buckets=16)
    assert len(third.rewritten) == 1 and len(third.read) <= 3 and third.counts["unchanged"] == 1
    old, new = first.version.tables["jobs"], third.version.tables["jobs"]
    assert [b for b in old if old[b] != new[b]] == [str(third.rewritten[0])]
    assert store.table(spark, root, "jobs").count() == 201
    assert [r.counts["inserted"] for r in store.table(spark, root, "runs").orderBy("finished_at").collect()] == [200, 0, 1]


def test_an_update_is_found_by_id_and_by_key(spark, tmp_path):
    root = str(tmp_path / "store")
    store.ingest_into(spark, root, raw_frame(spark, jobs_rows(20, source="jobspy_indeed")), F.lit(SINCE), F.lit(NOW), buckets=8)
    found = store.ingest_into(spark, root, raw_frame(spark, jobs_rows(20, url="https://x")), F.lit(SINCE), F.lit(NOW), buckets=8)
    assert found.counts["updated"] == 20
    other = [{**r, "title": r["title"].replace("Data", "Staff Data")} for r in jobs_rows(20)]
    found = store.ingest_into(spark, root, raw_frame(spark, other), F.lit(SINCE), F.lit(NOW), buckets=8)
    assert (found.counts["unchanged"], found.rewritten) == (20, [])
    assert {(r.source, r.url) for r in store.table(spark, root, "jobs").collect()} == {("greenhouse", "https://x")}


def test_one_of_two_writers_begins_again(spark, tmp_path):
    root = str(tmp_path / "table")
    base = versions.current(spark, root)
    first = versions.commit(spark, root, base, {"t": {"0": ["data/a"]}})
    with pytest.raises(versions.Conflict):
        versions.commit(spark, root, base, {"t": {"0": ["data/b"]}})
    (tmp_path / "table" / "_versions" / f"{first.number + 1:012d}").write_text("{")
    assert versions.current(spark, root) == first
    with pytest.raises(versions.Conflict):  # somebody is writing it
        versions.commit(spark, root, first, {"t": {"0": ["data/b"]}})


def test_old_versions_go(spark, tmp_path):
    root = str(tmp_path / "table")
    for k in range(4):
        tables.write_snapshot(spark.range(k + 1), root)
    before = versions.current(spark, root)
    assert versions.clean(spark, root, keep=2) == []  # too young
    assert len(versions.clean(spark, root, keep=2, hours=-1)) == 2
    assert versions.versions(spark, root) == [3, 4] and versions.current(spark, root) == before
    assert tables.read_snapshot(spark, root).count() == 4


def test_appended_pieces_are_merged(spark, tmp_path):
    root = str(tmp_path / "table")
    for k in range(20):
        base = versions.current(spark, root)
        made = versions.commit(spark, root, base, {"t": versions.append(spark.createDataFrame([(k,)], "k int"), root, base, "t", "k int", ["k"], 1)})
        assert len(made.pieces("t")) <= versions.MOST_PIECES
    assert sorted(r.k for r in versions.read(spark, root, made, "t", "k int").collect()) == list(range(20))


def test_first_sight_is_remembered(spark, tmp_path):
    """A board's first batch gets the baseline, a new id of a later batch as_of, an id seen before the baseline again. Only
    buckets of the batch are read, and a batch that is delivered again changes nothing."""
    when = datetime(2026, 5, 1)
    root, landed, out = str(tmp_path / "store"), str(tmp_path / "landed"), str(tmp_path / "out")
    found, read = [], []
    for number, ids in enumerate((["a"], ["a", "b"], ["b", "c"], [f"d{k}" for k in range(100)], ["a"])):
        rows = [{"source": "greenhouse", "ats_job_id": i, "company": "Acme", "undated": True, "seq": number} for i in ids]
        raw_frame(spark, rows).coalesce(1).write.mode("append").parquet(landed)
        before = versions.current(spark, root)
        read.append(sum(len(before.pieces(t, versions.touched(raw_frame(spark, rows), store.KEYS[t], 64))) for t in ("seen", "boards")))
        first_seen_stream(spark, landed, root, str(tmp_path / "checkpoint"), out, F.lit(when)).awaitTermination()
        seen = spark.read.parquet(out).filter(F.col("batch") == number)
        found.append({r.ats_job_id for r in seen.collect() if r.posted_at == when})
    assert found == [set(), {"b"}, {"c"}, {f"d{k}" for k in range(100)}, set()]
    assert read[4] <= 3  # of more than 60 buckets
    held = versions.current(spark, root)
    shutil.rmtree(tmp_path / "checkpoint" / "commits")
    shutil.copytree(tmp_path / "checkpoint" / "offsets", tmp_path / "offsets")
    first_seen_stream(spark, landed, root, str(tmp_path / "checkpoint"), out, F.lit(when)).awaitTermination()
    assert versions.current(spark, root) == held


def test_window_is_capped():
    now = datetime(2026, 5, 20, 12)
    for window in files.postings.DEFAULT.window_hours:
        config = files.postings.DEFAULT
        assert compute_since(now, window) == max(now - timedelta(hours=config.window_hours[window] + config.grace_hours), now - timedelta(days=config.max_age_days))


def lca_row(**values):
    row = dict.fromkeys(schemas.LCA_COLUMNS, "x") | {"TOTAL_WORKER_POSITIONS": "3", "WAGE_RATE_OF_PAY_FROM": "1.5", "DECISION_DATE": "2025-01-01"}
    return row | values


def test_read_lca_binds_columns_by_name_in_each_file(spark, tmp_path):
    names = list(schemas.LCA_COLUMNS)
    for k, order in enumerate((names, names[::-1], [*names[5:], "EXTRA", *names[:5]])):
        row = lca_row(CASE_NUMBER=str(k), EMPLOYER_NAME=f"Employer {k}", EXTRA="e")
        lines = [",".join(order), ",".join(row[c] for c in order)]
        (tmp_path / f"f{k}.csv").write_text("\n".join(lines) + "\n")
    row = lca_row(CASE_NUMBER="3", EMPLOYER_NAME="Employer 3")
    spark.createDataFrame([tuple(row[c] for c in names[::-1])], ", ".join(f"{c} string" for c in names[::-1])).write.parquet(str(tmp_path / "f3.parquet"))
    read = tables.read_lca(spark, [str(tmp_path / "f*.csv"), str(tmp_path / "f3.parquet")])
    rows = {r.CASE_NUMBER: r for r in read.collect()}
    assert {k: r.EMPLOYER_NAME for k, r in rows.items()} == {str(k): f"Employer {k}" for k in range(4)}
    assert {(r.TOTAL_WORKER_POSITIONS, r.WAGE_RATE_OF_PAY_FROM, r.DECISION_DATE) for r in rows.values()} == {(3, 1.5, datetime(2025, 1, 1))}
    assert [rows[str(k)].source_file for k in range(3)] == [f"f{k}.csv" for k in range(3)]


def test_read_lca_names_files_that_lack_columns(spark, tmp_path):
    names = list(schemas.LCA_COLUMNS)
    (tmp_path / "good.csv").write_text(",".join(names) + "\n")
    (tmp_path / "bad.csv").write_text(",".join(n for n in names if n != "VISA_CLASS") + "\n")
    with pytest.raises(ValueError, match="bad.csv: .'VISA_CLASS'.") as e:
        tables.read_lca(spark, str(tmp_path / "*.csv"))
    assert "good.csv" not in str(e.value)
    with pytest.raises(ValueError, match="no files"):
        tables.read_lca(spark, str(tmp_path / "none*.csv"))
    (tmp_path / "x.xlsx").write_text("")
    with pytest.raises(ValueError, match="x.xlsx"):
        tables.read_lca(spark, str(tmp_path / "x.xlsx"))


def test_scratch_tables_can_be_removed(spark):
    rows = written(spark.range(3), "three")
    folder = scratch_dir(spark)
    assert rows.count() == 3 and os.listdir(folder)
    remove_scratch(spark)
    assert not os.path.exists(folder)
    remove_scratch(spark)
    assert written(spark.range(2), "two").count() == 2


def test_a_run_writes_changed_rows_only(spark, tmp_path, monkeypatch):
    """Rows of the buckets that it reads are not copied to the scratch folder, and the batch is written once."""
    from rolespark.plans import store as plans

    seen = {}
    monkeypatch.setattr(plans, "written", lambda df, label, real=plans.written: seen.setdefault(label, real(df, label)))
    columns = "company string, source string, ats_job_id string, title string, location string, url string, posted_at timestamp, undated boolean, is_remote boolean, description_text string, description_html string, seq long"
    as_of, since = F.lit("2026-03-01").cast("timestamp"), F.lit("2026-02-01").cast("timestamp")
    rows = [("Acme", "lever", str(k), f"Data Scientist {'ab'[k]}", "Austin, TX", "u", None, False, False, "", None, k) for k in range(2)]
    for some, changed in ((rows[:1], 1), (rows, 1), (rows, 0)):
        seen.clear()
        plans.ingest_into(spark, str(tmp_path / "store"), spark.createDataFrame(some, columns), since, as_of, buckets=1)
        assert "prepared" not in seen and "rows" not in seen
        assert seen["changed"].count() == changed
    assert sorted(r.ats_job_id for r in plans.table(spark, str(tmp_path / "store"), "jobs").collect()) == ["0", "1"]
