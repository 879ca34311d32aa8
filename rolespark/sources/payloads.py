"""Mappers from landed responses to raw postings.

Responses land as rows (company, host, tenant, board, slug, site, kind, key, term, page, payload, fetched_at): kind is
list, detail, sitemap or page; key names what a detail is about; term and page order the search pages. Every mapper
keeps rows whose title matches and whose date, where there is one, is not before since."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rolespark.config import DEFAULT, Config
from rolespark.functions import helpers as H
from rolespark.functions.text import title_matches
from rolespark.operators.jobs import dedup_terms
from rolespark.schemas import RAW_JOB, conform

BOARD = ["company", "host", "tenant", "board", "slug", "site"]


def iso_time(text: Column) -> Column:
    """An ISO date or time; without a zone it is UTC (the session's zone)."""
    return text.try_cast("timestamp")


def filled(text: Column) -> Column:
    """Null for an empty string."""
    return F.nullif(text, F.lit(""))


def _items(landed: DataFrame, kind: str, schema: str, items) -> DataFrame:
    """One row an item: the board's columns, term, page, pos, fetched_at and item."""
    parsed = landed.filter(F.col("kind") == kind).withColumn("_p", F.from_json("payload", schema))
    return parsed.select(*BOARD, "key", "term", "page", "fetched_at", F.posexplode(items(F.col("_p"))).alias("pos", "item"))


def _details(landed: DataFrame, schema: str) -> DataFrame:
    """company, key and detail: one detail for each posting of a board."""
    parsed = landed.filter("kind = 'detail'").select("company", "key", F.from_json("payload", schema).alias("detail"))
    return parsed.groupBy("company", "key").agg(F.any_value("detail").alias("detail"))


def _with_detail(items: DataFrame, landed: DataFrame, schema: str) -> DataFrame:
    return items.join(_details(landed, schema).withColumnRenamed("key", "posting"), ["company", "posting"], "left")


def _first_of_terms(items: DataFrame) -> DataFrame:
    """Dealt by the columns that details are joined by, so that the join deals them no second time."""
    return dedup_terms(items, ["company", "posting"], ["term", "page", "pos"])


def _finish(rows: DataFrame, since: Column, config: Config) -> DataFrame:
    kept = rows.filter(title_matches(F.col("title"), config) & (F.col("posted_at").isNull() | (F.col("posted_at") >= since)))
    return conform(kept.withColumns({"is_remote": F.coalesce("is_remote", F.lit(False)), "url": F.coalesce("url", F.lit(""))}), RAW_JOB)


def map_greenhouse(landed: DataFrame, since: Column, config: Config = DEFAULT) -> DataFrame:
    item = "struct<id:long,title:string,first_published:string,content:string,absolute_url:string,location:struct<name:string>>"
    rows = _items(landed, "list", f"jobs array<{item}>", lambda p: p["jobs"]).withColumn("posting", F.col("item.id").cast("string"))
    rows = _with_detail(rows.filter(title_matches(F.col("item.title"), config)), landed, "first_published string")
    html = H.unescape(F.coalesce("item.content", F.lit("")))
    rows = rows.select("company", F.lit("greenhouse").alias("source"), F.col("posting").alias("ats_job_id"), F.col("item.title").alias("title"), F.col("item.location.name").alias("location"), F.lit(False).alias("is_remote"), F.col("item.absolute_url").alias("url"), F.coalesce(iso_time(F.col("item.first_published")), iso_time(F.col("detail.first_published"))).alias("posted_at"), html.alias("description_html"))
    return _finish(rows.withColumn("description_text", H.html_to_text("description_html")), since, config)


def map_lever(landed: DataFrame, since: Column, config: Config = DEFAULT) -> DataFrame:
    schema = "array<struct<id:string,text:string,createdAt:long,categories:struct<location:string>,workplaceType:string,hostedUrl:string,description:string,descriptionPlain:string>>"
    rows = _items(landed, "list", schema, lambda p: p)
    i = lambda c: F.col(f"item.{c}")
    rows = rows.select("company", F.lit("lever").alias("source"), i("id").alias("ats_job_id"), i("text").alias("title"), i("categories.location").alias("location"), (F.lower(i("workplaceType")) == "remote").alias("is_remote"), i("hostedUrl").alias("url"), F.timestamp_millis(F.nullif(i("createdAt"), F.lit(0))).alias("posted_at"), F.coalesce(i("description"), F.lit("")).alias("description_html"), F.coalesce(i("descriptionPlain"), F.lit("")).alias("description_text"))
    return _finish(rows, since, config)


def map_ashby(landed: DataFrame, since: Column, config: Config = DEFAULT) -> DataFrame:
    item = "struct<id:string,title:string,publishedAt:string,location:string,jobUrl:string,descriptionHtml:string,descriptionPlain:string,isListed:boolean,isRemote:boolean>"
    rows = _items(landed, "list", f"jobs array<{item}>", lambda p: p["jobs"]).filter(F.coalesce("item.isListed", F.lit(True)))
    i = lambda c: F.col(f"item.{c}")
    rows = rows.select("company", F.lit("ashby").alias("source"), i("id").alias("ats_job_id"), i("title").alias("title"), i("location").alias("location"), i("isRemote").alias("is_remote"), i("jobUrl").alias("url"), iso_time(i("publishedAt")).alias("posted_at"), F.coalesce(i("descriptionHtml"), F.lit("")).alias("description_html"), F.coalesce(i("descriptionPlain"), F.lit("")).alias("description_text"))
    return _finish(rows, since, config)


def relative_date(text: Column, fetched_at: Column) -> Column:
    """Posted Today, Yesterday, or N+ Days Ago."""
    days = filled(F.regexp_extract(text, r"(?i)posted\s+(\d+)\+?\s+days?\s+ago", 1)).try_cast("int")
    ago = F.when(text.rlike(r"(?i)posted\s+today"), 0).when(text.rlike(r"(?i)posted\s+yesterday"), 1).otherwise(days)
    return fetched_at - F.make_dt_interval(ago)


def map_workday(landed: DataFrame, since: Column, config: Config = DEFAULT) -> DataFrame:
    rows = _items(landed, "list", "jobPostings array<struct<title:string,externalPath:string,locationsText:string,postedOn:string>>", lambda p: p["jobPostings"])
    rows = _first_of_terms(rows.withColumn("posting", filled(F.col("item.externalPath"))))
    rows = _with_detail(rows.filter(title_matches(F.col("item.title"), config)), landed, "jobPostingInfo struct<id:string,title:string,jobDescription:string,location:string,externalUrl:string,country:struct<descriptor:string>>")
    d = lambda c: F.col(f"detail.jobPostingInfo.{c}")
    listed, country = filled(F.col("item.locationsText")), filled(d("country.descriptor"))
    place = filled(F.when(listed.isNotNull() & ~F.trim(listed).rlike(r"(?i)^\d+\s+locations?$"), listed).otherwise(d("location")))
    lacks = place.isNull() | ~F.contains(F.lower(place), F.lower(country))
    place = F.when(country.isNotNull() & lacks, F.concat_ws(", ", place, country)).otherwise(place)
    html = F.coalesce(d("jobDescription"), F.lit(""))
    rows = rows.select("company", F.lit("workday").alias("source"), F.coalesce(filled(d("id")), "posting").alias("ats_job_id"), F.col("item.title").alias("title"), filled(place).alias("location"), F.lit(False).alias("is_remote"), F.coalesce(filled(d("externalUrl")), F.concat(F.lit("https://"), "host", F.lit("/"), "board", "posting")).alias("url"), relative_date(F.col("item.postedOn"), F.col("fetched_at")).alias("posted_at"), html.alias("description_html"))
    return _finish(rows.withColumn("description_text", H.html_to_text("description_html")), since, config)


def map_smartrecruiters(landed: DataFrame, since: Column, config: Config = DEFAULT) -> DataFrame:
    rows = _items(landed, "list", "content array<struct<id:string,name:string,releasedDate:string,location:struct<fullLocation:string,city:string,region:string,country:string,remote:boolean>>>", lambda p: p["content"])
    rows = _first_of_terms(rows.withColumn("posting", F.col("item.id")))
    rows = _with_detail(rows.filter(title_matches(F.col("item.name"), config)), landed, "jobAd struct<sections:map<string,struct<title:string,text:string>>>, postingUrl string, applyUrl string")
    sections = F.col("detail.jobAd.sections")
    parts = [F.when(F.map_contains_key(sections, k), F.concat(F.lit("<h3>"), F.coalesce(sections[k]["title"], F.lit("")), F.lit("</h3>"), F.coalesce(sections[k]["text"], F.lit("")))) for k in ("jobDescription", "qualifications", "additionalInformation")]
    loc = lambda c: filled(F.col(f"item.location.{c}"))
    place = F.coalesce(loc("fullLocation"), filled(F.concat_ws(", ", loc("city"), loc("region"), loc("country"))))
    rows = rows.select("company", F.lit("smartrecruiters").alias("source"), F.col("posting").alias("ats_job_id"), F.col("item.name").alias("title"), place.alias("location"), F.col("item.location.remote").alias("is_remote"), F.coalesce(filled(F.col("detail.postingUrl")), filled(F.col("detail.applyUrl"))).alias("url"), iso_time(F.col("item.releasedDate")).alias("posted_at"), F.concat_ws("\n", *parts).alias("description_html"))
    return _finish(rows.withColumn("description_text", H.html_to_text("description_html")), since, config)


def map_oracle_rc(landed: DataFrame, since: Column, config: Config = DEFAULT) -> DataFrame:
    rows = _items(landed, "list", "items array<struct<requisitionList:array<struct<Id:string,Title:string,PostedDate:string,PrimaryLocation:string,WorkplaceType:string,ShortDescriptionStr:string>>>>", lambda p: F.get(p["items"], F.lit(0))["requisitionList"])
    day = iso_time(F.col("item.PostedDate"))
    rows = rows.withColumn("posting", F.col("item.Id")).filter(title_matches(F.col("item.Title"), config) & (day.isNull() | (day + F.make_dt_interval(F.lit(1)) >= since)))
    rows = _with_detail(_first_of_terms(rows), landed, "items array<struct<ExternalPostedStartDate:string,ExternalDescriptionStr:string,ExternalResponsibilitiesStr:string,ExternalQualificationsStr:string>>")
    d = F.get(F.col("detail.items"), F.lit(0))
    html = F.concat_ws("\n", *[filled(d[c]) for c in ("ExternalDescriptionStr", "ExternalResponsibilitiesStr", "ExternalQualificationsStr")])
    html = F.coalesce(filled(html), "item.ShortDescriptionStr", F.lit(""))
    url = F.concat(F.lit("https://"), "host", F.lit("/hcmUI/CandidateExperience/en/sites/"), "site", F.lit("/job/"), "posting")
    rows = rows.select("company", F.lit("oracle_rc").alias("source"), F.col("posting").alias("ats_job_id"), F.col("item.Title").alias("title"), F.col("item.PrimaryLocation").alias("location"), F.contains(F.lower("item.WorkplaceType"), F.lit("remote")).alias("is_remote"), url.alias("url"), F.coalesce(iso_time(d["ExternalPostedStartDate"]), iso_time(F.col("item.PostedDate"))).alias("posted_at"), html.alias("description_html"))
    return _finish(rows.withColumn("description_text", H.html_to_text("description_html")), since, config)


def map_eightfold(landed: DataFrame, since: Column, config: Config = DEFAULT) -> DataFrame:
    item = "struct<id:long,name:string,location:string,locations:array<string>,postedTs:long,t_create:long,workLocationOption:string,work_location_option:string,positionUrl:string,canonicalPositionUrl:string,job_description:string>"
    rows = _items(landed, "list", f"data struct<positions:array<{item}>>, positions array<{item}>", lambda p: F.coalesce(p["data"]["positions"], p["positions"]))
    rows = _first_of_terms(rows.withColumn("posting", F.col("item.id").cast("string")).filter(title_matches(F.col("item.name"), config)))
    rows = _with_detail(rows, landed, "data struct<jobDescription:string>, jobDescription string")
    i = lambda c: F.col(f"item.{c}")
    seconds = F.coalesce(F.nullif(i("postedTs"), F.lit(0)), F.nullif(i("t_create"), F.lit(0)))
    url = F.concat(F.lit("https://"), "host", F.coalesce(filled(i("positionUrl")), F.concat(F.lit("/careers/job/"), "posting")))
    option = F.coalesce(filled(i("workLocationOption")), filled(i("work_location_option")), F.lit(""))
    html = F.coalesce(filled(F.col("detail.data.jobDescription")), filled(F.col("detail.jobDescription")), i("job_description"), F.lit(""))
    rows = rows.select("company", F.lit("eightfold").alias("source"), F.col("posting").alias("ats_job_id"), i("name").alias("title"), F.coalesce(filled(i("location")), F.get(i("locations"), F.lit(0))).alias("location"), (option == "remote").alias("is_remote"), F.coalesce(filled(i("canonicalPositionUrl")), url).alias("url"), F.timestamp_seconds(seconds).alias("posted_at"), html.alias("description_html"))
    return _finish(rows.withColumn("description_text", H.html_to_text("description_html")), since, config)


def map_amazon(landed: DataFrame, since: Column, config: Config = DEFAULT) -> DataFrame:
    """One feed for two boards: a board whose site is audible gets the rows of that company, the other one the rest."""
    keys = (("description", "Description"), ("basic_qualifications", "Basic qualifications"), ("preferred_qualifications", "Preferred qualifications"))
    item = "struct<id_icims:string,title:string,company_name:string,posted_date:string,normalized_location:string,location:string,job_path:string," + ",".join(f"{k}:string" for k, _ in keys) + ">"
    rows = _items(landed, "list", f"jobs array<{item}>", lambda p: p["jobs"]).withColumn("posting", F.col("item.id_icims"))
    i = lambda c: F.col(f"item.{c}")
    split = F.startswith(F.lower(F.coalesce(i("company_name"), F.lit(""))), F.lit("audible")) == (F.lower(F.coalesce("site", F.lit(""))) == "audible")
    rows = _first_of_terms(rows.filter(split & title_matches(i("title"), config)))
    day = F.try_to_timestamp(F.trim(F.regexp_replace(i("posted_date"), r"\s+", " ")), F.lit("MMMM d, yyyy"))
    html = F.concat_ws("\n", *[F.when(filled(i(k)).isNotNull(), F.concat(F.lit(f"<h3>{label}</h3>"), i(k))) for k, label in keys])
    rows = rows.filter(day.isNull() | (day + F.make_dt_interval(F.lit(0), F.lit(23), F.lit(59)) >= since))
    rows = rows.select("company", F.lit("amazon").alias("source"), F.col("posting").alias("ats_job_id"), i("title").alias("title"), F.coalesce(filled(i("normalized_location")), i("location")).alias("location"), F.lit(False).alias("is_remote"), F.concat(F.lit("https://www.amazon.jobs"), i("job_path")).alias("url"), day.alias("posted_at"), html.alias("description_html"))
    rows = rows.withColumns({"description_text": H.html_to_text("description_html"), "is_remote": F.lit(False)})
    return conform(rows, RAW_JOB)


def map_jobspy(rows: DataFrame, as_of: Column) -> DataFrame:
    """Scraped search rows. A date is a day and counts until its end, but not past as_of; without one the row is of now,
    as the search was limited to recent postings."""
    text = lambda c: filled(F.trim(F.when(F.lower(F.col(c).cast("string")) != "nan", F.col(c).cast("string"))))
    url = F.coalesce(text("job_url_direct"), text("job_url"))
    day = F.substring(text("date_posted"), 1, 10).try_cast("date").cast("timestamp")
    posted = F.coalesce(F.least(day + F.make_dt_interval(F.lit(0), F.lit(23), F.lit(59)), as_of), as_of)
    out = rows.select(F.concat(F.lit("jobspy_"), text("site")).alias("source"), F.coalesce(text("id"), url).alias("ats_job_id"), text("company").alias("company"), text("title").alias("title"), text("location").alias("location"), F.coalesce("is_remote", F.lit(False)).alias("is_remote"), url.alias("url"), posted.alias("posted_at"), text("description").alias("description_text"))
    return conform(out.filter("title is not null and company is not null and url is not null and source is not null"), RAW_JOB)


def sitemap_urls(xml: Column) -> Column:
    """array of (loc, lastmod), blocks without a loc left out."""
    blocks = F.regexp_extract_all(xml, F.lit(r"(?s)<url>(.*?)</url>"), F.lit(1))
    each = F.transform(blocks, lambda b: F.struct(filled(F.regexp_extract(b, r"<loc>\s*([^<\s]+)\s*</loc>", 1)).alias("loc"), filled(F.regexp_extract(b, r"<lastmod>\s*([^<\s]+)\s*</lastmod>", 1)).alias("lastmod")))
    return F.filter(each, lambda x: x["loc"].isNotNull())


def posting_location(posting: Column) -> Column:
    """Places of a JobPosting (JSON), "; " between them; addressCountry may be a name or an object with one."""
    place = "struct<address:struct<addressLocality:string,addressRegion:string,addressCountry:string>>"
    raw = F.get_json_object(posting, "$.jobLocation")
    many = F.when(F.startswith(raw, F.lit("[")), F.from_json(raw, f"array<{place}>")).otherwise(F.array(F.from_json(raw, place)))

    def line(p: Column) -> Column:
        a = p["address"]
        country = F.when(F.startswith(a["addressCountry"], F.lit("{")), F.get_json_object(a["addressCountry"], "$.name")).otherwise(a["addressCountry"])
        return F.concat_ws(", ", filled(a["addressLocality"]), filled(a["addressRegion"]), filled(country))

    return filled(F.array_join(F.filter(F.transform(many, line), lambda x: x != ""), "; "))


def map_uber(landed: DataFrame, since: Column, config: Config = DEFAULT) -> DataFrame:
    """Sitemap entries joined with the pages (kind page, key = url). lastmod only saves work; datePosted decides."""
    listed = landed.filter("kind = 'sitemap'").select("company", F.explode(sitemap_urls(F.col("payload"))).alias("u")).select("company", F.col("u.loc").alias("url"), iso_time(F.col("u.lastmod")).alias("modified"))
    listed = listed.filter(F.col("modified").isNull() | (F.col("modified") >= since))
    pages = landed.filter("kind = 'page'").groupBy("company", F.col("key").alias("url")).agg(F.any_value("payload").alias("html"))
    rows = listed.join(pages, ["company", "url"]).withColumn("posting", H.jsonld_job("html")).filter("posting is not null")
    get = lambda c: F.get_json_object("posting", f"$.{c}")
    number = F.regexp_extract(F.regexp_replace("url", "/+$", ""), "([^/]*)$", 1)
    rows = rows.select("company", F.lit("uber").alias("source"), number.alias("ats_job_id"), get("title").alias("title"), posting_location(F.col("posting")).alias("location"), F.lit(False).alias("is_remote"), "url", iso_time(get("datePosted")).alias("posted_at"), F.coalesce(get("description"), F.lit("")).alias("description_html"))
    return _finish(rows.withColumn("description_text", H.html_to_text("description_html")), since, config)


def _per_page(landed: DataFrame, kind: str, parse, fields: str) -> DataFrame:
    """Rows that parse(html) yields for each landed page of a kind, with the board's columns, key, term, page and pos."""
    names = [f.split()[0] for f in fields.split(", ")]
    carried = [*BOARD, "key", "term", "page"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pages = batch.column("payload")
            found = [(at, pos, row) for at in range(len(pages)) for pos, row in enumerate(parse(pages[at].as_py()))]
            fixed = batch.select(carried).take(pa.array([at for at, _, _ in found], pa.int32()))
            made = [pa.array([row.get(n) for _, _, row in found], pa.string()) for n in names]
            yield pa.RecordBatch.from_arrays([*fixed.columns, pa.array([pos for _, pos, _ in found], pa.int32()), *made], names=[*carried, "pos", *names])

    schema = ", ".join(f"{c} {'int' if c == 'page' else 'string'}" for c in carried) + f", pos int, {fields}"
    return landed.filter(F.col("kind") == kind).select(*carried, "payload").mapInArrow(run, schema)


_ICIMS_NUMBER = re.compile(r"/jobs/(\d+)/")
_ICIMS_TIME = re.compile(r"\((\d{1,2}/\d{1,2}/\d{4} \d{1,2}:\d{2} [AP]M)\)")


def icims_rows(page: str) -> list[dict]:
    out = []
    for a in H.walk(H.tree(page)):
        number = _ICIMS_NUMBER.search(a[1].get("href") or "") if a[0] == "a" else None
        if not number or "iCIMS_Anchor" not in H.classes(a):
            continue
        title = next((n for n in H.walk(a) if n[0] == "h3"), None)
        row = H.up(a, lambda n: n[0] == "div" and "row" in H.classes(n))
        if title is None or row is None:
            continue
        when = _ICIMS_TIME.search(H.inner_text(row))
        place = None
        for tag in (n for n in H.walk(row) if "iCIMS_JobHeaderTag" in H.classes(n)):
            label = next((n for n in H.walk(tag) if n[0] == "dt"), None)
            if label is not None and "Location" in H.inner_text(label):
                value = next((n for n in H.walk(tag) if n[0] == "dd"), None)
                place = H.inner_text(value) if value is not None else None
                break
        out.append({"id": number[1], "title": H.inner_text(title), "url": a[1]["href"], "posted": when[1] if when else None, "location": place})
    return out


def map_icims(landed: DataFrame, since: Column, config: Config = DEFAULT) -> DataFrame:
    rows = _per_page(landed, "list", icims_rows, "id string, title string, url string, posted string, location string")
    row_date = F.try_to_timestamp("posted", F.lit("M/d/yyyy h:mm a"))
    rows = rows.withColumns({"posting": F.col("id"), "row_date": row_date}).filter(title_matches(F.col("title"), config) & (F.col("row_date").isNull() | (F.col("row_date") >= since)))
    pages = landed.filter("kind = 'detail'").select("company", F.col("key").alias("posting"), H.jsonld_job("payload").alias("ld")).groupBy("company", "posting").agg(F.any_value("ld").alias("ld"))
    rows = _first_of_terms(rows).join(pages, ["company", "posting"], "left")
    posted = F.coalesce(iso_time(F.get_json_object("ld", "$.datePosted")), "row_date")
    rows = rows.select("company", F.lit("icims").alias("source"), F.col("posting").alias("ats_job_id"), "title", "location", F.lit(False).alias("is_remote"), F.split_part("url", F.lit("?"), F.lit(1)).alias("url"), posted.alias("posted_at"), F.coalesce(F.get_json_object("ld", "$.description"), F.lit("")).alias("description_html"))
    return _finish(rows.withColumn("description_text", H.html_to_text("description_html")), since, config)


BUTTONS = ("apply", "view role", "view job", "view")


def avature_rows(page: str) -> list[dict]:
    found: dict[str, dict] = {}
    for a in H.walk(H.tree(page)):
        href = a[1].get("href") or ""
        text = H.inner_text(a) if a[0] == "a" and "/JobDetail/" in href else ""
        if not text or text.lower() in BUTTONS:
            continue
        box = H.up(a, lambda n: any("article__header__text" in c for c in H.classes(n)))
        inner = next((n for n in H.walk(box) if "article__header__content__text" in H.classes(n)), None) if box else None
        place = next((n for n in H.walk(inner) if "paragraph_inner-span" in H.classes(n)), None) if inner else None
        number = href.rstrip("/").rsplit("/", 1)[-1]
        found.setdefault(number, {"id": number, "title": text, "url": href, "location": H.inner_text(place) if place else None})
    return list(found.values())


def avature_detail(page: str) -> list[dict]:
    nodes = list(H.walk(H.tree(page)))
    place = None
    for k, n in enumerate(nodes):
        if "article__content__view__field__label" in H.classes(n) and H.inner_text(n).lower() == "location":
            value = next((m for m in nodes[k + 1 :] if "article__content__view__field__value" in H.classes(m)), None)
            place = H.inner_text(value) if value else None
            break
    parts = [n for n in nodes if "article__content" in H.classes(n)] or [n for n in nodes if n[0] == "body"][:1]
    return [{"place": place, "html": "\n".join(map(H.markup, parts))}]


def map_avature(landed: DataFrame, since: Column, config: Config = DEFAULT) -> DataFrame:
    """Postings without dates: undated, for resolve_undated."""
    rows = _per_page(landed, "list", avature_rows, "id string, title string, url string, location string").withColumn("posting", F.col("id"))
    rows = _first_of_terms(rows.filter(title_matches(F.col("title"), config)))
    details = _per_page(landed, "detail", avature_detail, "place string, html string").groupBy("company", F.col("key").alias("posting")).agg(F.any_value(F.struct("place", "html")).alias("d"))
    rows = rows.join(details, ["company", "posting"], "left")
    rows = rows.select("company", F.lit("avature").alias("source"), F.col("posting").alias("ats_job_id"), "title", F.coalesce(filled(F.col("d.place")), "location").alias("location"), F.lit(False).alias("is_remote"), "url", F.lit(None).cast("timestamp").alias("posted_at"), F.lit(True).alias("undated"), F.coalesce("d.html", F.lit("")).alias("description_html"))
    return _finish(rows.withColumn("description_text", H.html_to_text("description_html")), since, config)


def successfactors_rows(page: str) -> list[dict]:
    found: dict[str, dict] = {}
    for a in H.walk(H.tree(page)):
        number = re.search(r"/(\d+)/?$", a[1].get("href") or "") if a[0] == "a" else None
        if number and "jobTitle-link" in H.classes(a):
            found.setdefault(number[1], {"id": number[1], "title": H.inner_text(a), "href": a[1]["href"]})
    return list(found.values())


def successfactors_detail(page: str) -> list[dict]:
    nodes = list(H.walk(H.tree(page)))

    def of(name: str) -> str | None:
        n = next((n for n in nodes if n[1].get("itemprop") == name), None)
        return None if n is None else (n[1].get("content") or H.inner_text(n)) or None

    body = next((n for n in nodes if n[0] == "span" and "jobdescription" in H.classes(n)), None) or next((n for n in nodes if n[1].get("itemprop") == "description"), None)
    place = ", ".join(p for p in map(of, ("addressLocality", "addressRegion", "addressCountry")) if p)
    return [{"posted": of("datePosted"), "place": place or None, "html": H.markup(body) if body else ""}]


def map_successfactors(landed: DataFrame, since: Column, config: Config = DEFAULT) -> DataFrame:
    rows = _per_page(landed, "list", successfactors_rows, "id string, title string, href string").withColumn("posting", F.col("id"))
    rows = _first_of_terms(rows.filter(title_matches(F.col("title"), config)))
    details = _per_page(landed, "detail", successfactors_detail, "posted string, place string, html string").groupBy("company", F.col("key").alias("posting")).agg(F.any_value(F.struct("posted", "place", "html")).alias("d"))
    rows = rows.join(details, ["company", "posting"], "left")
    # the week day cannot be parsed and is left out
    posted = F.try_to_timestamp(F.substring("d.posted", 5, 100), F.lit("MMM d HH:mm:ss 'UTC' yyyy"))
    rows = rows.select("company", F.lit("successfactors").alias("source"), F.col("posting").alias("ats_job_id"), "title", F.col("d.place").alias("location"), F.lit(False).alias("is_remote"), F.concat(F.lit("https://"), "host", "href").alias("url"), posted.alias("posted_at"), F.coalesce("d.html", F.lit("")).alias("description_html"))
    return _finish(rows.withColumn("description_text", H.html_to_text("description_html")), since, config)


MAPPERS = {
    "greenhouse": map_greenhouse,
    "lever": map_lever,
    "ashby": map_ashby,
    "workday": map_workday,
    "smartrecruiters": map_smartrecruiters,
    "oracle_rc": map_oracle_rc,
    "eightfold": map_eightfold,
    "amazon": map_amazon,
    "uber": map_uber,
    "icims": map_icims,
    "avature": map_avature,
    "successfactors": map_successfactors,
}


LANDED = "company string, host string, tenant string, board string, slug string, site string, key string, term string, page int, payload string, fetched_at timestamp, ats string, kind string"


#: Most rows of a landed file.
ROWS_A_FILE = 50_000


def land(responses: DataFrame, path: str, mode: str = "append", rows_a_file: int = ROWS_A_FILE, gathered: bool = False) -> None:
    """Responses as files by ats and kind, so that each mapper opens its own files only. A large system is split over files,
    also by rows: pages compress well, and a task that gets few bytes may have very many pages to parse. gathered: each
    partition of the responses is of one system and kind, so they are written from where they are and not dealt out first."""
    dealt = conform(responses, LANDED)
    dealt = dealt if gathered else dealt.hint("rebalance", "ats", "kind")
    dealt.write.mode(mode).option("compression", "zstd").option("maxRecordsPerFile", rows_a_file).partitionBy("ats", "kind").parquet(path)


def read_landed(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(LANDED).parquet(path)


def map_all(landed: DataFrame, since: Column, config: Config = DEFAULT) -> DataFrame:
    """All boards' landed rows (with column ats) as raw postings. From a folder written by land() the filters on ats and kind
    are partition filters: a file is read where it is needed, and all mappers together read the folder once."""
    out = None
    for ats, mapper in MAPPERS.items():
        one = mapper(landed.filter(F.col("ats") == ats), since, config)
        out = one if out is None else out.unionByName(one, allowMissingColumns=True)
    return out
