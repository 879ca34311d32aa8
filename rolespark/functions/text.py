"""String columns: names, titles, locations, urls, evidence. All built-in expressions; character classes are Unicode."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from rolespark.config import ATS_SOURCES, DEFAULT, US_STATE_NAMES, Config

# fixed values: legal suffixes of company names
LEGAL_SUFFIXES = (
    "incorporated", "inc", "l l c", "llc", "ltd", "limited", "corporation", "corp", "company", "co", "llp", "lp", "plc", "pc", "na", "usa", "us",
    "holdings", "group",
)


def _squeezed(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(c, r"(?U)[^\w\s]", " "), r"(?U)\s+", " "))


def normalize_company(name: Column) -> Column:
    """Lower case, & as and, no punctuation, no leading the, no legal suffixes at the end."""
    text = _squeezed(F.replace(F.lower(name), F.lit("&"), F.lit(" and ")))
    text = F.trim(F.regexp_replace(text, r"(?U)^the\b\s*", ""))
    return F.trim(F.regexp_replace(text, rf"(?U)(?:\b(?:{'|'.join(LEGAL_SUFFIXES)})\b\s*)+$", ""))


def without_technology(company_norm: Column) -> Column:
    return F.regexp_replace(company_norm, r"(?:\s+(?:technologies|technology|tech))+$", "")


def normalize_excluded(name: Column) -> Column:
    return without_technology(normalize_company(name))


def title_norm(title: Column) -> Column:
    """Lower case without punctuation, work-mode words and one requisition code at the end."""
    text = F.regexp_replace(_squeezed(F.lower(title)), r"(?U)\b(?:remote|hybrid|onsite|on site)\b", " ")
    text = F.regexp_replace(text, r"(?U)\b(?:req|job|jr|r)?\s*\d{3,}\w*\s*$", " ")
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def location_norm(location: Column) -> Column:
    return _squeezed(F.lower(F.coalesce(location, F.lit(""))))


def canonical_id(company_norm: Column, title: Column, location: Column) -> Column:
    return F.sha1(F.concat_ws("|", company_norm, title_norm(title), location_norm(location)))


def source_priority(source: Column) -> Column:
    return F.when(source.isin(*ATS_SOURCES), 1).otherwise(0)


def should_overwrite(stored: Column, incoming: Column) -> Column:
    return source_priority(incoming) > source_priority(stored)


def any_of(text: Column, patterns: tuple[str, ...]) -> Column:
    """Whether any pattern occurs, ignoring case: one alternation, one pass."""
    return text.rlike("(?iuU)" + "|".join(f"(?:{p})" for p in patterns)) if patterns else F.lit(False)


def title_included(title: Column, config: Config = DEFAULT) -> Column:
    return any_of(title, config.title_include) if config.title_include else F.lit(True)


def title_matches(title: Column, config: Config = DEFAULT) -> Column:
    """An include pattern and no exclude pattern; a null or empty title does not match."""
    found = (title != "") & title_included(title, config) & ~any_of(title, config.title_exclude)
    return F.coalesce(found, F.lit(False))


def contains_any(text: Column, words: tuple[str, ...]) -> Column:
    found = F.lit(False)
    for w in words:
        found = found | text.contains(w)
    return found


def has_non_us_keyword(text: Column, config: Config = DEFAULT) -> Column:
    words = "|".join(rf"\Q{w}\E" for w in config.non_us_keywords)
    return F.lower(text).rlike(rf"(?U)(?<!\w)(?:{words})(?!\w)")


# fixed values: what tells of the United States in free text: the country, a state, a city with its state, a pay range
US_PHRASE = r"(?iuU)\bunited states\b|\bus[- ]based\b|\bu\.s\.|\busa\b|\bus only\b"
US_STATE = r"(?iuU)\b(?:{names})\b"
US_CITY = r"(?U)\b[A-Z][A-Za-z.]+(?: [A-Z][A-Za-z.]+)*,\s*(?:{codes})\b"
US_PAY = r"(?U)\$\s?\d{2,3}(?:,\d{3})?(?:\.\d+)?\s?[kK]?\s*(?:-|\u2013|\u2014|to)\s*\$?\s?\d{2,3}(?:,\d{3})?(?:\.\d+)?\s?[kK]?"


def has_us_signal(text: Column, config: Config = DEFAULT) -> Column:
    """Free text that names the country, a state, a city with its state code, or a dollar range."""
    patterns = (US_PHRASE, US_STATE.replace("{names}", "|".join(US_STATE_NAMES)), US_CITY.replace("{codes}", "|".join(config.us_states)), US_PAY)
    told = F.lit(False)
    for pattern in patterns:
        told = told | text.rlike(pattern)
    return F.coalesce(told, F.lit(False))


def state_in_location(raw: Column, config: Config = DEFAULT) -> Column:
    return raw.rlike(rf"(?U)(?:,\s*|^|[-/(]\s*)(?:{'|'.join(config.us_states)})\b")


def parse_location(raw: Column, description: Column, config: Config = DEFAULT, metro: Column | None = None, resolved: Column | None = None) -> Column:
    """struct(is_us, is_remote, is_nyc_metro). metro and resolved come from resolve_location; where a place resolves,
    distance decides about New York instead of the list of names."""
    place = F.trim(F.coalesce(raw, F.lit("")))
    text = F.lower(place)
    is_remote = contains_any(text, config.remote_keywords)
    listed = contains_any(text, config.nyc_metro)
    is_nyc = listed if metro is None else F.when(resolved, F.coalesce(metro == "nyc", F.lit(False))).otherwise(listed)
    is_us = (
        F.when(has_non_us_keyword(text, config), False)
        .when(contains_any(text, config.us_keywords) | state_in_location(place, config), True)
        .when(is_remote & (F.coalesce(description, F.lit("")) != ""), has_us_signal(description, config) & ~has_non_us_keyword(description, config))
        .otherwise(False)
    )
    return F.struct(is_us.alias("is_us"), is_remote.alias("is_remote"), is_nyc.alias("is_nyc_metro"))


# fixed values: hosts of job boards
BOARD_HOSTS = {
    "boards.greenhouse.io": "greenhouse",
    "job-boards.greenhouse.io": "greenhouse",
    "jobs.lever.co": "lever",
    "jobs.smartrecruiters.com": "smartrecruiters",
    "careers.smartrecruiters.com": "smartrecruiters",
    "jobs.ashbyhq.com": "ashby",
}


def parse_ats_url(url: Column) -> Column:
    """struct(ats, slug, host, tenant, board), null if the url is of no known job board."""
    kind = "struct<ats:string,slug:string,host:string,tenant:string,board:string>"
    host = F.lower(F.try_parse_url(url, F.lit("HOST")))
    parts = F.filter(F.split(F.coalesce(F.try_parse_url(url, F.lit("PATH")), F.lit("")), "/"), lambda s: s != "")
    first = F.get(parts, F.lit(0))
    ats = F.lit(None).cast("string")
    for h, name in BOARD_HOSTS.items():
        ats = F.when(host == h, name).otherwise(ats)
    board = F.get(F.filter(parts, lambda s: ~s.rlike("^[a-z]{2}(-[a-zA-Z]{2})?$")), F.lit(0))
    null = F.lit(None).cast("string")
    plain = F.struct(ats.alias("ats"), first.alias("slug"), null.alias("host"), null.alias("tenant"), null.alias("board"))
    workday = F.struct(F.lit("workday").alias("ats"), null.alias("slug"), host.alias("host"), F.split_part(host, F.lit("."), F.lit(1)).alias("tenant"), board.alias("board"))
    return F.when(ats.isNotNull() & first.isNotNull(), plain.cast(kind)).when(host.endswith(".myworkdayjobs.com") & board.isNotNull(), workday.cast(kind))


def ref_key(ref: Column) -> Column:
    """Identity of a board: host, tenant and board for workday, else the slug."""
    workday = F.concat_ws("|", F.lit("workday"), *[F.coalesce(ref[c], F.lit("")) for c in ("host", "tenant", "board")])
    return F.when(ref["ats"] == "workday", workday).otherwise(F.concat_ws("|", ref["ats"], F.coalesce(ref["slug"], F.lit(""))))


def blocklist_key(ref: Column) -> Column:
    return F.concat_ws("|", ref["ats"], F.coalesce(ref["slug"], ref["tenant"], F.lit("")))


def url_key(ref: Column) -> Column:
    """The number of a posting on a site whose links carry tracking parameters, else the trimmed text."""
    number = F.regexp_extract(ref, r"/jobs/view/(?:[^/?]*-)?(\d{6,})", 1)
    return F.coalesce(F.nullif(number, F.lit("")), F.trim(ref))


def hrefs(text: Column) -> Column:
    """Targets in double quotes, in order; text is unescaped already."""
    return F.regexp_extract_all(text, F.lit('href="([^"]+)"'), F.lit(1))


def guess_company_name(plain: Column, fallback: Column) -> Column:
    """From unescaped text without tags: first line, before the first bar; a work mode, a place or a long text is no name."""
    first = F.get(F.split(F.regexp_replace(plain, r"(?U)^\s+|\s+$", ""), r"\R"), F.lit(0))
    name = F.regexp_replace(F.get(F.split(first, r"\|"), F.lit(0)), "^[ \\-\u2013\u2014]+|[ \\-\u2013\u2014]+$", "")
    name = F.trim(F.regexp_replace(name, r"(?U)\s*\(\s*https?://\S+?\s*\)\s*$", ""))
    place = name.rlike(r"(?iuU)^(remote|hybrid|onsite|on-site|nyc|ny|nj|sf|bay area|usa?|us only|us-remote)\b")
    return F.when((F.length(name) > 0) & (F.length(name) <= 60) & ~place, name).otherwise(fallback)


# fixed values: pay periods a year
PERIODS = {"Hour": 2080, "Week": 52, "Bi-Weekly": 26, "Month": 12, "Year": 1}


def annualize(rate: Column, unit: Column) -> Column:
    times = F.lit(None).cast("int")
    for name, n in PERIODS.items():
        times = F.when(F.trim(unit) == name, n).otherwise(times)
    return rate.cast("double") * times


def job_text(title: Column, company: Column, description: Column, characters: int = 2000) -> Column:
    return F.concat_ws("\n", title, company, F.substring(F.coalesce(description, F.lit("")), 1, characters))


def has_description(description: Column, least: int = 200) -> Column:
    return F.coalesce(F.length(F.regexp_replace(description, r"(?U)^\s+|\s+$", "")) >= least, F.lit(False))


def squash(text: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(text, r"(?U)\s+", " ")))


def evidence_is_verbatim(evidence: Column, description: Column) -> Column:
    quote = squash(F.coalesce(evidence, F.lit("")))
    return (quote == "") | squash(F.coalesce(description, F.lit(""))).contains(quote)


def skill_keys(skills: Column) -> Column:
    """Distinct non-blank skills, lower-cased, white space squeezed."""
    return F.array_distinct(F.filter(F.transform(skills, squash), lambda s: s != ""))

