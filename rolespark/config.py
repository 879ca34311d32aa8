"""Settings of the posting pipeline, as one immutable dataclass; every job takes one as a parameter."""

from __future__ import annotations

from dataclasses import dataclass, field

# fixed values: posting systems whose rows outrank scraped ones
ATS_SOURCES = (
    "greenhouse", "lever", "ashby", "workday", "smartrecruiters", "oracle_rc", "eightfold", "amazon", "uber", "avature", "icims", "successfactors",
)

# fixed values: title patterns, ignoring case
TITLE_INCLUDE = (
    r"\bdata scien(ce|tist)",
    r"\bmachine learning\b",
    r"\bml\s*(engineer|scientist|ops|platform|infrastructure)\b",
    r"\bmlops\b",
    r"\b(ai|a\.i\.)\s*(/\s*ml\s*)?(engineer|scientist|developer)\b",
    r"\bapplied (ai|ml|scientist|science)\b",
    r"\b(gen(erative)?\s*ai|llm|nlp)\b",
    r"\bdeep learning\b",
    r"\bresearch (engineer|scientist)\b.*\b(ml|ai|machine learning)\b",
    r"\bdecision scien",
)
TITLE_EXCLUDE = (
    r"\bintern(ship)?\b", r"\bco-?op\b", r"\bstaff\b", r"\bprincipal\b", r"\bdistinguished\b", r"\bdirector\b", r"\bhead of\b",
    r"\bvp\b|\bvice president\b", r"\bmanager\b", r"\bpostdoc", r"\bprofessor\b", r"\bsales\b",
)

# fixed values: description patterns that exclude a posting, ignoring case
RED_FLAGS = (
    r"must be (a )?u\.?s\.? citizen",
    r"u\.?s\.? citizen(ship)? (is )?required",
    r"citizenship is required",
    r"(active|current|ability to obtain)\s+(a\s+)?(secret|top secret|ts/sci|public trust)",
    r"security clearance (is )?required",
    r"(will|can|do) not (provide |offer )?sponsor",
    r"unable to (provide |offer )?sponsor",
    r"not (able|eligible) to sponsor",
    r"no (visa |h-?1b )?sponsorship",
    r"sponsorship (is )?not (available|provided|offered)",
    r"without (the need for )?(current or future )?(visa )?sponsorship",
    r"(green card|gc) holders? only",
    r"\busc(/gc)? only\b",
)
STAFFING_PATTERNS = (r"on behalf of (our|a) client", r"our client (is|has)", r"\bw-?2 (only|contract)\b", r"\bc2c\b|corp[- ]to[- ]corp", r"\bstaffing (agency|firm|partner)\b")
STAFFING_COMPANIES = (
    "robert half", "teksystems", "insight global", "randstad", "adecco", "kforce", "apex systems", "aerotek", "kelly services", "manpowergroup",
    "motion recruitment", "jobot", "cybercoders", "harnham", "hays", "beacon hill staffing", "vaco", "akkodis", "modis", "collabera", "mindlance",
    "diverse lynx", "dice",
)

# fixed values: location words
US_STATES = (
    "AL AK AZ AR CA CO CT DE DC FL GA HI ID IL IN IA KS KY LA ME MD MA MI MN MS MO MT NE NV NH NJ NM NY NC ND OH OK OR PA RI SC SD TN TX UT VT VA WA WV WI WY"
).split()
US_STATE_NAMES = (
    "alabama", "alaska", "arizona", "arkansas", "california", "colorado", "connecticut", "delaware", "florida", "georgia", "hawaii", "idaho",
    "illinois", "indiana", "iowa", "kansas", "kentucky", "louisiana", "maine", "maryland", "massachusetts", "michigan", "minnesota", "mississippi",
    "missouri", "montana", "nebraska", "nevada", "new hampshire", "new jersey", "new mexico", "new york", "north carolina", "north dakota", "ohio",
    "oklahoma", "oregon", "pennsylvania", "rhode island", "south carolina", "south dakota", "tennessee", "texas", "utah", "vermont", "virginia",
    "washington", "west virginia", "wisconsin", "wyoming",
)
US_KEYWORDS = ("united states", "usa", "u.s.", "us-remote", "remote - us", "remote, us", "remote (us)", "anywhere in the us")
NON_US_KEYWORDS = (
    "canada", "toronto", "vancouver", "united kingdom", "london", "ireland", "dublin", "india", "bangalore", "bengaluru", "hyderabad", "germany",
    "berlin", "france", "paris", "netherlands", "amsterdam", "poland", "spain", "singapore", "australia", "mexico", "brazil", "israel", "emea", "apac",
    "latam",
)
REMOTE_KEYWORDS = ("remote", "anywhere", "distributed")
NYC_METRO = (
    "new york", "nyc", "manhattan", "brooklyn", "queens", "bronx", "staten island", "long island city", "jersey city", "hoboken", "newark", "weehawken",
    "secaucus", "harrison, nj", "fort lee", "edison", "princeton", "iselin", "white plains", "stamford", "greenwich",
)


@dataclass(frozen=True)
class Hub:
    name: str
    lat: float
    lon: float


# fixed values: metro hubs
NYC, DC, PHILADELPHIA = Hub("nyc", 40.7128, -74.0060), Hub("dc", 38.9072, -77.0369), Hub("philadelphia", 39.9526, -75.1652)


@dataclass(frozen=True)
class Config:
    window_hours: dict[str, int] = field(default_factory=lambda: {"24h": 24, "7d": 168, "14d": 336})
    grace_hours: int = 2
    max_age_days: int = 14
    title_include: tuple[str, ...] = TITLE_INCLUDE
    title_exclude: tuple[str, ...] = TITLE_EXCLUDE
    red_flags: tuple[str, ...] = RED_FLAGS
    staffing_patterns: tuple[str, ...] = STAFFING_PATTERNS
    staffing_companies: tuple[str, ...] = STAFFING_COMPANIES
    us_states: tuple[str, ...] = tuple(US_STATES)
    us_keywords: tuple[str, ...] = US_KEYWORDS
    non_us_keywords: tuple[str, ...] = NON_US_KEYWORDS
    remote_keywords: tuple[str, ...] = REMOTE_KEYWORDS
    nyc_metro: tuple[str, ...] = NYC_METRO
    score_hubs: tuple[Hub, ...] = (NYC, DC)
    corridor_hubs: tuple[Hub, ...] = (DC, PHILADELPHIA)
    full_points_miles: float = 25
    zero_points_miles: float = 250
    nyc_metro_miles: float = 50
    corridor_miles: float = 50
    location_points: int = 10
    relevant_soc: tuple[str, ...] = ("15-2051", "15-1221", "15-1252")
    fuzzy_cutoff: float = 90.0
    min_similarity: float = 0.50
    max_shortlist: int = 60
    max_yoe: int = 4
    recency_points: int = 15
    tiebreak_divisor: int = 1000
    digest_jobs: int = 30
    min_core_fit: int = 50
    blocked_boards: tuple[tuple[str, str], ...] = (("greenhouse", "linkedin"),)
    min_board_jobs: int = 3
    batch_prices: tuple[float, float] = (0.50, 2.50)  # a million tokens in, out
    sync_prices: tuple[float, float] = (1.00, 5.00)


DEFAULT = Config()
