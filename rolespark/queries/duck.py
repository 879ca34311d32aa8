"""Parts of oracle texts: the string rules in DuckDB SQL."""

from __future__ import annotations

from rolespark.config import DEFAULT, US_STATE_NAMES
from rolespark.functions.text import LEGAL_SUFFIXES


def quote(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def squeezed(x: str) -> str:
    return rf"trim(regexp_replace(regexp_replace({x}, '[^\w\s]', ' ', 'g'), '\s+', ' ', 'g'))"


def norm_company(x: str) -> str:
    the = rf"trim(regexp_replace({squeezed(f"replace(lower({x}), '&', ' and ')")}, '^the\b\s*', ''))"
    return rf"trim(regexp_replace({the}, '(\b({'|'.join(LEGAL_SUFFIXES)})\b\s*)+$', ''))"


def norm_excluded(x: str) -> str:
    return rf"regexp_replace({norm_company(x)}, '(\s+(technologies|technology|tech))+$', '')"


def norm_title(x: str) -> str:
    modes = rf"regexp_replace({squeezed(f'lower({x})')}, '\b(remote|hybrid|onsite|on site)\b', ' ', 'g')"
    return rf"trim(regexp_replace(regexp_replace({modes}, '\b(req|job|jr|r)?\s*\d{{3,}}\w*\s*$', ' '), '\s+', ' ', 'g'))"


def norm_location(x: str) -> str:
    return squeezed(f"lower(coalesce({x}, ''))")


def any_of(x: str, patterns) -> str:
    return f"regexp_matches({x}, {quote('(?i)' + '|'.join(f'({p})' for p in patterns))})"


def title_matches(x: str) -> str:
    return f"({any_of(x, DEFAULT.title_include)} AND NOT {any_of(x, DEFAULT.title_exclude)})"


def contains_any(x: str, words) -> str:
    return "(" + " OR ".join(f"contains({x}, {quote(w)})" for w in words) + ")"


def non_us(x: str) -> str:
    return rf"regexp_matches(lower({x}), '(^|\W)({'|'.join(DEFAULT.non_us_keywords)})($|\W)')"


def us_signal(x: str) -> str:
    parts = (r"(?i)\bunited states\b|\bus[- ]based\b|\bu\.s\.|\busa\b|\bus only\b", rf"(?i)\b({'|'.join(US_STATE_NAMES)})\b", rf"\b[A-Z][A-Za-z.]+( [A-Z][A-Za-z.]+)*,\s*({'|'.join(DEFAULT.us_states)})\b", r"\$\s?\d{2,3}(,\d{3})?(\.\d+)?\s?[kK]?\s*(-|to)\s*\$?\s?\d{2,3}")
    return "(" + " OR ".join(f"regexp_matches({x}, {quote(p)})" for p in parts) + ")"


def is_us(loc: str, desc: str) -> str:
    t = f"lower(trim(coalesce({loc}, '')))"
    state = rf"regexp_matches(trim(coalesce({loc}, '')), '(,\s*|^|[-/(]\s*)({'|'.join(DEFAULT.us_states)})\b')"
    return f"CASE WHEN {non_us(t)} THEN false WHEN {contains_any(t, DEFAULT.us_keywords)} OR {state} THEN true WHEN {is_remote(loc)} AND coalesce({desc}, '') <> '' THEN {us_signal(desc)} AND NOT {non_us(desc)} ELSE false END"


def is_remote(loc: str) -> str:
    return contains_any(f"lower(coalesce({loc}, ''))", DEFAULT.remote_keywords)


def is_nyc(loc: str) -> str:
    return contains_any(f"lower(coalesce({loc}, ''))", DEFAULT.nyc_metro)
