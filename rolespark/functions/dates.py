"""Windows, ages and the points that follow from them. "Now" is always the as_of parameter."""

from __future__ import annotations

from datetime import date, datetime, timedelta

from pyspark.sql import Column
from pyspark.sql import functions as F

from rolespark.config import DEFAULT, Config

#: Rank scores count days from here.
EPOCH = date(2026, 1, 1)


def compute_since(as_of: datetime | Column, window: str, config: Config = DEFAULT) -> datetime | Column:
    """Where a run at as_of begins to look: the window and its grace before, the age cap at most."""
    hours = min(config.window_hours[window] + config.grace_hours, config.max_age_days * 24)
    return as_of - (F.make_dt_interval(hours=F.lit(hours)) if isinstance(as_of, Column) else timedelta(hours=hours))


def age_days(posted_at: Column, as_of: Column) -> Column:
    return (F.unix_micros(as_of) - F.unix_micros(posted_at)) / 86_400_000_000.0


def recency_points(posted_at: Column, as_of: Column, config: Config = DEFAULT) -> Column:
    """Full points for a posting of just now, none at the age cap, half-even rounded; 0 without a date."""
    share = F.greatest(1 - F.greatest(age_days(posted_at, as_of), F.lit(0.0)) / config.max_age_days, F.lit(0.0))
    return F.when(posted_at.isNull(), 0).otherwise(F.rint(config.recency_points * share).cast("int"))


def rank_score(posted_at: Column, fit: Column, config: Config = DEFAULT) -> Column:
    return F.date_diff(F.to_date(posted_at), F.lit(EPOCH)) + fit / config.tiebreak_divisor


def display_fit(core_fit: Column, posted_at: Column, as_of: Column, config: Config = DEFAULT) -> Column:
    points = recency_points(posted_at, as_of, config)
    return F.struct(points.alias("recency"), (core_fit + points).alias("total"))
