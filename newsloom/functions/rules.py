"""Rule columns over items: noise, freshness, score, budget, alerts, retention."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from newsloom.functions import fixed, urls
from newsloom.functions.text import bind

# An item as the rules see it.
ITEM_COLUMNS = [
    "item_id", "reader_id", "feed_id", "title", "link", "author", "image_url", "snippet",
    "reading_minutes", "has_full_text", "published_at", "is_read", "is_starred", "is_vip",
]


def any_of(phrases: list[str]) -> str:
    """One alternation that matches any phrase literally."""
    return "|".join(re.escape(p) for p in phrases)


def is_promotional(title: Column, link: Column | None = None) -> Column:
    by_title = F.lower(title).rlike(any_of(fixed.PROMOTIONAL_PHRASES))
    if link is None:
        return by_title
    return by_title | F.coalesce(urls.path(link).rlike(any_of(fixed.PROMOTIONAL_PATHS)), F.lit(False))


def is_clickbait(title: Column) -> Column:
    return F.lower(title).rlike(any_of(fixed.CLICKBAIT_PHRASES))


def age_hours(published_at: Column, now: Column) -> Column:
    seconds = (F.unix_micros(now) - F.unix_micros(published_at)) / F.lit(3_600_000_000.0)
    return F.greatest(F.lit(0.0), seconds)


def is_fresh(age: Column, is_read: Column, is_vip: Column) -> Column:
    limit = F.when(is_read, F.when(is_vip, 72).otherwise(48)).otherwise(F.when(is_vip, 720).otherwise(336))
    return age <= limit


def is_candidate(age: Column, noise: Column) -> Column:
    """May enter scoring: starred rows by age or unread state, others fresh and clean."""
    starred = (age <= 720) | ~F.col("is_read")
    other = (F.col("is_vip") | ~noise) & is_fresh(age, F.col("is_read"), F.col("is_vip"))
    return F.when(F.col("is_starred"), starred).otherwise(other)


def score(age: Column, is_starred: Column | None = None) -> Column:
    """Rule score of an item row; ``age`` in hours."""
    starred = F.col("is_starred") if is_starred is None else is_starred
    recency = (
        F.when(age < 3, 45).when(age < 8, 35).when(age < 18, 26).when(age < 36, 18)
        .when(age < 72, 8).when(age < 168, 2).otherwise(-15)
    )
    # Named once, so that a projection below is not repeated when Spark merges the two.
    depth = bind(
        F.struct("reading_minutes", F.length("snippet").alias("chars")),
        lambda d: F.when(d["reading_minutes"] >= 3, 12)
        .when(d["reading_minutes"] >= 1, 6)
        .when(d["chars"] >= 140, 6)
        .otherwise(0),
    )
    return (
        F.lit(40)
        + recency
        + F.when(F.col("is_read"), -18).otherwise(20)
        + F.when(starred, 45).otherwise(0)
        + F.when(F.col("is_vip"), 35).otherwise(0)
        + depth
        + F.when(F.col("has_full_text"), 10).otherwise(0)
        + F.when(F.length("image_url") > 0, 5).otherwise(0)
        + F.when(F.length("title") < 15, -12).otherwise(0)
        + F.when(is_clickbait(F.col("title")), -25).otherwise(0)
    )


def selection_budget(total: Column, candidates: Column) -> Column:
    grown = F.floor(F.sqrt(total) * 2.5).cast("int")
    return (
        F.when(candidates == 0, 0)
        .when(candidates <= 30, candidates)
        .otherwise(F.least(F.lit(80), F.greatest(F.lit(30), F.least(candidates, grown))))
        .cast("int")
    )


def _trimmed(title: Column) -> Column:
    return F.regexp_replace(title, f"^{fixed.WHITESPACE}+|{fixed.WHITESPACE}+$", "")


def title_may_alert(title: Column) -> Column:
    clean = _trimmed(title)
    return (F.length(clean) >= 15) & ~is_promotional(clean) & ~is_clickbait(clean)


def may_alert() -> Column:
    """Whether an item row is worth an alert the moment it appears."""
    clean = _trimmed(F.col("title"))
    other = (
        (F.length(clean) >= 15)
        & (F.col("is_vip") | ~is_promotional(clean, F.col("link")))
        & ~is_clickbait(clean)
        & (score(F.lit(0.0), F.lit(False)) >= 85)
    )
    return F.col("is_starred") | other


def expired(kind: str, days: int, now: Column) -> Column:
    """Unstarred ``read``/``unread`` items older than ``days``; zero or less switches it off."""
    if days <= 0:
        return F.lit(False)
    state = F.col("is_read") if kind == "read" else ~F.col("is_read")
    return state & ~F.col("is_starred") & (F.col("published_at") < now - F.make_dt_interval(F.lit(days)))
