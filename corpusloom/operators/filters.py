"""Filters and predicates. "Now" is always a parameter."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def feed_filter(rows: DataFrame, excluded: Sequence[str], now: Column, ahead_days: int, kind: str = "doc_type", date: str = "meeting_date", key: str | None = None, value=None) -> DataFrame:
    """Rows of other kinds than the excluded ones (a null kind is dropped) whose date is unknown or at most ``ahead_days`` ahead."""
    kept = rows.filter(~F.col(kind).isin(*excluded) & (F.col(date).isNull() | (F.col(date) <= F.date_add(now, ahead_days))))
    return kept if key is None or value in (None, "All") else kept.filter(F.col(key) == value)


def lookback_filter(rows: DataFrame, now: Column, days: int, date: str) -> DataFrame:
    return rows.filter(F.col(date) >= F.date_sub(now, days))


def review_threshold(rows: DataFrame, confidence: str, threshold: float, name: str = "needs_review") -> DataFrame:
    return rows.withColumn(name, F.col(confidence) < threshold)


def pattern_filter(rows: DataFrame, label: str, like: Sequence[str], unlike: Sequence[str], measures: Sequence[str]) -> DataFrame:
    """Labels like any of one set of patterns and none of another, where all measures are known."""
    text = F.lower(label)
    found = F.lit(False)
    for p in like:
        found = found | text.like(p)
    for p in unlike:
        found = found & ~text.like(p)
    for m in measures:
        found = found & F.col(m).isNotNull()
    return rows.filter(found)


def nonempty_json(rows: DataFrame, payload: str, date: str, cutoff: Column, key: str = "id") -> DataFrame:
    return rows.filter(F.col(payload).isNotNull() & (F.col(payload) != "[]") & (F.col(date) >= cutoff)).orderBy(F.col(date).desc_nulls_last(), F.col(key).desc())


def action_split(rows: DataFrame, action: str, deployed: Sequence[str]) -> DataFrame:
    """deployment for the given actions, policy for every other, blank ones too."""
    return rows.withColumn("stream", F.when(F.lower(F.coalesce(action, F.lit(""))).isin(*deployed), "deployment").otherwise("policy"))


def deployment_filter(rows: DataFrame, amount: str, least: int, action: str, actions: Sequence[str]) -> DataFrame:
    """A positive minimum drops unknown amounts; a minimum of 0 keeps them."""
    kept = rows.filter(F.col(action).isin(*actions))
    return kept.filter(F.col(amount) >= least) if least > 0 else kept


def policy_filter(rows: DataFrame, action: str, selected: Sequence[str] | None = None) -> DataFrame:
    """The selected actions; by default all but ``other``. Blanks are dropped."""
    known = F.col(action).isNotNull() & (F.trim(action) != "")
    return rows.filter(known & (F.col(action).isin(*selected) if selected is not None else F.col(action) != "other"))


def any_variant_filter(rows: DataFrame, name: str, variants: str, mentions: str, text: str, least: int) -> DataFrame:
    q = text.lower()
    hit = F.lower(name).contains(q) | F.exists(variants, lambda v: F.lower(v).contains(q))
    return rows.filter((F.col(mentions) >= least) & hit)


def basis_filter(rows: DataFrame, items: str, field: str, denied: Sequence[str]) -> DataFrame:
    """Drops the items of an array whose field is denied; an unknown field is kept."""
    return rows.withColumn(items, F.filter(items, lambda x: ~F.coalesce(x[field].isin(*denied), F.lit(False))))


def status_worklist(rows: DataFrame, status: str = "status", wanted: str = "pending") -> DataFrame:
    return rows.filter(F.col(status) == wanted)


def reset_failed(rows: DataFrame, status: str = "status") -> DataFrame:
    return rows.withColumn(status, F.when(F.col(status) == "failed", "pending").otherwise(F.col(status)))


def recipients(rows: DataFrame, status: str, confirmed: str, flag: str) -> DataFrame:
    return rows.filter((F.col(status) == confirmed) & F.col(flag))


def signup_throttle(tokens: DataFrame, keys: DataFrame, key: str, at: str, now: Column, seconds: int, most: int) -> DataFrame:
    """For each key, the tokens issued within the window and whether another is allowed."""
    recent = tokens.filter((F.col(at) > now - F.expr(f"interval {seconds} seconds")) & (F.col(at) <= now)).groupBy(F.lower(F.trim(key)).alias(key)).agg(F.count("*").alias("recent"))
    return keys.select(F.lower(F.trim(key)).alias(key)).distinct().join(recent, key, "left").select(key, F.coalesce("recent", F.lit(0)).alias("recent")).withColumn("allowed", F.col("recent") < most)


def entity_list(rows: DataFrame, *order: str, key: str | None = None, value=None) -> DataFrame:
    return (rows if key is None else rows.filter(F.col(key) == value)).orderBy(*order)


def publications_by_status(rows: DataFrame, status: str, wanted: Sequence[str], period: str, key: str = "id") -> DataFrame:
    return rows.filter(F.col(status).isin(*wanted)).orderBy(F.col(period).desc_nulls_last(), F.col(key).desc())


def min_date_gate(rows: DataFrame, date: str, floor: Column) -> DataFrame:
    """An unknown date passes, a known one before the floor does not."""
    return rows.filter(F.col(date).isNull() | (F.col(date) >= floor))
