"""Elapsed days, follow-up levels, business days, campaign age, dates in text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from leadloom.functions.numbers import ladder

DAY_SECONDS = 86400


def timestamp_lit(value) -> Column:
    """``as_of`` arguments may be a Column, a datetime or an ISO string."""
    if isinstance(value, Column):
        return value
    return F.lit(value).cast("timestamp")


def days_since(as_of, ts: Column) -> Column:
    """Whole elapsed days (24 h blocks, not calendar days), never below 0."""
    seconds = F.unix_micros(timestamp_lit(as_of)) - F.unix_micros(ts.cast("timestamp"))
    return F.greatest(F.floor(seconds / (DAY_SECONDS * 1_000_000)), F.lit(0)).cast("int")


def followup_level(days: Column) -> Column:
    return F.when(days >= 3, ladder(days, [(14, "final"), (7, "high")], "normal"))


def followup_rank(level: Column) -> Column:
    return F.when(level == "final", 3).when(level == "high", 2).when(level == "normal", 1).otherwise(0)


def add_business_days(ts: Column, n: int) -> Column:
    """``n`` weekdays after ``ts``; the time of day is kept.

    Closed form: a start on a weekend behaves like the Friday before it, and
    every full block of five weekdays then costs seven calendar days.
    """
    if n <= 0:
        return ts
    dow = F.weekday(ts)  # Monday = 0
    anchor_shift = F.greatest(dow - 4, F.lit(0))
    anchor = F.least(dow, F.lit(4))
    remaining = anchor + F.lit(n)
    calendar = F.lit(n) + F.floor(remaining / 5) * 2 - anchor_shift
    return (ts + F.make_dt_interval(calendar.cast("int"))).cast("timestamp")


def age_bucket(end_date: Column, as_of) -> Column:
    today = F.to_date(timestamp_lit(as_of))
    return (
        F.when(end_date.isNull(), "unknown")
        .when(end_date.cast("date") < today, "ended")
        .otherwise("live")
    )


def campaign_state(end_date: Column, as_of) -> Column:
    today = F.to_date(timestamp_lit(as_of))
    return F.when(end_date.cast("date") < today, "ended").when(end_date.isNotNull(), "live")


def days_remaining(end_date: Column, as_of) -> Column:
    left = F.datediff(end_date.cast("date"), F.to_date(timestamp_lit(as_of)))
    return F.when(left >= 0, left)


def japanese_date_after(text: Column, anchor: str) -> Column:
    """First ``YYYY年M月D日`` within a few characters of the anchor word."""
    head = "".join("\\" + c if c in r".^$*+?{}[]\|()" else c for c in anchor)
    return _date_from_parts(text, head + r"[\s\S]{0,12}?(\d{4})年\s*(\d{1,2})月\s*(\d{1,2})日")


def _date_from_parts(text: Column, pattern: str) -> Column:
    parts = [F.regexp_extract(text, pattern, i) for i in (1, 2, 3)]
    iso = F.concat_ws("-", parts[0], F.lpad(parts[1], 2, "0"), F.lpad(parts[2], 2, "0"))
    return F.when(parts[0] != "", F.try_to_timestamp(iso, F.lit("yyyy-MM-dd")).cast("date"))


def days_left_in_text(text: Column) -> Column:
    """``12 days left`` as a number."""
    return F.nullif(F.regexp_extract(text, r"(\d+)\s*day", 1), F.lit("")).cast("int")
