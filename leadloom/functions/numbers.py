"""Number handling: rounding to scores, funding rates, score bands, money text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def clamp(value: Column) -> Column:
    """Half-even round, then 0..100, as int. NULL stays NULL."""
    bounded = F.least(F.greatest(F.bround(value.cast("double"), 0), F.lit(0.0)), F.lit(100.0))
    return F.when(value.isNotNull(), bounded).cast("int")


def whole(value: Column) -> Column:
    """Truncate toward zero."""
    return value.cast("double").cast("long")


def ladder(value: Column, steps, default) -> Column:
    """First step whose lower bound the value reaches; ``steps`` run downwards."""
    out = None
    for bound, label in steps:
        hit = value >= bound
        out = F.when(hit, F.lit(label)) if out is None else out.when(hit, F.lit(label))
    return out.otherwise(F.lit(default))


# --- funding rate: three readings that must stay apart ---------------------

def funding_ratio(raised: Column, goal: Column) -> Column:
    g = goal.cast("double")
    return F.when(g > 0, F.try_divide(raised.cast("double"), g))


def funding_percent_rounded(raised: Column, goal: Column) -> Column:
    return F.bround(funding_ratio(raised, goal) * 100, 0).cast("long")


def funding_percent_truncated(raised: Column, goal: Column) -> Column:
    return whole(funding_ratio(raised, goal) * 100)


def goal_from_percent(amount: Column, percent: Column) -> Column:
    """Goal implied by an amount raised and the percent funded, in whole units."""
    pct = percent.cast("decimal(20,6)")
    goal = F.when(pct > 0, F.try_divide(amount.cast("decimal(20,2)") * 100, pct))
    return F.bround(goal, 0).cast("decimal(16,0)")


# --- bands ------------------------------------------------------------------

def grade(score: Column) -> Column:
    s = clamp(score)
    return F.when(
        score.isNotNull(),
        ladder(s, [(80, "A"), (65, "B"), (50, "C"), (35, "D")], "E"),
    )


def workflow_stars(score: Column) -> Column:
    return ladder(score, [(80, 5), (60, 4), (40, 3), (20, 2)], 1)


def executive_stars(score: Column) -> Column:
    return ladder(score, [(85, 5), (65, 4), (45, 3), (25, 2)], 1)


def fit_level(score: Column) -> Column:
    return ladder(score, [(67, "high"), (40, "mid")], "low")


def priority_label(score: Column) -> Column:
    return ladder(score, [(67, "high"), (40, "medium")], "low")


def sales_priority(score: Column) -> Column:
    return ladder(F.coalesce(score, F.lit(0)), [(70, "high"), (40, "medium")], "low")


def ratio_percent(numerator: Column, denominator: Column) -> Column:
    """Percent to one place, NULL on an empty denominator."""
    share = F.when(denominator != 0, F.try_divide(numerator * 100.0, denominator.cast("double")))
    return F.bround(share, 1)
