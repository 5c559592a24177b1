"""Scores and states as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The bounds and weights of the sponsor match.
MATCH_LEAST, MATCH_MOST, SECTOR_WEIGHT, RATING_WEIGHT, BEST_RATING = 35, 99, 80, 20, 5


def rounded(x: Column) -> Column:
    """To the nearest whole number, halves upwards."""
    return F.floor(x + 0.5)


def share(part: Column, whole: Column) -> Column:
    """part of whole in percent; a whole below 1 counts as 1."""
    return part / F.greatest(F.lit(1), whole) * 100


def bar_width(value: Column, most: Column) -> Column:
    """value in percent of most, 100 at most; 0 where most isn't positive."""
    return F.when(most > 0, F.least(F.lit(100.0), F.try_divide(value, most) * 100)).otherwise(0.0)


def sponsor_match(industry: Column, sectors: Column, rating: Column) -> Column:
    """How well a sponsor fits: sectors that contain its industry or are contained in it, and its rating."""
    own = F.lower(industry)
    shared = F.filter(sectors, lambda s: F.contains(F.lower(s), own) | F.contains(own, F.lower(s)))
    ratio = F.coalesce(F.try_divide(F.size(shared), F.size(sectors)), F.lit(0.0))
    score = rounded(SECTOR_WEIGHT * ratio + RATING_WEIGHT * F.coalesce(rating, F.lit(0.0)) / BEST_RATING)
    return F.greatest(F.lit(MATCH_LEAST), F.least(F.lit(MATCH_MOST), score)).cast("long")


def available(total: Column, taken: Column) -> Column:
    return F.greatest(F.lit(0), total - F.coalesce(taken, F.lit(0)))


def pair(a: Column, b: Column) -> Column:
    """The two in order, so that a pair has one form."""
    return F.struct(F.least(a, b).alias("user_a"), F.greatest(a, b).alias("user_b"))


def other_party(me: Column, a: Column, b: Column) -> Column:
    return F.when(a == me, b).otherwise(a)


def next_of(order: list[str], state: Column) -> Column:
    """The state after this one, the first after the last (and after an unknown one)."""
    states = F.array(*map(F.lit, order))
    return F.element_at(states, (F.array_position(states, state) % len(order) + 1).cast("int"))
