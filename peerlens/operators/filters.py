"""Predicates over attributes, each with a stated answer for unknown values."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import date

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.rates import expires_within


@dataclass(frozen=True)
class Policy:
    """Whether an unknown age, an unknown value against a minimum and an unknown nationality pass."""

    age_passes: bool = False
    min_value_passes: bool = False
    min_value_as_zero: bool = False
    nationality_passes: bool = False


SEARCH = Policy(min_value_as_zero=True)
RECRUITMENT = Policy(min_value_passes=True)
SIMILARITY = Policy(age_passes=True, nationality_passes=True)
OPPORTUNITY = Policy()


def known_or(test: Column, passes: bool) -> Column:
    return F.coalesce(test, F.lit(passes))


def predicate(policy: Policy, *, age_min=None, age_max=None, value_min=None, value_max=None, nationality=None, minutes_min=None, height_min=None, expires=None, today: date | None = None, foot=None, group=None) -> Column:
    """All given conditions together, over age, market_value, nationality, minutes, height, contract_expires, foot and
    peer_group. A maximum value is a budget: an unknown value fails everywhere. Unknown minutes and heights count as 0."""
    out = F.lit(True)
    if group is not None:
        out = out & known_or(F.col("peer_group") == group, False)
    if age_min is not None:
        out = out & known_or(F.col("age") >= age_min, policy.age_passes)
    if age_max is not None:
        out = out & known_or(F.col("age") <= age_max, policy.age_passes)
    if value_max is not None:
        out = out & known_or(F.col("market_value") <= value_max, False)
    if value_min is not None:
        value = F.coalesce("market_value", F.lit(0)) if policy.min_value_as_zero else F.col("market_value")
        out = out & known_or(value >= value_min, policy.min_value_passes)
    if nationality is not None:
        out = out & known_or(F.col("nationality") == nationality, policy.nationality_passes)
    if minutes_min is not None:
        out = out & (F.coalesce("minutes", F.lit(0)) >= minutes_min)
    if height_min is not None:
        out = out & (F.coalesce("height", F.lit(0)) >= height_min)
    if expires is not None:
        out = out & expires_within("contract_expires", today, expires)
    if foot is not None:
        out = out & known_or(F.col("foot") == foot, False)
    return out


def funnel(criteria: list[tuple[str, Column]]) -> list[Column]:
    """Aggregates for one pass: how many rows are left after each criterion in turn."""
    out, left = [F.count("*").alias("all")], F.lit(True)
    for name, test in criteria:
        left = left & F.coalesce(test, F.lit(False))
        out.append(F.count_if(left).alias(name))
    return out
