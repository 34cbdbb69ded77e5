"""Search over profiles: fifteen filters, six orders and pages."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import filters
from .reliability import rank_by_evidence

#: Orders by name: what they sort by; ranked role scores are drawn to the mean of what was found.
SORTS = ("minutes", "name", "age", "market_value", "role_score", "role_score_ranked")
#: An unknown age comes after all known ones.
NO_AGE = 999


def passes(*, text: str | None = None, competition: str | None = None, club: str | None = None, sample_band: str | None = None, role: str | None = None, **more: object) -> Column:
    """All filters given, together. ``more`` are those of ``filters.predicate``; an unknown name, club, competition, band or role
    passes no filter on it. An empty text filters nothing."""
    out = filters.predicate(filters.SEARCH, **more)
    if text and text.strip():
        out = out & F.coalesce(F.contains(F.lower("name"), F.lit(text.strip().lower())), F.lit(False))
    for c, wanted in (("competition_id", competition), ("club_id", club), ("sample_band", sample_band), ("role", role)):
        out = out if wanted is None else out & F.coalesce(F.col(c) == wanted, F.lit(False))
    return out


def counts(profiles: DataFrame, asked: Sequence[tuple[str, Mapping[str, object]]], today: date | None = None) -> DataFrame:
    """(filter, found): for each of some named searches how many rows it finds, counted in one pass."""
    row = profiles.agg(*[F.count_if(passes(today=today, **a)).alias(name) for name, a in asked])
    return row.unpivot([], [name for name, _ in asked], "filter", "found")


def order(sort: str) -> list[Column]:
    if sort not in SORTS:
        raise ValueError(f"unknown order {sort}; there are {SORTS}")
    zero = lambda c: F.coalesce(F.col(c).cast("double"), F.lit(0.0))
    return [{"minutes": zero("minutes").desc(), "name": F.lower("name").asc(), "age": F.coalesce(F.nullif(F.col("age"), F.lit(0)), F.lit(NO_AGE)).asc(), "market_value": zero("market_value").desc(), "role_score": zero("role_score").desc(), "role_score_ranked": F.round("ranked", 9).desc()}[sort]]


def search(profiles: DataFrame, keys: list[str], sort: str = "minutes", offset: int = 0, limit: int = 25, **asked: object) -> DataFrame:
    """A page of the rows that pass all filters, in the order ``sort`` and by ``keys`` among equals, with ``ranked`` where that is by
    evidence. The sort keeps offset + limit rows in each task, however many are found."""
    rows = profiles.where(passes(**asked))
    by = order(sort)
    if sort == "role_score_ranked":
        rows = rank_by_evidence(rows.withColumn("_score", F.coalesce("role_score", F.lit(0.0))), "_score", "minutes").select(*profiles.columns, "ranked")
    return rows.orderBy(*by, *keys).offset(offset).limit(limit)
