"""Weighted composites with coverage gates, roles and role fit, as row-local expressions over percentile columns."""

from __future__ import annotations

import math
from collections.abc import Collection, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.rates import clamp
from ..spec import Role, Score


def _sum(cols: Sequence[Column]) -> Column:
    out = cols[0]
    for c in cols[1:]:
        out = out + c
    return out


def normalised(weights: Mapping[str, float], known: Collection[str] | None = None) -> dict[str, float]:
    """The positive weights as shares that sum to 1. Names that nothing defines, weights that are no numbers and no positive weight
    at all are errors."""
    if known is not None and (unknown := set(weights) - set(known)):
        raise ValueError(f"unknown {sorted(unknown)}")
    if bad := [n for n, w in weights.items() if not math.isfinite(w) or w < 0]:
        raise ValueError(f"no weights: {sorted(bad)}")
    total = float(sum(weights.values()))
    if total <= 0:
        raise ValueError("no positive weight")
    return {n: w / total for n, w in weights.items() if w > 0}


def _present(weights: Mapping[str, float]) -> Column:
    return _sum([F.when(F.col(c).isNotNull(), F.lit(float(w))).otherwise(F.lit(0.0)) for c, w in weights.items()])


def _total(weights: Mapping[str, float]) -> Column:
    return _sum([F.coalesce(clamp(F.col(c)) * F.lit(float(w)), F.lit(0.0)) for c, w in weights.items()])


def coverage(weights: Mapping[str, float]) -> Column:
    """The known components' share of all weights."""
    total = float(sum(weights.values()))
    if total <= 0:
        raise ValueError("weights must have a positive sum")
    return _present(weights) / F.lit(total)


def weighted(weights: Mapping[str, float], min_coverage: float = 1.0) -> Column:
    """The weighted mean of the known components, each within 0 to 100; null under the coverage gate."""
    present = _present(weights)
    return F.when((coverage(weights) >= min_coverage) & (present > 0), clamp(_total(weights) / present))


def contributions(weights: Mapping[str, float]) -> Column:
    """array<struct<part, name>> of what each known component adds to the score, the largest first."""
    present = _sum([F.when(F.col(c).isNotNull(), F.lit(float(w))).otherwise(F.lit(0.0)) for c, w in weights.items()])
    parts = [F.when(F.col(c).isNotNull() & (present > 0), F.struct((clamp(F.col(c)) * F.lit(float(w)) / present).alias("part"), F.lit(c).alias("name"))) for c, w in weights.items()]
    return F.sort_array(F.array_compact(F.array(*parts)), asc=False)


def dominant(weights: Mapping[str, float], share: float = 0.4) -> Column:
    """The component that adds most to the score, if that is at least ``share`` of it."""
    first, total = F.get(contributions(weights), F.lit(0)), weighted(weights, 1e-9)
    return F.when(first["part"] >= share * total, first["name"])


def with_scores(wide: DataFrame, scores: Sequence[Score]) -> DataFrame:
    return wide.select("*", *[weighted(s.weights, s.min_coverage).alias(f"score:{s.name}") for s in scores])


def unproducible(wide: DataFrame, scores: Sequence[Score]) -> DataFrame:
    """(score, producible): whether enough of a score's components are known for anyone at all."""
    names = sorted({c for s in scores for c in s.weights})
    seen = wide.agg(*[(F.count(c) > 0).alias(c) for c in names])
    one = lambda s: F.struct(F.lit(s.name).alias("score"), (_sum([F.when(F.col(c), F.lit(float(w))).otherwise(F.lit(0.0)) for c, w in s.weights.items()]) / F.lit(float(sum(s.weights.values()))) >= s.min_coverage).alias("producible"))
    return seen.select(F.explode(F.array(*[one(s) for s in scores])).alias("s")).select("s.*")


def role_columns(wide: DataFrame, group: str, roles: Sequence[Role], keep: Sequence[str]) -> DataFrame:
    """``keep`` and a column for each role, struct<role, raw, coverage, validity>, null if it isn't open to a row's group.

    validity: unavailable under the coverage floor, full if every core dimension has a known metric, else partial. Each step uses
    the columns of the one before, so that what occurs twice is worked out once and the generated code stays small."""
    own = {r.name: {f"`{c}`": w for c, w in r.weights.items()} for r in roles}
    at = lambda kind, r: F.col(f"`{kind}:{r.name}`")
    steps = wide.select("*", *[_present(own[r.name]).alias(f"_present:{r.name}") for r in roles], *[_total(own[r.name]).alias(f"_total:{r.name}") for r in roles])
    share = {r.name: at("_present", r) / F.lit(float(sum(r.weights.values()))) for r in roles}
    raw = [F.when((share[r.name] >= r.min_coverage) & (at("_present", r) > 0), clamp(at("_total", r) / at("_present", r))).alias(f"_raw:{r.name}") for r in roles]
    steps = steps.select(*dict.fromkeys([*keep, group]), *[at("_present", r) for r in roles], *raw, *[_met(r).alias(f"_met:{r.name}") for r in roles])
    validity = {r.name: F.when(at("_raw", r).isNull(), "unavailable").when(at("_met", r), "full").otherwise("partial") for r in roles}
    made = [F.when(F.col(group).isin(*r.groups), F.struct(F.lit(r.name).alias("role"), at("_raw", r).alias("raw"), share[r.name].alias("coverage"), validity[r.name].alias("validity"))).alias(r.name) for r in roles]
    return steps.select(*keep, *made)


def _met(r: Role) -> Column:
    """Whether each core dimension of a role has a known metric."""
    met = F.lit(True)
    for own in r.core.values():
        met = met & F.coalesce(*[F.col(m) for m in own]).isNotNull()
    return met


def with_roles(wide: DataFrame, keys: Sequence[str], group: str, roles: Sequence[Role]) -> DataFrame:
    """(keys, role, raw, coverage, validity) for each role open to a row's group."""
    made = role_columns(wide, group, roles, keys)
    return made.select(*keys, F.explode(F.array_compact(F.array(*[r.name for r in roles]))).alias("r")).select(*keys, "r.*")


def coverage_band(c: Column) -> Column:
    return F.when(c >= 0.95, "complete").when(c >= 0.75, "good").otherwise("limited")


def best_role(fits: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Per key the full role of highest standing (percentile, else raw score), by name among equals."""
    standing = F.coalesce("fit", "raw")
    w = Window.partitionBy(*keys).orderBy(standing.desc(), F.col("role"))
    return fits.where("validity = 'full'").withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r").withColumn("standing", standing)


def best_of(roles: Sequence[str]) -> Column:
    """struct<standing, role, raw, fit> of what ``best_role`` finds among one row's ``roles``, columns of structs with role, raw, validity
    and fit; null if none is full. Nothing moves."""

    def one(r: str) -> Column:
        of = lambda f: F.col(f"`{r}`.{f}")
        standing = F.coalesce(of("fit"), of("raw"))
        return F.when(of("validity") == "full", F.struct((-standing).alias("order"), of("role").alias("role"), of("raw").alias("raw"), of("fit").alias("fit"), standing.alias("standing")))

    return F.array_min(F.array(*[one(r) for r in roles]))
