"""Profiles compared by the cosine of their centred percentiles."""

from __future__ import annotations

import math
from collections.abc import Sequence
from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.rates import expires_within
from ..sources.shared import apart, written
from .reliability import rank_by_evidence

CENTRE = 50.0
MIN_SHARED = 5
MIN_INDEX = 50.0
#: Features up to which a comparison is plain arithmetic; that of more would make more code than the JVM compiles.
PLAIN = 16


def required(expected: int, least: int = MIN_SHARED) -> int:
    return max(least, math.ceil(0.5 * expected))


def vector(features: Sequence[str]) -> Column:
    """The centred percentiles in order; unknown ones are null."""
    return F.array(*[F.col(f) - F.lit(CENTRE) for f in features])


def _fold(pairs: Column, term) -> Column:
    return F.aggregate(pairs, F.lit(0.0), lambda acc, p: acc + term(p))


def compare(a: Column, b: Column) -> Column:
    """struct(shared, cosine, strength) over the features that both have; cosine 0 if either has no length."""
    shared = F.filter(F.arrays_zip(a.alias("a"), b.alias("b")), lambda p: p["a"].isNotNull() & p["b"].isNotNull())
    return F.transform(F.array(shared), _measures)[0]


def _measures(shared: Column) -> Column:
    dot = _fold(shared, lambda p: p["a"] * p["b"])
    na, nb = F.sqrt(_fold(shared, lambda p: p["a"] * p["a"])), F.sqrt(_fold(shared, lambda p: p["b"] * p["b"]))
    cosine = F.when((na > 0) & (nb > 0), dot / (na * nb)).otherwise(F.lit(0.0))
    strength = F.when((na == 0) & (nb == 0), F.lit(1.0)).otherwise(F.least(na, nb) / F.greatest(na, nb))
    return F.struct(F.size(shared).alias("shared"), cosine.alias("cosine"), strength.alias("strength"))


def compared(pairs: DataFrame, a: Sequence[str], b: Sequence[str]) -> DataFrame:
    """``pairs`` with _shared, _cosine and _strength: what ``compare`` finds for the vectors of the columns ``a`` and ``b``."""
    if len(a) > PLAIN:
        found = pairs.withColumn("_m", compare(F.array(*a), F.array(*b)))
        return found.select(*pairs.columns, *[F.col(f"_m.{c}").alias(f"_{c}") for c in ("shared", "cosine", "strength")])
    both = [(F.col(x), F.col(y)) for x, y in zip(a, b, strict=True)]
    total = lambda term, none: sum((F.when(x.isNotNull() & y.isNotNull(), term(x, y)).otherwise(none) for x, y in both), none)
    zero = F.lit(0.0)
    own = apart(pairs.select("*", total(lambda x, y: F.lit(1), F.lit(0)).alias("_shared")))
    sums = apart(own.select("*", total(lambda x, y: x * y, zero).alias("_dot"), F.sqrt(total(lambda x, y: x * x, zero)).alias("_na"), F.sqrt(total(lambda x, y: y * y, zero)).alias("_nb")))
    na, nb = F.col("_na"), F.col("_nb")
    cosine = F.when((na > 0) & (nb > 0), F.col("_dot") / (na * nb)).otherwise(zero)
    strength = F.when((na == 0) & (nb == 0), F.lit(1.0)).otherwise(F.least(na, nb) / F.greatest(na, nb))
    return sums.select(*pairs.columns, "_shared", cosine.alias("_cosine"), strength.alias("_strength"))


def index(cosine: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), cosine)) * 100.0


def gaps(a: Column, b: Column, features: Sequence[str]) -> Column:
    """array<struct<gap, place, feature>> of shared features, the closest first, in the given order among equals."""
    names = F.array(*[F.lit(f) for f in features])
    zipped = F.transform(F.arrays_zip(a.alias("a"), b.alias("b"), names.alias("f")), lambda p, i: F.when(p["a"].isNotNull() & p["b"].isNotNull(), F.struct(F.abs(p["a"] - p["b"]).alias("gap"), i.alias("place"), p["f"].alias("feature"))))
    return F.sort_array(F.array_compact(zipped))


def coverage_band(shared: Column, expected: int) -> Column:
    """How much of the profile both have."""
    share = shared / F.lit(float(expected))
    return F.when(share >= 0.85, "high").when(share >= 0.65, "good").when(share >= 0.5, "limited").otherwise("very limited")


def allowed(
    *, age_min=None, age_max=None, value_max=None, competitions=None, nationalities=None, other_competition=False, other_club=False, younger=False, expires=None, today: date | None = None, recorded_min=None
) -> Column:
    """All given conditions on a candidate's columns, and on its target's, which are named target_<column>.

    An unknown age, nationality or club passes; an unknown value isn't within a budget, an unknown contract isn't about to
    expire, and unknown recorded minutes are 0."""
    of = lambda c: F.col(f"target_{c}")
    tests = [
        (age_min is not None, lambda: F.coalesce(F.col("age") >= age_min, F.lit(True))),
        (age_max is not None, lambda: F.coalesce(F.col("age") <= age_max, F.lit(True))),
        (value_max is not None, lambda: F.coalesce(F.col("market_value") <= value_max, F.lit(False))),
        (competitions is not None, lambda: F.coalesce(F.col("competition_id").isin(*competitions), F.lit(False))),
        (nationalities is not None, lambda: F.coalesce(F.col("nationality").isin(*nationalities), F.lit(True))),
        (other_competition, lambda: ~F.col("competition_id").eqNullSafe(of("competition_id"))),
        (other_club, lambda: F.coalesce(F.col("club_id") != of("club_id"), F.lit(True))),
        (younger, lambda: F.coalesce(F.col("age") < of("age"), F.lit(True))),
        (expires is not None, lambda: expires_within("contract_expires", today, expires)),
        (recorded_min is not None, lambda: F.coalesce("recorded_minutes", F.lit(0)) >= recorded_min),
    ]
    out = F.lit(True)
    for asked, test in tests:
        out = out & test() if asked else out
    return out


def similar(rows: DataFrame, targets: DataFrame, by: Sequence[str], key: str, features: Sequence[str], minutes: str, least: int = MIN_SHARED, carry: Sequence[str] = (), allow: Column | None = None, keep: bool = False, ranked: bool = True) -> DataFrame:
    """For each target the rows of its group that are like it: index, strength, shared, band, and ranked by evidence.

    ``rows`` and ``targets``: ``by``, ``key``, ``minutes``, the features and what ``carry`` names. ``allow`` is a condition on
    carried columns, as ``allowed`` makes; only what it allows counts as a candidate. ``keep``: the carried columns stay, the
    target's as target_<column>. Rows are drawn to the mean of all
    candidates of the target before those under MIN_INDEX are left out; not if ``ranked`` is false. A target needs ``least`` features, a
    pair half of all. Targets are what a caller asks for; they are written, so that Spark knows how few they are and moves no row to
    them; each of their groups is read once."""
    parts = lambda side: [(F.col(f) - F.lit(CENTRE)).alias(f"{side}{i}") for i, f in enumerate(features)]
    t = targets.select(*by, F.col(key).alias("target"), vector(features).alias("_t"), *parts("_t"), *[F.col(c).alias(f"target_{c}") for c in carry])
    t = written(t.where(F.size(F.array_compact("_t")) >= least), "targets")
    c = rows.select(*by, key, minutes, vector(features).alias("_c"), *parts("_c"), *[x for x in carry if x != minutes])
    pairs = c.join(t, list(by)).where(F.col(key) != F.col("target"))
    if allow is not None:
        pairs = pairs.where(allow)
    shared = F.col("_shared")
    pairs = compared(pairs, *[[f"{side}{i}" for i in range(len(features))] for side in ("_t", "_c")]).where(shared >= required(len(features), least))
    kept = [x for c in carry for x in ([c] if c != minutes else []) + [f"target_{c}"]] if keep else []
    measured = pairs.select(*by, "target", key, minutes, *kept, shared.alias("shared"), coverage_band(shared, len(features)).alias("band"), index(F.col("_cosine")).alias("index"), F.col("_strength").alias("strength"), gaps(F.col("_t"), F.col("_c"), features).alias("gaps"))
    if ranked:
        measured = rank_by_evidence(measured, "index", minutes, [*by, "target"])
    return measured.where(F.col("index") >= MIN_INDEX)


def properties(pairs: DataFrame, rows: DataFrame, by: Sequence[str], key: str, saturated: float) -> DataFrame:
    """(property, checked, violations) of similar pairs (by, target, key, index) of some targets; ``rows`` (by, key) are all there
    are. Where two targets found each other, both directions are joined and must agree. Tells apart is violated by the targets
    whose closest row is at ``saturated`` or above, if more than a tenth are."""
    known = rows.select(*by, key).distinct().withColumn("_known", F.lit(True))
    held = pairs.join(known, [*by, key], "left")
    count = lambda df, name, bad: df.agg(F.lit(name).alias("property"), F.count("*").alias("checked"), F.count_if(bad).alias("violations"))
    back = pairs.select(*by, F.col("target").alias(key), F.col(key).alias("target"), F.col("index").alias("_back"))
    tops = pairs.groupBy(*by, "target").agg(F.max("index").alias("_top"))
    high = F.count_if(F.col("_top") >= saturated)
    parts = [
        count(held, "own group", F.col("_known").isNull()), count(pairs, "not itself", F.col("target") == F.col(key)),
        count(pairs.join(back, [*by, "target", key]), "both directions", F.abs(F.col("index") - F.col("_back")) > 1e-6), count(pairs, "within bounds", ~F.col("index").between(0, 100)),
        tops.agg(F.lit("tells apart").alias("property"), F.count("*").alias("checked"), F.when(high > 0.1 * F.count("*"), high).otherwise(F.lit(0)).alias("violations")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
