"""Weights of scores derived from definitions: a role's preset, its measurability, and weights moved off missing scores."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..spec import Role, Score

STEP = 5


def preset(role: Role, scores: Sequence[Score]) -> dict[str, int] | None:
    """Score weights in steps of 5 that sum to 100. A metric's weight is shared by the scores that have it; None if less
    than half of the role's weight can be expressed."""
    owners = {m: [s.name for s in scores if m in s.weights] for m in role.weights}
    carried: dict[str, float] = {}
    for part, w in role.weights.items():
        names = [part[6:]] if part.startswith("score:") else owners[part]
        for n in names:
            carried[n] = carried.get(n, 0.0) + w / len(names)
    total = sum(role.weights.values())
    if sum(carried.values()) < 0.5 * total:
        return None
    scale = 100 / sum(carried.values())
    steps = {n: STEP * round(w * scale / STEP) for n, w in carried.items()}
    steps = {n: w for n, w in steps.items() if w}
    if not steps:
        return None
    largest = max(steps, key=lambda n: (steps[n], n))
    steps[largest] = max(STEP, steps[largest] + 100 - sum(steps.values()))
    return dict(sorted(steps.items(), key=lambda x: (-x[1], x[0])))


#: Measurable shares below which a preset no longer covers its role, or only some of it.
LIMITED, MINIMAL = 0.85, 0.55


def measurability(share: float) -> str:
    return "full" if share >= LIMITED else "limited" if share >= MINIMAL else "minimal"


def measured(weights: DataFrame, role: str, score: str, weight: str, producible: str) -> DataFrame:
    """(role, measurable, measurability, blocked, weights) of presets, one row of ``weights`` for each score of a preset: the share of
    its weight on scores that the data can produce, what that makes it, and the scores that it can't."""
    total = F.sum(weight)
    share = F.round(F.coalesce(F.sum(F.when(F.col(producible), F.col(weight))), F.lit(0)) / total, 9)
    names = F.array_join(F.sort_array(F.collect_list(F.when(~F.col(producible), F.col(score)))), ",")
    parts = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct((-F.col(weight)).alias("w"), F.col(score).alias("s")))), lambda x: F.concat(x["s"], F.lit(":"), (-x["w"]).cast("string"))), ",")
    out = weights.groupBy(role).agg(share.alias("measurable"), names.alias("blocked"), parts.alias("weights"))
    band = F.when(F.col("measurable") < MINIMAL, "minimal").when(F.col("measurable") < LIMITED, "limited").otherwise("full")
    return out.select(role, "measurable", band.alias("measurability"), "blocked", "weights")


def moved(weights: Mapping[str, int], available: set[str]) -> dict[str, int]:
    """Weights of what is available, with the rest's weight shared in proportion; largest remainders keep the sum."""
    kept = {n: w for n, w in weights.items() if n in available and w > 0}
    total, own = sum(weights.values()), sum(kept.values())
    if not own:
        return {}
    exact = {n: w * total / own for n, w in kept.items()}
    out = {n: int(x) for n, x in exact.items()}
    for n in sorted(exact, key=lambda n: (out[n] - exact[n], n))[: total - sum(out.values())]:
        out[n] += 1
    return out


def impact(missing: set[str], scores: Sequence[Score], roles: Sequence[Role]) -> dict[str, list[str]]:
    """Scores and roles that can't be made without the missing metrics; a lost score is lost to roles that use it."""
    lost = lambda weights, gone, gate: sum(w for c, w in weights.items() if c not in gone) < gate * sum(weights.values()) - 1e-12
    out = [s.name for s in scores if lost(s.weights, missing, s.min_coverage)]
    gone = missing | {f"score:{s}" for s in out}
    return {"scores": out, "roles": [r.name for r in roles if lost(r.weights, gone, r.min_coverage)]}
