"""Declarative definitions of metrics, scores and roles. All are checked when they are made, before any job runs."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field


@dataclass(frozen=True)
class Metric:
    """``kind``: per90 over ``over`` ("playing" or "recorded" minutes), or percentage or ratio of the column ``over``."""

    name: str
    total: str
    kind: str = "per90"
    over: str = "recorded"
    lower_is_better: bool = False

    def __post_init__(self) -> None:
        if self.kind not in ("per90", "percentage", "ratio"):
            raise ValueError(f"{self.name}: unknown kind {self.kind}")
        if self.kind == "per90" and self.over not in ("playing", "recorded"):
            raise ValueError(f"{self.name}: unknown denominator {self.over}")


#: What a derived metric does with its operands: how many it takes.
KINDS = {"per90": 1, "sum": None, "difference": 2, "floored_difference": 2, "ratio": 2, "percentage": 2}


@dataclass(frozen=True)
class Derived:
    """A metric made of totals or of other derived metrics. A per-90 rate has one operand, and its minutes are routed; a sum has
    two or more; the others have two. What isn't ``shown`` only serves other metrics."""

    name: str
    kind: str
    of: tuple[str, ...]
    lower_is_better: bool = False
    shown: bool = True

    def __post_init__(self) -> None:
        if self.kind not in KINDS:
            raise ValueError(f"{self.name}: unknown kind {self.kind}")
        if len(self.of) != KINDS[self.kind] if KINDS[self.kind] else len(self.of) < 2:
            raise ValueError(f"{self.name}: {self.kind} of {len(self.of)} operands")


@dataclass(frozen=True)
class Routing:
    """Which minutes a per-90 rate is over: what was confirmed by published rates, what is inferred from like metrics, and the
    rest. A metric that is confirmed isn't inferred as well."""

    confirmed: Mapping[str, str] = field(default_factory=dict)
    inferred: Mapping[str, str] = field(default_factory=dict)
    default: str = "recorded"

    def __post_init__(self) -> None:
        if both := set(self.confirmed) & set(self.inferred):
            raise ValueError(f"confirmed and inferred: {sorted(both)}")
        if unknown := {self.default, *self.confirmed.values(), *self.inferred.values()} - {"playing", "recorded"}:
            raise ValueError(f"unknown minutes {sorted(unknown)}")

    def of(self, metric: str) -> tuple[str, str]:
        """(minutes, evidence): playing or recorded, and whether that is confirmed, inferred or the default."""
        for evidence, table in (("confirmed", self.confirmed), ("inferred", self.inferred)):
            if metric in table:
                return table[metric], evidence
        return self.default, "default"


@dataclass(frozen=True)
class Score:
    name: str
    weights: Mapping[str, float]
    min_coverage: float = 1.0

    def __post_init__(self) -> None:
        if not self.weights or any(w <= 0 for w in self.weights.values()):
            raise ValueError(f"{self.name}: weights must be positive and there must be one")
        if not 0 < self.min_coverage <= 1:
            raise ValueError(f"{self.name}: min_coverage must be in (0, 1]")


@dataclass(frozen=True)
class Role:
    """A score over metrics and other scores ("score:<name>"), open to some groups, with core dimensions that are met if
    any of their metrics is known."""

    name: str
    groups: tuple[str, ...]
    weights: Mapping[str, float]
    core: Mapping[str, tuple[str, ...]] = field(default_factory=dict)
    min_coverage: float = 0.5

    def __post_init__(self) -> None:
        Score(self.name, self.weights, self.min_coverage)
        if not self.groups:
            raise ValueError(f"{self.name}: no groups")


@dataclass(frozen=True)
class FeatureSets:
    """The metrics that each group is compared by: at least ``least`` different ones that are ``known``, for every group there is."""

    groups: Mapping[str, tuple[str, ...]]
    known: frozenset[str]
    every: frozenset[str]
    least: int = 5

    def __post_init__(self) -> None:
        if missing := self.every ^ set(self.groups):
            raise ValueError(f"groups without features, or unknown ones: {sorted(missing)}")
        for group, own in self.groups.items():
            if len(own) < self.least or len(set(own)) != len(own):
                raise ValueError(f"{group}: {self.least} different features are needed")
            if unknown := set(own) - self.known:
                raise ValueError(f"{group}: unknown features {sorted(unknown)}")


def check(metrics: list[Metric], scores: list[Score], roles: list[Role], groups: set[str]) -> None:
    """Raises for names that nothing defines."""
    known, made = {m.name for m in metrics}, {s.name for s in scores}
    for what, names in (("metric", [m.name for m in metrics]), ("score", [s.name for s in scores]), ("role", [r.name for r in roles])):
        if len(set(names)) != len(names):
            raise ValueError(f"a {what} is defined twice")
    for s in scores:
        if missing := set(s.weights) - known:
            raise ValueError(f"{s.name}: unknown metrics {sorted(missing)}")
    for r in roles:
        if missing := {w for w in r.weights if (w[6:] not in made if w.startswith("score:") else w not in known)}:
            raise ValueError(f"{r.name}: unknown components {sorted(missing)}")
        if missing := {m for own in r.core.values() for m in own} - known:
            raise ValueError(f"{r.name}: unknown core metrics {sorted(missing)}")
        if missing := set(r.groups) - groups:
            raise ValueError(f"{r.name}: unknown groups {sorted(missing)}")
