"""Derived metrics compiled from declarations: metrics over totals and over other metrics, in one projection."""

from __future__ import annotations

from collections.abc import Collection, Sequence
from functools import reduce
from graphlib import CycleError, TopologicalSorter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.rates import denominators, nonnegative_difference, per90, percentage, ratio
from ..spec import Derived, Routing


def ordered(definitions: Sequence[Derived], totals: Collection[str]) -> list[Derived]:
    """The definitions so that each comes after those it is made of. An operand that is neither a total nor a definition, a name
    that is taken, and definitions that are made of each other are errors."""
    named = {d.name: d for d in definitions}
    if len(named) != len(definitions) or set(named) & set(totals):
        raise ValueError(f"a name is defined twice: {sorted({d.name for d in definitions if [x.name for x in definitions].count(d.name) > 1} | set(named) & set(totals))}")
    if unknown := {o for d in definitions for o in d.of} - set(named) - set(totals):
        raise ValueError(f"nothing defines {sorted(unknown)}")
    try:
        return [named[n] for n in TopologicalSorter({d.name: [o for o in d.of if o in named] for d in definitions}).static_order()]
    except CycleError as e:
        raise ValueError(f"made of each other: {' of '.join(e.args[1])}") from e


def inputs(definitions: Sequence[Derived], totals: Collection[str]) -> dict[str, frozenset[str]]:
    """For each definition the totals that it is made of, however deep down."""
    found: dict[str, frozenset[str]] = {}
    for d in ordered(definitions, totals):
        found[d.name] = frozenset().union(*[found.get(o, frozenset({o})) for o in d.of])
    return found


def expressions(definitions: Sequence[Derived], totals: Collection[str], routing: Routing, playing: str = "minutes", recorded: str = "recorded_minutes") -> dict[str, Column]:
    """An expression over totals for each definition; absent stays absent, a denominator of 0 or less gives null."""
    minutes = dict(zip(("playing", "recorded"), denominators(playing, recorded), strict=True))
    made: dict[str, Column] = {}
    for d in ordered(definitions, totals):
        operands = [made[o] if o in made else F.col(o) for o in d.of]
        if d.kind == "per90":
            made[d.name] = per90(operands[0], minutes[routing.of(d.name)[0]])
        elif d.kind == "sum":
            made[d.name] = reduce(lambda a, b: a + b, operands)
        elif d.kind == "difference":
            made[d.name] = operands[0] - operands[1]
        else:
            made[d.name] = {"floored_difference": nonnegative_difference, "ratio": ratio, "percentage": percentage}[d.kind](*operands)
    return made


def derive(rows: DataFrame, definitions: Sequence[Derived], routing: Routing | None = None) -> DataFrame:
    """``rows`` with a column for each definition that is shown."""
    made = expressions(definitions, rows.columns, routing or Routing())
    return rows.select("*", *[made[d.name].alias(d.name) for d in definitions if d.shown])


def routes(definitions: Sequence[Derived], routing: Routing) -> list[tuple[str, str, str]]:
    """(metric, minutes, evidence) of the per-90 rates."""
    return [(d.name, *routing.of(d.name)) for d in definitions if d.kind == "per90"]
