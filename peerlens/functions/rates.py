"""Row-local expressions: rates, ratios, bands and dates. Absent stays absent; a denominator of 0 or less gives null."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from datetime import date

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def ratio(part: Column | str, whole: Column | str) -> Column:
    return F.when(col(whole) > 0, col(part).cast("double") / col(whole))


def percentage(part: Column | str, whole: Column | str) -> Column:
    return F.when(col(whole) > 0, col(part) * F.lit(100.0) / col(whole))


def per90(total: Column | str, minutes: Column | str) -> Column:
    return F.when(col(minutes) > 0, col(total) * F.lit(90.0) / col(minutes))


def nonnegative_difference(a: Column | str, b: Column | str) -> Column:
    """max(a - b, 0) where both are known; greatest() alone would skip a null."""
    return F.when(col(a).isNotNull() & col(b).isNotNull(), F.greatest(col(a) - col(b), F.lit(0)))


def denominators(playing: Column | str, recorded: Column | str) -> tuple[Column, Column]:
    """(playing, recorded) minutes, each standing in for the other where that is null; a 0 doesn't fall back."""
    return F.coalesce(col(playing), col(recorded)), F.coalesce(col(recorded), col(playing))


def rateable_minutes(playing: Column | str, recorded: Column | str) -> Column:
    """The larger of the two that aren't null or 0."""
    some = [F.when(col(c) != 0, col(c)) for c in (playing, recorded)]
    return F.greatest(*some)


def can_rate(denominator: Column | str, floor: float | None = None) -> Column:
    """Whether a rate over this denominator is worth making: it is known, above 0 and at least the floor, if there is one."""
    d = col(denominator)
    return F.coalesce((d > 0) & (d >= floor) if floor is not None else d > 0, F.lit(False))


def season_key(start_year: Column | str, season_id: Column | str) -> Column:
    """What makes seasons of several sources comparable: the year they start in as text, or their own id where that is unknown."""
    return F.coalesce(col(start_year).cast("string"), col(season_id))


def available(metrics: Sequence[str]) -> Column:
    return F.array_compact(F.array(*[F.when(F.col(m).isNotNull(), F.lit(m)) for m in metrics]))


def band(value: Column | str, floors: Sequence[tuple[float, str]], rest: str, unknown: str | None = None) -> Column:
    """The name of the first floor that the value reaches, floors in descending order."""
    v, out = col(value), F.when(col(value).isNull(), F.lit(unknown))
    for floor, name in floors:
        out = out.when(v >= floor, F.lit(name))
    return out.otherwise(F.lit(rest))


def coverage(recorded: Column | str, minutes: Column | str) -> Column:
    """Percent of playing minutes that are recorded; may exceed 100."""
    return percentage(recorded, minutes)


COVERAGE_FLOORS = ((90.0, "high"), (75.0, "good"), (50.0, "partial"))
SAMPLE_FLOORS = ((900.0, "full"), (450.0, "limited"), (180.0, "low"))


def coverage_band(value: Column | str) -> Column:
    return band(value, COVERAGE_FLOORS, "low")


def sample_band(minutes: Column | str) -> Column:
    return band(minutes, SAMPLE_FLOORS, "very_low", "very_low")


def age_at(born: Column | str, day: Column | date) -> Column:
    """Full years; a birthday counts from its month and day on. months_between isn't safe at month ends."""
    b, d = col(born), day if isinstance(day, Column) else F.lit(day)
    early = (F.month(d) * 100 + F.dayofmonth(d)) < (F.month(b) * 100 + F.dayofmonth(b))
    return F.year(d) - F.year(b) - early.cast("int")


def months_until(end: Column | str, day: date) -> Column:
    return (F.year(col(end)) - day.year) * 12 + F.month(col(end)) - day.month


def expires_within(end: Column | str, day: date, months: int) -> Column:
    """False for an unknown or a past date."""
    return F.coalesce((col(end) >= F.lit(day)) & (months_until(end, day) <= months), F.lit(False))


def has_lapsed(end: Column | str, day: date) -> Column:
    return F.coalesce(col(end) < F.lit(day), F.lit(False))


def clamp(value: Column, low: float = 0.0, high: float = 100.0) -> Column:
    """Within bounds; null stays null."""
    return F.when(value.isNotNull(), F.greatest(F.lit(low), F.least(F.lit(high), value)))


def market_fit(value: Column | str, budget: float | None) -> Column:
    if not budget:
        return F.lit(None).cast("double")
    return clamp(1.0 - col(value) / F.lit(float(budget)), 0.0, 1.0) * 100.0


def inconsistencies(pairs: Sequence[tuple[str, str]]) -> Column:
    """Messages for parts that exceed their wholes; a pair with a null is skipped."""
    return F.array_compact(F.array(*[F.when(F.col(a) > F.col(b), F.concat(F.lit(f"{a} "), F.col(a).cast("string"), F.lit(f" exceeds {b} "), F.col(b).cast("string"))) for a, b in pairs]))


def reconciled(pairs: Sequence[tuple[str, str]]) -> dict[str, Column]:
    """For disjoint (part, whole) pairs: both columns, null where they contradict each other."""
    out = {}
    for a, b in pairs:
        bad = F.coalesce(F.col(a) > F.col(b), F.lit(False))
        out |= {c: F.when(~bad, F.col(c)) for c in (a, b)}
    return out


def evidence(count: Column | str, least: int) -> Column:
    """Whether a rate rests on fewer events than it should; null if they aren't counted."""
    return col(count) < least


def same(a: Column, b: Column) -> Column:
    """Tri-state equality: null if either side is unknown."""
    return F.when(a.isNotNull() & b.isNotNull(), a == b)


def aliased(name: Column | str, aliases: Mapping[str, str]) -> Column:
    """A lower-cased, trimmed name with a fixed, small table of aliases put in."""
    key = F.lower(F.trim(col(name)))
    table = F.create_map(*[F.lit(x) for pair in aliases.items() for x in pair])
    return F.coalesce(F.get(F.array(table[key]), F.lit(0)), key) if aliases else key
