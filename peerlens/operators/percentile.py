"""Mid-rank percentiles inside populations.

A population is ordered within spans of close values, and each span adds the counts of the spans below it, of which a population has
some hundreds, so that no task orders a whole population. A row moves once, to its span. Rows that are ranked without being members
don't count. Quantiles are read off the counts of distinct values, which pre-aggregate in each task. Several columns are ranked at
once off such counts, which are sent to the rows where they are few.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import written

THIN = 10
SPANS = 64
#: Distinct values of all populations together up to which their ranks are sent to the rows; about 100 bytes each in memory.
SENT = 1 << 20


def primary(rows: DataFrame, keys: Sequence[str], minutes: str, ties: Sequence[str]) -> DataFrame:
    """``rows`` with is_primary: per key the row of most minutes (null: 0), then the largest of ``ties``."""
    w = Window.partitionBy(*keys).orderBy(F.coalesce(F.col(minutes), F.lit(0)).desc(), *[F.col(t).desc() for t in ties])
    return rows.withColumn("is_primary", F.row_number().over(w) == 1)


def span(value: Column) -> Column:
    """A number that never falls as ``value`` rises: 0 for 0, and SPANS numbers for each doubling of its size."""
    x = value.cast("double")
    far = F.least(F.floor(F.log2(F.abs(x)) * SPANS), F.lit(1 << 19))
    return F.when(x == 0, F.lit(0)).when(F.isnan(x), F.lit(1 << 21)).when(x > 0, (1 << 20) + far).otherwise(-(1 << 20) - far)


def mid_rank(long: DataFrame, by: Sequence[str], member: Column | None = None, out: str = "percentile", size: str = "n") -> DataFrame:
    """``long`` with 100 * (#less + #less or equal) / (2 * #members) of ``value`` among the members with one, and #members.

    ``by`` are the columns that tell populations apart; ``member`` is true for the rows that count. Rows without a value get
    null for both; they are dealt out by a hash of all their columns."""
    counted = F.col("value").isNotNull() & F.coalesce(member if member is not None else F.lit(True), F.lit(False))
    placed = long.withColumn("_span", F.when(F.col("value").isNotNull(), span(F.col("value"))).otherwise(-(1 << 22) - _dealt(long))).withColumn("_counted", counted.cast("int"))
    spans = _below(placed.where(F.col("value").isNotNull()).groupBy(*by, "_span").agg(F.sum("_counted").alias("_own")), by, size)
    within = Window.partitionBy(*by, "_span").orderBy("value")  # as the join deals rows out, so that they move once
    alike = F.sum("_counted").over(within.rangeBetween(Window.currentRow, Window.currentRow))
    found = placed.join(spans, [*by, "_span"], "left").select("*", (F.col("_below") + F.sum("_counted").over(within)).alias("_upto"), alike.alias("_eq"))
    return found.select(*[F.col(f"`{c}`") for c in long.columns], _share("_eq", "_upto", size).alias(out), F.col(size))


def mid_ranks(rows: DataFrame, row: str, by: Sequence[str], columns: Sequence[str], member: Column | None = None, sent: int = SENT, again: bool = False) -> DataFrame:
    """``rows`` with <column>:rank and <column>:n for each of ``columns`` (doubles): what ``mid_rank`` finds for its values.

    ``row`` tells rows apart; ``rows`` are read several times. Rates of small totals have few distinct values however many rows there
    are. Up to ``sent`` of them are ranked by their counts and sent to the rows, none of which moves; beyond, each value is ranked
    by ``mid_rank`` and comes back to its row, which is written if it is read ``again``."""
    found = [(f"{c}:rank", f"{c}:n") for c in columns]
    counted = F.coalesce(member if member is not None else F.lit(True), F.lit(False)).cast("long")
    at = ["_column", *by]
    long = rows.withColumn("_counted", counted).unpivot([F.col(c) for c in (row, *by, "_counted")], [F.col(f"`{c}`") for c in columns], "_column", "value")
    kinds = written(long.where(F.col("value").isNotNull()).groupBy(*at, "value").agg(F.sum("_counted").alias("_eq")), "kinds")
    if kinds.count() > sent:
        ranks = mid_rank(long, at, F.col("_counted") == 1, "_rank", "_size")
        back = ranks.groupBy(row).agg(*[F.max(F.when(F.col("_column") == c, F.col(x))).alias(out) for c, own in zip(columns, found, strict=True) for x, out in zip(("_rank", "_size"), own, strict=True)])
        moved = rows.join(back, row).select(*[F.col(f"`{c}`") for c in rows.columns], *[F.col(f"`{c}`") for own in found for c in own])
        return written(moved, "moved") if again else moved
    ranks = written(accumulated(kinds, at, "_eq", "_upto", "_size").select(*at, "value", _share("_eq", "_upto", "_size").alias("_rank"), "_size"), "ranks")
    out = rows
    for c, (rank, size) in zip(columns, found, strict=True):
        own = ranks.where(F.col("_column") == c).select(*by, F.col("value").alias(c), F.col("_rank").alias(rank), F.col("_size").alias(size))
        out = out.join(F.broadcast(own), [*by, c], "left")
    return out.select(*[F.col(f"`{c}`") for c in rows.columns], *[F.col(f"`{c}`") for own in found for c in own])


def counts(long: DataFrame, by: Sequence[str], counted: Column, size: str) -> DataFrame:
    """(by, value, _eq, _upto, size) of each distinct value of a population: how many of its rows are ``counted`` at the value, up to
    it, and in all."""
    kinds = long.where(F.col("value").isNotNull()).groupBy(*by, "value").agg(F.count(counted).alias("_eq"))
    return accumulated(kinds, by, "_eq", "_upto", size).select(*by, "value", "_eq", "_upto", size)


def accumulated(kinds: DataFrame, by: Sequence[str], eq: str, upto: str, size: str) -> DataFrame:
    """``kinds``, a row for each distinct value of a population with its count ``eq``, with the counts up to the value and in all."""
    placed = kinds.withColumn("_span", span(F.col("value")))
    within = Window.partitionBy(*by, "_span").orderBy("value").rowsBetween(Window.unboundedPreceding, 0)
    spans = placed.groupBy(*by, "_span").agg(F.sum(eq).alias("_own"))
    spans = _below(spans, by, size)
    found = placed.withColumn("_in", F.sum(eq).over(within)).join(spans, [*by, "_span"])
    return found.select(*kinds.columns, (F.col("_below") + F.col("_in")).alias(upto), F.col(size))


def _below(spans: DataFrame, by: Sequence[str], size: str) -> DataFrame:
    """(by, _span, _below, size): how many are counted in a population's lower spans, and in all; ``spans`` has _own, those of one."""
    every = Window.partitionBy(*by)
    below = F.coalesce(F.sum("_own").over(every.orderBy("_span").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return spans.select(*by, "_span", below.alias("_below"), F.sum("_own").over(every).alias(size))


def _share(eq: str, upto: str, size: str) -> Column:
    return F.when(F.col(size) > 0, F.lit(100.0) * (2 * F.col(upto) - F.col(eq)) / (2 * F.col(size)))


def _dealt(long: DataFrame) -> Column:
    """0 for rows with a value; rows without one, which look nothing up, are dealt out by a hash of all their columns."""
    return F.when(F.col("value").isNotNull(), F.lit(0)).otherwise(1 + F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in long.columns]), F.lit(1024)).cast("int"))


def quantiles(long: DataFrame, by: Sequence[str], shares: Mapping[str, float]) -> DataFrame:
    """(by, known, least, most, and a column for each of ``shares``) of ``value``: exact quantiles, read off the counts of distinct
    values, so that no group's values meet in one task. Between two values the quantile is interpolated; a group without a value
    has nulls."""
    rows = long.select(F.struct(*by).alias("_by"), "value")  # a struct meets one like it, nulls included
    held = rows.groupBy("_by").agg(F.count("value").alias("known"), F.min("value").alias("least"), F.max("value").alias("most"))
    kinds = counts(rows, ["_by"], F.lit(1), "_n")

    def at(place: Column) -> Column:
        return F.max(F.when((F.col("_upto") - F.col("_eq") <= place) & (place < F.col("_upto")), F.col("value")))

    place = {name: F.lit(float(p)) * (F.col("_n") - 1) for name, p in shares.items()}
    ends = [x for name, h in place.items() for x in (at(F.floor(h)).alias(f"_low_{name}"), at(F.ceil(h)).alias(f"_high_{name}"), F.max(h - F.floor(h)).alias(f"_part_{name}"))]
    found = kinds.groupBy("_by").agg(*ends)
    made = [(F.col(f"_low_{n}") + (F.col(f"_high_{n}") - F.col(f"_low_{n}")) * F.col(f"_part_{n}")).alias(n) for n in shares]
    return held.join(found, "_by", "left").select(*[F.col("_by")[c].alias(c) for c in by], "known", "least", "most", *made)


def scoped(long: DataFrame, group: Sequence[str], narrow: str, member: Column) -> DataFrame:
    """Percentiles in the narrow scope, widened to the members of the whole group if that is thin, or refused.

    Adds percentile, n, scope ("narrow", "global" or null) and reason; n of a refusal is the narrow one. Rows of no narrow scope are
    ranked in the whole group alone. Counting each value once for both scopes was tried and took longer (11.2 s against 8.6 s
    for percentiles_widened on sf0.1), as what both are made from is then read four times with other columns."""
    both = mid_rank(long, [*group, narrow], None, "_p", "_n")
    both = mid_rank(both, group, member, "_pg", "_ng")
    count = lambda c: F.coalesce(F.col(c), F.lit(0))
    here, wide, known = count("_n") >= THIN, count("_ng") >= THIN, F.col("value").isNotNull()
    scope = F.when(known & here, "narrow").when(known & wide, "global")
    return both.select(
        *long.columns,
        F.when(known & here, F.col("_p")).when(known & wide, F.col("_pg")).alias("percentile"),
        F.when(known & ~here & wide, F.col("_ng")).otherwise(count("_n")).alias("n"),
        scope.alias("scope"),
        F.when(~known, "metric missing").when(scope.isNull(), "population too small").alias("reason"),
    )


def oriented(percentile: Column, metric: Column, lower_is_better: Sequence[str]) -> Column:
    return F.when(metric.isin(*lower_is_better), F.lit(100.0) - percentile).otherwise(percentile)


def z_scores(long: DataFrame, by: Sequence[str]) -> DataFrame:
    """``long`` with z over the population's deviation; null for less than 2 values or no spread."""
    stats = long.groupBy(*by).agg(F.count("value").alias("_n"), F.avg("value").alias("_m"), F.stddev_pop("value").alias("_s"))
    z = F.when((F.col("_n") >= 2) & (F.col("_s") > 0), (F.col("value") - F.col("_m")) / F.col("_s"))
    return long.join(stats, list(by)).select(*long.columns, z.alias("z"))


def maturity(rows: DataFrame, by: Sequence[str], unit: str, minutes: Column, established: int = 900) -> DataFrame:
    """Per population: units, established units (most minutes at least ``established``), share of rows in those, the upper
    median of the units' most minutes, and whether the season is early (several units, share under half)."""
    units = rows.groupBy(*by, unit).agg(F.count("*").alias("rows"), F.max(F.coalesce(minutes, F.lit(0))).alias("most"))
    ok = F.col("most") >= established
    kinds = counts(units.select(*by, F.col("most").alias("value")), by, F.lit(1), "_n")
    here = (F.col("_upto") - F.col("_eq") <= F.floor(F.col("_n") / 2)) & (F.floor(F.col("_n") / 2) < F.col("_upto"))
    middle = kinds.where(here).select(*by, F.col("value").alias("median_most"))
    out = units.groupBy(*by).agg(F.count("*").alias("units"), F.count(F.when(ok, 1)).alias("established"), (F.coalesce(F.sum(F.when(ok, F.col("rows"))), F.lit(0)) / F.sum("rows")).alias("share"), F.sort_array(F.collect_set(unit)).alias("covered"))
    return out.join(middle, list(by)).withColumn("early_season", (F.col("units") > 1) & (F.col("share") < 0.5))
