"""Deterministic readings of percentiles: bands, strengths, watch-outs and drivers, as codes."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

STRONG, WEAK = 70.0, 40.0


def reading(percentile: Column) -> Column:
    return F.when(percentile >= 90, "outstanding").when(percentile >= 70, "strong").when(percentile <= 10, "very low").when(percentile.isNotNull(), "ordinary")


def withheld(metric: Column, group: Column, context_metrics: Sequence[str], told_for: str) -> Column:
    """Whether a metric says more of an entity's team than of itself, and so is told for the group ``told_for`` only."""
    return metric.isin(*context_metrics) & ~F.coalesce(group == told_for, F.lit(False))


def highlights(long: DataFrame, keys: Sequence[str], own: Mapping[str, Sequence[str]], role: str, most: int = 4, context_metrics: Sequence[str] = ()) -> DataFrame:
    """(keys, kind, place, metric, percentile) over rows (keys, role, metric, oriented): strengths from STRONG on,
    watch-outs up to WEAK among the role's own components, drivers the role's two best from STRONG on."""
    in_role = F.lit(False)
    for name, metrics in own.items():
        in_role = in_role | ((F.col(role) == name) & F.col("metric").isin(*metrics))
    rows = long.where(F.col("oriented").isNotNull() & ~F.col("metric").isin(*(context_metrics or [""])))
    in_role = F.coalesce(in_role, F.lit(False))
    strong, weak = F.col("oriented") >= STRONG, F.col("oriented") <= WEAK
    one = lambda test, kind, order, n: F.when(test, F.struct(F.lit(kind).alias("kind"), order.alias("_o"), F.lit(n).alias("_most")))
    kinds = F.array_compact(F.array(one(strong, "strength", -F.col("oriented"), most), one(weak & in_role, "watch-out", F.col("oriented"), most), one(strong & in_role, "driver", -F.col("oriented"), 2)))
    told = rows.where(strong | weak & in_role).select(*keys, "metric", "oriented", F.explode(kinds).alias("_k")).select(*keys, "_k.*", "metric", "oriented")  # all three move at once
    place = F.row_number().over(Window.partitionBy(*keys, "kind").orderBy("_o", "metric"))
    return told.withColumn("place", place).where(F.col("place") <= F.col("_most")).select(*keys, "kind", "place", "metric", F.col("oriented").alias("percentile"))


def highlights_of_rows(wide: DataFrame, keys: Sequence[str], metrics: Sequence[str], own: Mapping[str, Sequence[str]], role: str, most: int = 4, context_metrics: Sequence[str] = ()) -> DataFrame:
    """What ``highlights`` finds over ``wide``, rows (keys, role, a column for each of ``metrics``) of which each has keys of its own, so
    that its metrics are ordered where they are and nothing moves."""
    told = sorted(set(metrics) - set(context_metrics))
    names = F.array(*[F.lit(m) for m in told])
    in_role = lambda m: F.coalesce(F.col(role).isin(*[r for r, of in own.items() if m in of]), F.lit(False))

    strong = lambda m: F.col(m) >= STRONG
    kinds = [("strength", strong, 1.0, most), ("watch-out", lambda m: (F.col(m) <= WEAK) & in_role(m), -1.0, most), ("driver", lambda m: strong(m) & in_role(m), 1.0, 2)]
    found = [F.sort_array(F.array(*[F.when(test(m), F.struct((F.col(m) * sign).alias("o"), F.lit(-i).alias("i"))) for i, m in enumerate(told)]), asc=False).alias(f"_{kind}") for kind, test, sign, _ in kinds]
    held = [F.least(F.lit(n), sum((F.when(test(m), 1).otherwise(0) for m in told), F.lit(0))).alias(f"_n_{kind}") for kind, test, _, n in kinds]
    rows = wide.select(*keys, *found, *held)
    first = [F.slice(f"`_{kind}`", F.lit(1), F.col(f"`_n_{kind}`")) for kind, *_ in kinds]
    out = rows.select(*keys, *[F.col(f"`_n_{kind}`").alias(f"_n{i}") for i, (kind, *_) in enumerate(kinds)], F.posexplode(F.concat(*first)).alias("_at", "_x"))
    strength, watch = F.col("_at") < F.col("_n0"), F.col("_at") < F.col("_n0") + F.col("_n1")
    before = F.when(strength, 0).when(watch, F.col("_n0")).otherwise(F.col("_n0") + F.col("_n1"))
    kind = F.when(strength, "strength").when(watch, "watch-out").otherwise("driver")
    value = F.when(~strength & watch, -F.col("_x.o")).otherwise(F.col("_x.o"))
    return out.select(*keys, kind.alias("kind"), (F.col("_at") - before + 1).alias("place"), F.get(names, -F.col("_x.i")).alias("metric"), value.alias("percentile"))
