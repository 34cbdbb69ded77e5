"""Derived metrics of totals, as one projection."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.rates import denominators, per90, percentage, ratio
from ..spec import Metric


def expression(m: Metric, playing: str = "minutes", recorded: str = "recorded_minutes") -> Column:
    if m.kind == "per90":
        over = dict(zip(("playing", "recorded"), denominators(playing, recorded), strict=True))[m.over]
        return per90(m.total, over)
    return (percentage if m.kind == "percentage" else ratio)(m.total, m.over)


def derive(totals: DataFrame, metrics: Sequence[Metric]) -> DataFrame:
    """``totals`` with a double column for each metric."""
    return totals.select("*", *[expression(m).alias(m.name) for m in metrics])


def unpivot(wide: DataFrame, keys: Sequence[str], metrics: Sequence[str]) -> DataFrame:
    """(keys, metric, value), nulls included."""
    return wide.unpivot([F.col(k) for k in keys], [F.col(m) for m in metrics], "metric", "value")


def coverage_by_group(wide: DataFrame, metrics: Sequence[str], group: str) -> DataFrame:
    """(metric, group, rows, known, share, status) overall (group null) and for each group, from one aggregation."""
    sums = wide.groupingSets([[], [group]], group).agg(F.count("*").alias("rows"), *[F.count(m).alias(m) for m in metrics])
    long = sums.unpivot([F.col(group), F.col("rows")], [F.col(m) for m in metrics], "metric", "known")
    share = F.col("known").cast("double") / F.col("rows")
    status = F.when(F.col("known") == 0, "absent").when(share < 0.5, "sparse").when(share < 0.95, "partial").otherwise("complete")
    return long.where("rows > 0").select("metric", F.col(group), "rows", "known", share.alias("share"), status.alias("status"))
