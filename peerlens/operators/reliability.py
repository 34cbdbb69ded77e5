"""Rankings that weigh how much evidence stands behind each number."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.shared import written

FULL = 900.0


def evidence_weight(minutes: Column) -> Column:
    return F.when(minutes > 0, F.least(F.lit(1.0), minutes / F.lit(FULL))).otherwise(F.lit(0.0))


def rank_by_evidence(rows: DataFrame, value: str, minutes: str, by: Sequence[str] = (), prior: float | Column | None = None) -> DataFrame:
    """``rows`` with a value, and mean, weight, ranked and adjusted: values drawn to the mean of the others.

    mean is the leave-one-out mean of the population ``by``, or ``prior``. Sums are aggregated and looked up, so that a
    population of any size needs no window. They are written, so that Spark knows how few they are and moves no row to them."""
    known = rows.where(F.col(value).isNotNull())
    if prior is None:
        sums = known.groupBy(*by).agg(F.sum(value).alias("_s"), F.count("*").alias("_n"))
        known = known.join(written(sums, "sums"), list(by)) if by else known.join(F.broadcast(sums))
        mean = F.when(F.col("_n") > 1, (F.col("_s") - F.col(value)) / (F.col("_n") - 1)).otherwise(F.col(value))
    else:
        mean = prior if isinstance(prior, Column) else F.lit(float(prior))
    out = known.withColumn("mean", mean).withColumn("weight", evidence_weight(F.col(minutes)))
    out = out.withColumn("ranked", F.col("mean") + F.col("weight") * (F.col(value) - F.col("mean")))
    return out.withColumn("adjusted", F.abs(F.col("ranked") - F.col(value)) >= 0.05).select(*rows.columns, "mean", "weight", "ranked", "adjusted")


def inert(ranked: DataFrame, value: str) -> DataFrame:
    """One row: whether, of at least two rows, every ranked value equals the raw one at one decimal."""
    return ranked.agg((F.bool_and(F.round("ranked", 1) == F.round(value, 1)) & (F.count("*") >= 2)).alias("inert"))
