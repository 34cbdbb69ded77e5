"""Lists of entities that a user keeps, against the view that is served now."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: The most entries that are compared side by side.
MAX_COMPARED = 5


def resolved(entries: DataFrame, view: DataFrame, key: str) -> DataFrame:
    """``entries`` with the columns of ``view`` and state: ok, or missing where the view doesn't have them now. A missing entry stays,
    with what its owner wrote and nulls for the rest."""
    clash = [c for c in view.columns if c in entries.columns and c != key]
    if clash:
        raise ValueError(f"entries and view both have {clash}")
    held = view.withColumn("_held", F.lit(True))
    return entries.join(held, key, "left").withColumn("state", F.when(F.col("_held"), "ok").otherwise("missing")).drop("_held")


def compared(entries: DataFrame, view: DataFrame, key: str, by: Sequence[str], asked: DataFrame | None = None, most: int = MAX_COMPARED) -> DataFrame:
    """Of each list (``by``) the entries that are compared: those ``asked`` for (by, key), or else the first ``most`` by ``place``.

    Adds refused: too many (more than ``most`` were asked for), not listed (an entry that the list doesn't have), missing (the view
    doesn't have it), or null. Nothing can be compared through a list that it doesn't hold."""
    if asked is None:
        first = Window.partitionBy(*by).orderBy("place", key)
        chosen = entries.withColumn("_r", F.row_number().over(first)).where(F.col("_r") <= most).drop("_r").withColumn("_listed", F.lit(True))
        many = F.lit(False)
    else:
        wanted = asked.select(*by, key).distinct()
        sizes = wanted.groupBy(*by).agg((F.count("*") > most).alias("_many"))
        chosen = wanted.join(sizes, list(by)).join(entries.withColumn("_listed", F.lit(True)), [*by, key], "left")
        many = F.col("_many")
    out = chosen.join(view.withColumn("_held", F.lit(True)), key, "left")
    refused = F.when(many, "too many").when(F.col("_listed").isNull(), "not listed").when(F.col("_held").isNull(), "missing")
    return out.withColumn("refused", refused).drop("_listed", "_held", "_many")
