"""Sources: CSV tables with stated schemas, nested JSON snapshots and override lists; and a registry of them."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Strings that stand for an unknown value.
UNKNOWN = ("", "Missing")


def csv_table(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A CSV with header under a stated schema; unknown strings are null."""
    df = spark.read.schema(schema).option("header", True).csv(path)
    return df.select(*[F.when(~F.col(c).isin(*UNKNOWN), F.col(c)).alias(c) if t == "string" else F.col(c) for c, t in df.dtypes])


def overrides(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("source string, source_id string, target_id long").option("comment", "#").csv(path)


def snapshot(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The player lines of JSON-lines snapshots; roster lines are left out."""
    return spark.read.schema(schema).json(path).where(F.col("kind") == "player")


def mapped(records: DataFrame, mapping: Mapping[str, str], types: Mapping[str, str]) -> DataFrame:
    """Columns taken from dotted paths, safely cast: what doesn't parse is null."""
    return records.select(*[F.col(path).cast("string").try_cast(types.get(name, "string")).alias(name) for name, path in mapping.items()])


def epoch_date(seconds: Column) -> Column:
    return F.to_date(F.timestamp_seconds(seconds))


def ranged(df: DataFrame, column: str, low: float, high: float) -> tuple[DataFrame, DataFrame]:
    """``df`` with out-of-range values nulled, and the rows that had them."""
    bad = F.coalesce(~F.col(column).between(low, high), F.lit(False))
    return df.withColumn(column, F.when(~bad, F.col(column))), df.where(bad)


REGISTRY: dict[str, Callable[..., DataFrame]] = {"csv": csv_table, "snapshot": snapshot, "overrides": overrides}


def read(kind: str, *args, **options) -> DataFrame:
    if kind not in REGISTRY:
        raise ValueError(f"unknown source {kind}; there are {sorted(REGISTRY)}")
    return REGISTRY[kind](*args, **options)
