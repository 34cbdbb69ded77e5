"""Season totals over the order tables, and example definitions over them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.metrics import derive
from ..operators.percentile import primary
from ..spec import Metric, Role, Score, check

GROUPS = {"AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"}
METRICS = [
    Metric("attempts_per90", "attempts"), Metric("successes_per90", "successes"), Metric("discounted_per90", "discounted"),
    Metric("returns_per90", "returns", lower_is_better=True), Metric("headline_per90", "headline", over="playing"), Metric("success_percentage", "successes", "percentage", "attempts"),
]
NAMES = [m.name for m in METRICS]
LOWER = [m.name for m in METRICS if m.lower_is_better]
SCORES = [
    Score("volume", {"attempts_per90": 3.0, "headline_per90": 2.0}),
    Score("finish", {"success_percentage": 2.0, "successes_per90": 1.0}),
    Score("security", {"returns_per90": 1.0, "success_percentage": 1.0}, 0.5),
]
ROLES = [
    Role("runner", ("AUTOMOBILE", "MACHINERY", "BUILDING"), {"attempts_per90": 2.0, "headline_per90": 1.0, "discounted_per90": 1.0}, {"work": ("attempts_per90",), "reach": ("headline_per90", "discounted_per90")}),
    Role("finisher", ("AUTOMOBILE", "FURNITURE", "HOUSEHOLD"), {"success_percentage": 2.0, "score:finish": 1.0, "returns_per90": 1.0}, {"end": ("success_percentage",)}),
    Role("keeper", ("BUILDING", "HOUSEHOLD", "MACHINERY", "FURNITURE"), {"score:security": 2.0, "attempts_per90": 1.0}, {"safe": ("returns_per90",)}),
]
check(METRICS, SCORES, ROLES, GROUPS)
KEYS = ["entity_key", "peer_group", "competition_id", "season_id"]


#: Lines that one task joins and adds up, where there are more than Spark's number of partitions would deal out so.
TASK_LINES = 1 << 21


def tables(spark: SparkSession, sf_dir: str, *names: str) -> list[DataFrame]:
    return [spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in names]


def customers_orders(spark: SparkSession, sf_dir: str, sums: Sequence[Column], own: Sequence[str], told: Sequence[str | Column]) -> DataFrame:
    """A row for each order with ``sums`` over its lines, its ``own`` columns and _year, o_custkey, and what is ``told`` of its customer,
    with how many rows of customers tell it alike. Lines are added up by order where they meet it, and only orders meet customers.
    Partitions grow in number with the lines, so that what a task holds doesn't grow."""
    lines, orders, customers = tables(spark, sf_dir, "lineitem", "orders", "customer")
    parts = -(-lines.count() // TASK_LINES)
    deal = lambda df, key: df.repartition(parts, key) if parts > int(spark.conf.get("spark.sql.shuffle.partitions")) else df
    added = deal(lines, "l_orderkey").join(deal(orders, "o_orderkey"), F.col("l_orderkey") == F.col("o_orderkey")).groupBy("o_orderkey", "o_custkey", F.year("o_orderdate").alias("_year"), *own).agg(*sums)
    held = deal(customers, "c_custkey").groupBy("c_custkey", *told).agg(F.count("*").alias("_alike"))
    return deal(added, "o_custkey").join(held, F.col("o_custkey") == F.col("c_custkey"))


def stats(spark: SparkSession, sf_dir: str, competition: str = "o_orderpriority") -> DataFrame:
    """One row per customer, competition and year.

    Rows of one order number, customer, competition and year are one order, so that orders are counted without their numbers; a
    customer that several rows tell alike counts its orders' lines as often."""
    flag = lambda c, v: F.count_if(F.col(c) == v)
    own = [competition] if competition in tables(spark, sf_dir, "orders")[0].columns else []
    sums = [
        F.sum("l_quantity").alias("minutes"), F.sum(F.when(F.col("l_linestatus") == "F", F.col("l_quantity"))).alias("recorded_minutes"), F.count("*").alias("attempts"), flag("l_returnflag", "A").alias("successes"),
        flag("l_returnflag", "R").alias("returns"), F.count_if(F.col("l_discount") > 0.05).alias("discounted"), flag("l_returnflag", "N").alias("headline"),
    ]
    told = ["c_mktsegment", F.when(F.col("c_acctbal") >= 0, F.floor("c_acctbal")).alias("market_value"), *([] if own else [competition])]
    total = lambda c: F.sum(F.col(c) * F.col("_alike"))
    return customers_orders(spark, sf_dir, sums, own, told).groupBy(
        F.col("c_custkey").alias("entity_key"), F.col("c_mktsegment").alias("peer_group"), F.col(competition).cast("string").alias("competition_id"), F.col("_year").cast("string").alias("season_id"), "market_value",
    ).agg(
        F.floor(6 * total("minutes")).cast("int").alias("minutes"), F.floor(6 * total("recorded_minutes")).cast("int").alias("recorded_minutes"), F.count("*").alias("appearances"),
        *[total(c).alias(c) for c in ("attempts", "successes", "returns", "discounted", "headline")],
    )


def population(spark: SparkSession, sf_dir: str, competition: str = "o_orderpriority") -> DataFrame:
    """The totals with derived metrics and is_primary, one primary row per entity and season."""
    return primary(derive(stats(spark, sf_dir, competition), METRICS), ["entity_key", "season_id"], "minutes", ["competition_id"])
