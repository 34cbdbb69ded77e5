"""Connected components of a table of links, by joins and minima alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, materialise, over_keys, salt


def components(links: DataFrame) -> DataFrame:
    """(node, component): for each node of ``links`` (a, b: long) the smallest node that it reaches.

    Alternates the two star steps of Kiveris et al., "Connected Components in MapReduce and Beyond": every node tells
    its larger neighbours, then its smaller ones, of the smallest it knows. The table never holds more rows than there
    are links, a step's minima pre-aggregate, a node that very many others link to is dealt to several tasks, and each round
    is written to the shared folder. Links with a null end and links of a node with itself are left out; an empty
    table gives an empty result.
    """
    now = materialise(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    while not _settled(now):
        both = now.union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        large = _told(both, F.least(F.min("m"), F.first("a"))).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        moved = _told(large, F.min("m")).select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.a", "e.b")
        then = materialise(moved.where("a <> b").distinct(), "links")
        discard(now)
        now = then
    roots = now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(roots)


def _told(links: DataFrame, least: Column) -> DataFrame:
    """(a, b, m): each link with the least that its a knows."""
    salted = links.withColumn("_salt", salt("b"))
    low = over_keys(salted, ["a"], [F.min("b").alias("m")], [least.alias("m")])
    return salted.join(low.select("a", "m", F.explode("_salts").alias("_salt")), ["a", "_salt"]).select("a", "b", "m")


def _settled(links: DataFrame) -> bool:
    """Whether every node links to one root, and no root to another node."""
    ends = links.select(F.col("a").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("root")).union(links.select("b", F.lit(0), F.lit(1)))
    ends = ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("root").alias("root"))
    return ends.where("up > 1 OR (up = 1 AND root = 1)").isEmpty()
