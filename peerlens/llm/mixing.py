"""Mixing sources to target weights by Poisson replication, in DataFrame functions only.

A source's mean repetition rate is its share of the wanted total over what it has. Each document's count is the quantile
of a Poisson distribution of that mean at a number in (0, 1) that is hashed from its id, so that the same document gets
the same count on any cluster. Documents are repeated by their count and dealt out by a hash of id and copy.

Only a count for each source is aggregated, which pre-aggregates in each task. The rates are broadcast if there are at
most ``MAX_BROADCAST_SOURCES`` of them and otherwise joined, a join whose hot keys Spark splits.

Defined results: a null source is a source of its own; a null doc_id hashes as the empty string; rows that share a doc_id
get the same count; a source without weight (or with a weight of 0 or less) gets rate 0; an empty table stays empty; columns
of the input stay as they are, in ``mix`` ``copy`` and ``shuffle_key`` replacing columns of that name.
"""

from __future__ import annotations

import math
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, packed_rows, shuffle_parts, unpacked

MAX_BROADCAST_SOURCES = 10_000
#: A Poisson variable of a larger mean is the sum of several with means up to this one.
PIECE = 16.0
SEED = 17


def unit(*parts: Column | str) -> Column:
    """A number in (0, 1) from 52 bits of the md5 of the parts, joined by ':'."""
    text = F.concat_ws(":", *[F.coalesce((F.col(p) if isinstance(p, str) else p).cast("string"), F.lit("")) for p in parts])
    return (F.conv(F.substring(F.md5(text.cast("binary")), 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)


def poisson_quantile(mean: Column, u: Column) -> Column:
    """The least k with P(X <= k) >= u for X of a Poisson distribution of a mean up to PIECE, by summing its terms."""
    steps = F.sequence(F.lit(0), F.ceil(mean + 10 * F.sqrt(mean) + 20).cast("int"))
    start = F.struct(F.lit(0).alias("k"), F.exp(-mean).alias("term"), F.exp(-mean).alias("below"))
    fold = lambda s, i: F.when(s["below"] >= u, s).otherwise(F.struct((s["k"] + 1).alias("k"), (s["term"] * mean / (s["k"] + 1)).alias("term"), (s["below"] + s["term"] * mean / (s["k"] + 1)).alias("below")))
    return F.aggregate(steps, start, fold, lambda s: s["k"])


def poisson_count(rate: Column, key: Column, seed: int = SEED) -> Column:
    """A hash-seeded Poisson count of any mean: the sum of the quantiles of equal pieces of it."""
    n = F.greatest(F.ceil(rate / PIECE), F.lit(1)).cast("int")
    add = lambda total, i: total + poisson_quantile(rate / n, unit(F.lit(seed), key, i))
    return F.when(rate > 0, F.aggregate(F.sequence(F.lit(1), n), F.lit(0), add)).otherwise(F.lit(0))


def rates(docs: DataFrame, weights: Mapping[str | None, float] | None = None, total: float | None = None) -> DataFrame:
    """(source, n_docs, rate) for each source. Without weights all sources weigh the same; ``total`` documents are
    wanted, as many as there are by default."""
    held = docs.groupBy("source").agg(F.count("*").alias("n_docs"))
    if weights is not None and any(not math.isfinite(w) for w in weights.values()):
        raise ValueError("weights must be finite")
    if weights is None:
        weighed = held.withColumn("weight", F.lit(1.0))
    else:
        given = docs.sparkSession.createDataFrame([(s, max(float(w), 0.0)) for s, w in weights.items()], "_source string, weight double")
        weighed = held.join(F.broadcast(given), F.col("source").eqNullSafe(F.col("_source")), "left").drop("_source").fillna(0.0, ["weight"])
    sums = weighed.agg(F.sum("weight").alias("_weights"), F.sum("n_docs").cast("double").alias("_docs"))
    wanted = F.col("_docs") if total is None else F.lit(float(total))
    rate = F.when(F.col("weight") > 0, wanted * F.col("weight") / F.col("_weights") / F.col("n_docs")).otherwise(F.lit(0.0))
    return weighed.join(F.broadcast(sums)).select("source", "n_docs", rate.alias("rate"))


def copies(docs: DataFrame, weights: Mapping[str | None, float] | None = None, total: float | None = None, seed: int = SEED) -> DataFrame:
    """(r, copy, shuffle_key): each row of ``docs`` as a struct, once for each of its copies, in shuffled order."""
    by_source = rates(docs, weights, total).select(F.col("source").alias("_source"), F.col("rate").alias("_rate"))
    if len(by_source.select("_source").limit(MAX_BROADCAST_SOURCES + 1).collect()) <= MAX_BROADCAST_SOURCES:
        by_source = F.broadcast(by_source)
    held = docs.select(packed_rows(docs).alias("r"), F.col("source").alias("source"), F.col("doc_id").cast("string").alias("doc_id"))
    counted = held.join(by_source, F.col("source").eqNullSafe(F.col("_source"))).withColumn("many", poisson_count(F.col("_rate"), F.col("doc_id"), seed))
    copied = counted.where(F.col("many") > 0).select("r", "doc_id", F.explode(F.sequence(F.lit(1), F.col("many"))).alias("copy"))
    key = F.md5(F.concat_ws(":", F.lit(seed), F.coalesce("doc_id", F.lit("")), "copy", F.lit("order")).cast("binary"))
    keyed = copied.select("r", "copy", key.alias("shuffle_key"))
    return keyed.repartition(shuffle_parts(docs.sparkSession), "shuffle_key").sortWithinPartitions("shuffle_key")


def mix(docs: DataFrame, weights: Mapping[str | None, float] | None = None, total: float | None = None, seed: int = SEED) -> DataFrame:
    """``docs`` with each row repeated by its Poisson count, and copy (from 1) and shuffle_key, in shuffled order."""
    kept = [F.col(f"r.`{c}`").alias(c) for c in docs.columns if c not in ("copy", "shuffle_key")]
    return copies(docs, weights, total, seed).select(*kept, "copy", "shuffle_key")


def repeat(docs: DataFrame, weights: Mapping[str | None, float] | None = None, total: float | None = None, seed: int = SEED) -> DataFrame:
    """The same with the columns of ``docs`` alone, whatever their names."""
    return copies(docs, weights, total, seed).select(*unpacked(docs, "r"))


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(documents(spark, sf_dir))


ORACLE = """
WITH held AS (SELECT source, count(*) AS n_docs FROM documents GROUP BY source),
rates AS (
  SELECT source, (SELECT count(*) FROM documents)::DOUBLE * 1.0::DOUBLE / (SELECT count(*) FROM held)::DOUBLE / n_docs AS rate FROM held
), pieces AS (
  SELECT d.*, greatest(ceil(rate / 16.0::DOUBLE), 1)::INT AS n, rate / greatest(ceil(rate / 16.0::DOUBLE), 1) AS mean
  FROM documents d JOIN rates r ON d.source IS NOT DISTINCT FROM r.source
), drawn AS (
  SELECT *, list_transform(range(1, n + 1), lambda i: ((('0x' || substr(md5('17:' || coalesce(doc_id::VARCHAR, '') || ':' || i::VARCHAR), 1, 13))::BIGINT)::DOUBLE + 0.5::DOUBLE) / 4503599627370496.0::DOUBLE) AS us
  FROM pieces
), terms AS (
  SELECT *, list_transform(range(0, 80), lambda k: list_sum(list_transform(range(0, k + 1), lambda j: exp(-mean + j * ln(mean) - lgamma(j + 1.0::DOUBLE))))) AS cdf
  FROM (SELECT DISTINCT mean FROM drawn)
), counted AS (
  SELECT d.*, list_sum(list_transform(us, lambda u: len(list_filter(t.cdf, lambda c: c < u))))::BIGINT AS copies
  FROM drawn d JOIN terms t ON d.mean = t.mean
)
SELECT doc_id, text, lang, source, n_chars, copy::INT AS copy, md5('17:' || coalesce(doc_id::VARCHAR, '') || ':' || copy::VARCHAR || ':order') AS shuffle_key
FROM (SELECT doc_id, text, lang, source, n_chars, unnest(range(1, copies + 1)) AS copy FROM counted)
"""
