"""Checks of tables: profiles, keys, references, ledgers, quarantine and the guard before publication."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def profile(df: DataFrame) -> DataFrame:
    """(field, type, rows, known, null_share, kinds, least, most) for each column, from one pass; least and most as text."""
    aggs = []
    for c, kind in df.dtypes:
        v = F.col(f"`{c}`")
        aggs.append(F.struct(F.lit(c).alias("field"), F.lit(kind).alias("type"), F.count("*").alias("rows"), F.count(v).alias("known"), F.count_distinct(v).alias("kinds"), F.min(v).cast("string").alias("least"), F.max(v).cast("string").alias("most")).alias(c))
    row = df.agg(*aggs).select(F.explode(F.array(*[F.col(f"`{c}`") for c in df.columns])).alias("p")).select("p.*")
    return row.withColumn("null_share", F.when(F.col("rows") > 0, 1.0 - F.col("known") / F.col("rows")))


def orphans(facts: DataFrame, key: str, dimension: DataFrame, to: str) -> DataFrame:
    return facts.join(dimension.select(F.col(to).alias(key)).distinct(), key, "left_anti")


def referenced(dimension: DataFrame, key: str, facts: DataFrame, by: str) -> DataFrame:
    return dimension.join(facts.select(F.col(by).alias(key)).distinct(), key, "left_semi")


def duplicates(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("copies")).where("copies > 1")


def check_rows(rows: DataFrame, entity: str, checks: Sequence[tuple[str, Column, int, int]]) -> DataFrame:
    """(entity, check_name, status, record_count) of (name, bad, warn at, fail at) counts, from one aggregation."""
    counts = rows.agg(*[F.count_if(F.coalesce(bad, F.lit(False))).alias(name) for name, bad, _, _ in checks])
    one = lambda name, warn, fail: F.struct(F.lit(entity).alias("entity"), F.lit(name).alias("check_name"), F.when(F.col(name) >= fail, "fail").when(F.col(name) >= warn, "warn").otherwise("pass").alias("status"), F.col(name).alias("record_count"))
    return counts.select(F.explode(F.array(*[one(n, w, f) for n, _, w, f in checks])).alias("c")).select("c.*")


def split(rows: DataFrame, rules: Sequence[tuple[str, Column]]) -> DataFrame:
    """``rows`` with refused: the names of the rules they break; a rule on nulls isn't broken."""
    return rows.withColumn("refused", F.array_compact(F.array(*[F.when(F.coalesce(bad, F.lit(False)), F.lit(name)) for name, bad in rules])))


def latest(ledger: DataFrame, source: str, at: str) -> DataFrame:
    """Each source's rows of its latest time, ties kept."""
    last = ledger.groupBy(source).agg(F.max(at).alias("_at"))
    return ledger.join(last, source).where(F.col(at) == F.col("_at")).drop("_at")


def freshness(ledger: DataFrame, source: str, at: str, status: str, now: Column, stale_days: int = 7) -> DataFrame:
    """Per source: its last time, age in days, failures and warnings at that time, and whether it is stale."""
    age = F.datediff(now, F.to_date("last_run"))
    out = latest(ledger, source, at).groupBy(source).agg(F.max(at).alias("last_run"), F.count_if(F.col(status) == "fail").alias("failed"), F.count_if(F.col(status) == "warn").alias("warned"))
    return out.withColumn("age_days", age).withColumn("stale", age > stale_days)


def identity_coverage(bridge: DataFrame, entity: str, source: str, confidence: str, manual: str) -> DataFrame:
    """Per entity: sources, least confidence, any manual link, and status manual, ambiguous (under .90) or matched."""
    out = bridge.groupBy(entity).agg(F.count_distinct(source).alias("sources"), F.min(confidence).alias("confidence"), F.coalesce(F.bool_or(manual), F.lit(False)).alias("manual"))
    return out.withColumn("status", F.when(F.col("manual"), "manual").when(F.col("confidence") < 0.90, "ambiguous").when(F.col("sources") > 1, "matched").otherwise("single"))


def fingerprint(ledger: DataFrame, at: str, context: str) -> DataFrame:
    """Rows and latest time of what isn't a candidate; a null context is served."""
    return ledger.where(~F.col(context).eqNullSafe("CANDIDATE")).agg(F.count("*").alias("rows"), F.max(at).alias("latest"))


def publishable(candidate: DataFrame, served: DataFrame, least: float = 0.75) -> DataFrame:
    """One row: counts of both and whether the candidate is non-empty and has at least ``least`` of the served rows."""
    a, b = candidate.agg(F.count("*").alias("candidate_rows")), served.agg(F.count("*").alias("served_rows"))
    return a.join(F.broadcast(b)).withColumn("publish", (F.col("candidate_rows") > 0) & (F.col("candidate_rows") >= least * F.col("served_rows")))


def failure_ledger(ledger: DataFrame, failed_now: DataFrame, tried_now: DataFrame, key: str, run: str) -> DataFrame:
    """(key, runs_failed, first_run, last_run) after this run: ids that failed again or first, without those that healed."""
    now = failed_now.select(key).distinct().withColumn("_now", F.lit(True))
    both = ledger.join(now, key, "full").join(tried_now.select(key).distinct().withColumn("_tried", F.lit(True)), key, "left")
    out = both.where(F.col("_now") | F.col("_tried").isNull())
    again = F.coalesce(F.col("_now").cast("int"), F.lit(0))
    return out.select(key, (F.coalesce("runs_failed", F.lit(0)) + again).alias("runs_failed"), F.coalesce("first_run", F.lit(run)).alias("first_run"), F.when(F.col("_now"), F.lit(run)).otherwise(F.col("last_run")).alias("last_run"))


def infer_denominator(rows: DataFrame, totals: Sequence[str], published: Sequence[str], playing: str, recorded: str, tolerance: float = 0.011, gap: int = 45) -> DataFrame:
    """(metric, by_playing, by_recorded, verdict): which minutes reproduce published per-90 values, where they differ enough."""
    far = F.abs(F.col(playing) - F.col(recorded)) >= gap
    fits = lambda t, p, m: F.count_if(far & (F.abs(F.col(t) * 90.0 / F.nullif(F.col(m), F.lit(0)) - F.col(p)) <= tolerance))
    sums = rows.agg(*[F.struct(F.lit(t).alias("metric"), fits(t, p, playing).alias("by_playing"), fits(t, p, recorded).alias("by_recorded")).alias(t) for t, p in zip(totals, published, strict=True)])
    out = sums.select(F.explode(F.array(*totals)).alias("s")).select("s.*")
    return out.withColumn("verdict", F.when((F.col("by_playing") > 0) & (F.col("by_recorded") == 0), "playing").when((F.col("by_recorded") > 0) & (F.col("by_playing") == 0), "recorded").otherwise("unclear"))


def leaders(rows: DataFrame, by: Sequence[str], key: str, lower_is_better: Sequence[str]) -> DataFrame:
    """(by, metric, leader) over long rows (by, key, metric, value): the only best of at least two known values."""
    good = F.when(F.col("metric").isin(*lower_is_better), -F.col("value")).otherwise(F.col("value"))
    w = Window.partitionBy(*by, "metric")
    known = rows.where(F.col("value").isNotNull()).withColumn("_g", good).withColumn("_best", F.max("_g").over(w)).withColumn("_n", F.count("*").over(w))
    best = known.where(F.col("_g") == F.col("_best")).withColumn("_ties", F.count("*").over(w))
    return best.where("_ties = 1 AND _n >= 2").select(*by, "metric", F.col(key).alias("leader"))
