"""Ownership and context of loaded rows, purges, publications and what definitions can be made from the data."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..spec import Metric, Role, Score
from .quality import duplicates, orphans


def purge(dimension: DataFrame, bridge: DataFrame, key: str, source: str, gone: str) -> DataFrame:
    """``dimension`` without the entities that only the source ``gone`` knows; what other sources share stays."""
    only = bridge.groupBy(key).agg(F.bool_and(F.coalesce(F.col(source) == gone, F.lit(False))).alias("_only")).where("_only").select(key)
    return dimension.join(only, key, "left_anti")


def universe(dimension: DataFrame, facts: DataFrame, key: str, group: str) -> DataFrame:
    """Every fact and every entity once, with state: read (a fact of an entity whose group is known), or why it is left out: a fact
    without entity, an entity without fact, or an entity without group."""
    held = facts.withColumn("_fact", F.lit(True)).join(dimension.withColumn("_entity", F.lit(True)), key, "full")
    state = F.when(F.col("_entity").isNull(), "fact without entity").when(F.col("_fact").isNull(), "entity without fact").when(F.col(group).isNull(), "entity without group").otherwise("read")
    return held.withColumn("state", state).drop("_fact", "_entity")


def _status(name: str, count: Column, warn: Column, fail: Column) -> Column:
    return F.struct(F.lit(name).alias("check_name"), F.when(fail, "fail").when(warn, "warn").otherwise("pass").alias("status"), count.cast("long").alias("record_count"))


def ownership(dimension: DataFrame, bridge: DataFrame, facts: DataFrame, declared: Sequence[str], discrepant: Column, most: float = 0.10) -> DataFrame:
    """(check_name, status, record_count) of sources that are declared but own nothing, entities without a source, source
    ids that come twice, bridge rows that ``discrepant`` marks (a warning from ``most`` of all on) and facts of no bridge row.

    ``dimension``: entity_id; ``bridge``: source, source_id, entity_id; ``facts``: source_id."""
    one = lambda df, name: df.agg(F.count("*").alias("n"), F.lit(None).cast("long").alias("of")).withColumn("check_name", F.lit(name))
    wanted = bridge.sparkSession.createDataFrame([(s,) for s in declared], "source string")
    parts = one(orphans(wanted, "source", bridge, "source"), "stranded source")
    parts = parts.unionByName(one(orphans(dimension, "entity_id", bridge, "entity_id"), "orphan"))
    parts = parts.unionByName(one(duplicates(bridge, ["source", "source_id"]), "duplicate"))
    parts = parts.unionByName(one(orphans(facts, "source_id", bridge, "source_id"), "dangling"))
    share = bridge.agg(F.count_if(F.coalesce(discrepant, F.lit(False))).alias("n"), F.count("*").alias("of")).withColumn("check_name", F.lit("discrepant"))
    parts = parts.unionByName(share)
    bad = F.when(F.col("of").isNull(), F.col("n") > 0).otherwise((F.col("of") > 0) & (F.col("n") >= most * F.col("of")))
    return parts.select("check_name", F.when(bad, F.when(F.col("check_name").isin("orphan", "discrepant"), "warn").otherwise("fail")).otherwise("pass").alias("status"), F.col("n").alias("record_count"))


def contexts(rows: DataFrame, club: str, country: str, home: str, ends: str, today: Column, most: float = 0.25) -> DataFrame:
    """(check_name, status, record_count): clubs with rows in several countries, rows outside their club's home, and ends
    that are past (a warning from ``most`` of the known ones on). One pass by club, then one row."""
    by_club = rows.groupBy(club).agg(
        F.count_distinct(country).alias("_countries"), F.count_if(F.col(country) != F.col(home)).alias("_outside"),
        F.count_if(F.col(ends) < today).alias("_past"), F.count(ends).alias("_ends"),
    )
    total = by_club.agg(F.count_if(F.col("_countries") > 1).alias("_several"), *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("_outside", "_past", "_ends")])
    never, late = F.lit(False), (F.col("_ends") > 0) & (F.col("_past") >= most * F.col("_ends"))
    checks = [_status("several countries", F.col("_several"), F.col("_several") > 0, never), _status("outside home", F.col("_outside"), F.col("_outside") > 0, never), _status("past end", F.col("_past"), late, never)]
    return total.select(F.explode(F.array(*checks)).alias("c")).select("c.*")


def publish(ledger: DataFrame, batch: DataFrame, key: Sequence[str], order: str) -> DataFrame:
    """``ledger`` with those rows of ``batch`` whose key it lacks, of each key the one of least ``order``: publishing a batch
    again adds nothing."""
    rest = [c for c in batch.columns if c not in (*key, order)]
    first = batch.groupBy(*key).agg(F.min(F.struct(order, *rest)).alias("_f")).select(*key, "_f.*")
    return ledger.unionByName(first.join(ledger.select(*key).distinct(), list(key), "left_anti"))


def same_rows(a: DataFrame, b: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row: counts of both and whether they hold the same rows in any order, by the sum of the rows' hashes."""
    one = lambda df, n: df.agg(F.count("*").alias(n), F.sum(F.xxhash64(*columns).cast("decimal(38,0)")).alias(f"_{n}"))
    both = one(a, "staged_rows").join(F.broadcast(one(b, "served_rows")))
    return both.select("staged_rows", "served_rows", ((F.col("staged_rows") == F.col("served_rows")) & F.col("_staged_rows").eqNullSafe(F.col("_served_rows"))).alias("equal"))


def provider_status(ledger: DataFrame, providers: DataFrame, source: str, at: str, status: str, context: str) -> DataFrame:
    """Per provider, known from either side: its last publication, load (null context) and attempt, and failures among its
    attempts; all from one aggregation."""
    last = lambda test, name: F.max(F.when(test, F.col(at))).alias(name)
    seen = ledger.groupBy(source).agg(last(F.col(context) == "PUBLISHED", "published"), last(F.col(context).isNull(), "loaded"), last(F.col(context) == "CANDIDATE", "attempted"), F.count_if((F.col(context) == "CANDIDATE") & (F.col(status) == "fail")).alias("failed"))
    return seen.join(providers, source, "full").fillna(0, ["failed"])


def resolve_names(paths: DataFrame, names: DataFrame, most: int = 6) -> DataFrame:
    """(name, status, candidates): AVAILABLE if a path's last part is the name, UNCLEAR with up to ``most`` paths that share a
    word with it, else UNAVAILABLE. ``paths``: path; ``names``: name. Words meet in an equality join."""
    words = lambda c: F.explode(F.array_distinct(F.split(F.lower(c), "[^a-z0-9]+")))
    leaf = F.element_at(F.split("path", r"\."), -1)
    exact = paths.select(leaf.alias("name")).distinct().withColumn("_exact", F.lit(True))
    shared = names.select("name", words(F.col("name")).alias("_w")).join(paths.select("path", words(leaf).alias("_w")).where("_w <> ''"), "_w")
    first = Window.partitionBy("name").orderBy("path")
    near = shared.select("name", "path").distinct().withColumn("_r", F.row_number().over(first)).where(F.col("_r") <= most)
    near = near.groupBy("name").agg(F.sort_array(F.collect_list("path")).alias("_near"))
    both = names.join(exact, "name", "left").join(near, "name", "left")
    status = F.when(F.col("_exact"), "AVAILABLE").when(F.col("_near").isNotNull(), "UNCLEAR").otherwise("UNAVAILABLE")
    return both.select("name", status.alias("status"), F.when(status == "UNCLEAR", F.array_join("_near", ",")).alias("candidates"))


def supplied_weights(wide: DataFrame, scores: Sequence[Score], roles: Sequence[Role]) -> DataFrame:
    """(kind, name, configured, supplied, enabled): the weight of a definition's components that anyone has, against all of
    it. A score that isn't enabled supplies nothing to a role. One aggregation over ``wide``, one row, few definitions."""
    metrics = sorted({c for d in (*scores, *roles) for c in d.weights if not c.startswith("score:")})
    seen = wide.agg(*[(F.count(m) > 0).alias(m) for m in metrics])
    enabled: dict[str, Column] = {}

    def one(kind: str, name: str, weights: Mapping[str, float], least: float) -> Column:
        have = F.lit(0.0)
        for c, w in weights.items():
            have = have + F.when(enabled[c[6:]] if c.startswith("score:") else F.col(c), F.lit(float(w))).otherwise(F.lit(0.0))
        total = float(sum(weights.values()))
        ok = have >= least * total - 1e-9
        if kind == "score":
            enabled[name] = ok
        return F.struct(F.lit(kind).alias("kind"), F.lit(name).alias("name"), F.lit(total).alias("configured"), have.alias("supplied"), ok.alias("enabled"))

    rows = [one("score", s.name, s.weights, s.min_coverage) for s in scores] + [one("role", r.name, r.weights, r.min_coverage) for r in roles]
    return seen.select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def census(totals: DataFrame, metrics: Sequence[Metric], verified: Sequence[str], minutes: Sequence[str] = ("minutes", "recorded_minutes")) -> DataFrame:
    """(metric, status): VERIFIED for confirmed totals that anyone has, AVAILABLE for other such totals, DERIVABLE for metrics
    all of whose inputs anyone has, else UNAVAILABLE."""
    inputs = sorted({m.total for m in metrics})
    over = {m.over for m in metrics if m.kind != "per90"}
    seen = totals.agg(*[(F.count(c) > 0).alias(c) for c in sorted({*inputs, *over, *minutes})])
    raw = [F.struct(F.lit(c).alias("metric"), F.when(F.col(c), "VERIFIED" if c in verified else "AVAILABLE").otherwise("UNAVAILABLE").alias("status")) for c in inputs]
    some = F.col(minutes[0]) | F.col(minutes[1])
    made = [F.struct(F.lit(m.name).alias("metric"), F.when(F.col(m.total) & (some if m.kind == "per90" else F.col(m.over)), "DERIVABLE").otherwise("UNAVAILABLE").alias("status")) for m in metrics]
    return seen.select(F.explode(F.array(*raw, *made)).alias("r")).select("r.*")


def markdown(df: DataFrame) -> DataFrame:
    """``df`` as rows (line) of a Markdown table, without its head; nulls are dashes and bars are escaped."""
    cell = lambda c: F.coalesce(F.replace(F.col(f"`{c}`").cast("string"), F.lit("|"), F.lit("\\|")), F.lit("-"))
    return df.select(F.concat(F.lit("| "), F.concat_ws(" | ", *[cell(c) for c in df.columns]), F.lit(" |")).alias("line"))


def markdown_head(spark: SparkSession, columns: Sequence[str]) -> DataFrame:
    return spark.createDataFrame([("| " + " | ".join(columns) + " |",), ("|" + "---|" * len(columns),)], "line string")
