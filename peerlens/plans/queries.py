"""The queries over tables, by name."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import rates as R
from ..operators import filters, identity, neighbours, percentile, presets, quality, reading, reliability, scoring, similarity
from ..operators.metrics import coverage_by_group, derive, unpivot
from ..sources.shared import apart, written
from ..sources.writers import csv_lines
from .fixture import KEYS, LOWER, METRICS, NAMES, ROLES, SCORES, population, stats, tables

TODAY = date(1998, 3, 1)
GROUP = ["metric", "peer_group", "season_id"]


def season_totals(spark: SparkSession, d: str) -> DataFrame:
    return stats(spark, d)


def derived_rates(spark: SparkSession, d: str) -> DataFrame:
    return derive(stats(spark, d), METRICS).select(*KEYS, *NAMES)


def exposure_bands(spark: SparkSession, d: str) -> DataFrame:
    cover = R.coverage("recorded_minutes", "minutes")
    return stats(spark, d).select(*KEYS, cover.alias("coverage"), R.coverage_band(cover).alias("coverage_band"), R.sample_band("minutes").alias("sample_band"), R.rateable_minutes("minutes", "recorded_minutes").alias("rateable"), F.coalesce(F.col("recorded_minutes") > F.col("minutes"), F.lit(False)).alias("inconsistent"))


def calendar(spark: SparkSession, d: str) -> DataFrame:
    (orders,) = tables(spark, d, "orders")
    day = F.to_date("o_orderdate")
    return orders.select("o_orderkey", R.age_at(day, TODAY).alias("age"), R.months_until(day, TODAY).alias("months"), R.expires_within(day, TODAY, 6).alias("expiring"), R.has_lapsed(day, TODAY).alias("lapsed"))


PAIRS = [("successes", "returns"), ("discounted", "headline")]


def consistency(spark: SparkSession, d: str) -> DataFrame:
    own = R.reconciled(PAIRS)
    return stats(spark, d).select(*KEYS, F.array_join(R.inconsistencies(PAIRS), "; ").alias("errors"), *[c.alias(n) for n, c in own.items()])


def availability(spark: SparkSession, d: str) -> DataFrame:
    rows = derive(stats(spark, d), METRICS)
    held = rows.groupBy("peer_group").agg(F.array_compact(F.array(*[F.when(F.count(m) > 0, F.lit(m)) for m in NAMES])).alias("_group"))
    own = R.available(NAMES)
    return rows.join(held, "peer_group").select(*KEYS, F.array_join(own, ",").alias("available"), (F.size(F.array_intersect(own, F.col("_group"))) / F.size("_group")).alias("completeness"))


def primary_rows(spark: SparkSession, d: str) -> DataFrame:
    return population(spark, d).select(*KEYS, "minutes", "is_primary")


def _long(rows: DataFrame) -> DataFrame:
    return unpivot(rows, [*KEYS, "is_primary"], NAMES)


def percentiles_competition(spark: SparkSession, d: str) -> DataFrame:
    return percentile.mid_rank(_long(population(spark, d)), [*GROUP, "competition_id"]).select(*KEYS, "metric", "percentile", F.coalesce("n", F.lit(0)).alias("n"))


def percentiles_global(spark: SparkSession, d: str) -> DataFrame:
    return percentile.mid_rank(_long(population(spark, d)), GROUP, F.col("is_primary")).select(*KEYS, "metric", "percentile", F.coalesce("n", F.lit(0)).alias("n"))


def percentiles_league_group(spark: SparkSession, d: str, leagues: tuple[str, ...] = ("1-URGENT", "2-HIGH")) -> DataFrame:
    if not leagues:
        raise ValueError("a league group needs a competition")
    return percentile.mid_rank(_long(population(spark, d)), GROUP, F.col("is_primary") & F.col("competition_id").isin(*leagues)).select(*KEYS, "metric", "percentile")


def percentiles_widened(spark: SparkSession, d: str) -> DataFrame:
    out = percentile.scoped(_long(population(spark, d, "c_nationkey")), GROUP, "competition_id", F.col("is_primary"))
    return out.select(*KEYS, "metric", "percentile", "n", "scope", "reason", percentile.oriented(F.col("percentile"), F.col("metric"), LOWER).alias("oriented"))


def z_scores(spark: SparkSession, d: str) -> DataFrame:
    return percentile.z_scores(_long(population(spark, d)), GROUP).select(*KEYS, "metric", F.round("z", 6).alias("z"))


def maturity(spark: SparkSession, d: str) -> DataFrame:
    out = percentile.maturity(stats(spark, d), ["peer_group", "season_id"], "competition_id", R.rateable_minutes("minutes", "recorded_minutes"))
    return out.select("peer_group", "season_id", "units", "established", "share", "median_most", F.array_join("covered", ",").alias("covered"), "early_season")


CARRIED = ["minutes", "recorded_minutes", "market_value", "is_primary"]


def ranked_wide(spark: SparkSession, d: str, rows: DataFrame | None = None, again: bool = False) -> DataFrame:
    """Totals, or ``rows`` like ``population``, with the oriented global percentile of each metric under its name, and _row, which tells
    rows apart. Rows are written, so that the facts are read once; ``again`` as in ``percentile.mid_ranks``."""
    own = (population(spark, d) if rows is None else rows).select(*KEYS, *CARRIED, *NAMES)
    own = written(own.withColumn("_row", F.monotonically_increasing_id()), "numbered")
    ranks = percentile.mid_ranks(own, "_row", ["peer_group", "season_id"], NAMES, F.col("is_primary"), again=again)
    o = lambda m: F.when(F.col(f"`{m}:n`") >= percentile.THIN, percentile.oriented(F.col(f"`{m}:rank`"), F.lit(m), LOWER))
    return ranks.select(*KEYS, *[o(m).alias(m) for m in NAMES], *CARRIED, "_row")


def composite_scores(spark: SparkSession, d: str) -> DataFrame:
    wide = ranked_wide(spark, d)
    w = SCORES[0].weights
    return scoring.with_scores(wide, SCORES).select(*KEYS, *[F.round(f"score:{s.name}", 6).alias(s.name) for s in SCORES], scoring.coverage(w).alias("coverage"), F.round(F.get(scoring.contributions(w), F.lit(0))["part"], 6).alias("largest_part"), scoring.dominant(w).alias("dominant"))


def unproducible_scores(spark: SparkSession, d: str) -> DataFrame:
    return scoring.unproducible(derive(stats(spark, d), METRICS), SCORES)


def _roles(wide: DataFrame) -> DataFrame:
    scored = scoring.with_scores(wide, SCORES)
    return scoring.with_roles(scored, [*KEYS, "minutes", "market_value", "is_primary"], "peer_group", ROLES)


def role_scores(spark: SparkSession, d: str) -> DataFrame:
    return _roles(ranked_wide(spark, d)).select(*KEYS, "role", F.round("raw", 6).alias("raw"), F.round("coverage", 6).alias("coverage"), "validity", scoring.coverage_band(F.round("coverage", 9)).alias("band"))


ROLE_NAMES = [r.name for r in ROLES]


def scored_wide(spark: SparkSession, d: str) -> DataFrame:
    """``ranked_wide`` with scores, written. Scores, roles and fits are made in three steps, as the code that Spark generates for a step
    must stay under 8,000 bytes for the JVM to compile it."""
    return written(scoring.with_scores(ranked_wide(spark, d), SCORES), "ranked")


def scored_rows(spark: SparkSession, d: str) -> DataFrame:
    """``scored_wide``, not written, for what reads it twice at most: looking ranks up again takes less than writing and reading them."""
    return apart(scoring.with_scores(apart(ranked_wide(spark, d, again=True)), SCORES))


def with_fits(wide: DataFrame) -> DataFrame:
    """``wide``, as ``scored_wide`` makes it, without scores and with a column for each role: struct<role, raw, coverage, validity, fit>,
    null if it isn't open to the row's group."""
    keep = [*KEYS, *NAMES, *CARRIED, "_row"]
    value = lambda r: F.when(F.col(f"{r}.validity") == "full", F.round(f"{r}.raw", 6)).alias(f"fit:{r}")
    made = scoring.role_columns(wide, "peer_group", ROLES, keep)
    made = written(made.select("*", *[value(r) for r in ROLE_NAMES]), "roles")
    ranks = percentile.mid_ranks(made, "_row", ["season_id"], [f"fit:{r}" for r in ROLE_NAMES])
    fit = lambda r: F.when(F.col(f"`fit:{r}:n`") >= percentile.THIN, F.col(f"`fit:{r}:rank`")).alias("fit")
    return ranks.select(*keep, *[F.when(F.col(r).isNotNull(), F.struct(f"{r}.role", f"{r}.raw", f"{r}.coverage", f"{r}.validity", fit(r))).alias(r) for r in ROLE_NAMES])


def _fits(wide: DataFrame) -> DataFrame:
    """A row for each role open to a row of ``wide``, as ``scored_wide`` makes it."""
    keys = [*KEYS, "minutes", "market_value", "is_primary"]
    return with_fits(wide).select(*keys, F.explode(F.array_compact(F.array(*ROLE_NAMES))).alias("r")).select(*keys, "r.*")


def with_best(wide: DataFrame) -> DataFrame:
    """``wide``, as ``scored_wide`` or ``scored_rows`` makes it, without scores and with best: struct of the role, raw, fit and standing of
    each row's best role, or null. Only full roles can be best, so that a role is a number here; nothing is written."""
    keep = [*KEYS, *NAMES, *CARRIED, "_row"]
    full = lambda r: F.when(F.col(f"{r}.validity") == "full", F.col(f"{r}.raw")).alias(f"raw:{r}")
    made = apart(scoring.role_columns(wide, "peer_group", ROLES, keep).select(*keep, *[full(r) for r in ROLE_NAMES]))
    made = made.select("*", *[F.round(f"raw:{r}", 6).alias(f"fit:{r}") for r in ROLE_NAMES])
    ranks = percentile.mid_ranks(made, "_row", ["season_id"], [f"fit:{r}" for r in ROLE_NAMES], again=True)
    fit = lambda r: F.when(F.col(f"`fit:{r}:n`") >= percentile.THIN, F.col(f"`fit:{r}:rank`")).alias("fit")
    role = lambda r: F.when(F.col(f"raw:{r}").isNotNull(), F.struct(F.lit(r).alias("role"), F.col(f"raw:{r}").alias("raw"), F.lit("full").alias("validity"), fit(r))).alias(r)
    return ranks.select(*keep, *[role(r) for r in ROLE_NAMES]).select(*keep, scoring.best_of(ROLE_NAMES).alias("best"))


def role_fit(spark: SparkSession, d: str) -> DataFrame:
    return _fits(scored_wide(spark, d)).select(*KEYS, "role", "validity", "fit")


def best_roles(spark: SparkSession, d: str) -> DataFrame:
    return scoring.best_role(_fits(scored_wide(spark, d)), KEYS).select(*KEYS, "role", "standing")


def shrunk_ranking(spark: SparkSession, d: str) -> DataFrame:
    scored = scored_wide(spark, d).where("is_primary").withColumn("raw", F.col("score:volume"))
    out = reliability.rank_by_evidence(scored, "raw", "minutes", ["peer_group", "season_id"])
    return out.select("entity_key", "peer_group", "season_id", F.round("raw", 6).alias("raw"), F.round("mean", 6).alias("mean"), F.round("weight", 6).alias("weight"), F.round("ranked", 6).alias("ranked"))


def recruitment(spark: SparkSession, d: str, weights: dict[str, float] | None = None, top: int = 25) -> DataFrame:
    """Weighted search: percentiles, scores, one composite, evidence, the best ``top`` of each season."""
    weights = weights or {"score:volume": 60.0, "score:finish": 40.0}
    weights = scoring.normalised(weights, {f"score:{s.name}" for s in SCORES})
    rows = scored_wide(spark, d).where("is_primary")
    rows = rows.where(filters.predicate(filters.RECRUITMENT, minutes_min=180, value_min=100))
    rows = rows.withColumn("raw", scoring.weighted({f"`{k}`": w for k, w in weights.items()}, 1.0 - 1e-9))
    out = reliability.rank_by_evidence(rows, "raw", "minutes", ["season_id"])
    w = Window.partitionBy("season_id").orderBy(F.desc(F.round("ranked", 6)), "entity_key")
    out = out.withColumn("place", F.row_number().over(w)).where(F.col("place") <= top)
    return out.select("season_id", "place", "entity_key", "peer_group", F.round("raw", 6).alias("raw"), F.round("ranked", 6).alias("ranked"), F.round(R.market_fit("market_value", 5000.0), 6).alias("market_fit"))


def opportunity_funnel(spark: SparkSession, d: str) -> DataFrame:
    rows = population(spark, d).where("is_primary")
    criteria = [("minutes_ok", F.col("minutes") >= 450), ("value_ok", F.col("market_value") <= 5000), ("recorded_ok", F.col("recorded_minutes") >= 180), ("rated_ok", F.col("success_percentage") >= 30)]
    return rows.groupBy("season_id").agg(*filters.funnel(criteria))


def opportunities(spark: SparkSession, d: str, top: int = 20) -> DataFrame:
    rows = with_best(scored_rows(spark, d)).where("is_primary AND best IS NOT NULL")
    best = written(rows.select(*KEYS, *CARRIED, F.col("best.role").alias("role"), F.round("best.raw", 6).alias("raw")), "best")
    prior = best.agg(F.avg("raw").alias("_prior"))
    kept = best.join(F.broadcast(prior)).where(filters.predicate(filters.OPPORTUNITY, minutes_min=450, value_max=5000))
    out = reliability.rank_by_evidence(kept.withColumn("_p", F.col("_prior")), "raw", "minutes", (), F.col("_prior"))
    w = Window.partitionBy("season_id").orderBy(F.desc(F.round("ranked", 6)), "entity_key")
    return out.withColumn("place", F.row_number().over(w)).where(F.col("place") <= top).select("season_id", "place", "entity_key", "role", "raw", F.round("ranked", 6).alias("ranked"))


def player_search(spark: SparkSession, d: str, offset: int = 0, limit: int = 50) -> DataFrame:
    rows = population(spark, d).where(F.col("is_primary") & filters.predicate(filters.SEARCH, minutes_min=300, value_min=1, value_max=8000))
    return rows.orderBy(F.desc("minutes"), "entity_key", "season_id").offset(offset).limit(limit).select("entity_key", "season_id", "peer_group", "minutes", "market_value")


def _targets(rows: DataFrame) -> DataFrame:
    w = Window.partitionBy("peer_group", "season_id").orderBy(F.desc("minutes"), "entity_key")
    return rows.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def similar_profiles(spark: SparkSession, d: str, top: int = 20) -> DataFrame:
    """What is most like the row of most minutes in each group and season."""
    rows = written(ranked_wide(spark, d).where("is_primary"), "ranked")
    out = similarity.similar(rows, _targets(rows), ["peer_group", "season_id"], "entity_key", NAMES, "minutes")
    w = Window.partitionBy("peer_group", "season_id", "target").orderBy(F.desc(F.round("ranked", 6)), "entity_key")
    out = out.withColumn("place", F.row_number().over(w)).where(F.col("place") <= top)
    return out.select("peer_group", "season_id", "target", "place", "entity_key", "shared", F.round("index", 6).alias("index"), F.round("strength", 6).alias("strength"), F.round("ranked", 6).alias("ranked"), F.get("gaps", F.lit(0))["feature"].alias("closest"))


def replacements(spark: SparkSession, d: str, top: int = 10) -> DataFrame:
    """Similarity .55, role fit .30 and affordability .15; complete candidates come before those that lack a part."""
    rows = with_best(scored_rows(spark, d)).where("is_primary")
    rows = written(rows.select("peer_group", "season_id", "entity_key", *NAMES, "minutes", "market_value", F.col("best.standing").alias("role_fit")), "fitted")
    alike = similarity.similar(rows, _targets(rows), ["peer_group", "season_id"], "entity_key", NAMES, "minutes", carry=["market_value", "role_fit"], keep=True, ranked=False)
    parts = alike.withColumn("afford", R.market_fit("market_value", 5000.0))
    w = {"index": 0.55, "role_fit": 0.30, "afford": 0.15}
    parts = parts.withColumn("overall", scoring.weighted(w, 0.55 - 1e-9)).withColumn("complete", F.col("role_fit").isNotNull() & F.col("afford").isNotNull())
    parts = written(parts.select("peer_group", "season_id", "target", "entity_key", "minutes", "complete", "overall"), "parts")
    out = reliability.rank_by_evidence(parts, "overall", "minutes", ["peer_group", "season_id", "target", "complete"])
    order = Window.partitionBy("peer_group", "season_id", "target").orderBy(F.desc("complete"), F.desc(F.round("ranked", 6)), "entity_key")
    return out.withColumn("place", F.row_number().over(order)).where(F.col("place") <= top).select("peer_group", "season_id", "target", "place", "entity_key", "complete", F.round("overall", 6).alias("overall"), F.round("ranked", 6).alias("ranked"))


def embedding_neighbours(spark: SparkSession, d: str) -> DataFrame:
    """The three nearest fellows of each vector within its label."""
    (e,) = tables(spark, d, "embeddings")
    return neighbours.nearest(e, "label", "vec_id", "embedding", 3)


def compared_leaders(spark: SparkSession, d: str) -> DataFrame:
    """Of the five rows of most minutes in each group and season, the only best in each metric."""
    rows = derive(stats(spark, d), METRICS).groupBy("entity_key", "peer_group", "season_id").agg(F.sum("minutes").alias("minutes"), *[F.max(m).alias(m) for m in NAMES])
    w = Window.partitionBy("peer_group", "season_id").orderBy(F.desc("minutes"), "entity_key")
    five = rows.withColumn("_r", F.row_number().over(w)).where("_r <= 5")
    return quality.leaders(unpivot(five, ["peer_group", "season_id", "entity_key"], NAMES), ["peer_group", "season_id"], "entity_key", LOWER)


def metric_coverage(spark: SparkSession, d: str) -> DataFrame:
    return coverage_by_group(derive(stats(spark, d), METRICS), NAMES, "peer_group").withColumnRenamed("rows", "n_rows")


def mean_coverage(spark: SparkSession, d: str) -> DataFrame:
    cover = R.clamp(R.coverage("recorded_minutes", "minutes"))
    return stats(spark, d).groupBy("competition_id").agg(F.round(F.avg(cover), 6).alias("mean_coverage"), F.count_if(F.col("recorded_minutes") > F.col("minutes")).alias("beyond"))


def field_profile(spark: SparkSession, d: str) -> DataFrame:
    (customer,) = tables(spark, d, "customer")
    return quality.profile(customer.select("c_custkey", "c_name", "c_nationkey", "c_mktsegment")).select("field", F.col("rows").alias("n_rows"), "known", "kinds", "least", "most", "null_share")


def identity_coverage(spark: SparkSession, d: str) -> DataFrame:
    (orders,) = tables(spark, d, "orders")
    bridge = orders.select("o_custkey", "o_orderpriority", ((F.floor("o_totalprice") % 100 + 900) / 1000).alias("confidence"), (F.col("o_orderkey") % 97 == 0).alias("manual_link"))
    return quality.identity_coverage(bridge, "o_custkey", "o_orderpriority", "confidence", "manual_link")


def identity_by_competition(spark: SparkSession, d: str) -> DataFrame:
    orders, customers = tables(spark, d, "orders", "customer")
    known = orders.join(customers.where("c_acctbal >= 0").select("c_custkey"), F.col("o_custkey") == F.col("c_custkey"), "left")
    return known.groupBy("o_orderpriority").agg(F.count_distinct("o_custkey").alias("entities"), F.count_distinct(F.when(F.col("c_custkey").isNotNull(), F.col("o_custkey"))).alias("linked"))


def _ledger(spark: SparkSession, d: str) -> DataFrame:
    (events,) = tables(spark, d, "events")
    status = F.when(F.col("user_id") % 7 == 0, "fail").when(F.col("user_id") % 3 == 0, "warn").otherwise("pass")
    return events.select("event_id", F.col("event_type").alias("source"), F.date_trunc("hour", "ts").alias("at"), status.alias("status"), F.when(F.col("user_id") % 2 == 0, "CANDIDATE").when(F.col("user_id") % 5 == 0, "PUBLISHED").alias("context"))


def ledger_freshness(spark: SparkSession, d: str) -> DataFrame:
    out = quality.freshness(_ledger(spark, d), "source", "at", "status", F.lit(date(2024, 2, 3)))
    return out.select("source", F.date_format("last_run", "yyyy-MM-dd HH:mm").alias("last_run"), "failed", "warned", F.col("age_days").cast("long").alias("age_days"), "stale")


def latest_checks(spark: SparkSession, d: str) -> DataFrame:
    return quality.latest(_ledger(spark, d), "source", "at").select("source", "event_id", "status")


def served_fingerprint(spark: SparkSession, d: str) -> DataFrame:
    return quality.fingerprint(_ledger(spark, d), "at", "context").select(F.col("rows").alias("n_rows"), F.date_format("latest", "yyyy-MM-dd HH:mm").alias("latest"))


def candidate_checks(spark: SparkSession, d: str) -> DataFrame:
    """Candidates at each source's newest candidate time, if that is after its last publication."""
    ledger = _ledger(spark, d)
    newest = quality.latest(ledger.where("context = 'CANDIDATE'"), "source", "at")
    published = ledger.where("context = 'PUBLISHED'").groupBy("source").agg(F.max("at").alias("_p"))
    return newest.join(published, "source", "left").where(F.col("_p").isNull() | (F.col("at") > F.col("_p"))).select("source", "event_id", "status")


def orphans(spark: SparkSession, d: str) -> DataFrame:
    customers, orders = tables(spark, d, "customer", "orders")
    return quality.orphans(customers, "c_custkey", orders, "o_custkey").select("c_custkey", "c_nationkey")


def referenced_nations(spark: SparkSession, d: str) -> DataFrame:
    nation, supplier = tables(spark, d, "nation", "supplier")
    return quality.referenced(nation, "n_nationkey", supplier, "s_nationkey").select("n_nationkey", "n_name")


def duplicate_lines(spark: SparkSession, d: str) -> DataFrame:
    (lines,) = tables(spark, d, "lineitem")
    return quality.duplicates(lines, ["l_orderkey", "l_linenumber"])


def loader_checks(spark: SparkSession, d: str) -> DataFrame:
    checks = [("recorded_beyond_played", F.col("recorded_minutes") > F.col("minutes"), 1, 100), ("minutes_beyond_appearances", F.col("minutes") > F.col("appearances") * 120, 1, 1_000_000), ("value_unknown", F.col("market_value").isNull(), 1, 1_000_000), ("negative_minutes", F.col("minutes") < 0, 1, 1)]
    return quality.check_rows(stats(spark, d), "season_stats", checks)


def quarantine(spark: SparkSession, d: str) -> DataFrame:
    rules = [("minutes", F.col("minutes") > F.col("appearances") * 400), ("value", F.col("market_value") > 9000)]
    return quality.split(stats(spark, d), rules).select(*KEYS, F.array_join("refused", ",").alias("refused"))


def value_history(spark: SparkSession, d: str) -> DataFrame:
    (orders,) = tables(spark, d, "orders")
    day = F.when(F.col("o_orderkey") % 11 != 0, F.to_date("o_orderdate"))
    w = Window.partitionBy("o_custkey").orderBy(F.desc_nulls_last("valued_on"), "o_orderkey")
    rows = orders.select("o_custkey", "o_orderkey", day.alias("valued_on"), F.col("o_totalprice").alias("amount"))
    return rows.withColumn("place", F.row_number().over(w)).select("o_custkey", "place", "o_orderkey", F.date_format("valued_on", "yyyy-MM-dd").alias("valued_on"), "amount")


def pruned_history(spark: SparkSession, d: str) -> DataFrame:
    orders, lines = tables(spark, d, "orders", "lineitem")
    used = lines.where("l_discount > 0.08").select(F.col("l_orderkey").alias("o_orderkey")).distinct()
    return orders.join(used, "o_orderkey", "left_anti").select("o_orderkey", "o_custkey")


def csv_export(spark: SparkSession, d: str) -> DataFrame:
    (part,) = tables(spark, d, "part")
    return csv_lines(part.select("p_partkey", F.concat(F.when(F.col("p_size") % 5 == 0, F.lit("=")).otherwise(F.lit("")), F.col("p_name")).alias("p_name"), F.col("p_retailprice")))


def reference_lists(spark: SparkSession, d: str) -> DataFrame:
    rows = stats(spark, d)
    return rows.select(F.lit("competition").alias("kind"), F.col("competition_id").alias("name")).union(rows.select(F.lit("season"), "season_id")).union(rows.select(F.lit("group"), "peer_group")).distinct()


def role_presets(spark: SparkSession, d: str) -> DataFrame:
    """Each role's preset of score weights, with how many entities the role is open to."""
    (customer,) = tables(spark, d, "customer")
    made = [(r.name, s, w) for r in ROLES for s, w in (presets.preset(r, SCORES) or {}).items()]
    open_to = customer.select(F.explode(F.array_compact(F.array(*[F.when(F.col("c_mktsegment").isin(*r.groups), F.lit(r.name)) for r in ROLES]))).alias("role")).groupBy("role").agg(F.count("*").alias("open_to"))
    weights = F.broadcast(spark.createDataFrame(made, "role string, score string, weight int"))
    return weights.join(open_to, "role").select("role", "score", "weight", "open_to")


def highlights(spark: SparkSession, d: str) -> DataFrame:
    """Rows of customers whose number is theirs alone have keys of their own; those of shared numbers meet by their keys."""
    rows = apart(with_best(scored_rows(spark, d)).select(*KEYS, *NAMES, F.col("best.role").alias("role"))).where("role IS NOT NULL")
    own = {r.name: [m for m in r.weights if not m.startswith("score:")] for r in ROLES}
    (customers,) = tables(spark, d, "customer")
    several = written(customers.groupBy(F.col("c_custkey").alias("entity_key")).count().where("count > 1").select("entity_key"), "several")
    alone = lambda df: reading.highlights_of_rows(df, KEYS, NAMES, own, "role")
    if several.isEmpty():
        return alone(rows)
    met = rows.join(several, "entity_key", "left_semi")
    met = reading.highlights(unpivot(met, [*KEYS, "role"], NAMES).withColumnRenamed("value", "oriented"), KEYS, own, "role")
    return alone(rows.join(several, "entity_key", "left_anti")).unionByName(met)


def inert_ranking(spark: SparkSession, d: str) -> DataFrame:
    scored = scored_wide(spark, d).where("is_primary").withColumn("raw", F.col("score:volume"))
    return reliability.inert(reliability.rank_by_evidence(scored, "raw", "minutes"), "raw")


def denominators(spark: SparkSession, d: str) -> DataFrame:
    rows = stats(spark, d).withColumn("pub_attempts", F.round(R.per90("attempts", "minutes"), 2)).withColumn("pub_returns", F.round(R.per90("returns", "recorded_minutes"), 2))
    return quality.infer_denominator(rows, ["attempts", "returns"], ["pub_attempts", "pub_returns"], "minutes", "recorded_minutes")


def promotion_guard(spark: SparkSession, d: str) -> DataFrame:
    orders, lines = tables(spark, d, "orders", "lineitem")
    return quality.publishable(orders, lines)


def json_fields(spark: SparkSession, d: str) -> DataFrame:
    """Per key of events' props: how often it occurs and its distinct values."""
    (events,) = tables(spark, d, "events")
    pairs = events.select(F.explode(F.from_json("props", "map<string,string>")).alias("path", "value"))
    return pairs.groupBy("path").agg(F.count("*").alias("seen"), F.count("value").alias("known"), F.count_distinct("value").alias("kinds"))


def identity_candidates(spark: SparkSession, d: str) -> DataFrame:
    """Customers of two regions that share a birth date, or surname and birth year; names and dates stand in for theirs."""
    (customer,) = tables(spark, d, "customer")
    born = F.when(F.col("c_custkey") % 10 != 0, F.date_add(F.lit(date(1980, 1, 1)), (F.col("c_custkey") * 37 % 9000).cast("int")))
    rows = customer.select(F.col("c_custkey").alias("id"), F.concat(F.lit("n "), F.col("c_mktsegment"), F.lit(" s"), (F.col("c_custkey") % 41).cast("string")).alias("name"), born.alias("born"), "c_nationkey")
    return identity.candidates(rows.where("c_nationkey < 12"), rows.where("c_nationkey >= 12"))


def identity_decisions(spark: SparkSession, d: str) -> DataFrame:
    """Each customer's order of highest confidence, with some orders as manual overrides; prices stand in for confidence."""
    (orders,) = tables(spark, d, "orders")
    scored = orders.select(F.col("o_custkey").alias("left_id"), F.col("o_orderkey").alias("right_id"), ((F.floor("o_totalprice") % 200 + 800) / 1000).alias("confidence"))
    manual = orders.where("o_orderkey % 97 = 0").groupBy(F.col("o_custkey").alias("left_id")).agg(F.min("o_orderkey").alias("right_id"))
    return identity.decide(scored, manual)


def identity_merges(spark: SparkSession, d: str) -> DataFrame:
    """Customers planned to merge into the one before them whose number 4 divides; months stand in for seasons."""
    customer, orders = tables(spark, d, "customer", "orders")
    plan = customer.where("c_custkey % 4 <> 0").select(F.col("c_custkey").alias("source_id"), (F.col("c_custkey") - F.col("c_custkey") % 4).alias("target_id"))
    held = orders.select(F.col("o_custkey").alias("entity_id"), F.col("o_orderpriority").alias("competition_id"), F.date_format("o_orderdate", "yyyy-MM").alias("season_id"))
    return identity.merges(plan, held)


def distribution_profile(spark: SparkSession, d: str) -> DataFrame:
    """Least, median, 99th percentile and largest value of each metric in each group."""
    found = percentile.quantiles(unpivot(derive(stats(spark, d), METRICS), ["peer_group"], NAMES), ["peer_group", "metric"], {"middle": 0.5, "high": 0.99})
    return found.select("peer_group", "metric", "known", *[F.round(c, 6).alias(c) for c in ("least", "middle", "high", "most")])


def unscored_roles(spark: SparkSession, d: str) -> DataFrame:
    """Roles that a row has too little for, and the coverage that is short."""
    return _roles(ranked_wide(spark, d)).where("raw IS NULL").select(*KEYS, "role", F.round(0.5 - F.col("coverage"), 6).alias("shortfall"))


def shortlist_counts(spark: SparkSession, d: str) -> DataFrame:
    """Every customer with the number of orders, 0 included, and the latest one's date."""
    customer, orders = tables(spark, d, "customer", "orders")
    entries = orders.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("entries"), F.date_format(F.max("o_orderdate"), "yyyy-MM-dd").alias("latest"))
    return customer.select("c_custkey").join(entries, "c_custkey", "left").select("c_custkey", F.coalesce("entries", F.lit(0)).alias("entries"), "latest")


def hourly_events(spark: SparkSession, d: str) -> DataFrame:
    from ..streaming.ingest import hourly

    (events,) = tables(spark, d, "events")
    return hourly(events).select(F.date_format("hour", "yyyy-MM-dd HH:mm").alias("hour"), "event_type", "n", F.round("total", 4).alias("total"))


QUERIES = {f.__name__: f for f in (
    season_totals, derived_rates, exposure_bands, calendar, consistency, availability, primary_rows, percentiles_competition, percentiles_global, percentiles_league_group,
    percentiles_widened, z_scores, maturity, composite_scores, unproducible_scores, role_scores, role_fit, best_roles, shrunk_ranking, recruitment, opportunity_funnel,
    opportunities, player_search, similar_profiles, replacements, embedding_neighbours, compared_leaders, metric_coverage, mean_coverage, field_profile, identity_coverage,
    identity_by_competition, ledger_freshness, latest_checks, served_fingerprint, candidate_checks, orphans, referenced_nations, duplicate_lines, loader_checks, quarantine,
    value_history, pruned_history, csv_export, reference_lists, role_presets, highlights, inert_ranking, denominators, promotion_guard, json_fields, identity_candidates, identity_decisions, identity_merges,
    distribution_profile, unscored_roles, shortlist_counts, hourly_events,
)}
