"""Queries that put several operators together, and reports over them, by name."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import rates as R
from ..operators import identity, lifecycle, percentile, scoring, similarity
from ..operators.metrics import derive, unpivot
from ..sources.shared import written
from .fixture import KEYS, METRICS, NAMES, ROLES, SCORES, population, stats, tables
from .queries import GROUP, TODAY, _fits, _ledger, _long, _roles, _targets, identity_decisions, identity_merges, loader_checks, ranked_wide, scored_wide, with_best


def widest_contexts(spark: SparkSession, d: str) -> DataFrame:
    """For each score of a row the widest population behind any of its known components: most competitions, then largest."""
    rows = population(spark, d, "c_nationkey")
    ranks = percentile.scoped(_long(rows), GROUP, "competition_id", F.col("is_primary"))
    covered = rows.groupBy("peer_group", "season_id").agg(F.count_distinct("competition_id").alias("_all"))
    parts = spark.createDataFrame([(m, s.name) for s in SCORES for m in s.weights], "metric string, score string")
    known = ranks.where("scope IS NOT NULL").join(covered, ["peer_group", "season_id"]).join(F.broadcast(parts), "metric")
    wide = F.max(F.struct(F.when(F.col("scope") == "global", F.col("_all")).otherwise(F.lit(1)).alias("competitions"), F.col("n").alias("members")))
    return known.groupBy(*KEYS, "score").agg(wide.alias("w")).select(*KEYS, "score", "w.*")


def player_summary(spark: SparkSession, d: str) -> DataFrame:
    """Each entity's primary row of its last season, and how many rows and seasons it has."""
    rows = population(spark, d)
    held = rows.groupBy("entity_key").agg(F.count("*").alias("n_rows"), F.count_distinct("season_id").alias("seasons"), F.max(F.when(F.col("is_primary"), F.struct("season_id", "competition_id", "peer_group", "minutes", "market_value"))).alias("l"))
    return held.select("entity_key", "n_rows", "seasons", "l.*", R.sample_band("l.minutes").alias("sample_band"))


def player_stats(spark: SparkSession, d: str, entities: DataFrame | None = None) -> DataFrame:
    """Metrics with percentiles at competition scope, widened where thin, and their companions at global scope.

    ``entities`` (entity_key) asks for some only; then just the populations that they are in are ranked."""
    rows = population(spark, d, "c_nationkey")
    if entities is not None:
        asked = rows.join(entities.select("entity_key").distinct(), "entity_key", "left_semi").select("peer_group", "season_id").distinct()
        rows = rows.join(asked, ["peer_group", "season_id"], "left_semi")
    ranks = percentile.scoped(_long(rows), GROUP, "competition_id", F.col("is_primary"))
    ranks = percentile.mid_rank(ranks, GROUP, F.col("is_primary"), "_global", "_members")
    if entities is not None:
        ranks = ranks.join(entities.select("entity_key").distinct(), "entity_key", "left_semi")
    return ranks.select(*KEYS, "metric", "percentile", "scope", F.when(F.col("_members") >= percentile.THIN, F.col("_global")).alias("global_percentile"))


def player_roles(spark: SparkSession, d: str) -> DataFrame:
    """Per row its best role, the other full ones by standing, the partial ones, and the rest, closest to coverage first."""
    fits = _fits(scored_wide(spark, d))
    standing = F.coalesce("fit", "raw")
    names = lambda test, order: F.array_join(F.transform(F.sort_array(F.collect_list(F.when(test, F.struct(order.alias("o"), F.col("role"))))), lambda x: x["role"]), ",")
    full = names(F.col("validity") == "full", -F.round(standing, 6))
    out = fits.groupBy(*KEYS).agg(full.alias("_full"), names(F.col("validity") == "partial", F.lit(0)).alias("partial"), names(F.col("raw").isNull(), -F.round("coverage", 6)).alias("unscored"))
    return out.select(*KEYS, F.nullif(F.substring_index("_full", ",", 1), F.lit("")).alias("best"), F.when(F.instr("_full", ",") > 0, F.expr("substring(_full, instr(_full, ',') + 1)")).otherwise(F.lit("")).alias("others"), "partial", "unscored")


def player_profile(spark: SparkSession, d: str) -> DataFrame:
    """One row of everything: minutes and bands, scores with thin ones withheld, best role, counts of strong and weak metrics."""
    wide = scoring.with_scores(with_best(scored_wide(spark, d)), SCORES)
    count = lambda test: sum((F.coalesce(test(F.col(m)), F.lit(False)).cast("int") for m in NAMES), F.lit(0))
    cover = R.coverage_band(R.coverage("recorded_minutes", "minutes"))
    return wide.select(*KEYS, "minutes", R.sample_band("minutes").alias("sample_band"), cover.alias("coverage_band"), *[F.when(F.col("minutes") >= 180, F.round(f"score:{s.name}", 6)).alias(s.name) for s in SCORES], count(lambda c: c >= 70).alias("strong"), count(lambda c: c <= 40).alias("weak"), F.col("best.role").alias("best"))


def comparison_caveats(spark: SparkSession, d: str) -> DataFrame:
    """Of the five rows of most minutes in each season: whether they mix groups or competitions."""
    w = Window.partitionBy("season_id").orderBy(F.desc("minutes"), "entity_key", "competition_id")
    five = stats(spark, d).withColumn("_r", F.row_number().over(w)).where("_r <= 5")
    return five.groupBy("season_id").agg(F.count("*").alias("compared"), (F.count_distinct("peer_group") > 1).alias("mixed_groups"), (F.count_distinct("competition_id") > 1).alias("mixed_competitions"))


def score_distributions(spark: SparkSession, d: str) -> DataFrame:
    """Percentiles, scores and full role scores: how many are known, their spread and the share of 90 and more."""
    ranked = written(ranked_wide(spark, d), "ranked")
    wide = scoring.with_scores(ranked, SCORES)
    made = wide.select("peer_group", *[F.col(m).alias(f"percentile:{m}") for m in NAMES], *[F.col(f"`score:{s.name}`") for s in SCORES])
    long = unpivot(made, ["peer_group"], [c for c in made.columns[1:]]).select("peer_group", F.col("metric").alias("name"), "value")
    roles = _roles(ranked).select("peer_group", F.concat(F.lit("role:"), "role").alias("name"), F.when(F.col("validity") == "full", F.col("raw")).alias("value"))
    every = written(long.union(roles), "distributions")
    found = percentile.quantiles(every, ["peer_group", "name"], {"middle": 0.5})
    top = every.groupBy("peer_group", "name").agg((F.count_if(F.col("value") >= 90) / F.nullif(F.count("value"), F.lit(0))).alias("top_share"))
    return found.join(top, ["peer_group", "name"]).select("peer_group", "name", "known", *[F.round(c, 6).alias(c) for c in ("least", "middle", "most", "top_share")])


def similarity_stability(spark: SparkSession, d: str, spread: float = 0.03, top: int = 10) -> DataFrame:
    """Per target: the Jaccard similarity of its nearest ``top`` before and after all percentiles are jittered by normal
    noise of ``spread`` that is hashed from row and metric."""
    rows = written(ranked_wide(spark, d).where("is_primary"), "ranked")
    text = lambda m, salt: F.concat_ws(":", "entity_key", "season_id", F.lit(m), F.lit(salt)).cast("binary")
    unit = lambda m, salt: (F.conv(F.substring(F.md5(text(m, salt)), 1, 10), 16, 10).cast("double") + 0.5) / float(1 << 40)
    noise = lambda m: F.sqrt(-2 * F.log(unit(m, 1))) * F.cos(2 * F.pi() * unit(m, 2))
    moved = rows.select(*[c for c in rows.columns if c not in NAMES], *[R.clamp(F.col(m) * (1 + spread * noise(m))).alias(m) for m in NAMES])
    by = ["peer_group", "season_id", "target"]
    w = Window.partitionBy(*by).orderBy(F.desc(F.round("ranked", 6)), "entity_key")
    near = lambda df: similarity.similar(df, _targets(df), ["peer_group", "season_id"], "entity_key", NAMES, "minutes").withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= top)
    both = near(rows).select(*by, "entity_key", F.lit(1).alias("_a")).join(near(moved).select(*by, "entity_key", F.lit(1).alias("_b")), [*by, "entity_key"], "full")
    return both.groupBy(*by).agg(F.round(F.count_if(F.col("_a").isNotNull() & F.col("_b").isNotNull()) / F.count("*"), 6).alias("jaccard"))


def source_purge(spark: SparkSession, d: str) -> DataFrame:
    customer, orders = tables(spark, d, "customer", "orders")
    bridge = orders.select(F.col("o_custkey").alias("c_custkey"), "o_orderpriority")
    return lifecycle.purge(customer, bridge, "c_custkey", "o_orderpriority", "5-LOW").select("c_custkey", "c_mktsegment")


def ownership_checks(spark: SparkSession, d: str) -> DataFrame:
    customer, orders, lines = tables(spark, d, "customer", "orders", "lineitem")
    bridge = orders.select(F.col("o_orderpriority").alias("source"), F.col("o_orderkey").alias("source_id"), F.col("o_custkey").alias("entity_id"), "o_orderstatus")
    return lifecycle.ownership(customer.select(F.col("c_custkey").alias("entity_id")), bridge, lines.select(F.col("l_orderkey").alias("source_id")), ["1-URGENT", "2-HIGH", "9-NONE"], F.col("o_orderstatus") == "P")


def context_checks(spark: SparkSession, d: str) -> DataFrame:
    lines, orders, customer, supplier = tables(spark, d, "lineitem", "orders", "customer", "supplier")
    rows = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).join(customer, F.col("o_custkey") == F.col("c_custkey")).join(supplier, F.col("l_suppkey") == F.col("s_suppkey"))
    return lifecycle.contexts(rows.select("l_suppkey", "c_nationkey", "s_nationkey", F.to_date("l_shipdate").alias("ends")), "l_suppkey", "c_nationkey", "s_nationkey", "ends", F.lit(TODAY))


def publication_ledger(spark: SparkSession, d: str) -> DataFrame:
    """Later events published onto the earlier ones' ledger; user and type are the refresh they belong to."""
    (events,) = tables(spark, d, "events")
    one = lambda df: df.groupBy("user_id", "event_type").agg(F.min("event_id").alias("event_id"))
    cut = F.col("ts") < F.lit("2024-01-10").cast("timestamp")
    return lifecycle.publish(one(events.where(cut)), events.where(~cut).select("user_id", "event_type", "event_id"), ["user_id", "event_type"], "event_id")


def staging_equality(spark: SparkSession, d: str) -> DataFrame:
    """A reloaded copy of the orders, which is equal, and two candidates that aren't: one with a changed price, one with a row twice."""
    (orders,) = tables(spark, d, "orders")
    odd = F.col("o_orderkey") == F.lit(orders.agg(F.min("o_orderkey")).first()[0])
    reloaded = written(orders.orderBy("o_totalprice"), "orders")
    changed = orders.withColumn("o_totalprice", F.when(odd, F.col("o_totalprice") + 1).otherwise(F.col("o_totalprice")))
    twice = orders.union(orders.where(odd))
    parts = [lifecycle.same_rows(x, orders, orders.columns).select(F.lit(n).alias("candidate"), "*") for n, x in (("reloaded", reloaded), ("changed", changed), ("twice", twice))]
    return parts[0].union(parts[1]).union(parts[2])


def provider_status(spark: SparkSession, d: str) -> DataFrame:
    known = spark.createDataFrame([("click",), ("silent",)], "source string")
    out = lifecycle.provider_status(_ledger(spark, d), known, "source", "at", "status", "context")
    return out.select("source", *[F.date_format(c, "yyyy-MM-dd HH:mm").alias(c) for c in ("published", "loaded", "attempted")], "failed")


def volumes(spark: SparkSession, d: str) -> DataFrame:
    """Rows of each table, and how many entities have a value and a value with a fact."""
    customer, orders = tables(spark, d, "customer", "orders")
    one = lambda df, name: df.agg(F.count("*").alias("n_rows")).select(F.lit(name).alias("entity"), "n_rows")
    valued = customer.where("c_acctbal >= 0")
    parts = [one(df, n) for df, n in zip(tables(spark, d, "supplier", "part", "lineitem"), ("supplier", "part", "lineitem"), strict=True)]
    parts += [one(customer, "customer"), one(orders, "orders"), one(valued, "valued"), one(valued.join(orders, F.col("c_custkey") == F.col("o_custkey"), "left_semi"), "served")]
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out


def name_resolution(spark: SparkSession, d: str) -> DataFrame:
    """Names that a definition asks for against the kinds and keys of the events."""
    (events,) = tables(spark, d, "events")
    paths = events.select(F.explode(F.map_keys(F.from_json("props", "map<string,string>"))).alias("key"), "event_type").select(F.concat("event_type", F.lit(".count_"), "key").alias("path")).distinct()
    names = spark.createDataFrame([("count_k",), ("view_count",), ("minutes",)], "name string")
    return lifecycle.resolve_names(paths, names)


def weight_report(spark: SparkSession, d: str) -> DataFrame:
    return lifecycle.supplied_weights(derive(stats(spark, d), METRICS), SCORES, ROLES)


def metric_census(spark: SparkSession, d: str) -> DataFrame:
    return lifecycle.census(stats(spark, d), METRICS, ["attempts", "returns"])


def check_report(spark: SparkSession, d: str) -> DataFrame:
    """The loader's checks as lines of a Markdown table."""
    checks = loader_checks(spark, d)
    return lifecycle.markdown_head(spark, checks.columns).union(lifecycle.markdown(checks))


def club_countries(spark: SparkSession, d: str) -> DataFrame:
    """Clubs with the country of the competition that they belong to; a club of no known competition keeps nulls."""
    supplier, nation, region = tables(spark, d, "supplier", "nation", "region")
    places = nation.where("n_nationkey % 7 <> 0").join(region, F.col("n_regionkey") == F.col("r_regionkey"), "left")
    return supplier.join(places, F.col("s_nationkey") == F.col("n_nationkey"), "left").select("s_suppkey", F.col("n_name").alias("competition"), F.col("r_name").alias("country"))


def canonical_records(spark: SparkSession, d: str) -> DataFrame:
    """Totals with what is derived when a record is built: differences that don't fall below 0, sums; unknown parts stay unknown."""
    return stats(spark, d).select(*KEYS, R.nonnegative_difference("attempts", "returns").alias("unreturned"), R.nonnegative_difference("minutes", "recorded_minutes").alias("unrecorded"), (F.col("successes") + F.col("returns")).alias("taken"))


def similar_filtered(spark: SparkSession, d: str, top: int = 10) -> DataFrame:
    """What is like each target in another competition, within a budget and with enough recorded minutes."""
    rows = written(ranked_wide(spark, d).where("is_primary"), "ranked")
    allow = similarity.allowed(value_max=8000, other_competition=True, recorded_min=120)
    out = similarity.similar(rows, _targets(rows), ["peer_group", "season_id"], "entity_key", NAMES, "minutes", carry=["competition_id", "market_value", "recorded_minutes"], allow=allow)
    w = Window.partitionBy("peer_group", "season_id", "target").orderBy(F.desc(F.round("ranked", 6)), "entity_key")
    out = out.withColumn("place", F.row_number().over(w)).where(F.col("place") <= top)
    return out.select("peer_group", "season_id", "target", "place", "entity_key", "shared", "band", F.round("index", 6).alias("index"), F.round("ranked", 6).alias("ranked"))


def repointed_orders(spark: SparkSession, d: str) -> DataFrame:
    """Orders whose customers are merged where no merge is refused, counted by who holds them then."""
    (orders,) = tables(spark, d, "orders")
    merged = identity_merges(spark, d)
    return identity.repoint(orders.select("o_custkey", "o_orderkey"), merged, "o_custkey").groupBy("o_custkey").agg(F.count("*").alias("n_orders"))


def identity_evaluation(spark: SparkSession, d: str) -> DataFrame:
    """Precision and recall of the decisions if each customer's right order were the first one of a confidence of at least .95."""
    (orders,) = tables(spark, d, "orders")
    sure = orders.where((F.floor("o_totalprice") % 200 + 800) / 1000 >= 0.95)
    truth = sure.groupBy(F.col("o_custkey").alias("left_id")).agg(F.min("o_orderkey").alias("true_id"))
    out = identity.evaluate(identity_decisions(spark, d), truth)
    return out.select("found", "right", F.round("precision", 6).alias("precision"), F.round("recall", 6).alias("recall"))


QUERIES = {f.__name__: f for f in (
    widest_contexts, player_summary, player_stats, player_roles, player_profile, comparison_caveats, score_distributions, similarity_stability, source_purge, ownership_checks,
    context_checks, publication_ledger, staging_equality, provider_status, volumes, name_resolution, weight_report, metric_census, check_report, club_countries,
    canonical_records, similar_filtered, repointed_orders, identity_evaluation,
)}
