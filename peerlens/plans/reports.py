"""Reports on what is served: profiles of a dataset, coverage checks, lists against the current view, presets that the data can
measure, reference lists and the checks of all parts together; each with the same in SQL."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import rates as R
from ..operators import derived, lifecycle, lists, percentile, presets, quality, scoring, similarity
from ..operators.metrics import coverage_by_group, derive, unpivot
from ..sources.shared import written
from ..sources.writers import csv_document
from ..spec import FeatureSets
from . import oracles as O
from .definitions import CATALOGUE, CATALOGUE_NAMES, ROUTING, _LINE_STATS, _METRICS, _MIXED, line_stats
from .fixture import GROUPS, KEYS, METRICS, NAMES, ROLES, SCORES, population, stats, tables
from .queries import _roles, ranked_wide


def _all(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


# --- profiles and checks --------------------------------------------------------------------------------------------------------


def dataset_profile(spark: SparkSession, d: str) -> DataFrame:
    """Per group: rows of each sample band, least, middle and most of the recorded share, middle and 99th percentile of each rate."""
    rows = written(derive(stats(spark, d), METRICS), "rates").withColumn("recorded_share", R.ratio("recorded_minutes", "minutes"))
    long = unpivot(rows, ["peer_group"], ["recorded_share", *NAMES])
    spread = percentile.quantiles(long, ["peer_group", "metric"], {"middle": 0.5, "high": 0.99})
    spread = spread.select("peer_group", F.col("metric").alias("name"), "known", *[F.round(c, 6).alias(c) for c in ("least", "middle", "high", "most")])
    bands = rows.groupBy("peer_group", R.sample_band("minutes").alias("band")).agg(F.count("*").alias("known"))
    none = F.lit(None).cast("double")
    return spread.unionByName(bands.select("peer_group", F.concat(F.lit("band:"), "band").alias("name"), "known", *[none.alias(c) for c in ("least", "middle", "high", "most")]))


def _check(name: str, bad: Column, severity: str, count: Column, detail: Column) -> Column:
    return F.struct(F.lit("season_stats").alias("entity"), F.lit(name).alias("check_name"), F.when(bad, severity).otherwise("pass").alias("status"), count.cast("long").alias("record_count"), detail.alias("detail"))


def coverage_checks(rows: DataFrame, metrics: list[str], group: str, minutes: str, least: float = 0.80) -> DataFrame:
    """(entity, check_name, status, record_count, detail): whether rows have minutes, which metrics are absent or sparse, and which
    scores and roles cannot be made without the absent ones. One aggregation; no rows at all are a failure."""
    share = coverage_by_group(rows, [minutes, *metrics], group).where(F.col(group).isNull())
    one = lambda status: F.array_join(F.sort_array(F.collect_list(F.when((F.col("status") == status) & (F.col("metric") != minutes), F.col("metric")))), ",")
    told = share.agg(F.max("rows").alias("n"), F.max(F.when(F.col("metric") == minutes, F.col("known"))).alias("minutes"), one("absent").alias("absent"), one("sparse").alias("sparse"))
    size = lambda c: F.when(F.col(c) == "", 0).otherwise(F.size(F.split(c, ",")))
    gone = F.split("absent", ",")
    dead: dict[str, Column] = {}
    for d in (*SCORES, *ROLES):
        lost = reduce(lambda a, b: a + b, [F.when(dead.get(c, F.array_contains(gone, c)), F.lit(float(w))).otherwise(F.lit(0.0)) for c, w in d.weights.items()])
        total = float(sum(d.weights.values()))
        dead[f"score:{d.name}" if d in SCORES else f"role:{d.name}"] = total - lost < d.min_coverage * total - 1e-9
    disabled = F.array_join(F.array_compact(F.array(*[F.when(x, F.lit(n)) for n, x in sorted(dead.items())])), ",")
    told = told.withColumn("disabled", disabled).withColumn("n", F.coalesce("n", F.lit(0)))
    checks = F.array(
        _check("has_rows", F.col("n") == 0, "fail", F.col("n"), F.lit("")), _check("minutes_coverage", F.col("minutes") < least * F.col("n"), "fail", F.col("minutes"), F.lit("")),
        _check("metrics_absent", F.col("absent") != "", "warn", size("absent"), F.col("absent")), _check("features_disabled", F.col("disabled") != "", "warn", size("disabled"), F.col("disabled")),
        _check("metrics_sparse", F.col("sparse") != "", "warn", size("sparse"), F.col("sparse")),
    )
    return told.select(F.explode(checks).alias("c")).select("c.*")


def coverage_report(spark: SparkSession, d: str) -> DataFrame:
    """The checks for a source that has no returns, and recorded minutes for one group only."""
    rows = stats(spark, d).withColumn("returns", F.lit(None).cast("long")).withColumn("headline", F.when(F.col("peer_group") == "BUILDING", F.col("headline")))
    return coverage_checks(derive(rows, METRICS), NAMES, "peer_group", "minutes")


def integrity_report(spark: SparkSession, d: str) -> DataFrame:
    """Counts of rows that no group is known for, of facts without a dimension and dimensions without facts, of keys that come twice,
    and of competitions that made-up rows share with real ones."""
    customers, orders, lines = tables(spark, d, "customer", "orders", "lineitem")
    known = customers.withColumn("segment", F.when(F.col("c_custkey") % 19 != 0, F.col("c_mktsegment")))
    demo = orders.where("o_orderkey % 1000 = 7").select("o_orderpriority").distinct()
    real = orders.where("o_orderkey % 1000 <> 7").select("o_orderpriority").distinct()
    one = lambda df, name: df.agg(F.lit(name).alias("check_name"), F.count("*").alias("record_count"))
    return _all([
        one(known.where("segment IS NULL"), "unmapped"), one(quality.orphans(orders, "o_custkey", known.where("segment IS NOT NULL"), "c_custkey"), "fact without group"),
        one(quality.orphans(customers.select(F.col("c_custkey").alias("k")), "k", orders.select(F.col("o_custkey").alias("k")), "k"), "entity without fact"),
        one(quality.duplicates(lines, ["l_orderkey", "l_linenumber"]), "duplicate key"), one(demo.intersect(real), "demo mixed with real"),
    ])


def universe(spark: SparkSession, d: str) -> DataFrame:
    """What a reader of the universe gets and leaves out: entities that have a fact, facts whose entity is known, and the rest."""
    customers, orders = tables(spark, d, "customer", "orders")
    dimension = customers.where("c_custkey % 23 <> 0").select(F.col("c_custkey").alias("entity_id"), F.when(F.col("c_custkey") % 19 != 0, F.col("c_mktsegment")).alias("peer_group"))
    facts = orders.select(F.col("o_custkey").alias("entity_id"), "o_orderkey")
    read = lifecycle.universe(dimension, facts, "entity_id", "peer_group")
    return read.groupBy("state").agg(F.count("*").alias("n_rows"), F.count_distinct("entity_id").alias("entities"))


def bridged_entities(spark: SparkSession, d: str) -> DataFrame:
    """Links of one source to entities that are known, with the entity's club, which may be unknown."""
    orders, customers, nations = tables(spark, d, "orders", "customer", "nation")
    bridge = orders.where("o_orderpriority = '1-URGENT'").select("o_orderkey", F.col("o_custkey").alias("c_custkey"))
    clubs = nations.where("n_nationkey % 5 <> 0").select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_name").alias("club"))
    return bridge.join(customers.where("c_acctbal >= 0"), "c_custkey").join(clubs, "c_nationkey", "left").select("o_orderkey", "c_custkey", "c_mktsegment", "club")


# --- lists ----------------------------------------------------------------------------------------------------------------------


def _entries(spark: SparkSession, d: str) -> DataFrame:
    """Three lists of customers with notes, in the order in which they were added."""
    (customers,) = tables(spark, d, "customer")
    key = F.col("c_custkey")
    return customers.where("c_custkey % 50 < 3").select((key % 50).cast("int").alias("list_id"), key.alias("entity_key"), F.when(key % 2 == 0, F.concat(F.lit("note "), key.cast("string"))).alias("note"), (key * 7 % 1000).alias("place"))


def _view(spark: SparkSession, d: str) -> DataFrame:
    """The served row of each entity: its primary row of the last season, where that has 300 minutes and more."""
    rows = population(spark, d).where("is_primary")
    last = Window.partitionBy("entity_key").orderBy(F.desc("season_id"))
    return rows.withColumn("_r", F.row_number().over(last)).where("_r = 1 AND minutes >= 300").select("entity_key", "peer_group", "competition_id", "season_id", "minutes")


def listed_entries(spark: SparkSession, d: str) -> DataFrame:
    """Every entry of the lists with what is served for it now; those that aren't served stay and are marked."""
    return lists.resolved(_entries(spark, d), _view(spark, d), "entity_key")


def compared_entries(spark: SparkSession, d: str) -> DataFrame:
    """What may be compared if some entries are asked for: of one list too many, of another ones that it doesn't hold."""
    entries = _entries(spark, d)
    first = Window.partitionBy("list_id").orderBy("place", "entity_key")
    asked = entries.withColumn("_r", F.row_number().over(first)).where("(list_id = 0 AND _r <= 7) OR (list_id > 0 AND _r <= 3)").select("list_id", "entity_key")
    stranger = entries.where("list_id = 1").agg(F.lit(2).alias("list_id"), F.min("entity_key").alias("entity_key"))
    return lists.compared(entries, _view(spark, d), "entity_key", ["list_id"], asked.unionByName(stranger)).select("list_id", "entity_key", "refused", "peer_group", "minutes")


# --- definitions against the data ---------------------------------------------------------------------------------------------


def preset_availability(spark: SparkSession, d: str) -> DataFrame:
    """Each role's preset of score weights, and how much of it can be measured where a source has no returns."""
    rows = derive(stats(spark, d).withColumn("returns", F.lit(None).cast("long")), METRICS)
    made = [(r.name, s, w) for r in ROLES for s, w in (presets.preset(r, SCORES) or {}).items()]
    weights = F.broadcast(spark.createDataFrame(made, "role string, score string, weight int"))
    found = scoring.unproducible(rows, SCORES).join(weights, "score")
    return presets.measured(found, "role", "score", "weight", "producible")


def raw_best_roles(spark: SparkSession, d: str) -> DataFrame:
    """Each row's roles by raw score alone, where scores aren't ranked within a competition: the best and how many come after it."""
    long = _roles(written(ranked_wide(spark, d), "ranked")).withColumn("fit", F.lit(None).cast("double"))
    best = scoring.best_role(long, KEYS).select(*KEYS, "role", F.round("standing", 6).alias("standing"))
    more = long.where("validity = 'full'").groupBy(*KEYS).agg((F.count("*") - 1).alias("others"))
    return best.join(more, KEYS)


#: Which metrics each group is compared by.
FEATURES = FeatureSets({
    "AUTOMOBILE": ("attempts_per90", "successes_per90", "headline_per90", "large_per90", "small_per90", "success_share", "conversion", "discount_share", "taxed_per90", "dear_per90", "unreturned_per90"),
    "BUILDING": ("attempts_per90", "returns_per90", "closed_per90", "opened_per90", "cheap_per90", "return_share", "large_share", "tax_share"),
    "FURNITURE": ("attempts_per90", "successes_per90", "headline_per90", "large_per90", "success_share", "conversion", "handling", "untouched_share"),
    "HOUSEHOLD": ("attempts_per90", "returns_per90", "handled_per90", "marked_per90", "unsmall_per90", "size_quality"),
    "MACHINERY": ("closed_per90", "opened_per90", "cheap_per90", "dear_per90", "headline_per_order", "tax_share", "discount_share"),
}, frozenset(CATALOGUE_NAMES), frozenset(GROUPS))


def group_similarity(spark: SparkSession, d: str, top: int = 5) -> DataFrame:
    """What is most like the row of most minutes in each group and season, each group by its own metrics."""
    rows = derived.derive(line_stats(spark, d), CATALOGUE, ROUTING)
    rows = percentile.primary(rows, ["entity_key", "season_id"], "minutes", ["competition_id"]).where("is_primary")
    used = sorted({m for own in FEATURES.groups.values() for m in own})
    compared = lambda m: F.when(F.col("peer_group").isin(*[g for g, own in FEATURES.groups.items() if m in own]), F.col(m)).alias(m)
    rows = written(rows.select("entity_key", "peer_group", "season_id", "minutes", *[compared(m) for m in used]).withColumn("_row", F.monotonically_increasing_id()), "numbered")
    ranks = percentile.mid_ranks(rows, "_row", ["peer_group", "season_id"], used)
    wide = written(ranks.select("entity_key", "peer_group", "season_id", "minutes", *[F.col(f"`{m}:rank`").alias(m) for m in used]), "ranked")
    first = Window.partitionBy("peer_group", "season_id").orderBy(F.desc("minutes"), "entity_key")
    parts = []
    for group, features in FEATURES.groups.items():
        own = wide.where(F.col("peer_group") == group)
        targets = own.withColumn("_r", F.row_number().over(first)).where("_r = 1").drop("_r")
        parts.append(similarity.similar(own, targets, ["peer_group", "season_id"], "entity_key", list(features), "minutes").drop("gaps"))
    place = Window.partitionBy("peer_group", "season_id", "target").orderBy(F.desc(F.round("ranked", 6)), "entity_key")
    out = _all(parts).withColumn("place", F.row_number().over(place)).where(F.col("place") <= top)
    return out.select("peer_group", "season_id", "target", "place", "entity_key", "shared", "band", F.round("index", 6).alias("index"), F.round("ranked", 6).alias("ranked"))


def reference_catalogue(spark: SparkSession, d: str) -> DataFrame:
    """What can be asked for: competitions, seasons and groups with the rows that there are, roles with those that they are open to,
    and bands with those that are in them."""
    rows = stats(spark, d)
    held = rows.select("competition_id", "season_id", "peer_group", R.sample_band("minutes").alias("band"))
    counted = [held.groupBy(F.lit(kind).alias("kind"), F.col(c).alias("name")).agg(F.count("*").alias("n_rows")) for kind, c in (("competition", "competition_id"), ("season", "season_id"), ("group", "peer_group"), ("band", "band"))]
    roles = held.select(F.explode(F.array_compact(F.array(*[F.when(F.col("peer_group").isin(*r.groups), F.lit(r.name)) for r in ROLES]))).alias("name"))
    return _all([*counted, roles.groupBy(F.lit("role").alias("kind"), "name").agg(F.count("*").alias("n_rows"))])


def exported_document(spark: SparkSession, d: str) -> DataFrame:
    """The lines of a CSV file of the lists, in order: a head after a byte order mark, every field quoted."""
    return csv_document(listed_entries(spark, d).select("list_id", "place", "entity_key", "note", "peer_group", "minutes", "state"), ["list_id", "place", "entity_key"])


def quality_report(spark: SparkSession, d: str) -> DataFrame:
    """The checks of all parts, with how many passed, warned and failed."""
    from .composites import context_checks, ownership_checks
    from .queries import loader_checks

    parts = [(name, df.select("status")) for name, df in (("load", loader_checks(spark, d)), ("ownership", ownership_checks(spark, d)), ("context", context_checks(spark, d)), ("coverage", coverage_report(spark, d)))]
    one = lambda name, df: df.agg(F.lit(name).alias("part"), F.count("*").alias("checks"), *[F.count_if(F.col("status") == s).alias(s) for s in ("pass", "warn", "fail")])
    out = _all([one(n, df) for n, df in parts])
    return out.withColumn("worst", F.when(F.col("fail") > 0, "fail").when(F.col("warn") > 0, "warn").otherwise("pass"))


QUERIES = {f.__name__: f for f in (
    dataset_profile, coverage_report, integrity_report, universe, bridged_entities, listed_entries, compared_entries, preset_availability, raw_best_roles, group_similarity, reference_catalogue, exported_document, quality_report,
)}

# --- the same in SQL ------------------------------------------------------------------------------------------------------------

_BAND = O.BAND.format(v="minutes", null="'very_low'", a=900, x="full", b=450, y="limited", c=180, z="low", rest="very_low")
_SPREAD = "SELECT peer_group, '{n}' AS name, count({v}) AS known, round(min({v}), 6) AS least, round(median({v}), 6) AS middle, round(quantile_cont({v}, 0.99), 6) AS high, round(max({v}), 6) AS most FROM rates GROUP BY peer_group"
_VIEW = "view AS (SELECT entity_key, peer_group, competition_id, season_id, minutes FROM (SELECT *, row_number() OVER (PARTITION BY entity_key ORDER BY season_id DESC) AS rn FROM population WHERE is_primary) WHERE rn = 1 AND minutes >= 300)"
_ENTRIES = "entries AS (SELECT (c_custkey % 50)::INT AS list_id, c_custkey AS entity_key, CASE WHEN c_custkey % 2 = 0 THEN 'note ' || c_custkey END AS note, c_custkey * 7 % 1000 AS place FROM customer WHERE c_custkey % 50 < 3)"
_LISTED = O.base(_VIEW, _ENTRIES).rstrip() + ", listed AS (SELECT e.entity_key, e.list_id, e.note, e.place, v.peer_group, v.competition_id, v.season_id, v.minutes, CASE WHEN v.entity_key IS NULL THEN 'missing' ELSE 'ok' END AS state FROM entries e LEFT JOIN view v ON e.entity_key = v.entity_key)"


def _cell(c: str) -> str:
    return f"'\"' || replace(coalesce(CASE WHEN regexp_matches({c}::VARCHAR, '^[=+\\-@\\t\\r]') THEN '''' || {c}::VARCHAR ELSE {c}::VARCHAR END, ''), '\"', '\"\"') || '\"'"


def _group_similar(group: str, features: tuple[str, ...]) -> str:
    n = len(features)
    least = similarity.required(n)
    both = lambda f: f"(c.{f} IS NOT NULL AND t.{f} IS NOT NULL)"
    part = lambda a, b: " + ".join(f"CASE WHEN {both(f)} THEN ({a}.{f} - 50.0::DOUBLE) * ({b}.{f} - 50.0::DOUBLE) ELSE 0.0::DOUBLE END" for f in features)
    own = " + ".join(f"(t.{f} IS NOT NULL)::INT" for f in features)
    return f"""SELECT c.peer_group, c.season_id, t.entity_key AS target, c.entity_key, c.minutes, {' + '.join(f'{both(f)}::INT' for f in features)} AS shared, {n} AS expected, {part('c', 't')} AS dot, sqrt({part('t', 't')}) AS nt, sqrt({part('c', 'c')}) AS nc
  FROM wide c JOIN tops t ON c.peer_group = t.peer_group AND c.season_id = t.season_id AND c.entity_key <> t.entity_key WHERE c.peer_group = '{group}' AND ({own}) >= 5 AND ({' + '.join(f'{both(f)}::INT' for f in features)}) >= {least}"""


_USED = sorted({m for own in FEATURES.groups.values() for m in own})
_GROUP_SIMILAR = f"""WITH {_LINE_STATS}, {_MIXED.format(of='line_stats')}, {_METRICS},
mains AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY entity_key, season_id ORDER BY coalesce(minutes, 0) DESC, competition_id DESC) AS rn FROM metrics) WHERE rn = 1),
wide AS (SELECT entity_key, peer_group, season_id, minutes, {', '.join(f"CASE WHEN {m} IS NOT NULL THEN 100.0::DOUBLE * (2 * count({m}) OVER (PARTITION BY peer_group, season_id ORDER BY {m} NULLS LAST RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - count({m}) OVER (PARTITION BY peer_group, season_id, {m})) / (2 * count({m}) OVER (PARTITION BY peer_group, season_id)) END AS {m}" for m in _USED)} FROM mains),
tops AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY peer_group, season_id ORDER BY minutes DESC, entity_key) AS rn FROM wide) WHERE rn = 1),
compared AS ({' UNION ALL '.join(_group_similar(g, f) for g, f in FEATURES.groups.items())}),
alike AS (SELECT *, greatest(0.0::DOUBLE, least(1.0::DOUBLE, CASE WHEN nt > 0 AND nc > 0 THEN dot / (nt * nc) ELSE 0.0::DOUBLE END)) * 100.0::DOUBLE AS index FROM compared),
{O.shrink('index', 'peer_group, season_id, target', 'alike', 'drawn')}
SELECT peer_group, season_id, target, place::INT AS place, entity_key, shared, band, round(index, 6) AS index, round(ranked_value, 6) AS ranked FROM (
  SELECT *, row_number() OVER (PARTITION BY peer_group, season_id, target ORDER BY round(ranked_value, 6) DESC, entity_key) AS place, CASE WHEN shared::DOUBLE / expected >= 0.85 THEN 'high' WHEN shared::DOUBLE / expected >= 0.65 THEN 'good' WHEN shared::DOUBLE / expected >= 0.5 THEN 'limited' ELSE 'very limited' END AS band FROM drawn WHERE index >= 50.0
) WHERE place <= 5"""

_COVERAGE = f"""WITH {O.STATS.format(competition='o_orderpriority')}, lacking AS (SELECT * REPLACE (NULL::BIGINT AS returns, CASE WHEN peer_group = 'BUILDING' THEN headline END AS headline) FROM stats),
{O.RATES.replace('FROM stats)', 'FROM lacking)')}, shares AS (""" + " UNION ALL ".join(f"SELECT '{n}' AS metric, count(*) AS n, count({n}) AS k FROM rates" for n in NAMES) + """),
told AS (SELECT max(n) AS n, coalesce(string_agg(metric, ',' ORDER BY metric) FILTER (k = 0), '') AS absent, coalesce(string_agg(metric, ',' ORDER BY metric) FILTER (k > 0 AND k::DOUBLE / n < 0.5), '') AS sparse FROM shares),
checks AS (
  SELECT 'has_rows' AS check_name, CASE WHEN n = 0 THEN 'fail' ELSE 'pass' END AS status, n AS record_count, '' AS detail FROM told
  UNION ALL SELECT 'minutes_coverage', CASE WHEN (SELECT count(minutes) FROM rates) < 0.8 * n THEN 'fail' ELSE 'pass' END, (SELECT count(minutes) FROM rates), '' FROM told
  UNION ALL SELECT 'metrics_absent', CASE WHEN absent <> '' THEN 'warn' ELSE 'pass' END, CASE WHEN absent = '' THEN 0 ELSE len(string_split(absent, ',')) END, absent FROM told
  UNION ALL SELECT 'features_disabled', CASE WHEN gone <> '' THEN 'warn' ELSE 'pass' END, CASE WHEN gone = '' THEN 0 ELSE len(string_split(gone, ',')) END, gone FROM (
    SELECT coalesce(string_agg(name, ',' ORDER BY name) FILTER (lost), '') AS gone FROM (
      SELECT 'score:volume' AS name, contains(absent, 'attempts_per90') OR contains(absent, 'headline_per90') AS lost FROM told
      UNION ALL SELECT 'score:finish', contains(absent, 'success_percentage') OR contains(absent, 'successes_per90') FROM told
      UNION ALL SELECT 'score:security', contains(absent, 'returns_per90') AND contains(absent, 'success_percentage') FROM told
      UNION ALL SELECT 'role:runner', 2 * contains(absent, 'attempts_per90')::INT + contains(absent, 'headline_per90')::INT + contains(absent, 'discounted_per90')::INT > 2 FROM told
      UNION ALL SELECT 'role:finisher', 2 * contains(absent, 'success_percentage')::INT + (contains(absent, 'success_percentage') OR contains(absent, 'successes_per90'))::INT + contains(absent, 'returns_per90')::INT > 2 FROM told
      UNION ALL SELECT 'role:keeper', 2 * (contains(absent, 'returns_per90') AND contains(absent, 'success_percentage'))::INT + contains(absent, 'attempts_per90')::INT > 1.5 FROM told))
  UNION ALL SELECT 'metrics_sparse', CASE WHEN sparse <> '' THEN 'warn' ELSE 'pass' END, CASE WHEN sparse = '' THEN 0 ELSE len(string_split(sparse, ',')) END, sparse FROM told
)"""


def _part(name: str, sql: str) -> str:
    return f"SELECT '{name}' AS part, count(*) AS checks, count(*) FILTER (status = 'pass') AS pass, count(*) FILTER (status = 'warn') AS warn, count(*) FILTER (status = 'fail') AS fail FROM ({sql})"


def _report() -> str:
    from .composite_oracles import ORACLES as composite

    parts = [("load", O.ORACLES["loader_checks"]), ("ownership", composite["ownership_checks"]), ("context", composite["context_checks"]), ("coverage", f"{_COVERAGE} SELECT status FROM checks")]
    return "SELECT *, CASE WHEN fail > 0 THEN 'fail' WHEN warn > 0 THEN 'warn' ELSE 'pass' END AS worst FROM (" + " UNION ALL ".join(_part(n, s) for n, s in parts) + ")"


_WEIGHTS = [(r.name, s, w) for r in ROLES for s, w in (presets.preset(r, SCORES) or {}).items()]
_DOCUMENT = ("list_id", "place", "entity_key", "note", "peer_group", "minutes", "state")
ORACLES = {
    "dataset_profile": f"WITH {O.STATS.format(competition='o_orderpriority')}, {O.RATES.replace('rates AS (', 'rates0 AS (')}, rates AS (SELECT *, CASE WHEN minutes > 0 THEN recorded_minutes::DOUBLE / minutes END AS recorded_share FROM rates0) "
    + " UNION ALL ".join(_SPREAD.format(n=n, v=n) for n in ("recorded_share", *NAMES)) + f" UNION ALL SELECT peer_group, 'band:' || {_BAND}, count(*), NULL, NULL, NULL, NULL FROM rates GROUP BY peer_group, {_BAND}",
    "coverage_report": f"{_COVERAGE} SELECT 'season_stats' AS entity, check_name, status, record_count::BIGINT AS record_count, detail FROM checks",
    "integrity_report": """SELECT 'unmapped' AS check_name, count(*) AS record_count FROM customer WHERE c_custkey % 19 = 0 OR c_mktsegment IS NULL
UNION ALL SELECT 'fact without group', count(*) FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 19 <> 0) UNION ALL SELECT 'entity without fact', count(*) FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)
UNION ALL SELECT 'duplicate key', count(*) FROM (SELECT 1 FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1) UNION ALL SELECT 'demo mixed with real', count(*) FROM (SELECT o_orderpriority FROM orders WHERE o_orderkey % 1000 = 7 INTERSECT SELECT o_orderpriority FROM orders WHERE o_orderkey % 1000 <> 7)""",
    "universe": """WITH dim AS (SELECT c_custkey AS id, CASE WHEN c_custkey % 19 <> 0 THEN c_mktsegment END AS g FROM customer WHERE c_custkey % 23 <> 0)
SELECT CASE WHEN id IS NULL THEN 'fact without entity' WHEN o_custkey IS NULL THEN 'entity without fact' WHEN g IS NULL THEN 'entity without group' ELSE 'read' END AS state, count(*) AS n_rows, count(DISTINCT coalesce(id, o_custkey)) AS entities FROM dim FULL JOIN orders ON id = o_custkey GROUP BY 1""",
    "bridged_entities": "SELECT o_orderkey, c_custkey, c_mktsegment, n_name AS club FROM orders JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey AND n_nationkey % 5 <> 0 WHERE o_orderpriority = '1-URGENT' AND c_acctbal >= 0",
    "listed_entries": f"{_LISTED} SELECT * FROM listed",
    "compared_entries": f"""{_LISTED}, asked AS (SELECT list_id, entity_key FROM (SELECT *, row_number() OVER (PARTITION BY list_id ORDER BY place, entity_key) AS rn FROM entries) WHERE (list_id = 0 AND rn <= 7) OR (list_id > 0 AND rn <= 3) UNION SELECT 2, min(entity_key) FROM entries WHERE list_id = 1)
SELECT a.list_id, a.entity_key, CASE WHEN (SELECT count(*) FROM asked b WHERE b.list_id = a.list_id) > 5 THEN 'too many' WHEN l.entity_key IS NULL THEN 'not listed' WHEN v.entity_key IS NULL THEN 'missing' END AS refused, v.peer_group, v.minutes
FROM asked a LEFT JOIN listed l ON a.list_id = l.list_id AND a.entity_key = l.entity_key LEFT JOIN view v ON a.entity_key = v.entity_key""",
    "preset_availability": f"""WITH {O.STATS.format(competition='o_orderpriority')}, {O.RATES}, weights(role, score, weight) AS (VALUES {', '.join(f"('{r}', '{s}', {w})" for r, s, w in _WEIGHTS)}),
can AS (SELECT 'volume' AS score, count(attempts_per90) > 0 AND count(headline_per90) > 0 AS ok FROM rates UNION ALL SELECT 'finish', count(success_percentage) > 0 AND count(successes_per90) > 0 FROM rates UNION ALL SELECT 'security', count(success_percentage) > 0 FROM rates)
SELECT role, measurable, CASE WHEN measurable >= 1 THEN 'full' WHEN measurable < 0.55 THEN 'minimal' WHEN measurable < 0.85 THEN 'limited' ELSE 'full' END AS measurability, blocked, weights FROM (
  SELECT role, round(sum(weight) FILTER (ok)::DOUBLE / sum(weight), 9) AS measurable, coalesce(string_agg(score, ',' ORDER BY score) FILTER (NOT ok), '') AS blocked, string_agg(score || ':' || weight, ',' ORDER BY weight DESC, score) AS weights FROM weights JOIN can USING (score) GROUP BY role)""",
    "raw_best_roles": O.base(O.WIDE, O.ROLES).rstrip()
    + f", full_roles AS (SELECT *, row_number() OVER (PARTITION BY {O.K} ORDER BY raw DESC, role) AS rn, count(*) OVER (PARTITION BY {O.K}) - 1 AS others FROM roles WHERE validity = 'full') SELECT {O.K}, role, round(raw, 6) AS standing, others FROM full_roles WHERE rn = 1",
    "group_similarity": _GROUP_SIMILAR,
    "reference_catalogue": f"WITH {O.STATS.format(competition='o_orderpriority')} SELECT 'competition' AS kind, competition_id AS name, count(*) AS n_rows FROM stats GROUP BY 2 UNION ALL SELECT 'season', season_id, count(*) FROM stats GROUP BY 2 UNION ALL SELECT 'group', peer_group, count(*) FROM stats GROUP BY 2 UNION ALL SELECT 'band', {_BAND}, count(*) FROM stats GROUP BY 2 "
    + " ".join(f"UNION ALL SELECT 'role', '{r.name}', count(*) FROM stats WHERE peer_group IN ({', '.join(repr(g) for g in r.groups)})" for r in ROLES),
    "exported_document": f"""{_LISTED}, lined AS (SELECT row_number() OVER (ORDER BY list_id, place, entity_key) AS place_no, {" || ',' || ".join(_cell(c) for c in _DOCUMENT)} AS line FROM listed)
SELECT 0::BIGINT AS place, chr(65279) || '{','.join(f'"{c}"' for c in _DOCUMENT)}' AS line UNION ALL SELECT place_no, line FROM lined""",
    "quality_report": _report(),
}
