"""Queries over declared definitions: a catalogue of derived metrics, what came out of it, nested records, properties of similarity,
search in all its orders, and readings; each with the same in SQL."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import rates as R
from ..operators import coverage, derived, profiler, reading, scoring, search, similarity
from ..operators.metrics import unpivot
from ..sources.shared import written
from ..spec import Derived, Role, Routing, Score
from . import oracles as O
from .fixture import KEYS, NAMES, ROLES, SCORES, customers_orders, population, stats, tables
from .queries import TODAY, ranked_wide, scored_rows, scored_wide, with_best

# --- a catalogue of 43 metrics over 27 totals ---------------------------------------------------------------------------------

#: Totals as counts of lines, in a form that Spark and DuckDB both read.
FLAGS = {"successes": "l_returnflag = 'A'", "returns": "l_returnflag = 'R'", "headline": "l_returnflag = 'N'"}
KINDS = {"discounted": "l_discount > CAST(0.05 AS DOUBLE)", "taxed": "l_tax > CAST(0.04 AS DOUBLE)", "large": "l_quantity > 25", "small": "l_quantity <= 10", "dear": "l_extendedprice > 50000"}
LINES = {"attempts": "l_quantity IS NOT NULL", **FLAGS, **KINDS, "closed": "l_linestatus = 'F'", "opened": "l_linestatus = 'O'", "cheap": "l_extendedprice < 10000", **{f"{a}_{b}": f"{x} AND {y}" for a, x in FLAGS.items() for b, y in KINDS.items()}}
MADE = [
    Derived("unreturned", "floored_difference", ("attempts", "returns"), shown=False),
    Derived("handled", "sum", ("successes", "returns"), shown=False),
    Derived("untouched", "floored_difference", ("attempts", "handled"), shown=False),
    Derived("marked", "sum", ("discounted", "taxed", "dear"), shown=False),
    Derived("unsmall", "difference", ("attempts", "small"), shown=False),
]
CATALOGUE = [
    *MADE,
    *[Derived(f"{t}_per90", "per90", (t,), lower_is_better=t.startswith("returns")) for t in (*LINES, *[m.name for m in MADE])],
    Derived("success_share", "percentage", ("successes", "attempts")),
    Derived("conversion", "percentage", ("successes", "unreturned")),
    Derived("size_quality", "ratio", ("successes_large", "unreturned")),
    Derived("handling", "percentage", ("successes", "handled")),
    Derived("return_share", "percentage", ("returns", "attempts"), lower_is_better=True),
    Derived("large_share", "percentage", ("large", "unsmall")),
    Derived("discount_share", "percentage", ("discounted", "marked")),
    Derived("tax_share", "percentage", ("taxed", "marked")),
    Derived("dear_return_share", "percentage", ("returns_dear", "returns")),
    Derived("headline_per_order", "percentage", ("headline", "appearances")),
    Derived("untouched_share", "percentage", ("untouched", "attempts")),
]
CATALOGUE_NAMES = [d.name for d in CATALOGUE if d.shown]
ROUTING = Routing(
    confirmed={f"{t}_per90": "playing" for t in ("headline", "closed", "opened")} | {f"{t}_per90": "recorded" for t in ("attempts", "successes", "returns", "discounted", "taxed", "large", "small", "dear", "cheap")},
    inferred={"unreturned_per90": "playing", "handled_per90": "recorded"},
)


def line_stats(spark: SparkSession, d: str) -> DataFrame:
    """Totals like ``stats``, of all kinds of lines, which are added up by order first."""
    sums = [F.sum("l_quantity").alias("minutes"), F.sum(F.when(F.col("l_linestatus") == "F", F.col("l_quantity"))).alias("recorded_minutes"), *[F.count_if(F.expr(test)).alias(name) for name, test in LINES.items()]]
    joined = customers_orders(spark, d, sums, ["o_orderpriority"], ["c_mktsegment"])
    total = lambda c: F.sum(F.col(c) * F.col("_alike"))
    return joined.groupBy(F.col("c_custkey").alias("entity_key"), F.col("c_mktsegment").alias("peer_group"), F.col("o_orderpriority").alias("competition_id"), F.col("_year").cast("string").alias("season_id")).agg(
        F.floor(6 * total("minutes")).cast("int").alias("minutes"), F.floor(6 * total("recorded_minutes")).cast("int").alias("recorded_minutes"),
        F.count("*").alias("appearances"), *[total(name).alias(name) for name in LINES],
    )


def derived_catalogue(spark: SparkSession, d: str) -> DataFrame:
    """All metrics of the catalogue, in one projection over the totals."""
    return derived.derive(line_stats(spark, d), CATALOGUE, ROUTING).select(*KEYS, *CATALOGUE_NAMES)


def _supplied(rows: DataFrame) -> DataFrame:
    """What a source supplies that has no dear returns at all, and taxed lines of one group only."""
    return rows.withColumn("returns_dear", F.lit(None).cast("long")).withColumn("taxed", F.when(F.col("peer_group") == "BUILDING", F.col("taxed")))


def derived_metric_coverage(spark: SparkSession, d: str) -> DataFrame:
    """How often each metric came out for rows of 450 minutes and more, its best group, and for rates their minutes and evidence."""
    rows = _supplied(line_stats(spark, d)).where(R.can_rate("minutes", 450))
    made_of = derived.inputs(CATALOGUE, rows.columns)
    out = coverage.derived_coverage(derived.derive(rows, CATALOGUE, ROUTING), CATALOGUE_NAMES, "peer_group", {m: made_of[m] for m in CATALOGUE_NAMES})
    routes = F.broadcast(spark.createDataFrame(derived.routes(CATALOGUE, ROUTING), "metric string, denominator string, evidence string"))
    return out.withColumn("best_coverage", F.round("best_coverage", 9)).join(routes, "metric", "left")


MORE_SCORES = [*SCORES, Score("retention", {"returns_per90": 2.0, "success_percentage": 1.0})]
MORE_ROLES = [*ROLES, Role("stayer", ("BUILDING", "MACHINERY"), {"score:retention": 2.0, "attempts_per90": 1.0}), Role("all_round", ("AUTOMOBILE", "FURNITURE"), {"score:retention": 1.0, "attempts_per90": 2.0, "score:volume": 1.0})]


def feature_coverage(spark: SparkSession, d: str) -> DataFrame:
    """What scores and roles come to if a source supplies no returns: which are withheld, caveated or available, and why."""
    rows = ranked_wide(spark, d, population(spark, d).withColumn("returns_per90", F.lit(None).cast("double"))).where(R.can_rate("minutes", 450))
    out = coverage.feature_coverage(scoring.with_scores(rows, MORE_SCORES), "peer_group", MORE_SCORES, MORE_ROLES, NAMES)
    return out.withColumn("surviving", F.round("surviving", 9))


def rate_eligibility(spark: SparkSession, d: str) -> DataFrame:
    """Rows by season key with how many can be rated, at all and from 450 minutes on, and how many rest on too few attempts."""
    rows = stats(spark, d)
    key = R.season_key(F.when(F.col("season_id").cast("int") % 2 == 0, F.col("season_id").cast("int")), F.concat(F.lit("s"), F.col("season_id")))
    thin = R.evidence(F.when(F.col("attempts") > 2, F.col("attempts")), 6)
    return rows.groupBy(key.alias("season_key")).agg(F.count("*").alias("n_rows"), F.count_if(R.can_rate("recorded_minutes")).alias("rated"), F.count_if(R.can_rate("minutes", 450)).alias("established"), F.count_if(F.coalesce(thin, F.lit(False))).alias("thin"), F.count(thin).alias("counted"))


# --- nested records -------------------------------------------------------------------------------------------------------------


def nested_fields(spark: SparkSession, d: str) -> DataFrame:
    """The profile of orders as nested records: objects in objects, lists, fields of several types, of nulls alone, and absent ones."""
    orders, lines, customers = tables(spark, d, "orders", "lineitem", "customer")
    held = lines.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("n"))
    joined = orders.join(customers, F.col("o_custkey") == F.col("c_custkey")).join(held, "o_orderkey", "left")
    key, text = F.col("o_orderkey"), lambda c: F.concat(F.lit('"'), c, F.lit('"'))
    balance = F.when(F.col("c_acctbal") >= 0, F.floor("c_acctbal").cast("string")).otherwise(F.lit("null"))
    mixed = F.when(key % 4 == 0, "1").when(key % 4 == 1, '"x y"').when(key % 4 == 2, "null").otherwise("true")
    fields = [
        F.lit('{"order": {"id": '), key.cast("string"), F.lit(', "status": '), text(F.col("o_orderstatus")), F.lit(', "customer": {"segment": '), text(F.col("c_mktsegment")),
        F.lit(', "home": {"nation": '), F.col("c_nationkey").cast("string"), F.lit('}, "balance": '), balance, F.lit('}}, "lines": ['), F.array_join(F.array_repeat(F.lit("0"), F.coalesce("n", F.lit(0)).cast("int")), ","),
        F.lit('], "mixed": '), mixed, F.lit(', "rate": '), F.when(key % 3 == 0, "0.5").otherwise("2"), F.lit(', "never": null, "empty": {}, "note": '), F.when(key % 2 == 0, text(F.lit(""))).otherwise(text(F.concat(F.lit("n"), key.cast("string")))),
        F.when(key % 5 == 0, ', "seldom": -1').otherwise(""), F.lit("}"),
    ]
    records = joined.select(key.alias("key"), F.parse_json(F.concat(F.lit('{"data": ['), *fields, F.lit("]}"))).alias("payload"))
    each = records.select("key", F.explode(profiler.records_of(F.col("payload"))).alias("record"))
    out = profiler.nested_profile(each, "record", "key")
    return out.withColumn("null_share", F.round("null_share", 9))


# --- similarity -----------------------------------------------------------------------------------------------------------------

SATURATED = 99.0


def similarity_properties(spark: SparkSession, d: str, per_group: int = 4) -> DataFrame:
    """What must hold of similarity whatever the data say, with the cases checked and those that violate it: it stays in its group, is
    never of a row with itself, is the same in both directions, within 0 and 100, and tells rows apart. Checked for the
    ``per_group`` rows of most minutes of each group and season, against all rows; those compare with each other both ways."""
    rows = written(ranked_wide(spark, d).where("is_primary"), "ranked")
    w = Window.partitionBy("peer_group", "season_id").orderBy(F.desc("minutes"), "entity_key")
    targets = rows.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= per_group).drop("_r")
    pairs = written(similarity.similar(rows, targets, ["peer_group", "season_id"], "entity_key", NAMES, "minutes").select("peer_group", "season_id", "target", "entity_key", "index"), "pairs")
    return similarity.properties(pairs, rows.select("entity_key", "peer_group", "season_id"), ["peer_group", "season_id"], "entity_key", SATURATED)


# --- search and readings --------------------------------------------------------------------------------------------------------


def _profiles(spark: SparkSession, d: str, wide: DataFrame | None = None) -> DataFrame:
    """Primary rows of a season with attributes that follow from the customer, and the best role."""
    (customers,) = tables(spark, d, "customer")
    key = F.col("c_custkey")
    attributes = customers.select(
        key.alias("entity_key"), F.col("c_name").alias("name"), F.when(key % 13 != 0, 18 + key % 20).cast("int").alias("age"), F.when(key % 11 != 0, 160 + key % 40).cast("int").alias("height"),
        F.when(key % 7 != 0, F.when(key % 3 == 0, "left").otherwise("right")).alias("foot"), F.concat(F.lit("n"), F.col("c_nationkey").cast("string")).alias("nationality"),
        F.concat(F.lit("club"), (key % 40).cast("string")).alias("club_id"), F.when(key % 9 != 0, F.date_add(F.lit(TODAY), (key * 31 % 900 - 100).cast("int"))).alias("contract_expires"),
    )
    wide = scored_rows(spark, d) if wide is None else wide
    rows = with_best(wide).where("is_primary").withColumns({"role": F.col("best.role"), "role_score": F.col("best.raw")}).join(attributes, "entity_key")
    return rows.select(*KEYS, "minutes", "market_value", R.sample_band("minutes").alias("sample_band"), "role", F.round("role_score", 6).alias("role_score"), *[c for c in attributes.columns if c != "entity_key"])


def search_orders(spark: SparkSession, d: str, limit: int = 15) -> DataFrame:
    """The second page in each of the six orders, under filters."""
    profiles = written(_profiles(spark, d), "profiles")
    asked = {"age_min": 19, "age_max": 35, "minutes_min": 200, "height_min": 165, "value_min": 1, "value_max": 9500, "today": TODAY, "expires": 24}
    pages = [search.search(profiles, ["entity_key", "season_id"], s, limit, limit, **asked).select(F.lit(s).alias("sort"), "entity_key", "season_id", "minutes", "age", "role_score", (F.round("ranked", 6) if s == "role_score_ranked" else F.lit(None).cast("double")).alias("ranked")) for s in search.SORTS]
    out = pages[0]
    for p in pages[1:]:
        out = out.unionByName(p)
    return out


#: Each filter of the search alone, as a name and what is asked.
ALONE: list[tuple[str, dict]] = [
    ("all", {}), ("text", {"text": " 00012 "}), ("group", {"group": "BUILDING"}), ("competition", {"competition": "2-HIGH"}), ("club", {"club": "club7"}), ("nationality", {"nationality": "n3"}), ("foot", {"foot": "left"}), ("role", {"role": "runner"}),
    ("age_min", {"age_min": 30}), ("age_max", {"age_max": 21}), ("minutes", {"minutes_min": 1200}), ("band", {"sample_band": "low"}), ("value_min", {"value_min": 0}), ("value_max", {"value_max": 3000}), ("height", {"height_min": 190}), ("contract", {"expires": 6}),
]


def search_filters(spark: SparkSession, d: str) -> DataFrame:
    """How many rows each filter alone lets through, all counted in one pass over the profiles."""
    return search.counts(_profiles(spark, d), ALONE, TODAY)


def reading_bands(spark: SparkSession, d: str) -> DataFrame:
    """How many percentiles of each metric read as outstanding, strong, ordinary or very low; attempts are told for one group only."""
    long = unpivot(ranked_wide(spark, d), ["peer_group"], NAMES)
    kept = long.where(~reading.withheld(F.col("metric"), F.col("peer_group"), ["attempts_per90"], "BUILDING"))
    return kept.select("metric", F.coalesce(reading.reading(F.col("value")), F.lit("unknown")).alias("band")).groupBy("metric", "band").agg(F.count("*").alias("n"))


def similar_by_filter(spark: SparkSession, d: str) -> DataFrame:
    """For the target of each group and season: how many candidates each of the nine filters of similarity alone leaves."""
    wide = scored_wide(spark, d)
    rows = written(_profiles(spark, d, wide).join(wide.select(*KEYS, "recorded_minutes", *NAMES), KEYS), "profiles")
    w = Window.partitionBy("peer_group", "season_id").orderBy(F.desc("minutes"), "entity_key")
    targets = rows.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")
    carry = ["age", "market_value", "competition_id", "nationality", "club_id", "contract_expires", "recorded_minutes"]
    asked = {"age_min": {"age_min": 25}, "age_max": {"age_max": 25}, "value_max": {"value_max": 4000}, "competitions": {"competitions": ["1-URGENT", "5-LOW"]}, "nationalities": {"nationalities": ["n1", "n2", "n3"]}, "other_competition": {"other_competition": True}, "other_club": {"other_club": True}, "younger": {"younger": True}, "expires": {"expires": 12, "today": TODAY}, "recorded_min": {"recorded_min": 300}}
    pairs = similarity.similar(rows, targets, ["peer_group", "season_id"], "entity_key", NAMES, "minutes", carry=carry, keep=True)
    return pairs.groupBy("peer_group", "season_id", "target").agg(F.count("*").alias("similar_rows"), *[F.count_if(similarity.allowed(**a)).alias(name) for name, a in asked.items()])


QUERIES = {f.__name__: f for f in (derived_catalogue, derived_metric_coverage, feature_coverage, rate_eligibility, nested_fields, similarity_properties, search_orders, search_filters, reading_bands, similar_by_filter)}

# --- the same in SQL ------------------------------------------------------------------------------------------------------------

_LINE_STATS = """line_stats AS (
  SELECT c_custkey AS entity_key, c_mktsegment AS peer_group, o_orderpriority AS competition_id, CAST(year(o_orderdate) AS VARCHAR) AS season_id, CAST(floor(6 * sum(l_quantity)) AS INTEGER) AS minutes,
    CAST(floor(6 * sum(l_quantity) FILTER (WHERE l_linestatus = 'F')) AS INTEGER) AS recorded_minutes, count(DISTINCT o_orderkey) AS appearances, {counts}
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey GROUP BY ALL
)""".format(counts=", ".join(f"count(*) FILTER (WHERE {test}) AS {name}" for name, test in LINES.items()))
_MIXED = """parts AS (
  SELECT *, coalesce(recorded_minutes, minutes) AS r, coalesce(minutes, recorded_minutes) AS p, CASE WHEN attempts IS NOT NULL AND returns IS NOT NULL THEN greatest(attempts - returns, 0) END AS unreturned,
    successes + returns AS handled, CASE WHEN attempts IS NOT NULL AND successes + returns IS NOT NULL THEN greatest(attempts - (successes + returns), 0) END AS untouched, discounted + taxed + dear AS marked, attempts - small AS unsmall FROM {of}
)"""
_PLAYING = ("headline", "closed", "opened", "unreturned")
_SHARES = {
    "success_share": ("successes", "attempts", 100), "conversion": ("successes", "unreturned", 100), "size_quality": ("successes_large", "unreturned", 1), "handling": ("successes", "handled", 100), "return_share": ("returns", "attempts", 100),
    "large_share": ("large", "unsmall", 100), "discount_share": ("discounted", "marked", 100), "tax_share": ("taxed", "marked", 100), "dear_return_share": ("returns_dear", "returns", 100), "headline_per_order": ("headline", "appearances", 100), "untouched_share": ("untouched", "attempts", 100),
}
_RATED = [*LINES, "unreturned", "handled", "untouched", "marked", "unsmall"]
_METRIC_SQL = {f"{t}_per90": f"CASE WHEN {m} > 0 THEN {t} * 90.0::DOUBLE / {m} END" for t in _RATED for m in ["p" if t in _PLAYING else "r"]} | {
    n: f"CASE WHEN {b} > 0 THEN {a}{' * 100.0::DOUBLE' if f == 100 else '::DOUBLE'} / {b} END" for n, (a, b, f) in _SHARES.items()
}
_METRICS = "metrics AS (SELECT *, " + ", ".join(f"{x} AS {n}" for n, x in _METRIC_SQL.items()) + " FROM parts)"
_LACKS = {n: "returns_dear" for n in ("returns_dear_per90", "dear_return_share")}
_EVIDENCE = {f"{t}_per90": ("playing" if t in _PLAYING else "recorded", "inferred" if t in ("unreturned", "handled") else "confirmed" if t in ("headline", "closed", "opened", "attempts", "successes", "returns", "discounted", "taxed", "large", "small", "dear", "cheap") else "default") for t in _RATED}


def _feature(kind: str, name: str, weights: dict[str, float], least: float, lacking: str, surviving: float, groups: str = "TRUE") -> str:
    have = " + ".join(f"CASE WHEN {c} IS NOT NULL THEN {w}::DOUBLE ELSE 0.0::DOUBLE END" for c, w in weights.items())
    total = sum(weights.values())
    made = f"({groups}) AND ({have}) > 0 AND ({have}) / {total}::DOUBLE >= {least}::DOUBLE"
    return f"SELECT '{kind}' AS kind, '{name}' AS name, count(*) FILTER ({groups}) AS eligible, count(*) FILTER ({made}) AS produced, count(*) FILTER ({made} AND ({have}) / {total}::DOUBLE < 1 - 1e-9) AS caveated, '{lacking}' AS absent_components, round({surviving}::DOUBLE, 9) AS surviving, {least}::DOUBLE AS needed FROM eligible_rows"


_FEATURES = " UNION ALL ".join([
    _feature("score", "volume", {"attempts_per90": 3.0, "headline_per90": 2.0}, 1.0, "", 1.0),
    _feature("score", "finish", {"success_percentage": 2.0, "successes_per90": 1.0}, 1.0, "", 1.0),
    _feature("score", "security", {"returns_per90": 1.0, "success_percentage": 1.0}, 0.5, "returns_per90", 0.5),
    _feature("score", "retention", {"returns_per90": 2.0, "success_percentage": 1.0}, 1.0, "returns_per90", 1 / 3),
    _feature("role", "runner", {"attempts_per90": 2.0, "headline_per90": 1.0, "discounted_per90": 1.0}, 0.5, "", 1.0, "peer_group IN ('AUTOMOBILE', 'MACHINERY', 'BUILDING')"),
    _feature("role", "finisher", {"success_percentage": 2.0, "finish": 1.0, "returns_per90": 1.0}, 0.5, "returns_per90", 0.75, "peer_group IN ('AUTOMOBILE', 'FURNITURE', 'HOUSEHOLD')"),
    _feature("role", "keeper", {"security": 2.0, "attempts_per90": 1.0}, 0.5, "", 1.0, "peer_group IN ('BUILDING', 'HOUSEHOLD', 'MACHINERY', 'FURNITURE')"),
    _feature("role", "stayer", {"retention": 2.0, "attempts_per90": 1.0}, 0.5, "score:retention", 1 / 3, "peer_group IN ('BUILDING', 'MACHINERY')"),
    _feature("role", "all_round", {"retention": 1.0, "attempts_per90": 2.0, "volume": 1.0}, 0.5, "score:retention", 0.75, "peer_group IN ('AUTOMOBILE', 'FURNITURE')"),
])


def _path(path: str, kind: str, text: str, number: str = "NULL::DOUBLE", where: str = "TRUE") -> str:
    return f"SELECT '{path}' AS path, o_orderkey AS key, {kind} AS kind, {text} AS text, {number} AS number FROM recs WHERE {where}"


_NESTED = " UNION ALL ".join([
    _path("order.id", "'int'", "o_orderkey::VARCHAR", "o_orderkey::DOUBLE"), _path("order.status", "'str'", "o_orderstatus"), _path("order.customer.segment", "'str'", "c_mktsegment"),
    _path("order.customer.home.nation", "'int'", "c_nationkey::VARCHAR", "c_nationkey::DOUBLE"), _path("order.customer.balance", "CASE WHEN c_acctbal >= 0 THEN 'int' ELSE 'null' END", "CASE WHEN c_acctbal >= 0 THEN floor(c_acctbal)::BIGINT::VARCHAR END", "CASE WHEN c_acctbal >= 0 THEN floor(c_acctbal) END"),
    _path("lines", "'list'", "'[' || n || ' items]'"), _path("mixed", "CASE o_orderkey % 4 WHEN 0 THEN 'int' WHEN 1 THEN 'str' WHEN 2 THEN 'null' ELSE 'bool' END", "CASE o_orderkey % 4 WHEN 0 THEN '1' WHEN 1 THEN 'x y' WHEN 2 THEN NULL ELSE 'true' END", "CASE o_orderkey % 4 WHEN 0 THEN 1.0::DOUBLE END"),
    _path("rate", "CASE WHEN o_orderkey % 3 = 0 THEN 'float' ELSE 'int' END", "CASE WHEN o_orderkey % 3 = 0 THEN '0.5' ELSE '2' END", "CASE WHEN o_orderkey % 3 = 0 THEN 0.5::DOUBLE ELSE 2.0::DOUBLE END"),
    _path("never", "'null'", "NULL::VARCHAR"), _path("note", "'str'", "CASE WHEN o_orderkey % 2 = 0 THEN '' ELSE 'n' || o_orderkey END"), _path("seldom", "'int'", "'-1'", "-1.0::DOUBLE", "o_orderkey % 5 = 0"),
])

_ATTRIBUTES = """attributes AS (
  SELECT c_custkey AS entity_key, c_name AS name, CASE WHEN c_custkey % 13 <> 0 THEN 18 + c_custkey % 20 END AS age, CASE WHEN c_custkey % 11 <> 0 THEN 160 + c_custkey % 40 END AS height,
    CASE WHEN c_custkey % 7 <> 0 THEN CASE WHEN c_custkey % 3 = 0 THEN 'left' ELSE 'right' END END AS foot, 'n' || c_nationkey AS nationality, 'club' || (c_custkey % 40) AS club_id,
    CASE WHEN c_custkey % 9 <> 0 THEN DATE '1998-03-01' + (c_custkey * 31 % 900 - 100)::INT END AS contract_expires FROM customer
), profiles AS (
  SELECT s.*, b.role, round(b.raw, 6) AS role_score, a.* EXCLUDE (entity_key), {band} AS sample_band
  FROM scored s LEFT JOIN best b ON s.entity_key = b.entity_key AND s.peer_group = b.peer_group AND s.competition_id = b.competition_id AND s.season_id = b.season_id JOIN attributes a ON s.entity_key = a.entity_key WHERE s.is_primary
)""".format(band=O.BAND.format(v="s.minutes", null="'very_low'", a=900, x="full", b=450, y="limited", c=180, z="low", rest="very_low"))
_MONTHS = "((year(contract_expires) - 1998) * 12 + month(contract_expires) - 3)"


def _expiring(n: int) -> str:
    return f"coalesce(contract_expires >= DATE '1998-03-01' AND {_MONTHS} <= {n}, false)"


_ORDERS = {"minutes": "coalesce(minutes, 0) DESC", "name": "lower(name)", "age": "coalesce(age, 999)", "market_value": "coalesce(market_value, 0) DESC", "role_score": "coalesce(role_score, 0) DESC", "role_score_ranked": "round(drawn, 9) DESC"}
_ALONE = {
    "all": "TRUE", "text": "contains(lower(name), '00012')", "group": "peer_group = 'BUILDING'", "competition": "competition_id = '2-HIGH'", "club": "club_id = 'club7'", "nationality": "nationality = 'n3'", "foot": "foot = 'left'", "role": "role = 'runner'",
    "age_min": "age >= 30", "age_max": "age <= 21", "minutes": "coalesce(minutes, 0) >= 1200", "band": "sample_band = 'low'", "value_min": "coalesce(market_value, 0) >= 0", "value_max": "market_value <= 3000", "height": "coalesce(height, 0) >= 190", "contract": _expiring(6),
}
_PROFILED = O.base(O.WIDE, O.ROLES, O.FITS, _ATTRIBUTES)

ORACLES = {
    "derived_catalogue": f"WITH {_LINE_STATS}, {_MIXED.format(of='line_stats')}, {_METRICS} SELECT entity_key, peer_group, competition_id, season_id, {', '.join(_METRIC_SQL)} FROM metrics",
    "derived_metric_coverage": f"WITH {_LINE_STATS}, supplied AS (SELECT * REPLACE (NULL::BIGINT AS returns_dear, CASE WHEN peer_group = 'BUILDING' THEN taxed END AS taxed) FROM line_stats WHERE minutes >= 450), {_MIXED.format(of='supplied')}, {_METRICS}, long AS ("
    + " UNION ALL ".join(f"SELECT '{n}' AS metric, peer_group, {n} AS value FROM metrics" for n in _METRIC_SQL)
    + """), by_group AS (SELECT metric, peer_group, count(*) AS n, count(value) AS k FROM long GROUP BY ALL),
bests AS (SELECT metric, peer_group AS best_group, k::DOUBLE / n AS share FROM (SELECT *, row_number() OVER (PARTITION BY metric ORDER BY k::DOUBLE / n DESC, peer_group) AS rn FROM by_group WHERE k > 0) WHERE rn = 1),
whole AS (SELECT metric, sum(n)::BIGINT AS eligible, sum(k)::BIGINT AS computed FROM by_group GROUP BY metric)
SELECT w.metric, eligible, computed, best_group, round(coalesce(share, 0.0::DOUBLE), 9) AS best_coverage,
  CASE WHEN eligible = 0 THEN 'unknown' WHEN computed = 0 THEN 'absent' WHEN greatest(computed::DOUBLE / eligible, coalesce(share, 0)) < 0.5 THEN 'sparse' WHEN greatest(computed::DOUBLE / eligible, coalesce(share, 0)) < 0.95 THEN 'partial' ELSE 'complete' END AS status,
  """
    + "CASE w.metric "
    + " ".join(f"WHEN '{n}' THEN '{t}'" for n, t in _LACKS.items())
    + " ELSE '' END AS absent_inputs, CASE w.metric "
    + " ".join(f"WHEN '{n}' THEN '{m}'" for n, (m, _) in _EVIDENCE.items())
    + " END AS denominator, CASE w.metric "
    + " ".join(f"WHEN '{n}' THEN '{e}'" for n, (_, e) in _EVIDENCE.items())
    + " END AS evidence FROM whole w LEFT JOIN bests b ON w.metric = b.metric",
    "feature_coverage": O.base(O.WIDE).replace("CASE WHEN r > 0 THEN returns * 90.0::DOUBLE / r END AS returns_per90", "NULL::DOUBLE AS returns_per90").rstrip()
    + f""", eligible_rows AS (SELECT *, CASE WHEN returns_per90 IS NOT NULL AND success_percentage IS NOT NULL THEN 1.0 END AS retention FROM scored WHERE minutes >= 450),
features AS ({_FEATURES}), told AS (SELECT *, CASE WHEN eligible = 0 THEN 'unknown' WHEN produced = 0 THEN 'withheld' WHEN caveated >= produced * 0.5 THEN 'caveated' ELSE 'available' END AS status FROM features)
SELECT *, CASE WHEN absent_components <> '' AND surviving < needed - 1e-9 THEN 'inputs' WHEN status = 'withheld' OR eligible = 0 OR produced < eligible * 0.5 THEN 'sample' WHEN absent_components <> '' THEN 'partial' ELSE '' END AS reason FROM told""",
    "rate_eligibility": f"""WITH {O.STATS.format(competition='o_orderpriority')}, marked AS (SELECT *, CASE WHEN attempts > 2 THEN attempts < 6 END AS thin_row FROM stats)
SELECT CASE WHEN season_id::INT % 2 = 0 THEN season_id ELSE 's' || season_id END AS season_key, count(*) AS n_rows, count(*) FILTER (recorded_minutes > 0) AS rated, count(*) FILTER (minutes > 0 AND minutes >= 450) AS established, count(*) FILTER (thin_row) AS thin, count(thin_row) AS counted FROM marked GROUP BY 1""",
    "nested_fields": f"""WITH recs AS (SELECT o_orderkey, o_orderstatus, c_mktsegment, c_nationkey, c_acctbal, coalesce(n, 0) AS n FROM orders JOIN customer ON o_custkey = c_custkey LEFT JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey),
leaves AS ({_NESTED})
SELECT path, coalesce(string_agg(DISTINCT kind, '|' ORDER BY kind) FILTER (kind <> 'null'), 'null') AS kinds, count(*) AS seen, count(*) FILTER (kind <> 'null') AS known, round(1.0::DOUBLE - count(*) FILTER (kind <> 'null')::DOUBLE / count(*), 9) AS null_share, min(number) AS least, max(number) AS most, arg_min(text, key) FILTER (kind <> 'null' AND text <> '') AS example
FROM leaves GROUP BY path""",
    "similarity_properties": O.base(O.WIDE, O.SIMILAR.replace("WHERE rn = 1", "WHERE rn <= 4")).rstrip()
    + """, found AS (SELECT peer_group, season_id, target, entity_key, index FROM similar_rows WHERE index >= 50.0),
both_ways AS (SELECT a.index AS x, b.index AS y FROM found a JOIN found b ON a.peer_group = b.peer_group AND a.season_id = b.season_id AND a.target = b.entity_key AND a.entity_key = b.target),
tops AS (SELECT peer_group, season_id, target, max(index) AS top FROM found GROUP BY ALL)
SELECT 'own group' AS property, count(*) AS checked, count(*) FILTER (NOT EXISTS (SELECT 1 FROM mains m WHERE m.entity_key = f.entity_key AND m.peer_group = f.peer_group AND m.season_id = f.season_id)) AS violations FROM found f
UNION ALL SELECT 'not itself', count(*), count(*) FILTER (target = entity_key) FROM found
UNION ALL SELECT 'both directions', count(*), count(*) FILTER (abs(x - y) > 1e-6) FROM both_ways
UNION ALL SELECT 'within bounds', count(*), count(*) FILTER (NOT (index BETWEEN 0 AND 100)) FROM found
UNION ALL SELECT 'tells apart', count(*), CASE WHEN count(*) FILTER (top >= 99.0) > 0.1 * count(*) THEN count(*) FILTER (top >= 99.0) ELSE 0 END FROM tops""",
    "search_orders": _PROFILED.rstrip()
    + f""", kept AS (SELECT * FROM profiles WHERE age >= 19 AND age <= 35 AND coalesce(minutes, 0) >= 200 AND coalesce(height, 0) >= 165 AND coalesce(market_value, 0) >= 1 AND market_value <= 9500 AND {_expiring(24)}),
scored_kept AS (SELECT *, coalesce(role_score, 0) AS v FROM kept),
pulled AS (SELECT *, mean + weight * (v - mean) AS drawn FROM (SELECT *, CASE WHEN count(*) OVER () > 1 THEN (sum(v) OVER () - v) / (count(*) OVER () - 1) ELSE v END AS mean, CASE WHEN minutes > 0 THEN least(1.0::DOUBLE, minutes / 900.0::DOUBLE) ELSE 0.0::DOUBLE END AS weight FROM scored_kept))
"""
    + " UNION ALL ".join(f"SELECT * FROM (SELECT '{s}' AS sort, entity_key, season_id, minutes, age::INT AS age, role_score, {'round(drawn, 6)' if s == 'role_score_ranked' else 'NULL::DOUBLE'} AS ranked FROM pulled ORDER BY {o}, entity_key, season_id LIMIT 15 OFFSET 15)" for s, o in _ORDERS.items()),
    "search_filters": _PROFILED.rstrip() + " " + " UNION ALL ".join(f"SELECT '{n}' AS filter, count(*) AS found FROM profiles WHERE {t}" for n, t in _ALONE.items()),
    "reading_bands": O.base(O.WIDE).rstrip()
    + ", told AS ("
    + " UNION ALL ".join(f"SELECT '{n}' AS metric, peer_group, {n} AS v FROM wide" for n in O.FEATURES)
    + ") SELECT metric, CASE WHEN v IS NULL THEN 'unknown' WHEN v >= 90 THEN 'outstanding' WHEN v >= 70 THEN 'strong' WHEN v <= 10 THEN 'very low' ELSE 'ordinary' END AS band, count(*) AS n FROM told WHERE NOT (metric = 'attempts_per90' AND peer_group <> 'BUILDING') GROUP BY ALL",
    "similar_by_filter": O.base(O.WIDE, O.ROLES, O.FITS, _ATTRIBUTES, O.SIMILAR).rstrip()
    + f""", both_sides AS (
  SELECT s.peer_group, s.season_id, s.target, c.age, c.market_value, c.competition_id, c.nationality, c.club_id, c.contract_expires, c.recorded_minutes, t.competition_id AS t_competition, t.club_id AS t_club, t.age AS t_age
  FROM similar_rows s JOIN profiles c ON s.entity_key = c.entity_key AND s.peer_group = c.peer_group AND s.season_id = c.season_id JOIN profiles t ON s.target = t.entity_key AND s.peer_group = t.peer_group AND s.season_id = t.season_id WHERE s.index >= 50.0
)
SELECT peer_group, season_id, target, count(*) AS similar_rows, count(*) FILTER (age IS NULL OR age >= 25) AS age_min, count(*) FILTER (age IS NULL OR age <= 25) AS age_max, count(*) FILTER (market_value <= 4000) AS value_max, count(*) FILTER (competition_id IN ('1-URGENT', '5-LOW')) AS competitions,
  count(*) FILTER (nationality IN ('n1', 'n2', 'n3')) AS nationalities, count(*) FILTER (competition_id <> t_competition) AS other_competition, count(*) FILTER (club_id <> t_club) AS other_club, count(*) FILTER (age IS NULL OR t_age IS NULL OR age < t_age) AS younger,
  count(*) FILTER ({_expiring(12)}) AS expires, count(*) FILTER (coalesce(recorded_minutes, 0) >= 300) AS recorded_min FROM both_sides GROUP BY ALL""",
}
