"""Queries over providers: tables written as a provider's snapshot folders and read through the data source, with the same in SQL
over the tables themselves."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.providers import PERFORMANCE, MarketProvider, PerformanceProvider, export
from ..sources.shared import fresh_folder
from .fixture import stats, tables


def _performance(spark: SparkSession, d: str) -> PerformanceProvider:
    """The totals as JSON lines, a folder for each competition."""
    path = fresh_folder(spark, "performance")
    totals = stats(spark, d).withColumn("player_id", F.col("entity_key").cast("string"))
    names = [x.split()[0] for x in PERFORMANCE["player_stats"].split(", ")]
    export(totals.select(*names), path, "player_stats", ["competition_id"], "json")
    return PerformanceProvider(spark, path)


def provider_stats(spark: SparkSession, d: str) -> DataFrame:
    """The totals of one competition and season from 300 minutes on; files of other competitions aren't opened."""
    return _performance(spark, d).competition_stats("2-HIGH", "1996").where(F.col("minutes") >= 300)


def provider_metrics(spark: SparkSession, d: str) -> DataFrame:
    """Which totals the provider supplies, and for how many rows."""
    return _performance(spark, d).info()


def _market(spark: SparkSession, d: str) -> MarketProvider:
    """Customers, their orders as values and as moves between clubs, and nations as competitions, as gzipped CSV. Some values are out
    of their range, some dates and fees unknown."""
    path = fresh_folder(spark, "market")
    orders, customers, nations, regions = tables(spark, d, "orders", "customer", "nation", "region")
    key, text = F.col("o_orderkey"), lambda c: F.col(c).cast("string")
    day = F.when(key % 11 != 0, F.to_date("o_orderdate"))
    export(nations.join(regions, F.col("n_regionkey") == F.col("r_regionkey")).select(text("n_nationkey").alias("competition_id"), F.col("n_name").alias("name"), F.col("r_name").alias("country")), path, "competitions")
    export(customers.select(F.concat(F.lit("k"), text("c_custkey")).alias("club_id"), F.col("c_name").alias("name"), F.when(F.col("c_custkey") % 6 != 0, text("c_nationkey")).alias("competition_id")), path, "clubs")
    players = customers.select(
        text("c_nationkey").alias("competition_id"), text("c_custkey").alias("player_id"), F.when(F.col("c_custkey") % 17 == 0, "Missing").otherwise(F.col("c_name")).alias("name"),
        F.date_add(F.lit("1980-01-01").cast("date"), (F.col("c_custkey") % 5000).cast("int")).alias("born"), (F.col("c_custkey") % 240).cast("int").alias("height"), F.lit("left").alias("foot"), F.floor("c_acctbal").alias("market_value"),
    )
    export(players, path, "players", ["competition_id"])
    export(orders.select(text("o_custkey").alias("player_id"), day.alias("valued_on"), F.when(key % 13 != 0, F.floor("o_totalprice") - 9000).alias("amount"), F.concat(F.lit("k"), (key % 50).cast("string")).alias("club_id")), path, "values")
    export(orders.select(text("o_custkey").alias("player_id"), day.alias("moved_on"), F.concat(F.lit("k"), (key % 50).cast("string")).alias("from_club"), F.concat(F.lit("k"), key.cast("string")).alias("to_club"), F.when(key % 3 != 0, key % 5).alias("fee")), path, "transfers")
    return MarketProvider(spark, path)


def market_clubs(spark: SparkSession, d: str) -> DataFrame:
    """Clubs with the country of their competition."""
    return _market(spark, d).clubs().select("club_id", "name", "competition_id", "country")


def market_players(spark: SparkSession, d: str) -> DataFrame:
    """Players of one competition; heights and values out of their range are unknown."""
    return _market(spark, d).players("7").select("player_id", "name", F.date_format("born", "yyyy-MM-dd").alias("born"), "height", "market_value")


def market_values(spark: SparkSession, d: str) -> DataFrame:
    """How many values each player has, the oldest one and the newest one's amount."""
    history = _market(spark, d).value_history()
    return history.groupBy("player_id").agg(F.count("*").alias("n_values"), F.date_format(F.min("valued_on"), "yyyy-MM-dd").alias("first_on"), F.max_by("amount", "place").alias("latest"))


def market_transfers(spark: SparkSession, d: str) -> DataFrame:
    """Each player's moves from the oldest; a fee of 0 isn't an unknown one."""
    return _market(spark, d).transfers().select("player_id", "place", F.date_format("moved_on", "yyyy-MM-dd").alias("moved_on"), "from_club", "to_club", "fee")


def market_issues(spark: SparkSession, d: str) -> DataFrame:
    """Values that were taken for mistakes, by field and reason."""
    return _market(spark, d).issues().groupBy("entity", "field", "reason").agg(F.count("*").alias("issues"), F.min("raw_value").alias("least_raw"))


QUERIES = {f.__name__: f for f in (provider_stats, provider_metrics, market_clubs, market_players, market_values, market_transfers, market_issues)}

_STATS = """WITH totals AS (
  SELECT c_custkey::VARCHAR AS player_id, o_orderpriority AS competition_id, year(o_orderdate)::VARCHAR AS season_id, floor(6 * sum(l_quantity))::INT AS minutes, floor(6 * sum(l_quantity) FILTER (l_linestatus = 'F'))::INT AS recorded_minutes,
    count(DISTINCT o_orderkey) AS appearances, count(*) AS attempts, count(*) FILTER (l_returnflag = 'A') AS successes, count(*) FILTER (l_returnflag = 'R') AS returns, count(*) FILTER (l_discount > 0.05::DOUBLE) AS discounted, count(*) FILTER (l_returnflag = 'N') AS headline
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey GROUP BY c_custkey, o_orderpriority, year(o_orderdate)
)"""
_METRICS = ("minutes", "recorded_minutes", "appearances", "attempts", "successes", "returns", "discounted", "headline")
_ISSUES = """SELECT entity, field, reason, count(*) AS issues, min(raw_value) AS least_raw FROM (
  SELECT 'players' AS entity, 'height' AS field, 'not between 140 and 220' AS reason, (c_custkey % 240)::VARCHAR AS raw_value FROM customer WHERE NOT (c_custkey % 240 BETWEEN 140 AND 220)
  UNION ALL SELECT 'players', 'market_value', 'under 0', floor(c_acctbal)::BIGINT::VARCHAR FROM customer WHERE floor(c_acctbal) < 0
  UNION ALL SELECT 'values', 'amount', 'under 0', (floor(o_totalprice) - 9000)::BIGINT::VARCHAR FROM orders WHERE o_orderkey % 13 <> 0 AND floor(o_totalprice) - 9000 < 0
) GROUP BY ALL"""

ORACLES = {
    "provider_stats": f"{_STATS} SELECT * FROM totals WHERE competition_id = '2-HIGH' AND season_id = '1996' AND minutes >= 300",
    "provider_metrics": f"{_STATS} " + " UNION ALL ".join(f"SELECT '{m}' AS metric, count({m}) AS known FROM totals" for m in _METRICS),
    "market_clubs": "SELECT 'k' || c_custkey AS club_id, c_name AS name, n_nationkey::VARCHAR AS competition_id, r_name AS country FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey AND c_custkey % 6 <> 0 LEFT JOIN region ON n_regionkey = r_regionkey",
    "market_players": "SELECT c_custkey::VARCHAR AS player_id, CASE WHEN c_custkey % 17 <> 0 THEN c_name END AS name, strftime(DATE '1980-01-01' + (c_custkey % 5000)::INT, '%Y-%m-%d') AS born, CASE WHEN c_custkey % 240 BETWEEN 140 AND 220 THEN c_custkey % 240 END::INT AS height, CASE WHEN floor(c_acctbal) >= 0 THEN floor(c_acctbal) END::BIGINT AS market_value FROM customer WHERE c_nationkey = 7",
    "market_values": "SELECT o_custkey::VARCHAR AS player_id, count(*) AS n_values, strftime(min(o_orderdate), '%Y-%m-%d') AS first_on, arg_max(amount, (day, amount)) AS latest FROM (SELECT *, o_orderdate::DATE AS day, (floor(o_totalprice) - 9000)::BIGINT AS amount FROM orders WHERE o_orderkey % 11 <> 0 AND o_orderkey % 13 <> 0) WHERE amount >= 0 GROUP BY 1",
    "market_transfers": "SELECT o_custkey::VARCHAR AS player_id, row_number() OVER (PARTITION BY o_custkey ORDER BY CASE WHEN o_orderkey % 11 <> 0 THEN o_orderdate::DATE END NULLS LAST, 'k' || o_orderkey)::INT AS place, CASE WHEN o_orderkey % 11 <> 0 THEN strftime(o_orderdate, '%Y-%m-%d') END AS moved_on, 'k' || (o_orderkey % 50) AS from_club, 'k' || o_orderkey AS to_club, CASE WHEN o_orderkey % 3 <> 0 THEN o_orderkey % 5 END AS fee FROM orders",
    "market_issues": _ISSUES,
}
