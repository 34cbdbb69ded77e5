"""Providers: read-only access to one source's tables under declared schemas, over snapshot folders.

A performance provider tells of competitions, seasons, clubs, players and their totals; a market provider of clubs, players, values
and transfers. Both are batch reads. What is asked of one competition, season or player is a filter that the data source takes, so
that files of other competitions aren't opened. ``build`` selects a provider by mode and raises where its snapshot is missing,
rather than serving another one.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .folders import FORMAT, files_of, register

TOTALS = "minutes int, recorded_minutes int, appearances long, attempts long, successes long, returns long, discounted long, headline long"
PERFORMANCE = {
    "competitions": "competition_id string, name string, country string",
    "seasons": "competition_id string, season_id string, start_year int",
    "clubs": "competition_id string, season_id string, club_id string, name string",
    "players": "competition_id string, season_id string, player_id string, name string, born date, peer_group string",
    "player_stats": f"competition_id string, season_id string, player_id string, {TOTALS}",
}
MARKET = {
    "competitions": "competition_id string, name string, country string",
    "clubs": "club_id string, name string, competition_id string",
    "players": "competition_id string, player_id string, name string, born date, height int, foot string, market_value long",
    "values": "player_id string, valued_on date, amount long, club_id string",
    "transfers": "player_id string, moved_on date, from_club string, to_club string, fee long",
}


class Provider:
    """The tables below ``path``, a folder each, under ``schemas``; ``paths`` maps columns of a table to places in its records."""

    schemas: Mapping[str, str] = {}

    def __init__(self, spark: SparkSession, path: str, paths: Mapping[str, Mapping[str, str]] | None = None, kind: str | None = None) -> None:
        register(spark)
        self.spark, self.path, self.paths, self.kind = spark, path.rstrip("/"), paths or {}, kind

    def _reader(self, table: str, reader):  # noqa: ANN001, ANN202
        if table not in self.schemas:
            raise ValueError(f"no table {table}; there are {sorted(self.schemas)}")
        reader = reader.format(FORMAT).schema(self.schemas[table]).option("path", f"{self.path}/{table}").option("paths", json.dumps(dict(self.paths.get(table, {}))))
        return reader.option("kind", self.kind) if self.kind else reader

    def table(self, table: str) -> DataFrame:
        return self._reader(table, self.spark.read).load()

    def stream(self, table: str) -> DataFrame:
        """The same rows as they come, file by file."""
        return self._reader(table, self.spark.readStream).load()

    def asked(self, table: str, **keys: object) -> DataFrame:
        """The rows whose columns have the values that aren't None."""
        df = self.table(table)
        for c, v in keys.items():
            df = df if v is None else df.where(F.col(c) == F.lit(v))
        return df

    def health(self) -> tuple[bool, str | None]:
        """Whether each table has a file, and if not which lack one."""
        lacking = []
        for table in self.schemas:
            try:
                if not files_of(f"{self.path}/{table}"):
                    lacking.append(table)
            except ValueError:
                lacking.append(table)
        return not lacking, f"no files of {', '.join(lacking)}" if lacking else None


class PerformanceProvider(Provider):
    schemas = PERFORMANCE

    def info(self) -> DataFrame:
        """(metric, known): the totals and how many rows have them, so that what is absent switches a feature off."""
        metrics = [x.split()[0] for x in TOTALS.split(", ")]
        row = self.table("player_stats").agg(*[F.count(m).alias(m) for m in metrics])
        return row.unpivot([], metrics, "metric", "known")

    def competitions(self) -> DataFrame:
        return self.table("competitions")

    def seasons(self, competition: str | None = None) -> DataFrame:
        return self.asked("seasons", competition_id=competition)

    def clubs(self, competition: str | None = None, season: str | None = None) -> DataFrame:
        return self.asked("clubs", competition_id=competition, season_id=season)

    def players(self, competition: str | None = None, season: str | None = None) -> DataFrame:
        return self.asked("players", competition_id=competition, season_id=season)

    def player_stats(self, player: str, season: str | None = None) -> DataFrame:
        return self.asked("player_stats", player_id=player, season_id=season)

    def competition_stats(self, competition: str | None = None, season: str | None = None) -> DataFrame:
        return self.asked("player_stats", competition_id=competition, season_id=season)


#: Ranges outside which a value is taken for a mistake and is unknown: (table, column, least, most).
RANGES = (("players", "height", 140, 220), ("players", "market_value", 0, None), ("values", "amount", 0, None), ("transfers", "fee", 0, None))


class MarketProvider(Provider):
    schemas = MARKET
    ranges: Sequence[tuple[str, str, int | None, int | None]] = RANGES

    def _bad(self, column: str, low: int | None, high: int | None) -> Column:
        bounds = [F.col(column) < low] * (low is not None) + [F.col(column) > high] * (high is not None)
        return F.coalesce(reduce(lambda a, b: a | b, bounds), F.lit(False))

    def _clean(self, df: DataFrame, table: str) -> DataFrame:
        own = {c: F.when(~self._bad(c, low, high), F.col(c)) for t, c, low, high in self.ranges if t == table}
        return df.withColumns(own) if own else df

    def competitions(self) -> DataFrame:
        return self.table("competitions")

    def clubs(self) -> DataFrame:
        """Clubs with the country of the competition they belong to, which may be unknown."""
        return self.table("clubs").join(self.competitions().select("competition_id", "country"), "competition_id", "left")

    def players(self, competition: str | None = None) -> DataFrame:
        return self._clean(self.asked("players", competition_id=competition), "players")

    def value_history(self, player: str | None = None) -> DataFrame:
        """Values with a date and an amount; ``place`` counts a player's from the oldest."""
        return self._ordered(self._clean(self.asked("values", player_id=player), "values").where("valued_on IS NOT NULL AND amount IS NOT NULL"), "valued_on", "amount")

    def transfers(self, player: str | None = None) -> DataFrame:
        """Moves; ``place`` counts a player's from the oldest, undated ones last. A fee of 0 isn't an unknown one."""
        return self._ordered(self._clean(self.asked("transfers", player_id=player), "transfers"), "moved_on", "to_club")

    def _ordered(self, df: DataFrame, at: str, tie: str) -> DataFrame:
        from pyspark.sql import Window

        return df.withColumn("place", F.row_number().over(Window.partitionBy("player_id").orderBy(F.asc_nulls_last(at), tie)))

    def issues(self) -> DataFrame:
        """(entity, entity_id, field, raw_value, reason) of the values that were taken for mistakes."""
        key = {"players": "player_id", "values": "player_id", "transfers": "player_id"}
        parts = []
        for table, c, low, high in self.ranges:
            reason = F.lit(f"not between {low} and {high}" if high is not None else f"under {low}")
            parts.append(self.table(table).where(self._bad(c, low, high)).select(F.lit(table).alias("entity"), F.col(key[table]).alias("entity_id"), F.lit(c).alias("field"), F.col(c).cast("string").alias("raw_value"), reason.alias("reason")))
        return reduce(DataFrame.unionByName, parts)


PROVIDERS: dict[str, Callable[..., Provider]] = {"performance": PerformanceProvider, "market": MarketProvider}


def build(spark: SparkSession, kind: str, mode: str, folders: Mapping[str, str], **options: object) -> Provider:
    """The provider of ``kind`` over the folder of ``mode``. A mode without a folder, or with a folder that lacks a table, is an
    error: another mode's data never stands in for it."""
    if kind not in PROVIDERS:
        raise ValueError(f"unknown provider {kind}; there are {sorted(PROVIDERS)}")
    if mode not in folders:
        raise ValueError(f"no folder is configured for mode {mode}")
    made = PROVIDERS[kind](spark, folders[mode], **options)
    ok, why = made.health()
    if not ok:
        raise ValueError(f"{kind} provider of mode {mode}: {why}")
    return made


def export(df: DataFrame, path: str, table: str, by: Sequence[str] = (), layout: str = "csv") -> None:
    """``df`` as a provider's table: CSV with a header or JSON lines, gzipped, in a folder for each value of ``by``."""
    writer = df.write.mode("overwrite").option("compression", "gzip")
    writer = writer.partitionBy(*by) if by else writer
    if layout == "csv":
        writer.option("header", True).option("escape", '"').option("emptyValue", "").csv(f"{path}/{table}")
    else:
        writer.json(f"{path}/{table}")
