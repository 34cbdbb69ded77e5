"""Evaluation of matching against a shadow source: identities with the errors that a second source makes, whose right answers are known.

Every choice is a hash of the seed, the identity and what is chosen, so that a shadow is the same on any cluster and in SQL. A
shadow goes through the whole chain of blocking, scores and decisions, and the decisions are counted against the truth.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.rates import aliased, same
from ..sources.shared import apart, written
from .identity import MAX_BLOCK, compared, decide, kind_scores, named_kinds, normalised, pair_scores, same_club

SEED = 41
#: Letters that are taken for others: each of the first stands for the one below it.
TYPOS = ("iksc", "yczk")


@dataclass(frozen=True)
class Errors:
    """How often a shadow has each error. Of a name at most one: ``kept`` and what follows are shares of all names."""

    kept: float = 0.40
    swapped: float = 0.15
    middle_dropped: float = 0.15
    initial: float = 0.10
    typo: float = 0.10
    born_lost: float = 0.12
    born_moved: float = 0.03
    nation_lost: float = 0.20
    club_lost: float = 0.30
    club_short: float = 0.35

    def __post_init__(self) -> None:
        if self.kept + self.swapped + self.middle_dropped + self.initial + self.typo > 1 + 1e-9 or any(not 0 <= x <= 1 for x in vars(self).values()):
            raise ValueError("shares must be within 0 and 1, those of names together too")


def unit(seed: int, key: Column, what: str) -> Column:
    """A number in (0, 1) from 40 bits of the md5 of seed, key and what is chosen."""
    text = F.concat_ws(":", F.lit(str(seed)), key.cast("string"), F.lit(what))
    return (F.conv(F.substring(F.md5(text.cast("binary")), 1, 10), 16, 10).cast("double") + 0.5) / float(1 << 40)


def misnamed(name: Column, key: Column, errors: Errors, seed: int) -> Column:
    """The name as another source may write it: last word first, without the words between, with an initial, with a letter
    taken for another, or the last word alone. Names that are too short for their error stay."""
    words = F.split(name, " ")
    first, last, n = words[0], F.element_at(words, -1), F.size(words)
    at = (2 + F.floor(unit(seed, key, "place") * (F.length(name) - 2))).cast("int")
    typo = F.concat(F.substring(name, F.lit(1), at - 1), F.translate(F.substring(name, at, F.lit(1)), *TYPOS), F.substring(name, at + 1, F.length(name)))
    kinds = [
        (errors.kept, name),
        (errors.swapped, F.when(n > 1, F.concat_ws(" ", last, F.array_join(F.slice(words, F.lit(1), F.greatest(n - 1, F.lit(0))), " "))).otherwise(name)),
        (errors.middle_dropped, F.when(n > 2, F.concat_ws(" ", first, last)).otherwise(name)),
        (errors.initial, F.when(n > 1, F.concat(F.substring(first, 1, 1), F.lit(". "), last)).otherwise(name)),
        (errors.typo, F.when(F.length(name) >= 5, typo).otherwise(name)),
    ]
    roll, upto, out = unit(seed, key, "name"), 0.0, None
    for share, made in kinds:
        upto += share
        out = F.when(roll < round(upto, 9), made) if out is None else out.when(roll < round(upto, 9), made)
    return F.when(name.isNotNull(), out.otherwise(last))


def shadow(identities: DataFrame, errors: Errors | None = None, seed: int = SEED) -> DataFrame:
    """``identities`` (id, name, born, nation, club) as a second source has them; ``id`` tells what is the right answer."""
    e, key = errors or Errors(), F.col("id")
    u = lambda what: unit(seed, key, what)
    born = F.when(u("born") < e.born_lost, None).when(u("born") < round(e.born_lost + e.born_moved, 9), F.date_add("born", 1)).otherwise(F.col("born"))
    club = F.when(u("club") < e.club_lost, None).when(u("short") < e.club_short, F.trim(F.regexp_replace("club", r"\b(fc|club)\b", ""))).otherwise(F.col("club"))
    return identities.select("id", misnamed(F.col("name"), key, e, seed).alias("name"), born.alias("born"), F.when(u("nation") >= e.nation_lost, F.col("nation")).alias("nation"), club.alias("club"))


def scored(left: DataFrame, right: DataFrame, nations: Mapping[str, str], club_stop: list[str], max_block: int | None = MAX_BLOCK) -> DataFrame:
    """(left_id, right_id, name_score, confidence, method) of the candidate pairs of two sources (id, name, born, nation, club).
    Names are normalised once, on the way, and written; nations are compared through ``nations``, their other names.

    Without ``max_block``, rows without a date are compared with all of their surname. Names are then compared kind by kind where
    rows have no date in common."""
    plain = _plain(left, right, nations)
    if max_block is not None:
        return _scores(compared(*plain, max_block), club_stop)
    pairs = _kinds(*plain, club_stop).withColumn("_x", F.explode_outer("left_rows")).withColumn("_y", F.explode_outer("right_rows"))
    named = pairs.select("_x.*", "_y.*", "name_score", "confidence", "method").where(~F.coalesce(F.col("left_born") == F.col("right_born"), F.lit(False)))
    return _scores(compared(*plain, None, named=False), club_stop).unionByName(named.drop("left_born", "right_born"))


def decided(left: DataFrame, right: DataFrame, nations: Mapping[str, str], club_stop: list[str]) -> DataFrame:
    """``decide`` of ``scored`` without ``max_block``. Without a date in common nothing is accepted, so that of such pairs only a left
    row's highest confidence decides, and none is made but by kind."""
    plain = _plain(left, right, nations)
    dated = _scores(compared(*plain, None, named=False), club_stop).select("left_id", "right_id", "confidence")
    pairs = _kinds(*plain, club_stop).withColumn("_x", F.explode_outer("left_rows")).select("_x.*", "right_rows", "confidence")
    other = lambda row: F.coalesce(row["right_born"] != F.col("left_born"), F.lit(True))
    best = pairs.where(other(F.get("right_rows", F.lit(0))) | F.exists("right_rows", other)).groupBy("left_id").agg(F.max("confidence").alias("confidence"))
    return decide(dated.unionByName(best.select("left_id", F.lit(None).cast(dated.schema["right_id"].dataType).alias("right_id"), "confidence")))


def _plain(left: DataFrame, right: DataFrame, nations: Mapping[str, str]) -> list[DataFrame]:
    return [written(df.select("id", normalised(F.col("name")).alias("name"), "born", aliased("nation", nations).alias("nation"), normalised(F.col("club")).alias("club")), "plain") for df in (left, right)]


def _alike(pairs: DataFrame, club_stop: list[str]) -> DataFrame:
    return pairs.withColumn("same_nation", same(F.col("left_nation"), F.col("right_nation"))).withColumn("same_club", same_club(F.col("left_club"), F.col("right_club"), club_stop))


def _scores(pairs: DataFrame, club_stop: list[str]) -> DataFrame:
    return pair_scores(_alike(pairs, club_stop)).select("left_id", "right_id", "name_score", F.round("confidence", 6).alias("confidence"), "method")


def _kinds(left: DataFrame, right: DataFrame, club_stop: list[str]) -> DataFrame:
    """(left_rows, right_rows, name_score, confidence, method) of ``named_kinds``."""
    alike = _alike(apart(named_kinds(left, right)), club_stop)
    return apart(kind_scores(alike).select("left_rows", "right_rows", "name_score", F.round("confidence", 6).alias("confidence"), "method"))


def outcome(left: DataFrame, decided: DataFrame) -> DataFrame:
    """One row (total, matched, correct, incorrect, ambiguous, unmatched, precision, recall) of the decisions on ``left``, whose
    ids are the right answers. What no candidate was found for is unmatched."""
    both = left.select(F.col("id").alias("left_id")).join(decided, "left_id", "left")
    status = F.coalesce("status", F.lit("unmatched"))
    right = status.isin("matched", "manual") & F.coalesce(F.col("right_id") == F.col("left_id"), F.lit(False))
    sums = both.agg(F.count("*").alias("total"), F.count_if(status.isin("matched", "manual")).alias("matched"), F.count_if(right).alias("correct"), F.count_if(status == "ambiguous").alias("ambiguous"), F.count_if(status == "unmatched").alias("unmatched"))
    share = lambda of, none: F.when(F.col(of) > 0, F.col("correct") / F.col(of)).otherwise(F.lit(none))
    return sums.select("total", "matched", "correct", (F.col("matched") - F.col("correct")).alias("incorrect"), "ambiguous", "unmatched", share("matched", 1.0).alias("precision"), share("total", 0.0).alias("recall"))


def evaluate(identities: DataFrame, nations: Mapping[str, str], club_stop: list[str], errors: Errors | None = None, seed: int = SEED) -> DataFrame:
    """``outcome`` of the whole chain on the shadow of ``identities``."""
    other = shadow(identities, errors, seed)
    return outcome(other, decide(scored(other, identities, nations, club_stop).select("left_id", "right_id", "confidence")))
