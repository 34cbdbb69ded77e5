"""Conversation structure repair: the cheapest edits that make the roles of a conversation alternate.

Faults are flagged by windows over a conversation: a turn is blank, repeats an earlier one, or breaks off. Its turns are then
collected in order and folded. The fold carries four (cost, audit) structs, one for each state that what was kept so far can
be in, and takes the least of the ways into each state, first by cost and then by audit:

    empty  nothing kept yet       opened  a system turn only       asked  a user turn last       answered  an assistant turn last

Each edit costs the same in all states and appends one letter: K keeps a turn, R gives it the role that fits, D deletes it
and I inserts an empty turn. Of two ways that cost the same none is the beginning of the other, as a longer way over the same
turns has more insertions, so what follows can't turn their order and the least of each state is enough.

The letters tell the repaired turns: what is kept alternates between user and assistant from its first turn on, or from its
second if the first is a kept system turn.

All rows of a conversation meet in one task, as its repaired turns are one row; a conversation must fit there. The rows are
shuffled once. Audits grow by a letter at a time, so a fold over n turns copies n * n / 2 characters.

Defined results: null roles and texts are one space, so a null text is blank; turns come by turn (nulls first), then role, then
text; rows that share all three are repeats; a null conv_id is a conversation of its own; a conversation of which no row is
live has no faults, no cost and an empty audit; further columns are not read, whatever their names; an empty table stays empty.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import CRC_SQL, bound, crc_sql, running

#: Costs of the edits, and of leaving a turn that breaks off.
RENAME, DELETE, INSERT, BROKEN = 2, 3, 2, 1
#: More than any conversation can cost: a state that can't be reached, a turn that mustn't be kept.
NEVER = 1 << 40
SPACE = r"\x20\x09-\x0D"


def damage(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, live) with every fifth or so of the rows damaged by crc32 of conv_id and turn, modulo 20: 0
    drops the row (it stays as one that isn't live), 1 empties its text, 2 removes ``.!?`` from it, 3 repeats it, 4 makes its role user."""
    word = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    fate = F.crc32(F.concat_ws(":", word("conv_id"), word("turn")).cast("binary")) % 20
    role = F.when(fate == 4, F.lit("user")).otherwise(word("role"))
    text = F.when(fate == 1, F.lit("")).when(fate == 2, F.translate(word("text"), ".!?", "")).otherwise(word("text"))
    made = rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), (fate != 0).alias("live"), F.when(fate == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1))).alias("times"))
    return made.select("conv_id", "turn", "role", "text", "live", F.explode("times").alias("_time")).drop("_time")


def flagged(rows: DataFrame) -> DataFrame:
    """The rows of ``damage`` or of like columns, with fault (blank, duplicate, truncated or null), seen (how often this role and
    text have come so far), odd (its role can't follow the one before) and fresh (the first row of its turn).

    Both windows hold whole conversations, so one shuffle serves them and what is grouped by conversation later."""
    whole = rows.select("conv_id", "turn", F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"), "live").repartition("conv_id")
    in_order = Window.partitionBy("conv_id", "live").orderBy(F.asc_nulls_first("turn"), "role", "text")
    alike = Window.partitionBy("conv_id", "live", "role", "text").orderBy(F.asc_nulls_first("turn"))
    pair = F.concat(F.lag(F.substring("role", 1, 1)).over(in_order), F.substring("role", 1, 1))
    before = F.lag("turn").over(in_order)
    numbered = whole.withColumn("seen", F.row_number().over(alike)).withColumn("odd", F.coalesce(~pair.isin("su", "ua", "au"), F.lit(False)))
    fault = F.when(~F.col("text").rlike(f"[^{SPACE}]"), "blank").when(F.col("seen") > 1, "duplicate").when(~F.col("text").rlike(rf"[.!?][{SPACE}]*\z"), "truncated")
    return numbered.withColumn("fresh", F.col("turn").isNotNull() & (before.isNull() | (before != F.col("turn")))).withColumn("fault", fault)


def _way(cost: Column, audit: Column) -> Column:
    return F.struct(cost.cast("long").alias("cost"), audit.alias("audit"))


def _then(way: Column, cost: Column | int, letter: Column | str) -> Column:
    return _way(way["cost"] + cost, F.concat(way["audit"], F.lit(letter) if isinstance(letter, str) else letter))


def _inserted(state: Column) -> Column:
    """``state`` after as many insertions as pay. Of those to a user turn one is enough, and one more answers it."""
    asked = F.least(state["asked"], *[_then(state[x], INSERT, "I") for x in ("empty", "opened", "answered")])
    return bound(asked, lambda u: F.struct(state["empty"].alias("empty"), state["opened"].alias("opened"), u.alias("asked"), F.least(state["answered"], _then(u, INSERT, "I")).alias("answered")))


def _after(state: Column, turn: Column) -> Column:
    """``state`` after ``turn`` is kept, renamed or deleted, and what is inserted behind it."""
    initial, fault = F.substring(turn["role"], 1, 1), F.coalesce(turn["fault"], F.lit(""))
    left = F.when(fault.isin("blank", "duplicate"), NEVER).when(fault == "truncated", BROKEN).otherwise(0)
    dropped = {x: _then(state[x], DELETE, "D") for x in ("empty", "opened", "asked", "answered")}
    system = _then(state["empty"], F.when(initial == "s", left).otherwise(NEVER), "K")
    as_role = lambda way, own: _then(way, left + F.when(initial == own, 0).otherwise(RENAME), F.when(initial == own, "K").otherwise("R"))
    user = as_role(F.least(state["empty"], state["opened"], state["answered"]), "u")
    assistant = as_role(state["asked"], "a")
    moved = F.struct(dropped["empty"].alias("empty"), F.least(dropped["opened"], system).alias("opened"), F.least(dropped["asked"], user).alias("asked"), F.least(dropped["answered"], assistant).alias("answered"))
    return bound(moved, _inserted)


def cheapest(turns: Column) -> Column:
    """(cost, audit) of the cheapest edits of an array of (role, text, fault) that leave nothing or user and assistant in
    turn, after a system turn or none."""
    nothing, never = _way(F.lit(0), F.lit("")), _way(F.lit(NEVER), F.lit(""))
    start = _inserted(F.struct(nothing.alias("empty"), never.alias("opened"), never.alias("asked"), never.alias("answered")))
    return F.aggregate(turns, start, _after, lambda end: F.least(end["empty"], end["answered"]))


def applied(turns: Column, audit: Column) -> Column:
    """The turns (role, text) that the edits of ``audit`` make of ``turns``. One piece of the audit belongs to each turn: what
    is inserted before it, and what becomes of it."""
    kept = lambda piece: F.length(F.translate(piece, "D", ""))

    def made(pieces: Column, places: Column) -> Column:
        opens = F.exists(F.arrays_zip(turns.alias("turn"), pieces.alias("piece"), F.slice(places, F.lit(1), F.size(pieces)).alias("place")), lambda x: (x["place"] == 0) & (x["piece"] == "K") & (F.substring(x["turn"]["role"], 1, 1) == "s"))

        def with_first(system: Column) -> Column:
            fitting = lambda place: F.when((place - system.cast("long")) % 2 == 0, "user").otherwise("assistant")
            line = lambda role, text: F.struct(role.alias("role"), text.alias("text"))
            empties = lambda place, n: F.transform(F.filter(F.sequence(F.lit(0), n), lambda k: k < n), lambda k: line(fitting(place + k), F.lit("")))

            def of(turn: Column, i: Column) -> Column:
                inserts = F.length(pieces[i]) - 1
                end = F.substring(pieces[i], -1, 1)
                own = F.array(line(F.when(end == "K", turn["role"]).otherwise(fitting(places[i] + inserts)), turn["text"]))
                return F.concat(empties(places[i], inserts), F.when(end == "D", F.slice(own, 1, 0)).otherwise(own))

            behind = F.length(F.regexp_extract(audit, "I*$", 0))
            return F.concat(F.flatten(F.transform(turns, of)), empties(F.element_at(places, -1), behind))

        return bound(opens, with_first)

    pieces = F.regexp_extract_all(audit, F.lit("I*[KRD]"), F.lit(0))
    return bound(pieces, lambda found: bound(running(F.transform(found, kept)), lambda places: made(found, places)))


def repair(rows: DataFrame) -> DataFrame:
    """One row per conversation of ``rows`` (conv_id, turn, role, text, live): gaps, blank, duplicate, truncated, illegal, cost,
    audit, and repaired, the array of turns (role, text) that the edits leave."""
    of = lambda what: F.sum((F.col("live") & what).cast("long"))
    when_live = lambda c: F.when(F.col("live"), c)
    span = F.max(when_live(F.col("turn"))) - F.min(when_live(F.col("turn"))) + 1 - of(F.col("fresh"))
    faults = [of(F.coalesce(F.col("fault") == x, F.lit(False))).alias(x) for x in ("blank", "duplicate", "truncated")]
    turns = F.sort_array(F.collect_list(when_live(F.struct("turn", "role", "text", "seen", "fault"))))
    whole = flagged(rows).groupBy("conv_id").agg(F.coalesce(span, F.lit(0)).cast("long").alias("gaps"), *faults, of(F.col("odd")).alias("illegal"), turns.alias("turns"))
    folded = whole.withColumn("best", cheapest(F.col("turns")))
    counts = ["gaps", "blank", "duplicate", "truncated", "illegal"]
    return folded.select("conv_id", *counts, F.col("best.cost").alias("cost"), F.col("best.audit").alias("audit"), "turns").select("conv_id", *counts, "cost", "audit", applied(F.col("turns"), F.col("audit")).alias("repaired"))


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = repair(damage(spark.read.parquet(f"{sf_dir}/conversations.parquet")))
    text = F.array_join(F.transform("repaired", lambda t: F.concat(t["role"], F.lit(":"), t["text"])), "\n")
    return found.select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", F.sha2(text.cast("binary"), 256).alias("repaired_sha256"))


def _step(way: str, cost: str, letter: str, line: str) -> str:
    """A way in the SQL: eight digits of cost, the audit, chr(1), and the lines so far."""
    kept = f"split_part(substr({way}, 9), chr(1), 1) || {letter} || chr(1) || split_part({way}, chr(1), 2)"
    return f"lpad((substr({way}, 1, 8)::BIGINT + {cost})::VARCHAR, 8, '0') || {kept} || {line}"


_LINE = "chr(10) || {} || ':' || text"
_KEEP = "CASE WHEN initial = '{0}' THEN " + _LINE.format("role") + " ELSE " + _LINE.format("'{1}'") + " END"
_INSERT_U, _INSERT_A = "chr(10) || 'user:'", "chr(10) || 'assistant:'"

ORACLE = f"""
WITH RECURSIVE {CRC_SQL},
rows0 AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    {crc_sql("coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ')")} % 20 AS fate
  FROM conversations, crcs
), live AS (
  SELECT conv_id, turn, CASE WHEN fate = 4 THEN 'user' ELSE role END AS role,
    CASE fate WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM rows0, unnest(CASE fate WHEN 0 THEN []::INT[] WHEN 3 THEN [1, 2] ELSE [1] END) AS u(k)
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i, substr(role, 1, 1) AS initial FROM live
), ordered AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) AS seen FROM placed
), flagged AS (
  SELECT *, CASE WHEN NOT regexp_matches(text, '[^ \\t-\\r]') THEN 'blank' WHEN seen > 1 THEN 'duplicate' WHEN NOT regexp_matches(text, '[.!?][ \\t-\\r]*\\z') THEN 'truncated' ELSE '' END AS fault,
    coalesce(lag(initial) OVER (PARTITION BY conv_id ORDER BY i) || initial NOT IN ('su', 'ua', 'au'), false) AS odd
  FROM ordered
), priced AS (
  SELECT *, CASE WHEN fault IN ('blank', 'duplicate') THEN 9000000 WHEN fault = 'truncated' THEN 1 ELSE 0 END AS left_cost FROM flagged
), fold AS (
  SELECT DISTINCT conv_id, 0::BIGINT AS i, '00000000' || chr(1) AS e, '09000000' || chr(1) AS s, '00000002I' || chr(1) || {_INSERT_U} AS u, '00000004II' || chr(1) || {_INSERT_U} || {_INSERT_A} AS a FROM conversations
  UNION ALL
  SELECT conv_id, i, e1, s1, u2, least(a1, {_step("u2", "2", "'I'", _INSERT_A)}) FROM (
    SELECT *, least(u1, {_step("e1", "2", "'I'", _INSERT_U)}, {_step("s1", "2", "'I'", _INSERT_U)}, {_step("a1", "2", "'I'", _INSERT_U)}) AS u2 FROM (
      SELECT f.conv_id, p.i, {_step("e", "3", "'D'", "''")} AS e1,
        least({_step("s", "3", "'D'", "''")}, {_step("e", "CASE WHEN initial = 's' THEN left_cost ELSE 9000000 END", "'K'", _LINE.format("role"))}) AS s1,
        least({_step("u", "3", "'D'", "''")}, {_step("least(e, s, a)", "left_cost + CASE WHEN initial = 'u' THEN 0 ELSE 2 END", "CASE WHEN initial = 'u' THEN 'K' ELSE 'R' END", _KEEP.format("u", "user"))}) AS u1,
        least({_step("a", "3", "'D'", "''")}, {_step("u", "left_cost + CASE WHEN initial = 'a' THEN 0 ELSE 2 END", "CASE WHEN initial = 'a' THEN 'K' ELSE 'R' END", _KEEP.format("a", "assistant"))}) AS a1
      FROM fold f JOIN priced p ON f.conv_id IS NOT DISTINCT FROM p.conv_id AND p.i = f.i + 1
    )
  )
), best AS (
  SELECT conv_id, arg_max(least(e, a), i) AS way FROM fold GROUP BY conv_id
), counted AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
    count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (odd) AS illegal
  FROM flagged GROUP BY conv_id
)
SELECT b.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal,
  substr(way, 1, 8)::BIGINT AS cost, split_part(substr(way, 9), chr(1), 1) AS audit, sha256(substr(split_part(way, chr(1), 2), 2)) AS repaired_sha256
FROM best b LEFT JOIN counted c ON b.conv_id IS NOT DISTINCT FROM c.conv_id
"""
