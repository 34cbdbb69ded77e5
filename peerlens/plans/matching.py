"""Matching two sources of identities, and its evaluation, over people that are read off the documents, with the same in SQL.

A person's name is the first three words of a document, the birth date, which two have in common, follows from its id, language and source stand in for nation
and club. The second source is a shadow of the first with errors in names, dates, nations and clubs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import identity, shadow
from .fixture import tables

NATIONS = {"england": "en", "france": "fr", "germany": "de", "spain": "es"}
CLUB_STOP = ["fc", "club"]
DAYS = 20_000


def people(spark: SparkSession, d: str) -> DataFrame:
    (docs,) = tables(spark, d, "documents")
    names = F.array_join(F.slice(F.split("text", r"\s+", 4), 1, 3), " ")
    born = F.when(F.col("doc_id") % 10 != 0, F.date_add(F.lit("1980-01-01").cast("date"), (F.floor(F.col("doc_id") / 2) * 37 % DAYS).cast("int")))
    long = F.col("lang")
    for name, code in NATIONS.items():
        long = F.when(F.col("lang") == code, name).otherwise(long)
    nation = F.when(F.col("doc_id") % 2 == 0, F.col("lang")).otherwise(long)
    return docs.where("doc_id IS NOT NULL AND text IS NOT NULL").select(F.col("doc_id").alias("id"), names.alias("name"), born.alias("born"), nation.alias("nation"), F.concat("source", F.lit(" fc")).alias("club"))


def identity_pair_scores(spark: SparkSession, d: str) -> DataFrame:
    """Every pair of a shadow and a person that share a date, or surname and year, or surname if the shadow has no date, with its name
    score, confidence and the rule that decided."""
    own = people(spark, d)
    return shadow.scored(shadow.shadow(own), own, NATIONS, CLUB_STOP, None)


def shadow_decisions(spark: SparkSession, d: str) -> DataFrame:
    """What is decided for each shadow that has a candidate."""
    own = people(spark, d)
    return shadow.decided(shadow.shadow(own), own, NATIONS, CLUB_STOP)


def shadow_evaluation(spark: SparkSession, d: str) -> DataFrame:
    """Precision and recall of names, blocking, scores and decisions together."""
    out = shadow.evaluate(people(spark, d), NATIONS, CLUB_STOP)
    return out.withColumns({c: F.round(c, 9) for c in ("precision", "recall")})


def unblocked_people(spark: SparkSession, d: str, max_block: int = 3) -> DataFrame:
    """Surnames of undated shadows that are compared with nobody, as more than ``max_block`` people have them."""
    own = people(spark, d)
    plain = [df.withColumn("name", identity.normalised(F.col("name"))) for df in (shadow.shadow(own), own)]
    return identity.unblocked(*plain, max_block)


QUERIES = {f.__name__: f for f in (identity_pair_scores, shadow_decisions, shadow_evaluation, unblocked_people)}


def _u(what: str) -> str:
    return f"((('0x' || substr(md5('{shadow.SEED}:' || id::VARCHAR || ':{what}'), 1, 10))::BIGINT)::DOUBLE + 0.5::DOUBLE) / 1099511627776.0::DOUBLE"


def _plain(name: str) -> str:
    """A name in lower-case letters a to z and digits, single-spaced."""
    single = "".join(a for a, b in identity.LETTERS.items() if len(b) == 1), "".join(b for b in identity.LETTERS.values() if len(b) == 1)
    out = f"translate({name}, '{single[0]}', '{single[1]}')"
    for a, b in identity.LETTERS.items():
        if len(b) > 1:
            out = f"replace({out}, '{a}', '{b}')"
    return f"trim(regexp_replace(regexp_replace(lower(strip_accents({out})), '[^a-z0-9\\s]', ' ', 'g'), '\\s+', ' ', 'g'))"


def _nation(c: str) -> str:
    return "CASE " + " ".join(f"WHEN lower(trim({c})) = '{a}' THEN '{b}'" for a, b in NATIONS.items()) + f" ELSE lower(trim({c})) END"


def _inside(p: str, q: str) -> str:
    times = f"len(list_filter({p}, lambda w: len(list_filter({p}, lambda z: z = w)) > len(list_filter({q}, lambda z: z = w))))"
    return f"(len({p}) >= 2 AND len({p}) < len({q}) AND {p}[1] = {q}[1] AND {times} = 0)"


_E = shadow.Errors()
_NAME = [round(sum((_E.kept, _E.swapped, _E.middle_dropped, _E.initial, _E.typo)[: k + 1]), 9) for k in range(5)]
_OWN = "list_filter(list_distinct(string_split({0}, ' ')), lambda w: w NOT IN ('fc', 'club'))"
_MATCH = "list_max(list_filter(flatten(list_transform(range(1, length(a) + 1), lambda i: list_transform(range(1, length(a) - i + 2), lambda k: {'k': k, 'i': -i, 'j': strpos(b, substr(a, i, k))}))), lambda z: z.j > 0))"
_FEW = f" AND ls.s IN (SELECT s FROM rs GROUP BY s HAVING count(*) <= {identity.MAX_BLOCK})"

SCORED = f"""
people AS (
  SELECT doc_id AS id, array_to_string(regexp_split_to_array(text, '\\s+')[1:3], ' ') AS name, CASE WHEN doc_id % 10 <> 0 THEN DATE '1980-01-01' + (doc_id // 2 * 37 % {DAYS})::INT END AS born,
    CASE WHEN doc_id % 2 = 0 THEN lang ELSE CASE lang {' '.join(f"WHEN '{b}' THEN '{a}'" for a, b in NATIONS.items())} ELSE lang END END AS nation, source || ' fc' AS club
  FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL
), rolled AS (
  SELECT *, string_split(name, ' ') AS w, {_u('name')} AS u_name, {_u('place')} AS u_place, {_u('born')} AS u_born, {_u('nation')} AS u_nation, {_u('club')} AS u_club, {_u('short')} AS u_short FROM people
), placed AS (
  SELECT *, 2 + floor(u_place * (length(name) - 2))::INT AS spot FROM rolled
), shadows AS (
  SELECT id, CASE WHEN u_name < {_NAME[0]} THEN name
      WHEN u_name < {_NAME[1]} THEN CASE WHEN len(w) > 1 THEN w[-1] || ' ' || array_to_string(w[1:len(w) - 1], ' ') ELSE name END
      WHEN u_name < {_NAME[2]} THEN CASE WHEN len(w) > 2 THEN w[1] || ' ' || w[-1] ELSE name END
      WHEN u_name < {_NAME[3]} THEN CASE WHEN len(w) > 1 THEN substr(w[1], 1, 1) || '. ' || w[-1] ELSE name END
      WHEN u_name < {_NAME[4]} THEN CASE WHEN length(name) >= 5 THEN substr(name, 1, spot - 1) || translate(substr(name, spot, 1), '{shadow.TYPOS[0]}', '{shadow.TYPOS[1]}') || substr(name, spot + 1) ELSE name END
      ELSE w[-1] END AS name,
    CASE WHEN u_born < {_E.born_lost} THEN NULL WHEN u_born < {round(_E.born_lost + _E.born_moved, 9)} THEN born + 1 ELSE born END AS born,
    CASE WHEN u_nation >= {_E.nation_lost} THEN nation END AS nation,
    CASE WHEN u_club < {_E.club_lost} THEN NULL WHEN u_short < {_E.club_short} THEN trim(regexp_replace(club, '\\b(fc|club)\\b', '', 'g')) ELSE club END AS club
  FROM placed
), l AS (
  SELECT id, {_plain('name')} AS name, born, {_nation('nation')} AS nation, {_plain('club')} AS club FROM shadows
), r AS (
  SELECT id, {_plain('name')} AS name, born, {_nation('nation')} AS nation, {_plain('club')} AS club FROM people
), ls AS (SELECT *, string_split(name, ' ')[-1] AS s FROM l
), rs AS (SELECT *, string_split(name, ' ')[-1] AS s FROM r
), blocked AS (
  SELECT ls.id AS left_id, rs.id AS right_id FROM ls JOIN rs ON ls.born = rs.born
  UNION SELECT ls.id, rs.id FROM ls JOIN rs ON ls.s = rs.s AND year(ls.born) = year(rs.born)
  UNION SELECT ls.id, rs.id FROM ls JOIN rs ON ls.s = rs.s WHERE ls.born IS NULL{_FEW}
), pairs AS (
  SELECT left_id, right_id, l.name AS a, r.name AS b, string_split(l.name, ' ') AS p, string_split(r.name, ' ') AS q, l.born AS left_born, r.born AS right_born, l.nation = r.nation AS same_nation,
    CASE WHEN l.club IS NULL OR r.club IS NULL THEN NULL
      WHEN l.club = r.club OR ((list_has_all(string_split(r.club, ' '), string_split(l.club, ' ')) OR list_has_all(string_split(l.club, ' '), string_split(r.club, ' '))) AND list_has_any({_OWN.format('l.club')}, {_OWN.format('r.club')})) THEN true
      WHEN NOT list_has_any({_OWN.format('l.club')}, {_OWN.format('r.club')}) THEN false END AS same_club
  FROM blocked JOIN l ON left_id = l.id JOIN r ON right_id = r.id
), kinds AS (
  SELECT DISTINCT a, b, p, q FROM pairs WHERE a <> '' AND b <> '' AND a <> b AND list_sort(list_distinct(p)) <> list_sort(list_distinct(q))
), words AS (
  SELECT DISTINCT x, y FROM (SELECT x, unnest(q) AS y FROM (SELECT q, unnest(p) AS x FROM kinds))
), hard AS (
  SELECT x, y FROM words WHERE x <> y AND NOT (substr(x, 1, 1) = substr(y, 1, 1) AND (length(x) = 1 OR length(y) = 1))
), common AS (
  SELECT x, y, x AS a, y AS b, 0 AS n FROM hard
  UNION ALL
  SELECT x, y, part.a, part.b, part.n FROM (
    SELECT x, y, unnest([{{'a': substr(a, 1, -m.i - 1), 'b': substr(b, 1, m.j - 1), 'n': m.k}}, {{'a': substr(a, -m.i + m.k), 'b': substr(b, m.j + m.k), 'n': 0}}]) AS part
    FROM (SELECT *, {_MATCH} AS m FROM common WHERE a <> '' AND b <> '') WHERE m IS NOT NULL
  )
), alike AS (
  SELECT x, y, CASE WHEN ratio >= {identity.ALIKE} THEN ratio ELSE ratio / 2 END AS score FROM (SELECT x, y, 2.0::DOUBLE * sum(n)::DOUBLE / (length(x) + length(y)) AS ratio FROM common GROUP BY x, y)
  UNION ALL SELECT x, y, CASE WHEN x = y THEN 1.0 ELSE {identity.INITIAL} END::DOUBLE FROM words WHERE (x, y) NOT IN (SELECT x, y FROM hard)
), cells AS (
  SELECT k.a, k.b, i, j, score FROM (SELECT a, b, p, q, unnest(range(1, len(p) + 1)) AS i FROM kinds) k, unnest(range(1, len(q) + 1)) AS u(j) JOIN alike ON x = p[i] AND y = q[j]
), sided AS (
  SELECT c.a, c.b, CASE WHEN len(p) <= len(q) THEN i ELSE j END AS few, CASE WHEN len(p) <= len(q) THEN j ELSE i END AS many, score, len(p) AS np, len(q) AS nq, CASE WHEN i = len(p) AND j = len(q) THEN score END AS last
  FROM cells c JOIN kinds k ON c.a = k.a AND c.b = k.b
), lines AS (
  SELECT a, b, few, list(score ORDER BY many) AS line, max(last) AS last, any_value(np) AS np, any_value(nq) AS nq FROM sided GROUP BY a, b, few
), tabled AS (
  SELECT a, b, list(line ORDER BY few) AS t, max(last) AS last, least(any_value(np), any_value(nq)) AS few, greatest(any_value(np), any_value(nq)) AS many FROM lines GROUP BY a, b
), paired AS (
  SELECT a, b, 0 AS step, list_transform(range(0, many), lambda i: true) AS free, 0.0::DOUBLE AS got FROM tabled
  UNION ALL
  SELECT a, b, step + 1, list_transform(free, lambda f, i: f AND NOT (i = k AND v[k] > 0)), got + v[k] FROM (
    SELECT *, list_position(v, list_max(v)) AS k FROM (
      SELECT g.a, g.b, step, free, got, list_transform(t[step + 1], lambda s, i: CASE WHEN free[i] THEN s ELSE -1.0 END) AS v FROM paired g JOIN tabled t ON g.a = t.a AND g.b = t.b WHERE step < few
    )
  )
), named AS (
  SELECT t.a, t.b, least({identity.MOST}::DOUBLE, {identity.WEIGHTS['paired']}::DOUBLE * (got / few) + {identity.WEIGHTS['last']}::DOUBLE * last + {identity.WEIGHTS['share']}::DOUBLE * (few::DOUBLE / many)) AS score
  FROM tabled t JOIN paired g ON t.a = g.a AND t.b = g.b AND g.step = t.few
), judged AS (
  SELECT pairs.*, round(CASE WHEN pairs.a = '' OR pairs.b = '' THEN 0.0 WHEN pairs.a = pairs.b THEN {identity.EQUAL} WHEN named.score IS NULL THEN {identity.SAME_WORDS} ELSE named.score END::DOUBLE, 9) AS n,
    {_inside('p', 'q')} OR {_inside('q', 'p')} AS within, coalesce(same_nation, false) AS nation, coalesce(same_club, false) AS club, coalesce(left_born = right_born, false) AS dated,
    left_born IS NOT NULL AND right_born IS NOT NULL AS both_dated, coalesce(year(left_born) = year(right_born), false) AS same_year
  FROM pairs LEFT JOIN named ON pairs.a = named.a AND pairs.b = named.b
), scored AS (
  SELECT left_id, right_id, n AS name_score, round((rule).c, 6) AS confidence, (rule).m AS method FROM (SELECT *, CASE
    WHEN dated AND n >= 1 AND club THEN {{'c': 1.00::DOUBLE, 'm': 'name, date, club'}}
    WHEN dated AND n >= 1 THEN {{'c': 0.95::DOUBLE, 'm': 'name, date'}}
    WHEN dated AND n >= {identity.VERY_STRONG} THEN {{'c': 0.98::DOUBLE, 'm': 'date, very like name'}}
    WHEN dated AND n >= {identity.STRONG} AND nation AND club THEN {{'c': 0.92::DOUBLE, 'm': 'date, like name, nation, club'}}
    WHEN dated AND n >= {identity.STRONG} AND (nation OR club) THEN {{'c': 0.90::DOUBLE, 'm': 'date, like name, nation or club'}}
    WHEN dated AND n >= {identity.STRONG} THEN {{'c': 0.86::DOUBLE, 'm': 'date, like name'}}
    WHEN dated AND within AND nation AND club THEN {{'c': 0.92::DOUBLE, 'm': 'date, part of name, nation, club'}}
    WHEN dated AND within AND (nation OR club) THEN {{'c': 0.90::DOUBLE, 'm': 'date, part of name, nation or club'}}
    WHEN dated THEN {{'c': least(0.70::DOUBLE, 0.45::DOUBLE + n * 0.3::DOUBLE), 'm': 'date, weak name'}}
    WHEN both_dated AND NOT same_year THEN {{'c': least(0.30::DOUBLE, n * 0.3::DOUBLE), 'm': 'years differ'}}
    WHEN both_dated AND n >= {identity.VERY_STRONG} AND (nation OR club) THEN {{'c': 0.88::DOUBLE, 'm': 'year, very like name, nation or club'}}
    WHEN both_dated THEN {{'c': least(0.75::DOUBLE, n * 0.75::DOUBLE), 'm': 'year, name'}}
    WHEN n >= 1 AND nation AND club THEN {{'c': 0.85::DOUBLE, 'm': 'name, nation, club'}}
    WHEN n >= {identity.VERY_STRONG} AND (nation OR club) THEN {{'c': 0.72::DOUBLE, 'm': 'very like name, nation or club'}}
    ELSE {{'c': least(0.65::DOUBLE, n * 0.65::DOUBLE), 'm': 'name alone'}} END AS rule FROM judged)
), decided AS (
  SELECT left_id, CASE WHEN status = 'matched' THEN right_id END AS right_id, confidence, status FROM (
    SELECT *, CASE WHEN confidence < {identity.ACCEPT} THEN 'unmatched' WHEN confidence - coalesce(runner_up, 0) < {identity.MARGIN} - 1e-9 THEN 'ambiguous' ELSE 'matched' END AS status
    FROM (SELECT *, row_number() OVER w AS place, lead(confidence) OVER w AS runner_up FROM scored WINDOW w AS (PARTITION BY left_id ORDER BY confidence DESC, right_id)) WHERE place = 1
  )
)"""
#: The same with surnames of any number of people.
WHOLE = SCORED.replace(_FEW, "")

ORACLES = {
    "identity_pair_scores": f"WITH RECURSIVE {WHOLE} SELECT * FROM scored",
    "shadow_decisions": f"WITH RECURSIVE {WHOLE} SELECT * FROM decided",
    "shadow_evaluation": f"""WITH RECURSIVE {SCORED}, sums AS (
  SELECT count(*) AS total, count(*) FILTER (status = 'matched') AS matched, count(*) FILTER (status = 'matched' AND right_id = id) AS correct, count(*) FILTER (status = 'ambiguous') AS ambiguous,
    count(*) FILTER (coalesce(status, 'unmatched') = 'unmatched') AS unmatched
  FROM shadows LEFT JOIN decided ON id = left_id
)
SELECT total, matched, correct, matched - correct AS incorrect, ambiguous, unmatched, round(CASE WHEN matched > 0 THEN correct::DOUBLE / matched ELSE 1.0 END, 9) AS precision, round(CASE WHEN total > 0 THEN correct::DOUBLE / total ELSE 0.0 END, 9) AS recall FROM sums""",
    "unblocked_people": f"""WITH RECURSIVE {SCORED}
SELECT a.s AS surname, left_rows, right_rows FROM (SELECT s, count(*) AS left_rows FROM ls WHERE born IS NULL GROUP BY s) a JOIN (SELECT s, count(*) AS right_rows FROM rs GROUP BY s) b ON a.s = b.s WHERE right_rows > 3""",
}
