"""The queries of ``composites`` in SQL, written apart from the Spark plans."""

from __future__ import annotations

import re

from .oracles import ORACLES as MAIN
from .oracles import BAND, COVER, FEATURES, FITS, GROUP, LEDGER, ROLES, SIMILAR, WIDE, K, base, ranked

SAMPLE = BAND.format(v="minutes", null="'very_low'", a=900, b=450, c=180, x="full", y="limited", z="low", rest="very_low")
COVER_BAND = BAND.format(v=COVER, null="NULL", a=90, b=75, c=50, x="high", y="good", z="partial", rest="low")
OWNERS = "(VALUES ('attempts_per90', 'volume'), ('headline_per90', 'volume'), ('success_percentage', 'finish'), ('successes_per90', 'finish'), ('returns_per90', 'security'), ('success_percentage', 'security')) AS owners(metric, score)"
SCOPED = f"""scoped AS (
  SELECT {', '.join('a.' + k.strip() for k in K.split(','))}, metric, CASE WHEN a.n >= 10 THEN 'narrow' WHEN b.n >= 10 THEN 'global' END AS scope, a.n AS narrow_n, b.n AS global_n, a.percentile AS pa, b.percentile AS pb, a.value
  FROM a JOIN b USING ({K}, metric)
)"""
NATIONS = base(ranked(GROUP + ", competition_id", out="a"), ranked(GROUP, "is_primary", out="b"), SCOPED, competition="c_nationkey")


def _spread(name: str, value: str, of: str) -> str:
    return f"SELECT peer_group, {name} AS name, count({value}) AS known, round(min({value}), 6) AS least, round(median({value}), 6) AS middle, round(max({value}), 6) AS most, round(count(*) FILTER (WHERE {value} >= 90)::DOUBLE / nullif(count({value}), 0), 6) AS top_share FROM {of} GROUP BY ALL"


def _seen(kind: str, name: str, parts: dict[str, float], least: float) -> str:
    have = " + ".join(f"CASE WHEN {c} THEN {w}::DOUBLE ELSE 0.0::DOUBLE END" for c, w in parts.items())
    total = sum(parts.values())
    return f"SELECT '{kind}' AS kind, '{name}' AS name, {total}::DOUBLE AS configured, {have} AS supplied, {have} >= {least * total}::DOUBLE AS enabled FROM seen"


SEEN = f"seen AS (SELECT *, attempts_per90 AND headline_per90 AS volume, success_percentage AND successes_per90 AS finish, returns_per90 OR success_percentage AS security FROM (SELECT {', '.join(f'count({f}) > 0 AS {f}' for f in FEATURES)} FROM rates))"
CENSUS = "".join(f" UNION ALL SELECT '{f}', CASE WHEN count({t}) > 0 AND ({'count(minutes) > 0 OR count(recorded_minutes) > 0' if f.endswith('90') else 'count(attempts) > 0'}) THEN 'DERIVABLE' ELSE 'UNAVAILABLE' END FROM stats" for f, t in zip(FEATURES, ("attempts", "successes", "discounted", "returns", "headline", "successes"), strict=True))

PRESETS = """WITH parts AS (SELECT * FROM (VALUES ('runner', 'attempts_per90', 2.0), ('runner', 'headline_per90', 1.0), ('runner', 'discounted_per90', 1.0), ('finisher', 'success_percentage', 2.0),
    ('finisher', 'score:finish', 1.0), ('finisher', 'returns_per90', 1.0), ('keeper', 'score:security', 2.0), ('keeper', 'attempts_per90', 1.0)) AS t(role, part, w)),
owners AS (SELECT * FROM (VALUES ('attempts_per90', 'volume'), ('headline_per90', 'volume'), ('success_percentage', 'finish'), ('successes_per90', 'finish'), ('returns_per90', 'security'),
    ('success_percentage', 'security'), ('score:volume', 'volume'), ('score:finish', 'finish'), ('score:security', 'security')) AS t(part, score)),
shares AS (SELECT role, score, sum(w::DOUBLE / many) AS w FROM (SELECT role, part, w, score, count(*) OVER (PARTITION BY role, part) AS many FROM parts JOIN owners USING (part)) GROUP BY role, score),
whole AS (SELECT role, sum(w) AS total FROM parts GROUP BY role),
steps AS (SELECT role, score, (5 * round(w * 100 / sum(w) OVER (PARTITION BY role) / 5))::INT AS weight, sum(w) OVER (PARTITION BY role) >= 0.5 * total AS told FROM shares JOIN whole USING (role)),
placed AS (SELECT *, sum(weight) OVER (PARTITION BY role) AS got, row_number() OVER (PARTITION BY role ORDER BY weight DESC, score DESC) AS place FROM steps WHERE told AND weight > 0)
SELECT role, score, (CASE WHEN place = 1 THEN greatest(5, weight + 100 - got) ELSE weight END)::INT AS weight,
  (SELECT count(*) FROM customer WHERE (role = 'runner' AND c_mktsegment IN ('AUTOMOBILE', 'MACHINERY', 'BUILDING')) OR (role = 'finisher' AND c_mktsegment IN ('AUTOMOBILE', 'FURNITURE', 'HOUSEHOLD')) OR (role = 'keeper' AND c_mktsegment <> 'AUTOMOBILE')) AS open_to FROM placed"""


def _unit(metric: str, salt: int) -> str:
    return f"((('0x' || substr(md5(entity_key::VARCHAR || ':' || season_id || ':{metric}:{salt}'), 1, 10))::BIGINT)::DOUBLE + 0.5::DOUBLE) / 1099511627776.0::DOUBLE"


def _jitter(m: str) -> str:
    noise = f"sqrt(-2.0::DOUBLE * ln({_unit(m, 1)})) * cos(2.0::DOUBLE * pi() * {_unit(m, 2)})"
    return f"least(100.0::DOUBLE, greatest(0.0::DOUBLE, {m} * (1.0::DOUBLE + 0.03::DOUBLE * {noise}))) AS {m}"


_second = re.sub(r"\b(targets|compared|alike|similar_rows|mains)\b", r"\1_b", SIMILAR.split("\n", 1)[1])
JITTERED = f"mains_b AS (SELECT * REPLACE ({', '.join(_jitter(m) for m in FEATURES)}) FROM mains),\n" + _second + "".join(
    f""", near{x} AS (SELECT peer_group, season_id, target, entity_key FROM (
  SELECT *, row_number() OVER (PARTITION BY peer_group, season_id, target ORDER BY round(ranked_value, 6) DESC, entity_key) AS place FROM similar_rows{x} WHERE index >= 50) WHERE place <= 10)"""
    for x in ("", "_b")
) + """, nearest AS (
  SELECT peer_group, season_id, target, entity_key, count(*) AS n FROM (SELECT * FROM near UNION ALL SELECT * FROM near_b) GROUP BY ALL
)"""
STABILITY = "SELECT peer_group, season_id, target, round(count(*) FILTER (WHERE n = 2)::DOUBLE / count(*), 6) AS jaccard FROM nearest GROUP BY ALL"

ORACLES: dict[str, str] = {
    "widest_contexts": NATIONS + f"""SELECT {K}, score, w.c AS competitions, w.n AS members FROM (
      SELECT {K}, score, max({{'c': CASE WHEN scope = 'global' THEN covered ELSE 1 END, 'n': CASE WHEN scope = 'global' THEN global_n ELSE narrow_n END}}) AS w
      FROM scoped JOIN {OWNERS} USING (metric) JOIN (SELECT peer_group, season_id, count(DISTINCT competition_id) AS covered FROM stats GROUP BY ALL) USING (peer_group, season_id)
      WHERE scope IS NOT NULL AND value IS NOT NULL GROUP BY ALL)""",
    "player_summary": base() + f"""SELECT *, {SAMPLE} AS sample_band FROM (
      SELECT entity_key, n_rows, seasons, season_id, competition_id, peer_group, minutes, market_value FROM (SELECT *, count(*) OVER (PARTITION BY entity_key) AS n_rows FROM population)
      JOIN (SELECT entity_key, count(DISTINCT season_id) AS seasons FROM population GROUP BY 1) USING (entity_key) WHERE is_primary QUALIFY row_number() OVER (PARTITION BY entity_key ORDER BY season_id DESC) = 1)""",
    "player_stats": NATIONS + f"SELECT {K}, metric, CASE WHEN value IS NULL THEN NULL WHEN scope = 'narrow' THEN pa WHEN scope = 'global' THEN pb END AS percentile, CASE WHEN value IS NOT NULL THEN scope END AS scope, CASE WHEN value IS NOT NULL AND global_n >= 10 THEN pb END AS global_percentile FROM scoped",
    "player_roles": base(WIDE, ROLES, FITS) + f"""SELECT {K}, names[1] AS best, array_to_string(names[2:], ',') AS others, partial, unscored FROM (
      SELECT {K}, list(role ORDER BY round(coalesce(fit, raw), 6) DESC, role) FILTER (WHERE validity = 'full') AS names,
        coalesce(string_agg(role, ',' ORDER BY role) FILTER (WHERE validity = 'partial'), '') AS partial, coalesce(string_agg(role, ',' ORDER BY round(coverage, 6) DESC, role) FILTER (WHERE raw IS NULL), '') AS unscored
      FROM fits GROUP BY ALL)""".replace("array_to_string(names[2:], ',')", "coalesce(array_to_string(names[2:], ','), '')"),
    "player_profile": base(WIDE, ROLES, FITS) + f"""SELECT {K}, minutes, {SAMPLE} AS sample_band, {COVER_BAND} AS coverage_band, {', '.join(f'CASE WHEN minutes >= 180 THEN round({s}, 6) END AS {s}' for s in ('volume', 'finish', 'security'))},
      {' + '.join(f'coalesce({f} >= 70, FALSE)::INT' for f in FEATURES)} AS strong, {' + '.join(f'coalesce({f} <= 40, FALSE)::INT' for f in FEATURES)} AS weak, role AS best FROM scored LEFT JOIN (SELECT {K}, role FROM best) USING ({K})""",
    "comparison_caveats": base() + "SELECT season_id, count(*) AS compared, count(DISTINCT peer_group) > 1 AS mixed_groups, count(DISTINCT competition_id) > 1 AS mixed_competitions FROM (SELECT * FROM stats QUALIFY row_number() OVER (PARTITION BY season_id ORDER BY minutes DESC, entity_key, competition_id) <= 5) GROUP BY season_id",
    "score_distributions": base(WIDE, ROLES)
    + " UNION ALL ".join([_spread("'percentile:' || metric", "o", "oriented"), *[_spread(f"'score:{s}'", s, "scored") for s in ("volume", "finish", "security")], _spread("'role:' || role", "v", "(SELECT peer_group, role, CASE WHEN validity = 'full' THEN raw END AS v FROM roles)")]),
    "source_purge": "SELECT c_custkey, c_mktsegment FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders GROUP BY 1 HAVING count(*) FILTER (WHERE o_orderpriority = '5-LOW') = count(*))",
    "ownership_checks": """SELECT check_name, CASE WHEN NOT bad THEN 'pass' WHEN check_name IN ('orphan', 'discrepant') THEN 'warn' ELSE 'fail' END AS status, record_count FROM (
      SELECT *, record_count > 0 AS bad FROM (
        SELECT 'stranded source' AS check_name, count(*) AS record_count FROM (VALUES ('1-URGENT'), ('2-HIGH'), ('9-NONE')) AS v(s) WHERE s NOT IN (SELECT o_orderpriority FROM orders)
        UNION ALL SELECT 'orphan', count(*) FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)
        UNION ALL SELECT 'duplicate', count(*) FROM (SELECT 1 FROM orders GROUP BY o_orderpriority, o_orderkey HAVING count(*) > 1)
        UNION ALL SELECT 'dangling', count(*) FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders))
      UNION ALL SELECT 'discrepant', count(*) FILTER (WHERE o_orderstatus = 'P'), count(*) > 0 AND count(*) FILTER (WHERE o_orderstatus = 'P') >= 0.1::DOUBLE * count(*) FROM orders)""",
    "context_checks": """WITH r AS (SELECT l_suppkey, c_nationkey, s_nationkey, l_shipdate::DATE AS ends FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey)
      SELECT 'several countries' AS check_name, CASE WHEN count(*) > 0 THEN 'warn' ELSE 'pass' END AS status, count(*) AS record_count FROM (SELECT 1 FROM r GROUP BY l_suppkey HAVING count(DISTINCT c_nationkey) > 1)
      UNION ALL SELECT 'outside home', CASE WHEN count(*) > 0 THEN 'warn' ELSE 'pass' END, count(*) FROM r WHERE c_nationkey <> s_nationkey
      UNION ALL SELECT 'past end', CASE WHEN count(ends) > 0 AND count(*) FILTER (WHERE ends < DATE '1998-03-01') >= 0.25::DOUBLE * count(ends) THEN 'warn' ELSE 'pass' END, count(*) FILTER (WHERE ends < DATE '1998-03-01') FROM r""",
    "publication_ledger": "SELECT user_id, event_type, coalesce(min(event_id) FILTER (WHERE ts < TIMESTAMP '2024-01-10'), min(event_id)) AS event_id FROM events GROUP BY 1, 2",
    "staging_equality": "SELECT unnest(['reloaded', 'changed', 'twice']) AS candidate, unnest([count(*), count(*), count(*) + 1]) AS staged_rows, count(*) AS served_rows, unnest([TRUE, FALSE, FALSE]) AS equal FROM orders",
    "similar_filtered": base(WIDE, SIMILAR.replace("c.entity_key <> t.entity_key", "c.entity_key <> t.entity_key AND c.market_value <= 8000 AND c.competition_id <> t.competition_id AND coalesce(c.recorded_minutes, 0) >= 120"))
    + "SELECT peer_group, season_id, target, place::INTEGER AS place, entity_key, shared, CASE WHEN shared / 6.0::DOUBLE >= 0.85::DOUBLE THEN 'high' WHEN shared / 6.0::DOUBLE >= 0.65::DOUBLE THEN 'good' WHEN shared >= 3 THEN 'limited' ELSE 'very limited' END AS band, round(index, 6) AS index, round(ranked_value, 6) AS ranked FROM (SELECT *, row_number() OVER (PARTITION BY peer_group, season_id, target ORDER BY round(ranked_value, 6) DESC, entity_key) AS place FROM similar_rows WHERE index >= 50) WHERE place <= 10",
    "repointed_orders": f"SELECT CASE WHEN refused = FALSE THEN target_id ELSE o_custkey END AS o_custkey, count(*) AS n_orders FROM orders LEFT JOIN ({MAIN['identity_merges']}) ON o_custkey = source_id GROUP BY 1",
    "identity_evaluation": f"""SELECT found, "right", round("right"::DOUBLE / nullif(found, 0), 6) AS precision, round("right"::DOUBLE / nullif(n, 0), 6) AS recall FROM (
      SELECT count(right_id) AS found, count(*) FILTER (WHERE right_id = true_id) AS "right", count(*) AS n FROM (SELECT o_custkey AS left_id, min(o_orderkey) AS true_id FROM orders WHERE (floor(o_totalprice)::BIGINT % 200 + 800)::DOUBLE / 1000 >= 0.95::DOUBLE GROUP BY 1)
      LEFT JOIN ({MAIN['identity_decisions']}) USING (left_id))""",
    "role_presets": PRESETS,
    "similarity_stability": base(WIDE, SIMILAR, JITTERED) + STABILITY,
    "provider_status": f"""WITH {LEDGER}, l AS (SELECT source, {', '.join(f"strftime(max(ran) FILTER (WHERE {t}), '%Y-%m-%d %H:%M') AS {n}" for t, n in (("context = 'PUBLISHED'", 'published'), ('context IS NULL', 'loaded'), ("context = 'CANDIDATE'", 'attempted')))}, count(*) FILTER (WHERE context = 'CANDIDATE' AND status = 'fail') AS failed FROM ledger GROUP BY source)
      SELECT source, published, loaded, attempted, coalesce(failed, 0) AS failed FROM l FULL JOIN (VALUES ('click'), ('silent')) AS p(source) USING (source)""",
    "volumes": " UNION ALL ".join(f"SELECT '{t}' AS entity, count(*) AS n_rows FROM {t}" for t in ("supplier", "part", "lineitem", "customer", "orders"))
    + " UNION ALL SELECT 'valued', count(*) FROM customer WHERE c_acctbal >= 0 UNION ALL SELECT 'served', count(*) FROM customer WHERE c_acctbal >= 0 AND c_custkey IN (SELECT o_custkey FROM orders)",
    "name_resolution": """WITH p AS (SELECT DISTINCT event_type || '.count_' || k AS path FROM (SELECT event_type, unnest(json_keys(props)) AS k FROM events))
      SELECT 'count_k' AS name, CASE WHEN count(*) > 0 THEN 'AVAILABLE' ELSE 'UNAVAILABLE' END AS status, NULL AS candidates FROM p WHERE path LIKE '%.count_k'
      UNION ALL SELECT 'view_count', 'UNCLEAR', array_to_string(list(path ORDER BY path)[1:6], ',') FROM p UNION ALL SELECT 'minutes', 'UNAVAILABLE', NULL""",
    "weight_report": base(SEEN) + " UNION ALL ".join([
        _seen("score", "volume", {"attempts_per90": 3.0, "headline_per90": 2.0}, 1.0), _seen("score", "finish", {"success_percentage": 2.0, "successes_per90": 1.0}, 1.0), _seen("score", "security", {"returns_per90": 1.0, "success_percentage": 1.0}, 0.5),
        _seen("role", "runner", {"attempts_per90": 2.0, "headline_per90": 1.0, "discounted_per90": 1.0}, 0.5), _seen("role", "finisher", {"success_percentage": 2.0, "finish": 1.0, "returns_per90": 1.0}, 0.5), _seen("role", "keeper", {"security": 2.0, "attempts_per90": 1.0}, 0.5),
    ]),
    "metric_census": base() + " UNION ALL ".join(f"SELECT '{t}' AS metric, CASE WHEN count({t}) > 0 THEN '{'VERIFIED' if t in ('attempts', 'returns') else 'AVAILABLE'}' ELSE 'UNAVAILABLE' END AS status FROM stats" for t in ("attempts", "successes", "discounted", "returns", "headline")) + CENSUS,
    "check_report": base() + "SELECT '| season_stats | ' || n || ' | ' || CASE WHEN r >= f THEN 'fail' WHEN r >= 1 THEN 'warn' ELSE 'pass' END || ' | ' || r || ' |' AS line FROM (" + " UNION ALL ".join(
        f"SELECT '{n}' AS n, count(*) FILTER (WHERE {t}) AS r, {f} AS f FROM stats" for n, t, f in (("recorded_beyond_played", "recorded_minutes > minutes", 100), ("minutes_beyond_appearances", "minutes > appearances * 120", 1000000), ("value_unknown", "market_value IS NULL", 1000000), ("negative_minutes", "minutes < 0", 1)))
    + ") UNION ALL SELECT '| entity | check_name | status | record_count |' UNION ALL SELECT '|---|---|---|---|'",
    "club_countries": "SELECT s_suppkey, n_name AS competition, r_name AS country FROM supplier LEFT JOIN (SELECT * FROM nation LEFT JOIN region ON n_regionkey = r_regionkey WHERE n_nationkey % 7 <> 0) ON s_nationkey = n_nationkey",
    "canonical_records": base() + f"SELECT {K}, greatest(attempts - returns, 0) AS unreturned, CASE WHEN recorded_minutes IS NOT NULL THEN greatest(minutes - recorded_minutes, 0) END AS unrecorded, successes + returns AS taken FROM stats",
}
