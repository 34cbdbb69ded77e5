"""The same queries in SQL, written apart from the Spark plans."""

from __future__ import annotations

STATS = """stats AS (
  SELECT c_custkey AS entity_key, c_mktsegment AS peer_group, CAST({competition} AS VARCHAR) AS competition_id, CAST(year(o_orderdate) AS VARCHAR) AS season_id,
    CASE WHEN c_acctbal >= 0 THEN CAST(floor(c_acctbal) AS BIGINT) END AS market_value, CAST(floor(6 * sum(l_quantity)) AS INTEGER) AS minutes,
    CAST(floor(6 * sum(l_quantity) FILTER (WHERE l_linestatus = 'F')) AS INTEGER) AS recorded_minutes, count(DISTINCT o_orderkey) AS appearances, count(*) AS attempts,
    count(*) FILTER (WHERE l_returnflag = 'A') AS successes, count(*) FILTER (WHERE l_returnflag = 'R') AS returns,
    count(*) FILTER (WHERE l_discount > 0.05::DOUBLE) AS discounted, count(*) FILTER (WHERE l_returnflag = 'N') AS headline
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey GROUP BY ALL
)"""
RATES = """rates AS (
  SELECT *, CASE WHEN r > 0 THEN attempts * 90.0::DOUBLE / r END AS attempts_per90, CASE WHEN r > 0 THEN successes * 90.0::DOUBLE / r END AS successes_per90,
    CASE WHEN r > 0 THEN discounted * 90.0::DOUBLE / r END AS discounted_per90, CASE WHEN r > 0 THEN returns * 90.0::DOUBLE / r END AS returns_per90,
    CASE WHEN p > 0 THEN headline * 90.0::DOUBLE / p END AS headline_per90, CASE WHEN attempts > 0 THEN successes * 100.0::DOUBLE / attempts END AS success_percentage
  FROM (SELECT *, coalesce(recorded_minutes, minutes) AS r, coalesce(minutes, recorded_minutes) AS p FROM stats)
)"""
POPULATION = """population AS (
  SELECT *, row_number() OVER (PARTITION BY entity_key, season_id ORDER BY coalesce(minutes, 0) DESC, competition_id DESC) = 1 AS is_primary FROM rates
)"""
NAMES = "attempts_per90, successes_per90, discounted_per90, returns_per90, headline_per90, success_percentage"
LONG = f"""long AS (
  SELECT entity_key, peer_group, competition_id, season_id, is_primary, metric, value FROM (
    SELECT entity_key, peer_group, competition_id, season_id, is_primary, unnest([{', '.join(f"{{'metric': '{n}', 'value': {n}}}" for n in NAMES.split(', '))}], recursive := true) FROM population)
)"""
GROUP = "metric, peer_group, season_id"


def ranked(by: str, member: str = "TRUE", out: str = "ranked", of: str = "long", extra: str = "") -> str:
    """Mid-ranks by counting with windows over all rows, members only."""
    c = f"CASE WHEN value IS NOT NULL AND ({member}) THEN 1 END"
    return f"""{out} AS (
  SELECT *, CASE WHEN value IS NOT NULL AND n > 0 THEN 100.0::DOUBLE * (2 * le - eq) / (2 * n) END AS percentile FROM (
    SELECT *, count({c}) OVER (PARTITION BY {by}) AS n, count({c}) OVER (PARTITION BY {by}, value) AS eq,
      count({c}) OVER (PARTITION BY {by} ORDER BY value NULLS LAST RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS le FROM {of})
)"""


def base(*ctes: str, competition: str = "o_orderpriority") -> str:
    return "WITH " + ",\n".join([STATS.format(competition=competition), RATES, POPULATION, LONG, *ctes]) + "\n"


K = "entity_key, peer_group, competition_id, season_id"
WIDE = ranked(GROUP, "is_primary") + f""", oriented AS (
  SELECT {K}, metric, CASE WHEN n >= 10 THEN CASE WHEN metric = 'returns_per90' THEN 100.0::DOUBLE - percentile ELSE percentile END END AS o FROM ranked
), wide AS (
  SELECT {K}, {', '.join(f"max(o) FILTER (WHERE metric = '{n}') AS {n}" for n in NAMES.split(', '))} FROM oriented GROUP BY ALL
), scored AS (
  SELECT w.*, p.minutes, p.recorded_minutes, p.market_value, p.is_primary,
    least(100.0::DOUBLE, (3.0::DOUBLE * w.attempts_per90 + 2.0::DOUBLE * w.headline_per90) / 5.0::DOUBLE) AS volume,
    least(100.0::DOUBLE, (2.0::DOUBLE * w.success_percentage + w.successes_per90) / 3.0::DOUBLE) AS finish,
    CASE WHEN w.returns_per90 IS NULL THEN w.success_percentage WHEN w.success_percentage IS NULL THEN w.returns_per90 ELSE (w.returns_per90 + w.success_percentage) / 2.0::DOUBLE END AS security
  FROM wide w JOIN population p USING ({K})
)"""


def _role(name: str, groups: str, parts: dict[str, float], core: str) -> str:
    total = sum(parts.values())
    have = " + ".join(f"CASE WHEN {c} IS NOT NULL THEN {w}::DOUBLE ELSE 0.0::DOUBLE END" for c, w in parts.items())
    got = " + ".join(f"coalesce({w}::DOUBLE * {c}, 0.0::DOUBLE)" for c, w in parts.items())
    return f"SELECT {K}, minutes, market_value, is_primary, '{name}' AS role, ({have}) AS have, ({have}) / {total}::DOUBLE AS coverage, ({got}) AS got, ({core}) AS met FROM scored WHERE peer_group IN ({groups})"


ROLES = "roles AS (SELECT *, CASE WHEN raw IS NULL THEN 'unavailable' WHEN met THEN 'full' ELSE 'partial' END AS validity FROM (SELECT *, CASE WHEN coverage >= 0.5::DOUBLE THEN got / have END AS raw FROM (" + " UNION ALL ".join([
    _role("runner", "'AUTOMOBILE', 'MACHINERY', 'BUILDING'", {"attempts_per90": 2.0, "headline_per90": 1.0, "discounted_per90": 1.0}, "attempts_per90 IS NOT NULL AND (headline_per90 IS NOT NULL OR discounted_per90 IS NOT NULL)"),
    _role("finisher", "'AUTOMOBILE', 'FURNITURE', 'HOUSEHOLD'", {"success_percentage": 2.0, "finish": 1.0, "returns_per90": 1.0}, "success_percentage IS NOT NULL"),
    _role("keeper", "'BUILDING', 'HOUSEHOLD', 'MACHINERY', 'FURNITURE'", {"security": 2.0, "attempts_per90": 1.0}, "returns_per90 IS NOT NULL"),
]) + ")))"
FITS = (
    "fit_values AS (SELECT *, CASE WHEN validity = 'full' THEN round(raw, 6) END AS value FROM roles),\n"
    + ranked("role, season_id", out="fit_ranked", of="fit_values")
    + """, fits AS (SELECT * EXCLUDE (percentile), CASE WHEN n >= 10 THEN percentile END AS fit FROM fit_ranked),
best AS (
  SELECT * FROM (SELECT *, coalesce(fit, raw) AS standing, row_number() OVER (PARTITION BY entity_key, peer_group, competition_id, season_id ORDER BY coalesce(fit, raw) DESC, role) AS rn FROM fits WHERE validity = 'full') WHERE rn = 1
)"""
)


def shrink(value: str, by: str, of: str, out: str = "shrunk") -> str:
    over = f"PARTITION BY {by}" if by else ""
    return f"""{out} AS (
  SELECT *, mean + weight * ({value} - mean) AS ranked_value FROM (
    SELECT *, CASE WHEN count(*) OVER ({over}) > 1 THEN (sum({value}) OVER ({over}) - {value}) / (count(*) OVER ({over}) - 1) ELSE {value} END AS mean,
      CASE WHEN minutes > 0 THEN least(1.0::DOUBLE, minutes / 900.0::DOUBLE) ELSE 0.0::DOUBLE END AS weight FROM {of} WHERE {value} IS NOT NULL)
)"""


TODAY = "DATE '1998-03-01'"
FEATURES = NAMES.split(", ")
_d = " + ".join(f"coalesce((c.{f} - 50.0::DOUBLE) * (t.{f} - 50.0::DOUBLE), 0.0::DOUBLE)" for f in FEATURES)
_n = {x: " + ".join(f"CASE WHEN c.{f} IS NOT NULL AND t.{f} IS NOT NULL THEN ({x}.{f} - 50.0::DOUBLE) * ({x}.{f} - 50.0::DOUBLE) ELSE 0.0::DOUBLE END" for f in FEATURES) for x in "ct"}
SIMILAR = f"""mains AS (SELECT * FROM scored WHERE is_primary),
targets AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY peer_group, season_id ORDER BY minutes DESC, entity_key) AS rn FROM mains) WHERE rn = 1),
compared AS (
  SELECT c.peer_group, c.season_id, t.entity_key AS target, c.entity_key, c.minutes, {' + '.join(f"(c.{f} IS NOT NULL AND t.{f} IS NOT NULL)::INT" for f in FEATURES)} AS shared,
    {' + '.join(f"(t.{f} IS NOT NULL)::INT" for f in FEATURES)} AS own, {_d} AS dot, sqrt({_n['t']}) AS nt, sqrt({_n['c']}) AS nc,
    [{', '.join(f"abs((t.{f} - 50.0::DOUBLE) - (c.{f} - 50.0::DOUBLE))" for f in FEATURES)}] AS gaps
  FROM mains c JOIN targets t ON c.peer_group = t.peer_group AND c.season_id = t.season_id AND c.entity_key <> t.entity_key
), alike AS (
  SELECT *, greatest(0.0::DOUBLE, least(1.0::DOUBLE, CASE WHEN nt > 0 AND nc > 0 THEN dot / (nt * nc) ELSE 0.0::DOUBLE END)) * 100.0::DOUBLE AS index,
    CASE WHEN nt = 0 AND nc = 0 THEN 1.0::DOUBLE ELSE least(nt, nc) / greatest(nt, nc) END AS strength FROM compared WHERE shared >= 5 AND own >= 5
), """ + shrink("index", "peer_group, season_id, target", "alike", "similar_rows")
LEDGER = """ledger AS (
  SELECT event_id, event_type AS source, date_trunc('hour', ts) AS ran, CASE WHEN user_id % 7 = 0 THEN 'fail' WHEN user_id % 3 = 0 THEN 'warn' ELSE 'pass' END AS status,
    CASE WHEN user_id % 2 = 0 THEN 'CANDIDATE' WHEN user_id % 5 = 0 THEN 'PUBLISHED' END AS context FROM events
)"""
BAND = "CASE WHEN {v} IS NULL THEN {null} WHEN {v} >= {a} THEN '{x}' WHEN {v} >= {b} THEN '{y}' WHEN {v} >= {c} THEN '{z}' ELSE '{rest}' END"
COVER = "CASE WHEN minutes > 0 THEN recorded_minutes * 100.0::DOUBLE / minutes END"
HIGHLIGHT = "SELECT {k}, '{kind}' AS kind, place, metric, o AS percentile FROM (SELECT *, row_number() OVER (PARTITION BY {k} ORDER BY o {way}, metric) AS place FROM marked WHERE {test}) WHERE place <= {n}"
OWN = "((role = 'runner' AND metric IN ('attempts_per90', 'headline_per90', 'discounted_per90')) OR (role = 'finisher' AND metric IN ('success_percentage', 'returns_per90')) OR (role = 'keeper' AND metric = 'attempts_per90'))"

ORACLES: dict[str, str] = {
    "season_totals": base() + "SELECT * FROM stats",
    "derived_rates": base() + f"SELECT {K}, {NAMES} FROM rates",
    "exposure_bands": base() + f"SELECT {K}, {COVER} AS coverage, {BAND.format(v=COVER, null='NULL', a=90, b=75, c=50, x='high', y='good', z='partial', rest='low')} AS coverage_band, {BAND.format(v='minutes', null=chr(39) + 'very_low' + chr(39), a=900, b=450, c=180, x='full', y='limited', z='low', rest='very_low')} AS sample_band, greatest(nullif(minutes, 0), nullif(recorded_minutes, 0)) AS rateable, coalesce(recorded_minutes > minutes, FALSE) AS inconsistent FROM stats",
    "calendar": f"SELECT o_orderkey, CAST(1998 - year(o_orderdate) - CASE WHEN month(o_orderdate) * 100 + day(o_orderdate) > 301 THEN 1 ELSE 0 END AS INTEGER) AS age, CAST((year(o_orderdate) - 1998) * 12 + month(o_orderdate) - 3 AS INTEGER) AS months, o_orderdate::DATE >= {TODAY} AND (year(o_orderdate) - 1998) * 12 + month(o_orderdate) - 3 <= 6 AS expiring, o_orderdate::DATE < {TODAY} AS lapsed FROM orders",
    "consistency": base() + f"SELECT {K}, array_to_string(list_filter([CASE WHEN successes > returns THEN 'successes ' || successes || ' exceeds returns ' || returns END, CASE WHEN discounted > headline THEN 'discounted ' || discounted || ' exceeds headline ' || headline END], lambda x: x IS NOT NULL), '; ') AS errors, CASE WHEN successes <= returns THEN successes END AS successes, CASE WHEN successes <= returns THEN returns END AS returns, CASE WHEN discounted <= headline THEN discounted END AS discounted, CASE WHEN discounted <= headline THEN headline END AS headline FROM stats",
    "availability": base() + f"SELECT {K}, string_agg(CASE WHEN value IS NOT NULL THEN metric END, ',' ORDER BY list_position([{', '.join(repr(n) for n in FEATURES)}], metric)) AS available, count(value)::DOUBLE / 6 AS completeness FROM long GROUP BY {K}",
    "primary_rows": base() + f"SELECT {K}, minutes, is_primary FROM population",
    "percentiles_competition": base(ranked(GROUP + ", competition_id")) + f"SELECT {K}, metric, percentile, CASE WHEN value IS NULL THEN 0 ELSE n END AS n FROM ranked",
    "percentiles_global": base(ranked(GROUP, "is_primary")) + f"SELECT {K}, metric, percentile, CASE WHEN value IS NULL THEN 0 ELSE n END AS n FROM ranked",
    "percentiles_league_group": base(ranked(GROUP, "is_primary AND competition_id IN ('1-URGENT', '2-HIGH')")) + f"SELECT {K}, metric, percentile FROM ranked",
    "percentiles_widened": base(ranked(GROUP + ", competition_id", out="a"), ranked(GROUP, "is_primary", out="b"), competition="c_nationkey")
    + f"""SELECT {K}, metric, p AS percentile, CASE WHEN value IS NULL THEN 0 WHEN an < 10 AND bn >= 10 THEN bn ELSE an END AS n, scope, CASE WHEN value IS NULL THEN 'metric missing' WHEN scope IS NULL THEN 'population too small' END AS reason,
      CASE WHEN metric = 'returns_per90' THEN 100.0::DOUBLE - p ELSE p END AS oriented
    FROM (SELECT {', '.join('a.' + k.strip() for k in K.split(','))}, a.metric, a.value, a.n AS an, b.n AS bn, CASE WHEN a.value IS NULL THEN NULL WHEN a.n >= 10 THEN 'narrow' WHEN b.n >= 10 THEN 'global' END AS scope,
      CASE WHEN a.n >= 10 THEN a.percentile WHEN b.n >= 10 THEN b.percentile END AS p FROM a JOIN b USING ({K}, metric))""",
    "z_scores": base() + f"SELECT {K}, metric, round(CASE WHEN count(value) OVER w >= 2 AND stddev_pop(value) OVER w > 0 THEN (value - avg(value) OVER w) / stddev_pop(value) OVER w END, 6) AS z FROM long WINDOW w AS (PARTITION BY {GROUP})",
    "maturity": base("units AS (SELECT peer_group, season_id, competition_id, count(*) AS c, max(coalesce(greatest(nullif(minutes, 0), nullif(recorded_minutes, 0)), 0)) AS most FROM stats GROUP BY ALL)")
    + "SELECT *, units > 1 AND share < 0.5::DOUBLE AS early_season FROM (SELECT peer_group, season_id, count(*) AS units, count(*) FILTER (WHERE most >= 900) AS established, coalesce(sum(c) FILTER (WHERE most >= 900), 0)::DOUBLE / sum(c)::DOUBLE AS share, list_sort(list(most))[count(*) // 2 + 1] AS median_most, string_agg(competition_id, ',' ORDER BY competition_id) AS covered FROM units GROUP BY ALL)",
    "composite_scores": base(WIDE) + f"""SELECT {K}, round(volume, 6) AS volume, round(finish, 6) AS finish, round(security, 6) AS security, ((attempts_per90 IS NOT NULL)::INT * 3 + (headline_per90 IS NOT NULL)::INT * 2)::DOUBLE / 5 AS coverage,
      round(greatest(a, h), 6) AS largest_part, CASE WHEN a IS NULL AND h IS NULL THEN NULL WHEN a IS NULL THEN 'headline_per90' WHEN h IS NULL THEN 'attempts_per90' WHEN greatest(a, h) < 0.4::DOUBLE * (a + h) THEN NULL WHEN h >= a THEN 'headline_per90' ELSE 'attempts_per90' END AS dominant
    FROM (SELECT *, attempts_per90 * 3.0::DOUBLE / (3 + 2 * (headline_per90 IS NOT NULL)::INT) AS a, headline_per90 * 2.0::DOUBLE / (2 + 3 * (attempts_per90 IS NOT NULL)::INT) AS h FROM scored)""",
    "unproducible_scores": base() + "SELECT 'volume' AS score, count(attempts_per90) > 0 AND count(headline_per90) > 0 AS producible FROM rates UNION ALL SELECT 'finish', count(success_percentage) > 0 AND count(successes_per90) > 0 FROM rates UNION ALL SELECT 'security', count(returns_per90) > 0 OR count(success_percentage) > 0 FROM rates",
    "role_scores": base(WIDE, ROLES) + f"SELECT {K}, role, round(raw, 6) AS raw, round(coverage, 6) AS coverage, validity, CASE WHEN round(coverage, 9) >= 0.95::DOUBLE THEN 'complete' WHEN round(coverage, 9) >= 0.75::DOUBLE THEN 'good' ELSE 'limited' END AS band FROM roles",
    "role_fit": base(WIDE, ROLES, FITS) + f"SELECT {K}, role, validity, fit FROM fits",
    "best_roles": base(WIDE, ROLES, FITS) + f"SELECT {K}, role, standing FROM best",
    "shrunk_ranking": base(WIDE, "mains AS (SELECT * FROM scored WHERE is_primary)", shrink("volume", "peer_group, season_id", "mains")) + "SELECT entity_key, peer_group, season_id, round(volume, 6) AS raw, round(mean, 6) AS mean, round(weight, 6) AS weight, round(ranked_value, 6) AS ranked FROM shrunk",
    "recruitment": base(WIDE, "kept AS (SELECT *, least(100.0::DOUBLE, (60.0::DOUBLE * volume + 40.0::DOUBLE * finish) / 100.0::DOUBLE) AS raw FROM scored WHERE is_primary AND coalesce(minutes, 0) >= 180 AND (market_value IS NULL OR market_value >= 100))", shrink("raw", "season_id", "kept"))
    + "SELECT season_id, place::INTEGER AS place, entity_key, peer_group, round(raw, 6) AS raw, round(ranked_value, 6) AS ranked, round(CASE WHEN market_value IS NOT NULL THEN greatest(0.0::DOUBLE, least(1.0::DOUBLE, 1.0::DOUBLE - market_value / 5000.0::DOUBLE)) * 100.0::DOUBLE END, 6) AS market_fit FROM (SELECT *, row_number() OVER (PARTITION BY season_id ORDER BY round(ranked_value, 6) DESC, entity_key) AS place FROM shrunk) WHERE place <= 25",
    "opportunity_funnel": base() + 'SELECT season_id, count(*) AS "all", count(*) FILTER (WHERE minutes >= 450) AS minutes_ok, count(*) FILTER (WHERE minutes >= 450 AND market_value <= 5000) AS value_ok, count(*) FILTER (WHERE minutes >= 450 AND market_value <= 5000 AND recorded_minutes >= 180) AS recorded_ok, count(*) FILTER (WHERE minutes >= 450 AND market_value <= 5000 AND recorded_minutes >= 180 AND success_percentage >= 30) AS rated_ok FROM population WHERE is_primary GROUP BY season_id',
    "opportunities": base(WIDE, ROLES, FITS, "mains AS (SELECT * EXCLUDE (raw), round(raw, 6) AS raw FROM (SELECT * FROM (SELECT *, coalesce(fit, raw) AS st, row_number() OVER (PARTITION BY entity_key, peer_group, competition_id, season_id ORDER BY coalesce(fit, raw) DESC, role) AS rn2 FROM fits WHERE validity = 'full' AND is_primary) WHERE rn2 = 1))")
    + "SELECT season_id, place::INTEGER AS place, entity_key, role, raw, round(r, 6) AS ranked FROM (SELECT *, row_number() OVER (PARTITION BY season_id ORDER BY round(r, 6) DESC, entity_key) AS place FROM (SELECT *, prior + CASE WHEN minutes > 0 THEN least(1.0::DOUBLE, minutes / 900.0::DOUBLE) ELSE 0 END * (raw - prior) AS r FROM mains, (SELECT avg(raw) AS prior FROM mains) WHERE minutes >= 450 AND market_value <= 5000)) WHERE place <= 20",
    "player_search": base() + "SELECT entity_key, season_id, peer_group, minutes, market_value FROM population WHERE is_primary AND coalesce(minutes, 0) >= 300 AND coalesce(market_value, 0) >= 1 AND market_value <= 8000 ORDER BY minutes DESC, entity_key, season_id LIMIT 50",
    "similar_profiles": base(WIDE, SIMILAR) + f"SELECT peer_group, season_id, target, place::INTEGER AS place, entity_key, shared, round(index, 6) AS index, round(strength, 6) AS strength, round(ranked_value, 6) AS ranked, [{', '.join(repr(f) for f in FEATURES)}][list_position(gaps, list_min(gaps))] AS closest FROM (SELECT *, row_number() OVER (PARTITION BY peer_group, season_id, target ORDER BY round(ranked_value, 6) DESC, entity_key) AS place FROM similar_rows WHERE index >= 50) WHERE place <= 20",
    "replacements": base(WIDE, ROLES, FITS, SIMILAR, """fit_of AS (SELECT entity_key, season_id, coalesce(fit, raw) AS role_fit FROM (SELECT *, row_number() OVER (PARTITION BY entity_key, season_id ORDER BY coalesce(fit, raw) DESC, role) AS rn3 FROM fits WHERE validity = 'full' AND is_primary) WHERE rn3 = 1),
parts AS (
  SELECT s.peer_group, s.season_id, s.target, s.entity_key, s.minutes, s.index, f.role_fit, CASE WHEN m.market_value IS NOT NULL THEN greatest(0.0::DOUBLE, least(1.0::DOUBLE, 1.0::DOUBLE - m.market_value / 5000.0::DOUBLE)) * 100.0::DOUBLE END AS afford
  FROM similar_rows s LEFT JOIN fit_of f USING (entity_key, season_id) JOIN mains m USING (entity_key, season_id) WHERE s.index >= 50
), whole AS (
  SELECT *, role_fit IS NOT NULL AND afford IS NOT NULL AS complete, (0.55::DOUBLE * index + coalesce(role_fit * 0.30::DOUBLE, 0) + coalesce(afford * 0.15::DOUBLE, 0)) / (0.55::DOUBLE + CASE WHEN role_fit IS NOT NULL THEN 0.30::DOUBLE ELSE 0 END + CASE WHEN afford IS NOT NULL THEN 0.15::DOUBLE ELSE 0 END) AS overall FROM parts
)""", shrink("overall", "peer_group, season_id, target, complete", "whole"))
    + "SELECT peer_group, season_id, target, place::INTEGER AS place, entity_key, complete, round(overall, 6) AS overall, round(ranked_value, 6) AS ranked FROM (SELECT *, row_number() OVER (PARTITION BY peer_group, season_id, target ORDER BY complete DESC, round(ranked_value, 6) DESC, entity_key) AS place FROM shrunk) WHERE place <= 10",
    "embedding_neighbours": "SELECT label, vec_id, place::INTEGER AS place, other, cosine FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY cosine DESC, other) AS place FROM (SELECT a.label, a.vec_id, b.vec_id AS other, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS cosine FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id <> b.vec_id)) WHERE place <= 3",
    "compared_leaders": base(f"five AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY peer_group, season_id ORDER BY minutes DESC, entity_key) AS rn FROM (SELECT entity_key, peer_group, season_id, sum(minutes) AS minutes, {', '.join(f'max({n}) AS {n}' for n in FEATURES)} FROM rates GROUP BY ALL)) WHERE rn <= 5)", f"tall AS (SELECT peer_group, season_id, entity_key, unnest([{', '.join(f'''{{'metric': '{n}', 'value': {n}}}''' for n in FEATURES)}], recursive := true) FROM five)")
    + "SELECT peer_group, season_id, metric, min(entity_key) AS leader FROM (SELECT *, max(g) OVER (PARTITION BY peer_group, season_id, metric) AS top, count(*) OVER (PARTITION BY peer_group, season_id, metric) AS c FROM (SELECT *, CASE WHEN metric = 'returns_per90' THEN -value ELSE value END AS g FROM tall WHERE value IS NOT NULL)) WHERE g = top AND c >= 2 GROUP BY peer_group, season_id, metric HAVING count(*) = 1",
    "metric_coverage": base() + "SELECT metric, peer_group, n_rows, known, known::DOUBLE / n_rows AS share, CASE WHEN known = 0 THEN 'absent' WHEN known::DOUBLE / n_rows < 0.5::DOUBLE THEN 'sparse' WHEN known::DOUBLE / n_rows < 0.95::DOUBLE THEN 'partial' ELSE 'complete' END AS status FROM (SELECT metric, NULL AS peer_group, count(*) AS n_rows, count(value) AS known FROM long GROUP BY metric UNION ALL SELECT metric, peer_group, count(*), count(value) FROM long GROUP BY metric, peer_group)",
    "mean_coverage": base() + f"SELECT competition_id, round(avg(least(100.0::DOUBLE, c)), 6) AS mean_coverage, count(*) FILTER (WHERE recorded_minutes > minutes) AS beyond FROM (SELECT *, {COVER} AS c FROM stats WHERE recorded_minutes IS NOT NULL) GROUP BY competition_id",
    "field_profile": " UNION ALL ".join(f"SELECT '{c}' AS field, count(*) AS n_rows, count({c}) AS known, count(DISTINCT {c}) AS kinds, min({c})::VARCHAR AS least, max({c})::VARCHAR AS most, 1.0::DOUBLE - count({c})::DOUBLE / count(*) AS null_share FROM customer" for c in ("c_custkey", "c_name", "c_nationkey", "c_mktsegment")),
    "identity_coverage": "SELECT *, CASE WHEN manual THEN 'manual' WHEN confidence < 0.9::DOUBLE THEN 'ambiguous' WHEN sources > 1 THEN 'matched' ELSE 'single' END AS status FROM (SELECT o_custkey, count(DISTINCT o_orderpriority) AS sources, min((floor(o_totalprice)::BIGINT % 100 + 900)::DOUBLE / 1000) AS confidence, bool_or(o_orderkey % 97 = 0) AS manual FROM orders GROUP BY o_custkey)",
    "identity_by_competition": "SELECT o_orderpriority, count(DISTINCT o_custkey) AS entities, count(DISTINCT c_custkey) AS linked FROM orders LEFT JOIN (SELECT c_custkey FROM customer WHERE c_acctbal >= 0) ON o_custkey = c_custkey GROUP BY 1",
    "ledger_freshness": f"WITH {LEDGER} SELECT *, age_days > 7 AS stale FROM (SELECT l.source, strftime(max(l.ran), '%Y-%m-%d %H:%M') AS last_run, count(*) FILTER (WHERE status = 'fail') AS failed, count(*) FILTER (WHERE status = 'warn') AS warned, date_diff('day', max(l.ran)::DATE, DATE '2024-02-03') AS age_days FROM ledger l JOIN (SELECT source, max(ran) AS m FROM ledger GROUP BY source) x ON l.source = x.source AND l.ran = x.m GROUP BY l.source)",
    "latest_checks": f"WITH {LEDGER} SELECT source, event_id, status FROM (SELECT *, rank() OVER (PARTITION BY source ORDER BY ran DESC) AS r FROM ledger) WHERE r = 1",
    "served_fingerprint": f"WITH {LEDGER} SELECT count(*) AS n_rows, strftime(max(ran), '%Y-%m-%d %H:%M') AS latest FROM ledger WHERE context IS DISTINCT FROM 'CANDIDATE'",
    "candidate_checks": f"WITH {LEDGER} SELECT c.source, event_id, status FROM (SELECT *, rank() OVER (PARTITION BY source ORDER BY ran DESC) AS r FROM ledger WHERE context = 'CANDIDATE') c LEFT JOIN (SELECT source, max(ran) AS p FROM ledger WHERE context = 'PUBLISHED' GROUP BY source) p USING (source) WHERE r = 1 AND (p IS NULL OR ran > p)",
    "orphans": "SELECT c_custkey, c_nationkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)",
    "referenced_nations": "SELECT n_nationkey, n_name FROM nation WHERE n_nationkey IN (SELECT s_nationkey FROM supplier)",
    "duplicate_lines": "SELECT l_orderkey, l_linenumber, count(*) AS copies FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1",
    "loader_checks": base() + "SELECT 'season_stats' AS entity, check_name, CASE WHEN record_count >= f THEN 'fail' WHEN record_count >= 1 THEN 'warn' ELSE 'pass' END AS status, record_count FROM (SELECT 'recorded_beyond_played' AS check_name, count(*) FILTER (WHERE recorded_minutes > minutes) AS record_count, 100 AS f FROM stats UNION ALL SELECT 'minutes_beyond_appearances', count(*) FILTER (WHERE minutes > appearances * 120), 1000000 FROM stats UNION ALL SELECT 'value_unknown', count(*) FILTER (WHERE market_value IS NULL), 1000000 FROM stats UNION ALL SELECT 'negative_minutes', count(*) FILTER (WHERE minutes < 0), 1 FROM stats)",
    "quarantine": base() + f"SELECT {K}, concat_ws(',', CASE WHEN minutes > appearances * 400 THEN 'minutes' END, CASE WHEN market_value > 9000 THEN 'value' END) AS refused FROM stats",
    "value_history": "SELECT o_custkey, row_number() OVER (PARTITION BY o_custkey ORDER BY v DESC NULLS LAST, o_orderkey)::INTEGER AS place, o_orderkey, strftime(v, '%Y-%m-%d') AS valued_on, o_totalprice AS amount FROM (SELECT *, CASE WHEN o_orderkey % 11 <> 0 THEN o_orderdate::DATE END AS v FROM orders)",
    "pruned_history": "SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_discount > 0.08::DOUBLE)",
    "csv_export": """SELECT '"' || p_partkey || '","' || CASE WHEN p_size % 5 = 0 THEN '''=' ELSE '' END || p_name || '","' || printf('%.1f', p_retailprice) || '"' AS line FROM part""",
    "reference_lists": base() + "SELECT DISTINCT 'competition' AS kind, competition_id AS name FROM stats UNION SELECT 'season', season_id FROM stats UNION SELECT 'group', peer_group FROM stats",
    "highlights": base(WIDE, ROLES, FITS, f"marked AS (SELECT o.*, b.role FROM oriented o JOIN best b USING ({K}) WHERE o IS NOT NULL)")
    + " UNION ALL ".join([HIGHLIGHT.format(k=K, kind="strength", way="DESC", test="o >= 70", n=4), HIGHLIGHT.format(k=K, kind="watch-out", way="ASC", test=f"o <= 40 AND {OWN}", n=4), HIGHLIGHT.format(k=K, kind="driver", way="DESC", test=f"o >= 70 AND {OWN}", n=2)]).replace("place, metric", "place::INTEGER AS place, metric"),
    "inert_ranking": base(WIDE, "mains AS (SELECT * FROM scored WHERE is_primary)", shrink("volume", "", "mains")) + "SELECT bool_and(round(ranked_value, 1) = round(volume, 1)) AND count(*) >= 2 AS inert FROM shrunk",
    "denominators": base() + "SELECT *, CASE WHEN by_playing > 0 AND by_recorded = 0 THEN 'playing' WHEN by_recorded > 0 AND by_playing = 0 THEN 'recorded' ELSE 'unclear' END AS verdict FROM (" + " UNION ALL ".join(
        f"SELECT '{t}' AS metric, count(*) FILTER (WHERE far AND abs({t} * 90.0::DOUBLE / nullif(minutes, 0) - pub) <= 0.011::DOUBLE) AS by_playing, count(*) FILTER (WHERE far AND abs({t} * 90.0::DOUBLE / nullif(recorded_minutes, 0) - pub) <= 0.011::DOUBLE) AS by_recorded FROM (SELECT *, abs(minutes - recorded_minutes) >= 45 AS far, CASE WHEN {m} > 0 THEN round({t} * 90.0::DOUBLE / {m}, 2) END AS pub FROM stats)" for t, m in (("attempts", "minutes"), ("returns", "recorded_minutes"))) + ")",
    "promotion_guard": "SELECT a AS candidate_rows, b AS served_rows, a > 0 AND a >= 0.75::DOUBLE * b AS publish FROM (SELECT (SELECT count(*) FROM orders) AS a, (SELECT count(*) FROM lineitem) AS b)",
    "json_fields": "SELECT path, count(*) AS seen, count(v) AS known, count(DISTINCT v) AS kinds FROM (SELECT unnest(json_keys(props)) AS path, props FROM events) , LATERAL (SELECT json_extract_string(props, '$.' || path) AS v) GROUP BY path",
    "identity_candidates": """WITH r AS (SELECT c_custkey AS id, 's' || (c_custkey % 41) AS s, CASE WHEN c_custkey % 10 <> 0 THEN DATE '1980-01-01' + CAST(c_custkey * 37 % 9000 AS INTEGER) END AS born, c_nationkey < 12 AS l FROM customer),
small AS (SELECT s FROM r WHERE NOT l GROUP BY s HAVING count(*) <= 400)
SELECT DISTINCT a.id AS left_id, b.id AS right_id FROM r a JOIN r b ON a.l AND NOT b.l AND (a.born = b.born OR (a.s = b.s AND (year(a.born) = year(b.born) OR (a.born IS NULL AND a.s IN (SELECT s FROM small)))))""",
    "identity_decisions": """WITH s AS (SELECT o_custkey AS left_id, o_orderkey AS right_id, (floor(o_totalprice)::BIGINT % 200 + 800)::DOUBLE / 1000 AS confidence FROM orders),
b AS (SELECT *, lead(confidence) OVER w AS runner_up, row_number() OVER w AS rn FROM s WINDOW w AS (PARTITION BY left_id ORDER BY confidence DESC, right_id)),
o AS (SELECT o_custkey AS left_id, min(o_orderkey) AS manual FROM orders WHERE o_orderkey % 97 = 0 GROUP BY 1),
j AS (SELECT *, CASE WHEN confidence < 0.9::DOUBLE THEN 'unmatched' WHEN confidence - coalesce(runner_up, 0) < 0.05::DOUBLE - 1e-9 THEN 'ambiguous' ELSE 'matched' END AS found FROM b LEFT JOIN o USING (left_id) WHERE rn = 1)
SELECT left_id, CASE WHEN manual IS NOT NULL THEN manual WHEN found = 'matched' THEN right_id END AS right_id, CASE WHEN manual IS NOT NULL THEN 1.0::DOUBLE ELSE confidence END AS confidence, CASE WHEN manual IS NOT NULL THEN 'manual' ELSE found END AS status FROM j""",
    "identity_merges": """WITH s AS (SELECT o_custkey AS e, o_orderpriority AS c, strftime(o_orderdate::DATE, '%Y-%m') AS y FROM orders),
p AS (SELECT c_custkey AS source_id, c_custkey - c_custkey % 4 AS target_id FROM customer WHERE c_custkey % 4 <> 0),
own AS (SELECT p.*, c, y, rank() OVER (PARTITION BY target_id, c, y ORDER BY source_id) AS r FROM p JOIN s ON source_id = e),
bad AS (SELECT DISTINCT source_id FROM own LEFT JOIN (SELECT DISTINCT e, c, y FROM s) h ON h.e = own.target_id AND h.c = own.c AND h.y = own.y WHERE r > 1 OR h.e IS NOT NULL)
SELECT source_id, target_id, source_id IN (SELECT source_id FROM bad) AS refused FROM p""",
    "distribution_profile": base() + "SELECT peer_group, metric, count(value) AS known, round(min(value), 6) AS least, round(median(value), 6) AS middle, round(quantile_cont(value, 0.99), 6) AS high, round(max(value), 6) AS most FROM long GROUP BY ALL",
    "unscored_roles": base(WIDE, ROLES) + f"SELECT {K}, role, round(0.5::DOUBLE - coverage, 6) AS shortfall FROM roles WHERE raw IS NULL",
    "shortlist_counts": "SELECT c_custkey, count(o_orderkey) AS entries, strftime(max(o_orderdate)::DATE, '%Y-%m-%d') AS latest FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey",
    "hourly_events": "SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M') AS hour, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL",
}
