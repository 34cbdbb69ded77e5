"""Both scopes of a percentile against counting by hand, with ties, unknown values and rows of no scope."""

import random

from pyspark.sql import functions as F

from peerlens.operators import percentile


def by_hand(rows):
    out = {}
    share = lambda v, own: 100.0 * (sum(x < v for x in own) + sum(x <= v for x in own)) / (2 * len(own))
    for k, g, c, v, member in rows:
        here = [r[3] for r in rows if c is not None and r[1] == g and r[2] == c and r[3] is not None]
        wide = [r[3] for r in rows if g is not None and r[1] == g and r[4] and r[3] is not None]
        if v is None:
            out[k] = (None, 0, None, "metric missing")
        elif len(here) >= percentile.THIN:
            out[k] = (share(v, here), len(here), "narrow", None)
        elif len(wide) >= percentile.THIN:
            out[k] = (share(v, wide), len(wide), "global", None)
        else:
            out[k] = (None, len(here), None, "population too small")
    return out


def test_scopes_against_counting(spark):
    rng = random.Random(11)
    rows = [(k, rng.choice("xyyyz"), rng.choice(["a", "a", "a", "b", "c", None]), rng.choice([None, 0.0, 0.0, 1.0, -2.5, 3.25, rng.random() * 100]), rng.random() < 0.6) for k in range(150)]
    df = spark.createDataFrame(rows, "k long, g string, c string, value double, member boolean").repartition(5)
    out = percentile.scoped(df, ["g"], "c", F.col("member"))
    got = {r["k"]: (r["percentile"], r["n"], r["scope"], r["reason"]) for r in out.collect()}
    want = by_hand(rows)
    assert {s for _, _, s, _ in want.values()} == {"narrow", "global", None}
    for k, (p, n, scope, reason) in want.items():
        assert got[k][2:] == (scope, reason) and (reason == "metric missing" or got[k][1] == n), (k, got[k], want[k])
        assert (p is None and got[k][0] is None) or abs(got[k][0] - p) < 1e-9
    assert sorted(map(repr, percentile.scoped(df.orderBy(F.desc("k")), ["g"], "c", F.col("member")).collect())) == sorted(map(repr, out.collect()))


def test_a_population_of_one_value(spark):
    df = spark.range(5000).select(F.col("id").alias("k"), F.lit("g").alias("g"), F.lit("a").alias("c"), F.lit(0.0).alias("value"))
    assert {(r["percentile"], r["n"]) for r in percentile.scoped(df, ["g"], "c", F.lit(True)).select("percentile", "n").distinct().collect()} == {(50.0, 5000)}
    assert percentile.scoped(df.limit(0), ["g"], "c", F.lit(True)).count() == 0


def test_rows_move_once_and_odd_values_keep_their_ranks(spark):
    """Against counts of smaller and equal members, with nulls, NaN, both zeros, negative values and rows that aren't members."""
    import math

    from pyspark.sql import functions as F

    from peerlens.operators.percentile import mid_rank

    values = [None, float("nan"), 0.0, -0.0, -3.5, -3.5, 1e-9, 2.0, 2.0, 2.0000001, 7e12, float("inf"), -float("inf")]
    rows = [(i, "a" if i % 4 else "b", values[i % 13], i % 3 != 0) for i in range(130)] + [(200, "c", 1.0, False), (201, None, 1.0, True), (202, "d", None, True)]
    df = spark.createDataFrame(rows, "id int, g string, value double, m boolean")
    key = lambda v: (1, 0.0) if math.isnan(v) else (0, v + 0.0)
    got = mid_rank(df, ["g"], F.col("m"))
    found = {r["id"]: r for r in got.collect()}
    assert len(found) == len(rows) and got.columns == ["id", "g", "value", "m", "percentile", "n"]
    for i, g, v, _ in rows:
        own = [key(x) for _, h, x, m in rows if h == g and m and x is not None and g is not None]
        want = None if v is None or not own else 100.0 * (sum(x < key(v) for x in own) + sum(x <= key(v) for x in own)) / (2 * len(own))
        assert found[i]["percentile"] == want, (i, g, v)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate [g" in plan and "value#" not in plan.split("Aggregate [g")[1].split("]")[0]


def test_season_totals_count_odd_rows_as_a_plain_join_does(spark, tmp_path):
    """Order numbers and customers that come twice, against a join of all rows."""
    import duckdb

    from peerlens.plans.fixture import stats

    c = duckdb.connect()
    c.sql("CREATE TABLE customer AS SELECT * FROM (VALUES (1, 'A', 5.5::DOUBLE, 3), (1, 'A', 5.5, 3), (1, 'A', 5.9, 4), (2, 'B', -1.0, 3)) t(c_custkey, c_mktsegment, c_acctbal, c_nationkey)")
    c.sql("CREATE TABLE orders AS SELECT * FROM (VALUES (10, 1, TIMESTAMP '1995-01-01', 'x'), (10, 1, TIMESTAMP '1995-03-01', 'x'), (10, 2, TIMESTAMP '1996-01-01', 'y'), (11, 1, TIMESTAMP '1995-05-05', 'x')) t(o_orderkey, o_custkey, o_orderdate, o_orderpriority)")
    c.sql("CREATE TABLE lineitem AS SELECT * FROM (VALUES (10, 3.0::DOUBLE, 0.1::DOUBLE, 'A', 'F'), (10, 4.0, 0.0, 'N', 'O'), (11, 5.0, 0.06, 'R', 'O')) t(l_orderkey, l_quantity, l_discount, l_returnflag, l_linestatus)")
    for t in ("customer", "orders", "lineitem"):
        c.sql(f"COPY {t} TO '{tmp_path}/{t}.parquet' (FORMAT parquet)")
    for place in ("o_orderpriority", "c_nationkey"):
        got = sorted(map(repr, (tuple(r[:4]) + tuple(r[4:]) for r in stats(spark, str(tmp_path), place).collect())))
        want = c.sql(f"""SELECT c_custkey, c_mktsegment, {place}::VARCHAR, year(o_orderdate)::VARCHAR, CASE WHEN c_acctbal >= 0 THEN floor(c_acctbal)::BIGINT END AS v, floor(6 * sum(l_quantity))::INT, floor(6 * sum(l_quantity) FILTER (l_linestatus = 'F'))::INT, count(DISTINCT o_orderkey), count(*),
            count(*) FILTER (l_returnflag = 'A'), count(*) FILTER (l_returnflag = 'R'), count(*) FILTER (l_discount > 0.05), count(*) FILTER (l_returnflag = 'N') FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2, 3, 4, 5""").fetchall()
        assert got == sorted(map(repr, want))
