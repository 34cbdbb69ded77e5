"""Ranks that are sent to rows, against ranks that rows are moved for; best roles and highlights that move a row once at most."""

import random

import pytest
from pyspark.sql import functions as F

from peerlens.operators import percentile, reading, scoring, similarity

DATA = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_ranks_of_several_columns_are_those_of_each(spark):
    rng = random.Random(5)
    odd = [None, float("nan"), 0.0, -0.0, 1.5, -2.25, float("inf"), 3.0]
    rows = [(i, rng.choice(["x", "y", None]), rng.choice([True, True, False, None]), rng.choice(odd), rng.choice([*odd, rng.random()])) for i in range(300)]
    df = spark.createDataFrame([*rows, (300, "z", False, 1.0, None)], "_row long, g string, m boolean, `a:1` double, b double")
    few = percentile.mid_ranks(df, "_row", ["g"], ["a:1", "b"], F.col("m"))
    many = percentile.mid_ranks(df, "_row", ["g"], ["a:1", "b"], F.col("m"), sent=0)
    assert few.columns == many.columns == [*df.columns, "a:1:rank", "a:1:n", "b:rank", "b:n"]
    assert "hashpartitioning" not in plan(few) and "hashpartitioning" in plan(many)  # where values are few, no row moves
    got = sorted(map(repr, few.collect()))
    assert got == sorted(map(repr, many.collect())) and len(got) == 301
    for c in ("a:1", "b"):
        want = percentile.mid_rank(df.select("_row", "g", "m", F.col(f"`{c}`").alias("value")), ["g"], F.col("m")).select("_row", "percentile", "n")
        assert sorted(map(repr, map(tuple, want.collect()))) == sorted(map(repr, map(tuple, few.select("_row", f"`{c}:rank`", f"`{c}:n`").collect())))


def test_best_role_of_a_row_is_that_of_the_window(spark):
    rng = random.Random(6)
    one = lambda name: rng.choice([None, (name, rng.choice([10.0, 20.0, 30.0]), rng.choice(["full", "full", "partial"]), rng.choice([None, 0.0, 50.0, 90.0]))])
    kind = "struct<role:string,raw:double,validity:string,fit:double>"
    df = spark.createDataFrame([(i, one("p"), one("q"), one("r")) for i in range(200)], f"i int, p {kind}, q {kind}, r {kind}")
    long = df.select("i", F.explode(F.array_compact(F.array("p", "q", "r"))).alias("r")).select("i", "r.*")
    want = scoring.best_role(long, ["i"]).select("i", "role", "raw", "fit", "standing")
    got = df.select("i", scoring.best_of(["p", "q", "r"]).alias("b")).where("b IS NOT NULL").select("i", "b.role", "b.raw", "b.fit", "b.standing")
    assert "Exchange" not in plan(got) and sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, map(tuple, want.collect())))


def test_highlights_of_all_kinds_move_together(spark):
    values = {"a": 95.0, "b": 95.0, "c": 80.0, "d": 72.0, "e": 71.0, "f": 12.0, "g": 3.0, "h": None}
    df = spark.createDataFrame([(1, "k", m, v) for m, v in values.items()], "i int, role string, metric string, oriented double")
    out = reading.highlights(df, ["i"], {"k": ["b", "c", "e", "f"]}, "role")
    assert plan(out).count("hashpartitioning") == 1
    got = sorted((r["kind"], r["place"], r["metric"], r["percentile"]) for r in out.collect())
    assert got == [("driver", 1, "b", 95.0), ("driver", 2, "c", 80.0), ("strength", 1, "a", 95.0), ("strength", 2, "b", 95.0), ("strength", 3, "c", 80.0), ("strength", 4, "d", 72.0), ("watch-out", 1, "f", 12.0)]


def test_highlights_of_rows_are_those_of_metrics_and_move_nothing(spark):
    rng = random.Random(7)
    names = ["d", "a", "c", "b", "f", "e"]
    value = lambda: rng.choice([None, 0.0, 12.0, 40.0, 41.0, 69.5, 70.0, 70.0, 95.0, 100.0])
    df = spark.createDataFrame([(i, rng.choice(["k", "l", "m", None]), *[value() for _ in names]) for i in range(300)], "i int, role string, " + ", ".join(f"{n} double" for n in names))
    own = {"k": ["b", "c", "e"], "l": ["a"]}
    long = df.unpivot(["i", "role"], names, "metric", "oriented")
    for context in ((), ("a", "e")):
        want = reading.highlights(long, ["i"], own, "role", 3, context)
        got = reading.highlights_of_rows(df, ["i"], names, own, "role", 3, context)
        assert got.columns == want.columns and "Exchange" not in plan(got)
        assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, map(tuple, want.collect())))


def test_highlights_of_customers_that_share_a_number(spark, tmp_path):
    from peerlens.plans.registry import ORACLES, QUERIES

    con = pytest.importorskip("duckdb").connect()
    for t in ("customer", "orders", "lineitem"):
        df = spark.read.parquet(f"{DATA}/{t}.parquet")
        if t == "customer":
            df = df.union(df.where("c_custkey % 5 = 0").withColumn("c_acctbal", F.col("c_acctbal") + 700))
        df.coalesce(1).write.parquet(f"{tmp_path}/{t}.parquet")
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
    norm = lambda rows: sorted(repr([round(x, 6) if isinstance(x, float) else x for x in r]) for r in rows)
    got = QUERIES["highlights"](spark, str(tmp_path))
    names = con.execute(ORACLES["highlights"]).description
    want = con.execute(ORACLES["highlights"]).fetchall()
    assert norm(map(tuple, got.select(*[n[0] for n in names]).collect())) == norm(want) and want


def test_comparison_by_arithmetic_is_that_of_vectors(spark, monkeypatch):
    rng = random.Random(8)
    one = lambda: [rng.choice([None, 0.0, -0.0, 50.0, rng.uniform(-50, 50)]) for _ in range(5)]
    df = spark.createDataFrame([(i, one(), one()) for i in range(300)], "i int, a array<double>, b array<double>")
    wide = df.select("*", *[F.get(v, F.lit(i)).alias(f"{v}{i}") for v in "ab" for i in range(5)])
    names = [[f"{v}{i}" for i in range(5)] for v in "ab"]
    want = df.select("i", similarity.compare(F.col("a"), F.col("b")).alias("m")).select("i", "m.*")
    for plain in (16, 4):
        monkeypatch.setattr(similarity, "PLAIN", plain)
        got = similarity.compared(wide, *names).select("i", "_shared", "_cosine", "_strength")
        assert ("lambda" in plan(got)) == (plain < 5)
        assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, map(tuple, want.collect())))


def test_candidates_do_not_move_to_their_targets(spark):
    names = ["a", "b", "c", "d", "e"]
    df = spark.range(400).selectExpr("id AS k", "id % 3 AS g", "1000 AS m", *[f"cast((id * {7 + i}) % 101 AS double) AS {n}" for i, n in enumerate(names)])
    out = similarity.similar(df, df.where("k < 3"), ["g"], "k", names, "m")
    assert "hashpartitioning" not in plan(out) and out.count() > 0  # neither to targets nor to sums


def test_best_roles_are_found_without_writing_scores_or_roles(spark, monkeypatch):
    from peerlens.plans import queries
    from peerlens.sources import shared

    names = []
    for module in (queries, percentile):
        monkeypatch.setattr(module, "written", lambda df, name: names.append(name) or shared.written(df, name))
    best = queries.with_best(queries.scored_rows(spark, DATA))
    assert names == ["numbered", "kinds", "ranks", "kinds", "ranks"]
    want = scoring.best_role(queries._fits(queries.scored_wide(spark, DATA)), queries.KEYS).select(*queries.KEYS, "role", "raw", "fit", "standing")
    got = best.where("best IS NOT NULL").select(*queries.KEYS, "best.role", "best.raw", "best.fit", "best.standing")
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, map(tuple, want.collect())))
