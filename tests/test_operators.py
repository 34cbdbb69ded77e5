"""Operators against brute force and stated edge cases."""

import random
from bisect import bisect_left, bisect_right
from datetime import date

import pytest
from pyspark.sql import functions as F

from peerlens.functions import rates as R
from peerlens.operators import filters, identity, percentile, presets, quality, reliability, scoring, similarity
from peerlens.spec import Metric, Role, Score, check


def one(spark, expr, **row):
    names = list(row)
    kinds = {int: "long", float: "double", str: "string", date: "date", bool: "boolean"}
    schema = ", ".join(f"{n} {kinds.get(type(row[n]), 'double')}" for n in names)
    return spark.createDataFrame([tuple(row.values())], schema).select(expr).first()[0]


@pytest.mark.parametrize("total,minutes,want", [(2, 180, 1.0), (2, 0, None), (None, 90, None), (2, None, None), (0, 90, 0.0)])
def test_per90(spark, total, minutes, want):
    df = spark.createDataFrame([(total, minutes)], "t long, m long")
    assert df.select(R.per90("t", "m")).first()[0] == want


def test_denominators_fall_back_on_null_only(spark):
    df = spark.createDataFrame([(None, 10), (0, 10), (5, None)], "p long, r long")
    p, r = R.denominators("p", "r")
    assert [tuple(x) for x in df.select(p, r).collect()] == [(10, 10), (0, 10), (5, 5)]


def test_age_counts_birthdays(spark):
    assert one(spark, R.age_at("b", date(2023, 2, 28)), b=date(2000, 2, 29)) == 22
    assert one(spark, R.age_at("b", date(2023, 3, 1)), b=date(2000, 2, 29)) == 23


def test_expiry_of_unknown_and_past_dates(spark):
    df = spark.createDataFrame([(None,), (date(2024, 1, 1),), (date(2024, 3, 1),), (date(2025, 1, 1),)], "d date")
    assert [r[0] for r in df.select(R.expires_within("d", date(2024, 2, 1), 6)).collect()] == [False, False, True, False]


def test_clamp_keeps_null(spark):
    df = spark.createDataFrame([(None,), (120.0,), (-3.0,)], "v double")
    assert [r[0] for r in df.select(R.clamp(F.col("v"))).collect()] == [None, 100.0, 0.0]


def test_mid_rank_against_bisect(spark):
    rng = random.Random(5)
    rows = [(i, rng.choice("ab"), rng.choice([None, *range(8)]), rng.random() < 0.6) for i in range(200)]
    df = spark.createDataFrame([(i, g, None if v is None else float(v), m) for i, g, v, m in rows], "i long, g string, value double, m boolean")
    got = {r["i"]: (r["percentile"], r["n"]) for r in percentile.mid_rank(df, ["g"], F.col("m")).collect()}
    for i, g, v, _ in rows:
        members = sorted(x for _, h, x, m in rows if h == g and m and x is not None)
        want = None if v is None or not members else 100.0 * (bisect_left(members, v) + bisect_right(members, v)) / (2 * len(members))
        assert got[i][0] == want


def test_scoped_widens_and_refuses(spark):
    rows = [(i, "g", "big" if i < 12 else "small", float(i)) for i in range(14)] + [(99, "g", "small", None), (100, "h", "x", 1.0)]
    df = spark.createDataFrame(rows, "i long, g string, c string, value double")
    got = {r["i"]: r for r in percentile.scoped(df, ["g"], "c", F.lit(True)).collect()}
    assert (got[0]["scope"], got[0]["n"]) == ("narrow", 12)
    assert (got[13]["scope"], got[13]["n"]) == ("global", 14)
    assert got[99]["reason"] == "metric missing" and got[99]["percentile"] is None
    assert (got[100]["reason"], got[100]["n"]) == ("population too small", 1)


def test_weighted_score_renormalises_behind_its_gate(spark):
    df = spark.createDataFrame([(80.0, None), (80.0, 20.0), (None, None)], "a double, b double")
    w = {"a": 3.0, "b": 1.0}
    assert [r[0] for r in df.select(scoring.weighted(w, 1.0)).collect()] == [None, 65.0, None]
    assert [r[0] for r in df.select(scoring.weighted(w, 0.75)).collect()] == [80.0, 65.0, None]
    parts = df.select(scoring.contributions(w).alias("p")).collect()[1]["p"]
    assert [(p["part"], p["name"]) for p in parts] == [(60.0, "a"), (5.0, "b")]
    with pytest.raises(ValueError):
        scoring.coverage({})


def test_roles_validity(spark):
    role = Role("r", ("g",), {"a": 1.0, "b": 1.0}, {"core": ("b",)})
    df = spark.createDataFrame([(1, "g", 50.0, 60.0), (2, "g", 50.0, None), (3, "g", None, None), (4, "x", 1.0, 1.0)], "i long, g string, a double, b double")
    got = {r["i"]: (r["validity"], r["raw"]) for r in scoring.with_roles(df, ["i"], "g", [role]).collect()}
    assert got == {1: ("full", 55.0), 2: ("partial", 50.0), 3: ("unavailable", None)}


def test_rank_by_evidence_leaves_the_row_out(spark):
    df = spark.createDataFrame([(1, 90.0, 90), (2, 50.0, 900), (3, 40.0, 2000), (4, None, 900)], "i long, v double, m long")
    got = {r["i"]: r for r in reliability.rank_by_evidence(df, "v", "m").collect()}
    assert set(got) == {1, 2, 3}
    assert got[1]["mean"] == 45.0 and abs(got[1]["ranked"] - 49.5) < 1e-12 and got[1]["adjusted"]
    assert got[3]["ranked"] == 40.0 and not got[3]["adjusted"]


def test_similarity_over_shared_features(spark):
    names = [f"f{i}" for i in range(6)]
    rows = [(1, "g", 900, *[90.0, 10.0, 80.0, 20.0, 70.0, None]), (2, "g", 900, *[70.0, 30.0, 65.0, 35.0, 60.0, 5.0]), (3, "g", 900, *[10.0, 90.0, 20.0, 80.0, 30.0, 1.0]), (4, "g", 900, None, None, None, None, None, 1.0)]
    df = spark.createDataFrame(rows, "k long, g string, m long, " + ", ".join(f"{n} double" for n in names))
    got = similarity.similar(df, df.where("k = 1"), ["g"], "k", names, "m").collect()
    assert [r["k"] for r in got] == [2] and got[0]["shared"] == 5 and got[0]["index"] > 99.9
    assert got[0]["gaps"][0]["feature"] == "f4"


def test_null_policies(spark):
    df = spark.createDataFrame([(None, None, None, None)], "age long, market_value long, nationality string, minutes long")
    ask = lambda p, **k: df.select(filters.predicate(p, **k)).first()[0]
    assert [ask(p, age_max=30) for p in (filters.SEARCH, filters.RECRUITMENT, filters.SIMILARITY, filters.OPPORTUNITY)] == [False, False, True, False]
    assert [ask(p, value_max=5) for p in (filters.SEARCH, filters.RECRUITMENT, filters.SIMILARITY)] == [False] * 3
    assert [ask(p, value_min=1) for p in (filters.SEARCH, filters.RECRUITMENT)] == [False, True]
    assert ask(filters.SEARCH, value_min=0) and ask(filters.SIMILARITY, nationality="x") and not ask(filters.SEARCH, nationality="x")
    assert not ask(filters.SEARCH, minutes_min=1)


def test_identity_names_blocks_and_decisions(spark):
    assert identity.plain("Ødegård-Łuk  Jr.") == "odegard luk jr"
    assert identity.name_score("ann lee", "lee ann") == 0.98 and identity.name_score("ann lee", "ann lee") == 1.0
    names = spark.createDataFrame([("joao silva", "joao pedro silva"), ("pedro silva", "joao pedro silva")], "a string, b string")
    assert [r[0] for r in names.select(identity.contained(F.col("a"), F.col("b"))).collect()] == [True, False]
    a = spark.createDataFrame([(1, "ann lee", date(1990, 1, 1)), (2, "bo ray", None)], "id long, name string, born date")
    b = spark.createDataFrame([(7, "x y", date(1990, 1, 1)), (8, "an lee", date(1990, 5, 5)), (9, "z ray", date(1999, 1, 1)), (10, "q lee", None)], "id long, name string, born date")
    pairs = identity.candidates(a, b)
    assert {tuple(r) for r in pairs.collect()} == {(1, 7), (1, 8), (2, 9)}
    assert "CartesianProduct" not in pairs._jdf.queryExecution().toString() and "NestedLoop" not in pairs._jdf.queryExecution().toString()
    s = spark.createDataFrame([(1, 7, 0.95), (1, 8, 0.93), (2, 9, 0.95), (3, 9, 0.5)], "left_id long, right_id long, confidence double")
    o = spark.createDataFrame([(3, 42)], "left_id long, right_id long")
    assert {r["left_id"]: (r["status"], r["right_id"]) for r in identity.decide(s, o).collect()} == {1: ("ambiguous", None), 2: ("matched", 9), 3: ("manual", 42)}


def test_merges_refuse_collisions(spark):
    plan = spark.createDataFrame([(1, 9), (2, 9), (3, 9)], "source_id long, target_id long")
    stats = spark.createDataFrame([(1, "c", "s1"), (2, "c", "s1"), (3, "c", "s0"), (9, "c", "s0")], "entity_id long, competition_id string, season_id string")
    assert {r["source_id"]: r["refused"] for r in identity.merges(plan, stats).collect()} == {1: False, 2: True, 3: True}


def test_same_club_is_tri_state(spark):
    df = spark.createDataFrame([("inter milan", "inter milan"), ("fc ajax", "ajax"), ("fc porto", "fc lille"), ("fc", "sc fc"), (None, "x")], "a string, b string")
    assert [r[0] for r in df.select(identity.same_club(F.col("a"), F.col("b"), ["fc", "sc"])).collect()][:3] == [True, True, False]


def test_presets_and_moved_weights():
    scores = [Score("s", {"a": 1.0}), Score("t", {"a": 1.0, "b": 1.0})]
    made = presets.preset(Role("r", ("g",), {"a": 2.0, "b": 1.0, "score:s": 1.0}), scores)
    assert sum(made.values()) == 100 and all(w % 5 == 0 for w in made.values())
    assert presets.preset(Role("r", ("g",), {"z": 3.0, "a": 1.0}), scores) is None
    assert presets.moved({"s": 50, "t": 30, "u": 20}, {"s", "t"}) == {"s": 63, "t": 37}
    assert presets.impact({"b"}, scores, [Role("r", ("g",), {"score:t": 3.0, "a": 1.0})]) == {"scores": ["t"], "roles": ["r"]}


def test_definitions_are_checked():
    for bad in (lambda: Score("s", {}), lambda: Score("s", {"a": 0}), lambda: Metric("m", "t", "x"), lambda: check([Metric("m", "t")], [Score("s", {"q": 1.0})], [], set())):
        with pytest.raises(ValueError):
            bad()


def test_quality(spark):
    ledger = spark.createDataFrame([(1, 2, "r1", "r1"), (2, 1, "r1", "r1"), (3, 1, "r0", "r0")], "k long, runs_failed long, first_run string, last_run string")
    k = lambda *x: spark.createDataFrame([(i,) for i in x], "k long")
    got = {r["k"]: (r["runs_failed"], r["last_run"]) for r in quality.failure_ledger(ledger, k(1, 9), k(1, 2, 9), "k", "r2").collect()}
    assert got == {1: (3, "r2"), 3: (1, "r0"), 9: (1, "r2")}
    e = spark.createDataFrame([], "a long, b string")
    assert {r["field"]: r["null_share"] for r in quality.profile(e).collect()} == {"a": None, "b": None}
    assert not quality.publishable(e, e).first()["publish"]


def test_name_scores_pair_words_in_order():
    """Worked out by hand: the shorter name's words choose first, each the likest word left."""
    assert identity.name_score("a b", "b c d") == pytest.approx(0.55 * (0.0 + 1.0) / 2 + 0.30 * 0.0 + 0.15 * 2 / 3)
    assert identity.name_score("l farrugia", "liam farrugia") == pytest.approx(0.55 * (0.85 + 1) / 2 + 0.30 + 0.15)
    assert identity.plain("Ødegaard Þór ĦAL Ŧun") == "odegaard thor hal tun"


def test_pair_score_ladder(spark):
    from datetime import date

    day, other, year = date(1990, 1, 2), date(1990, 3, 4), date(1985, 1, 2)
    cases = [
        ("ann lee", "ann lee", day, day, None, True, 1.00), ("ann lee", "ann lee", day, day, True, None, 0.95), ("ann lee", "lee ann", day, day, None, None, 0.98),
        ("joao castilho", "joao castilho carvalho", day, day, True, True, 0.92), ("joao castilho", "joao castilho carvalho", day, day, None, True, 0.90), ("bo wu", "xi pa", day, day, True, True, None),
        ("ann lee", "ann lee", day, year, True, True, 0.30), ("ann lee", "ann lee", day, other, True, None, 0.88), ("ann lee", "ann lee", day, other, None, None, 0.75),
        ("ann lee", "ann lee", None, day, True, True, 0.85), ("ann lee", "lee ann", None, None, True, None, 0.72), ("ann lee", "ann lee", None, None, None, None, 0.65),
    ]
    df = spark.createDataFrame([(i, *c[:6]) for i, c in enumerate(cases)], "i int, left_name string, right_name string, left_born date, right_born date, same_nation boolean, same_club boolean")
    got = {r["i"]: r for r in identity.pair_scores(df).collect()}
    for i, c in enumerate(cases):
        want = min(0.70, 0.45 + 0.3 * got[i]["name_score"]) if c[6] is None else c[6]
        assert got[i]["confidence"] == pytest.approx(want), (c, got[i])


def test_undated_rows_without_a_comparison_are_told(spark):
    left = spark.createDataFrame([(1, "a smith", None), (2, "b lee", None)], "id int, name string, born date")
    right = spark.createDataFrame([(i, f"c{i} smith", None) for i in range(5)] + [(9, "d lee", None)], "id int, name string, born date")
    assert [tuple(r) for r in identity.unblocked(left, right, 4).collect()] == [("smith", 1, 5)]
    assert {r["left_id"] for r in identity.candidates(left, right, 4).collect()} == {2} and identity.candidates(left, right, 5).count() == 6


def test_similarity_filters(spark):
    from peerlens.operators import similarity

    rows = [(1, 20, 5, "x", "c1", "k", 100), (2, None, None, "y", "c2", None, 300), (3, 31, 9, "x", "c2", "k", None)]
    df = spark.createDataFrame(rows, "id int, age int, market_value int, nationality string, competition_id string, club_id string, recorded_minutes int").selectExpr("*", "25 AS target_age", "'c1' AS target_competition_id", "'k' AS target_club_id")
    ids = lambda **asked: [r["id"] for r in df.where(similarity.allowed(**asked)).orderBy("id").collect()]
    assert ids(age_min=21) == [2, 3] and ids(age_max=30) == [1, 2] and ids(value_max=8) == [1] and ids(competitions=["c2"]) == [2, 3] and ids(nationalities=["y"]) == [2]
    assert ids(other_competition=True) == [2, 3] and ids(other_club=True) == [2] and ids(younger=True) == [1, 2] and ids(recorded_min=100) == [1, 2] and ids() == [1, 2, 3]


def test_candidates_of_large_blocks_are_dealt_out_and_told_once(spark, monkeypatch):
    """Against all pairs compared one by one, with ids that several rows have, and blocks of many parts."""
    monkeypatch.setattr(identity, "BLOCK", 4)
    day = lambda i: None if i % 5 == 0 else date(1990 + i % 2, 1 + i % 3, 1)
    a = [(i % 50, f"a{i} s{i % 3}", day(i)) for i in range(60)] + [(None, "x s1", day(1)), (60, None, day(2))]
    b = [(i % 70, f"b{i} s{i % 4}", day(i)) for i in range(80)] + [(90, None, day(2)), (91, "", None)]
    last = lambda name: None if name is None else name.split(" ")[-1]
    for most in (15, 400):
        few = {s for s in map(last, (n for _, n, _ in b)) if sum(last(n) == s for _, n, _ in b) <= most}
        meet = lambda n, x, m, y: (x and x == y) or (last(n) is not None and last(n) == last(m) and ((x and y and x.year == y.year) or (not x and last(n) in few)))  # noqa: B023, E731
        want = {(i, j) for i, n, x in a for j, m, y in b if meet(n, x, m, y)}
        dfs = [spark.createDataFrame(x, "id long, name string, born date").coalesce(1) for x in (a, b)]
        got = identity.candidates(*dfs, most)
        found = [tuple(r) for r in got.collect()]
        assert len(found) == len(set(found)) and set(found) == want
        assert "SortMergeJoin [_key" in got._jdf.queryExecution().executedPlan().toString()


def test_name_scores_of_a_batch_are_those_of_pairs_one_by_one():
    """Against difflib and a plain loop over words."""
    import difflib
    import random

    def one(x, y):
        if x == y or (x[0] == y[0] and 1 in (len(x), len(y))):
            return 1.0 if x == y else identity.INITIAL
        share = difflib.SequenceMatcher(None, x, y).ratio()
        return share if share >= identity.ALIKE else share / 2

    def whole(a, b):
        p, q = a.split(), b.split()
        if not p or not q or a == b or set(p) == set(q):
            return 0.0 if not p or not q else 1.0 if a == b else 0.98
        few, many = (p, q) if len(p) <= len(q) else (q, p)
        left, got = list(range(len(many))), 0.0
        for x in few:
            score = lambda k: one(x, many[k]) if few is p else one(many[k], x)  # noqa: B023, E731
            k = max(left, key=lambda k: (score(k), -k))
            if score(k) > 0:
                left.remove(k)
                got += score(k)
        return min(0.97, 0.55 * (got / len(few)) + 0.30 * one(p[-1], q[-1]) + 0.15 * (len(few) / len(many)))

    r = random.Random(5)
    words = ["".join(r.choice("abcø") for _ in range(r.choice([1, 2, 4, 7, 9, 15, 31, 32, 33, 210]))) for _ in range(60)]
    names = [" ".join(r.choice(words) for _ in range(r.randrange(5))) for _ in range(200)]
    a, b = ([r.choice(names) for _ in range(1500)] for _ in range(2))
    assert identity._name_scores(a, b).tolist() == pytest.approx([whole(x, y) for x, y in zip(a, b, strict=True)], abs=1e-12)
    assert identity._name_scores([], []).tolist() == []


def test_decisions_need_few_pairs(spark):
    """Against a sort of all pairs; what is far under ACCEPT isn't shuffled pair by pair."""
    import random

    r = random.Random(2)
    rows = [(i % 90, r.randrange(40), r.choice([0.1, 0.3, 0.799, 0.8, 0.84, 0.85, 0.87, 0.9, 0.92, 0.95, 1.0][: 3 + i % 9])) for i in range(500)]
    rows += [(200, 1, 0.95), (200, 1, 0.95), (201, 1, 0.9), (201, 2, 0.85), (202, 1, 0.9), (202, 2, 0.86)] + [(i, j, 0.2) for i in range(300, 303) for j in range(1000)]
    want = {}
    for i in {x[0] for x in rows}:
        own = sorted(((-c, j) for k, j, c in rows if k == i))
        best, after = -own[0][0], -own[1][0] if len(own) > 1 else 0.0
        status = "unmatched" if best < 0.9 else "ambiguous" if best - after < 0.05 - 1e-9 else "matched"
        want[i] = (own[0][1] if status == "matched" else None, best, status)
    df = spark.createDataFrame(rows, "left_id long, right_id long, confidence double").coalesce(1)
    got = identity.decide(df)
    assert {x[0]: tuple(x[1:]) for x in got.collect()} == want
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert plan.count("HashAggregate") >= 2 and plan.index("Window") < plan.index("HashAggregate")
