"""Compiled metrics, coverage with reasons, nested profiles, shadows, properties of similarity and search, against hand and brute force."""

import json
import random
from datetime import date

import pytest
from pyspark.sql import functions as F

from peerlens.operators import coverage, derived, identity, profiler, search, shadow, similarity
from peerlens.plans.definitions import CATALOGUE, CATALOGUE_NAMES, ROUTING
from peerlens.spec import Derived, Role, Routing, Score

TOTALS = ["minutes", "recorded_minutes", "shots", "penalties", "goals", "saves", "conceded", "clean", "games"]


def test_metrics_over_metrics_come_in_order_and_stay_absent(spark):
    made = [
        Derived("conversion", "percentage", ("open_goals", "open_shots")),
        Derived("open_shots", "difference", ("shots", "penalties"), shown=False),
        Derived("open_goals", "floored_difference", ("goals", "penalties"), shown=False),
        Derived("faced", "sum", ("saves", "conceded")),
        Derived("save_share", "percentage", ("saves", "faced")),
        Derived("clean_share", "percentage", ("clean", "games")),
        Derived("goals_per90", "per90", ("goals",)),
        Derived("shots_per90", "per90", ("shots",)),
        Derived("open_goals_per90", "per90", ("open_goals",)),
        Derived("quality", "ratio", ("faced", "open_shots")),
    ]
    routing = Routing({"goals_per90": "playing"}, {"open_goals_per90": "playing"})
    rows = [(900, 450, 10, 2, 5, 3, 1, 2, 8), (900, None, 2, 2, 1, None, 1, 0, 0), (None, 450, 4, 0, None, 0, 0, None, 3), (0, 90, 1, 3, 2, 1, 1, 1, 1)]
    df = spark.createDataFrame(rows, ", ".join(f"{t} int" for t in TOTALS))
    names = [d.name for d in made if d.shown]
    got = [tuple(r[n] for n in names) for r in derived.derive(df, made, routing).collect()]
    assert got == [
        (100 * 3 / 8, 4, 75.0, 25.0, 0.5, 2.0, 0.3, 0.5), (None, None, None, None, 0.1, 0.2, 0.0, None), (None, 0, None, None, None, 0.8, None, 0.0), (None, 2, 50.0, 100.0, None, 1.0, None, None),
    ]
    plan = derived.derive(df, made, routing)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Project") == 1
    assert derived.inputs(made, TOTALS)["conversion"] == {"goals", "penalties", "shots"}
    assert derived.routes(made, routing) == [("goals_per90", "playing", "confirmed"), ("shots_per90", "recorded", "default"), ("open_goals_per90", "playing", "inferred")]


@pytest.mark.parametrize("bad", [
    lambda: derived.ordered([Derived("a", "sum", ("b", "x")), Derived("b", "sum", ("c", "x")), Derived("c", "sum", ("a", "x"))], ["x"]),
    lambda: derived.ordered([Derived("a", "sum", ("a", "x"))], ["x"]), lambda: derived.ordered([Derived("a", "sum", ("y", "x"))], ["x"]),
    lambda: derived.ordered([Derived("x", "sum", ("x", "y"))], ["x", "y"]), lambda: derived.ordered([Derived("a", "per90", ("x",))] * 2, ["x"]),
    lambda: Derived("a", "mean", ("x",)), lambda: Derived("a", "ratio", ("x",)), lambda: Derived("a", "sum", ("x",)), lambda: Routing({"a": "other"}), lambda: Routing({"a": "playing"}, {"a": "recorded"}),
])
def test_definitions_that_cannot_be_compiled(bad):
    with pytest.raises(ValueError):
        bad()


def test_the_catalogue():
    assert len(CATALOGUE_NAMES) == 43 and sum(d.kind == "per90" for d in CATALOGUE) == 32
    assert len(ROUTING.confirmed) == 12 and len(ROUTING.inferred) == 2 and ROUTING.of("marked_per90") == ("recorded", "default")


def test_metric_coverage_names_its_best_group_and_absent_inputs(spark):
    rows = [("g", 1, 1.0, None), ("g", None, None, None), ("h", None, None, None), ("h", 2, 2.0, None), ("h", 3, 3.0, None), (None, 4, None, None)]
    df = spark.createDataFrame(rows, "grp string, x int, m double, n double")
    got = {r["metric"]: tuple(r)[1:] for r in coverage.derived_coverage(df, ["m", "n", "x"], "grp", {"m": frozenset({"x"}), "n": frozenset({"n", "x"}), "x": frozenset()}).collect()}
    assert got["m"] == (6, 3, "h", 2 / 3, "partial", "") and got["n"] == (6, 0, None, 0.0, "absent", "n") and got["x"][:2] == (6, 4)
    assert coverage.derived_coverage(df.limit(0), ["m"], "grp").count() == 0


def test_feature_coverage_follows_what_is_absent(spark):
    scores = [Score("whole", {"a": 1.0}), Score("dead", {"gone": 2.0, "a": 1.0}), Score("thin", {"a": 1.0, "gone": 1.0}, 0.5), Score("rare", {"b": 1.0})]
    roles = [Role("x", ("g",), {"a": 1.0, "score:dead": 2.0}), Role("y", ("g", "h"), {"a": 3.0, "score:dead": 1.0}), Role("z", ("none",), {"a": 1.0})]
    rows = [("g", 50.0, None, None), ("g", 60.0, 5.0, None), ("h", 70.0, None, None)]
    from peerlens.operators.scoring import with_scores

    wide = with_scores(spark.createDataFrame(rows, "grp string, a double, b double, gone double"), scores)
    got = {r["name"]: r for r in coverage.feature_coverage(wide, "grp", scores, roles, ["a", "b", "gone"]).collect()}
    told = {n: (r["eligible"], r["produced"], r["caveated"], r["absent_components"], r["status"], r["reason"]) for n, r in got.items()}
    assert told == {
        "whole": (3, 3, 0, "", "available", ""), "dead": (3, 0, 0, "gone", "withheld", "inputs"), "thin": (3, 3, 3, "gone", "caveated", "partial"), "rare": (3, 1, 0, "", "available", "sample"),
        "x": (2, 0, 0, "score:dead", "withheld", "inputs"), "y": (3, 3, 3, "score:dead", "caveated", "partial"), "z": (0, 0, 0, "", "unknown", "sample"),
    }


# --- nested profiles


def walked(record, prefix=""):
    for k, v in record.items():
        if isinstance(v, dict):
            yield from walked(v, f"{prefix}{k}.")
        else:
            yield f"{prefix}{k}", v


def by_hand(records):
    out = {}
    for key, record in records:
        for path, v in walked(record):
            s = out.setdefault(path, {"kinds": set(), "seen": 0, "known": 0, "numbers": [], "examples": []})
            s["seen"] += 1
            kind = "null" if v is None else "bool" if isinstance(v, bool) else "list" if isinstance(v, list) else type(v).__name__
            s["kinds"].add(kind)
            s["known"] += v is not None
            if kind in ("int", "float"):
                s["numbers"].append(float(v))
            text = f"[{len(v)} items]" if kind == "list" else str(v).lower() if kind == "bool" else str(v)
            if v is not None and text:
                s["examples"].append((key, text[:60]))
    return {p: ("|".join(sorted(s["kinds"] - {"null"})) or "null", s["seen"], s["known"], min(s["numbers"], default=None), max(s["numbers"], default=None), min(s["examples"])[1] if s["examples"] else None) for p, s in out.items()}


def value(rng, depth):
    if depth and rng.random() < 0.4:
        return {rng.choice("abcd"): value(rng, depth - 1) for _ in range(rng.randrange(3))}
    return rng.choice([None, True, False, 3, -7, 2.5, "", "text", "é" * 80, [], [1, {"x": 2}], "1"])


def test_nested_profile_against_a_walk(spark):
    rng = random.Random(2)
    records = [(i, {rng.choice("abc"): value(rng, 4) for _ in range(3)}) for i in range(200)]
    df = spark.createDataFrame([(i, json.dumps(r)) for i, r in records], "key long, raw string").repartition(4).select("key", F.parse_json("raw").alias("v"))
    got = {r["path"]: (r["kinds"], r["seen"], r["known"], r["least"], r["most"], r["example"]) for r in profiler.nested_profile(df, "v", "key").collect()}
    assert got == by_hand(records) and max(p.count(".") for p in got) >= 3


def test_records_of_payloads(spark):
    payloads = [([{"a": 1}, 3, {"b": 2}], 2), ({"data": [{"a": 1}]}, 1), ({"data": {"a": 1}}, 1), ({"a": 1, "data": 5}, 1), ("x", 0), (None, 0), ([], 0), ({}, 1)]
    df = spark.createDataFrame([(i, json.dumps(p)) for i, (p, _) in enumerate(payloads)], "i int, raw string").select("i", F.size(profiler.records_of(F.parse_json("raw"))).alias("n"))
    assert {r["i"]: r["n"] for r in df.collect()} == {i: n for i, (_, n) in enumerate(payloads)}
    deep = {"a": {"b": {"c": {"d": 1}}}}
    shallow = spark.createDataFrame([(1, json.dumps(deep))], "key long, raw string").select("key", F.parse_json("raw").alias("v"))
    assert [(r["path"], r["kinds"]) for r in profiler.nested_profile(shallow, "v", "key", depth=2).collect()] == [("a.b", "object")]
    assert profiler.nested_profile(shallow.limit(0), "v", "key").count() == 0


# --- matching


def test_containment_counts_words(spark):
    pairs = [("joao silva", "joao pedro silva", True), ("pedro silva", "joao pedro silva", False), ("a b", "a b", False), ("a", "a b", False), ("a b b", "a b c d", False), ("a b b", "a b c b", True), (None, "a b", False), ("joao pedro silva", "joao silva", True)]
    df = spark.createDataFrame([(a, b) for a, b, _ in pairs], "a string, b string")
    assert [r[0] for r in df.select(identity.contained(F.col("a"), F.col("b"))).collect()] == [w for _, _, w in pairs]


def test_shadows_have_each_error_in_its_share(spark):
    rows = spark.range(4000).select(F.col("id"), F.lit("Anna Maria de Silvak").alias("name"), F.lit(date(1990, 1, 2)).alias("born"), F.lit("x").alias("nation"), F.lit("fc ajax").alias("club"))
    made = shadow.shadow(rows).cache()
    share = lambda test: made.where(test).count() / 4000
    names = {r["name"]: r["count"] / 4000 for r in made.groupBy("name").count().collect()}
    typos = sum(n for x, n in names.items() if x not in ("Anna Maria de Silvak", "Silvak Anna Maria de", "Anna Silvak", "A. Silvak", "Silvak"))
    assert 0 < typos < 0.1 and abs(names["Anna Maria de Silvak"] + typos - 0.50) < 0.04 and abs(names["Silvak Anna Maria de"] - 0.15) < 0.03 and abs(names["Anna Silvak"] - 0.15) < 0.03 and abs(names["A. Silvak"] - 0.1) < 0.03 and abs(names["Silvak"] - 0.1) < 0.03
    assert abs(share("born IS NULL") - 0.12) < 0.03 and abs(share("born = DATE'1990-01-03'") - 0.03) < 0.02 and abs(share("club IS NULL") - 0.3) < 0.04 and share("club = 'ajax'") > 0.15
    assert sorted(map(repr, made.collect())) == sorted(map(repr, shadow.shadow(rows.repartition(5)).collect()))
    assert sorted(map(repr, made.collect())) != sorted(map(repr, shadow.shadow(rows, seed=2).collect()))
    perfect = shadow.Errors(kept=1.0, swapped=0, middle_dropped=0, initial=0, typo=0, born_lost=0, born_moved=0, nation_lost=0, club_lost=0, club_short=0)
    people = rows.where("id < 50").withColumn("name", F.concat(F.lit("person "), F.col("id").cast("string"))).withColumn("born", F.date_add("born", F.col("id").cast("int") % 7))
    assert shadow.evaluate(people, {}, ["fc"], perfect).first()[:] == (50, 50, 50, 0, 0, 0, 1.0, 1.0)
    none = shadow.Errors(kept=0, swapped=0, middle_dropped=0, initial=0, typo=0, born_lost=1.0)
    got = shadow.evaluate(people, {}, ["fc"], none).first()
    assert (got["total"], got["matched"], got["precision"], got["recall"]) == (50, 0, 1.0, 0.0)
    with pytest.raises(ValueError):
        shadow.Errors(kept=0.9)


# --- similarity and search


def test_properties_of_similarity_find_faults(spark):
    rows = spark.createDataFrame([("g", 1), ("g", 2), ("g", 3), ("h", 9)], "grp string, k long")
    pairs = spark.createDataFrame([("g", 1, 2, 99.5), ("g", 2, 1, 80.0), ("g", 1, 1, 100.0), ("g", 1, 9, 101.0), ("g", 3, 1, 50.0), ("g", 1, 3, 50.0)], "grp string, target long, k long, index double")
    got = {r["property"]: (r["checked"], r["violations"]) for r in similarity.properties(pairs, rows, ["grp"], "k", 99.0).collect()}
    assert got == {"own group": (6, 1), "not itself": (6, 1), "both directions": (5, 2), "within bounds": (6, 1), "tells apart": (3, 1)}


def test_search_filters_treat_unknown_as_stated(spark):
    schema = "k long, name string, peer_group string, competition_id string, club_id string, nationality string, foot string, role string, age int, minutes long, sample_band string, market_value long, height int, contract_expires date, role_score double"
    rows = [(1, "Ann Lee", "g", "c", "k", "x", "left", "r", 20, 900, "full", 5, 180, date(2024, 6, 1), 50.0), (2, None, None, None, None, None, None, None, None, None, None, None, None, None, None), (3, "bo", "h", "d", "l", "y", "right", "s", 30, 100, "low", 50, 170, date(2023, 1, 1), 90.0)]
    df, day = spark.createDataFrame(rows, schema), date(2024, 1, 1)
    ids = lambda **a: {r["k"] for r in df.where(search.passes(today=day, **a)).collect()}
    one = [dict(text="N L"), dict(group="g"), dict(competition="c"), dict(club="k"), dict(nationality="x"), dict(foot="left"), dict(role="r"), dict(age_max=25), dict(minutes_min=200), dict(sample_band="full"), dict(value_max=10), dict(height_min=175), dict(expires=6)]
    assert all(ids(**a) == {1} for a in one) and ids(age_min=25) == ids(value_min=6) == {3} and ids(value_min=0) == ids() == ids(text="  ") == {1, 2, 3}
    pages = {s: [r["k"] for r in search.search(df, ["k"], s).collect()] for s in search.SORTS}
    assert pages == {"minutes": [1, 3, 2], "name": [2, 1, 3], "age": [1, 3, 2], "market_value": [3, 1, 2], "role_score": [3, 1, 2], "role_score_ranked": pages["role_score_ranked"]}
    assert [r["k"] for r in search.search(df, ["k"], "minutes", 1, 1).collect()] == [3]
    with pytest.raises(ValueError):
        search.search(df, ["k"], "luck")
