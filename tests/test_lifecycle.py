"""Ownership, publications, names and definitions on small rows with nulls, repeats and empty tables."""

from pyspark.sql import functions as F

from peerlens.operators import lifecycle as L
from peerlens.spec import Metric, Role, Score


def test_purge_keeps_what_others_share(spark):
    dim = spark.createDataFrame([(1,), (2,), (3,), (4,)], "id int")
    bridge = spark.createDataFrame([(1, "a"), (1, "b"), (2, "a"), (2, "a"), (3, None)], "id int, source string")
    assert sorted(r.id for r in L.purge(dim, bridge, "id", "source", "a").collect()) == [1, 3, 4]
    assert L.purge(dim, bridge.limit(0), "id", "source", "a").count() == 4


def test_publishing_twice_adds_nothing(spark):
    ledger = spark.createDataFrame([("r1", 1)], "run string, n int")
    batch = spark.createDataFrame([("r1", 9), ("r2", 5), ("r2", 4)], "run string, n int")
    once = L.publish(ledger, batch, ["run"], "n")
    assert sorted(map(tuple, once.collect())) == [("r1", 1), ("r2", 4)]
    assert sorted(map(tuple, L.publish(once, batch, ["run"], "n").collect())) == [("r1", 1), ("r2", 4)]


def test_same_rows_counts_repeats_and_ignores_order(spark):
    a = spark.createDataFrame([(1, "x"), (1, "x"), (2, None)], "n int, s string")
    assert L.same_rows(a, a.orderBy(F.desc("n")), ["n", "s"]).first().equal
    assert not L.same_rows(a, a.distinct(), ["n", "s"]).first().equal
    assert L.same_rows(a.limit(0), a.limit(0), ["n", "s"]).first().equal


def test_names_are_available_unclear_or_unavailable(spark):
    paths = spark.createDataFrame([("d.shots",), ("shots_total",), ("d.Shots.blocked",)], "path string")
    names = spark.createDataFrame([("shots",), ("total",), ("goals",)], "name string")
    got = {r.name: (r.status, r.candidates) for r in L.resolve_names(paths, names).collect()}
    assert got == {"shots": ("AVAILABLE", None), "total": ("UNCLEAR", "shots_total"), "goals": ("UNAVAILABLE", None)}
    assert {r.status for r in L.resolve_names(paths.limit(0), names).collect()} == {"UNAVAILABLE"}


def test_a_lost_score_supplies_nothing_to_its_role(spark):
    wide = spark.createDataFrame([(1.0, None), (None, None)], "a double, b double")
    got = {r.name: (r.supplied, r.enabled) for r in L.supplied_weights(wide, [Score("s", {"a": 1.0, "b": 1.0}), Score("t", {"a": 2.0})], [Role("r", ("g",), {"score:s": 3.0, "score:t": 1.0})]).collect()}
    assert got == {"s": (1.0, False), "t": (2.0, True), "r": (1.0, False)}


def test_census(spark):
    rows = spark.createDataFrame([(90, None, 1, None, None)], "minutes int, recorded_minutes int, shots int, goals int, blocks int")
    got = dict(map(tuple, L.census(rows, [Metric("s90", "shots"), Metric("g90", "goals"), Metric("rate", "shots", "ratio", "blocks")], ["shots"]).collect()))
    assert got == {"shots": "VERIFIED", "goals": "UNAVAILABLE", "s90": "DERIVABLE", "g90": "UNAVAILABLE", "rate": "UNAVAILABLE"}


def test_ownership_of_empty_tables_passes(spark):
    bridge = spark.createDataFrame([], "source string, source_id int, entity_id int, bad boolean")
    got = L.ownership(spark.createDataFrame([], "entity_id int"), bridge, spark.createDataFrame([], "source_id int"), ["x"], F.col("bad")).collect()
    assert {r.check_name: r.status for r in got} == {"stranded source": "fail", "orphan": "pass", "duplicate": "pass", "dangling": "pass", "discrepant": "pass"}


def test_contexts_of_an_empty_table_pass(spark):
    rows = spark.createDataFrame([], "club int, country int, home int, ends date")
    assert {(r.status, r.record_count) for r in L.contexts(rows, "club", "country", "home", "ends", F.current_date()).collect()} == {("pass", 0)}


def test_markdown_escapes_bars(spark):
    df = spark.createDataFrame([("a|b", None)], "x string, y int")
    assert L.markdown(df).first().line == "| a\\|b | - |"
    assert [r.line for r in L.markdown_head(spark, ["x", "y"]).collect()] == ["| x | y |", "|---|---|"]
