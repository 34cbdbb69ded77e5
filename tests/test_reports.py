"""Quantiles, lists, presets, feature sets and documents, by hand."""

import statistics

import numpy as np
import pytest
from pyspark.sql import functions as F

from peerlens.operators import lifecycle, lists, percentile, presets, scoring
from peerlens.sources.writers import csv_document
from peerlens.spec import FeatureSets


def test_quantiles_are_exact_and_no_group_meets_in_one_task(spark):
    rng = np.random.default_rng(3)
    rows = [("a", float(x)) for x in rng.choice([0.0, 1.0, 1.5, -2.0, 7.25, 1e9], 999)] + [("b", float(x)) for x in rng.normal(size=1000)] + [("c", None)] * 5 + [("d", 4.0), (None, 1.0), (None, 2.0)]
    df = spark.createDataFrame(rows, "g string, value double").repartition(5)
    out = percentile.quantiles(df, ["g"], {"middle": 0.5, "high": 0.99, "low": 0.0, "top": 1.0})
    plan = out._jdf.queryExecution().toString()
    assert "percentile(" not in plan and "median(" not in plan and "collect_list" not in plan
    for r in out.collect():
        own = [v for g, v in rows if g == r["g"] and v is not None]
        assert r["known"] == len(own)
        if own:
            assert r["middle"] == pytest.approx(statistics.median(own)) and r["high"] == pytest.approx(np.quantile(own, 0.99))
            assert (r["low"], r["top"], r["least"], r["most"]) == (min(own), max(own), min(own), max(own))
        else:
            assert r["middle"] is None and r["most"] is None


def test_lists_keep_what_is_missing_and_refuse_strangers(spark):
    entries = spark.createDataFrame([(1, k, f"n{k}", 10 - k) for k in range(8)] + [(2, 1, None, 1)], "list_id int, k long, note string, place int")
    view = spark.createDataFrame([(k, 100 * k) for k in range(0, 8, 2)], "k long, minutes long")
    got = {(r["list_id"], r["k"]): (r["note"], r["minutes"], r["state"]) for r in lists.resolved(entries, view, "k").collect()}
    assert len(got) == 9 and got[1, 4] == ("n4", 400, "ok") and got[1, 3] == ("n3", None, "missing") and got[2, 1] == (None, None, "missing")
    with pytest.raises(ValueError):
        lists.resolved(entries, view.withColumn("note", F.lit("x")), "k")
    first = {(r["list_id"], r["k"]): r["refused"] for r in lists.compared(entries, view, "k", ["list_id"]).collect()}
    assert first == {(1, 7): "missing", (1, 6): None, (1, 5): "missing", (1, 4): None, (1, 3): "missing", (2, 1): "missing"}
    ask = lambda rows: {(r["list_id"], r["k"]): r["refused"] for r in lists.compared(entries, view, "k", ["list_id"], spark.createDataFrame(rows, "list_id int, k long")).collect()}
    assert ask([(1, 2), (1, 2), (2, 4)]) == {(1, 2): None, (2, 4): "not listed"}
    assert set(ask([(1, k) for k in range(6)]).values()) == {"too many"}


def test_measured_presets(spark):
    rows = [("x", "a", 60, True), ("x", "b", 40, False), ("y", "a", 100, True), ("z", "b", 50, False), ("z", "c", 50, True), ("w", "a", 90, True), ("w", "b", 10, False)]
    got = {r["role"]: tuple(r)[1:] for r in presets.measured(spark.createDataFrame(rows, "role string, score string, weight int, ok boolean"), "role", "score", "weight", "ok").collect()}
    assert got == {"x": (0.6, "limited", "b", "a:60,b:40"), "y": (1.0, "full", "", "a:100"), "z": (0.5, "minimal", "b", "b:50,c:50"), "w": (0.9, "full", "b", "a:90,b:10")}
    assert [presets.measurability(x) for x in (1.0, 0.85, 0.6, 0.5)] == ["full", "full", "limited", "minimal"]


def test_weights_are_checked_and_normalised():
    assert scoring.normalised({"a": 3, "b": 1, "c": 0}, "abc") == {"a": 0.75, "b": 0.25}
    for bad in ({"x": 1}, {"a": 0}, {}, {"a": -1, "b": 2}, {"a": float("nan")}):
        with pytest.raises(ValueError):
            scoring.normalised(bad, "abc")


def test_feature_sets_are_checked():
    names = tuple("abcdef")
    assert FeatureSets({"g": names}, frozenset(names), frozenset({"g"})).groups["g"] == names
    for groups in ({"g": names[:4]}, {"g": (*names[:4], "a")}, {"g": (*names, "z")}, {"h": names}, {"g": names, "h": names}):
        with pytest.raises(ValueError):
            FeatureSets(groups, frozenset(names), frozenset({"g"}))


def test_documents_have_a_mark_a_head_and_an_order(spark):
    df = spark.createDataFrame([(2, "=x"), (None, 'q"'), (1, None)], "k long, t string").repartition(3)
    got = [r["line"] for r in csv_document(df, ["k"]).orderBy("place").collect()]
    assert got == ['﻿"k","t"', '"","q"""', '"1",""', '"2","\'=x"']


def test_universe_tells_why_rows_are_left_out(spark):
    dimension = spark.createDataFrame([(1, "g"), (2, None), (3, "g")], "k long, grp string")
    facts = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c"), (9, "d")], "k long, f string")
    got = sorted((r["k"], r["f"], r["state"]) for r in lifecycle.universe(dimension, facts, "k", "grp").na.fill("").collect())
    assert got == [(1, "a", "read"), (1, "b", "read"), (2, "c", "entity without group"), (3, "", "entity without fact"), (9, "d", "fact without entity")]
