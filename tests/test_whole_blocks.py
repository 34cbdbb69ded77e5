"""Rows without a date are compared with all of their surname, however many have it."""

from datetime import date

import duckdb
import pytest

from peerlens.operators import identity, shadow
from peerlens.plans import matching


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Documents whose third word is one for most of them, more than MAX_BLOCK."""
    d = tmp_path_factory.mktemp("people")
    rows = [(i, f"w{i % 7} {'ab' * (i % 3)}x{i % 5} {'attion' if i % 30 else f'o{i % 90}'} and more", ["en", "fr", None][i % 3], ["s", "t"][i % 2]) for i in range(460)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").coalesce(1).write.parquet(f"{d}/documents.parquet")
    return str(d)


def want(folder, name):
    c = duckdb.connect()
    c.sql(f"CREATE VIEW documents AS SELECT * FROM '{folder}/documents.parquet/*.parquet'")
    return c.sql(matching.ORACLES[name]).fetchall()


def test_pairs_of_a_common_surname_are_all_scored(spark, folder, monkeypatch):
    monkeypatch.setattr(identity, "ROWS", 64)
    own = matching.people(spark, folder)
    undated = {r["id"] for r in shadow.shadow(own).where("born IS NULL AND name LIKE '%attion'").collect()}
    everyone = {r["id"] for r in own.where("name LIKE '%attion'").collect()}
    got = [tuple(r) for r in matching.identity_pair_scores(spark, folder).collect()]
    assert undated and len(everyone) > identity.MAX_BLOCK and {(i, j) for i in undated for j in everyone} <= {r[:2] for r in got}
    told = lambda rows: sorted((*r[:2], round(r[2], 6), round(r[3], 5), r[4]) for r in rows)
    assert told(got) == told(want(folder, "identity_pair_scores"))


def test_kinds_of_parts_and_ids_that_several_rows_have(spark, monkeypatch):
    """Against all pairs compared one by one, with kinds and surnames of many parts."""
    monkeypatch.setattr(identity, "ROWS", 3)
    monkeypatch.setattr(identity, "SHARE", 8)
    day = lambda i: None if i % 2 == 0 else date(1990 + i % 2, 1 + i % 3, 1)
    row = lambda i, id, name: (id, name, day(i), ["en", "fr", None][i % 3], ["s fc", "t", None][i % 5 % 3])
    a = [row(i, i % 50, f"a{i % 4} s{i % 3}") for i in range(60)] + [row(0, 70, "s1 a1"), row(0, 71, None), row(0, 72, ""), row(2, None, "x s1")]
    b = [row(i, i % 70, f"a{i % 6} s{i % 4}") for i in range(80)] + [row(2, 90, None), row(0, 91, ""), row(4, 92, "s1")]
    frames = [spark.createDataFrame(x, "id long, name string, born date, nation string, club string").coalesce(1) for x in (a, b)]
    last = lambda name: None if name is None else name.split(" ")[-1]
    meet = lambda n, x, m, y: (x and x == y) or (last(n) is not None and last(n) == last(m) and (not x or (y and x.year == y.year)))
    pairs = {}
    for i, n, x, *_ in a:
        for j, m, y, *_ in b:
            if meet(n, x, m, y):
                pairs.setdefault((i, j), set()).add(round(identity.name_score(n, m), 9))
    got = shadow.scored(*frames, {}, ["fc"], None).collect()
    assert len(got) == len(pairs) and all(r["name_score"] in pairs[r["left_id"], r["right_id"]] for r in got)
    capped = {tuple(r): 1 for r in shadow.scored(*frames, {}, ["fc"], 10**6).collect()}
    many = {i for rows in (a, b) for i in [r[0] for r in rows] if [r[0] for r in rows].count(i) > 1}
    assert {tuple(r) for r in got if not {r["left_id"], r["right_id"]} & many} == {r for r in capped if not {r[0], r[1]} & many}


def test_crossed_names_are_scored_as_pairs_are():
    import random

    r = random.Random(7)
    words = ["".join(r.choice("abcø") for _ in range(r.choice([1, 2, 4, 7, 9, 15, 31, 32, 33, 210]))) for _ in range(60)]
    a, b = ([" ".join(r.choice(words) for _ in range(r.randrange(5))) for _ in range(n)] + ["", " ", words[0]] for n in (60, 90))
    assert identity._crossed_scores(a, b).ravel().tolist() == identity._name_scores([x for x in a for _ in b], b * len(a)).tolist()
    assert identity._crossed_scores([], b).shape == (0, len(b))


def test_decisions_of_a_common_surname(spark, folder, monkeypatch):
    """Those of all pairs, though those without a date in common are scored by kind only."""
    monkeypatch.setattr(identity, "ROWS", 64)
    pairs = matching.identity_pair_scores(spark, folder).select("left_id", "right_id", "confidence")
    got = sorted(map(tuple, matching.shadow_decisions(spark, folder).collect()))
    undated = {r["id"] for r in shadow.shadow(matching.people(spark, folder)).where("born IS NULL AND name LIKE '%attion'").collect()}
    assert undated and undated <= {r[0] for r in got}
    assert got == sorted(map(tuple, identity.decide(pairs).collect())) == sorted(want(folder, "shadow_decisions"))


def test_one_date_is_no_other_pair_of_a_year(spark):
    """A row whose kind has its own date only has no runner-up there."""
    rows = lambda *x: spark.createDataFrame([(i, "ann lee", d, "en", "s fc") for i, d in x], "id long, name string, born date, nation string, club string")
    day, other = date(1990, 1, 1), date(1990, 2, 1)
    decided = lambda a, b: [tuple(r) for r in shadow.decided(a, b, {}, ["fc"]).collect()]
    assert decided(rows((1, day)), rows((7, day))) == [(1, 7, 1.0, "matched")]
    assert decided(rows((1, day)), rows((7, day), (8, day))) == [(1, None, 1.0, "ambiguous")]
    assert decided(rows((1, other)), rows((7, day), (8, day))) == [(1, None, 0.88, "unmatched")]
    assert decided(rows((1, None)), rows((7, day), (8, None))) == [(1, None, 0.85, "unmatched")]
