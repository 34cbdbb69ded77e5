"""The snapshot-folder data source and the providers over it."""

import gzip
import json
from datetime import date

import pytest
from pyspark.sql import functions as F

from peerlens.sources import folders, providers

SCHEMA = "competition string, id int, name string, born date, height double, ok boolean"


def put(path, text, zipped=False):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(gzip.compress(text.encode()) if zipped else text.encode())


def read(spark, path, schema=SCHEMA, **options):
    folders.register(spark)
    reader = spark.read.format(folders.FORMAT).schema(schema).option("path", str(path))
    for k, v in options.items():
        reader = reader.option(k, v)
    return reader.load()


@pytest.fixture
def table(tmp_path):
    put(tmp_path / "competition=a" / "1.csv", 'id,name,born,height,ok,more\n1,"Ann, ""A""",1990-02-28,1.5,true,x\n2,Missing,1990-02-30,1e2,no,x\nbad,,x,y,z,x\n')
    put(tmp_path / "competition=b%20c" / "2.csv.gz", "name,id,height\nlineé,+7, -2\n", zipped=True)
    put(tmp_path / "competition=__HIVE_DEFAULT_PARTITION__" / "3.jsonl", json.dumps({"id": 9, "name": "j", "born": 86400, "height": 3, "ok": False}) + "\n\n" + json.dumps({"data": [{"id": 10}, {"id": 99999999999}, "no record"]}) + "\n")
    put(tmp_path / "competition=a" / "_hidden.csv", "id\n5\n")
    put(tmp_path / "competition=e" / "empty.csv", "")
    put(tmp_path / "competition=e" / "head.csv", "id,name\n")
    return tmp_path


def test_values_of_all_layouts(spark, table):
    got = {(r["competition"], r["id"], r["name"]): tuple(r)[3:] for r in read(spark, table).collect()}
    assert got == {
        ("a", 1, 'Ann, "A"'): (date(1990, 2, 28), 1.5, True), ("a", 2, None): (None, 100.0, False), ("a", None, None): (None, None, None),
        ("b c", 7, "lineé"): (None, -2.0, None), (None, 9, "j"): (date(1970, 1, 2), 3.0, False), (None, 10, None): (None, None, None), (None, None, None): (None, None, None),
    }


def test_filters_are_pushed_and_whole_files_left_out(spark, table):
    df = read(spark, table).where("competition = 'a' AND id > 1")
    plan = df._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    assert "PushedFilters: [IsNotNull(competition), IsNotNull(id), EqualTo(competition,a), GreaterThan(id,1)]" in plan and "Filter" not in plan.replace("PushedFilters", "").replace("RuntimeFilters", "")
    assert [r["id"] for r in df.collect()] == [2] and df.rdd.getNumPartitions() == 1
    assert read(spark, table).rdd.getNumPartitions() == 5
    for test in ("competition IN ('a', 'e')", "competition IS NULL", "id IS NULL", "name = 'j' OR id = 1", "competition <> 'a'", "height <= -2.0", "born = DATE'1990-02-28'", "competition <=> 'a'", "upper(competition) = 'A'", "id IN (1, 9, 10)", "ok = false"):
        every = read(spark, table).collect()
        want = spark.createDataFrame(every, read(spark, table).schema).where(test).collect()
        assert sorted(map(repr, read(spark, table).where(test).collect())) == sorted(map(repr, want)), test
    assert read(spark, table).where("competition = 'nobody'").count() == 0


def test_columns_of_fewer_and_nested_paths(spark, tmp_path):
    assert read(spark, tmp_path).count() == 0
    line = {"kind": "player", "player_id": 5, "data": {"detailed": {"goals": "3", "xg": "x", "all": [1, 2]}, "player_id": 6}}
    put(tmp_path / "s.jsonl", json.dumps({"kind": "roster"}) + "\n" + json.dumps(line) + "\n")
    paths = {"id": "player_id", "goals": "detailed.goals", "xg": "detailed.xg", "all": "detailed.all"}
    df = read(spark, tmp_path, "id long, goals int, xg double, all string", paths=json.dumps(paths), kind="player")
    assert [tuple(r) for r in df.collect()] == [(6, 3, None, "[1, 2]")]
    assert df.select("goals").count() == 1
    with pytest.raises(Exception, match="no folder"):
        read(spark, tmp_path / "none").count()
    with pytest.raises(Exception, match="stated schema"):
        spark.read.format(folders.FORMAT).option("path", str(tmp_path)).load().count()


def test_many_rows_in_one_file(spark, tmp_path):
    put(tmp_path / "x.csv.gz", "id,name\n" + "".join(f'{i},"a\nb{i}"\n' for i in range(30_000)), zipped=True)
    df = read(spark, tmp_path, "id long, name string")
    assert df.agg(F.sum("id"), F.count("name"), F.max(F.length("name"))).first()[:] == (30_000 * 29_999 // 2, 30_000, 8)


def test_a_stream_takes_new_files_once(spark, tmp_path):
    folders.register(spark)
    rows = spark.readStream.format(folders.FORMAT).schema("id long").option("path", str(tmp_path / "in")).load()
    run = lambda: rows.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()
    for i in range(3):
        put(tmp_path / "in" / f"{9 - i}.csv", f"id\n{i}\n")
        run()
        assert sorted(r["id"] for r in spark.read.parquet(str(tmp_path / "out")).collect()) == list(range(i + 1))
    run()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 3


def stats(spark):
    rows = [(c, s, f"{c}{i}", 100 * i, None if i == 2 else 50 * i, i, i, i, 0, 0, 1) for c in "ab" for s in ("1996", "1997") for i in range(4)]
    return spark.createDataFrame(rows, providers.PERFORMANCE["player_stats"])


@pytest.mark.parametrize("layout", ["csv", "json"])
def test_performance_provider(spark, tmp_path, layout):
    providers.export(stats(spark), str(tmp_path), "player_stats", ["competition_id"], layout)
    with pytest.raises(ValueError, match="clubs, players"):
        providers.build(spark, "performance", "live", {"live": str(tmp_path)})
    for table, row in (("competitions", ("a", "A", "x")), ("seasons", ("a", "1996", 1996)), ("clubs", ("a", "1996", "k", "K")), ("players", ("a", "1996", "a1", "Ann", date(1990, 1, 2), "g"))):
        providers.export(spark.createDataFrame([row], providers.PERFORMANCE[table]), str(tmp_path), table, layout=layout)
    p = providers.build(spark, "performance", "live", {"live": str(tmp_path)})
    assert p.health() == (True, None) and sorted(map(repr, p.competition_stats().collect())) == sorted(map(repr, stats(spark).collect()))
    assert p.competition_stats("a", "1997").count() == 4 and p.player_stats("b3").count() == 2 and p.player_stats("b3", "1996").first()["minutes"] == 300
    assert p.players("a", "1996").first()["born"] == date(1990, 1, 2) and p.players("b").count() == 0 and p.clubs().count() == p.seasons("a").count() == p.competitions().count() == 1
    assert {r["metric"]: r["known"] for r in p.info().collect()}["recorded_minutes"] == 12
    for bad in (("performance", "demo"), ("weather", "live")):
        with pytest.raises(ValueError):
            providers.build(spark, *bad, {"live": str(tmp_path)})
    with pytest.raises(ValueError, match="no table"):
        p.table("transfers")


def test_market_provider(spark, tmp_path):
    put(tmp_path / "competitions" / "x.csv", "competition_id,name,country\nc1,One,X\n")
    put(tmp_path / "clubs" / "x.csv", "club_id,name,competition_id\nk1,K,c1\nk2,L,c9\n")
    put(tmp_path / "players" / "x.csv", "competition_id,player_id,name,born,height,foot,market_value\nc1,p1,Ann,1990-01-01,18,left,5\nc2,p2,Bo,,180,,-1\n")
    put(tmp_path / "values" / "x.csv", "player_id,valued_on,amount,club_id\np1,2001-01-01,10,k1\np1,2000-01-01,5,k1\np1,,7,k1\np1,2002-01-01,-3,k1\np2,2000-05-05,1,k2\n")
    put(tmp_path / "transfers" / "x.csv", "player_id,moved_on,from_club,to_club,fee\np1,2003-01-01,k1,k2,0\np1,,k2,k3,\np1,2001-01-01,k0,k1,9\n")
    p = providers.build(spark, "market", "live", {"live": str(tmp_path)})
    assert sorted((r["club_id"], r["country"]) for r in p.clubs().collect()) == [("k1", "X"), ("k2", None)]
    assert [(r["player_id"], r["height"], r["market_value"]) for r in p.players("c1").collect()] == [("p1", None, 5)]
    assert [(r["place"], r["amount"]) for r in p.value_history("p1").orderBy("place").collect()] == [(1, 5), (2, 10)]
    assert [(r["place"], r["to_club"], r["fee"]) for r in p.transfers("p1").orderBy("place").collect()] == [(1, "k1", 9), (2, "k2", 0), (3, "k3", None)]
    assert sorted((r["entity"], r["entity_id"], r["field"], r["raw_value"]) for r in p.issues().collect()) == [("players", "p1", "height", "18"), ("players", "p2", "market_value", "-1"), ("values", "p1", "amount", "-3")]
